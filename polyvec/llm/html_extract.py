"""Main text of web pages by tree scoring.

Paragraphs give points to their ancestors: one, one more for each comma, and one for each hundred
characters up to three. The parent takes all of it, the grandparent half, the next two ancestors
a sixth and an eighth. A container's points are discounted by its link density. The best
container is kept with those of its siblings that look like text.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvec.llm.textvec import slices

_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</\s*([a-zA-Z][^\s></]*)[^>]*>?|[^<]+|<", re.S)
_OPEN = re.compile(r"<([a-zA-Z][^\s></]*)")
_STOP = re.compile(r"[<>\"']")
_NAME = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe svg object select button textarea head title".split())
RAW = frozenset("script style noscript template textarea title".split())
_RAW_END = {tag: re.compile(rf"</\s*{tag}\b[^>]*>?", re.I) for tag in RAW}
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset(("p", "pre", "td", "blockquote", "li", "dd"))
#: A tag that opens closes an open one of these, up to a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("html body div article section main table ul ol dl blockquote td th form aside nav header footer".split())
START = {"article": 8.0, "main": 8.0, "section": 3.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "address": -3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "dd": -3.0, "dt": -3.0, "li": -3.0, "form": -3.0, "th": -5.0, "h1": -5.0, "h2": -5.0, "h3": -5.0, "nav": -25.0, "footer": -25.0, "aside": -25.0, "header": -10.0}
GOOD = re.compile(r"article|body|content|entry|main|page|post|text|blog|story", re.I)
BAD = re.compile(r"\bads?\b|advert|banner|combx|comment|contact|cookie|foot|masthead|menu|meta|nav|popup|promo|related|share|sidebar|social|sponsor|subscribe|widget", re.I)
LEAST = 25


class Node:
    __slots__ = ("tag", "parent", "kids", "weight", "points", "scored", "chars", "linked", "place")

    def __init__(self, tag: str, parent: Node | None, weight: float, place: int):
        self.tag, self.parent, self.weight, self.place = tag, parent, weight, place
        self.kids: list = []  # nodes and texts in order
        self.points, self.scored, self.chars, self.linked = 0.0, False, 0, 0


class Tags:
    """Ends of tags in one pass: what a tag has scanned is not scanned again.

    A tag ends at the first > outside quotes. A quote without a partner is an ordinary sign. A tag
    without > ends before the next < outside quotes, or with the page."""

    def __init__(self, source: str):
        self.source = source
        self.partner = {'"': True, "'": True}  # may there be another one further on?

    def end(self, at: int) -> tuple[int, int]:
        """(end of the attributes, end of the tag) of the tag whose name ends at `at`."""
        source = self.source
        while True:
            m = _STOP.search(source, at)
            if m is None:
                return len(source), len(source)
            sign, place = m[0], m.start()
            if sign == ">":
                return place, place + 1
            if sign == "<":
                return place, place
            at = place + 1
            if self.partner[sign]:
                close = source.find(sign, at)
                if close < 0:
                    self.partner[sign] = False
                else:
                    at = close + 1


class Open:
    """The open elements, innermost last, and where those of a name are: no step climbs the tree."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.at: dict[str, list[int]] = {}
        self.fences: list[int] = []  # of FENCES
        self.hard: list[int] = []  # of those, without cells

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else 0

    def push(self, node: Node) -> None:
        tag, place = node.tag, len(self.nodes)
        self.at.setdefault(tag, []).append(place)
        if tag in FENCES:
            self.fences.append(place)
            if tag not in ("td", "th"):
                self.hard.append(place)
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Closes the element at place and all in it."""
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            for places in (self.fences, self.hard):
                if places and places[-1] == len(self.nodes):
                    places.pop()

    def before(self, tag: str) -> None:
        """Closes what an opening tag ends without an end tag of its own."""
        if tag in BLOCKS and tag != "hr":  # an open paragraph ends where a block starts
            p = self.last("p")
            if p > max(self.fences[-1] if self.fences else 0, self.last("li")):
                self.cut(p)
        if tag in CLOSES:
            near = max(self.last(t) for t in CLOSES[tag])
            if near > (self.hard[-1] if self.hard else 0):
                self.cut(near)
                if tag == "tr" and self.nodes[-1].tag == "tr":
                    self.cut(len(self.nodes) - 1)

    def close(self, tag: str) -> None:
        """An end tag: closes the innermost element of its name, but none across a container."""
        place = self.last(tag)
        if place and (tag in FENCES or place > (self.fences[-1] if self.fences else 0)):
            self.cut(place)


def tree(source: str) -> tuple[Node, str]:
    """(root, title), in time linear in the page. Never fails: what is no tag is text, and open tags
    close at the end."""
    root = Node("#root", None, 0.0, 0)
    title, place = "", 0
    at, size = 0, len(source)
    tags, opened = Tags(source), Open(root)
    while at < size:
        begin = _OPEN.match(source, at) if source[at] == "<" else None
        if begin:
            stop, at = tags.end(begin.end())
            tag, attributes = begin[1].lower(), source[begin.end() : stop]
            if tag in RAW and not attributes.endswith("/"):
                end = _RAW_END[tag].search(source, at)
                if tag == "title" and not title:
                    title = _SPACE.sub(" ", _html.unescape(source[at : end.start() if end else size])).strip()
                at = end.end() if end else size
                continue
            opened.before(tag)
            node = opened.nodes[-1]
            if tag in ("br", "hr"):
                node.kids.append("\n")
                continue
            if tag in VOID:
                continue
            weight = START.get(tag, 0.0)
            if len(attributes) > 4:
                for a, b, c in _NAME.findall(attributes):
                    name = a or b or c
                    weight += (25.0 if GOOD.search(name) else 0.0) - (25.0 if BAD.search(name) else 0.0)
            place += 1
            new = Node(tag, node, weight, place)
            node.kids.append(new)
            if not attributes.endswith("/"):
                opened.push(new)
            continue
        m = _OTHER.match(source, at)
        at = m.end()
        if m[1]:
            opened.close(m[1].lower())
        elif m[0][0] != "<" or m[0] == "<":
            opened.nodes[-1].kids.append(_html.unescape(m[0]))
        elif m[0].startswith("<![CDATA["):
            opened.nodes[-1].kids.append(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
    return root, title


def _walk(root: Node) -> list[Node]:
    """All nodes that show, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node) and k.tag not in HIDDEN)
    return out


def _own_text(node: Node) -> str:
    """The text of a node and of the inline nodes in it, white space folded."""
    parts, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is node or (x.tag not in BLOCKS and x.tag not in HIDDEN):
            stack.extend(reversed(x.kids))
    return _SPACE.sub(" ", "".join(parts)).strip()


def _lines(node: Node, drop: frozenset) -> list[str]:
    """The text below a node by blocks and line breaks."""
    out, line = [], []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if x == "\n":
                out.append("".join(line))
                line = []
            else:
                line.append(_SPACE.sub(" ", x))
        elif x is None:
            out.append("".join(line))
            line = []
        elif x.tag not in HIDDEN and x.place not in drop:
            block = x.tag in BLOCKS
            if block:
                stack.append(None)
            stack.extend(reversed(x.kids))
            if block:
                stack.append(None)
    out.append("".join(line))
    return [t for t in (_SPACE.sub(" ", x).strip() for x in out) if t]


def extract(source: str) -> tuple[str, str, float, str]:
    """(title, text, points, tag) of the best container; ("", "", 0, "") parts where there is none.

    Ties go to the container that comes first. Without any scored container, the whole text counts.
    """
    root, title = tree(source)
    nodes = _walk(root)
    for node in reversed(nodes):  # children before parents: text and link sizes
        own = sum(len(_SPACE.sub(" ", k).strip()) for k in node.kids if isinstance(k, str))
        node.chars += own
        if node.tag == "a":
            node.linked = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    for node in nodes:
        if node.tag not in PARAGRAPHS and not (node.tag in ("div", "section", "article", "main") and not any(isinstance(k, Node) and k.tag in BLOCKS for k in node.kids)):
            continue
        text = _own_text(node)
        if len(text) < LEAST:
            continue
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        up = node.parent if node.tag in PARAGRAPHS else node
        for share in (1, 2, 6, 8):
            if up is None or up.parent is None:
                break
            if not up.scored:
                up.scored, up.points = True, up.points + up.weight
            up.points += points / share
            up = up.parent
    best, most = None, 0.0
    for node in nodes:
        if node.scored and node.chars:
            node.points *= 1 - min(1.0, node.linked / node.chars)
            if best is None or node.points > most:
                best, most = node, node.points
    if best is None:
        return title, "\n".join(_lines(root, frozenset())), 0.0, ""
    least = max(10.0, most * 0.2)
    kept: list[str] = []
    # Blocks that lose points as navigation or advertisement are left out of what is kept.
    drop = frozenset(n.place for n in nodes if n.weight <= -15 and n is not best)
    for node in best.parent.kids:
        if not isinstance(node, Node) or node.tag in HIDDEN:
            continue
        take = node is best or (node.scored and node.points >= least)
        if not take and node.tag == "p":
            density = node.linked / node.chars if node.chars else 1.0
            text = _own_text(node)
            take = (len(text) > 80 and density < 0.25) or (0 < len(text) <= 80 and density == 0 and re.search(r"[.!?。](\s|$)", text) is not None)
        if take:
            kept += _lines(node, drop)
    return title, "\n".join(kept), most, best.tag


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, title, text, points, container of every page.

    A null html gives nulls, an empty one empty strings and 0 points; a null page_id stays null.
    Pages are parsed whole, in time linear in their length, also broken ones. Repeated rows are
    parsed each; of containers with equal points the first counts. Columns other than page_id and
    html are ignored, whatever their names; an empty table gives no rows.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "html"):
                rows = [extract(x) if x is not None else (None,) * 4 for x in batch.column("html").to_pylist()]
                title, text, points, tag = zip(*rows, strict=True)
                yield pa.record_batch([batch.column("page_id"), pa.array(title, pa.string()), pa.array(text, pa.string()), pa.array(points, pa.float64()), pa.array(tag, pa.string())], names=["page_id", "title", "text", "points", "container"])

    source = pages.select(F.col("page_id"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, f"page_id {kind}, title string, text string, points double, container string")
