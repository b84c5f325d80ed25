"""Code units of languages that mark blocks by braces, by one scanner and a table of patterns.

Comments and strings are blanked first, so that braces and names in them do not count. Definitions are
found by each language's patterns, their ends by the braces; a definition inside a class, an impl block
or with a receiver is a method of that type. Functions inside functions are units too. A file that
nests deeper than the limit has no units.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_C_LIKE = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
_JS_MASK = re.compile(_C_LIKE + "|" + _QUOTED + r"|`(?:\\.|[^`\\])*`?", re.S)
_GO_MASK = re.compile(_C_LIKE + "|" + _QUOTED + r"|`[^`]*`?", re.S)
_RUST_MASK = re.compile(_C_LIKE + r"|r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"?|'(?:\\[^\n]{1,8}?|[^'\\\n])'", re.S)
_C_MASK = re.compile(_C_LIKE + r"|R\"(\w*)\(.*?\)\1\"|" + _QUOTED, re.S)
_JAVA_MASK = re.compile(_C_LIKE + r"|\"\"\".*?(?:\"\"\"|\Z)|" + _QUOTED, re.S)
_PHP_MASK = re.compile(_C_LIKE + r"|\#(?!\[)[^\n]*|\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?", re.S)

_ARGS = r"\((?P<args>[^(){};]*(?:\([^()]*\)[^(){};]*)*)\)"
_TYPED = r"^[ \t]*(?:@\w+(?:\([^)]*\))?[ \t]+)*(?!(?:return|else|new|throw|case|goto|await|yield|using|import|package)\b)(?:[\w<>\[\],.&*:~?]+[ \t*&]+)*?(?P<name>~?[A-Za-z_]\w*(?:::~?\w+)*)\s*" + _ARGS
_AFTER = r"\s*(?:(?:const|noexcept|override|final|async|throws\s+[\w., \t]+|where\s+[^{]+|->\s*[\w:<>*& ]+|:\s*[^{;]+)\s*)*\{"


@dataclass(frozen=True)
class Language:
    mask: re.Pattern
    functions: tuple[str, ...]
    classes: tuple[str, ...]
    constants: tuple[str, ...] = ()
    owners: tuple[str, ...] = ()  # blocks that are no unit but whose functions are methods of the named type
    imports: tuple[str, ...] = ()
    classes_only: bool = False  # functions only in classes


_JS = Language(
    _JS_MASK,
    (
        r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^>]*>)?" + _ARGS,
        r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\((?P<args>[^()]*)\)|[\w$]+)\s*(?::[^=\n{]+)?=>",
        r"^[ \t]+(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?(?P<name>#?[\w$]+)\s*(?:<[^>]*>)?" + _ARGS + r"\s*(?::[^{;\n]+)?\{",
    ),
    (r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)(?:<[^>]*>)?(?:\s+extends\s+(?P<base>[\w$.]+))?", r"^[ \t]*(?:export\s+)?(?:declare\s+)?(?:interface|enum)\s+(?P<name>[\w$]+)(?:\s+extends\s+(?P<base>[\w$.]+))?"),
    (r"^(?:export\s+)?const\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=(?!>)",),
    imports=(r"^\s*import\b[^'\"\n]*['\"](?P<name>[^'\"]+)['\"]", r"\brequire\(\s*['\"](?P<name>[^'\"]+)['\"]"),
)
_GO = Language(_GO_MASK, (r"^func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?" + _ARGS,), (r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?:struct|interface)\b",), (r"^(?:const|var)\s+(?P<name>\w+)\b",), imports=(r"^\s*import\s+(?:\w+\s+)?\"(?P<name>[^\"]+)\"", r"^\s+(?:\w+\s+)?\"(?P<name>[\w./-]+)\"\s*$"))
_RUST = Language(
    _RUST_MASK,
    (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:(?:const|async|unsafe|extern)\s+)*fn\s+(?P<name>\w+)\s*(?:<[^({]*>)?\s*" + _ARGS,),
    (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+(?P<name>\w+)",),
    (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>\w+)\s*:",),
    (r"^[ \t]*(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+(?:[\w:<>, &']+\s+for\s+)?(?P<name>\w+)",),
    (r"^\s*(?:pub\s+)?use\s+(?P<name>[\w:]+)",),
)
_C = Language(_C_MASK, (_TYPED + _AFTER,), (r"^[ \t]*(?:typedef\s+)?(?:template\s*<[^>]*>\s*)?(?:class|struct|union|enum(?:\s+class)?)\s+(?P<name>\w+)(?:\s+final)?(?:\s*:\s*(?:public|private|protected)?\s*(?P<base>[\w:]+))?[^;{()=]*(?=\{)",), (r"^[ \t]*#define\s+(?P<name>[A-Z_][A-Z0-9_]*)\b", r"^(?:static\s+)?(?:const|constexpr)\s+[\w:<>*& ]+?\b(?P<name>\w+)\s*="), imports=(r"^\s*#include\s+[<\"](?P<name>[^>\"]+)[>\"]",))
_JAVA = Language(_JAVA_MASK, (_TYPED + _AFTER,), (r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|internal|static|abstract|final|sealed|partial|readonly)\s+)*(?:class|interface|enum|record|struct|@interface)\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s*(?:extends|:)\s+(?P<base>[\w.]+))?",), imports=(r"^\s*(?:import|using)\s+(?:static\s+)?(?P<name>[\w.]+)",), classes_only=True)
_FUN = Language(
    _JAVA_MASK,
    (r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|internal|open|override|final|static|suspend|inline|mutating|abstract|implicit|fileprivate|async|external)\s+)*(?:fun|func|def)\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<name>\w+)\s*(?:[<\[][^(]*[>\]])?\s*" + _ARGS,),
    (r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|internal|open|final|abstract|sealed|data|case|implicit|fileprivate|inner|enum|value)\s+)*(?:class|interface|object|trait|struct|protocol|enum|extension|actor|mixin)\s+(?P<name>\w+)(?:[<\[][^>\]]*[>\]])?(?:\s*\([^)]*\))?(?:\s*(?:extends|:)\s+(?P<base>[\w.]+))?",),
    (r"^(?:const\s+)?(?:val|let)\s+(?P<name>[A-Z][A-Z0-9_]*)\b",),
    imports=(r"^\s*import\s+(?P<name>[\w.]+)",),
)
_PHP = Language(_PHP_MASK, (r"^[ \t]*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(?P<name>\w+)\s*" + _ARGS,), (r"^[ \t]*(?:(?:abstract|final|readonly)\s+)*(?:class|interface|trait|enum)\s+(?P<name>\w+)(?:\s+extends\s+(?P<base>[\w\\]+))?",), (r"^const\s+(?P<name>\w+)\s*=",), imports=(r"^use\s+(?P<name>[\w\\]+)",))

LANGUAGES = {"javascript": _JS, "typescript": _JS, "go": _GO, "rust": _RUST, "c": _C, "cpp": _C, "java": _JAVA, "csharp": _JAVA, "kotlin": _FUN, "swift": _FUN, "scala": _FUN, "php": _PHP}
KEYWORDS = frozenset("if else for while switch match catch return sizeof new throw do try loop fn func function fun def class struct when guard select defer async await typeof instanceof in of and or not unsafe move foreach using lock synchronized fixed assert super this self elseif alignof decltype static_assert".split())
_CALL = re.compile(r"(?<![\w$#])([A-Za-z_$][\w$]*)!?\s*(?:::<[^>()]*>)?\(")
_LOOP, _BRANCH = re.compile(r"\b(?:for|while|loop|foreach|do)\b"), re.compile(r"\b(?:if|switch|match|case|when|guard|select)\b")
_TRY = re.compile(r"\b(?:try|catch|throw|throws|panic|recover|except|rescue|Result|unwrap|expect)\b")
_LOCAL = re.compile(r"\b(?:let|const|var|val|auto)\s+(?:mut\s+)?([A-Za-z_$][\w$]*)|\b([A-Za-z_]\w*)\s*:=")


def _blank(mask: re.Pattern, source: str) -> str:
    """source with comments and strings as blanks, line breaks kept."""
    return mask.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


class _Braces:
    """Where each open brace ends, in one pass."""

    def __init__(self, text: str):
        self.end: dict[int, int] = {}
        self.opens: list[int] = []
        stack: list[int] = []
        self.deepest = 0
        for m in re.finditer(r"[{}]", text):
            if m[0] == "{":
                stack.append(m.start())
                self.opens.append(m.start())
                self.deepest = max(self.deepest, len(stack))
            elif stack:
                self.end[stack.pop()] = m.start()
        for at in stack:  # unclosed: to the end of the file
            self.end[at] = len(text) - 1

    def next(self, at: int) -> int | None:
        k = bisect_right(self.opens, at - 1)
        return self.opens[k] if k < len(self.opens) else None


def _statement_end(text: str, at: int, braces: _Braces) -> int:
    """The end of a statement that begins at `at`: past its braces and brackets, at a semicolon or line's end."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c == "{":
            at = braces.end[at]
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth <= 0 and c in ";\n":
            return at - (c == "\n")
        at += 1
    return len(text) - 1


def _comment_above(lines: list[str], line: int) -> str | None:
    """The comment that ends right above a line (from 1), without its marks."""
    out: list[str] = []
    k = line - 2
    while k >= 0 and re.match(r"\s*(//|\*|/\*|#(?!\[|include|define|pragma))", lines[k]):
        out.append(re.sub(r"^\s*(?:/{2,}!?|/\*+!?|\*+/?|#+)\s?|\s*\*+/\s*$", "", lines[k]).strip())
        k -= 1
    return "\n".join(x for x in reversed(out) if x) or None


def _names(args: str | None, first: bool = False) -> list[str]:
    """Parameter names: before a colon, else the last word of each part (the first in Go, where types follow)."""
    out = []
    for part in re.split(r",(?![^<(\[]*[>)\]])", args or ""):
        part = re.sub(r"=.*", "", part).strip()
        if part.startswith(("self", "&self", "&mut self", "mut self")):
            continue
        head = part.split(":")[0] if re.search(r"(?<!:):(?!:)", part) else part
        words = re.findall(r"\$?[A-Za-z_]\w*", head)
        if words and words != ["void"]:
            out.append(words[0 if first else -1].lstrip("$"))
    return out


def brace_units(path: str, source: str, kind: str, unit, gaps, depth_limit: int = 1024, shift: int = 0) -> list[dict]:
    """The units of one file. unit and gaps make units and those of uncovered lines; shift: the lines before
    the source in its file, as for a script in a page."""
    own = LANGUAGES[kind]
    text = _blank(own.mask, source)
    braces = _Braces(text)
    if braces.deepest > depth_limit:
        return []
    lines = source.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)

    def line_of(at: int) -> int:
        return bisect_right(starts, at)

    imports = sorted({m["name"] for p in own.imports for m in re.finditer(p, source, re.M)})
    blocks: list[tuple[int, int, str]] = []  # classes and owners: where methods are
    found: list[dict] = []

    def definition(m: re.Match) -> tuple[int, int]:
        """(start, end) of a definition: to the end of its block, or of its statement if that comes first."""
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        block = braces.next(m.end() - 1)
        stop = text.find(";", m.end())
        if block is None or (0 <= stop < block):
            return start, stop if stop >= 0 else _statement_end(text, m.end(), braces)
        return start, braces.end[block]

    for p in own.classes:
        for m in re.finditer(p, text, re.M):
            start, end = definition(m)
            blocks.append((start, end, m["name"]))
            found.append({"kind": "class", "name": m["name"], "start": start, "end": end, "base": m.groupdict().get("base"), "args": None, "owner": None})
    for p in own.owners:
        for m in re.finditer(p, text, re.M):
            start, end = definition(m)
            blocks.append((start, end, m["name"]))

    def inside(at: int) -> str | None:
        near = [b for b in blocks if b[0] < at <= b[1]]
        return max(near)[2] if near else None

    seen: set[int] = set()
    for p in own.functions:
        for m in re.finditer(p, text, re.M):
            name = m["name"].split("::")[-1]
            at = m.start("name")
            if name in KEYWORDS or at in seen or any(b[0] <= at <= b[0] + 1 for b in blocks):
                continue
            owner = m.groupdict().get("owner") or (m["name"].split("::")[-2] if "::" in m["name"] else inside(at))
            arrow = m[0].rstrip().endswith("=>")
            only_method = p is own.functions[-1] and len(own.functions) == 3  # the form without a keyword
            if (own.classes_only or only_method) and owner is None:
                continue
            if arrow:
                start, end = m.start() + len(m[0]) - len(m[0].lstrip()), _statement_end(text, m.end(), braces)
            else:
                begin = m.start() + len(m[0]) - len(m[0].lstrip())
                block = m.end() - 1 if m[0].endswith("{") else braces.next(m.end() - 1)
                stop = text.find(";", m.end()) if not m[0].endswith("{") else -1
                line_end = text.find("\n", m.end())
                if block is None or 0 <= stop < block:  # only declared, or a body without braces
                    start, end = begin, stop if stop >= 0 else _statement_end(text, m.end(), braces)
                elif kind in ("kotlin", "scala") and 0 <= line_end < block and "=" in text[m.end() : line_end]:
                    start, end = begin, line_end - 1
                else:
                    start, end = begin, braces.end[block]
            seen.add(at)
            found.append({"kind": "method" if owner else "function", "name": name.lstrip("#"), "start": start, "end": end, "args": m["args"], "owner": owner, "base": None})
    covered = sorted((f["start"], f["end"]) for f in found)
    for p in own.constants:
        for m in re.finditer(p, source if p.startswith(r"^[ \t]*#define") else text, re.M):
            at = m.start("name")
            if at in seen or any(a < at < b for a, b in covered):
                continue
            seen.add(at)
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            end = text.find("\n", m.end()) - 1 if "#define" in p else _statement_end(text, m.end(), braces)
            found.append({"kind": "constant", "name": m["name"], "start": start, "end": end if end >= start else len(text) - 1, "args": None, "owner": None, "base": None})
    out = []
    for f in sorted(found, key=lambda f: (f["start"], -f["end"])):
        first, last = line_of(f["start"]), line_of(f["end"])
        signature = lines[first - 1].strip()
        while first > 1 and re.match(r"\s*(@\w|#\[|\[\w)", lines[first - 2]):  # attributes belong to what they are on
            first -= 1
        more: dict = {"language": kind, "parent_class": f["owner"], "signature": signature, "docstring": _comment_above(lines, first)}
        if f["kind"] == "class":
            more["extends"] = f["base"]
        elif f["kind"] != "constant":
            block = text.find("{", f["start"], f["end"] + 1)
            body = text[block if block >= 0 else f["start"] : f["end"] + 1]
            loops, branches = len(_LOOP.findall(body)), len(_BRANCH.findall(body))
            code = source[f["start"] : f["end"] + 1]
            more |= {
                "parameters": _names(f["args"], kind == "go"), "calls": sorted({c for c in _CALL.findall(body) if c not in KEYWORDS} - ({f["name"]} if block < 0 else set())), "variables": sorted({a or b for a, b in _LOCAL.findall(body)}),
                "imports": [i for i in imports if re.search(rf"\b{re.escape(re.split(r'[./:]+', i.rstrip('./:'))[-1])}\b", code)], "complexity": 1 + loops + branches,
                "has_loops": loops > 0, "has_branches": branches > 0, "has_error_handling": bool(_TRY.search(body)),
            }
        out.append(unit(path, f["kind"], f["name"], first, last, lines, **more))
    out += gaps(path, lines, out, imports)
    for u in out:
        u["language"] = kind
        if shift:
            if u["unit_type"] == "rawcode":
                u["name"] = f"raw_code_{u['line'] + shift}"
                u["qualified_name"] = f"{path}::{u['name']}"
            u["line"], u["end_line"] = u["line"] + shift, u["end_line"] + shift
    return out
