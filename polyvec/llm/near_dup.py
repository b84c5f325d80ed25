"""Near-duplicate groups by a Chosen-Path set similarity join over minwise tokens.

A document is the set of its word 3-grams. Each of a number of independent random trees picks
minwise coordinates with probability 1/(threshold * COORDS) each; a document goes to the node named by
its own minwise token there. Two sets of similarity J then share an expected J/threshold nodes a tree,
unrelated ones next to none. Node ids are hashes, so all trees are one shuffle on the node id.

A link is a pair that shares a node and is similar by the estimate. Both depend on the two texts only:
every node, whatever its size, yields the links of all its pairs. Sizes decide how a node is compared,
not what is found:

* A node of at most ``leaf`` documents is compared exhaustively, with others of that kind at once.
* In a larger one rows found connected share a label, and pairs of one label need no comparison. ``leaf``
  documents outside the commonest label are compared with all, again and again.
* Where that stays much work, the node branches on so many bands of coordinates that no similar pair can
  differ in all of them: two rows that agree in all but m coordinates agree in one of m + 1 bands at
  least. The children are compared exhaustively. Where bands separate little, all pairs are compared.
* A node of more than ``held`` rows is dealt out to several tasks; each compares two shares, and every
  two shares meet.

Whole texts count, every document is a query, and nothing is capped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from polyvec.llm.scratch import Scratch, column, fresh
from polyvec.llm.textvec import U64, mix64, slices, word_hashes
from polyvec.operators.index import numbered

COORDS = 256
SHINGLE = 3
HELD = 1 << 17  # rows of a node held in a task, or half of them; a larger node is dealt out, all rows
MUCH = 1 << 24  # pairs of a node above which bands are tried
SEEN = 1 << 8  # one text in so many is looked at to find the nodes that are dealt out
_A = (mix64(np.arange(1, COORDS + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix64(np.arange(10_001, COORDS + 10_001, dtype=U64)) >> U64(32)).astype(np.uint32)


def survival(depth: int, threshold: float = 0.5) -> float:
    """The chance that two sets of just the threshold's similarity share a node at a level of one tree."""
    out = 1.0
    for _ in range(depth):
        out = 1 - (1 - out / (threshold * COORDS)) ** (threshold * COORDS)
    return out


def trees_for(recall: float, depth: int, threshold: float = 0.5) -> int:
    """Independent trees with which such a pair shares a node at the deepest level with probability recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(depth, threshold))))


def shingles(column, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the word k-grams, number of them by document). A text of fewer than k
    words has one shingle, all its words; one without words has none."""
    h, doc, _ = word_hashes(column)
    words = np.bincount(doc, minlength=len(column)) if len(doc) else np.zeros(len(column), np.int64)
    count = np.where(words > 0, np.maximum(1, words - k + 1), 0)
    total = int(count.sum())
    if not total:
        return np.zeros(0, U64), count
    first = np.cumsum(words) - words
    at = np.arange(total) + np.repeat(first - (np.cumsum(count) - count), count)
    end = np.repeat(first + words, count)
    out = np.zeros(total, U64)
    for j in range(k):
        part = h[np.minimum(at + j, len(h) - 1)]
        out = mix64(out + U64(0x9E3779B97F4A7C15)) ^ np.where(at + j < end, part, U64(j + 1))
    return mix64(out), count


def signatures(sh: np.ndarray, count: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """uint32 [documents with shingles, COORDS]: the least value of each random permutation."""
    count = count[count > 0]
    out = np.full((COORDS, len(count)), 0xFFFFFFFF, np.uint32)
    ends = np.cumsum(count)
    low = (sh >> U64(32)).astype(np.uint32)
    doc = 0
    for start in range(0, len(low), block):
        stop = min(len(low), start + block)
        last = int(np.searchsorted(ends, stop - 1, side="right"))  # the document of the block's end
        cuts = np.concatenate(([0], ends[doc:last] - start))
        part, buffer = low[start:stop], np.empty(stop - start, np.uint32)
        rows = slice(doc, last + 1)
        for i in range(COORDS):
            np.multiply(part, _A[i], out=buffer)
            np.add(buffer, _B[i], out=buffer)
            np.minimum(out[i, rows], np.minimum.reduceat(buffer, cuts), out=out[i, rows])
        doc = last if ends[last] > stop else last + 1
    return np.ascontiguousarray(out.T)


def chosen(node: np.ndarray, level: int, rate: float) -> np.ndarray:
    """bool [nodes, COORDS]: the coordinates that each node branches on, a function of its id."""
    salt = mix64(np.arange(1, COORDS + 1, dtype=U64) + U64(level * 1_000_003))
    draw = mix64(node[:, None] ^ salt[None, :]) >> U64(11)
    return draw < U64(int(rate * 2**53))


def children(node: np.ndarray, tokens: np.ndarray, level: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child id) for every document row and coordinate chosen at its node."""
    row, coord = np.nonzero(chosen(node, level, rate))
    token = tokens[row, coord].astype(U64)
    return row, mix64(mix64(node[row] + U64(level)) ^ (token << U64(16)) ^ coord.astype(U64))


def _signed(batches, trees: int, rate: float):
    for whole in batches:
        for batch in slices(whole, "text"):
            sh, count = shingles(batch.column("text"))
            has = count > 0
            if not has.any():
                continue
            sig = signatures(sh, count)
            n = len(sig)
            sums = np.add.reduceat(sh, (np.cumsum(count) - count)[has])
            print_of = mix64(sums ^ mix64(count[has].astype(U64)))
            for j in range(0, COORDS, 32):
                print_of = mix64(print_of + np.bitwise_xor.reduce(sig[:, j : j + 32].astype(U64) << (np.arange(32, dtype=U64)), axis=1))
            roots: list[np.ndarray] = []
            rows: list[np.ndarray] = []
            for tree in range(trees):
                root = np.full(n, mix64(np.array([tree + 1], U64))[0], U64)
                r, c = children(root, sig, 0, rate)
                rows.append(r)
                roots.append(c)
            row, child = np.concatenate(rows), np.concatenate(roots)
            order = np.argsort(row, kind="stable")
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n))))
            low = (mix64(sig.astype(U64)) & U64(255)).astype(np.uint8)
            yield pa.record_batch(
                [
                    batch.column("doc_id").filter(pa.array(has)),
                    pa.array(print_of.view(np.int64)),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * COORDS).astype(np.int32)), pa.py_buffer(low.tobytes())]),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(child[order].view(np.int64))),
                ],
                names=["doc_id", "print", "sig", "roots"],
            )


def _estimate(agree: np.ndarray) -> np.ndarray:
    """Jaccard estimates from numbers of equal bytes, corrected for the one chance in 256 that bytes agree."""
    return (agree.astype(np.float32) / np.float32(COORDS) - 1 / 256) / (1 - 1 / 256)


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of signature rows."""
    lanes = (a == b).view(U64).sum(axis=-1, dtype=U64)  # eight counts of at most COORDS / 8
    pairs = (lanes & U64(0x00FF00FF00FF00FF)) + ((lanes >> U64(8)) & U64(0x00FF00FF00FF00FF))
    pairs = pairs + (pairs >> U64(32))
    return _estimate((pairs + (pairs >> U64(16))) & U64(0xFFFF))


def _miss(threshold: float) -> int:
    """In so many coordinates similar rows differ at most."""
    return max(0, COORDS - int((_estimate(np.arange(COORDS + 1)) < threshold).sum()))


def _bands(threshold: float) -> list[slice]:
    """Coordinates of which similar rows agree in at least one whole slice; none where there are too few."""
    count = _miss(threshold) + 1
    width = min(8, COORDS // count)
    return [slice(k * width, (k + 1) * width) for k in range(count)] if width else []


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) as a forest of stars with the same components: (member, smallest member)."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = label != np.arange(len(ids))
    return ids[member], ids[label[member]]


def _links(batches, threshold: float, leaf: int, much: int = MUCH):
    """Over rows sorted by node: links that connect what all similar pairs of each node connect."""
    bands, miss = _bands(threshold), _miss(threshold)
    first = min(255, miss + 32)

    def small(node, sig, label):
        """(row, row) of the similar pairs of all nodes at once: row i with row i + d, for each distance d."""
        found = []
        d = 1
        live = np.arange(len(node))
        while True:
            live = live[live + d < len(node)]
            live = live[node[live] == node[live + d]]
            if not len(live):
                break
            new = live[label[live] != label[live + d]]
            for s in range(0, len(new), 8192):
                i = new[s : s + 8192]
                i = i[_similar(sig[i], sig[i + d]) >= threshold]
                found.append((i, i + d))
            d += 1
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def cross(rows, pick, sig, label):
        """(row, row of pick) of all similar pairs with different labels. Those that differ too often in the
        first coordinates can't be similar; the others are compared whole."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        some = sig[pick, :first]
        for i in range(0, len(rows), 4096):
            part = rows[i : i + 4096]
            turned = np.ascontiguousarray(sig[part, :first].T)
            differ, one = np.zeros((len(pick), len(part)), np.uint8), np.empty((len(pick), len(part)), bool)
            for k in range(first):
                np.not_equal(some[:, k, None], turned[k], out=one)
                np.add(differ, one.view(np.uint8), out=differ)
            c, r = np.nonzero((differ <= miss) & (label[pick][:, None] != label[part]))
            for j in range(0, len(c), 8192):
                x, y = part[r[j : j + 8192]], pick[c[j : j + 8192]]
                same = _similar(sig[x], sig[y]) >= threshold
                found.append((x[same], y[same]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def settle(doc, sig):
        """Pairs of a node of more than leaf rows."""
        label = np.unique(doc, return_inverse=True)[1]
        found = []

        def note(a, b):
            nonlocal label
            if len(a):
                found.append((doc[a], doc[b]))
                member, least = _star(label[a], label[b])
                new = np.arange(label.max() + 1)
                new[member] = least
                label = new[label]

        def exhaust(rows, rounds=-1):
            """Compares rows with each other, all pairs of different labels or so many rounds: rows that are left."""
            while rounds and len(rows):
                count = np.bincount(label[rows])
                rest = np.flatnonzero(label[rows] != count.argmax())[:leaf]
                if not len(rest):
                    return rows[:0]
                pick, rows = rows[rest], np.delete(rows, rest)
                a, b = cross(rows, pick, sig, label)
                x, y = small(np.zeros(len(pick), np.int64), sig[pick], label[pick])
                note(np.concatenate((a, pick[x])), np.concatenate((b, pick[y])))
                rounds -= 1
            return rows

        rows = exhaust(np.arange(len(doc)), 4)
        rest = len(rows) - np.bincount(label[rows]).max() if len(rows) else 0
        work, spent = rest * (len(rows) - rest // 2), 0
        for band in bands if work > much else ():
            key = np.zeros(len(rows), U64)
            for column in range(band.start, band.stop):
                key = (key << U64(8)) | sig[rows, column]
            order = np.lexsort((label[rows], key))
            key, there = key[order], rows[order]
            cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            sizes = np.diff(cuts)
            mixed = label[there[cuts[:-1]]] != label[there[cuts[1:] - 1]]  # children of several labels
            # A pair of a small child takes some forty times as long as one of a block.
            spent += int((np.where(sizes > leaf, 1, 40) * sizes * (sizes - 1) // 2)[mixed].sum())
            if 4 * spent > work:
                break
            few = np.repeat(mixed & (sizes <= leaf), sizes)
            x, y = small(key[few], sig[there[few]], label[there[few]])
            note(there[few][x], there[few][y])
            for k in np.flatnonzero(mixed & (sizes > leaf)):
                exhaust(there[cuts[k] : cuts[k + 1]])
        else:
            if work > much and bands:
                rows = rows[:0]
        exhaust(rows)
        return found

    def whole(batches):
        """(node, doc, sig) of one or more whole nodes at a time."""
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = batch.column("sig")
            raw = np.frombuffer(sig.buffers()[2], np.uint8)[sig.offset * COORDS : (sig.offset + len(sig)) * COORDS]
            rows = np.asarray(batch.column("node")), np.asarray(batch.column("doc_id")), raw.reshape(-1, COORDS)
            last = int(np.argmax(rows[0] == rows[0][-1]))  # where the last node begins, which may go on
            if held and (last or held[-1][0][-1] != rows[0][0]):
                yield tuple(np.concatenate(x) for x in zip(*held, tuple(x[:last] for x in rows), strict=True))
                held = []
            elif last:
                yield tuple(x[:last] for x in rows)
            held.append(tuple(x[last:] for x in rows))
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    for node, doc, sig in whole(batches):
        cuts = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]))
        sizes = np.diff(cuts)
        few = np.repeat((sizes > 1) & (sizes <= leaf), sizes)
        x, y = small(node[few], sig[few], doc[few])
        found = [(doc[few][x], doc[few][y])]
        for k in np.flatnonzero(sizes > leaf):
            found += settle(doc[cuts[k] : cuts[k + 1]], sig[cuts[k] : cuts[k + 1]])
        a, b = _star(*(np.concatenate(x) for x in zip(*found, strict=True)))
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, root): root is the least doc_id of the component; roots themselves are left out.

    Alternating large-star and small-star steps, each of them one or two shuffles of the edges.
    edges: (a, b), a > b. Logarithmically many rounds; every round is a written table.
    """
    scratch = Scratch(edges.sparkSession)
    edges = scratch.write(edges.distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
        small = large.join(low, "a").select(F.explode(pairs).alias("e")).select("e.*").where("a > b").distinct()
        old, edges = edges, scratch.write(small)
        scratch.drop(old)
        now = tuple(edges.agg(F.count("*"), F.countDistinct("a"), F.sum(F.hash("a", "b").cast("long"))).first())
        # Stars: every member has one edge, and no centre is a member.
        if now == before or (now[0] == now[1] and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()):
            return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("root"))
        before = now


def _dealt(rows: DataFrame, hot: DataFrame, held: int) -> DataFrame:
    """rows; those of a node of hot(node, n) get parts of held rows or less on average, by a hash.

    They are repeated, once for every part of their node, and the node's id becomes that of the two
    parts, so that each two parts meet in one task."""
    rows = rows.join(hot, "node", "left")
    parts = F.ceil(F.col("n") / held).cast("int")
    own = F.pmod(F.xxhash64("doc_id", "sig", F.lit(1)), parts).cast("int")
    others = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), parts - 1))
    rows = rows.withColumn("part", own).withColumn("other", F.explode(others))
    pair = F.xxhash64("node", F.least("part", "other"), F.greatest("part", "other"))
    return rows.select(F.when(F.col("n").isNull(), F.col("node")).otherwise(pair).alias("node"), "doc_id", "sig")


def near_duplicates(docs: DataFrame, threshold: float = 0.5, recall: float = 0.95, leaf: int = 64, depth: int = 6, trees: int | None = None, held: int = HELD) -> DataFrame:
    """(doc_id, duplicate_of): every document that repeats another one, with its group's least doc_id.

    docs needs doc_id, of any type that has an order, and text. threshold: Jaccard similarity of the
    word 3-grams, estimated from 256 minwise values (standard error 0.03 at 0.5); groups are the
    connected components. Two texts are linked or not whatever the table's size and its other texts
    are: pairs of a common node are all compared. The number of trees is taken such that pairs at the
    threshold would share a node with probability recall even after branching to depth, unless it is
    given; as nodes are compared before any branching, they do with 1 - (1 - survival(1))^trees, more
    similar ones with a greater probability. leaf and held change the cost only.

    Null or wordless texts, and rows without doc_id, are in no group. Rows that repeat a doc_id
    count as one document with all their texts: whatever is similar to one of them is in its group.
    Texts of equal shingles are equal, so there is nothing to choose between ties. Very long texts
    count whole. An empty table gives no rows. Columns other than doc_id and text are ignored,
    whatever their names.
    """
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        # Numbers in place of the ids; the least id of each group is looked up in the end.
        scratch = Scratch(docs.sparkSession)
        ids = scratch.write(numbered(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", name="number"))
        plain = docs.select("doc_id", "text").join(ids, "doc_id").select(F.col("number").alias("doc_id"), "text")
        found = near_duplicates(plain, threshold, recall, leaf, depth, trees, held).select(F.col("doc_id").alias("number"), F.col("duplicate_of").alias("root"))
        every = scratch.write(found.unionByName(found.select(F.col("root").alias("number"), "root").distinct()).join(ids, "number").select("doc_id", "root"))
        least = every.groupBy("root").agg(F.min("doc_id").alias("duplicate_of"))
        return every.join(least, "root").where("doc_id <> duplicate_of").select("doc_id", "duplicate_of")
    scratch = Scratch(docs.sparkSession)
    rate = 1 / (threshold * COORDS)
    trees = trees or trees_for(recall, depth, threshold)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    signed = scratch.write(source.mapInArrow(lambda it: _signed(it, trees, rate), "doc_id long, print long, sig binary, roots array<long>"))
    # Equal shingle sets have equal prints: only the least doc_id of a print goes into the trees, and
    # there the print stands for the text (a doc_id may have several).
    least = signed.groupBy("print").agg(F.min("doc_id").alias("b"), F.count("*").alias("n"))
    same = scratch.write(signed.select("print", F.col("doc_id").alias("a")).join(least.where("n > 1"), "print").where("a > b").select("print", "a", "b"))
    first = signed.join(same.select("print", F.col("a").alias("doc_id")).distinct(), ["print", "doc_id"], "left_anti")
    # Nodes with one text end here, before any signature is moved. Nodes that many of the looked-at
    # texts share have several for sure; they need no count, and are dealt out.
    place = first.select("print", F.explode("roots").alias("node"))
    some = place.where(F.pmod(F.xxhash64("print", F.lit(2)), F.lit(SEEN)) == 0).groupBy("node").agg((F.count("*") * SEEN).alias("n"))
    hot = scratch.write(some.where(F.col("n") > held))
    if hot.isEmpty():
        cold = place
    else:
        cold = place.join(hot.select("node"), "node", "left_anti")
    own = Window.partitionBy("node")
    cold = cold.withColumns({"n": F.count("*").over(own), "low": F.min("print").over(own), "high": F.max("print").over(own), "mixed": F.bit_xor("print").over(own), "added": F.sum(F.shiftrightunsigned(F.xxhash64("print"), 24)).over(own)}).where("n > 1")
    # Nodes of the same texts would be compared with the same result: one of them stays. (Two texts are told
    # by their least and greatest print, more by these, their number and the prints, which are hashes, xored.
    # Repeated rows cancel each other in that; so 40 bits of another hash are added up besides.)
    one = cold.groupBy("n", "low", "high", "mixed", "added").agg(F.min("node").alias("node")).select("node")
    cold = cold.join(one, "node", "left_semi").select("print", "node").distinct()
    if not hot.isEmpty():
        cold = cold.unionByName(place.join(hot.select("node"), "node", "left_semi").distinct())
    once = signed.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
    rows = cold.join(once, "print").select("node", "doc_id", "sig")
    if not hot.isEmpty():
        rows = _dealt(rows, hot, held)
    placed = rows.repartition("node").sortWithinPartitions("node")
    links = scratch.write(placed.mapInArrow(lambda it: _links(it, threshold, leaf), "a long, b long"))
    edges = same.select("a", "b").unionByName(links)
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    groups = components(edges)
    scratch.drop(signed, same, hot, links)
    return groups.select("doc_id", F.col("root").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """docs without the documents that near_duplicates() ties to another one; all columns stay.

    Of rows that repeat a doc_id one stays (the least by text, of equal texts any); rows without
    doc_id all stay, those with null or empty texts too. Columns may have any names.
    """
    gone = near_duplicates(docs, **parameters).select("doc_id")
    keep = docs.join(gone, "doc_id", "left_anti").select(*[column(c) for c in docs.columns])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    name = fresh("_place", docs.columns)
    return keep.withColumn(name, F.when(F.col("doc_id").isNull(), 1).otherwise(place)).where(F.col(name) == 1).drop(name)
