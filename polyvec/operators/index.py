"""A vector index as versioned Parquet tables, and pruned search over it.

Tables of a version: docs(doc_id, embs), codes(doc_id, codes, residuals), ivf(centroid_id, doc_id),
a codebook, totals, and the table of deleted ids (operators/ids.py). A document goes by its position
outside and by its stored id inside; the two are the same until something is deleted.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyvec.operators import grid, kmeans
from polyvec.operators import ids as places
from polyvec.operators.codec import Codec, encode_docs, train, unpack_buckets, unpacked
from polyvec.operators.maxsim import query_numbers, ranked, segment_maxsim, slices_of
from polyvec.operators.vectors import matrix, query_matrix


HELD = 50_000  # vectors of the sample that the codec's cutoffs are taken from, about


@dataclass(frozen=True)
class IndexConfig:
    nbits: int = 4
    seed: int = 42
    rounds: int = 4
    per_centroid: int = 256
    centroids: int | None = None
    start_from_scratch: int = 999
    buffer_size: int = 100


@dataclass(frozen=True)
class SearchParameters:
    k: int = 10
    probes: int = 8
    full_scores: int = 4096
    centroid_threshold: float | None = 0.4
    digits: int | None = None  # scores are rounded to so many before they are ranked


@dataclass
class VectorIndex:
    codec: Codec
    docs: DataFrame
    codes: DataFrame
    ivf: DataFrame
    meta: dict = field(default_factory=dict)
    dead: DataFrame | None = None  # blocks of deleted ids

    def alive(self, rows: DataFrame) -> DataFrame:
        return places.alive(rows, self.dead)

    def placed(self, rows: DataFrame) -> DataFrame:
        """Live rows with positions in place of stored ids."""
        return places.placed(rows, self.dead)

    def stored(self, rows: DataFrame) -> DataFrame:
        """rows(doc_id, ...) with stored ids in place of positions; positions that nothing has are left out."""
        if self.dead is None:
            return rows
        own = self.codes.select(F.col("doc_id").alias("_stored"), "doc_id")
        return rows.join(self.placed(own), "doc_id").withColumn("doc_id", F.col("_stored")).select(*rows.columns)

    def whole(self) -> VectorIndex:
        """The same index with positions as stored ids and nothing deleted."""
        if self.dead is None:
            return self
        return replace(self, docs=self.placed(self.docs), codes=self.placed(self.codes), ivf=self.placed(self.ivf), dead=None)


def inverted(codes: DataFrame) -> DataFrame:
    return codes.select(F.explode(F.array_distinct("codes")).alias("centroid_id"), "doc_id")


def statistics(codes: DataFrame) -> dict:
    row = codes.agg(F.count("*").alias("documents"), F.sum(F.size("codes")).alias("tokens")).first()
    n, t = row["documents"], row["tokens"] or 0
    return {"documents": n, "tokens": t, "average_tokens": t / n if n else 0.0}


def create(docs: DataFrame, config: IndexConfig = IndexConfig(), centroids: np.ndarray | None = None, codec: Codec | None = None) -> VectorIndex:
    """An index of docs(doc_id, embs): codebook from a sample, then one pass that encodes.

    The sample grows with the root of the corpus and stays distributed, as does the part of it that
    the codec's cutoffs come from; the driver sees the codebook alone. A given codec is used as it is."""
    if codec is not None:
        codes = encode_docs(docs, codec)
        return VectorIndex(codec, docs, codes, inverted(codes), statistics(codes) | {"nbits": codec.nbits, "dimension": codec.centroids.shape[1], "centroids": len(codec.centroids)})
    n = docs.count()
    points = kmeans.sampled(docs, n, config.seed).persist()
    tokens = points.count()
    if centroids is None:
        average = docs.agg(F.avg(F.size("embs"))).first()[0] or 0.0
        k = config.centroids or kmeans.centroid_count(n, average, tokens)
        centroids = kmeans.lloyd(kmeans.thinned(points, tokens, k * config.per_centroid), k, config.rounds)
    held = kmeans.thinned(points.withColumn("h", F.xxhash64("h", F.lit(config.seed))), tokens, min(HELD, max(1000, tokens // 20)))
    codec = train(held.select(F.array("v").alias("embs")), centroids, config.nbits)
    points.unpersist()
    codes = encode_docs(docs, codec)
    return VectorIndex(codec, docs, codes, inverted(codes), statistics(codes) | {"nbits": config.nbits, "dimension": centroids.shape[1], "centroids": len(centroids)})


def shared_book(index: VectorIndex, most_bytes: int = 2 << 30):
    """The codebook as a broadcast variable; its size is checked first."""
    book = index.codec.centroids
    if book.nbytes > most_bytes:
        raise ValueError(f"a codebook of {book.nbytes} bytes is more than a task should hold; build the index with fewer centroids")
    return index.codes.sparkSession.sparkContext.broadcast(book)


def best_cells(q: np.ndarray, book: np.ndarray, allowed: np.ndarray, n: int, threshold: float | None, block: int = 1 << 16) -> np.ndarray:
    """The union of the n best of the allowed centroids for each row of q (of equal ones the lowest), without
    those whose best product over all rows is below the threshold. In blocks of centroids, of which only
    the n best of each row are kept."""
    score, cell = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
    most = np.full(len(allowed), -np.inf)
    for s in range(0, len(allowed), block):
        part = q @ book[allowed[s : s + block]].T
        most[s : s + block] = part.max(axis=0)
        score = np.concatenate((score, part), axis=1)
        cell = np.concatenate((cell, np.broadcast_to(np.arange(s, s + part.shape[1]), part.shape)), axis=1)
        order = np.lexsort((cell, -score), axis=1)[:, :n]
        score, cell = np.take_along_axis(score, order, 1), np.take_along_axis(cell, order, 1)
    best = np.unique(cell)
    return allowed[best if threshold is None else best[most[best] >= threshold]]


def _prober(index: VectorIndex, parameters: SearchParameters, eligible: np.ndarray | None, scale: float):
    """A function for tasks: the cells of a query's vectors."""
    allowed = np.arange(len(index.codec.centroids)) if eligible is None else eligible
    n = min(len(allowed), max(1, int(np.ceil(parameters.probes * scale))))
    shared, threshold = shared_book(index), parameters.centroid_threshold
    return lambda q: best_cells(q, shared.value, allowed, n, threshold) if len(q) and len(allowed) else allowed[:0]


def probe(index: VectorIndex, queries: DataFrame, parameters: SearchParameters, eligible: np.ndarray | None = None, scale: float = 1.0) -> DataFrame:
    """cells(query_id, centroid_id) to look into, found in tasks by whole queries."""
    cells = _prober(index, parameters, eligible, scale)

    def run(batches):
        for batch in batches:
            q, count = matrix(batch.column("vecs"))
            ends = np.cumsum(count)
            found = [cells(q[e - c : e]) for c, e in zip(count, ends, strict=True)]
            size = [len(f) for f in found]
            yield pa.record_batch([batch.column("query_id").take(pa.array(np.repeat(np.arange(len(size)), size))), pa.array(np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32))], names=["query_id", "centroid_id"])

    return grid.nested_queries(queries).mapInArrow(run, "query_id long, centroid_id int")


def probed(index: VectorIndex, queries: DataFrame, parameters: SearchParameters, eligible: np.ndarray | None = None, scale: float = 1.0) -> DataFrame:
    """The queries as rows of a grid (operators/grid.py), each with its cells."""
    cells = _prober(index, parameters, eligible, scale)

    def run(batches):
        for batch in batches:
            count = np.asarray(batch.column("n")).astype(np.int64)
            q = grid.numbers(batch.column("data"), np.float64).reshape(int(count.sum()), -1)
            ends = np.cumsum(count)
            found = [cells(q[e - c : e]).astype(np.int32) for c, e in zip(count, ends, strict=True)]
            own = grid.binaries(np.concatenate(found) if found else np.zeros(0, np.int32), np.array([len(f) for f in found], np.int64))
            yield pa.record_batch([batch.column("id"), batch.column("n"), batch.column("data"), own], names=["id", "n", "data", "more"])

    return grid.packed(grid.nested_queries(queries), "query_id", "vecs").mapInArrow(run, grid.PACKED)


def probe_plan(index: VectorIndex, subset: DataFrame | None) -> tuple[DataFrame, DataFrame, np.ndarray | None, float]:
    """(codes, lists, eligible centroids, scale of probes) of a search within subset(doc_id), positions."""
    if subset is None:
        return index.codes, index.ivf, None, 1.0
    chosen = index.stored(subset.select("doc_id").distinct())
    codes, ivf = index.codes.join(chosen, "doc_id", "left_semi"), index.ivf.join(chosen, "doc_id", "left_semi")
    eligible = np.array(sorted(r[0] for r in ivf.select("centroid_id").distinct().collect()), np.int64)  # at most the codebook
    size = chosen.count()
    return codes, ivf, eligible, max(1.0, index.meta["documents"] / size) if size else 1.0


def candidates(index: VectorIndex, ivf: DataFrame, cells: pa.Table) -> DataFrame:
    """query_id, doc_id of every live document in the lists of a query's cells. cells is bounded by the query
    batch: tokens times probes. The lists are clustered by centroid, so the scan skips the others."""
    spark = index.codes.sparkSession
    wanted = cells.column("centroid_id").unique().to_pylist()
    lists = ivf.where(F.col("centroid_id").isin(wanted)) if len(wanted) <= 10_000 else ivf
    return index.alive(lists.join(spark.createDataFrame(cells), "centroid_id").select("query_id", "doc_id").distinct())


def rough_scores(index: VectorIndex, codes: DataFrame, pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score of pairs(query_id, doc_id): late interaction of the query with the centroids
    of the document's tokens."""
    ids, first, q = query_matrix(queries)
    number = {int(x): i for i, x in enumerate(ids)}
    shared, asked = shared_book(index), index.codes.sparkSession.sparkContext.broadcast(q)
    wanted = pairs.groupBy("doc_id").agg(F.collect_set("query_id").alias("queries"))

    def run(batches):
        for whole in batches:
            lengths = np.asarray(whole.column("codes").value_lengths().fill_null(0)).astype(np.int64)
            for s, n in slices_of(lengths, len(asked.value)):
                batch, count = whole.slice(s, n), lengths[s : s + n]
                own, at = np.unique(np.asarray(batch.column("codes").flatten()), return_inverse=True)
                products = shared.value[own] @ asked.value.T if len(own) else np.zeros((0, len(asked.value)))
                scores = segment_maxsim(products[at], count, first)
                named = batch.column("queries")
                row = np.repeat(np.arange(n), np.asarray(named.value_lengths()))
                column = np.array([number[x] for x in named.flatten().to_pylist()], np.int64)
                yield pa.record_batch([pa.array(ids[column], pa.int64()), batch.column("doc_id").take(pa.array(row)), pa.array(scores[row, column])], names=["query_id", "doc_id", "score"])

    return codes.join(wanted, "doc_id").select("doc_id", "codes", "queries").mapInArrow(run, "query_id long, doc_id long, score double")


def exact_scores(index: VectorIndex, codes: DataFrame, kept: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score, worse of kept(query_id, doc_id, score): from the decoded vectors; worse is
    minus the rough score, for ties."""
    ids, first, q = query_matrix(queries)
    number = {int(x): i for i, x in enumerate(ids)}
    codec = replace(index.codec, centroids=None)
    shared, asked = shared_book(index), index.codes.sparkSession.sparkContext.broadcast(q)
    wanted = kept.select("doc_id", F.struct("query_id", F.col("score").alias("rough")).alias("q")).groupBy("doc_id").agg(F.collect_list("q").alias("queries"))

    def run(batches):
        own_codec = replace(codec, centroids=shared.value)
        for whole in batches:
            lengths = np.asarray(whole.column("codes").value_lengths().fill_null(0)).astype(np.int64)
            for s, n in slices_of(lengths, len(asked.value)):
                batch = whole.slice(s, n)
                e, count = unpacked(batch, own_codec)
                scores = segment_maxsim(e @ asked.value.T if len(e) else np.zeros((0, len(asked.value))), count, first)
                rows = [(w["query_id"], i, w["rough"]) for i, own in enumerate(batch.column("queries").to_pylist()) for w in own]
                if not rows:
                    continue
                qid, row, rough = (np.array(x) for x in zip(*rows, strict=True))
                column = np.array([number[int(x)] for x in qid])
                yield pa.record_batch([pa.array(qid, pa.int64()), batch.column("doc_id").take(pa.array(row)), pa.array(scores[row, column]), pa.array(-rough)], names=["query_id", "doc_id", "score", "worse"])

    return codes.join(wanted, "doc_id").select("doc_id", "codes", "residuals", "queries").mapInArrow(run, "query_id long, doc_id long, score double, worse double")


def rough_limit(parameters: SearchParameters) -> int:
    return min(parameters.full_scores, max(parameters.full_scores // 4, parameters.k))


FEW = 1 << 16  # numbers of a query batch that is searched list by list
CODED = 64 << 20  # buckets of documents that a task of the grid holds


class _Coded:
    """The documents of a task: codes and buckets, in the order of their ids."""

    def __init__(self, table: pa.Table, codec: Codec, book: np.ndarray):
        ids, count = table.column("id").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        start = np.cumsum(count) - count
        token = spans(start[order], count[order])
        self.ids, self.count = ids[order], count[order]
        self.start = np.cumsum(self.count) - self.count
        self.code = grid.numbers(table.column("more"), np.int32)[token]
        self.raw = grid.numbers(table.column("data"), np.uint8).reshape(len(token), -1)[token] if len(token) else np.zeros((0, 0), np.uint8)
        self.codec, self.buckets = replace(codec, centroids=book), None
        self.own, self.at = np.unique(self.code, return_inverse=True)
        self.number = np.full(len(book), -1)
        self.number[self.own] = np.arange(len(self.own))
        # The documents by own centroid, as lists one after another.
        by_code = np.argsort(self.at, kind="stable")
        self.listed = np.repeat(np.arange(len(self.count)), self.count)[by_code]
        self.size = np.bincount(self.at, minlength=len(self.own))
        self.first = np.cumsum(self.size) - self.size
        even = len(self.count) > 0 and self.count[0] > 0 and (self.count == self.count[0]).all()
        self.table = np.ascontiguousarray(self.at.reshape(len(self.count), -1).T) if even else None

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """The places of the documents in the lists of cells."""
        own = self.number[cells]
        own = own[own >= 0]
        there = np.zeros(len(self.count), bool)
        there[self.listed[spans(self.first[own], self.size[own])]] = True
        return np.flatnonzero(there)

    def rough(self, place: np.ndarray, products: np.ndarray) -> np.ndarray:
        """Scores by centroids alone from products [query tokens, own centroids]."""
        if self.table is not None:
            best = products[:, self.table[0, place]]
            for row in self.table[1:]:
                np.maximum(best, products[:, row[place]], out=best)
        else:
            count = self.count[place]
            best = np.maximum.reduceat(products[:, self.at[spans(self.start[place], count)]], np.cumsum(count) - count, axis=1)
        best[~np.isfinite(best)] = 0
        return best.sum(axis=0)

    def exact(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The scores of documents, by their place, from the decoded vectors."""
        if self.buckets is None:
            step = 1 << 14
            self.buckets = np.concatenate([unpack_buckets(self.raw[s : s + step], self.codec.nbits, self.codec.centroids.shape[1]) for s in range(0, len(self.raw), step)])
            self.raw = None
        token = spans(self.start[rows], self.count[rows])
        return segment_maxsim(self.codec.vectors(self.code[token], self.buckets[token]) @ q.T, self.count[rows], np.zeros(1, np.int64))[:, 0]


def spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., start + count - 1 of each, one after another."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _candidates_of(docs: _Coded, batches, entries: int = 4 << 20):
    """(query id, vectors, places of its candidates, their rough scores), query by query."""
    book = docs.codec.centroids[docs.own].T
    for batch in batches:
        count = np.asarray(batch.column("n")).astype(np.int64)
        q = grid.numbers(batch.column("data"), np.float64).reshape(int(count.sum()), -1)
        ids, ends = np.asarray(batch.column("id")), np.cumsum(count)
        cells = [np.frombuffer(c or b"", np.int32) for c in batch.column("more").to_pylist()]
        for s, n in slices_of(count, max(1, len(docs.own)), entries):
            begin = ends[s] - count[s]
            products = q[begin : ends[s + n - 1]] @ book
            for j in range(s, s + n):
                place = docs.candidates(cells[j])
                if len(place):
                    yield ids[j], q[ends[j] - count[j] : ends[j]], place, docs.rough(place, products[ends[j] - count[j] - begin : ends[j] - begin])


def _searched(index: VectorIndex, codes: DataFrame, asked: DataFrame, work, schema: str) -> tuple[DataFrame, int]:
    """(what work(documents, query batches) yields in a grid that holds documents, their shares)."""
    codec, shared = replace(index.codec, centroids=None), shared_book(index)
    own, other = grid.shares(index.meta["tokens"] * index.codec.centroids.shape[1], CODED, grid.tasks(codes.sparkSession))

    def packed(batches):
        for batch in batches:
            count = np.asarray(batch.column("codes").value_lengths().fill_null(0)).astype(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(count.astype(np.int32)), batch.column("residuals"), grid.binaries(np.asarray(batch.column("codes").flatten()).astype(np.int32), count)], names=["id", "n", "data", "more"])

    def run(table, batches):
        yield from work(_Coded(table, codec, shared.value), batches)

    rows = codes.select(F.col("doc_id").cast("long").alias("doc_id"), "codes", "residuals").mapInArrow(packed, grid.PACKED)
    return grid.crossed(rows, asked, own, other, run, schema), own


def rough_candidates(index: VectorIndex, codes: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, doc_id, score by centroids alone of every live document in the cells of asked (probed()): no
    pair is shuffled."""

    def work(docs, batches):
        for query_id, _, place, score in _candidates_of(docs, batches):
            yield pa.record_batch([pa.array(np.full(len(place), query_id)), pa.array(docs.ids[place]), pa.array(score)], names=["query_id", "doc_id", "score"])

    return _searched(index, index.alive(codes), asked, work, "query_id long, doc_id long, score double")[0]


def _search_grid(index: VectorIndex, codes: DataFrame, asked: DataFrame, parameters: SearchParameters) -> DataFrame:
    """query_id, doc_id, score, worse: all steps of search() in the tasks of a grid. A task that has all documents
    gives the k best of a query, else the rough cut is made over all shares."""
    limit, k, digits = rough_limit(parameters), parameters.k, parameters.digits
    whole = grid.shares(index.meta["tokens"] * index.codec.centroids.shape[1], CODED, 1)[0] == 1

    def work(docs, batches):
        held, size = [], 0
        for query_id, q, place, rough in _candidates_of(docs, batches):
            if len(place) > limit:
                first = np.argsort(-rough, kind="stable")[:limit]
                place, rough = place[first], rough[first]
            score = docs.exact(place, q)
            score = score if digits is None else np.round(score, digits)
            if whole:
                best = np.lexsort((place, np.zeros(len(place)) if digits is not None else -rough, -score))[:k]
                place, rough, score = place[best], rough[best], score[best]
            held.append((np.full(len(place), query_id), docs.ids[place], score, -rough))
            size += len(place)
            if size > 1 << 17:
                yield _rows(held)
                held, size = [], 0
        if held:
            yield _rows(held)

    found, _ = _searched(index, index.alive(codes), asked, work, _FULL)
    if whole:
        return found
    return ranked(found.withColumn("_full", F.col("score")).withColumn("score", -F.col("worse")), limit).select("query_id", "doc_id", F.col("_full").alias("score"), "worse")


_FULL = "query_id long, doc_id long, score double, worse double"


def _rows(parts) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["query_id", "doc_id", "score", "worse"])


def search(index: VectorIndex, queries: DataFrame, parameters: SearchParameters = SearchParameters(), subset: DataFrame | None = None) -> DataFrame:
    """query_id, rank, doc_id, score of queries(query_id, qpos, qvec), pruned in four steps:

    probe the best cells of each query token, gather the documents in their lists, score those by
    centroids alone and keep max(full_scores / 4, k) (full_scores at most), then score exactly from
    the decoded vectors. A subset(doc_id) is applied before probing: only its cells are probed, and
    the more of them the smaller it is. Without candidates the result is empty.

    A batch of up to FEW numbers reads the lists of its cells; for a larger one, whose cells are most of them, a
    grid of tasks (operators/grid.py) holds the codes, so that no pair of query and candidate is shuffled.
    With parameters.digits equal rounded scores go by doc_id, else by rough scores first.
    """
    spark = index.codes.sparkSession
    codes, ivf, eligible, scale = probe_plan(index, subset)
    if query_numbers(queries) > FEW:
        full = _search_grid(index, codes, probed(index, queries, parameters, eligible, scale), parameters)
    else:
        cells = probe(index, queries, parameters, eligible, scale).toArrow()
        if not cells.num_rows:
            return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
        rough = rough_scores(index, codes, candidates(index, ivf, cells), queries)
        kept = ranked(rough, rough_limit(parameters)).select("query_id", "doc_id", "score")
        full = exact_scores(index, codes, kept, queries)
        if parameters.digits is not None:
            full = full.withColumn("score", F.round("score", parameters.digits))
    ties = ("worse", "doc_id") if parameters.digits is None else ("doc_id",)
    found = ranked(full, parameters.k, *ties).select("query_id", "rank", "doc_id", "score")
    return index.placed(found)


def exact_search(index: VectorIndex, queries: DataFrame, k: int = 10, subset: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """query_id, rank, doc_id, score of every live document, or of those in subset(doc_id)."""
    from polyvec.operators.maxsim import maxsim_topk

    rows = index.alive(index.docs)
    if subset is not None:
        rows = rows.join(index.stored(subset.select("doc_id").distinct()), "doc_id", "left_semi")
    return index.placed(maxsim_topk(rows, queries, k, digits=digits))


# Maintenance


def append(index: VectorIndex, docs: DataFrame) -> VectorIndex:
    """The index with docs after its own; codebook and lists of the old documents stay."""
    codes = encode_docs(docs, index.codec)
    all_codes = index.codes.unionByName(codes)
    return replace(index, docs=index.docs.unionByName(docs), codes=all_codes, ivf=index.ivf.unionByName(inverted(codes)), meta=index.meta | added(index.meta, statistics(codes)))


def added(old: dict, new: dict, sign: int = 1) -> dict:
    """Totals of two sets of documents together; sign -1 takes the second away."""
    n, t = (old.get(k, 0) + sign * new[k] for k in ("documents", "tokens"))
    return {"documents": n, "tokens": t, "average_tokens": t / n if n else 0.0}


def outlying(index: VectorIndex, docs: DataFrame) -> DataFrame:
    """points(h, v): the tokens of docs that are farther from all centroids than the threshold."""
    shared, limit = shared_book(index), index.codec.threshold**2

    def outside(batches):
        for batch in batches:
            e, _ = matrix(batch.column("embs"))
            book = shared.value
            length = (book**2).sum(axis=1)
            for s in range(0, len(e), step := max(1, (2 << 20) // max(1, len(book)))):
                part = e[s : s + step]
                far = part @ book.T
                far *= -2
                far += length
                near = np.maximum(0, far.min(axis=1) + (part * part).sum(axis=1))
                out = part[near > limit]
                yield pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), e.shape[1]).cast(pa.list_(pa.float64()))], names=["v"])

    return docs.select("embs").mapInArrow(outside, "v array<double>").select(F.xxhash64("v").alias("h"), "v")


def expand(index: VectorIndex, docs: DataFrame) -> Codec:
    """A codec with centroids for all tokens of docs that are farther from all others than the threshold."""
    points = outlying(index, docs).persist()
    n = points.count()
    codec = replace(index.codec, centroids=np.concatenate([index.codec.centroids, kmeans.expansion(points, n)])) if n else index.codec
    points.unpersist()
    return codec


def update(index: VectorIndex | None, docs: DataFrame, buffered: DataFrame | None = None, config: IndexConfig = IndexConfig()) -> tuple[VectorIndex, str]:
    """(index, regime) after adding docs, whose ids go on from the index's.

    Up to start_from_scratch documents in all, everything is built anew ("rebuild"); up to buffer_size
    new documents are appended with the codebook as it is ("buffer"); more of them let the codebook
    grow first, and the buffered ones are encoded again with it ("expand").
    """
    if index is None:
        return create(docs, config), "create"
    index = index.whole()
    n = docs.count()
    if index.meta["documents"] + n <= config.start_from_scratch:
        return create(index.docs.unionByName(docs), config), "rebuild"
    pending = n + (buffered.count() if buffered is not None else 0)
    if pending < config.buffer_size:
        return append(index, docs), "buffer"
    if buffered is not None:
        index = without(index, buffered, renumber_ids=False)
        docs = buffered.unionByName(docs)
    return append(replace(index, codec=expand(index, docs)), docs), "expand"


def dense(keys: DataFrame, key: str = "doc_id", block: int = 1 << 16) -> DataFrame:
    """key, _new: dense numbers from 0 for the distinct keys, in their order.

    Blocks of the key space are counted, a running sum over the (small) table of blocks gives each
    its start, and ranks within blocks are independent: there is no window over the whole table.
    """
    keys = keys.select(key).distinct().withColumn("_block", F.floor(F.col(key) / block))
    starts = keys.groupBy("_block").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_block").orderBy(key)) - 1
    return keys.withColumn("_place", place).join(starts, "_block").select(key, (F.col("_start") + F.col("_place")).cast("long").alias("_new"))


def renumber(rows: DataFrame, key: str = "doc_id", block: int = 1 << 16) -> DataFrame:
    """rows with dense keys from 0 in the order of the old ones; rows of one key keep one key."""
    return rows.join(dense(rows, key, block), key).withColumn(key, F.col("_new")).select(*rows.columns)


def numbered(rows: DataFrame, *keys: str, name: str = "doc_id", buckets: int = 4096) -> DataFrame:
    """rows with dense numbers from 0 as one more column, the same at every run: by buckets of the first
    key's hash, and in a bucket by the keys, which together tell rows apart."""
    placed = rows.withColumn("_block", F.pmod(F.xxhash64(keys[0]), F.lit(buckets)))
    sizes = placed.groupBy("_block").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_block").orderBy(*keys)) - 1
    return placed.withColumn("_place", place).join(starts, "_block").withColumn(name, (F.col("_start") + F.col("_place")).cast("long")).drop("_block", "_place", "_start")


def running_start(rows: DataFrame, key: str, value: str, name: str, block: int = 1 << 16) -> DataFrame:
    """rows with one more column: the sum of value over all smaller keys. As in renumber(), only a
    table of blocks is ordered as a whole. Keys are distinct whole numbers."""
    placed = rows.withColumn("_block", F.floor(F.col(key) / block))
    sums = placed.groupBy("_block").agg(F.sum(value).alias("_sum"))
    starts = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    own = F.sum(value).over(Window.partitionBy("_block").orderBy(key)) - F.col(value)
    return placed.withColumn("_own", own).join(starts, "_block").withColumn(name, F.col("_before") + F.col("_own")).select(*rows.columns, name)


def without(index: VectorIndex, gone: DataFrame, renumber_ids: bool = True) -> VectorIndex:
    """The index without the documents of gone(doc_id); ids that it lacks are ignored. The survivors
    are numbered anew from 0, unless told otherwise. This makes new tables; Engine.delete() only marks."""
    index = index.whole()
    ids = gone.select("doc_id").distinct()
    docs, codes = (t.join(ids, "doc_id", "left_anti") for t in (index.docs, index.codes))
    if renumber_ids:
        docs, codes = renumber(docs), renumber(codes)
    return replace(index, docs=docs, codes=codes, ivf=inverted(codes), meta=index.meta | statistics(codes))


def evict(index: VectorIndex, most: int) -> VectorIndex:
    """The index with its newest `most` documents."""
    index = index.whole()
    extra = index.meta["documents"] - most
    return without(index, index.codes.where(F.col("doc_id") < extra)) if extra > 0 else index


def repair(index: VectorIndex, metadata: DataFrame) -> tuple[VectorIndex, DataFrame]:
    """Index and metadata(doc_id, ...) cut to the documents that both have."""
    index = index.whole()
    n = min(index.meta["documents"], metadata.count())
    keep = F.col("doc_id") < n
    codes = index.codes.where(keep)
    return replace(index, docs=index.docs.where(keep), codes=codes, ivf=index.ivf.where(keep), meta=index.meta | statistics(codes)), metadata.where(keep)
