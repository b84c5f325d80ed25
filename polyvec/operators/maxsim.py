"""Late interaction: a document's score is the sum over query tokens of the best token product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyvec.operators.grid import HELD, crossed, nested_queries, numbers, packed, shares, tasks
from polyvec.operators.vectors import best_first, matrix, nested, query_matrix


def maxsim_scores(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score of every pair, for query batches of any size: matrix products in a grid of
    tasks (operators/grid.py), which shuffles vectors and no scores.

    Best products that are not finite are skipped.
    """
    return _gridded(nested(tokens), queries, None, None)


def segment_maxsim(scores: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[documents, queries] from token products [tokens, query tokens]; documents without tokens score 0."""
    out = np.zeros((len(count), scores.shape[1]))
    some = count > 0
    if some.all() and (count == count[:1]).all() and len(count):
        own = scores.reshape(len(count), -1, scores.shape[1])
        out[:] = own[:, 0]
        for j in range(1, own.shape[1]):
            np.maximum(out, own[:, j], out=out)
    elif some.any():
        out[some] = np.maximum.reduceat(scores, (np.cumsum(count) - count)[some], axis=0)
    out[~np.isfinite(out)] = 0
    return np.add.reduceat(out, first, axis=1)


def slices_of(count: np.ndarray, width: int, entries: int = 8 << 20):
    """(first, number) of documents in turn, so that their tokens times width are about `entries` at most
    (one document at least): what a task multiplies at once is bounded whatever the batch."""
    ends = np.cumsum(count)
    start = 0
    while start < len(count):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + entries // max(1, width), side="right")))
        stop = min(stop, start + max(1, entries // max(1, width)))
        yield start, stop - start
        start = stop


class Best:
    """The k best documents of each of n queries, as blocks of scores go by: greater scores first, those that
    are not finite last, of equal ones the smaller id. It holds about 3 k rows a query at most."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.most = 0, max(1 << 16, 2 * k * n)

    def take(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores [documents, queries]."""
        least = self.least
        if len(scores) > self.k:
            bad = ~np.isfinite(scores)
            value = np.where(bad, -np.inf, scores) if bad.any() else scores
            hit = value >= least
            if hit.sum() > 4 * self.k * scores.shape[1]:
                hit = value >= np.maximum(least, np.partition(value, len(value) - self.k, axis=0)[len(value) - self.k])
        else:
            hit = np.where(np.isfinite(scores), scores, -np.inf) >= least
        row, column = np.nonzero(hit)
        self.parts.append((column, ids[row], scores[row, column].astype(np.float64)))
        self.waiting += len(row)
        if self.waiting > self.most:
            self._cut()

    def _cut(self) -> None:
        column, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        value = np.where(np.isfinite(score), score, -np.inf)
        order = np.lexsort((ids, -value, column))
        column, ids, score, value = column[order], ids[order], score[order], value[order]
        first = np.searchsorted(column, np.arange(len(self.least)))
        keep = np.arange(len(column)) - first[column] < self.k
        full = np.flatnonzero(np.bincount(column, minlength=len(self.least)) >= self.k)
        self.least[full] = value[first[full] + self.k - 1]
        self.parts, self.waiting = [(column[keep], ids[keep], score[keep])], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score)."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self._cut()
        return self.parts[0]


def ranked(scores: DataFrame, k: int | None, *ties: str) -> DataFrame:
    """scores with rank from 1 by query, cut at k. Scores that are not finite come last; ties go by `ties`."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(best_first(F.col("score")), *[F.col(t) for t in ties or ("doc_id",)]))
    out = scores.withColumn("rank", place)
    return out if k is None else out.where(F.col("rank") <= k)


SMALL = 1 << 20  # numbers of a query batch that every task may hold
SCORES = "query_id long, doc_id long, score double"


def _record(query_ids: np.ndarray, doc_ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(query_ids, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(scores.astype(np.float64))], names=["query_id", "doc_id", "score"])


def _best_of(blocks, ids: np.ndarray, k: int | None, digits: int | None):
    """Batches of SCORES from blocks of (doc ids, scores [documents, queries]): all, or the k best of each query."""
    best = Best(len(ids), k) if k is not None else None
    for doc_ids, scores in blocks:
        scores = scores if digits is None else np.round(scores, digits)
        if best is None:
            yield _record(np.tile(ids, len(doc_ids)), np.repeat(doc_ids, len(ids)), scores.ravel())
        else:
            best.take(doc_ids, scores)
    if best is not None:
        column, doc_ids, score = best.rows()
        yield _record(ids[column], doc_ids, score)


def _scored(table: pa.Table, batches, kind=np.float64):
    """(query ids, blocks of (doc ids, scores)) of a task of the grid that holds queries."""
    n = table.column("n").to_numpy().astype(np.int64)
    ids, first = table.column("id").to_numpy(), np.cumsum(n) - n
    q = numbers(table.column("data"), np.float64).reshape(int(n.sum()), -1).astype(kind)

    def blocks():
        for whole in batches:
            count, doc_ids = np.asarray(whole.column("n")).astype(np.int64), np.asarray(whole.column("id"))
            e = numbers(whole.column("data"), np.float64).reshape(-1, q.shape[1]).astype(kind)
            ends = np.cumsum(count)
            for s, m in slices_of(count, len(q)):
                own = e[ends[s] - count[s] : ends[s + m - 1]]
                yield doc_ids[s : s + m], segment_maxsim(own @ q.T, count[s : s + m], first)

    return ids, blocks()


def _sides(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    return packed(nested_queries(queries), "query_id", "vecs"), packed(docs, "doc_id", "embs")


def _gridded(docs: DataFrame, queries: DataFrame, k: int | None, digits: int | None, single: bool = False, total: int | None = None) -> DataFrame:
    """SCORES of every pair, or of the k best of each query in each share of the documents."""
    kind = np.float32 if single else np.float64

    def work(table, batches):
        ids, blocks = _scored(table, batches, kind)
        yield from _best_of(blocks, ids, k, digits)

    own, other = shares(total if total is not None else query_numbers(queries), HELD, tasks(docs.sparkSession))
    return crossed(*_sides(docs, queries), own, other, work, SCORES)


def query_numbers(queries: DataFrame) -> int:
    """How many numbers a query batch has."""
    return int(queries.agg(F.sum(F.size("qvec").cast("long"))).first()[0] or 0)


def maxsim_topk(docs: DataFrame, queries: DataFrame, k: int | None = 10, single: bool = False, digits: int | None = None) -> DataFrame:
    """query_id, rank, doc_id, score: the k best of docs(doc_id, embs) for each query.

    A batch of up to SMALL numbers goes to every task: one scan without a shuffle of vectors. A larger one
    is dealt out in a grid (operators/grid.py). Either way a task keeps the k best of a query, so that what
    is shuffled to rank them grows with queries times tasks. digits: scores are rounded to so many before
    they are ranked. single: in 32 bits, twice as fast.
    """
    total = query_numbers(queries)
    if k is None:
        return every_ranked(docs, queries, digits, single)
    if total > SMALL:
        return ranked(_gridded(docs, queries, k, digits, single, total), k).select("query_id", "rank", "doc_id", "score")
    ids, first, q = query_matrix(queries)
    kind = np.float32 if single else np.float64
    q = q.astype(kind)

    def blocks(batches):
        for whole in batches:
            lengths = np.asarray(whole.column("embs").value_lengths().fill_null(0)).astype(np.int64)
            for s, n in slices_of(lengths, len(q)):
                batch = whole.slice(s, n)
                e, count = matrix(batch.column("embs"), kind)
                yield np.asarray(batch.column("doc_id")), segment_maxsim(e @ q.T if len(e) else np.zeros((0, len(q))), count, first)

    def run(batches):
        if len(ids):
            yield from _best_of(blocks(batches), ids, k, digits)

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "embs").mapInArrow(run, SCORES)
    return ranked(scored, k).select("query_id", "rank", "doc_id", "score")


WHOLE = 32 << 20  # scores that a task holds to rank them


def every_ranked(docs: DataFrame, queries: DataFrame, digits: int | None = None, single: bool = False) -> DataFrame:
    """query_id, rank, doc_id, score of all documents for each query. A task has so few queries that it holds
    their scores of all documents and ranks them itself: no score is shuffled. More than WHOLE documents are
    ranked by a window instead."""
    n_docs, n_queries, total = docs.count(), queries.select("query_id").distinct().count(), query_numbers(queries)
    kind = np.float32 if single else np.float64
    if n_docs > WHOLE:
        return ranked(_gridded(docs, queries, None, digits, single, total), None).select("query_id", "rank", "doc_id", "score")

    def work(table, batches):
        ids, blocks = _scored(table, batches, kind)
        every, doc_ids, at = np.empty((len(ids), n_docs)), np.empty(n_docs, np.int64), 0
        for own, scores in blocks:
            every[:, at : at + len(own)] = scores.T
            doc_ids[at : at + len(own)] = own
            at += len(own)
        by_id = np.argsort(doc_ids[:at], kind="stable")
        sorted_ids, step = doc_ids[by_id], max(1, (1 << 18) // max(1, at))
        for s in range(0, len(ids), step):
            part = every[s : s + step][:, by_id]
            part = part if digits is None else np.round(part, digits)
            order = np.argsort(-np.where(np.isfinite(part), part, -np.inf), axis=1, kind="stable")
            scores = np.take_along_axis(part, order, 1)
            yield pa.record_batch([pa.array(np.repeat(ids[s : s + step], at)), pa.array(np.tile(np.arange(1, at + 1, dtype=np.int32), len(part))), pa.array(sorted_ids[order].ravel()), pa.array(scores.ravel())], names=["query_id", "rank", "doc_id", "score"])

    own = max(tasks(docs.sparkSession), -(-n_queries * n_docs // WHOLE), -(-total // HELD))
    return crossed(*_sides(docs, queries), own, 1, work, "query_id long, rank int, doc_id long, score double")


def rerank(docs: DataFrame, queries: DataFrame, digits: int | None = None) -> DataFrame:
    """query_id, rank, doc_id, score of all documents; a vector with a number that is not finite is an error."""
    bad = F.exists("embs", lambda v: F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    checked = docs.withColumn("embs", F.when(bad, F.raise_error(F.concat(F.lit("numbers that are not finite in document "), F.col("doc_id").cast("string"))).cast(docs.schema["embs"].dataType)).otherwise(F.col("embs")))
    return maxsim_topk(checked, queries, None, digits=digits)
