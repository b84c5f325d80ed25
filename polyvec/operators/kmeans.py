"""Codebooks: how many centroids, and spherical k-means over a distributed sample.

A round is one pass over the sample: tasks assign their vectors in blocks and add them up, the sums
meet by centroid, and only the codebook itself (k rows) comes to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPARE = 1024  # points at hand for centroids that lose all of theirs


def sample_size(n_docs: int) -> int:
    """Documents to train on: grows with the root of the corpus."""
    return min(1 + int(16 * math.sqrt(120 * n_docs)), n_docs)


def centroid_count(n_docs: int, average_tokens: float, sample_tokens: int | None = None) -> int:
    """A power of two near 16 times the root of the number of tokens."""
    k = 1 << max(0, int(math.floor(math.log2(max(1.0, 16 * math.sqrt(max(1.0, average_tokens * n_docs)))))))
    return max(1, min(k, sample_tokens) if sample_tokens is not None else k)


def sampled(docs: DataFrame, n_docs: int, seed: int = 42) -> DataFrame:
    """points(h, v): the vectors of some sample_size(n_docs) documents, those whose hash is small.

    A row a document of the sample's share of the hash space: nothing is sorted or collected."""
    share = min(1.0, sample_size(n_docs) / max(1, n_docs))
    own = docs if share >= 1 else docs.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = own.select("doc_id", F.posexplode("embs").alias("pos", "v"))
    return rows.select(F.xxhash64("doc_id", "pos", F.lit(seed + 1)).alias("h"), F.col("v").cast("array<double>").alias("v"))


def thinned(points: DataFrame, n: int, most: int) -> DataFrame:
    """About most of the n points, by their hash; all of them if there are no more."""
    return points if n <= most else points.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def first_points(points: DataFrame, n: int) -> np.ndarray:
    """The n points of least hash (equal ones by their numbers): at most n vectors come to the driver."""
    got = points.orderBy("h", "v").limit(n).select("v").toArrow().column("v").combine_chunks()
    return got.flatten().to_numpy().reshape(len(got), -1) if len(got) else np.zeros((0, 0))


def _vectors(lists) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def _totals(code: np.ndarray, points: np.ndarray, size: np.ndarray | None = None) -> pa.RecordBatch:
    own, at = np.unique(code, return_inverse=True)
    total = np.zeros((len(own), points.shape[1]))
    np.add.at(total, at, points)
    n = np.bincount(at, size, minlength=len(own)).astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array((np.arange(len(own) + 1) * points.shape[1]).astype(np.int32)), pa.array(total.ravel()))
    return pa.record_batch([pa.array(own.astype(np.int32)), lists, pa.array(n)], names=["centroid_id", "total", "n"])


def lloyd(points: DataFrame, k: int, rounds: int = 4, tolerance: float = 1e-8) -> np.ndarray:
    """k unit centroids of points(h, v) by inner product; an empty one takes a point that is at hand."""
    from polyvec.operators.codec import assign

    start = first_points(points, k + SPARE)
    k = min(k, len(start))
    if not k:
        return np.zeros((1, 1))
    centroids, spare = start[:k].copy(), start[k:] if len(start) > k else start
    context, used = points.sparkSession.sparkContext, 0
    for _ in range(rounds):
        shared = context.broadcast(centroids)

        def summed(batches, shared=shared):
            for batch in batches:
                if batch.num_rows:
                    e = _vectors(batch.column("v"))
                    yield _totals(assign(e, shared.value), e)

        def merged(batches):
            parts = [(np.asarray(b.column("centroid_id")), _vectors(b.column("total")), np.asarray(b.column("n"))) for b in batches if b.num_rows]
            if parts:
                yield _totals(*(np.concatenate(x) for x in zip(*parts, strict=True)))

        schema = "centroid_id int, total array<double>, n long"
        got = points.select("v").mapInArrow(summed, schema).repartition("centroid_id").mapInArrow(merged, schema).toArrow()
        code, size = got.column("centroid_id").to_numpy(), got.column("n").to_numpy()
        new = np.empty_like(centroids)
        empty = np.ones(k, bool)
        empty[code] = False
        new[code] = _vectors(got.column("total").combine_chunks()) / size[:, None]
        n_empty = int(empty.sum())
        new[empty] = spare[(used + np.arange(n_empty)) % len(spare)]
        used += n_empty
        moved = np.abs(new - centroids).max()
        centroids = new
        shared.unpersist()
        if moved < tolerance:
            break
    return centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)


def expansion(outlying: DataFrame, n: int, per_centroid: int = 256) -> np.ndarray:
    """New centroids for all n outlying points: four for each started 256, as many as there are points at most."""
    return lloyd(outlying, min(n, max(1, -(-n // per_centroid)) * 4))
