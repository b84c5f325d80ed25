"""Token pooling: hierarchical clustering of a document's tokens, then cluster means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvec.operators.vectors import dot, matrix, norm


def cosine_distances(e: np.ndarray) -> np.ndarray:
    """Square matrix in 0..2; a zero vector is at distance 1 from all others."""
    n = np.linalg.norm(e, axis=1)
    unit = e / np.where(n > 0, n, 1)[:, None]
    d = np.clip(1 - unit @ unit.T, 0, 2)
    d[n == 0, :] = 1
    d[:, n == 0] = 1
    np.fill_diagonal(d, 0)
    return d


def linkage(d: np.ndarray, method: str = "ward") -> np.ndarray:
    """[n - 1, 4]: the two clusters joined, their distance and the size, nearest pairs first.

    ward, single, complete, average or weighted, all by their recurrence on distances.
    """
    n = len(d)
    d = d.astype(np.float64).copy()
    np.fill_diagonal(d, np.inf)
    size, name = np.ones(n), np.arange(n)
    alive = np.ones(n, bool)
    out = np.zeros((max(0, n - 1), 4))
    for step in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        dij, a, b = d[i, j], d[i], d[j]
        if method == "ward":
            t = size[i] + size[j] + size
            new = np.sqrt(np.maximum(0, ((size[i] + size) * a**2 + (size[j] + size) * b**2 - size * dij**2) / t))
        elif method == "single":
            new = np.minimum(a, b)
        elif method == "complete":
            new = np.maximum(a, b)
        elif method == "average":
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        elif method == "weighted":
            new = (a + b) / 2
        else:
            raise ValueError(f"unknown method {method!r}")
        out[step] = (*sorted((name[i], name[j])), dij, size[i] + size[j])
        alive[j] = False
        new[~alive] = np.inf
        new[i] = np.inf
        d[i, :], d[:, i] = new, new
        d[j, :], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        name[i] = n + step
    return out


def clusters(links: np.ndarray, n: int, most: int | None = None, distance: float | None = None) -> np.ndarray:
    """Labels from 1 by first appearance: at most `most` clusters, or those no farther than distance."""
    parent = np.arange(2 * n - 1 if n else 0)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for step, (a, b, d, _) in enumerate(links):
        if (most is not None and step >= n - most) or (distance is not None and d > distance):
            continue
        parent[root(int(a))] = parent[root(int(b))] = n + step
    roots = [root(i) for i in range(n)]
    order = {r: k for k, r in enumerate(dict.fromkeys(roots), 1)}
    return np.array([order[r] for r in roots], np.int64)


def pool(e: np.ndarray, factor: int = 2, keep_first: bool = True, method: str = "ward") -> np.ndarray:
    """About one vector for `factor` tokens: means of clusters, in order of first appearance, not
    brought to length 1. The first token stays as it is."""
    head, rest = (e[:1], e[1:]) if keep_first else (e[:0], e)
    k = max(1, len(rest) // factor) if len(rest) else 0
    if factor <= 1 or len(rest) <= 1 or k >= len(rest):
        return e
    label = clusters(linkage(cosine_distances(rest), method), len(rest), most=k) - 1
    sums = np.zeros((label.max() + 1, e.shape[1]))
    np.add.at(sums, label, rest)
    return np.concatenate([head, sums / np.bincount(label)[:, None]])


def pooled(docs: DataFrame, factor: int = 2, keep_first: bool = True) -> DataFrame:
    """docs(doc_id, embs) with pooled tokens."""

    def run(batches):
        for batch in batches:
            e, count = matrix(batch.column("embs"))
            parts = [pool(x, factor, keep_first) for x in np.split(e, np.cumsum(count)[:-1])] if len(e) else [e] * len(count)
            yield pa.record_batch([batch.column("doc_id"), pa.array([p.tolist() for p in parts], pa.list_(pa.list_(pa.float64())))], names=["doc_id", "embs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "embs").mapInArrow(run, "doc_id long, embs array<array<double>>")


def pairwise_cosine(tokens: DataFrame) -> DataFrame:
    """doc_id, a, b, distance of the token pairs (a < b) of each document, as a DataFrame operation."""
    left = tokens.select("doc_id", F.col("pos").alias("a"), F.col("emb").alias("ea"))
    right = tokens.select("doc_id", F.col("pos").alias("b"), F.col("emb").alias("eb"))
    lengths = norm(F.col("ea")) * norm(F.col("eb"))
    d = F.when(lengths == 0, F.lit(1.0)).otherwise(F.least(F.greatest(1 - dot(F.col("ea"), F.col("eb")) / lengths, F.lit(0.0)), F.lit(2.0)))
    return left.join(right, "doc_id").where("a < b").select("doc_id", "a", "b", d.alias("distance"))
