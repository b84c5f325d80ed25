"""Residual quantisation: a token is its nearest centroid and, for each dimension, a bucket of the rest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyvec.operators.vectors import dot, every_task, matrix


def assign(e: np.ndarray, centroids: np.ndarray, budget: int = 16 << 20) -> np.ndarray:
    """The centroid of the greatest product for each row, the last of equals; in blocks of the budget, of rows
    and of centroids, so that neither a large batch nor a large codebook takes more memory."""
    wide = max(1, min(len(centroids), 1 << 14))
    step = max(1, budget // (8 * wide))
    out = np.zeros(len(e), np.int32)
    for s in range(0, len(e), step):
        own = e[s : s + step]
        most, at = np.full(len(own), -np.inf), np.zeros(len(own), np.int32)
        for c in range(0, len(centroids), wide):
            p = own @ centroids[c : c + wide].T
            np.nan_to_num(p, copy=False, nan=-np.inf)
            best = p.shape[1] - 1 - p[:, ::-1].argmax(axis=1)
            value = p[np.arange(len(own)), best]
            later = value >= most
            most[later], at[later] = value[later], best[later] + c
        out[s : s + step] = at
    return out


def pack_buckets(buckets: np.ndarray, nbits: int) -> np.ndarray:
    """uint8 [rows, dim * nbits / 8]: the bits of each bucket lowest first, bytes filled from the top."""
    bits = (buckets[:, :, None] >> np.arange(nbits)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(len(buckets), -1), axis=1)


def unpack_buckets(packed: np.ndarray, nbits: int, dim: int) -> np.ndarray:
    bits = np.unpackbits(packed, axis=1)[:, : dim * nbits].reshape(len(packed), dim, nbits)
    return (bits << np.arange(nbits, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


DIGITS = 5  # of residuals, for quantiles


@dataclass
class Codec:
    nbits: int
    centroids: np.ndarray
    cutoffs: np.ndarray
    weights: np.ndarray
    average: np.ndarray
    threshold: float

    def encode(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, packed buckets): a bucket is the number of cutoffs strictly below the residual."""
        codes = assign(e, self.centroids)
        step = max(1, (1 << 18) // max(1, e.shape[1]))
        parts = [pack_buckets(np.searchsorted(self.cutoffs, e[s : s + step] - self.centroids[codes[s : s + step]], side="left").astype(np.uint8), self.nbits) for s in range(0, len(e), step)]
        return codes, np.concatenate(parts) if parts else pack_buckets(np.zeros(e.shape, np.uint8), self.nbits)

    def decode(self, codes: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Centroid plus bucket weights, brought to length 1."""
        return self.vectors(codes, unpack_buckets(packed, self.nbits, self.centroids.shape[1]))

    def vectors(self, codes: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """decode() of buckets that are unpacked."""
        e = self.centroids[codes] + self.weights[buckets]
        return e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)


def _residuals(docs: DataFrame, centroids: np.ndarray) -> DataFrame:
    """kind, key, n, total: how often each rounded residual ("x") and length of a residual ("d") occurs, and the sums of
    absolute residuals by dimension ("a"), added up by batch. Rounded to DIGITS there are few distinct values."""
    shared = docs.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            e, _ = matrix(batch.column("embs"))
            if not len(e):
                continue
            rest = e - shared.value[assign(e, shared.value)]
            value, n = np.unique(rest.round(DIGITS), return_counts=True)
            length, m = np.unique(np.linalg.norm(rest, axis=1).round(DIGITS), return_counts=True)
            dims = np.arange(rest.shape[1], dtype=np.float64)
            yield pa.record_batch(
                [
                    pa.array(["x"] * len(value) + ["d"] * len(length) + ["a"] * len(dims)),
                    pa.array(np.concatenate((value + 0.0, length, dims))),
                    pa.array(np.concatenate((n, m, np.full(len(dims), len(e)))).astype(np.int64)),
                    pa.array(np.concatenate((np.zeros(len(value) + len(length)), np.abs(rest).sum(axis=0)))),
                ],
                names=["kind", "key", "n", "total"],
            )

    return docs.select("embs").mapInArrow(run, "kind string, key double, n long, total double").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def train(docs: DataFrame, centroids: np.ndarray, nbits: int = 4) -> Codec:
    """Cutoffs and weights from the residuals of all tokens of docs(embs), in one pass over it whatever its
    size; quantiles are those of residuals rounded to DIGITS. Without tokens all are zero."""
    levels = [i / (1 << nbits) for i in range(1, 1 << nbits)] + [(i + 0.5) / (1 << nbits) for i in range(1 << nbits)]
    counts = _residuals(docs, centroids).persist()
    x = counts.where("kind = 'x'").agg(F.percentile("key", F.array(*map(F.lit, levels)), F.col("n"))).first()[0]
    d = counts.where("kind = 'd'").agg(F.percentile("key", F.lit(0.75), F.col("n"))).first()[0]
    sums = counts.where("kind = 'a'").orderBy("key").select("n", "total").collect()  # one row a dimension
    counts.unpersist()
    values = np.array(x if x is not None else [0.0] * len(levels))
    cut = (1 << nbits) - 1
    average = np.array([r["total"] / r["n"] for r in sums]) if sums else np.zeros(centroids.shape[1])
    return Codec(nbits, centroids, values[:cut], values[cut:], average, d or 0.0)


def merged_threshold(old: float, n_old: int, new: float, n_new: int) -> float:
    return (old * n_old + new * n_new) / (n_old + n_new) if n_old + n_new else 0.0


def residual_quantile(docs: DataFrame, codec: Codec, level: float = 0.75) -> float:
    """The quantile of the distances of the tokens of docs to their centroids; 0 without tokens."""
    return _residuals(docs, codec.centroids).where("kind = 'd'").agg(F.percentile("key", F.lit(level), F.col("n"))).first()[0] or 0.0


def encode_docs(docs: DataFrame, codec: Codec) -> DataFrame:
    """codes(doc_id, codes array<int>, residuals binary) of docs(doc_id, embs); no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches):
        codec = shared.value
        for batch in batches:
            e, count = matrix(batch.column("embs"))
            codes, packed = codec.encode(e) if len(e) else (np.zeros(0, np.int32), np.zeros((0, 0), np.uint8))
            edge = np.concatenate(([0], np.cumsum(count)))
            width = packed.shape[1] if len(packed) else 0
            residuals = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer((edge * width).astype(np.int32)), pa.py_buffer(packed.tobytes())])
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(codes)), residuals], names=["doc_id", "codes", "residuals"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "embs").mapInArrow(run, "doc_id long, codes array<int>, residuals binary")


def unpacked(batch: pa.RecordBatch, codec: Codec) -> tuple[np.ndarray, np.ndarray]:
    """(decoded vectors, number of them by row) of a batch with codes and residuals."""
    lists = batch.column("codes")
    count = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    codes = np.asarray(lists.flatten())
    raw = np.frombuffer(b"".join(x or b"" for x in batch.column("residuals").to_pylist()), np.uint8)
    return codec.decode(codes, raw.reshape(len(codes), -1)) if len(codes) else np.zeros((0, codec.centroids.shape[1])), count


def decode_docs(codes: DataFrame, codec: Codec) -> DataFrame:
    """docs(doc_id, embs) as far as the codes tell."""

    def run(batches):
        for batch in batches:
            e, count = unpacked(batch, codec)
            inner = pa.ListArray.from_arrays(pa.array((np.arange(len(e) + 1) * codec.centroids.shape[1]).astype(np.int32)), pa.array(e.ravel()))
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), inner)], names=["doc_id", "embs"])

    return codes.select("doc_id", "codes", "residuals").mapInArrow(run, "doc_id long, embs array<array<double>>")


def buckets(codes: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, pos, centroid_id, buckets array<int>: the codes read out, token by token."""
    dim, nbits = codec.centroids.shape[1], codec.nbits

    def run(batches):
        for batch in batches:
            lists = batch.column("codes")
            count = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            code = np.asarray(lists.flatten())
            if not len(code):
                continue
            raw = np.frombuffer(b"".join(x or b"" for x in batch.column("residuals").to_pylist()), np.uint8).reshape(len(code), -1)
            own = unpack_buckets(raw, nbits, dim).astype(np.int32)
            pos = np.arange(len(code)) - np.repeat(np.cumsum(count) - count, count)
            yield pa.record_batch([batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(count)), count))), pa.array(pos.astype(np.int32)), pa.array(code), pa.ListArray.from_arrays(pa.array((np.arange(len(own) + 1) * dim).astype(np.int32)), pa.array(own.ravel()))], names=["doc_id", "pos", "centroid_id", "buckets"])

    return codes.select("doc_id", "codes", "residuals").mapInArrow(run, "doc_id long, pos int, centroid_id int, buckets array<int>")


def reconstruct(codes: DataFrame, codec: Codec, ids: DataFrame, strict: bool = True) -> DataFrame:
    """docs(doc_id, embs) of ids(doc_id), decoded. An id that has no codes is an error, or without strict
    gives no vectors."""
    chosen = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    found = decode_docs(codes.join(chosen, "doc_id", "left_semi"), codec)
    missing = F.raise_error(F.concat(F.lit("no document "), F.col("doc_id").cast("string"))).cast("array<array<double>>") if strict else F.array().cast("array<array<double>>")
    return chosen.join(found.withColumn("_there", F.lit(True)), "doc_id", "left").select("doc_id", F.when(F.col("_there"), F.col("embs")).otherwise(missing).alias("embs"))


# The same steps as DataFrame operators: for SQL, and for tables without a fitted codec.


def assign_tokens(tokens: DataFrame, centroids: DataFrame, keep: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """keep columns, centroid_id, product: the centroid of the greatest product, the highest id of equals."""
    pairs = tokens.crossJoin(every_task(centroids))
    best = F.max(F.struct(dot(F.col("emb"), F.col("vec")).alias("product"), F.col("centroid_id")))
    return pairs.groupBy(*keep).agg(best.alias("b")).select(*keep, F.col("b.centroid_id").alias("centroid_id"), F.col("b.product").alias("product"))


def bucketize(value: Column, cutoffs: Column) -> Column:
    return F.size(F.filter(cutoffs, lambda c: value > c))


def label_centroids(rows: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """centroid_id, vec: the mean vector of each label, brought to length 1."""
    parts = rows.select(F.col(label), F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    means = parts.groupBy(label, "pos").agg(F.avg("x").alias("m"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
    from polyvec.operators.vectors import normalized

    return means.groupBy(label).agg(vec.alias("v")).select(F.col(label).cast("int").alias("centroid_id"), normalized(F.col("v")).alias("vec"))


def inverted_lists(assigned: DataFrame) -> DataFrame:
    """ivf(centroid_id, doc_id), each pair once."""
    return assigned.select("centroid_id", "doc_id").distinct()


def outliers(tokens: DataFrame, centroids: DataFrame, threshold: float) -> DataFrame:
    """doc_id, pos, distance2 of the tokens whose nearest centroid is farther than the threshold."""
    from polyvec.operators.vectors import squared_distance

    near = tokens.crossJoin(every_task(centroids)).groupBy("doc_id", "pos").agg(F.min(squared_distance(F.col("emb"), F.col("vec"))).alias("distance2"))
    return near.where(F.col("distance2") > threshold * threshold)
