"""Every query against every document, as a grid of tasks.

Both sides are packed, one row a document or query, and dealt out by hash: a task gets one share of the
queries and one of the documents. It holds the one side and lets the other stream past, so that it never
has more than a share and a batch. Each side is shuffled once for every share of the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvec.operators.vectors import doubles, matrix

PACKED = "id long, n int, data binary, more binary"
HELD = 4 << 20  # numbers that a task holds, about


def tasks(spark) -> int:
    """How many tasks keep the cluster busy."""
    return max(8, 2 * spark.sparkContext.defaultParallelism)


def shares(total: int, held: int, wanted: int) -> tuple[int, int]:
    """(shares of the held side, shares of the other) for `total` numbers on the held side: no more than
    `held` in a task, and `wanted` tasks at least."""
    own = max(1, -(-total // held))
    return own, max(1, -(-wanted // own))


def binaries(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """One binary for each of count rows of values."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    edge = (np.concatenate(([0], np.cumsum(count))) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def numbers(column, kind) -> np.ndarray:
    """The numbers of a column of binaries, one after another."""
    return np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), kind)


def packed(rows: DataFrame, key: str, vectors: str, most: int = 8 << 20) -> DataFrame:
    """PACKED rows of rows(key, vectors array<array<number>>); rows without vectors too."""

    def run(batches):
        for whole in batches:
            lists = whole.column(1)
            e, count = matrix(lists)
            width = max(1, e.shape[1])
            start, ends = 0, np.cumsum(count)
            while start < len(count):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + most // width, side="right")))
                part = e[done : ends[stop - 1]]
                yield pa.record_batch([whole.column(0).slice(start, stop - start), pa.array(count[start:stop].astype(np.int32)), binaries(part, count[start:stop]), pa.nulls(stop - start, pa.binary())], names=["id", "n", "data", "more"])
                start = stop

    return rows.select(F.col(key).cast("long").alias("id"), F.col(vectors).cast("array<array<double>>").alias("v")).mapInArrow(run, PACKED)


def nested_queries(queries: DataFrame) -> DataFrame:
    """query_id, vecs: the vectors of each query in order."""
    own = queries.groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("qpos", doubles(F.col("qvec")).alias("qvec")))).alias("own"))
    return own.select("query_id", F.transform("own", lambda s: s["qvec"]).alias("vecs"))


def crossed(held: DataFrame, streamed: DataFrame, n_held: int, n_streamed: int, work: Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What work(held rows, batches of streamed rows) yields in each of n_held x n_streamed tasks; both are
    PACKED. A task without held rows yields nothing."""

    def dealt(rows: DataFrame, kind: int, own: int, other: int) -> DataFrame:
        share = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")
        at = (lambda j: share * n_streamed + j) if kind == 0 else (lambda j: j * n_streamed + share)
        return rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(other - 1)), at)).alias("cell"), F.lit(kind).alias("kind"), "id", "n", "data", "more")

    def run(batches):
        batches, own, rest = iter(batches), [], None
        for batch in batches:
            n = int(np.searchsorted(np.asarray(batch.column("kind")), 1))
            if n:
                own.append(batch.slice(0, n))
            if n < batch.num_rows:
                rest = batch.slice(n)
                break
        if not own or rest is None:
            return

        def others():
            yield rest
            yield from batches

        table = pa.Table.from_batches(own).combine_chunks()
        own.clear()
        yield from work(table, others())

    both = dealt(held, 0, n_held, n_streamed).unionByName(dealt(streamed, 1, n_streamed, n_held))
    placed = both.repartitionById(n_held * n_streamed, F.col("cell")).sortWithinPartitions("kind")
    return placed.select("kind", "id", "n", "data", "more").mapInArrow(run, schema)
