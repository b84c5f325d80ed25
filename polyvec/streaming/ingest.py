"""Streams into an index: each micro-batch is one update, and one new version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from polyvec.engine import Engine


def ingest(stream: DataFrame, engine: Engine, checkpoint: str, interval: str = "100 milliseconds", done: Callable[[int, str], None] | None = None) -> DataStreamWriter:
    """A writer that adds every batch of stream(doc_id, embs, metadata columns) to the index.

    The number of the last batch is kept in the index's manifest, which a batch publishes together with
    its documents: a batch that is delivered again after a failure is not added twice. How many documents
    a batch has at most is the source's to say (maxFilesPerTrigger, maxOffsetsPerTrigger).
    """

    def step(batch: DataFrame, number: int) -> None:
        if engine.info().get("last_batch", -1) >= number or batch.isEmpty():
            return
        batch = batch.persist()
        columns = [c for c in batch.columns if c != "embs"]
        regime = engine.add(batch.select("doc_id", "embs"), batch.select(*columns), {"last_batch": number})
        batch.unpersist()
        if done is not None:
            done(number, regime)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=interval)


def deletions(stream: DataFrame, engine: Engine, checkpoint: str, interval: str = "500 milliseconds") -> DataStreamWriter:
    """A writer that applies every batch of stream(condition, values array<string>), in order of `n`, as one change.

    As with ingest(), a batch that is delivered again is not applied twice."""

    def step(batch: DataFrame, number: int) -> None:
        apply_deletions(engine, batch, number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=interval)


def apply_deletions(engine: Engine, batch: DataFrame, number: int) -> int:
    """One batch of deletions(); tells how many documents went."""
    if engine.info().get("last_deletion", -1) >= number:
        return 0
    rows = batch.orderBy("n").collect()  # conditions, not data
    return engine.delete_many([(r["condition"], list(r["values"] or [])) for r in rows], {"last_deletion": number}) if rows else 0
