"""Operations on the metadata table: doc_id and any columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvec.functions.predicate import compile_condition, where
from polyvec.operators.index import renumber


def ids_where(rows: DataFrame, condition: str, values: Sequence = ()) -> DataFrame:
    return where(rows, condition, values).select("doc_id")


def get(rows: DataFrame, condition: str | None = None, values: Sequence = (), limit: int | None = None) -> DataFrame:
    """Rows that satisfy the condition, by doc_id."""
    out = (where(rows, condition, values) if condition else rows).orderBy("doc_id")
    return out if limit is None else out.limit(limit)


def get_by_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ids(doc_id, pos) in the order of pos; an id asked for twice comes once, at its first place."""
    first = ids.groupBy("doc_id").agg(F.min("pos").alias("pos"))
    return rows.join(first, "doc_id").orderBy("pos").select("pos", *rows.columns)


def existing(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, present for every asked doc_id."""
    have = rows.select("doc_id").distinct().withColumn("_have", F.lit(True))
    return ids.select("doc_id").distinct().join(have, "doc_id", "left").select("doc_id", F.coalesce("_have", F.lit(False)).alias("present"))


def distinct_strings(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()


def update_where(rows: DataFrame, condition: str, values: Sequence, changes: dict) -> DataFrame:
    """rows with the changes where the condition is true; `changed` tells which."""
    hit = F.coalesce(compile_condition(condition, values, rows.schema), F.lit(False))
    out = rows.withColumn("changed", hit)
    return out.select(*[F.when(F.col("changed"), F.lit(changes[c]).cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in rows.columns], "changed")


def add(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows and columns; a row lacks what its table lacks."""
    return rows.unionByName(new, allowMissingColumns=True)


def delete(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows without the ids of gone, numbered anew from 0."""
    return renumber(rows.join(gone.select("doc_id").distinct(), "doc_id", "left_anti"))


def gap_ranges(gone: DataFrame, block: int = 1 << 16) -> DataFrame:
    """first_id, last_id, n of each run of consecutive ids.

    Runs are found within blocks of the id space. Only those that touch a block's edge can go on in
    the next one; they, two a block at most, are joined in one ordered pass.
    """
    from pyspark.sql import Window

    ids = gone.select("doc_id").distinct().withColumn("_block", F.floor(F.col("doc_id") / block))
    island = F.col("doc_id") - F.row_number().over(Window.partitionBy("_block").orderBy("doc_id"))
    runs = ids.withColumn("_island", island).groupBy("_block", "_island").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).select("a", "b")
    at_edge = (F.pmod("a", F.lit(block)) == 0) | (F.pmod("b", F.lit(block)) == block - 1)
    order = Window.orderBy("a")
    opens = F.coalesce((F.col("a") != F.lag("b").over(order) + 1).cast("int"), F.lit(1))
    edge = runs.where(at_edge).withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order)).groupBy("_run").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("a", "b")
    return runs.where(~at_edge).unionByName(edge).select(F.col("a").alias("first_id"), F.col("b").alias("last_id"), (F.col("b") - F.col("a") + 1).alias("n"))


def repaired(rows: DataFrame, n_documents: int) -> DataFrame:
    """rows whose ids an index of n_documents has."""
    return rows.where(F.col("doc_id") < n_documents)
