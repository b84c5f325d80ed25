"""Positions of documents after deletes, without renumbering what is stored.

Stored ids never change; deleted ones are kept as bitmaps, one for each block of ids. A document's
position is its stored id less the number of deleted ids below it: those of the blocks before (a
running sum over the table of blocks) and those below it in its own bitmap. All of it is built-in
expressions over one join with the table of blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 15

_BYTE = f"cast(pmod(_id, {BLOCK}) div 8 as int)"
_CELL = f"coalesce(cast(conv(hex(substring(_bits, {_BYTE} + 1, 1)), 16, 10) as int), 0)"
_REST = "cast(pmod(_id, 8) as int)"
_DEAD = f"(shiftright({_CELL}, {_REST}) & 1) = 1"
_BELOW = f"coalesce(bitmap_count(substring(_bits, 1, {_BYTE})), 0) + bit_count({_CELL} & (shiftleft(1, {_REST}) - 1))"


def blocks(dead: DataFrame, next_id: int) -> DataFrame:
    """_block, _bits, _before: the bitmap of each block of ids below next_id (null where none is
    deleted), and how many deleted ids the blocks before it have. dead(doc_id) may repeat ids."""
    spark = dead.sparkSession
    own = dead.groupBy(F.floor(F.col("doc_id") / BLOCK).cast("long").alias("_block")).agg(F.bitmap_construct_agg(F.expr(f"doc_id % {BLOCK}")).alias("_bits"))
    sizes = own.select("_block", F.bitmap_count("_bits").alias("_n"))
    every = spark.range(0, next_id // BLOCK + 1, 1, 1).withColumnRenamed("id", "_block").join(sizes, "_block", "left")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return every.select("_block", before.alias("_before")).join(own, "_block", "left")


def _joined(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    block = F.floor(F.col(key) / BLOCK).cast("long")
    return rows.withColumn("_block", block).withColumn("_id", F.col(key)).join(table, "_block")


def alive(rows: DataFrame, table: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """rows whose stored id is not deleted."""
    if table is None:
        return rows
    return _joined(rows, table, key).where(f"not ({_DEAD})").select(*rows.columns)


def placed(rows: DataFrame, table: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """rows that are not deleted, with the position in place of the stored id."""
    if table is None:
        return rows
    place = F.expr(f"cast(_id - _before - ({_BELOW}) as bigint)")
    return _joined(rows, table, key).where(f"not ({_DEAD})").withColumn(key, place).select(*rows.columns)
