"""Fusion of a semantic and a keyword ranking: ranked(query_id, rank, doc_id, score) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyvec.operators.maxsim import ranked


def _check(alpha: float) -> None:
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be between 0 and 1")


def reciprocal_rank(semantic: DataFrame, keyword: DataFrame, alpha: float = 0.75, k: int | None = 10, constant: int = 60) -> DataFrame:
    """alpha / (constant + rank) of the one plus (1 - alpha) / (constant + rank) of the other."""
    _check(alpha)
    parts = [r.select("query_id", "doc_id", (F.lit(w) / (F.lit(constant) + F.col("rank"))).alias("part")) for r, w in ((semantic, alpha), (keyword, 1 - alpha))]
    fused = parts[0].unionByName(parts[1]).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    return ranked(fused, k).select("query_id", "rank", "doc_id", "score")


def relative_score(semantic: DataFrame, keyword: DataFrame, alpha: float = 0.75, k: int | None = 10) -> DataFrame:
    """The weighted sum of scores brought to 0..1 within their list; a list of equal scores counts 1 throughout."""
    _check(alpha)
    own = Window.partitionBy("query_id")
    parts = []
    for rows, weight in ((semantic, alpha), (keyword, 1 - alpha)):
        low, high = F.min("score").over(own), F.max("score").over(own)
        scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0))
        parts.append(rows.select("query_id", "doc_id", (scaled * weight).alias("part")))
    fused = parts[0].unionByName(parts[1]).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    return ranked(fused, k).select("query_id", "rank", "doc_id", "score")


MODES = {"rrf": reciprocal_rank, "relative_score": relative_score}
