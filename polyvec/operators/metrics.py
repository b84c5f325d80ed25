"""Retrieval quality: run(query_id, rank, doc_id) against qrels(query_id, doc_id, rel)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluate(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """query_id, average_precision, ndcg, recall at k of every query with a relevant document."""
    wanted = qrels.where("rel > 0").select("query_id", "doc_id", "rel")
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rel").desc(), "doc_id"))
    ideal = wanted.withColumn("r", ideal_rank).groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("r") <= k, F.col("rel") / F.log2(F.col("r") + 1))).alias("best"))
    hits = run.where(F.col("rank") <= k).join(wanted, ["query_id", "doc_id"])
    return _shares(ideal, hits)


def evaluate_common(run: DataFrame, queries: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """evaluate() of every query of queries(query_id) where all have the same relevant(doc_id, rel): without a
    row for each query and relevant document. Without relevant documents all are 0."""
    wanted = relevant.where("rel > 0").select("doc_id", "rel")
    first = wanted.orderBy(F.col("rel").desc(), "doc_id").limit(k).withColumn("r", F.row_number().over(Window.orderBy(F.col("rel").desc(), "doc_id")))
    ideal = wanted.agg(F.count("*").alias("n")).crossJoin(first.agg(F.sum(F.col("rel") / F.log2(F.col("r") + 1)).alias("best")))
    hits = run.where(F.col("rank") <= k).join(wanted, "doc_id")
    return _shares(queries.select("query_id").distinct().crossJoin(F.broadcast(ideal)), hits)


def _shares(ideal: DataFrame, hits: DataFrame) -> DataFrame:
    """Of ideal(query_id, n, best) and the relevant rows of a run."""
    seen = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    got = hits.withColumn("seen", seen).groupBy("query_id").agg(F.sum(F.col("seen") / F.col("rank")).alias("precision"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("gain"), F.count("*").alias("found"))
    zero = F.lit(0.0)
    return ideal.join(got, "query_id", "left").select("query_id", *[F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), zero).alias(c) for c, a, b in (("average_precision", "precision", "n"), ("ndcg", "gain", "best"), ("recall", "found", "n"))])


def overlap(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of an exact ranking's documents that another one has."""
    both = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id").withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return both.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
