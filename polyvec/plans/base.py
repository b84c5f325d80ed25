"""Shared inputs of the registered queries, for Spark and as SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyvec.operators.vectors import grouped_tokens, nested


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens(doc_id, pos, emb): five vectors in a row are a document."""
    return grouped_tokens(read(spark, sf_dir, "embeddings"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested(tokens(spark, sf_dir))


def every_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a query: queries(query_id, qpos, qvec)."""
    return tokens(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.col("pos").alias("qpos"), F.col("emb").alias("qvec"))


def workspace(spark: SparkSession) -> str:
    """A new folder that all executors share, for queries that write: below spark.checkpoint.dir, or a
    temporary one on a local master. It goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    path = f"{base.rstrip('/')}/polyvec-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


TOKENS = "t as (select vec_id, cast(floor(vec_id / 5) as bigint) as doc_id, cast(vec_id % 5 as int) as pos, embedding::double[] as e from embeddings)"
SCORES = TOKENS + """,
best as (select q.doc_id as query_id, d.doc_id as doc_id, q.pos as qpos, max(list_inner_product(q.e, d.e)) as s from t q cross join t d group by all),
scores as (select query_id, doc_id, sum(s) as score from best group by all)"""
CENTROIDS = """cm as (select label, pos, avg(x) as m from (select label, unnest(range(64)) as pos, unnest(embedding::double[]) as x from embeddings) group by all),
cn as (select label, sqrt(sum(m * m)) as n from cm group by label),
cent as (select cm.label as centroid_id, list(m / n order by pos) as v from cm join cn using (label) group by cm.label)"""
ASSIGNED = TOKENS + ", " + CENTROIDS + """,
product as (select doc_id, pos, vec_id, centroid_id, list_inner_product(e, v) as s from t cross join cent),
assigned as (select doc_id, pos, centroid_id, s from (select *, row_number() over (partition by vec_id order by s desc, centroid_id desc) as r from product) where r = 1),
ivf as (select distinct centroid_id, doc_id from assigned)"""


def top(source: str, k: int = 10, columns: str = "query_id, rank, doc_id, score", ties: str = "doc_id") -> str:
    return f"select {columns} from (select query_id, doc_id, round(score, 6) as score, cast(row_number() over (partition by query_id order by round(score, 6) desc, {ties}) as int) as rank from {source}) where rank <= {k}"
