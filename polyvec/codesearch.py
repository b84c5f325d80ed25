"""Search over source trees: units, vectors, words, filters and ranking signals together."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyvec.engine import Engine
from polyvec.functions import patterns
from polyvec.functions.text import any_identifier_query
from polyvec.operators import fusion, ranking, units
from polyvec.operators.encoder import Encoder, HashEncoder, encode_distinct, encode_queries
from polyvec.operators.index import IndexConfig, SearchParameters, numbered, search
from polyvec.sources import projects

ALPHA, FULL_SCORES = 0.60, 8192
TEXT_COLUMNS = ("code", "file", "name", "signature")
COLUMNS = ("file", "line", "end_line", "score", "name", "unit_type", "code")


class CodeSearch:
    """An index of the units below a root; refresh() follows the files, search() asks."""

    def __init__(self, spark: SparkSession, path: str, encoder: Encoder | None = None, config: IndexConfig = IndexConfig(), pool: int = 1, progress: Callable[[str, dict], None] | None = None):
        self.spark, self.encoder, self.pool = spark, encoder or HashEncoder(), pool
        self.engine = Engine(spark, path, config, tokenizer="identifier_aware", text_columns=TEXT_COLUMNS, progress=progress)

    def plan(self, root: str, files: Sequence[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
        """(scan, plan(file, action)) of the files against what is indexed; nothing is written. files: the
        plan is about these alone."""
        scan = projects.scan(self.spark, root, files=list(files) if files is not None else None, **options)
        if self.engine.rows is None:
            return scan, scan.select("file", F.lit("added").alias("action"))
        state = self.engine.rows.select("file", "hash", "mtime", "size").distinct()
        if files is not None:
            state = state.where(F.col("file").isin(*files))
        return scan, units.update_plan(state, scan.select("file", "hash", "mtime", "size"))

    def status(self, root: str, **options) -> dict[str, int]:
        return {r["action"]: r["count"] for r in self.plan(root, **options)[1].groupBy("action").count().collect()}

    def refresh(self, root: str, files: Sequence[str] | None = None, batch_files: int | None = None, **options) -> dict[str, int]:
        """Indexes added and changed files, drops changed and deleted ones; tells how many of each.

        batch_files: new files go in batches of about so many, each of them a version of its own. A build
        that ends in the middle goes on with the files that are not yet indexed when it is run again."""
        scan, plan = self.plan(root, files, **options)
        plan = plan.persist()
        done = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
        if done.get("changed", 0) + done.get("deleted", 0):
            self.engine.delete_ids(self.engine.rows.join(plan.where("action in ('changed', 'deleted')"), "file", "left_semi").select("doc_id"))
        new = done.get("added", 0) + done.get("changed", 0)
        parts = -(-new // batch_files) if batch_files else 1
        for part in range(parts if new else 0):
            mine = plan.where("action in ('added', 'changed')").where(F.pmod(F.xxhash64("file"), F.lit(parts)) == part)
            self._index(scan.join(mine, "file", "left_semi"))
        plan.unpersist()
        if self.engine.rows is not None and not self.engine.manifest["text"]:
            self.engine.publish_text()
        return done

    def _index(self, fresh: DataFrame) -> None:
        rows = units.units(fresh.select("file", "source")).join(fresh.select("file", "hash", "mtime", "size"), "file")
        rows = numbered(rows, "file", "line", "end_line", "unit_type", "name").persist()
        if not rows.isEmpty():
            vectors = encode_distinct(rows.select("doc_id", units.embedding_text().alias("text")), self.encoder)
            if self.pool > 1:
                from polyvec.operators.pooling import pooled

                vectors = pooled(vectors, self.pool)
            self.engine.add(vectors, rows)
        rows.unpersist()

    def skipped(self, root: str, **options) -> DataFrame:
        """file, reason of the scanned files that give no units."""
        return units.skipped(projects.scan(self.spark, root, **options).select("file", "source"))

    def reconcile(self) -> dict:
        """Corrects the index's totals by what is there; see Engine.reconcile()."""
        return self.engine.reconcile()

    def stats(self) -> DataFrame:
        """language, unit_type, files, units, lines of what is indexed."""
        return self.engine.rows.groupBy("language", "unit_type").agg(F.countDistinct("file").alias("files"), F.count("*").alias("units"), F.sum(F.col("end_line") - F.col("line") + 1).alias("lines"))

    def filters(self, include=(), exclude=(), exclude_dirs=(), prefix: str | None = None, pattern: str | None = None, files: Sequence[str] | None = None, **options) -> Column | None:
        """One condition of all filters: globs, folders, a path prefix, an exact list of files, a text pattern."""
        file, parts = F.col("file"), []
        if include:
            parts.append(patterns.included(file, list(include)))
        if exclude:
            parts.append(patterns.not_excluded(file, list(exclude)))
        if exclude_dirs:
            parts.append(patterns.outside(file, list(exclude_dirs)))
        if prefix:
            parts.append(patterns.below(file, prefix))
        if files is not None:
            parts.append(file.isin(*files))
        if pattern:
            parts.append(patterns.text_matches(F.col("code"), pattern, **options))
        return reduce(lambda a, b: a & b, parts) if parts else None

    def candidates(self, query: str, k: int, condition: Column | None, alpha: float) -> DataFrame:
        """Both rankings, fused, with the units' columns."""
        rows = self.engine.rows
        subset = rows.where(condition).select("doc_id") if condition is not None else None
        wide = max(20 * k, 200)
        asked = encode_queries(self.spark.createDataFrame([(0, query)], "query_id long, text string"), self.encoder)
        semantic = search(self.engine.index, asked, replace(SearchParameters(), k=wide, full_scores=FULL_SCORES), subset)
        words = any_identifier_query(query)
        keyword = self.engine.keywords({0: words} if words else {}, wide, subset)
        found = fusion.relative_score(semantic, keyword, alpha, wide)
        return found.select("query_id", "doc_id", "score").join(rows, "doc_id").withColumnRenamed("doc_id", "unit_id")

    def search(self, query: str, k: int = 15, pattern: str | None = None, code_only: bool = False, alpha: float = ALPHA, **filters) -> DataFrame:
        """The k best files with the lines to look at: file, line, end_line, score, name, unit_type, code.

        With a pattern only units that hold it count, and its words join the query. Without one, a
        second pass over units that hold the query literally is merged in.
        """
        wanted = patterns.merged_query(query, pattern) if pattern else query
        found = self.candidates(wanted, k, self.filters(pattern=pattern, **filters), alpha)
        if not pattern:
            literal = self.candidates(query, k, self.filters(pattern=query, fixed=True, **filters), alpha)
            both = found.unionByName(literal)
            best = both.groupBy("unit_id").agg(F.max("score").alias("_best"))
            found = both.dropDuplicates(["unit_id"]).join(best, "unit_id").withColumn("score", F.col("_best")).drop("_best")
        if code_only:
            found = units.code_only(found)
        return ranking.reranked(found, wanted, k).select(*COLUMNS)

    def json(self, found: DataFrame) -> DataFrame:
        """One JSON object a result."""
        return found.select(F.to_json(F.struct("*")).alias("value"))

    def files(self, found: DataFrame) -> DataFrame:
        return found.select("file").distinct()

    def grouped(self, found: DataFrame, query: str, most: int = 3) -> DataFrame:
        """file, best, hits: the results of each file together, each with its lines and those that match the
        query best; files by their best score."""
        shown = ranking.with_representative_lines(found, query, most)
        hit = F.struct((-F.col("score")).alias("order"), "line", "end_line", "name", "unit_type", "score", "shown")
        out = shown.groupBy("file").agg(F.max("score").alias("best"), F.array_sort(F.collect_list(hit)).alias("hits"))
        hits = F.transform("hits", lambda h: h.dropFields("order"))
        return out.select("file", "best", hits.alias("hits")).orderBy(F.col("best").desc(), "file")


def search_all(indexes: dict[str, CodeSearch], query: str, k: int = 15, **options) -> DataFrame:
    """The k best files of several trees: path (the tree's name) and the columns of search()."""
    found = [code.search(query, k, **options).withColumn("path", F.lit(name)) for name, code in indexes.items()]
    return reduce(DataFrame.unionByName, found).orderBy(F.col("score").desc(), "path", "file", "line", "end_line").limit(k).select("path", *COLUMNS)


def clone_index(source: CodeSearch, path: str) -> CodeSearch:
    """A copy of an index for another working tree of the same project, which refresh() then brings up to date."""
    source.engine.clone(path)
    return CodeSearch(source.spark, path, source.encoder, source.engine.config, source.pool)
