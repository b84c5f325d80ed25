"""Ranking signals for code search on candidates(query_id, unit_id, file, name, unit_type, line, end_line, score).

Each step is a window over one query's candidates, so all steps share one shuffle by query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyvec.functions.text import identifier_tokens, identifier_tokens_py

STRONG, MODERATE, MILD = 0.30, 0.50, 0.70
DEFINITION, STEM, STEM_PREFIX, COHERENCE = 0.25, 0.40, 0.20, 0.20
DEFINITIONS = ("function", "method", "class", "constant")

# How test files are named, by ending: before the name, after it, or as a whole.
_STARTS = {"test_": "py cpp cc cxx c dart lua ml zig jl sh bash zsh", "tst_": "qml"}
_ENDS = {
    "_test": "py go rb cpp cc cxx c dart lua rs exs ml zig jl sh bash zsh", "_spec": "rb lua", "Test": "java php kt swift cs scala hs",
    "Tests": "java kt swift cs", "Spec": "kt swift scala hs", "Suite": "scala", r"\.test": "js jsx ts tsx vue svelte", r"\.spec": "js jsx ts tsx vue svelte", r"\.Tests": "ps1",
}
_WHOLE = [r"tests\.rs", r"runtests\.jl", r"[^/]*\.bats", r"test[-_][^/]*\.[rR]", r"test_helpers?[^/]*\.\w+"]
TEST_FILE = "(?:^|/)(?:" + "|".join([rf"{a}[^/]*\.(?:{e.replace(' ', '|')})" for a, e in _STARTS.items()] + [rf"[^/]*{z}\.(?:{e.replace(' ', '|')})" for z, e in _ENDS.items()] + _WHOLE) + ")$"


def _folder(names: str) -> str:
    return f"(?:^|/)(?:{names})(?:/|$)"


def path_penalty(path: Column) -> Column:
    """The product of what a path loses as test, as compatibility code, as example, as type stub, as barrel file."""
    p = F.translate(path, "\\", "/")
    name = F.substring_index(p, "/", -1)
    tests = p.rlike(TEST_FILE) | p.rlike(_folder("tests?|__tests__|spec|testing"))
    out = F.lit(1.0)
    for hit, factor in (
        (tests, STRONG),
        (p.rlike(_folder("compat|_compat|legacy")), STRONG),
        (p.rlike(_folder("_?examples?|docs?_src")), STRONG),
        (p.endswith(".d.ts"), MILD),
        (name.isin("__init__.py", "package-info.java"), MODERATE),
    ):
        out = out * F.when(hit, F.lit(factor)).otherwise(F.lit(1.0))
    return out


def wants_tests(query: str) -> bool:
    return any(w in query.lower() for w in ("test", "spec", "benchmark"))


def penalized(candidates: DataFrame, query: str) -> DataFrame:
    """Scores times path penalties, unless the query is about tests."""
    return candidates if wants_tests(query) else candidates.withColumn("score", F.col("score") * path_penalty(F.col("file")))


def _top() -> Column:
    return F.max("score").over(Window.partitionBy("query_id"))


def definition_boost(candidates: DataFrame, query: str) -> DataFrame:
    """A quarter of the best score more for definitions whose name shares an identifier token with the query."""
    tokens = list(dict.fromkeys(identifier_tokens_py(query)))
    if not tokens:
        return candidates
    hit = F.col("unit_type").isin(*DEFINITIONS) & (F.col("name") != "") & F.arrays_overlap(identifier_tokens(F.lower("name")), F.array(*map(F.lit, tokens)))
    return candidates.withColumn("score", F.col("score") + F.when(F.coalesce(hit, F.lit(False)) & (_top() > 0), _top() * DEFINITION).otherwise(F.lit(0.0)))


_SMALL_WORDS = frozenset("the an a that this these there then their its it was were is are be has have does do into on in at by of to from for with as if or and so how why who what which where when".split())


def _variants_py(token: str) -> list[str]:
    out = [token]
    if "_" in token:
        out.append(token.replace("_", ""))
    if token.endswith("s") and len(token) > 1:
        out.append(token[:-1])
    return out


def stem_boost(candidates: DataFrame, query: str) -> DataFrame:
    """More for files whose name (without ending) has a token of the query: 0.4 of the best score for
    the same token, singular or plural, with or without underscores, 0.2 where one begins the other."""
    wanted = sorted({v for t in identifier_tokens_py(query) if t not in _SMALL_WORDS for v in _variants_py(t)})
    if not wanted:
        return candidates
    base = F.substring_index(F.translate("file", "\\", "/"), "/", -1)
    stem = F.lower(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""))

    def variants(t: Column) -> Column:
        return F.array(t, F.replace(t, F.lit("_"), F.lit("")), F.when(t.endswith("s") & (F.length(t) > 1), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))

    own = F.array_distinct(F.flatten(F.transform(identifier_tokens(stem), variants)))
    asked = F.array(*map(F.lit, wanted))
    same = F.arrays_overlap(own, asked)
    begins = F.exists(own, lambda s: F.exists(asked, lambda q: ((F.length(s) >= 3) & q.startswith(s)) | ((F.length(q) >= 3) & s.startswith(q))))
    share = F.when(same, F.lit(STEM)).when(begins, F.lit(STEM_PREFIX)).otherwise(F.lit(0.0))
    return candidates.withColumn("score", F.col("score") + F.when(_top() > 0, _top() * F.coalesce(share, F.lit(0.0))).otherwise(F.lit(0.0)))


def coherence_boost(candidates: DataFrame, key: str = "unit_id") -> DataFrame:
    """The best unit of each file gets up to a fifth of the best score, by the file's share of scores."""
    file = Window.partitionBy("query_id", "file")
    rows = candidates.withColumn("_sum", F.sum("score").over(file)).withColumn("_place", F.row_number().over(file.orderBy(F.col("score").desc(), key)))
    most, top = F.max("_sum").over(Window.partitionBy("query_id")), _top()
    add = F.when((F.col("_place") == 1) & (most > 0) & (top > 0), top * COHERENCE * F.col("_sum") / most).otherwise(F.lit(0.0))
    return rows.withColumn("score", F.col("score") + add).select(*candidates.columns)


def collapsed(candidates: DataFrame, k: int | None = None, key: str = "unit_id") -> DataFrame:
    """One row a file: its best unit, with the lines that all its units span; the k best files of a query."""
    file = Window.partitionBy("query_id", "file")
    rows = candidates.withColumns({"_place": F.row_number().over(file.orderBy(F.col("score").desc(), key)), "_a": F.min("line").over(file), "_b": F.max("end_line").over(file)}).where("_place = 1")
    rows = rows.withColumns({"line": F.col("_a"), "end_line": F.col("_b")}).select(*candidates.columns)
    if k is None:
        return rows
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "file"))
    return rows.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """query_id, file, score, line, end_line of two result sets: the better score and the joint span of each file."""
    return first.unionByName(second).groupBy("query_id", "file").agg(F.max("score").alias("score"), F.min("line").alias("line"), F.max("end_line").alias("end_line"))


def final_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("score").desc(), "file", "line", "end_line")


def reranked(candidates: DataFrame, query: str, k: int | None = None) -> DataFrame:
    """All signals in their order: penalty, definition, stem, coherence, collapse."""
    rows = penalized(candidates, query)
    for step in (definition_boost, stem_boost):
        rows = step(rows, query)
    return final_order(collapsed(coherence_boost(rows), k))


def representative_lines(code: str, query: str, most: int = 3) -> list[int]:
    """The numbers (from 0) of the lines that match the query best, by three-line windows."""
    weights = {t: 1.0 / (1 + i * 0.1) for i, t in enumerate(dict.fromkeys(t for t in identifier_tokens_py(query) if t not in _SMALL_WORDS))}

    def line_score(line: str) -> float:
        words, low = set(identifier_tokens_py(line)), line.lower()
        total = 0.0
        for t, w in weights.items():
            total += w * (1.0 if t in words else 0.9 if any(v in words for v in _variants_py(t)) else 0.7 if any(x.startswith(t) for x in words) else 0.6 if len(t) > 3 and t in low else 0.5 if any(len(x) > 2 and t.startswith(x) for x in words) else 0.0)
        return total

    own = [line_score(x) for x in code.split("\n")]
    windows = [own[i] + 0.5 * ((own[i - 1] if i else 0) + (own[i + 1] if i + 1 < len(own) else 0)) for i in range(len(own))]
    best = sorted((i for i in range(len(own)) if own[i] > 0), key=lambda i: (-windows[i], i))[:most]
    return sorted(best)


def with_representative_lines(found: DataFrame, query: str, most: int = 3) -> DataFrame:
    """found(line, code, ...) with shown: the numbers, in the file, of the lines that match the query best."""
    from pyspark.sql.types import ArrayType, IntegerType

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            shown = [[(line or 1) + i for i in representative_lines(code or "", query, most)] for line, code in zip(batch.column("line").to_pylist(), batch.column("code").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shown, pa.list_(pa.int32()))], names=[*batch.schema.names, "shown"])

    return found.mapInArrow(run, type(found.schema)([*found.schema.fields]).add("shown", ArrayType(IntegerType())))


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """key, a, b of overlapping or touching line ranges (key, a, b), joined."""
    order = Window.partitionBy("key").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reach.isNull() | (F.col("a") > reach + 1)).cast("int")
    rows = ranges.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(order))
    return rows.groupBy("key", "_island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_island")
