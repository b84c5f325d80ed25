"""Keyword search, fusion, metadata, patterns, ranking signals, code units and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from polyvec.functions import patterns, text as texts
from polyvec.functions.predicate import where
from polyvec.operators import fulltext, fusion, maxsim, metadata, ranking, units
from polyvec.operators.grid import tasks
from polyvec.plans.base import SCORES, docs, every_query, read, top

K = 10


def _index(spark, sf_dir, tokenizer="unicode61"):
    return fulltext.build(read(spark, sf_dir, "documents"), tokenizer)


def _ranked(rows, k=K):
    return maxsim.ranked(rows.withColumn("score", F.round("score", 6)), k).select("query_id", "rank", "doc_id", "score")


def _found(spark, sf_dir, query, tokenizer="unicode61"):
    """All matches with their scores: no cut."""
    return fulltext.matches(_index(spark, sf_dir, tokenizer), query).select("doc_id", F.round("score", 6).alias("score"))


def bm25_term(spark, sf_dir):
    return _found(spark, sf_dir, "license")


def bm25_and(spark, sf_dir):
    return _found(spark, sf_dir, "licensed version")


def bm25_or(spark, sf_dir):
    return _found(spark, sf_dir, "license OR idiot OR moron")


def bm25_not(spark, sf_dir):
    return _found(spark, sf_dir, "license NOT mit")


def bm25_phrase(spark, sf_dir):
    return _found(spark, sf_dir, '"public license"')


def bm25_filtered(spark, sf_dir):
    subset = where(read(spark, sf_dir, "documents"), "lang = ?", ["en"]).select("doc_id")
    return _ranked(fulltext.matches(_index(spark, sf_dir), "license OR the").join(subset, "doc_id", "left_semi").withColumn("query_id", F.lit(0)))


def bm25_every_item(spark, sf_dir):
    """Every benchmark item as a query for any of its words; the ten best documents of each."""
    terms = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(texts.unicode_tokens(F.col("text"))).alias("term"))
    return _ranked(fulltext.any_of(_index(spark, sf_dir), terms))


def trigram_search(spark, sf_dir):
    return _found(spark, sf_dir, '"icense"', "trigram")


def bm25_many(spark, sf_dir):
    """Three queries in one pass, cut at five each."""
    found = fulltext.search_many(_index(spark, sf_dir), {1: "license", 2: '"public license"', 7: "idiot OR moron"}, None)
    return _ranked(found.drop("rank"), 5)


def identifier_tokens(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", texts.identifier_tokens(F.concat_ws(" ", F.regexp_replace(F.initcap("p_name"), " ", ""), F.regexp_replace("p_type", " ", "_"))).alias("tokens"))
    return rows.select("p_partkey", F.array_join("tokens", " ").alias("tokens"))


def unicode_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(texts.unicode_tokens(F.col("text")), " ").alias("tokens"))


TOKEN_SQL = r"tok as (select doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') as tokens from documents), dl as (select doc_id, len(tokens) as dl from tok), tot as (select count(*) as n, avg(dl) as avgdl from dl)"


def _bm25(terms: list[str], condition: str) -> str:
    """Scores of documents for single terms; condition on tf0, tf1, ..."""
    tf = ", ".join(f"len(list_filter(tokens, lambda x: x = '{t}')) as tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    return f"with {TOKEN_SQL}, f as (select doc_id, {tf} from tok), c as (select {df} from f) select f.doc_id, round({score}, 6) as score from f join dl using (doc_id) cross join tot cross join c where {condition}"


def _semantic(spark, sf_dir):
    return maxsim.maxsim_topk(docs(spark, sf_dir), every_query(spark, sf_dir), 30, digits=6)


def _keyword(spark, sf_dir):
    """The same words for every vector query: a ranking of 30."""
    found = fulltext.matches(_index(spark, sf_dir), "the OR license OR der OR que").select("doc_id", F.round("score", 6).alias("score"))
    best = maxsim.ranked(found.withColumn("query_id", F.lit(0)), 30).select("rank", "doc_id", "score")
    return every_query(spark, sf_dir).select("query_id").distinct().crossJoin(best).select("query_id", "rank", "doc_id", "score")


def fuse_rrf(spark, sf_dir):
    return _ranked(fusion.reciprocal_rank(_semantic(spark, sf_dir), _keyword(spark, sf_dir), 0.75, None).drop("rank"))


def fuse_relative(spark, sf_dir):
    return _ranked(fusion.relative_score(_semantic(spark, sf_dir), _keyword(spark, sf_dir), 0.75, None).drop("rank"))


def hybrid_search(spark, sf_dir):
    """Both sides restricted by a condition, fused, with metadata."""
    rows = read(spark, sf_dir, "documents")
    subset = where(rows, "n_chars >= ?", [400]).select("doc_id")
    semantic = maxsim.maxsim_topk(docs(spark, sf_dir).join(subset, "doc_id", "left_semi"), every_query(spark, sf_dir), 30, digits=6)
    words = fulltext.matches(_index(spark, sf_dir), "the OR license OR der OR que").join(subset, "doc_id", "left_semi").select("doc_id", F.round("score", 6).alias("score"))
    best = maxsim.ranked(words.withColumn("query_id", F.lit(0)), 30).select("rank", "doc_id", "score")
    keyword = every_query(spark, sf_dir).select("query_id").distinct().crossJoin(best)
    fused = _ranked(fusion.relative_score(semantic, keyword, 0.75, None).drop("rank"))
    return fused.join(rows.select("doc_id", "lang", "source"), "doc_id", "left").select("query_id", "rank", "doc_id", "score", "lang", "source")


def _fuse_sql(part: str, allowed: str = "true", more: str = "", columns: str = "query_id, rank, doc_id, score") -> str:
    words = _bm25(["the", "license", "der", "que"], "tf0 + tf1 + tf2 + tf3 > 0").removeprefix("with ")
    head, _, select = words.rpartition(" select f.doc_id")
    kw = f"kw as (select f.doc_id{select}), kwr as (select doc_id, score, row_number() over (order by score desc, doc_id) as rank from kw where {allowed})"
    return f"""with {SCORES}, {head}, {kw}, sem as ({top(f'(select * from scores where {allowed})', 30)}),
k as (select query_id, rank, doc_id, score from (select distinct doc_id as query_id from t) cross join (select doc_id, rank, score from kwr where rank <= 30)),
parts as (select query_id, doc_id, 0.75 * {part} as p from sem union all select query_id, doc_id, 0.25 * {part} as p from k),
fused as (select query_id, doc_id, sum(p) as score from parts group by all), fin as ({top('fused')}) select {columns} from fin {more}"""


_RRF = "1 / (60.0 + rank)"
_RELATIVE = "case when max(score) over (partition by query_id) > min(score) over (partition by query_id) then (score - min(score) over (partition by query_id)) / (max(score) over (partition by query_id) - min(score) over (partition by query_id)) else 1.0 end"


# Predicates and metadata


def _where(condition, values, table="documents", columns=("doc_id", "lang", "source", "n_chars")):
    def query(spark, sf_dir):
        return where(read(spark, sf_dir, table), condition, values).select(*columns)

    return query


PREDICATES = {
    "predicate_cmp": (("n_chars >= ? AND n_chars < ? AND lang != ?", [500, 3000, "en"]), "n_chars >= 500 and n_chars < 3000 and lang <> 'en'"),
    "predicate_like": (("text LIKE ? OR source LIKE ?", ["%LICENSE%", "SRC1_"]), "text ilike '%license%' or source ilike 'src1_'"),
    "predicate_regexp": (("text REGEXP ? AND source NOT REGEXP ?", [r"(?i)licensed? under", "^src[0-4]$"]), "regexp_matches(text, '(?i)licensed? under') and not regexp_matches(source, '^src[0-4]$')"),
    "predicate_between_in": (("n_chars BETWEEN ? AND ? AND lang IN (?, ?) AND source NOT IN (?)", [300, 2000, "de", "fr", "src0"]), "n_chars between 300 and 2000 and lang in ('de', 'fr') and source not in ('src0')"),
    "predicate_null_not": (('NOT (lang = ? OR "source" IS NULL) AND text IS NOT NULL', ["en"]), "not (lang = 'en' or source is null) and text is not null"),
    "predicate_constant": (("1=1", []), "true"),
}


def metadata_get_by_ids(spark, sf_dir):
    """Every benchmark item's number as an id, asked for in falling order, some of them twice."""
    asked = read(spark, sf_dir, "benchmark").select((F.col("item_id") * 2).alias("doc_id")).unionByName(read(spark, sf_dir, "labels").select("doc_id"))
    ids = asked.select("doc_id", (-F.col("doc_id")).alias("pos"))
    return metadata.get_by_ids(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), ids)


def metadata_check(spark, sf_dir):
    return metadata.existing(read(spark, sf_dir, "documents"), read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")))


def metadata_distinct(spark, sf_dir):
    return metadata.distinct_strings(read(spark, sf_dir, "documents"), "source")


def metadata_count(spark, sf_dir):
    return where(read(spark, sf_dir, "documents"), "lang = ?", ["es"]).agg(F.count("*").alias("n"))


def metadata_update_where(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return metadata.update_where(rows, "n_chars < ? AND lang IN (?, ?)", [600, "en", "de"], {"source": "short", "n_chars": 0})


def metadata_schema_evolution(spark, sf_dir):
    a = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return metadata.add(a, read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url"))


def deleted_gap_ranges(spark, sf_dir):
    return metadata.gap_ranges(where(read(spark, sf_dir, "documents"), "lang = ? OR n_chars < ?", ["fr", 300]).select("doc_id"))


def repair_tail(spark, sf_dir):
    """Documents that an index as long as the labels table has."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source")
    return metadata.repaired(rows, read(spark, sf_dir, "labels").count())


# Patterns over page paths and texts


def _paths(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"\?.*$", "").alias("path"))


PATHS = r"p as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '\?.*$', '') as path from pages)"


def glob_include(spark, sf_dir):
    return _paths(spark, sf_dir).where(patterns.included(F.col("path"), ["*.{com,org}/en/*", "blog.*/de/7*"]))


def glob_exclude(spark, sf_dir):
    return _paths(spark, sf_dir).where(patterns.not_excluded(F.col("path"), ["en/*1", "**/9*"]))


def glob_exclude_dirs(spark, sf_dir):
    return _paths(spark, sf_dir).where(patterns.outside(F.col("path"), ["de", "*.example.org"]))


def path_prefix(spark, sf_dir):
    return _paths(spark, sf_dir).where(patterns.below(F.col("path"), "WWW.th"))


def text_pattern_union(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(patterns.text_matches(F.col("text"), "licen[cs]ed under|gpl", word=True)).select("doc_id")


def text_pattern_fixed(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(patterns.text_matches(F.col("text"), "License, version 3.", fixed=True)).select("doc_id")


def matching_lines(spark, sf_dir):
    hit = patterns.matching_lines(F.col("text"), "licensed under")
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(hit).alias("m")).select("doc_id", F.col("m.line").alias("line"), F.col("m.text").alias("text"))


# Ranking signals, over documents as units of files


_FOLDERS = ["src/core", "src/test", "compat/old", "examples/a", "lib/util"]
_ENDINGS = ["_test.py", ".py", ".d.ts", "Spec.kt", ".rs", "/__init__.py", ".test.tsx"]


def _file_column(key, words):
    pick = lambda items, by: F.element_at(F.array(*map(F.lit, items)), (by % len(items) + 1).cast("int"))
    return F.concat(pick(_FOLDERS, key), F.lit("/"), words, pick(_ENDINGS, key))


def _candidates(spark, sf_dir):
    """Parts as units: brands in folders are files, prices are scores, sizes are lines."""
    key = F.col("p_partkey")
    word = F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"))
    return read(spark, sf_dir, "part").select(
        F.lit(0).alias("query_id"), key.alias("unit_id"), _file_column(key, word).alias("file"), F.regexp_replace(F.initcap("p_name"), " ", "").alias("name"),
        F.when(key % 3 == 0, "function").when(key % 3 == 1, "rawcode").otherwise("class").alias("unit_type"), F.col("p_size").cast("int").alias("line"), (F.col("p_size") + 5).cast("int").alias("end_line"), F.col("p_retailprice").alias("score"),
    )


_CAND = (
    "c as (select 0 as query_id, p_partkey as unit_id, list_extract([{f}], cast(p_partkey % {nf} + 1 as int)) || '/' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')) || list_extract([{e}], cast(p_partkey % {ne} + 1 as int)) as file, "
    "cast(p_size as int) as line, cast(p_size + 5 as int) as end_line, p_retailprice as score from part)"
).format(f=", ".join(f"'{x}'" for x in _FOLDERS), nf=len(_FOLDERS), e=", ".join(f"'{x}'" for x in _ENDINGS), ne=len(_ENDINGS))


def path_penalty(spark, sf_dir):
    return _candidates(spark, sf_dir).select("unit_id", "file", F.round(ranking.path_penalty(F.col("file")), 6).alias("penalty"))


def file_coherence(spark, sf_dir):
    return ranking.coherence_boost(_candidates(spark, sf_dir)).select("unit_id", "file", F.round("score", 4).alias("score"))


def collapse_by_file(spark, sf_dir):
    return ranking.collapsed(_candidates(spark, sf_dir)).select("file", "unit_id", "line", "end_line", F.round("score", 4).alias("score"))


def merge_by_file(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    first, second = (ranking.collapsed(rows.where(F.col("unit_type") == t)).select("query_id", "file", "score", "line", "end_line") for t in ("function", "class"))
    return ranking.merged(first, second).select("file", F.round("score", 4).alias("score"), "line", "end_line")


def rerank_signals(spark, sf_dir):
    return ranking.reranked(_candidates(spark, sf_dir), "how does BrandTwo handle brand_1 parts").select("file", "unit_id", "line", "end_line", F.round("score", 4).alias("score"))


def merged_ranges(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), (F.col("p_partkey") * 7 % 5000).alias("a")).withColumn("b", F.col("a") + F.length("key"))
    return ranking.merged_ranges(rows)


# Units, plans, streams


_TEMPLATES = {
    "js": "// makes one\nfunction make_{p}(a, b) {{\n  return use_{q}(a);\n}}\n",
    "go": "package x\n\nfunc make_{p}(a int, b int) int {{\n\treturn use_{q}(a)\n}}\n",
    "rs": "fn make_{p}(a: i32, b: i32) -> i32 {{\n    use_{q}(a)\n}}\n",
    "java": "class C {{\n  int make_{p}(int a, int b) {{\n    if (a > b) {{ return use_{q}(a); }}\n    return b;\n  }}\n}}\n",
    "c": "int make_{p}(int a, int b)\n{{\n    while (a < b) {{ a = use_{q}(a); }}\n    return a;\n}}\n",
}


def _sources(spark, sf_dir):
    """Every part as a source file, in one of five languages; each calls what the part of its size makes."""
    key, call = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    out = None
    for k, (ending, body) in enumerate(_TEMPLATES.items()):
        text = F.replace(F.replace(F.lit(body.replace("{{", "{").replace("}}", "}")), F.lit("{p}"), key), F.lit("{q}"), call)
        here = F.col("p_partkey") % len(_TEMPLATES) == k
        rows = F.struct(F.concat(F.lit("src/f"), key, F.lit(f".{ending}")).alias("file"), text.alias("source"))
        out = F.when(here, rows) if out is None else out.when(here, rows)
    # Few bytes a part, but each is parsed: dealt out evenly, whatever the files are like.
    return read(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(tasks(spark)).select(out.alias("r")).select("r.*")


def code_units(spark, sf_dir):
    """The functions and methods of those files."""
    found = units.units(_sources(spark, sf_dir)).where("unit_type in ('function', 'method')")
    return found.select("file", "name", "line", "end_line", "unit_type", "parent_class", F.array_join("parameters", ",").alias("parameters"), F.array_join("calls", ",").alias("calls"), "complexity", "has_loops", "has_branches")


def merged_files(spark, sf_dir):
    """One row a file: what all its units have together."""
    got = units.merged_units(units.units(_sources(spark, sf_dir)))
    return got.select("file", "language", "line", "end_line", F.array_join("parameters", ",").alias("parameters"), F.array_join("calls", ",").alias("calls"), "complexity", "has_loops", "has_branches")


def call_graph_of_code(spark, sf_dir):
    """Which functions call one of the parts' functions by name."""
    found = units.units(_sources(spark, sf_dir)).withColumn("calls", F.transform("calls", lambda c: F.replace(c, F.lit("use_"), F.lit("make_"))))
    return units.call_graph(found).select("name", F.array_join("called_by", ",").alias("called_by"))


def skipped_files(spark, sf_dir):
    """Files that give no units, with the reason: pages that are named as what they aren't."""
    key = F.col("page_id")
    name = F.concat(key.cast("string"), F.when(key % 3 == 0, ".html").when(key % 3 == 1, ".py").otherwise(".unknown"))
    files = read(spark, sf_dir, "pages").select(name.alias("file"), F.when(key % 4 != 0, F.col("html")).otherwise(" ").alias("source"))
    return units.skipped(files)


def exact_files(spark, sf_dir):
    """The units of a list of files."""
    from polyvec.codesearch import CodeSearch

    return _candidates(spark, sf_dir).where(CodeSearch.filters(None, files=["src/core/brand_1_test.py", "lib/util/brand_7.py", "none"], prefix="S")).select("unit_id", "file")


def metadata_text(spark, sf_dir):
    """Metadata as the text that keyword search sees."""
    return read(spark, sf_dir, "documents").select("doc_id", texts.row_text("source", "n_chars", "lang").alias("text"))


def event_times(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", texts.rfc3339(F.col("ts")).alias("at"))


def html_units(spark, sf_dir):
    """Every page as a file: its inline scripts and its other lines."""
    files = read(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("file"), F.col("html").alias("source"))
    return units.units(files).select("file", "name", "line", "end_line", "unit_type", F.md5(F.col("code").cast("binary")).alias("digest"))


def document_units(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), F.col("text").alias("source"))
    return units.units(files).select("file", "name", "signature", "end_line")


def call_graph(spark, sf_dir):
    """Orders as units that call the parts they list, parts as units."""
    lines = read(spark, sf_dir, "lineitem")
    callers = lines.groupBy(F.concat(F.lit("order_"), "l_orderkey").alias("name")).agg(F.collect_set(F.concat(F.lit("part_"), "l_partkey")).alias("calls"))
    parts = read(spark, sf_dir, "part").select(F.concat(F.lit("part_"), "p_partkey").alias("name"), F.array().cast("array<string>").alias("calls"))
    return units.call_graph(callers.unionByName(parts)).select("name", F.array_join("called_by", ",").alias("called_by"))


def update_plan(spark, sf_dir):
    """Documents as the known state, labels as what a scan found."""
    state = read(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), F.length("lang").alias("hash"), (F.col("doc_id") % 3).alias("mtime"), F.lit(1).alias("size"))
    scan = read(spark, sf_dir, "labels").select(F.concat((F.col("doc_id") + 7).cast("string"), F.lit(".md")).alias("file"), (F.col("quality") + 1).alias("hash"), (F.col("doc_id") % 3).alias("mtime"), F.lit(1).alias("size"))
    return units.update_plan(state, scan)


def dedup_texts(spark, sf_dir):
    return units.distinct_texts(read(spark, sf_dir, "documents")).select(F.md5("text").alias("digest"), "n")


def language_of_path(spark, sf_dir):
    return _candidates(spark, sf_dir).select("unit_id", units.language(F.col("file")).alias("language"))


def embedding_text(spark, sf_dir):
    """What an encoder gets of each document, as a digest of the text."""
    files = read(spark, sf_dir, "documents").select(F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), F.col("text").alias("source"))
    return units.units(files).select("file", "name", F.md5(units.embedding_text().cast("binary")).alias("digest"))


QUERIES = {name: _where(*spec[0]) for name, spec in PREDICATES.items()} | {
    f.__name__: f
    for f in (
        bm25_term, bm25_and, bm25_or, bm25_not, bm25_phrase, bm25_filtered, bm25_every_item, bm25_many, trigram_search, identifier_tokens, unicode_tokens, fuse_rrf, fuse_relative, hybrid_search, metadata_get_by_ids, metadata_check,
        metadata_distinct, metadata_count, metadata_update_where, metadata_schema_evolution, deleted_gap_ranges, repair_tail, glob_include, glob_exclude, glob_exclude_dirs, path_prefix, text_pattern_union, text_pattern_fixed,
        matching_lines, path_penalty, file_coherence, collapse_by_file, merge_by_file, rerank_signals, merged_ranges, code_units, merged_files, call_graph_of_code, skipped_files, exact_files, metadata_text, event_times, html_units, document_units, call_graph, update_plan, dedup_texts, language_of_path, embedding_text,
    )
}

_CODE_SQL = "with f as (select *, cast(p_partkey % 5 as int) as k, 'src/f' || p_partkey || ['.js', '.go', '.rs', '.java', '.c'][cast(p_partkey % 5 as int) + 1] as file, cast([2, 3, 1, 2, 1][cast(p_partkey % 5 as int) + 1] as int) as line, cast([3, 3, 3, 4, 5][cast(p_partkey % 5 as int) + 1] as int) as size from part)"
_PENALTY = r"((case when regexp_matches(file, '(_test\.py|Spec\.kt|\.test\.tsx)$') or file like '%/test/%' then 0.3 else 1 end) * (case when file like 'compat/%' then 0.3 else 1 end) * (case when file like 'examples/%' then 0.3 else 1 end) * (case when file like '%.d.ts' then 0.7 else 1 end) * (case when file like '%/__init__.py' then 0.5 else 1 end))"
_LICENSE_LINE = "regexp_matches(text, '(?i)licensed under')"

PHRASE_SQL = f"""with {TOKEN_SQL}, f as (select doc_id, len(list_filter(range(1, len(tokens)), lambda i: tokens[i] = 'public' and tokens[i + 1] = 'license')) as tf from tok), c as (select count(*) filter (tf > 0) as df from f)
select f.doc_id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) as score from f join dl using (doc_id) cross join tot cross join c where tf > 0"""

SQL = {name: f"select doc_id, lang, source, n_chars from documents where {spec[1]}" for name, spec in PREDICATES.items()} | {
    "bm25_term": _bm25(["license"], "tf0 > 0"),
    "bm25_and": _bm25(["licensed", "version"], "tf0 > 0 and tf1 > 0"),
    "bm25_or": _bm25(["license", "idiot", "moron"], "tf0 + tf1 + tf2 > 0"),
    "bm25_not": _bm25(["license", "mit"], "tf0 > 0 and tf1 = 0"),
    "bm25_phrase": PHRASE_SQL,
    "bm25_filtered": f"with s as ({_bm25(['license', 'the'], 'tf0 + tf1 > 0')}) " + top("(select 0 as query_id, doc_id, score from s where doc_id in (select doc_id from documents where lang = 'en'))"),
    "bm25_every_item": rf"""with {TOKEN_SQL}, q as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{{L}}\p{{N}}]+')) as term from benchmark),
post as (select doc_id, term, count(*) as tf from (select doc_id, unnest(tokens) as term from tok) where term in (select term from q) group by all),
df as (select term, count(*) as df from post group by term),
s as (select q.query_id, post.doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from q join post using (term) join df using (term) join dl using (doc_id) cross join tot group by all) {top('s')}""",
    "trigram_search": """with f as (select doc_id, greatest(length(text) - 2, 0) as dl, len(string_split(lower(text), 'icense')) - 1 as tf from documents), tot as (select count(*) as n, avg(dl) as avgdl, count(*) filter (tf > 0) as df from f)
select doc_id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) as score from f, tot where tf > 0""",
    "bm25_many": "with s as (select 1 as query_id, * from (" + _bm25(["license"], "tf0 > 0") + ") union all select 2 as query_id, * from (" + PHRASE_SQL + ") union all select 7 as query_id, * from (" + _bm25(["idiot", "moron"], "tf0 + tf1 > 0") + ")) select cast(query_id as bigint) as query_id, rank, doc_id, score from (" + top("s", 5) + ")",
    "identifier_tokens": "with w as (select p_partkey, string_split(p_name, ' ') as p, lower(replace(p_type, ' ', '_')) as t from part) select p_partkey, array_to_string(p, '') || ' ' || array_to_string(p, ' ') || case when len(p) > 1 then ' ' || array_to_string(list_transform(range(1, len(p)), lambda i: p[i] || '_' || p[i + 1]), ' ') else '' end || ' ' || t as tokens from w",
    "unicode_tokens": f"with {TOKEN_SQL} select doc_id, array_to_string(tokens, ' ') as tokens from tok",
    "fuse_rrf": _fuse_sql(_RRF),
    "fuse_relative": _fuse_sql(_RELATIVE),
    "hybrid_search": _fuse_sql(_RELATIVE, "doc_id in (select doc_id from documents where n_chars >= 400)", "left join documents using (doc_id)", "query_id, rank, doc_id, score, lang, source"),
    "metadata_get_by_ids": "with a as (select distinct doc_id from (select item_id * 2 as doc_id from benchmark union all select doc_id from labels)) select -doc_id as pos, doc_id, lang, n_chars from documents where doc_id in (select doc_id from a)",
    "metadata_check": "select distinct l_orderkey as doc_id, l_orderkey in (select doc_id from documents) as present from lineitem",
    "metadata_distinct": "select distinct source as value from documents where source is not null",
    "metadata_count": "select count(*) as n from documents where lang = 'es'",
    "metadata_update_where": "select doc_id, lang, case when c then 'short' else source end as source, case when c then 0 else n_chars end as n_chars, c as changed from (select *, coalesce(n_chars < 600 and lang in ('en', 'de'), false) as c from documents)",
    "metadata_schema_evolution": "select doc_id, lang, n_chars from documents union all by name select page_id as doc_id, url from pages",
    "deleted_gap_ranges": "with g as (select doc_id, doc_id - row_number() over (order by doc_id) as i from (select distinct doc_id from documents where lang = 'fr' or n_chars < 300)) select min(doc_id) as first_id, max(doc_id) as last_id, count(*) as n from g group by i",
    "repair_tail": "select doc_id, source from documents where doc_id < (select count(*) from labels)",
    "glob_include": rf"with {PATHS} select * from p where regexp_matches(path, '^(.*/)?.*\.(com|org)/en/.*$') or regexp_matches(path, '^(.*/)?blog\..*/de/7.*$')",
    "glob_exclude": rf"with {PATHS} select * from p where not regexp_matches(path, '(^|.*/)en/[^/]*1$|(.*/)?9[^/]*$')",
    "glob_exclude_dirs": rf"with {PATHS} select * from p where not regexp_matches(path, '(^|/)de/') and not regexp_matches(path, '(^|/)[^/]*\.example\.org/')",
    "path_prefix": f"with {PATHS} select * from p where path ilike 'www.th%'",
    "text_pattern_union": r"select doc_id from documents where regexp_matches(text, '(?i)\b(licen[cs]ed under|gpl)\b')",
    "text_pattern_fixed": "select doc_id from documents where contains(text, 'License, version 3.')",
    "matching_lines": "with l as (select doc_id, unnest(string_split(text, chr(10))) as text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from documents) select doc_id, cast(line as int) as line, text from l where " + _LICENSE_LINE,
    "path_penalty": f"with {_CAND} select unit_id, file, round({_PENALTY}, 6) as penalty from c",
    "file_coherence": f"with {_CAND}, s as (select *, sum(score) over (partition by file) as total, row_number() over (partition by file order by score desc, unit_id) as r, max(score) over () as top from c), m as (select *, max(total) over () as most from s) select unit_id, file, round(score + case when r = 1 then top * 0.2 * total / most else 0 end, 4) as score from m",
    "collapse_by_file": f"with {_CAND}, s as (select *, min(line) over (partition by file) as a, max(end_line) over (partition by file) as b, row_number() over (partition by file order by score desc, unit_id) as r from c) select file, unit_id, a as line, b as end_line, round(score, 4) as score from s where r = 1",
    "merge_by_file": f"with {_CAND} select file, round(max(score), 4) as score, min(line) as line, max(end_line) as end_line from c where unit_id % 3 <> 1 group by file",
    "merged_ranges": "with r as (select p_brand as key, p_partkey * 7 % 5000 as a, p_partkey * 7 % 5000 + length(p_brand) as b from part), o as (select *, case when a <= 1 + max(b) over (partition by key order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from r), i as (select *, sum(opens) over (partition by key order by a, b rows unbounded preceding) as n from o) select key, min(a) as a, max(b) as b from i group by key, n",
    "document_units": r"with l as (select doc_id, string_split(text, chr(10)) as lines from documents where regexp_matches(text, '\S')) select doc_id || '.md' as file, doc_id::varchar as name, trim(list_filter(lines, lambda x: regexp_matches(x, '\S'))[1]) as signature, cast(len(lines) as int) as end_line from l",
    "call_graph": "select 'part_' || l_partkey as name, string_agg(distinct 'order_' || l_orderkey, ',' order by 'order_' || l_orderkey) as called_by from lineitem where l_partkey in (select p_partkey from part) group by l_partkey",
    "update_plan": "with o as (select doc_id || '.md' as file, length(lang) as h, doc_id % 3 as m from documents), s as (select (doc_id + 7) || '.md' as file, quality + 1 as h, doc_id % 3 as m from labels) select coalesce(s.file, o.file) as file, case when o.h is null then 'added' when s.h is null then 'deleted' when s.m = o.m then 'unchanged' when s.h = o.h then 'touched' else 'changed' end as action from s full join o on s.file = o.file",
    "dedup_texts": "select md5(text) as digest, count(*) as n from documents where text is not null group by text",
    "code_units": _CODE_SQL + " select file, 'make_' || p_partkey as name, line, line + size - 1 as end_line, case when k = 3 then 'method' else 'function' end as unit_type, case when k = 3 then 'C' end as parent_class, 'a,b' as parameters, 'use_' || p_size as calls, case when k >= 3 then 2 else 1 end as complexity, k = 4 as has_loops, k = 3 as has_branches from f",
    "merged_files": _CODE_SQL + " select file, ['javascript', 'go', 'rust', 'java', 'c'][k + 1] as language, 1 as line, cast([4, 5, 3, 6, 5][k + 1] as int) as end_line, 'a,b' as parameters, 'use_' || p_size as calls, [2, 2, 1, 3, 2][k + 1] as complexity, k = 4 as has_loops, k = 3 as has_branches from f",
    "call_graph_of_code": "select 'make_' || p_size as name, string_agg(distinct 'make_' || p_partkey, ',' order by 'make_' || p_partkey) as called_by from part where p_size in (select p_partkey from part) group by p_size",
    "skipped_files": "select page_id || case page_id % 3 when 0 then '.html' when 1 then '.py' else '.unknown' end as file, case when page_id % 3 = 2 then 'unknown language' when page_id % 4 = 0 then 'no text' else 'no units' end as reason from pages where page_id % 3 > 0 or page_id % 4 = 0",
    "exact_files": f"with {_CAND} select unit_id, file from c where file in ('src/core/brand_1_test.py', 'lib/util/brand_7.py') and file ilike 's%'",
    "metadata_text": "select doc_id, concat_ws(' ', lang, n_chars, source) as text from documents",
    "event_times": "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at from events",
    "rerank_signals": rf"""with {_CAND}, p as (select *, score * {_PENALTY} as s from c), q as (select *, s + case when file like '%/__init__.py' then 0 else 0.4 * max(s) over () end as t from p),
h as (select *, sum(t) over (partition by file) as total, row_number() over (partition by file order by t desc, unit_id) as r, max(t) over () as top from q), m as (select *, max(total) over () as most from h),
z as (select *, t + case when r = 1 then top * 0.2 * total / most else 0 end as final, min(line) over (partition by file) as a, max(end_line) over (partition by file) as b from m)
select file, unit_id, a as line, b as end_line, round(final, 4) as score from z where r = 1""",
    "html_units": r"with l as (select page_id || '.html' as file, string_split(html, chr(10)) as lines from pages where html is not null), n as (select file, lines, list_filter(range(1, len(lines) + 1), lambda i: regexp_matches(lines[i], '\S')) as used from l) select file, 'raw_code_' || used[1] as name, cast(used[1] as int) as line, cast(used[-1] as int) as end_line, 'rawcode' as unit_type, md5(array_to_string(list_transform(used, lambda i: lines[i]), chr(10))) as digest from n where len(used) > 0",
    "embedding_text": r"with l as (select doc_id, text, string_split(text, chr(10)) as lines from documents where regexp_matches(text, '\S')), f as (select *, list_position(list_transform(lines, lambda x: regexp_matches(x, '\S')), true) as a from l), g as (select *, lines[a:] as tail from f), h as (select *, list_position(list_transform(tail, lambda x: not regexp_matches(x, '\S')), true) as stop from g), k as (select doc_id, text, list_transform(tail[1:least(5, case when coalesce(stop, 0) = 0 then len(tail) else stop - 1 end)], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) as head from h) select 'notes/' || doc_id || '.md' as file, doc_id::varchar as name, md5(substr('Document ' || doc_id || chr(10) || 'Signature: ' || head[1] || chr(10) || 'Description: ' || array_to_string(head, chr(10)) || chr(10) || 'File: notes ' || doc_id || ' md' || chr(10) || 'Code: ' || text, 1, 8192)) as digest from k",
    "language_of_path": rf"with {_CAND} select unit_id, case when file like '%.py' then 'python' when file like '%.ts' or file like '%.tsx' then 'typescript' when file like '%.kt' then 'kotlin' when file like '%.rs' then 'rust' end as language from c",
}
