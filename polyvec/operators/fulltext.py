"""Keyword search: an inverted index as tables, boolean and phrase queries, BM25.

postings(term, doc_id, positions), doc_stats(doc_id, dl) and a one-row table of totals. A query
reads only the postings of its terms. Statistics are those of the whole index, also when a search
is restricted to a subset.

An index that isn't written has no postings to read: there each phrase is counted in the texts by one
regular expression, in one pass whose small result (counts and lengths) serves totals and scores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyvec.functions.text import TOKENIZERS, WORD, phrase_pattern
from polyvec.operators.maxsim import ranked

K1, B = 1.2, 0.75


@dataclass
class TextIndex:
    tokenizer: str
    postings: DataFrame
    doc_stats: DataFrame
    totals: DataFrame  # n, avgdl
    buckets: int = 0
    docs: DataFrame | None = None  # doc_id, text of an index that isn't written

    def save(self, path: str, buckets: int = 64) -> None:
        """Writes the tables; postings in hash buckets of terms, so that a query opens few files."""
        self.postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("term", "doc_id").write.partitionBy("bucket").parquet(f"{path}/postings")
        self.doc_stats.write.parquet(f"{path}/doc_stats")
        self.totals.withColumns({"tokenizer": F.lit(self.tokenizer), "buckets": F.lit(buckets)}).write.parquet(f"{path}/totals")


def load(spark: SparkSession, path: str) -> TextIndex:
    totals = spark.read.parquet(f"{path}/totals")
    row = totals.first()
    return TextIndex(row["tokenizer"], spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/doc_stats"), totals.select("n", "avgdl"), row["buckets"])


def build(docs: DataFrame, tokenizer: str = "unicode61", text: str = "text") -> TextIndex:
    """The index of docs(doc_id, text). Null texts have no tokens but count as documents."""
    split = TOKENIZERS[tokenizer][0]
    tokens = docs.select("doc_id", F.coalesce(split(F.col(text)), F.array().cast("array<string>")).alias("tokens"))
    stats = docs.select("doc_id", length_of(tokenizer, F.col(text)).alias("dl"))
    own = docs.select("doc_id", F.col(text).alias("text"))
    return TextIndex(tokenizer, _postings(tokens), stats, stats.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), docs=own)


def _postings(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", F.posexplode("tokens").alias("pos", "term")).groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def write_segment(store, index: TextIndex) -> dict:
    """Writes the tables of a built index as segments of a store; postings by ranges of terms, so that a
    query skips most row groups. Tells the segments and their totals."""
    postings = store.segment("postings", index.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id"))
    stats = store.segment("stats", index.doc_stats)
    row = store.read([stats]).agg(F.count("*").alias("n"), F.sum("dl").alias("total")).first()
    return {"postings": postings, "stats": stats, "n": row["n"], "total": row["total"] or 0}


def segments(store, parts: list[dict], dead: DataFrame | None, n: int, total: int) -> TextIndex:
    """The index made of segments: without the deleted ids, and without what later segments replace (stale)."""
    from polyvec.operators.ids import alive

    postings, stats = [], []
    for part in parts:
        own = [store.read([part["postings"]]), store.read([part["stats"]])]
        for replaced in part["stale"]:
            gone = store.read([replaced])
            own = [t.join(gone, "doc_id", "left_anti") for t in own]
        postings.append(own[0])
        stats.append(own[1])
    postings, stats = (alive(reduce(DataFrame.unionByName, t), dead) for t in (postings, stats))
    totals = store.spark.createDataFrame([(n, total / n if n else 0.0)], "n long, avgdl double")
    return TextIndex(parts[0]["tokenizer"], postings, stats, totals)


def length_of(tokenizer: str, text: Column) -> Column:
    """The number of tokens of a text."""
    if tokenizer == "trigram":
        n = F.greatest(F.length(text) - 2, F.lit(0))
    elif tokenizer == "unicode61":
        n = F.regexp_count(text, F.lit(WORD))
    else:
        n = F.size(TOKENIZERS[tokenizer][0](text))
    return F.coalesce(n, F.lit(0)).cast("long")


def _counted(index: TextIndex, phrases: list[tuple[str, ...]]) -> DataFrame:
    """doc_id, dl, tf0, tf1, ... of every text of an index that isn't written: how often each phrase is in it."""
    text = F.col("text")
    if index.tokenizer == "identifier_aware":
        tokens = TOKENIZERS[index.tokenizer][0](text)
        rows = index.docs.select("doc_id", length_of(index.tokenizer, text).alias("dl"), F.coalesce(tokens, F.array().cast("array<string>")).alias("_tokens"))
        counts = [F.size(F.filter("_tokens", lambda t, p=p: t == p[0])) if p else F.lit(0) for p in phrases]
    else:
        # Trigrams in a row are a substring; words in a row are one expression.
        patterns = [re.escape(p[0] + "".join(t[-1] for t in p[1:])) if index.tokenizer == "trigram" else phrase_pattern(p) for p in phrases if p]
        patterns = iter([f"(?={x})" if index.tokenizer == "trigram" else x for x in patterns])
        plain = F.lower(text) if index.tokenizer == "trigram" else text
        rows = index.docs.select("doc_id", length_of(index.tokenizer, text).alias("dl"), plain.alias("_plain"))
        counts = [F.coalesce(F.regexp_count("_plain", F.lit(next(patterns))), F.lit(0)) if p else F.lit(0) for p in phrases]
    # One exchange of these small rows, used for the totals and for the scores.
    return rows.select("doc_id", "dl", *[c.cast("int").alias(f"tf{i}") for i, c in enumerate(counts)]).repartition("doc_id")


class QueryError(ValueError):
    """The query is not in the language."""


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()])|([\w\x80-\U0010ffff]+))')


def parse(query: str, tokenizer: str):
    """(tree, phrases) of a query of terms and "phrases" with AND (also implied), OR, NOT and parentheses.

    A tree is a phrase number, or (operator, left, right)."""
    words: list[tuple[str, str]] = []
    at, end = 0, len(query.rstrip())
    while at < end:
        m = _LEX.match(query, at)
        if not m:
            raise QueryError(f"syntax error near {query[at:].strip()[:1]!r}")
        at = m.end()
        if m[1] is not None:
            words.append(("phrase", m[1].replace('""', '"')))
        elif m[2]:
            words.append((m[2], m[2]))
        else:
            words.append(("op", m[3]) if m[3] in ("AND", "OR", "NOT") else ("phrase", m[3]))
    split = TOKENIZERS[tokenizer][1]
    phrases: list[tuple[str, ...]] = []
    i = 0

    def primary():
        nonlocal i
        if i >= len(words):
            raise QueryError("the query ends too early")
        kind, text = words[i]
        i += 1
        if kind == "(":
            out = either()
            if i >= len(words) or words[i][0] != ")":
                raise QueryError("unclosed parenthesis")
            i += 1
            return out
        if kind != "phrase":
            raise QueryError(f"unexpected {text!r}")
        tokens = split(text)
        if tokenizer == "identifier_aware":
            tokens = tokens[:1]  # the identifier as it is; its words are found through the index
        phrases.append(tuple(tokens))
        return len(phrases) - 1

    def without():
        nonlocal i
        out = primary()
        while i < len(words) and words[i] == ("op", "NOT"):
            i += 1
            out = ("NOT", out, primary())
        return out

    def both():
        nonlocal i
        out = without()
        while i < len(words) and (words[i] == ("op", "AND") or words[i][0] in ("phrase", "(")):
            i += words[i] == ("op", "AND")
            out = ("AND", out, without())
        return out

    def either():
        nonlocal i
        out = both()
        while i < len(words) and words[i] == ("op", "OR"):
            i += 1
            out = ("OR", out, both())
        return out

    if not words:
        return None, []
    tree = either()
    if i < len(words):
        raise QueryError(f"unexpected {words[i][1]!r}")
    return tree, phrases


def _holds(tree, hit: list[Column], empty: list[bool]) -> Column:
    """Does a document match? A phrase without tokens restricts nothing beside others."""
    if isinstance(tree, int):
        return hit[tree]
    op, left, right = tree
    if op == "AND":
        if isinstance(left, int) and empty[left]:
            return _holds(right, hit, empty)
        if isinstance(right, int) and empty[right]:
            return _holds(left, hit, empty)
        return _holds(left, hit, empty) & _holds(right, hit, empty)
    if op == "OR":
        return _holds(left, hit, empty) | _holds(right, hit, empty)
    return _holds(left, hit, empty) & ~_holds(right, hit, empty)


def _frequencies(index: TextIndex, phrases: list[tuple[str, ...]]) -> DataFrame:
    """doc_id, tf0, tf1, ... of the documents that have a term of the phrases, from the postings."""
    spark = index.postings.sparkSession
    terms = sorted({t for p in phrases for t in p})
    postings = index.postings.where(F.col("term").isin(terms))
    if index.buckets:  # the partitions of these terms, by the same hash as in save()
        names = spark.createDataFrame([(t,) for t in terms], "term string")
        numbers = [r[0] for r in names.select(F.pmod(F.xxhash64("term"), F.lit(index.buckets)).cast("int")).collect()]
        postings = postings.where(F.col("bucket").isin(numbers))
    rows = postings.groupBy("doc_id").agg(*[F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"p{i}") for i, t in enumerate(terms)])
    none = F.array().cast("array<int>")
    at = {t: F.coalesce(F.col(f"p{i}"), none) for i, t in enumerate(terms)}

    def count(phrase: tuple[str, ...]) -> Column:
        if not phrase:
            return F.lit(0)
        if len(phrase) == 1:
            return F.size(at[phrase[0]])

        def follows(p: Column) -> Column:
            out = F.lit(True)
            for j, term in enumerate(phrase[1:], 1):
                out = out & F.array_contains(at[term], p + j)
            return out

        return F.size(F.filter(at[phrase[0]], follows))

    return rows.select("doc_id", *[count(p).alias(f"tf{i}") for i, p in enumerate(phrases)])


def matches_many(index: TextIndex, queries: dict[int, str]) -> DataFrame:
    """query_id, doc_id, score of every document that matches a query. Scores are positive, greater is
    better. All queries share one pass over postings or texts."""
    spark = index.postings.sparkSession
    parsed = {query_id: parse(text, index.tokenizer) for query_id, text in queries.items()}
    parsed = {query_id: (tree, own) for query_id, (tree, own) in parsed.items() if tree is not None and any(own)}
    phrases = list(dict.fromkeys(p for _, own in parsed.values() for p in own))
    if not parsed:
        return spark.createDataFrame([], "query_id long, doc_id long, score double")
    # Document frequencies: one row, from the same candidates.
    df = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))]
    if index.docs is None:
        rows = _frequencies(index, phrases)
        rows = rows.crossJoin(rows.agg(*df)).crossJoin(index.totals).join(index.doc_stats, "doc_id")
    else:
        rows = _counted(index, phrases)
        rows = rows.crossJoin(rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.count("doc_id").alias("_ids"), *df))
    part = []
    for i in range(len(phrases)):
        tf, n = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        part.append(idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    found = []
    for query_id, (tree, own) in parsed.items():
        number = [phrases.index(p) for p in own]
        score = reduce(lambda a, b: a + b, [part[i] for i in number], F.lit(0.0))
        holds = _holds(tree, [F.col(f"tf{i}") > 0 for i in number], [not p for p in own])
        found.append(F.struct(F.lit(query_id).cast("long").alias("query_id"), F.when(holds & (F.col("n") > 0), score).alias("score")))
    return rows.select("doc_id", F.explode(F.array(*found)).alias("f")).where("f.score is not null").select("f.query_id", "doc_id", "f.score")


def matches(index: TextIndex, query: str) -> DataFrame:
    """doc_id, score of every document that matches the query."""
    return matches_many(index, {0: query}).select("doc_id", "score")


def search_many(index: TextIndex, queries: dict[int, str], k: int | None = 10, subset: DataFrame | None = None) -> DataFrame:
    """query_id, rank, doc_id, score: the k best matches of each query, of those in subset(doc_id) if given."""
    found = matches_many(index, queries)
    if subset is not None:
        found = found.join(subset.select("doc_id").distinct(), "doc_id", "left_semi")
    return ranked(found, k).select("query_id", "rank", "doc_id", "score")


def search(index: TextIndex, query: str, k: int | None = 10, subset: DataFrame | None = None, query_id: int = 0) -> DataFrame:
    """query_id, rank, doc_id, score: the k best matches, of those in subset(doc_id) if given."""
    return search_many(index, {query_id: query}, k, subset)


def any_of(index: TextIndex, asked: DataFrame) -> DataFrame:
    """query_id, doc_id, score of asked(query_id, term): each query asks for any of its terms. For any number
    of queries and terms: only joins by term, with frequencies counted from the same postings."""
    asked = asked.distinct()
    postings = index.postings.join(asked.select("term").distinct(), "term", "left_semi").select("term", "doc_id", F.size("positions").alias("tf"))
    df = postings.groupBy("term").agg(F.count_if((F.col("tf") > 0) & F.col("doc_id").isNotNull()).alias("df"))
    parts = postings.join(df, "term").join(index.doc_stats, "doc_id").crossJoin(index.totals)
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return parts.select("term", "doc_id", part.alias("part")).join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def updated(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """docs with the texts of changes(doc_id, text) in place; postings are always derived, so they can't drift."""
    new = changes.select("doc_id", F.col("text").alias("_new"), F.lit(True).alias("_changed"))
    return docs.join(new, "doc_id", "left").withColumn("text", F.when(F.col("_changed"), F.col("_new")).otherwise(F.col("text"))).select(*docs.columns)
