"""Mixing sources to target weights under a token budget, with exact cuts.

Every document gets a hash-random key. Within a source documents are put in key order; the keys
are uniform, so equal ranges of the key space are balanced parts of any source, and a hot source
simply has more of them. Parts are sorted independently; a prefix sum over the part totals (a table
of one row a part) makes the running token counts global. A source takes its documents in that
order until its budget is met exactly, whole epochs first, and the last document gives just the
tokens that are missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyvec.llm.scratch import Scratch, column

SEED = 17
PART_ROWS = 5_000
_SPACE = 1 << 60


def tokens(text: str = "text") -> Column:
    """Tokens of a text: its runs without white space. Null counts 0."""
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text), r"\s+"), "")), F.lit(0)).cast("long")


def _key(seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def _plan(counted: DataFrame, weights: dict | None, budget: int | None) -> DataFrame:
    """One row a source: total, target (its budget), parts."""
    spark = counted.sparkSession
    each = counted.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    if weights is None:
        each = each.withColumn("weight", F.floor(F.sqrt("total")).cast("decimal(18,0)"))
    else:
        given = spark.createDataFrame([(k, round(w * 10**6)) for k, w in weights.items()], "source string, weight long").withColumn("weight", F.col("weight").cast("decimal(18,0)"))
        each = each.join(given, each["source"].eqNullSafe(given["source"]), "left").select(each["source"], "total", "parts", F.coalesce("weight", F.lit(0).cast("decimal(18,0)")).alias("weight"))
    # The totals are one row; a window over all sources has one row a source.
    over = each.agg(F.sum("weight").alias("all_weight"), F.sum("total").alias("all_total"))
    amount = F.col("all_total") if budget is None else F.lit(budget)
    each = each.crossJoin(over).where("total > 0 and all_weight > 0")
    return each.withColumn("amount", amount.cast("decimal(19,0)")).select("source", "total", "parts", F.expr("cast(amount * weight div all_weight as bigint)").alias("target"))


def mixture(docs: DataFrame, weights: dict | None = None, budget: int | None = None, seed: int = SEED, whole: bool = False) -> DataFrame:
    """The documents that the mixture takes: source, epoch, doc_id, mix_key, n_tokens, start_token, taken_tokens.

    weights: by source, relative; None takes the (whole) square roots of the sources' token counts,
    which evens sources out. A source not named has weight 0. budget: tokens in all; None takes as
    many as the corpus has. The source s gets floor(budget * weight / sum of weights) tokens, exactly.
    Epoch e of a source repeats its documents in the same order; start_token counts the tokens
    before the document in its epoch and taken_tokens is less than n_tokens only at the cut.

    whole: instead, docs' own columns, the text at the cut shortened to its taken tokens and n_chars
    with it. Null sources are a source of their own. Null and empty texts have no tokens; they come
    along where the mixture passes them, a source of only such texts gives nothing. A null doc_id has
    a key of its own. Ties of keys go by doc_id, then by token count; repeated rows each count.
    Very long texts count whole, and are cut by tokens only if the budget ends in them. Other columns
    may have any names, those of helpers and with dots too. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    narrow = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id"), _key(seed).alias("mix_key"), tokens().alias("n_tokens"))
    counted = scratch.write(narrow)
    plan = scratch.write(_plan(counted, weights, budget))

    def placed(rows: DataFrame) -> DataFrame:
        part = F.floor(F.col("mix_key") / _SPACE * F.col("parts")).cast("long")
        return rows.join(plan, _same(rows, plan)).drop(plan["source"]).withColumn("part", part)

    sums = placed(counted).groupBy("source", "part").agg(F.sum("n_tokens").alias("in_part"))
    before = F.coalesce(F.sum("in_part").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = scratch.write(sums.select("source", "part", before.alias("before")))
    rows = placed(docs.select(*[F.col(column(c)).alias(f"_doc_{i}") for i, c in enumerate(docs.columns)], F.col("source").cast("string").alias("source"), "doc_id", _key(seed).alias("mix_key"), tokens().alias("n_tokens")) if whole else counted)
    rows = rows.join(offsets, _same(rows, offsets) & (rows["part"] == offsets["part"])).drop(offsets["source"]).drop(offsets["part"])
    order = Window.partitionBy("source", "part").orderBy("mix_key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start_token", F.col("before") + F.sum("n_tokens").over(order) - F.col("n_tokens"))
    full, rest = F.expr("target div total"), F.col("target") % F.col("total")
    epochs = F.sequence(F.lit(0).cast("long"), full)
    rows = rows.withColumn("epoch", F.explode(epochs)).where((F.col("epoch") < full) | (F.col("start_token") < rest))
    taken = F.when(F.col("epoch") < full, F.col("n_tokens")).otherwise(F.least("n_tokens", rest - F.col("start_token")))
    if not whole:
        return rows.select("source", "epoch", "doc_id", "mix_key", "n_tokens", "start_token", taken.alias("taken_tokens"))
    own = {c.lower(): f"_doc_{i}" for i, c in enumerate(docs.columns)}
    pieces = F.split(own["text"], r"(?<=\s)(?=\S)")
    lead = F.col(own["text"]).rlike(r"^\s").cast("int")
    short = F.array_join(F.slice(pieces, F.lit(1), taken.cast("int") + lead), "")
    text = F.when(taken < F.col("n_tokens"), F.rtrim(short)).otherwise(F.col(own["text"]))
    out = {"text": text}
    if "n_chars" in own:
        out["n_chars"] = F.when(taken < F.col("n_tokens"), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own["n_chars"]))
    return rows.select(*[out.get(c.lower(), F.col(own[c.lower()])).alias(c) for c in docs.columns])


def mixture_sql(seed: int = SEED) -> str:
    """DuckDB SQL for mixture() with its defaults, over documents."""
    return f"""
with d as (
  select source, doc_id, cast('0x' || substr(md5('{seed}:' || doc_id), 1, 15) as bigint) as mix_key,
    cast(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as bigint) as n_tokens from documents),
s as (select source, sum(n_tokens)::hugeint as total, floor(sqrt(sum(n_tokens)))::hugeint as weight from d group by source),
p as (select source, total, (sum(total) over () * weight) // sum(weight) over () as target from s),
r as (select *, cast(sum(n_tokens) over (partition by source order by mix_key, doc_id rows unbounded preceding) - n_tokens as bigint) as start_token from d),
e as (select r.*, p.total, p.target, unnest(range(0, cast(p.target // p.total as bigint) + 1)) as epoch from r join p using (source))
select source, epoch, doc_id, mix_key, n_tokens, start_token,
  case when epoch < target // total then n_tokens else least(n_tokens, cast(target % total as bigint) - start_token) end as taken_tokens
from e where epoch < target // total or start_token < target % total"""
