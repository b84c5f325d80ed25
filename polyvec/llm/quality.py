"""Line-first quality rules: failing lines are removed, then documents that lost too much go.

Every rule is a built-in expression, so the whole step stays in the JVM and needs no shuffle.
sql() holds the same rules as DuckDB SQL for the oracle; the two are kept side by side. Boilerplate is
known in English, German, French and Spanish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyvec.llm.scratch import column, fresh

LEAST_KEPT = 0.6
BOILERPLATE = "|".join(
    (
        "cookies?|javascript|click here|sign in|log in|subscribe|privacy policy|terms of (use|service)|all rights reserved|lorem ipsum|share (this|on)|read more",
        "alle rechte vorbehalten|hier klicken|datenschutzerklärung|nutzungsbedingungen|newsletter abonnieren",
        "tous droits réservés|cliquez ici|politique de confidentialité|mentions légales|lire la suite",
        "todos los derechos reservados|haga clic aquí|política de privacidad|aviso legal|iniciar sesión",
    )
)
_SYMBOLS = r"[#$%&*+=<>@^~{}|\\_]+"
_BARS = "[|»›•]+"
_CLOSING = "[.!?:;…。！？\"'”»)]$"


def line_fails(x: Column) -> dict[str, Column]:
    """By rule: does the (trimmed) line fail? The cheap rules come first."""
    size = F.length(x)
    words = size - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    bars = size - F.length(F.regexp_replace(x, _BARS, ""))
    return {
        "shouting": (size >= 12) & ~x.rlike(r"\p{Ll}") & x.rlike(r"\p{Lu}"),
        "navigation": x.rlike(_BARS) & (bars >= 2) & (words <= 8 * bars),
        "symbols": x.rlike(_SYMBOLS) & (size - F.length(F.regexp_replace(x, _SYMBOLS, "")) > 0.1 * size),
        "no_sentence": (size < 60) & ~x.rlike(_CLOSING) & (words < 3),
        "boilerplate": (size < 200) & F.lower(x).rlike(f"(^|[^a-z])({BOILERPLATE})([^a-z]|$)"),
        "same_words": (words >= 12) & (F.size(F.array_distinct(F.split(x, " "))) < 0.2 * words),
    }


def cleaned(docs: DataFrame, least_kept: float = LEAST_KEPT) -> DataFrame:
    """docs with the kept lines as text, their length as n_chars; rejected documents are gone.

    Lines are trimmed; blank ones don't count. A line that fails a rule or repeats an earlier line
    of its document is removed. A document is rejected if the removed lines hold more than
    1 - least_kept of the characters of its non-blank lines, or if nothing is left: so null, empty
    and blank texts are rejected. Other columns, whatever their names, nulls in them and repeated rows
    stay; n_chars is set only if there is such a column. Very long texts and lines are judged whole.
    Of equal lines the first stays. An empty table stays empty.
    """
    name = fresh("_quality", docs.columns)
    kept = decided(docs, name).where(accepted(least_kept, name))
    out = {"text": F.array_join(f"{name}.kept", "\n")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length(F.array_join(f"{name}.kept", "\n")).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[out[c].alias(c) if c in out else F.col(column(c)) for c in docs.columns])


def decided(docs: DataFrame, name: str = "_quality") -> DataFrame:
    """docs with the struct `name`(lines, kept). It comes from a generator, past which the optimiser
    pushes no expression: the rules run once, however often their result is used."""
    lines = F.filter(F.transform(F.split(F.replace(F.replace("text", F.lit("\r"), F.lit("\n")), F.lit("\t"), F.lit(" ")), "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def passes(line: Column) -> Column:
        bad = F.lit(False)
        for rule in line_fails(line).values():
            bad = bad | rule
        return ~bad

    mid = fresh("_split", [*docs.columns, name])
    split = docs.select("*", F.explode(F.array(F.struct(lines.alias("lines")))).alias(mid))
    kept = F.array_distinct(F.filter(f"{mid}.lines", passes))
    return split.select(*[F.col(column(c)) for c in docs.columns], F.explode(F.array(F.struct(F.col(f"{mid}.lines").alias("lines"), kept.alias("kept")))).alias(name))


def _chars(lines: str) -> Column:
    return F.length(F.array_join(lines, ""))


def accepted(least_kept: float, name: str = "_quality") -> Column:
    return (F.size(f"{name}.kept") > 0) & (_chars(f"{name}.kept") >= least_kept * _chars(f"{name}.lines"))


def report(docs: DataFrame, least_kept: float = LEAST_KEPT) -> DataFrame:
    """The kept documents: doc_id, n_lines, n_kept, chars_kept, text (the kept lines)."""
    kept = decided(docs.select("doc_id", "text")).where(accepted(least_kept))
    return kept.select("doc_id", F.size("_quality.lines").alias("n_lines"), F.size("_quality.kept").alias("n_kept"), _chars("_quality.kept").alias("chars_kept"), F.array_join("_quality.kept", "\n").alias("text"))


def sql(source: str = "documents", least_kept: float = LEAST_KEPT) -> str:
    """DuckDB SQL: all columns of source, and _lines and _kept, of the accepted documents."""
    size, words = "length(x)", "(length(x) - length(replace(x, ' ', '')) + 1)"

    def dropped(signs: str) -> str:
        return f"(length(x) - length(regexp_replace(x, '{signs}', '', 'g')))"

    closing = _CLOSING.replace("'", "''")
    bad = [
        f"({size} >= 12 and not regexp_matches(x, '\\p{{Ll}}') and regexp_matches(x, '\\p{{Lu}}'))",
        f"({dropped(_BARS)} >= 2 and {words} <= 8 * {dropped(_BARS)})",
        f"({dropped(_SYMBOLS)} > 0.1 * {size})",
        f"({size} < 60 and not regexp_matches(x, '{closing}') and {words} < 3)",
        f"({size} < 200 and regexp_matches(lower(x), '(^|[^a-z])({BOILERPLATE})([^a-z]|$)'))",
        f"({words} >= 12 and len(list_distinct(string_split(x, ' '))) < 0.2 * {words})",
    ]
    return f"""
with split as (
  select *, list_filter(list_transform(string_split(replace(replace(text, chr(13), chr(10)), chr(9), ' '), chr(10)), lambda x: trim(x)), lambda x: x <> '') as _lines
  from {source}),
passed as (select *, list_filter(_lines, lambda x: not ({" or ".join(bad)})) as _passed from split),
once as (select *, list_filter(_passed, lambda x, i: list_position(_passed, x) = i) as _kept from passed)
select * exclude (_passed) from once
where len(_kept) > 0 and length(array_to_string(_kept, '')) >= {least_kept} * length(array_to_string(_lines, ''))"""


def report_sql() -> str:
    return f"select doc_id, len(_lines) as n_lines, len(_kept) as n_kept, length(array_to_string(_kept, '')) as chars_kept, array_to_string(_kept, chr(10)) as text from ({sql()})"
