"""Tokenizers of the keyword index, built from SQL functions so that they run in the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Precomposed Latin, Greek and Cyrillic letters and the letters they are made of.
_FOLD = {c: b for n in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)) if (c := chr(n)) != (b := unicodedata.normalize("NFKD", c)[:1]) and unicodedata.category(c)[0] == "L" and all(unicodedata.category(x) == "Mn" for x in unicodedata.normalize("NFKD", c)[1:])}
_FROM, _TO = "".join(_FOLD), "".join(_FOLD.values())
CAMEL = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def fold(text: Column) -> Column:
    """Lower case, without diacritics. Texts of plain letters only skip the table of signs."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.lower(F.regexp_replace(F.translate(text, _FROM, _TO), r"\p{M}+", ""))).otherwise(F.lower(text))


def fold_py(text: str) -> str:
    """fold() on the driver, for query strings."""
    return "".join(x for x in (_FOLD.get(c, c) for c in text) if unicodedata.category(x)[0] != "M").lower()


#: A token of unicode_tokens() in the text as it is: marks go with the letter before them.
WORD = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{M}]*"


@cache
def _variants() -> dict[str, str]:
    """For each letter all signs that fold to it."""
    out: dict[str, list[str]] = {}
    for n in (*range(0x30, 0x3000), 0x212A, 0x212B):
        c = chr(n)
        low = fold_py(c)
        if len(low) == 1 and low != c:
            out.setdefault(low, []).append(c)
    return {k: "".join(v) for k, v in out.items()}


def phrase_pattern(phrase: tuple[str, ...]) -> str:
    """A regular expression that matches in a text, as it is, once for every place where the folded tokens
    of the phrase follow each other."""
    inside, marks = r"[\p{L}\p{N}\p{Co}\p{M}]", r"\p{M}*"

    def sign(c: str) -> str:
        more = _variants().get(c, "")
        return (f"[{re.escape(c)}{more}]" if more else re.escape(c)) + marks

    words = ["".join(map(sign, t)) for t in phrase]
    rest = "".join(rf"[^\p{{L}}\p{{N}}\p{{Co}}]+{w}(?!{inside})" for w in words[1:])
    # The first sign is looked at before what is behind it: at most places that is all.
    return rf"(?={sign(phrase[0][0])})(?<![\p{{L}}\p{{N}}\p{{Co}}]\p{{M}}{{0,8}}){words[0]}(?!{inside})" + (f"(?={rest})" if rest else "")


def unicode_tokens(text: Column) -> Column:
    """Runs of letters and digits, folded; every other sign separates, the underscore too."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), 1)


def unicode_tokens_py(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold_py(text))


def trigram_tokens(text: Column) -> Column:
    """Every three signs in a row, lower case; texts of fewer than three have none.

    Arrays are zipped as wholes: inside a lambda an outer expression would be evaluated for each element."""
    signs = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    pairs = F.zip_with(signs, F.slice(signs, 2, 1 << 30), lambda a, b: F.concat(a, b))
    return F.filter(F.zip_with(pairs, F.slice(signs, 3, 1 << 30), lambda a, b: F.concat(a, b)), lambda t: t.isNotNull())


def trigram_tokens_py(text: str) -> list[str]:
    low = text.lower()
    return [low[i : i + 3] for i in range(len(low) - 2)]


def split_identifier_py(token: str) -> list[str]:
    low = token.lower()
    parts = [p for p in low.split("_") if p] if "_" in token else [p.lower() for p in re.findall(CAMEL, token)]
    if len(parts) < 2:
        return [low]
    return [low, *parts, *(f"{a}_{b}" for a, b in zip(parts, parts[1:]))]


def identifier_tokens_py(text: str) -> list[str]:
    return [t for word in re.findall(IDENTIFIER, text) for t in split_identifier_py(word)]


def split_identifier(token: Column) -> Column:
    """The identifier in lower case; if it has several words also each of them and each two neighbours joined by _."""
    low = F.lower(token)
    parts = F.when(token.contains("_"), F.filter(F.split(low, "_"), lambda p: p != "")).otherwise(F.transform(F.regexp_extract_all(token, F.lit(f"({CAMEL})"), 1), lambda p: F.lower(p)))
    n = F.size(parts)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.get(parts, i - 1), F.lit("_"), F.get(parts, i)))
    return F.when(n >= 2, F.concat(F.array(low), parts, pairs)).otherwise(F.array(low))


def identifier_tokens(text: Column) -> Column:
    """split_identifier() of every identifier in the text, in order."""
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), 1), split_identifier))


TOKENIZERS = {
    "unicode61": (unicode_tokens, unicode_tokens_py),
    "trigram": (trigram_tokens, trigram_tokens_py),
    "identifier_aware": (identifier_tokens, identifier_tokens_py),
}
_EDGE = "\"'()[]{}<>.,;:!?*^-+/\\|&%$#@~`="


def all_words_query(text: str) -> str:
    """User text as a query for all of its words: outer punctuation and operators go, words are quoted."""
    words = [w.strip(_EDGE).replace('"', "") for w in text.split()]
    return " ".join(f'"{w}"' for w in words if w and w.upper() not in ("AND", "OR", "NOT", "NEAR"))


def any_identifier_query(text: str) -> str:
    """User text as a query for any of its identifier tokens."""
    return " OR ".join(f'"{t}"' for t in dict.fromkeys(identifier_tokens_py(text)))


def json_text(value) -> str:
    """The strings, numbers and truth values in a JSON value, by sorted keys, joined by blanks."""
    if isinstance(value, dict):
        return " ".join(x for k in sorted(value) if (x := json_text(value[k])))
    if isinstance(value, list):
        return " ".join(x for v in value if (x := json_text(v)))
    if isinstance(value, bool):
        return "true" if value else "false"
    return "" if value is None else str(value)


def rfc3339(moment: Column) -> Column:
    """A timestamp as RFC 3339 in whole seconds, for a session in UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def row_text(*columns: str) -> Column:
    """Metadata columns as one text; nulls are left out."""
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in sorted(columns)])
