"""Metadata conditions: a small, safe predicate language compiled to a Spark Column.

    or_expr  := and_expr (OR and_expr)*        and_expr := unary (AND unary)*
    unary    := [NOT] primary                  primary  := ( or_expr ) | column test
    test     := cmp ? | [NOT] LIKE ? | [NOT] REGEXP ? | IS [NOT] NULL
              | [NOT] BETWEEN ? AND ? | [NOT] IN (?, ...)

Values come only as placeholders, so a condition holds no literals, calls, subqueries or arithmetic;
the one exception is a constant comparison of two whole numbers, such as 1=1. Catalyst gets a plain
expression, which it pushes into the scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConditionError(ValueError):
    """The condition is not in the language, or names an unknown column."""


_FORBIDDEN = re.compile(r"\b(?:ALTER|ATTACH|CREATE|DELETE|DETACH|DROP|EXEC|EXECUTE|GRANT|INSERT|PRAGMA|REVOKE|SELECT|TRUNCATE|UNION|UPDATE)\b", re.I)
_LEX = re.compile(r"""\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<op><=|>=|<>|!=|=|<|>)|(?P<sign>[?(),]))""")
_WORDS = {"AND", "OR", "NOT", "LIKE", "REGEXP", "IS", "NULL", "BETWEEN", "IN"}
_CONSTANT = re.compile(r" *([0-9]+) *= *([0-9]+) *\Z")


def check_safe(condition: str) -> None:
    """Rejects comments, statement ends and words of data definition or change, quoted or not."""
    if not condition.strip():
        raise ConditionError("empty condition")
    for mark in ("--", "/*", "*/", ";"):
        if mark in condition:
            raise ConditionError(f"{mark!r} is not allowed")
    if m := _FORBIDDEN.search(condition):
        raise ConditionError(f"{m[0].upper()} is not allowed")


def lex(condition: str) -> list[tuple[str, str]]:
    """(kind, text) tokens: key (upper case), name, op, ?, (, ) and comma."""
    out, at, end = [], 0, len(condition.rstrip())
    while at < end:
        m = _LEX.match(condition, at)
        if not m:
            raise ConditionError(f"unexpected {condition[at:].strip()[:1]!r} at {at}")
        at = m.end()
        if m["quoted"] is not None:
            out.append(("name", m["quoted"][1:-1].replace('""', '"')))
        elif m["word"] is not None:
            upper = m["word"].upper()
            out.append(("key", upper) if upper in _WORDS else ("name", m["word"]))
        elif m["op"]:
            out.append(("op", m["op"]))
        else:
            out.append((m["sign"], m["sign"]))
    return out


def _like(pattern: str) -> str:
    """A pattern without an escape sign as one for Spark, whose escape sign is the backslash."""
    return pattern.replace("\\", "\\\\")


class _Parser:
    def __init__(self, tokens: list[tuple[str, str]], schema: T.StructType, values: Sequence):
        self.tokens, self.at, self.values, self.used = tokens, 0, list(values), 0
        self.columns = {f.name.lower(): f for f in schema.fields}

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, kind: str, text: str | None = None) -> str:
        token = self.peek()
        if token[0] != kind or (text is not None and token[1] != text):
            raise ConditionError(f"expected {text or kind}, found {token[1] or 'the end'!r}")
        self.at += 1
        return token[1]

    def key(self, *words: str) -> bool:
        if all(self.peek(i) == ("key", w) for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def parse(self) -> Column:
        out = self.alternatives()
        if self.peek()[0] != "end":
            raise ConditionError(f"unexpected {self.peek()[1]!r}")
        if self.used != len(self.values):
            raise ConditionError(f"{len(self.values)} values for {self.used} placeholders")
        return out

    def alternatives(self) -> Column:
        parts = [self.conjunction()]
        while self.key("OR"):
            parts.append(self.conjunction())
        return reduce(lambda a, b: a | b, parts)

    def conjunction(self) -> Column:
        parts = [self.unary()]
        while self.key("AND"):
            parts.append(self.unary())
        return reduce(lambda a, b: a & b, parts)

    def unary(self) -> Column:
        return ~self.primary() if self.key("NOT") else self.primary()

    def value(self):
        self.take("?")
        if self.used >= len(self.values):
            raise ConditionError("a placeholder has no value")
        self.used += 1
        return self.values[self.used - 1]

    def bound(self, field: T.StructField) -> Column:
        """The next value with the column's type, as columns with an affinity compare."""
        value = self.value()
        if value is None:
            return F.lit(None).cast(field.dataType)
        if isinstance(value, bool):
            value = int(value)
        kind = field.dataType
        if isinstance(kind, T.StringType):
            return F.lit(value if isinstance(value, str) else str(value))
        if isinstance(kind, T.BooleanType):
            return F.lit(value).cast("int").cast("boolean") if not isinstance(value, str) else F.lit(value).cast("boolean")
        if isinstance(kind, T.IntegralType) and isinstance(value, float):
            return F.lit(value)
        return F.lit(value).try_cast(kind) if isinstance(value, str) else F.lit(value)

    def primary(self) -> Column:
        if self.peek()[0] == "(":
            self.take("(")
            out = self.alternatives()
            self.take(")")
            return out
        name = self.take("name")
        field = self.columns.get(name.lower())
        if field is None:
            raise ConditionError(f"unknown column {name!r}")
        column = F.col(f"`{field.name}`")
        if self.key("IS", "NOT", "NULL"):
            return column.isNotNull()
        if self.key("IS", "NULL"):
            return column.isNull()
        negated = self.key("NOT")
        if self.key("LIKE"):
            pattern = self.value()
            out = F.lit(None).cast("boolean") if pattern is None else column.cast("string").ilike(_like(str(pattern)))
        elif self.key("REGEXP"):
            pattern = self.value()
            out = F.lit(None).cast("boolean") if pattern is None else column.cast("string").rlike(str(pattern))
        elif self.key("BETWEEN"):
            low = self.bound(field)
            self.take("key", "AND")
            out = column.between(low, self.bound(field))
        elif self.key("IN"):
            self.take("(")
            options = [self.bound(field)]
            while self.peek()[0] == ",":
                self.take(",")
                options.append(self.bound(field))
            self.take(")")
            out = column.isin(*options)
        elif negated:
            raise ConditionError("NOT needs LIKE, REGEXP, BETWEEN or IN here")
        else:
            op = self.take("op")
            value = self.bound(field)
            out = {"=": column == value, "!=": column != value, "<>": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[op]
        return ~out if negated else out


def compile_condition(condition: str, values: Sequence, schema: T.StructType) -> Column:
    """The condition as a Column over a table of the schema. Column names ignore case."""
    check_safe(condition)
    if m := _CONSTANT.match(condition):
        if values:
            raise ConditionError("values without placeholders")
        return F.lit(int(m[1]) == int(m[2]))
    return _Parser(lex(condition), schema, values).parse()


def where(rows: DataFrame, condition: str, values: Sequence = ()) -> DataFrame:
    """The rows for which the condition is true (not merely unknown)."""
    return rows.where(compile_condition(condition, values, rows.schema))
