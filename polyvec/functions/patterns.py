"""File and text patterns: globs, grep expressions and their regular expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_SPECIAL = set(".+()[]{}^$|\\")


def expand_braces(pattern: str) -> list[str]:
    """a{b,c} as [ab, ac]. A group ends at its first closing brace; without one it is literal."""
    head, opened, rest = pattern.partition("{")
    inner, closed, tail = rest.partition("}")
    if not opened or not closed:
        return [pattern]
    options = inner.split(",")
    if options[-1] == "" and len(options) == 1:
        return []
    return [x for option in options for x in expand_braces(head + option + tail)]


def _stars(pattern: str, any_sign: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append("[^/]*" if c == "*" else any_sign if c == "?" else "\\" + c if c in _SPECIAL else c)
            i += 1
    return "".join(out)


def exclude_regex(pattern: str) -> str:
    """The regular expression of an excluded glob; braces are literal in it."""
    return ("" if pattern.startswith(("**/", "/")) else "(^|.*/)") + _stars(pattern, ".") + "$"


def directory_regex(pattern: str) -> str:
    """The regular expression for paths below a directory, given by name or glob."""
    if not any(c in pattern for c in "*?["):
        return f"(^|/){re.escape(pattern)}/"
    for lead, start in (("**/", "(^|.*/)"), ("*/", "^[^/]*/"), ("/", "^")):
        if pattern.startswith(lead):
            return start + _stars(pattern[len(lead) :], ".") + "/"
    return "(^|/)" + _stars(pattern, ".") + "/"


def include_regex(pattern: str) -> str:
    """The regular expression of one brace-free included glob, which may match in any directory.

    A single star matches across / here, as in the usual glob sets; [..] and [!..] are classes."""
    glob = pattern if pattern.startswith(("**/", "/")) else f"**/{pattern}"
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?" if i == 0 else "(?:.*/)?")
            i += 3
            continue
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end + 1
            continue
        if c == "*":
            out.append(".*")
            i += 2 if glob.startswith("**", i) else 1
            continue
        out.append("." if c == "?" else "\\" + c if c in _SPECIAL else c)
        i += 1
    return "^" + "".join(out) + "$"


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def included(path: Column, patterns: list[str]) -> Column:
    """Does the path match one of the globs? Without globs it does."""
    globs = [g for p in patterns for g in expand_braces(p)]
    return _any([path.rlike(include_regex(g)) for g in globs]) if globs else F.lit(not patterns)


def not_excluded(path: Column, patterns: list[str]) -> Column:
    return ~path.rlike("|".join(map(exclude_regex, patterns))) if patterns else F.lit(True)


def outside(path: Column, directories: list[str]) -> Column:
    return ~path.rlike("|".join(map(directory_regex, directories))) if directories else F.lit(True)


def below(path: Column, prefix: str) -> Column:
    """Paths that begin with the prefix, whatever their case; % and _ in it stay wildcards."""
    return path.ilike(prefix.replace("\\", "\\\\") + "%")


def basic_to_extended(pattern: str) -> str:
    r"""A basic regular expression as an extended one: \| \( \) \{ \} become operators, the brackets
    only in pairs; \+ and \? stay literal, and a count at the start too."""
    pairs: set[int] = set()
    for opened, closed in ("()", "{}"):
        stack, i = [], 0
        while i + 1 < len(pattern):
            if pattern[i] != "\\":
                i += 1
                continue
            if pattern[i + 1] == opened:
                stack.append(i)
            elif pattern[i + 1] == closed and stack:
                pairs |= {stack.pop(), i}
            i += 2
    out, i, literal = "", 0, 0
    while i < len(pattern):
        c = pattern[i : i + 2]
        if c[0] != "\\" or len(c) < 2:
            out += c[0]
            i += 1
            continue
        if c[1] == "|" or (c[1] in "()" and i in pairs):
            out += c[1]
        elif c[1] == "{" and i in pairs:
            literal += not out
            out += "{" if out else "\\{"
        elif c[1] == "}" and i in pairs:
            out += "\\}" if literal else "}"
            literal -= literal > 0
        else:
            out += c
        i += 2
    return out


def literal_braces(pattern: str) -> str:
    """The pattern with every brace that opens or closes no count made literal."""
    out, i, in_class = "", 0, False
    while i < len(pattern):
        c = pattern[i]
        escaped = i > 0 and pattern[i - 1] == "\\"
        if c in "[]" and not escaped and (c == "[" or in_class):
            in_class = c == "["
        elif not in_class:
            if c == "\\" and i + 1 < len(pattern):
                out += f"[{pattern[i + 1]}]" if pattern[i + 1] in "{}" else pattern[i : i + 2]
                i += 2
                continue
            if c == "{" and (m := re.match(r"\{(\d+,?\d*|,\d+)\}", pattern[i:])):
                out += m[0]
                i += len(m[0])
                continue
            if c in "{}":
                out += f"[{c}]"
                i += 1
                continue
        out += c
        i += 1
    return out


def is_regex(pattern: str) -> bool:
    """Is it a regular expression for the engine that will run it, the JVM's?"""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import IllegalArgumentException

    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):  # a syntax error, as it is or as Spark shows it
        return False
    return True


def text_matches(text: Column, pattern: str, fixed: bool = False, extended: bool = True, word: bool = False, ignore_case: bool = True) -> Column:
    """Does the text hold the pattern, as a regular expression or literally?

    A pattern that is no regular expression counts literally only. fixed: literally, with the case
    as it is. word: between word boundaries."""
    literal = re.escape(pattern)
    bounds = (r"\b", r"\b") if word else ("", "")
    if fixed:
        return text.rlike("(?m)" + literal.join(bounds))
    flags = "(?mi)" if ignore_case else "(?m)"
    out = text.rlike(flags + literal.join(bounds))
    candidate = literal_braces(pattern if extended else basic_to_extended(pattern))
    if not is_regex(candidate):
        return out
    return out | text.rlike(flags + f"(?:{candidate})".join(bounds))


def matching_lines(text: Column, pattern: str, **options) -> Column:
    """array of (line, text) of the matching lines, counted from 1."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    return F.filter(lines, lambda s: text_matches(s["text"], pattern, **options))


_STOP = {"the", "and", "for", "not", "with"}


def pattern_words(pattern: str) -> list[str]:
    """The words of a regular expression that carry meaning, for a semantic query."""
    bare = re.sub(r"\\[a-zA-Z]|\[[^\]]*\]|\{[^}]*\}|[^A-Za-z0-9_]+", " ", pattern)
    return [w for w in dict.fromkeys(bare.split()) if len(w) > 1 and w.lower() not in _STOP]


def merged_query(query: str, pattern: str) -> str:
    """The query with the pattern's words that it lacks."""
    have = set(query.lower().split())
    return " ".join([query, *(w for w in pattern_words(pattern) if w.lower() not in have)]).strip()
