"""Source trees as files(file, source, hash, mtime, size), by the rules of what is worth indexing."""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyvec.functions.patterns import included
from polyvec.operators.units import language

MOST_BYTES = 512 * 1024
_VERSION_CONTROL = ".hg .svn .git"
_DEPENDENCIES = "third_party vendor node_modules bower_components site-packages Pods deps elm-stuff"
_OUTPUT = "dist target obj bin out build _build DerivedData coverage .next .nuxt .gradle"
_ENVIRONMENTS = "venv env .venv .tox .nox .eggs"
_CACHES = "tmp .cache __pycache__ .mypy_cache .ruff_cache .pytest_cache"
_EDITORS = ".vscode .idea"
IGNORED = tuple(" ".join((_VERSION_CONTROL, _DEPENDENCIES, _OUTPUT, _ENVIRONMENTS, _CACHES, _EDITORS)).split())
HIDDEN_ALLOWED = tuple(f".{x}" for x in ("buildkite", "circleci", "github", "gitlab"))


def ignored(path: Column, extra: tuple[str, ...] = (), forced: tuple[str, ...] = ()) -> Column:
    """Is a part of the relative path an ignored or hidden directory, and none a forced one?"""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    hit = F.exists(folders, lambda p: p.isin(*IGNORED, *extra) | (p.startswith(".") & ~p.isin(*HIDDEN_ALLOWED, ".", "..")))
    return hit & ~F.exists(folders, lambda p: p.isin(*forced)) if forced else hit


def gitignore_regexes(text: str, folder: str = "") -> list[tuple[bool, str]]:
    """(ignored, regular expression) of each line of the .gitignore of a folder, in order: the last match decides."""
    base = re.escape(folder.strip("/")) + "/" if folder.strip("/") else ""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.lstrip("!")
        only_dir, line = line.endswith("/"), line.rstrip("/")
        anchored = "/" in line
        body = "".join("(?:.*/)?" if t == "**/" else ".*" if t == "**" else "[^/]*" if t == "*" else "[^/]" if t == "?" else re.escape(t) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]", line.lstrip("/")))
        out.append((not negated, (f"^{base}" if anchored else f"^{base}(?:.*/)?") + body + ("/" if only_dir else "(?:/|$)")))
    return out


def not_ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    out = F.lit(True)
    for drop, pattern in rules:
        out = F.when(path.rlike(pattern), F.lit(not drop)).otherwise(out)
    return out


def ignore_files(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(folder, text) of every .gitignore below root, outer folders first; ignored folders are not entered."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    out, todo = [], [""]
    while todo:
        folder = todo.pop(0)
        for entry in fs.listStatus(path(f"{root.rstrip('/')}/{folder}".rstrip("/"))):
            name = entry.getPath().getName()
            if entry.isDirectory():
                if name not in IGNORED:
                    todo.append(f"{folder}/{name}".lstrip("/"))
            elif name == ".gitignore":
                stream = fs.open(entry.getPath())
                out.append((folder, bytes(stream.readAllBytes()).decode("utf-8", "replace")))
                stream.close()
    return out


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None, gitignore: str = "", extra: tuple[str, ...] = (), forced: tuple[str, ...] = (), files: list[str] | None = None) -> DataFrame:
    """The files below root in a known language, up to 512 KiB, that no rule ignores: neither the tree's own
    .gitignore files nor the given lines. files: only these, by their paths from root."""
    base = root.rstrip("/")
    rules = [rule for folder, text in ignore_files(spark, base) for rule in gitignore_regexes(text, folder)] + gitignore_regexes(gitignore)
    # Spark lists no hidden folders, so those that are wanted are named.
    hidden = [spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{h}") for h in HIDDEN_ALLOWED]
    paths = [base, *(p.toString() for p in hidden if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), "^" + re.escape(re.sub(r"^[a-z0-9]+:/+", "/", base)) + "/", "")
    rows = found.where(F.col("length") <= MOST_BYTES).withColumn("file", relative)
    rows = rows.where(~ignored(F.col("file"), extra, forced) & language(F.col("file")).isNotNull() & not_ignored(F.col("file"), rules) & included(F.col("file"), patterns or []))
    if files is not None:
        rows = rows.where(F.col("file").isin(*files))
    return rows.select("file", F.decode("content", "UTF-8").alias("source"), F.xxhash64("content").alias("hash"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def searches_from_root(patterns: list[str]) -> bool:
    """Do include patterns reach outside the directory that a search starts in?"""
    return any(p.startswith(("/", "../")) or os.path.isabs(p) for p in patterns)


def any_match(path: str, patterns: list[str]) -> bool:
    return any(fnmatch.fnmatch(path, p) for p in patterns)
