"""Code units: source files as functions, methods, classes, constants and the code between them."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyvec.operators.brace_units import LANGUAGES as BRACES
from polyvec.operators.brace_units import brace_units

LANGUAGES = {
    "py": "python", "pyi": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "go": "go", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "rb": "ruby", "cs": "csharp", "kt": "kotlin", "swift": "swift", "scala": "scala", "php": "php", "lua": "lua", "ex": "elixir", "exs": "elixir",
    "hs": "haskell", "ml": "ocaml", "r": "r", "zig": "zig", "jl": "julia", "sql": "sql", "vue": "vue", "svelte": "svelte", "qml": "qml", "html": "html", "htm": "html", "md": "markdown", "txt": "text",
    "rst": "text", "adoc": "asciidoc", "org": "org", "yaml": "yaml", "yml": "yaml", "toml": "toml", "json": "json", "sh": "shell", "bash": "shell", "zsh": "shell", "ps1": "powershell",
}
NAMES = {"dockerfile": "dockerfile", "makefile": "makefile", "gnumakefile": "makefile"}
TEXT_FORMATS = ("markdown", "text", "asciidoc", "org", "yaml", "toml", "json", "dockerfile", "makefile", "shell", "powershell")
SCHEMA = (
    "file string, name string, qualified_name string, line int, end_line int, language string, unit_type string, signature string, docstring string, code string, "
    "parameters array<string>, return_type string, calls array<string>, variables array<string>, imports array<string>, extends string, parent_class string, complexity int, has_loops boolean, has_branches boolean, has_error_handling boolean"
)
FLAGS = [f"has_{x}" for x in ("loops", "branches", "error_handling")]
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def language(path: Column) -> Column:
    """The language of a path by its name or ending, null if unknown."""
    name = F.lower(F.substring_index(path, "/", -1))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    known = F.when(name.isin(*NAMES), F.element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), name))
    return F.coalesce(known, F.try_element_at(table, F.regexp_extract(name, r"\.([^.]+)$", 1)))


def language_py(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1].lower()
    return NAMES.get(name) or (LANGUAGES.get(name.rsplit(".", 1)[-1]) if "." in name else None)


def code_only(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("language").isin(*TEXT_FORMATS))


def _unit(path: str, kind: str, name: str, line: int, end: int, lines: list[str], **more) -> dict:
    parent = more.get("parent_class")
    blank = {"signature": lines[line - 1].strip() if 0 < line <= len(lines) else "", "docstring": None, "parameters": [], "return_type": None, "calls": [], "variables": [], "imports": [], "extends": None, "parent_class": None, "complexity": 1, "has_loops": False, "has_branches": False, "has_error_handling": False}
    return blank | {"file": path, "name": name, "qualified_name": "::".join(x for x in (path, parent, name) if x), "line": line, "end_line": end, "language": language_py(path), "unit_type": kind, "code": "\n".join(lines[line - 1 : end])} | more


def raw_gaps(path: str, lines: list[str], units: list[dict], imports: list[str]) -> list[dict]:
    """Units for the runs of lines that no unit covers, from their first to their last line with text."""
    covered = set()
    for u in units:
        covered.update(range(u["line"], u["end_line"] + 1))
    out, run = [], []
    for n in range(1, len(lines) + 2):
        if n <= len(lines) and n not in covered:
            run.append(n)
            continue
        while run and not lines[run[0] - 1].strip():
            run.pop(0)
        while run and not lines[run[-1] - 1].strip():
            run.pop()
        if run:
            out.append(_unit(path, "rawcode", f"raw_code_{run[0]}", run[0], run[-1], lines, imports=imports))
        run = []
    return out


_LOOPS = (ast.For, ast.AsyncFor, ast.While, ast.comprehension)
_BRANCHES = (ast.If, ast.IfExp, ast.Match)


def _called(node: ast.AST) -> list[str]:
    names = set()
    for x in ast.walk(node):
        if isinstance(x, ast.Call):
            f = x.func
            names.add(f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None)
    return sorted(n for n in names if n)


def _doc(node: ast.AST, lines: list[str]) -> str | None:
    first = node.body[0] if node.body else None
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        return "\n".join(x.strip() for x in lines[first.lineno - 1 : first.end_lineno]).strip("\"'rRbBuU \n")
    return None


def python_units(path: str, source: str, depth_limit: int = 1024) -> list[dict]:
    """Units of a Python file; a file that does not parse or nests too deeply has none."""
    try:
        module = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines = source.split("\n")
    imports = sorted({a.name for x in ast.walk(module) if isinstance(x, ast.Import) for a in x.names} | {x.module for x in ast.walk(module) if isinstance(x, ast.ImportFrom) and x.module})
    out: list[dict] = []

    def visit(node: ast.AST, parent: str | None, inside: bool, depth: int) -> None:
        if depth > depth_limit:
            raise RecursionError
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                start = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                every = list(ast.walk(child))
                loops, branches = sum(isinstance(x, _LOOPS) for x in every), sum(isinstance(x, _BRANCHES) for x in every)
                a = child.args
                out.append(
                    _unit(
                        path, "method" if parent else "function", child.name, start, child.end_lineno, lines, parent_class=parent, signature=lines[child.lineno - 1].strip(), docstring=_doc(child, lines),
                        parameters=[x.arg for x in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else []))],
                        return_type=ast.unparse(child.returns) if child.returns else None, calls=_called(child),
                        variables=sorted({t.id for x in every if isinstance(x, (ast.Assign, ast.AnnAssign)) for t in (x.targets if isinstance(x, ast.Assign) else [x.target]) if isinstance(t, ast.Name)}),
                        imports=[i for i in imports if re.search(rf"\b{re.escape(i.split('.')[-1])}\b", "\n".join(lines[start - 1 : child.end_lineno]))],
                        complexity=1 + loops + branches, has_loops=loops > 0, has_branches=branches > 0, has_error_handling=any(isinstance(x, (ast.Try, ast.Raise)) for x in every),
                    )
                )
                visit(child, parent, True, depth + 1)
            elif isinstance(child, ast.ClassDef):
                start = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                out.append(_unit(path, "class", child.name, start, child.end_lineno, lines, signature=lines[child.lineno - 1].strip(), docstring=_doc(child, lines), extends=ast.unparse(child.bases[0]) if child.bases else None))
                visit(child, child.name, inside, depth + 1)
            elif isinstance(child, (ast.Assign, ast.AnnAssign)) and not parent and not inside:
                for t in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(t, ast.Name) and re.fullmatch(r"[A-Z][A-Z0-9_]*", t.id):
                        out.append(_unit(path, "constant", t.id, child.lineno, child.end_lineno, lines))
            else:
                visit(child, parent, inside, depth + 1)

    try:
        visit(module, None, False, 0)
    except RecursionError:
        return []
    return out + raw_gaps(path, lines, out, imports)


def document_unit(path: str, source: str) -> list[dict]:
    """A text file as one unit; a blank one has none."""
    lines = source.split("\n")
    first = next((i for i, x in enumerate(lines) if x.strip()), None)
    if first is None:
        return []
    head = []
    for x in lines[first:]:
        if not x.strip() or len(head) == 5:
            break
        head.append(x.strip())
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return [_unit(path, "document", stem, 1, len(lines), lines, signature=lines[first].strip(), docstring="\n".join(head))]


_SCRIPT = re.compile(r"^[ \t]*<script(?![^>]*\bsrc\s*=)[^>]*>(.*?)</script>", re.S | re.M | re.I)


def html_units(path: str, source: str) -> list[dict]:
    """Inline scripts as units of their language, at their lines in the page, and everything else with text as one."""
    lines = source.split("\n")
    out, inside = [], set()
    for m in _SCRIPT.finditer(source):
        a, b = source.count("\n", 0, m.start(1)) + 1, source.count("\n", 0, m.end(1)) + 1
        inside.update(range(a, b + 1))
        if m[1].strip():
            kind = "typescript" if re.search(r"""lang\s*=\s*["']?ts\b""", source[m.start() : m.start(1)]) else "javascript"
            found = brace_units(path, m[1], kind, _unit, raw_gaps, shift=a - 1)
            out += found if any(u["unit_type"] != "rawcode" for u in found) else [_unit(path, "rawcode", f"script_{a}", a, b, lines, language=kind)]
    rest = [i for i, x in enumerate(lines, 1) if i not in inside and x.strip()]
    if rest:
        out.insert(0, _unit(path, "rawcode", f"raw_code_{rest[0]}", rest[0], rest[-1], lines, code="\n".join(lines[i - 1] for i in rest)))
    return out


_QML_OBJECT, _QML_FUNCTION = re.compile(r"^[ \t]*([A-Z][\w.]*)\s*\{", re.M), re.compile(r"^[ \t]*function\s+(\w+)\s*\(([^)]*)\)", re.M)


def qml_units(path: str, source: str) -> list[dict]:
    """The outermost object of a QML file as a class, its functions as methods."""
    found = brace_units(path, source, "javascript", _unit, lambda *_: [])
    lines = source.split("\n")
    m = _QML_OBJECT.search(source)
    out = []
    if m:
        first = source.count("\n", 0, m.start(1)) + 1
        out.append(_unit(path, "class", m[1], first, max(i for i, x in enumerate(lines, 1) if x.strip()), lines, language="qml"))
    for u in found:
        if u["unit_type"] in ("function", "method"):
            out.append(u | {"language": "qml", "unit_type": "method" if m else "function", "parent_class": m[1] if m else None, "qualified_name": "::".join(x for x in (path, m and m[1], u["name"]) if x)})
    return out + raw_gaps(path, lines, out, [])


SKIPS = ("unknown language", "no text", "no units")


def skip_reason(path: str, source: str | None) -> str | None:
    """Why a file has no units; null if it has some."""
    if language_py(path) is None:
        return SKIPS[0]
    if source is None or not source.strip():
        return SKIPS[1]
    return None if file_units(path, source) else SKIPS[2]


def file_units(path: str, source: str) -> list[dict]:
    kind = language_py(path)
    if kind == "python":
        return python_units(path, source)
    if kind in ("html", "vue", "svelte"):
        return html_units(path, source)
    if kind == "qml":
        return qml_units(path, source)
    if kind in BRACES:
        return brace_units(path, source, kind, _unit, raw_gaps)
    if kind in TEXT_FORMATS:
        return document_unit(path, source)
    return raw_gaps(path, source.split("\n"), [], []) if kind else []


def units(files: DataFrame) -> DataFrame:
    """The units of files(file, source), a table function over each file on its own."""

    def run(batches):
        for batch in batches:
            rows = [u for path, source in zip(batch["file"], batch["source"], strict=True) if path is not None and source is not None for u in file_units(path, source)]
            yield pd.DataFrame([[r[c] for c in COLUMNS] for r in rows], columns=COLUMNS)

    return files.select("file", "source").mapInPandas(run, SCHEMA)


def skipped(files: DataFrame) -> DataFrame:
    """file, reason of the files(file, source) that give no units."""

    def run(batches):
        for batch in batches:
            reasons = [skip_reason(path, source) for path, source in zip(batch["file"], batch["source"], strict=True)]
            out = pd.DataFrame({"file": batch["file"], "reason": reasons})
            yield out[out["reason"].notna()]

    return files.where("file is not null").select("file", "source").mapInPandas(run, "file string, reason string")


def call_graph(rows: DataFrame) -> DataFrame:
    """name, called_by of the units that are called by name: sorted distinct callers.

    Units and calls are one table, so that rows is made once; whether a name is a unit's is told by a window,
    and only then are its callers gathered."""
    calls = F.transform(F.coalesce("calls", F.array().cast("array<string>")), lambda c: F.struct(c.alias("name"), F.col("name").alias("caller"), F.lit(False).alias("own")))
    own = F.array(F.struct(F.col("name").cast("string").alias("name"), F.lit(None).cast("string").alias("caller"), F.lit(True).alias("own")))
    every = rows.select(F.explode(F.concat(own, calls)).alias("e")).select("e.*").where("name is not null")
    known = every.withColumn("_known", F.max("own").over(Window.partitionBy("name")))
    return known.where("_known and not own").groupBy("name").agg(F.sort_array(F.collect_set("caller")).alias("called_by"))


LISTS = ("parameters", "calls", "called_by", "variables", "imports")


def merged_units(rows: DataFrame) -> DataFrame:
    """One row a file: name and language of its first unit, code in line order, distinct lists in order, summed
    complexity, flags of any, the lines from the first to the last. Lists that rows lack are left out."""
    lists = [c for c in LISTS if c in rows.columns]
    ordered = F.array_sort(F.collect_list(F.struct("line", "end_line", "name", "code", *lists)))
    out = rows.groupBy("file").agg(ordered.alias("u"), F.min("line").alias("line"), F.max("end_line").alias("end_line"), F.min("language").alias("language"), F.sum("complexity").alias("complexity"), *[F.bool_or(c).alias(c) for c in FLAGS])
    own = {c: F.array_distinct(F.flatten(F.transform(F.col(f"u.{c}"), lambda x: F.coalesce(x, F.array().cast("array<string>"))))) for c in lists}
    return out.select("file", F.col("u")[0]["name"].alias("name"), "language", "line", "end_line", F.array_join(F.transform("u", lambda s: s["code"]), "\n").alias("code"), *[v.alias(k) for k, v in own.items()], "complexity", *FLAGS)


def embedding_text(most: int = 8192) -> Column:
    """The text of a unit that an encoder gets: labelled parts, at most `most` signs."""
    words = F.trim(F.regexp_replace(F.regexp_replace("file", r"[/\\_.\-]+", " "), r"(?<=[a-z])(?=[A-Z])", " "))

    def part(label: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: "), value))

    joined = {c: F.array_join(c, ", ") for c in ("parameters", "calls", "variables", "imports")}
    full = F.concat_ws("\n", F.concat_ws(" ", F.initcap("unit_type"), F.col("name")), part("Signature", F.col("signature")), part("Description", F.col("docstring")), part("Parameters", joined["parameters"]), part("Returns", F.col("return_type")), part("Calls", joined["calls"]), part("Variables", joined["variables"]), part("Uses", joined["imports"]), part("File", words), part("Code", F.col("code")))
    return F.substring(full, 1, most)


def update_plan(state: DataFrame, scan: DataFrame) -> DataFrame:
    """file, action of state(file, hash, mtime, size) against scan(file, hash, mtime, size).

    unchanged: same time and size; touched: only the hash is the same; else changed, added or deleted.
    """
    old = state.select("file", *[F.col(c).alias(f"o_{c}") for c in ("hash", "mtime", "size")])
    action = F.when(F.col("o_hash").isNull(), "added").when(F.col("hash").isNull(), "deleted").when((F.col("mtime") == F.col("o_mtime")) & (F.col("size") == F.col("o_size")), "unchanged").when(F.col("hash") == F.col("o_hash"), "touched").otherwise("changed")
    return scan.join(old, "file", "full_outer").select("file", action.alias("action"))


def strided(rows: DataFrame, keys: list[str], stride: int = 64) -> DataFrame:
    """rows with place: those at every stride-th place of the order of keys (which tell rows apart) come
    first, so that what is encoded first is a sample of everything. Ordered by ranges, not as a whole."""
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).persist()
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_start", before).drop("_n")
    i = F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    n = rows.count()
    first = -(-n // stride)
    place = F.when(F.col("_i") % stride == 0, F.expr(f"_i div {stride}")).otherwise(first + F.col("_i") - F.expr(f"_i div {stride}") - 1)
    return ranged.join(starts, "_part").withColumn("_i", i).withColumn("place", place.cast("long")).select(*rows.columns, "place")


def distinct_texts(rows: DataFrame, text: str = "text") -> DataFrame:
    """Each text once, with the number of rows that share it: what has to be encoded."""
    return rows.where(F.col(text).isNotNull()).groupBy(text).agg(F.count("*").alias("n"))
