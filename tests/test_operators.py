"""Operators against hand-computed cases, brute force, and sqlite's full text."""

import base64
import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyvec.engine import Engine
from polyvec.functions import patterns, text as texts
from polyvec.functions.predicate import ConditionError, compile_condition, where
from polyvec.operators import codec, fulltext, fusion, index as indexes, kmeans, maxsim, metadata, metrics, pooling, ranking, units
from polyvec.sources import metadata_rows, projects, vector_files


def unit(rows):
    return rows / np.linalg.norm(rows, axis=-1, keepdims=True)


def frame(spark, docs):
    return spark.createDataFrame([(i, [[float(x) for x in v] for v in d]) for i, d in enumerate(docs)], "doc_id long, embs array<array<double>>")


def queries(spark, qs):
    return spark.createDataFrame([(i, j, [float(x) for x in v]) for i, q in enumerate(qs) for j, v in enumerate(q)], "query_id long, qpos int, qvec array<double>")


def test_maxsim_by_hand(spark):
    docs = frame(spark, [[(0.5, 0.5, 0, 0), (0.8, 0.2, 0, 0), (0, 0.9, 0.1, 0)], []])
    got = maxsim.maxsim_topk(docs, queries(spark, [[(1, 0, 0, 0), (0, 1, 0, 0)]])).collect()
    assert [(r.doc_id, round(r.score, 6)) for r in got] == [(0, 1.7), (1, 0.0)]


def test_rerank_order_and_error(spark):
    e = np.eye(4)
    docs = frame(spark, [[e[0], e[1]], [e[0], e[2]], [e[2], e[3]]])
    assert [(r.doc_id, r.score) for r in maxsim.rerank(docs, queries(spark, [[e[0], e[1]]])).collect()] == [(0, 2.0), (1, 1.0), (2, 0.0)]
    with pytest.raises(Exception, match="not finite"):
        maxsim.rerank(frame(spark, [[(math.nan, 0, 0, 0)]]), queries(spark, [[e[0]]])).collect()


def test_scores_that_are_not_finite_come_last(spark):
    rows = spark.createDataFrame([(0, i, s) for i, s in enumerate([1.0, math.inf, 0.5, math.nan])], "query_id long, doc_id long, score double")
    assert [r.doc_id for r in maxsim.ranked(rows, None).orderBy("rank").collect()] == [0, 2, 1, 3]


def test_codec_parts():
    assert codec.assign(np.array([[1.0, 0.0]]), np.array([[1.0, 0], [4, 0], [4, 1]])).tolist() == [2]
    b = np.random.default_rng(0).integers(0, 16, (7, 8)).astype(np.uint8)
    for nbits in (1, 2, 4, 8):
        x = b & ((1 << nbits) - 1)
        assert (codec.unpack_buckets(codec.pack_buckets(x, nbits), nbits, 8) == x).all()
    assert codec.pack_buckets(np.array([[1, 0]], np.uint8), 4).tolist() == [[0b10000000]]
    c = codec.Codec(1, np.zeros((1, 1)), np.array([-1.0, 0, 1]), np.zeros(2), np.zeros(1), 0.0)
    assert np.searchsorted(c.cutoffs, [0.0], side="left").tolist() == [1]
    assert codec.merged_threshold(1.0, 3, 2.0, 1) == 1.25
    assert np.quantile([1, 2, 4, 4.5], 0.75) == 4.125
    assert kmeans.centroid_count(100, 5) == 256


def test_index_recall_and_maintenance(spark, tmp_path):
    rng = np.random.default_rng(3)
    centers = unit(rng.normal(size=(40, 16)))
    data = [unit(centers[rng.integers(0, 40, 6)] + 0.1 * rng.normal(size=(6, 16))) for _ in range(200)]
    docs, qs = frame(spark, data), queries(spark, [d[:3] for d in data[:30]])
    index = indexes.create(docs, centroids=unit(centers))
    found = indexes.search(index, qs, indexes.SearchParameters(k=5))
    exact = maxsim.maxsim_topk(docs, qs, 5)
    recall = metrics.overlap(found, exact).agg(F.avg("recall")).first()[0]
    assert recall > 0.9
    assert {r.query_id: r.doc_id for r in found.where("rank = 1").collect()} == {i: i for i in range(30)}
    subset = spark.createDataFrame([(i,) for i in range(0, 200, 7)], "doc_id long")
    only = indexes.search(index, qs, indexes.SearchParameters(k=5), subset)
    assert {r.doc_id % 7 for r in only.collect()} == {0}
    less = indexes.without(index, spark.createDataFrame([(1,), (3,), (999,)], "doc_id long"))
    assert sorted(r.doc_id for r in less.docs.select("doc_id").collect()) == list(range(198))
    assert indexes.evict(index, 50).meta["documents"] == 50
    bigger, regime = indexes.update(index, frame(spark, data[:3]).withColumn("doc_id", F.col("doc_id") + 200), config=indexes.IndexConfig(start_from_scratch=10))
    assert regime == "buffer" and bigger.meta["documents"] == 203
    far = frame(spark, [unit(rng.normal(size=(6, 16))) for _ in range(120)]).withColumn("doc_id", F.col("doc_id") + 200)
    grown, regime = indexes.update(index, far, config=indexes.IndexConfig(start_from_scratch=10))
    assert regime == "expand" and len(grown.codec.centroids) > 40


def test_engine_cycle(spark, tmp_path):
    rng = np.random.default_rng(5)
    data = [unit(rng.normal(size=(4, 8))) for _ in range(30)]
    engine = Engine(spark, f"file://{tmp_path}/index")
    rows = metadata_rows.from_rows(spark, [{"name": f"unit {i}", "size": i, "lang": "Rust programming" if i % 2 else "Go concurrency"} for i in range(30)])
    assert engine.add(frame(spark, data), rows) == "create"
    first = engine.search(queries(spark, [data[4]]), parameters=indexes.SearchParameters(k=3, centroid_threshold=None)).collect()
    assert first[0].doc_id == 4 and first[0].size == 4
    assert {r.size % 2 for r in engine.search(text="rust", parameters=indexes.SearchParameters(k=50)).collect()} == {1}
    mixed = engine.search(queries(spark, [data[4]]), "concurrency", condition="size < ?", values=[10])
    assert mixed.count() > 0 and {r.size < 10 for r in mixed.collect()} == {True}
    assert engine.search(queries(spark, [data[4]]), "what is this?").count() > 0
    assert engine.delete("size >= ? AND size < ?", [0, 3]) == 3
    assert engine.count() == 27 and engine.metadata().first()["size"] == 3
    assert engine.delete_many([("doc_id = ?", [0]), ("doc_id = ?", [0])]) == 2
    assert engine.metadata().first()["size"] == 5
    assert engine.update_metadata("size = ?", [7], {"lang": "Zig"}) == 1
    assert engine.search(text="zig").collect()[0].size == 7
    engine.publish_text()
    assert engine.text_index().docs is None and engine.search(text="zig").collect()[0].size == 7
    engine.add(frame(spark, data[:2]), metadata_rows.from_rows(spark, [{"name": "new", "extra": 1.5}, {"name": "newer"}]))
    assert engine.count() == 27 and "extra" in engine.rows.columns
    assert Engine(spark, f"file://{tmp_path}/index").count() == 27


def test_predicates(spark):
    rows = spark.createDataFrame([("Abc", 1, None), ("xyz", 2, 3.5), (None, 3, 4.5)], "name string, n long, d double")
    count = lambda c, *v: where(rows, c, v).count()
    assert count("name LIKE ?", "abc") == 1 and count("name REGEXP ?", "abc") == 0 and count("name REGEXP ?", "(?i)abc") == 1
    assert count("n = ?", "2") == 1 and count("name = ?", 12) == 0 and count("NOT name = ?", "xyz") == 1
    assert count("d IS NULL OR (n > ? AND NAME NOT IN (?, ?))", 1, "a", "b") == 2
    assert count("n NOT BETWEEN ? AND ?", 2, 3) == 1 and count("1=1") == 3 and count("1=2") == 0
    assert count("n IN (?, ?, ?)", 1, 3, None) == 2 and count("n NOT IN (?, ?)", 1, None) == 0
    for bad in ("", "n = 1", "n = ? --", "n = ?; x", "NOT NOT n = ?", "drop = ?", '"select" = ?', "m = ?", "n = m", "(n = ?", "n LIKE", "n IN ()", "lower(n) = ?", "n = ? n = ?"):
        with pytest.raises(ConditionError):
            compile_condition(bad, [1], rows.schema)
    with pytest.raises(ConditionError):
        compile_condition("n = ?", [], rows.schema)


DOCS = ["alpha beta beta", "alpha gamma", "delta", "Éclair my_func handler_stack x", "handler x stack", "my func 10.5"]


def test_bm25_like_sqlite(spark):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(text, tokenize='unicode61')")
    con.executemany("insert into f(rowid, text) values (?, ?)", list(enumerate(DOCS, 1)))
    index = fulltext.build(spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string"))
    for query in ("beta", "alpha beta", "alpha OR delta", '"handler_stack"', "eclair", "alpha NOT beta", "(my OR delta) AND func", '"my func"', "handler stack"):
        want = {r - 1: -s for r, s in con.execute("select rowid, bm25(f) from f where f match ?", (query,))}
        got = {r.doc_id: r.score for r in fulltext.matches(index, query).collect()}
        assert got.keys() == want.keys(), query
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want), query
    for bad in ("what is this?", "(a", "AND", "a OR"):
        with pytest.raises(fulltext.QueryError):
            fulltext.matches(index, bad)


def test_tokenizers(spark):
    words = ["HandlerStack", "getHTTPResponse", "my_func", "simple", "my_FuncName", "A1b2", "__x__", "HTTP", "fooBAR9"]
    assert texts.split_identifier_py("PathPenalty") == "pathpenalty path penalty path_penalty".split()
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", texts.identifier_tokens(F.col("w")).alias("t")).collect()
    assert all(r.t == texts.identifier_tokens_py(r.w) for r in rows)
    tri = fulltext.build(spark.createDataFrame([(0, "parse_Arguments"), (1, "no"), (2, None)], "doc_id long, text string"), "trigram")
    assert [r.doc_id for r in fulltext.matches(tri, '"arg"').collect()] == [0] and fulltext.matches(tri, '"ar"').count() == 0
    assert texts.all_words_query('what (is) AND "this"?') == '"what" "is" "this"'
    assert texts.json_text({"b": [1, True], "a": {"x": "y"}}) == "y 1 true"


def test_text_index_on_disk(spark, tmp_path):
    index = fulltext.build(spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string"))
    index.save(f"file://{tmp_path}/fts", buckets=4)
    again = fulltext.load(spark, f"file://{tmp_path}/fts")
    assert {r.doc_id: r.score for r in fulltext.matches(again, "alpha beta").collect()} == {r.doc_id: r.score for r in fulltext.matches(index, "alpha beta").collect()}


def test_fusion_by_hand(spark):
    a = spark.createDataFrame([(0, 1, 10, 2.0), (0, 2, 11, 2.0)], "query_id long, rank int, doc_id long, score double")
    b = spark.createDataFrame([(0, 1, 11, 5.0), (0, 2, 12, 1.0)], "query_id long, rank int, doc_id long, score double")
    got = {r.doc_id: r.score for r in fusion.reciprocal_rank(a, b).collect()}
    assert got == pytest.approx({10: 0.75 / 61, 11: 0.75 / 62 + 0.25 / 61, 12: 0.25 / 62})
    assert {r.doc_id: r.score for r in fusion.relative_score(a, b).collect()} == pytest.approx({10: 0.75, 11: 1.0, 12: 0.0})
    with pytest.raises(ValueError):
        fusion.reciprocal_rank(a, b, alpha=2)


def test_metadata_rows(spark):
    rows = metadata_rows.from_rows(spark, [{"a": 1, "b": None}, {"b": "x", "c": True}, {}])
    assert rows.dtypes == [("doc_id", "bigint"), ("a", "bigint"), ("b", "string"), ("c", "bigint")]
    with pytest.raises(ValueError):
        metadata_rows.from_rows(spark, [{"a b": 1}])
    ids = spark.createDataFrame([(2, 0), (0, 1), (2, 2), (9, 3)], "doc_id long, pos int")
    assert [r.doc_id for r in metadata.get_by_ids(rows, ids).collect()] == [2, 0]
    left = metadata.delete(rows, spark.createDataFrame([(1,)], "doc_id long"))
    assert sorted(r.doc_id for r in left.collect()) == [0, 1]
    gone = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 20, 65535, 65536)], "doc_id long")
    assert sorted(map(tuple, metadata.gap_ranges(gone).collect())) == [(1, 3, 3), (7, 8, 2), (20, 20, 1), (65535, 65536, 2)]


def test_patterns(spark):
    assert patterns.expand_braces("a.{x,y}") == ["a.x", "a.y"] and patterns.expand_braces("a{b") == ["a{b"]
    assert patterns.basic_to_extended(r"\(a\|b\)\{2\}\+") == r"(a|b){2}\+" and patterns.basic_to_extended(r"\(a") == r"\(a"
    assert patterns.literal_braces("a{2}{x}[{]") == "a{2}[{]x[}][{]"
    rows = spark.createDataFrame([("src/a.rs",), ("src/sub/b.py",), ("tests/x.py",), ("vendor/y/z.py",)], "p string")
    keep = lambda c: sorted(r.p for r in rows.where(c).collect())
    p = F.col("p")
    assert keep(patterns.included(p, ["*.{rs,py}"])) == sorted(r.p for r in rows.collect())
    assert keep(patterns.included(p, ["src/**/*.py"])) == ["src/sub/b.py"]
    assert keep(patterns.not_excluded(p, ["*.py"])) == ["src/a.rs"]
    assert keep(patterns.outside(p, ["vendor", "test*"])) == ["src/a.rs", "src/sub/b.py"]
    assert patterns.merged_query("find it", r"foo\s+(bar|it)") == "find it foo bar"


def test_ranking(spark):
    paths = {"compat/foo_test.py": 0.09, "a/b.py": 1.0, "pkg/__init__.py": 0.5, "x.d.ts": 0.7, "tests.rs": 0.3, "docs_src/FooSpec.kt": 0.09, "src/latest.py": 1.0}
    rows = spark.createDataFrame([(k,) for k in paths], "file string").select("file", ranking.path_penalty(F.col("file")).alias("p")).collect()
    assert {r.file: round(r.p, 6) for r in rows} == paths
    units_ = spark.createDataFrame([(0, 1, "a/handler_stack.py", "run", "function", 1, 5, 1.0), (0, 2, "a/other.py", "HandlerStack", "class", 1, 9, 0.9), (0, 3, "a/other.py", "raw_code_9", "rawcode", 20, 30, 0.8)], "query_id int, unit_id int, file string, name string, unit_type string, line int, end_line int, score double")
    assert {r.unit_id: round(r.score, 6) for r in ranking.definition_boost(units_, "handler stack").collect()} == {1: 1.0, 2: 0.9, 3: 0.8}
    assert {r.unit_id: round(r.score, 6) for r in ranking.definition_boost(units_, "HandlerStack").collect()} == {1: 1.0, 2: 1.15, 3: 0.8}
    assert {r.unit_id: round(r.score, 6) for r in ranking.stem_boost(units_, "handlers").collect()} == {1: 1.4, 2: 0.9, 3: 0.8}
    assert [(r.file, r.line, r.end_line) for r in ranking.reranked(units_, "the handler stack").collect()][1] == ("a/other.py", 1, 30)
    assert ranking.representative_lines("x\ndef handler():\n  pass\nhandler stack\n", "handler stack") == [1, 3]


SOURCE = '''import os
from json import loads

LIMIT = 3

@decorated
def outer(a, *rest, b=1) -> int:
    """Says what."""
    for x in rest:
        if x:
            os.remove(x)
    return loads(a)

class Thing(Base):
    def method(self):
        try:
            return outer(1)
        except ValueError:
            raise

print(LIMIT)
'''


def test_units(spark):
    got = {u["name"]: u for u in units.python_units("m.py", SOURCE)}
    assert set(got) == {"LIMIT", "outer", "Thing", "method", "raw_code_1", "raw_code_21"}
    f = got["outer"]
    assert (f["line"], f["complexity"], f["calls"], f["parameters"], f["return_type"], f["docstring"]) == (6, 3, ["loads", "remove"], ["a", "rest", "b"], "int", "Says what.")
    assert got["method"]["qualified_name"] == "m.py::Thing::method" and got["method"]["has_error_handling"] and got["Thing"]["extends"] == "Base"
    files = spark.createDataFrame([("m.py", SOURCE), ("r.md", "\n# Title\nbody\n"), ("e.txt", " "), ("n.py", None), ("x.rs", "fn a() {}\n")], "file string, source string")
    rows = units.units(files)
    assert rows.where("file = 'm.py'").count() == 6 and rows.where("file = 'e.txt'").count() == 0
    assert {r.name: r.called_by for r in units.call_graph(rows).collect()} == {"outer": ["method"]}
    assert rows.where("name = 'outer'").select(units.embedding_text().alias("t")).first().t.startswith("Function outer\nSignature: def outer")
    assert units.merged_units(rows).where("file = 'm.py'").first().has_loops


def test_pooling_and_metrics(spark):
    e = np.array([[1.0, 0], [1, 0.01], [0, 1], [0.01, 1], [1, 0.02]])
    labels = pooling.clusters(pooling.linkage(pooling.cosine_distances(e)), 5, most=2)
    assert labels.tolist() == [1, 1, 2, 2, 1]
    assert pooling.pool(e, 2).shape == (3, 2) and pooling.cosine_distances(np.array([[0.0, 0], [1, 0]]))[0, 1] == 1
    for method in "weighted average complete single".split():
        assert len(pooling.linkage(pooling.cosine_distances(e), method)) == 4
    run = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (0, 3, 7)], "query_id long, rank int, doc_id long")
    qrels = spark.createDataFrame([(0, 5, 1), (0, 7, 1), (0, 9, 1), (1, 1, 1)], "query_id long, doc_id long, rel int")
    got = {r.query_id: r for r in metrics.evaluate(run, qrels).collect()}
    assert got[0].average_precision == pytest.approx((1 + 2 / 3) / 3) and got[0].recall == pytest.approx(2 / 3) and got[1].ndcg == 0


def test_sources(spark, tmp_path):
    m = np.arange(12, dtype=np.float16).reshape(4, 3)
    (tmp_path / "a.npy").write_bytes(vector_files.write_npy(m))
    assert vector_files.npy_header(vector_files.write_npy(m))["shape"] == (4, 3)
    rows = vector_files.read_npy(spark, f"file://{tmp_path}")
    assert rows.count() == 4
    docs = vector_files.documents(rows.select("row", "values"), spark.createDataFrame([(0, 1), (1, 3)], "doc_id long, n long"))
    assert {r.doc_id: len(r.embs) for r in docs.collect()} == {0: 1, 1: 3}
    text, (n, dim) = vector_files.encode_base64(m.astype(np.float32))
    back = vector_files.decode_base64(spark.createDataFrame([(text, n, dim)], "data string, n int, dim int")).first().embs
    assert back[3] == [9.0, 10.0, 11.0]
    bad = base64.b64encode(np.array([np.nan], "<f4").tobytes()).decode()
    with pytest.raises(Exception, match="not finite"):
        vector_files.decode_base64(spark.createDataFrame([(bad, 1, 1)], "data string, n int, dim int")).collect()
    tree = tmp_path / "tree"
    for name, body in {"src/a.py": "x = 1\n", "node_modules/b.js": "1", ".hidden/c.py": "1", "d.unknown": "1", "gen/e.py": "1", ".github/f.yml": "a: 1"}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(body)
    assert sorted(r.file for r in projects.scan(spark, f"file://{tree}", gitignore="gen/\n").collect()) == [".github/f.yml", "src/a.py"]


def test_stream_into_index(spark, tmp_path):
    from polyvec.streaming.ingest import deletions, ingest

    rng = np.random.default_rng(1)
    engine = Engine(spark, f"file://{tmp_path}/index")
    for part in range(2):
        frame(spark, [unit(rng.normal(size=(3, 8))) for _ in range(12)]).withColumn("tag", F.lit(f"t{part}")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = "doc_id long, embs array<array<double>>, tag string"
    seen = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest(stream, engine, f"{tmp_path}/cp", done=lambda n, regime: seen.append(regime)).trigger(availableNow=True).start().awaitTermination()
    assert engine.count() == 24 and seen[0] == "create" and len(seen) == 2 and engine.info()["last_batch"] == 1
    spark.createDataFrame([(0, "tag = ?", ["t0"])], "n int, condition string, values array<string>").coalesce(1).write.parquet(f"{tmp_path}/del")
    gone = spark.readStream.schema("n int, condition string, values array<string>").parquet(f"{tmp_path}/del")
    deletions(gone, engine, f"{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination()
    assert engine.count() == 12


def test_positions_after_deletes(spark):
    """Stored ids and positions by bitmaps, against counting; ids at the edges of bytes and blocks."""
    from polyvec.operators import ids

    n = 3 * ids.BLOCK + 100
    gone = {0, 7, 8, 9, ids.BLOCK - 1, 2 * ids.BLOCK, 2 * ids.BLOCK + 15, n - 1}
    dead = ids.blocks(spark.createDataFrame([(i,) for i in [*gone, 7]], "doc_id long"), n)
    rows = spark.range(n).selectExpr("id as doc_id", "id as was")
    got = {r.was: r.doc_id for r in ids.placed(rows, dead).collect()}
    assert got == {x: i for i, x in enumerate(x for x in range(n) if x not in gone)}
    assert {r.doc_id for r in ids.alive(rows, dead).collect()} == got.keys()


def test_kmeans_against_naive(spark):
    """Rounds over tasks give what rounds over one matrix give, empty centroids aside."""
    rng = np.random.default_rng(5)
    centers = unit(rng.normal(size=(6, 8)))
    vectors = unit(centers[rng.integers(0, 6, 400)] + 0.2 * rng.normal(size=(400, 8)))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "h long, v array<double>").repartition(3)
    want = vectors[:6].copy()
    for _ in range(4):
        code = (vectors @ want.T).argmax(axis=1)
        want = np.array([vectors[code == c].mean(axis=0) if (code == c).any() else np.nan * want[c] for c in range(6)])
    got = kmeans.lloyd(points, 6)
    assert np.allclose(got, unit(want), atol=1e-9)
    assert len(kmeans.lloyd(points.limit(3), 6)) == 3 and kmeans.first_points(points, 5).shape == (5, 8)


def test_best_cells_in_blocks():
    rng = np.random.default_rng(6)
    q, book = rng.normal(size=(5, 4)), rng.normal(size=(300, 4))
    allowed = np.sort(rng.choice(300, 200, replace=False))
    products = q @ book[allowed].T
    want = np.unique(np.argsort(-products, axis=1)[:, :7])
    for threshold in (None, 1.5):
        own = want if threshold is None else want[products[:, want].max(axis=0) >= threshold]
        for block in (3, 64, 1000):
            assert indexes.best_cells(q, book, allowed, 7, threshold, block).tolist() == allowed[own].tolist()


def test_engine_restart_and_redelivery(spark, tmp_path):
    """What was buffered stays so in a new engine; batches that come again change nothing; an append after a
    flush writes only its own segments; ids with gaps keep rows and vectors together."""
    from polyvec.streaming.ingest import apply_deletions

    rng = np.random.default_rng(6)
    data = [unit(rng.normal(size=(3, 8))) for _ in range(60)]
    config = indexes.IndexConfig(start_from_scratch=10, buffer_size=20)
    rows = lambda ids: spark.createDataFrame([(i, i, f"word{i} common") for i in ids], "doc_id long, key long, text string")
    docs = lambda ids: spark.createDataFrame([(i, data[i].tolist()) for i in ids], "doc_id long, embs array<array<double>>")
    at = f"file://{tmp_path}/index"
    engine = Engine(spark, at, config)
    odd = list(range(1, 60, 2))
    assert engine.add(docs(odd[:15]), rows(odd[:15])) == "create"
    engine.publish_text()
    assert engine.add(docs(odd[15:25]), rows(odd[15:25])) == "buffer"
    with pytest.raises(ValueError):
        engine.add(docs([2]), rows([4]))
    again = Engine(spark, at, config)
    assert again.info()["buffered"] == 10 and again.info()["threshold"] > 0
    before = again.manifest["tables"]
    assert again.add(docs(odd[25:]), rows(odd[25:])) == "buffer" and again.info()["buffered"] == 15
    assert again.add(docs(range(0, 12, 2)), rows(range(0, 12, 2))) == "expand" and again.info()["buffered"] == 0
    kept = again.manifest["tables"]
    assert kept["codes"][0] == before["codes"][0] and kept["docs"][: len(before["docs"])] == before["docs"] and not set(before["codes"][1:]) & set(kept["codes"])
    assert again.add(docs([14]), rows([14])) == "buffer" and again.manifest["tables"]["codes"][:-1] == kept["codes"]
    order = [*odd, *range(0, 12, 2), 14]
    assert [r.key for r in again.metadata().collect()] == order
    found = again.search(queries(spark, [data[i] for i in order]), parameters=indexes.SearchParameters(k=1), exact=True)
    assert [r.key for r in found.orderBy("query_id").collect()] == order
    assert again.search(text="word14").first().key == 14 and again.search(text="common", parameters=indexes.SearchParameters(k=99)).count() == len(order)
    batch = spark.createDataFrame([(0, "doc_id = ?", ["0"]), (1, "doc_id < ?", ["2"])], "n int, condition string, values array<string>")
    assert apply_deletions(again, batch, 4) == 3 and apply_deletions(again, batch, 4) == 0
    assert again.count() == len(order) - 3 and again.metadata().first()["key"] == 7 and again.info()["deleted"] == 3
    assert again.keywords({0: "word9, (common)?", 1: "nothing word11!"}, words="all").select("query_id").collect()[0][0] == 0 and again.keywords({1: "nothing or word11!"}, words="any").count() == 1
    assert again.search(text="word1").count() == 0 and again.search(text="word7").first().doc_id == 0
    assert again.delete("key > ?", [20]) > 10 and again.info()["deleted"] == 0  # so many that it was compacted
    assert again.search(text="common", parameters=indexes.SearchParameters(k=99)).count() == again.count()
    copy = again.clone(f"file://{tmp_path}/copy")
    assert copy.delete("1=1") == again.count() and again.count() > 0 and copy.count() == 0 and copy.search(text="common").count() == 0


def test_patterns_of_the_jvm(spark):
    """What the JVM does not take as an expression counts literally."""
    rows = spark.createDataFrame([("x (?P<a>b) y",), ("ab",)], "t string")
    assert [r.t for r in rows.where(patterns.text_matches(F.col("t"), "(?P<a>b)")).collect()] == ["x (?P<a>b) y"]
    assert rows.where(patterns.text_matches(F.col("t"), "a(?=b)")).count() == 1


def test_phrases_counted_in_texts(spark):
    """Counting by expressions is counting tokens, on texts with marks, ligatures and odd case."""
    import random

    rng = random.Random(4)
    docs = ["".join(rng.choice(["a", "B", "b", "á", "a\u0301", "Ç", "ß", "_", " ", " ", ".", "é", "1", "Ж", "ж", "\u0301"]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    index = fulltext.build(rows)
    written = fulltext.TextIndex("unicode61", index.postings, index.doc_stats, index.totals)
    for query in ("a", "b", "ab", '"a b"', '"a a"', "ж", "c OR e", "a NOT b", '"b a" OR 1'):
        one, two = ({r.doc_id: round(r.score, 9) for r in fulltext.matches(x, query).collect()} for x in (index, written))
        assert one == two, query


def test_encoding_takes_little_memory():
    """Blocks of rows and of centroids bound what a task holds; the codes are those of whole products."""
    import tracemalloc

    rng = np.random.default_rng(5)
    e, book = rng.normal(size=(40_000, 16)), unit(rng.normal(size=(900, 16)))
    book[899] = book[3]
    book[20] = 0
    own = codec.Codec(4, book, np.linspace(-1, 1, 15), np.zeros(16), np.zeros(16), 0.0)
    tracemalloc.start()
    codes, packed = own.encode(e)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20
    want = 899 - (e[:2000] @ book.T)[:, ::-1].argmax(axis=1)
    assert (codes[:2000] == want).all() and packed.shape == (40_000, 8)
    wide = unit(rng.normal(size=(40_000, 4)))
    wide[39_999] = wide[7]
    assert codec.assign(wide[7:8], wide).tolist() == [39_999]
    assert codec.assign(np.full((1, 4), np.nan), wide).tolist() == [39_999]


def test_call_graph_makes_its_units_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("a", ["b", "x", "b"]), ("b", ["a", None]), ("c", ["b"]), ("d", None), (None, ["d"]), ("c", [])], "name string, calls array<string>").mapInArrow(run, "name string, calls array<string>")
    got = units.call_graph(rows).collect()
    assert sorted((r.name, r.called_by) for r in got) == [("a", ["b"]), ("b", ["a", "c"]), ("d", [])]
    assert made.value == 6
