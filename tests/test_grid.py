"""Late interaction in a grid of tasks: every pair, ties, and ranks, against brute force."""

import numpy as np
import pytest

import polyvec.operators.maxsim as maxsim
import polyvec.operators.metrics as metrics


def _case(spark, copies=1):
    rng = np.random.default_rng(11)
    docs = [rng.integers(-2, 3, (int(rng.integers(0, 7)), 8)).astype(float) for _ in range(90)] * copies
    qs = [rng.integers(-2, 3, (int(rng.integers(1, 5)), 8)).astype(float) for _ in range(40)]
    table = spark.createDataFrame([(i, d.tolist()) for i, d in enumerate(docs)], "doc_id long, embs array<array<double>>").repartition(5)
    asked = spark.createDataFrame([(i, j, v.tolist()) for i, q in enumerate(qs) for j, v in enumerate(q)], "query_id long, qpos int, qvec array<double>").repartition(3)
    want = np.array([[sum((d @ v).max() for v in q) if len(d) else 0.0 for d in docs] for q in qs])
    return table, asked, want


def _ranks(want, k):
    return [(q, r + 1, int(d), want[q, d]) for q in range(len(want)) for r, d in enumerate(np.lexsort((np.arange(want.shape[1]), -want[q]))[:k])]


@pytest.mark.parametrize("small", [1 << 20, 0])
@pytest.mark.parametrize("copies", [1, 8])
def test_best_of_equal_scores(spark, monkeypatch, small, copies):
    """Whole numbers give many equal scores, and repeated documents more than any margin: of equal ones the
    lowest ids, whether the queries go to every task or are dealt out."""
    monkeypatch.setattr(maxsim, "SMALL", small)
    monkeypatch.setattr(maxsim, "HELD", 256)
    docs, queries, want = _case(spark, copies)
    for digits in (None, 6):
        got = maxsim.maxsim_topk(docs, queries, 4, digits=digits).collect()
        assert sorted((r.query_id, r.rank, r.doc_id, r.score) for r in got) == _ranks(want, 4)


def test_every_pair_without_a_shuffle_of_scores(spark):
    docs, queries, want = _case(spark)
    tokens = docs.selectExpr("doc_id", "posexplode(embs) as (pos, emb)")
    scored = maxsim.maxsim_scores(tokens, queries)
    assert "CartesianProduct" not in (plan := scored._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in plan
    some = {r.doc_id for r in tokens.select("doc_id").distinct().collect()}
    assert sorted((r.query_id, r.doc_id, r.score) for r in scored.collect()) == [(q, d, want[q, d]) for q in range(len(want)) for d in range(want.shape[1]) if d in some]


@pytest.mark.parametrize("whole", [32 << 20, 500, 10])
def test_every_rank(spark, monkeypatch, whole):
    """All documents ranked in the tasks; above WHOLE of them by a window."""
    monkeypatch.setattr(maxsim, "WHOLE", whole)
    docs, queries, want = _case(spark)
    got = maxsim.rerank(docs, queries, digits=6)
    assert ("Window" in got._jdf.queryExecution().toString()) == (whole == 10)
    assert sorted((r.query_id, r.rank, r.doc_id, r.score) for r in got.collect()) == _ranks(want, None)


def test_a_task_keeps_k_rows_of_a_query():
    """However many blocks go by, not k of each block."""
    best = maxsim.Best(3, 2)
    for i in range(50):
        best.take(np.arange(i * 4, i * 4 + 4), np.arange(12.0).reshape(4, 3) + (i % 7))
    column, ids, score = best.rows()
    assert column.tolist() == [0, 0, 1, 1, 2, 2] and ids.tolist() == [27, 55] * 3
    nothing = maxsim.Best(1, 2)
    nothing.take(np.arange(3), np.array([[np.nan], [1.0], [np.inf]]))
    assert nothing.rows()[1].tolist() == [1, 0]


def test_metrics_of_common_documents(spark):
    """As with a row for each query and relevant document, which are not made; without relevant ones, zeros."""
    run = spark.createDataFrame([(q, r, (q * 3 + r * r) % 17) for q in range(9) for r in range(1, 8)], "query_id long, rank int, doc_id long")
    relevant = spark.createDataFrame([(d, d % 4) for d in range(14)], "doc_id long, rel int")
    asked = run.select("query_id")
    for k in (3, 7):
        got = metrics.evaluate_common(run, asked, relevant, k)
        assert "NestedLoopJoin" not in got._jdf.queryExecution().optimizedPlan().toString()
        want = metrics.evaluate(run, asked.distinct().crossJoin(relevant), k)
        round_off = lambda rows: sorted(tuple(round(x, 9) for x in r) for r in rows.collect())
        assert round_off(got) == round_off(want) and got.count() == 9
    assert {tuple(r)[1:] for r in metrics.evaluate_common(run, asked, relevant.where("rel > 9"), 3).collect()} == {(0.0, 0.0, 0.0)}


def test_exact_search_rounds_before_it_ranks(spark):
    """Documents that are equal but for the last digits are in the order of their ids, however many there are."""
    import polyvec.operators.index as indexes
    from polyvec.operators.codec import Codec

    docs = spark.createDataFrame([(i, [[1.0 + (i % 7) * 1e-9, 0.0]]) for i in range(60)], "doc_id long, embs array<array<double>>").repartition(4)
    asked = spark.createDataFrame([(0, 0, [1.0, 0.0])], "query_id long, qpos int, qvec array<double>")
    index = indexes.create(docs, codec=Codec(4, np.eye(2), np.linspace(-1, 1, 15), np.zeros(16), np.zeros(2), 0.0))
    assert [r.doc_id for r in indexes.exact_search(index, asked, 10, digits=6).orderBy("rank").collect()] == list(range(10))


@pytest.mark.parametrize("coded", [64 << 20, 3000])
@pytest.mark.parametrize("digits", [None, 6])
def test_pruned_search_in_a_grid(spark, monkeypatch, coded, digits):
    """As by lists, whether a task has all documents or a share of them: cuts, subsets, deleted documents, ties."""
    import polyvec.operators.ids as places
    import polyvec.operators.index as indexes
    from polyvec.operators.codec import Codec

    rng = np.random.default_rng(8)
    data = [rng.normal(size=(int(rng.integers(0, 6)), 8)).round(1) for _ in range(70)] * 3
    docs = spark.createDataFrame([(i, d.tolist()) for i, d in enumerate(data)], "doc_id long, embs array<array<double>>").repartition(4)
    asked = spark.createDataFrame([(i, j, v.tolist()) for i, d in enumerate(data[:30]) for j, v in enumerate(d)], "query_id long, qpos int, qvec array<double>")
    book = rng.normal(size=(12, 8))
    index = indexes.create(docs, codec=Codec(4, book, np.linspace(-1, 1, 15), np.linspace(-1, 1, 16), np.zeros(8), 0.0))
    gone = places.blocks(spark.range(0, 210, 11).withColumnRenamed("id", "doc_id"), 210)
    subset = spark.range(0, 190, 3).withColumnRenamed("id", "doc_id")
    own = indexes.VectorIndex(index.codec, index.docs, index.codes, index.ivf, index.meta, gone)
    monkeypatch.setattr(indexes, "CODED", coded)
    for parameters in (indexes.SearchParameters(6, 2, 80, None, digits), indexes.SearchParameters(6, 3, 4096, 0.4, digits)):
        for chosen in (None, subset):
            runs = []
            for few in (1 << 20, 0):
                monkeypatch.setattr(indexes, "FEW", few)
                runs.append(sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in indexes.search(own, asked, parameters, chosen).collect()))
            assert runs[0] and runs[0] == runs[1]
    cells = indexes.probe(own, asked, parameters).toArrow()
    pairs = indexes.rough_scores(own, own.codes, indexes.candidates(own, own.ivf, cells), asked)
    grid = indexes.rough_candidates(own, own.codes, indexes.probed(own, asked, parameters))
    rows = lambda t: sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in t.collect())
    assert rows(pairs) and rows(pairs) == rows(grid)


def test_pruned_search_of_equal_rounded_scores(spark, small, monkeypatch):
    """The registered searches are the same by lists and in a grid."""
    import polyvec.catalog as catalog
    import polyvec.operators.index as indexes

    runs = []
    for few in (1 << 30, 0):
        monkeypatch.setattr(indexes, "FEW", few)
        runs.append([sorted(map(tuple, catalog.queries()[n](spark, small).collect())) for n in ("pruned_search", "pruned_search_filtered")])
    assert runs[0] == runs[1]
