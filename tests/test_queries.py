"""Every registered query runs, and equals its SQL on the smallest tables."""

import pytest
from conftest import rows_of

import polyvec.catalog as catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, small, name):
    got = catalog.queries()[name](spark, small).toPandas()
    if name not in SQL:
        assert len(got.columns)
        return
    want = duck.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_pruned_search_recall(spark, small):
    """Every query has its ten rows, and at least 0.9 of the exact ones."""
    run = {n: {(r.query_id, r.doc_id) for r in catalog.queries()[n](spark, small).collect()} for n in ("pruned_search", "maxsim_topk")}
    assert len(run["pruned_search"]) == len(run["maxsim_topk"])
    assert len(run["pruned_search"] & run["maxsim_topk"]) >= 0.9 * len(run["maxsim_topk"])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _with_embeddings(folder, small, condition):
    """The small tables with some of the embeddings, and a DuckDB over them."""
    import os

    import duckdb

    con = duckdb.connect()
    for file in os.listdir(small):
        if file != "embeddings.parquet":
            os.symlink(f"{small}/{file}", f"{folder}/{file}")
    con.sql(f"copy (select * from '{small}/embeddings.parquet' where {condition}) to '{folder}/embeddings.parquet' (format parquet)")
    for file in os.listdir(folder):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{folder}/{file}'")
    return str(folder), con


@pytest.mark.parametrize("last", [496, 497, 498, 499])
def test_ward_pool_with_a_short_document(spark, small, tmp_path, last):
    """The last document has one to four vectors."""
    folder, con = _with_embeddings(tmp_path, small, f"vec_id < {last}")
    got, want = catalog.queries()["ward_pool"](spark, folder).toPandas(), con.sql(SQL["ward_pool"]).df()
    assert rows_of(got, sorted(got.columns)) == rows_of(want, sorted(got.columns))


def test_a_file_is_written_from_many_tasks(spark, small):
    """The rows of a stream's file are aggregated and joined before the exchange to the task that writes."""
    from polyvec.plans import base, engine_queries

    plan = engine_queries._one_file(base.docs(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan and plan.index("Exchange SinglePartition") < plan.index("Aggregate")
