"""Every registered query against its SQL in DuckDB, on the small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessera.plans import catalogue


# These join rows by row_id, of which the smallest tables repeat some.
UNIQUE_ROWS = {"gbdt_one_tree", "forest_one_tree", "gbdt_three_rounds", "gbdt_round_metrics", "gbdt_node_budget", "deep_forest_score", "nb_model_round_trip"}


def views(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{folder}/{name}'")
    return con


@pytest.fixture(scope="module")
def duck(sf_dir):
    return {False: (sf_dir, views(sf_dir)), True: ("/root/testdata/sf0.01", views("/root/testdata/sf0.01"))}


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False):
        out.append(tuple(None if x != x else round(float(x), 3) + 0.0 if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "if" else str(x) for x in row))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    folder, con = duck[name in UNIQUE_ROWS]
    got = rows(catalogue.QUERIES[name](spark, folder).toPandas())
    want = rows(con.sql(catalogue.ORACLES[name]).df())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 0.002 for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
