"""Every query with SQL against DuckDB on the smallest tables; the others against plain Python."""

import math

import duckdb
import pytest

from mosaicq.plans import catalog, readout  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    a = sorted(repr([canon(r[c]) for c in columns]) for r in got.collect())
    b = sorted(repr([canon(r[i]) for i in at]) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_plans_stay_in_the_jvm(spark, sf_dir):
    for name in ("crosstalk_scale_sum", "ratio_simplex_project", "radius_pairs", "nearest_neighbor_radius", "expression_matrix"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name


def test_neighbours_are_ranked_from_k_rows_a_block(spark, sf_dir):
    """The blocks' product runs on Arrow tables; only its k rows a row and block are shuffled to be ranked."""
    plan = catalog.QUERIES["knn_k"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan and "WindowGroupLimit" in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalog.QUERIES["group_size_filter"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan and "o_totalprice" not in plan
