"""Every registered query against its SQL, and what its plan must not hold."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "events", "pages", "embeddings", "conversations")
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr([_plain(r[i]) for i in at]) for r in result.fetchall())


LAZY = sorted(n for n in set(ORACLES) - {"core_distances", "standardised_vectors", "saved_posts", "saved_comments", "json_posts", "csv_posts", "csv_comments", "full_density_labels", "full_density_sweep"} if not n.startswith("op"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_query_forms_a_product_or_calls_python(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    for node in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas"):
        assert node not in plan


@pytest.mark.parametrize("name", ["kept_posts", "top_comment_ranks", "post_comments", "keyword_ranks", "author_ranks", "sample_text", "sample_posts", "new_comments"])
def test_group_limits_run_before_the_shuffle(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_narrow_queries_read_narrow(spark):
    plan = _plan(QUERIES["cluster_count"](spark, SF))
    assert "ReadSchema: struct<label:int>" in plan
    plan = _plan(QUERIES["flagged_users"](spark, SF))
    assert "text" not in plan.split("ReadSchema", 1)[1]


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["cluster_label", "size", "burst", "concentrated", "flagged"]
    assert df.count() > 0
