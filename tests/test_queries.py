import os

import duckdb
import pytest

from quaestor import plans

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def sorted_rows(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, con, name):
    got, want = plans.QUERIES[name](spark, FOLDER), con.sql(plans.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted_rows(got.collect(), got.columns) == sorted_rows(want.fetchall(), want.columns)


def test_matching_by_brute_force(spark):
    from quaestor.operators.search import tag_cover

    edges = [("p", t, i) for t, i in [("a", 1), ("a", 2), ("b", 1), ("c", 2), ("c", 3), ("d", 3)]] + [("q", "a", 1), ("q", "b", 1)]
    got = tag_cover(spark.createDataFrame(edges, "profile string, tag string, item long"), "profile", "tag", "item").collect()
    p = [(r.tag, r.item) for r in got if r.profile == "p"]
    assert len(p) == 3 and len({t for t, _ in p}) == len({i for _, i in p}) == 3 and {("p", *x) for x in p} <= set(edges)
    assert sum(r.profile == "q" for r in got) == 1


def test_plans_push_down(spark):
    plan = plans.QUERIES["pricing_summary"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan and "l_comment" not in plan
