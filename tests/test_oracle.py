"""Every registered query against its DuckDB equivalent on the smallest data."""

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of(columns, data):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(str([plain(r[i]) for i in at]) for r in data)


def compare(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, got.fetchall())


@pytest.mark.parametrize("name", CORE)
def test_matches(spark, duck, name):
    compare(spark, duck, name)


def test_every_core_query_has_an_oracle():
    assert {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"} == set(CORE)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name,has",
    [
        ("frontier_top", "TakeOrderedAndProject"),
        ("dedup_in_page", "WindowGroupLimit"),
        ("anti_discovered", "LeftAnti"),
        ("score_join", "LeftOuter"),
        ("url_resolve", "Project"),
        ("page_text", "Project"),
        ("element_resolve", "Join"),
        ("products_from_verify", "Join"),
    ],
)
def test_plans(spark, name, has):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert has in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name in ("url_resolve", "page_text"):
        assert "Exchange" not in plan and "Python" not in plan
