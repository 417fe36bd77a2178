"""Registered queries against their SQL on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from factengine.plans import catalogue

SF = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()
SAMPLE = ("value_percent", "period_day", "fiscal_calendar_vote", "pair_deterministic_number", "pair_semantic_topk", "pair_union_paths", "settle", "orient_edges", "lines_explode", "context_gate", "table_reconstruct", "page_priority", "salience", "edges_upsert", "cases", "reuse_decision")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def test_every_query_is_a_function_and_flagship_runs(spark):
    assert len(catalogue.queries()) >= 80 and set(SQL) <= set(catalogue.queries())
    assert catalogue.flagship(spark, SF).count() >= 1


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    rel = duck.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = Counter(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in rel.fetchall())
    assert got == want
