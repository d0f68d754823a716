"""The catalogue against DuckDB on the smallest tables (every third query, and one of each kind)."""

import datetime as dt
import math
import os

import duckdb
import pytest

from lineaframe import catalogue, services

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.QUERIES | services.QUERIES, catalogue.ORACLES | services.ORACLES
NAMES = sorted(QUERIES)
CHOSEN = sorted({*NAMES[::4], "cmp_int_decimal_exact", "agg_p28", "sort_multi_nulls", "contrib_median", "exclude_rows", "clean_rows", "trace_back_counts", "q_wait",
                 "engine_exclude", "engine_trace_limit", "engine_problems", "clean_rule_counts", "clean_all_rows", "flatten_issues", "snapshot_round_trip"})

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("events", "orders", "lineitem", "customer", "part", "documents", "embeddings", "nation"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, dt.datetime):
        return x.isoformat()
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and not set(catalogue.QUERIES) & set(services.QUERIES)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_oracle(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in found.collect()]
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
