"""Queries of the services against DuckDB on tables with more rows than the smallest ones have."""

import duckdb
import pytest

from lineaframe import services


@pytest.fixture
def against_sql(spark, tmp_path):
    """Whether a query equals its SQL on tables given as DuckDB SQL."""

    def equal(name, **tables):
        duck = duckdb.connect()
        for table, sql in tables.items():
            path = tmp_path / f"{table}.parquet"
            duck.execute(f"COPY ({sql}) TO '{path}' (FORMAT parquet)")
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
        found = services.QUERIES[name](spark, str(tmp_path))
        wanted = duck.execute(services.ORACLES[name])
        columns = [d[0] for d in wanted.description]
        assert sorted(columns) == sorted(found.columns)
        return sorted(map(tuple, found.select(*[f"`{c}`" for c in columns]).collect()), key=repr) == sorted(wanted.fetchall(), key=repr)

    return equal


def test_cells_of_a_table_whose_later_rows_would_overflow(against_sql):
    assert against_sql("engine_cells", embeddings="SELECT range AS vec_id, 0 AS label, [(range / 7)::FLOAT, (-range)::FLOAT] AS embedding FROM range(9300)")


#: Requests from 2024 to 2037, as tables of over 26,304 documents have them.
MANY = "SELECT range * 97 AS doc_id FROM range(600)"


def test_requests_of_any_year_are_cleaned(against_sql):
    assert against_sql("clean_westchester", documents=MANY)


def test_no_requests_are_cleaned(against_sql):
    assert against_sql("clean_westchester", documents=f"{MANY} WHERE false")


def test_requests_of_any_year_are_fetched(against_sql):
    assert against_sql("seeclickfix_fetch", documents=MANY)


@pytest.mark.parametrize("n", [1, 100, 101])
def test_pages_that_are_full_or_not(against_sql, n):
    assert against_sql("seeclickfix_fetch", documents=f"{MANY} LIMIT {n}")
