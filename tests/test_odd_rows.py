"""Queries against their SQL on rows that the test data lacks."""

import duckdb
import pytest

from marlstone.plans import registry


def compared(spark, tmp_path, name, table, sql):
    """The query's rows and the SQL's, over one table made by SQL."""
    c = duckdb.connect()
    c.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = c.execute(registry.oracle_sql()[name]).fetchall()
    names = [x[0] for x in c.description]
    return sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).select(*names).collect()), sorted(want)


def test_times_far_from_1970(spark, tmp_path):
    got, want = compared(spark, tmp_path, "nanos_to_ts", "orders", "SELECT 8999000 + i AS o_orderkey FROM range(20000) t(i) UNION ALL SELECT -8999000 - i FROM range(20000) t(i)")
    assert got == want


@pytest.mark.parametrize("value", ["0.0", "-0.0", "NULL", "'NaN'", "'Infinity'", "'-Infinity'", "-1e-322", "-1e-320"])
def test_floats_equal_to_the_odd_ones(spark, tmp_path, value):
    got, want = compared(spark, tmp_path, "sort_float_total", "events", f"SELECT i AS event_id, CAST(CASE WHEN i % 3 = 0 THEN CAST({value} AS DOUBLE) ELSE i - 50 END AS DOUBLE) AS value FROM range(100) t(i)")
    assert got == want and len(got) == 100
