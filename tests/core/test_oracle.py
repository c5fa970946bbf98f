"""Every registered query with SQL against DuckDB on the same tables."""

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from traceforge.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, SQL = queries(), oracle_sql()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got, "no rows"
    if name in SQL:
        rel = db.sql(SQL[name])
        want = rows_of(rel.columns, rel.fetchall())
        assert sorted(df.columns) == sorted(rel.columns)
        assert len(got) == len(want)
        assert got == want


def test_last_digits_decide_as_in_sql(spark, tmp_path):
    """A share of a percentile whose last bit decides, a score that is 6 only when rounded, and a score of minus zero."""
    odd = [*[8.77] * 3, 20.0, 30.0, 40.0, 50.0, 60.0, 87.21, 89.17, 95.0, 96.0]
    even = [*[4.64] * 3, 20.0, 30.0, 31.0, 32.0, 33.0, 46.27, 46.79, 95.0, 96.0]
    six = [75.0, 100.0, 125.0] * 6 + [75.0, 100.0, 100.0 + 222.39 + 1e-8]
    low = [0.0] * 6 + [float(10 + i * 7 % 20) for i in range(20)]
    rows = [(u * 10, i, v) for u, values in enumerate((odd, even, six, low)) for i, v in enumerate(values)]
    times = [datetime(2024, 1, 1, 0, 0, i) for _, i, _ in rows]
    events = spark.createDataFrame([(17 * k + 1, times[k], user, "view", v) for k, (user, _, v) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("a10_full_run_native", "a10_severity"):
        df, rel = QUERIES[name](spark, str(tmp_path)), con.sql(SQL[name])
        want = sorted(map(repr, rel.fetchall()))
        assert sorted(repr(tuple(r)) for r in df.select(*rel.columns).collect()) == want
        assert name == "a10_severity" or {"-0.0" in r for r in want} == {"6.0, 'WARNING'" in r for r in want} == {True, False}
