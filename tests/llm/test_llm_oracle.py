import duckdb
import pytest

from traceforge.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    rel = con.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    got = sorted(map(repr, df.select(*order).toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None)))
    want = sorted(map(repr, rel.select(",".join(order)).df().astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None)))
    assert len(got) == len(want) and got == want
