import duckdb
import pytest
from lakecorpus.llm.queries import oracle_sql, queries

AT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    got = queries()[name](spark, AT)
    want = db.sql(oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect())))
    assert rows == sorted(map(repr, want.select(", ".join(columns)).fetchall()))
