import duckdb
import pytest

from walkmoments.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    df = registry.queries()[name](spark, path)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})")
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    assert got == sorted(map(repr, want.fetchall()))
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}
    assert [kinds[t] for _, t in df.select(*columns).dtypes] == [str(d[1]) for d in want.description]
