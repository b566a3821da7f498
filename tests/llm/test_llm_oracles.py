"""The registered queries of this sub-package that SQL can express, against DuckDB on the smallest tables."""

import os

import pytest

from quarry.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA).toPandas()
    want = con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted((tuple(None if v is None or v != v else round(v, 9) if isinstance(v, float) else v for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)
    assert plain(got) == plain(want)
