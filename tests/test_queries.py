"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from knapline.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(x) else float(x) if isinstance(x, (int, float)) or hasattr(x, "dtype") else x for x in row) for row in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    ours = catalog.queries()[name](spark, DATA).toPandas()
    theirs = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["knn_cosine", "knn_top1", "top5_similar"])
def test_searches_ask_for_every_row(spark, name):
    ids = {r["vec_id"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()}
    assert {r["query"] for r in catalog.queries()[name](spark, DATA).select("query").collect()} == ids
