"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quaystone.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    text = lambda v: None if v is None or v is pd.NaT or v != v else round(v + 0.0, 5) if isinstance(v, float) else str(v).removesuffix(" 00:00:00") if not isinstance(v, (bool, int)) else v
    return sorted((tuple(text(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) & set(registry.SQL)))
def test_query(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b


def test_walk_forward(spark):
    got = registry.QUERIES["walk_forward_metrics"](spark, DATA).toPandas()
    assert ((got.auc >= 0) & (got.auc <= 1)).all() and ((got.brier >= 0) & (got.brier <= 1)).all()
