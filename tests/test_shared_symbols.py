"""Part keys beyond six digits share a symbol: their trades have equal numbers, which SQL's frames hold together."""

import datetime as dt

import duckdb
import numpy as np
import pytest

from quaystone.plans import registry

COLUMNS = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz"


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    """Three parts of one symbol and one of its own.  A part's first ten trades are buys that cover all its sells, so that nothing is short and no tie is left to the engine."""
    rng, rows, order = np.random.default_rng(7), [], 0
    for part in (100000, 1000000, 1000007, 654321):
        for i in range(16):
            order += 1
            qty = float(rng.integers(30, 50) if i < 10 else rng.integers(1, 40))
            day = dt.datetime(2020, 1, 1) + dt.timedelta(days=20 * i + int(rng.integers(0, 19)))
            rows.append((order, part, order % 5, 1, qty, qty * float(rng.integers(100, 200)), "N" if i < 10 else "R", day))
    path = tmp_path_factory.mktemp("shared")
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet/*.parquet'")
    return str(path), con


def equal_rows(spark, shared, name):
    path, con = shared
    got = registry.QUERIES[name](spark, path).toPandas()
    want = con.execute(registry.SQL[name]).df()[list(got.columns)]
    text = lambda df: sorted(tuple(round(v, 5) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))
    assert text(got) == text(want) and len(got)
    return got


def test_round_trips_of_a_shared_symbol(spark, shared):
    got = equal_rows(spark, shared, "fifo_round_trips").set_index("symbol")
    assert got.n_lots["100000"] >= 3 * got.n_lots["654321"]  # trades of one number each meet the other side


def test_curves_of_a_shared_symbol(spark, shared):
    equal_rows(spark, shared, "trade_curves")


def test_diagnostics_of_a_shared_symbol(spark, shared):
    equal_rows(spark, shared, "trade_diagnostics")


def test_closes_of_a_shared_symbol(spark, shared):
    """A date's close is that of the trade with the greatest number in its part, not of the last order."""
    path, _ = shared
    rows = [(900, 1000001, 7, 1, 2.0, 20.0, "N", dt.datetime(2019, 1, 1)), (901, 1000001, 7, 1, 2.0, 40.0, "N", dt.datetime(2019, 6, 1)), (902, 100000, 7, 1, 2.0, 60.0, "N", dt.datetime(2019, 6, 1))]
    more = f"{path}/closes"
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{more}/lineitem.parquet")
    got = {str(r.date): r.close for r in registry.QUERIES["source_fallback"](spark, more).where("symbol = '100000'").collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{more}/lineitem.parquet/*.parquet'")
        want = {str(d): c for d, c in con.execute(f"SELECT date, close FROM ({registry.SQL['source_fallback']}) WHERE symbol = '100000'").fetchall()}
    assert got == want == {"2019-01-01": 10.0, "2019-06-01": 20.0}
