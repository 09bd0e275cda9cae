"""The array pass against the same frames as Spark windows, over symbols of uneven length and chunks cut between them."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__
from quaystone.operators import indicators, series
from quaystone.plans import q_rules
from quaystone.sources import adapters
from quaystone.plans.sqltext import r

DATA = "/root/testdata/sf0.001"


def batches(lengths, size):
    rng = np.random.default_rng(3)
    pos = np.concatenate([np.arange(1, n + 1) for n in lengths])
    symbol = np.repeat([f"{k:06}" for k in range(len(lengths))], lengths)
    table = pa.table({"symbol": symbol, "_k": pa.array(pos, pa.int32()), "close": rng.integers(1, 50, len(pos)) / 4.0})
    return table.to_batches(max_chunksize=size)


@pytest.mark.parametrize("size", (1, 7, 1000))
def test_chunks_hold_whole_symbols(monkeypatch, size):
    monkeypatch.setattr(series, "CHUNK", 20)
    lengths = [3, 40, 1, 1, 25, 60]
    got = list(series.chunks(batches(lengths, size)))
    assert sum(t.num_rows for t in got) == sum(lengths) and all(t.column("_k")[0].as_py() == 1 for t in got)
    assert size == 1000 or len(got) > 1
    names = [s for t in got for s in t.column("symbol").unique().to_pylist()]
    assert len(names) == len(set(names)) == len(lengths)


@pytest.mark.parametrize("chunk", (20, 10**6))
def test_frames_of_uneven_symbols(monkeypatch, chunk):
    monkeypatch.setattr(series, "CHUNK", chunk)
    lengths = [3, 40, 1, 25, 60]
    run = series.columns_pass(["close"], ["symbol", "_k", "close"], ["ma5", "_dev", "return_5d", "n_bars"])
    got = pa.Table.from_batches(list(run(iter(batches(lengths, 9))))).to_pandas()
    by = got.groupby("symbol")["close"]
    np.testing.assert_allclose(got["ma5"], by.rolling(5).mean().to_numpy(), equal_nan=True)
    np.testing.assert_allclose(got["_dev"], by.rolling(20).std().to_numpy(), equal_nan=True, atol=1e-12)
    np.testing.assert_allclose(got["return_5d"], ((got["close"] / by.shift(5) - 1).fillna(0) * 100).to_numpy())
    assert got["n_bars"].tolist() == [n for n in lengths for _ in range(n)]


def test_nulls_and_zeros(spark):
    day = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(25)]
    rows = [("000001", d, 9.0, 40.0, 0.0 if i == 9 else None if i == 3 else 10.0 + i) for i, d in enumerate(day)]
    df = spark.createDataFrame(rows, "symbol string, date date, low double, high double, close double")
    got = indicators.with_columns(df, ("ma5", "macd")).orderBy("date").collect()
    assert [r.ma5 is None for r in got[:10]] == [True] * 8 + [False] * 2 and got[3].macd is not None
    assert indicators.daily_change(df).orderBy("date").collect()[10].pct_change == 0.0  # after a close of 0


def test_scorers_are_not_one_long_method(spark):
    """The JVM compiles no method beyond 8,000 bytes: rows as wide as the panel's must not go through whole-stage code."""
    __spark_entry__.queries()["historical_picks"](spark, DATA)
    assert int(spark.conf.get("spark.sql.codegen.maxFields")) < len(q_rules.SIGNAL_COLUMNS)


def test_numbers_are_rounded_in_the_pass(spark):
    """As ``r`` rounds them, ties and signs included, but without a decimal number a value; only the rows of ``where`` stay."""
    x = np.concatenate([np.random.default_rng(7).normal(size=2000) * 10.0 ** np.arange(-9, 11).repeat(100), [0.00005, -0.00005, 2.5, -1e-10, 0.12345, -0.12345, 1e300, -0.0]])
    want = [r.y for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(r("x").alias("y")).collect()]
    got = series.rounded(x, 4)
    assert got.tolist() == want and not np.signbit(got[got == 0]).any()
    run = series.columns_pass(["close"], ["symbol"], ["ma5", "_far"], {"_far": lambda f: f["close"] / 0, "_rest": lambda f: f.pos >= 2}, where="_rest", whole=True, digits=1)
    got = pa.Table.from_batches(list(run(iter(batches([7, 2, 3], 100)))))
    assert got.num_rows == 5 + 0 + 1 and got["symbol"].to_pylist() == ["000000"] * 5 + ["000002"] and set(got["_far"].to_pylist()) == {0.0} and got["ma5"].to_pylist()[:2] == [0.0, 0.0]


def test_last_bars_are_those_of_all(spark):
    """Advice reads a symbol's last bar, decisions its last 31: no other bar leaves the pass, and these are as if all had."""
    bars = adapters.bars(spark, DATA)
    rows = lambda df: sorted(map(tuple, df.collect()), key=lambda x: x[:2])
    want = rows(indicators.latest(indicators.all_indicators(bars)))
    assert rows(indicators.all_indicators(bars, **indicators.last_bars(1))) == want and len({x[0] for x in want}) == len(want)
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    full = q_rules.signal_panel(spark, DATA)
    some = q_rules.signal_panel(spark, DATA, **indicators.last_bars(31))
    assert rows(some.drop("signal_codes")) == rows(full.drop("signal_codes").withColumn("_n", F.row_number().over(w)).where("_n <= 31").drop("_n"))
    recent = full.withColumn("_last", F.max("date").over(Window.partitionBy("symbol"))).where("datediff(_last, date) <= 30")
    assert recent.join(some, ["symbol", "date"], "left_anti").count() == 0


def test_training_panel_rounds_no_column_row_by_row(spark):
    plan = __spark_entry__.queries()["training_panel"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("round(") <= 1  # the bars' amount
