"""Queries over whole tables against folds in pandas and fixtures of their own."""

import datetime as dt
import os
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaystone.operators import models, ranking, rules, store
from quaystone.plans import q_rules, registry
from quaystone.sources import adapters as src
from quaystone.streaming import jobs

DATA = "/root/testdata/sf0.001"
RECURSIVE = ["macd", "macd_signal", "macd_hist", "kdj_k", "kdj_d", "kdj_j"]


def ema(xs, a):
    """A plain fold; what is missing carries the mean on and lets the older weight fade."""
    out, y, w = [], None, 1.0
    for x in xs:
        if y is None:
            y = None if np.isnan(x) else x
        elif np.isnan(x):
            w *= 1 - a
        else:
            w *= 1 - a
            y, w = (w * y + a * x) / (w + a), 1.0
        out.append(np.nan if y is None else y)
    return np.array(out)


@pytest.fixture(scope="module")
def daily(spark):
    """MACD and KDJ of the daily bars by a loop over each symbol."""
    parts = []
    for _, b in src.bars(spark, DATA).toPandas().sort_values(["symbol", "date"]).groupby("symbol"):
        low, high = b.low.rolling(9).min().to_numpy(), b.high.rolling(9).max().to_numpy()
        rsv = np.where(high != low, (b.close.to_numpy() - low) / np.where(high != low, high - low, 1) * 100, np.nan)
        macd = ema(b.close, 2 / 13) - ema(b.close, 2 / 27)
        signal, k = ema(macd, 0.2), ema(rsv, 1 / 3)
        d = ema(k, 1 / 3)
        parts.append(b.assign(macd=macd, macd_signal=signal, macd_hist=macd - signal, kdj_k=k, kdj_d=d, kdj_j=3 * k - 2 * d))
    return pd.concat(parts).set_index(["symbol", "date"]).sort_index()


def by_bar(df):
    return df.toPandas().set_index(["symbol", "date"]).sort_index()


def test_macd_kdj_of_every_daily_bar(spark, daily):
    got = by_bar(registry.QUERIES["indicator_macd_kdj"](spark, DATA))
    assert got.index.equals(daily.index)
    np.testing.assert_allclose(got[RECURSIVE].astype(float), daily[RECURSIVE], atol=1e-4)


def test_picks_score_with_daily_macd_and_kdj(spark, daily):
    panel = q_rules.pick_panel(spark, DATA)
    got = by_bar(panel.select("symbol", "date", "signal_score", *RECURSIVE))
    assert got.index.equals(daily.index)
    np.testing.assert_allclose(got[RECURSIVE].astype(float), daily[RECURSIVE], atol=1e-9)
    macd = np.where(daily.macd_hist > 0, 20, np.where(daily.macd < daily.macd_signal, -20, -10))
    k, d, j = (daily[c].replace(0, np.nan).fillna(50) for c in RECURSIVE[3:])
    kd = np.where((k > d) & (k > 50), 15, np.where((k < d) & (k < 50), -15, 0)) + np.where(j > 100, -10, np.where(j < 0, 10, 0))
    cut = rules.signal_score(panel.withColumns({c: F.lit(None).cast("double") for c in RECURSIVE})).select("symbol", "date", "signal_score")
    rest = by_bar(cut).signal_score + 10  # without MACD and KDJ the score holds a constant -10
    near = np.abs(daily.macd_hist) < 1e-9  # signs of rounding
    assert ((got.signal_score == rest + macd + kd) | near).all() and near.mean() < 0.05
    assert len(set(macd)) > 1 and len(set(kd)) > 1


def test_rule_signals_of_every_daily_bar(spark, daily):
    got = by_bar(registry.QUERIES["rule_signals"](spark, DATA))
    assert got.index.equals(daily.index)


def test_recalibrated_blends_the_picks_probability(spark):
    got = registry.QUERIES["recalibrated_probability"](spark, DATA).toPandas()
    table = registry.QUERIES["score_calibration"](spark, DATA).toPandas().set_index("bucket")
    up = q_rules.pick_panel(spark, DATA).select(F.col("date").alias("trade_date"), "symbol", "up_prob").toPandas()
    m = got.merge(up, on=["trade_date", "symbol"]).join(table, on="bucket")
    assert len(m) == len(got) > 0
    want = np.where(m.calibrated, 0.4 * m.up_prob + 0.6 * m.wins / m.n, m.up_prob)
    np.testing.assert_allclose(m.up_calibrated, want, atol=1e-4)


def test_neighbours_of_every_label(spark, monkeypatch):
    monkeypatch.setattr(models, "QUERY_BLOCK", 3)
    monkeypatch.setattr(models, "SAMPLE_BLOCK", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4)) * [1, 100, 0.01, 0]
    label = [None if i % 9 == 0 else int(i % 3) for i in range(120)]
    df = spark.createDataFrame([(i, v.tolist(), label[i]) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in models.neighbour_evidence(df.where("vec_id % 10 = 0"), df, 7).collect()}
    x = x.astype(np.float32).astype(float)
    std = x.std(axis=0)
    std[std < 1e-6] = 1
    assert sorted(got) == list(range(0, 120, 10))
    for i, r in got.items():
        d = np.round(np.sqrt(np.mean(((x - x[i]) / std) ** 2, axis=1)) + 1e-9, 6)
        near = [j for j in np.lexsort((np.arange(120), d)) if j != i][:7]
        assert (r.n, r.nearest) == (7, near[0]) and r.avg_d == pytest.approx(d[near].mean())
        assert r.mean_label == pytest.approx(np.mean([label[j] or 0 for j in near]))


def test_source_fallback_takes_whole_sources(spark):
    got = registry.QUERIES["source_fallback"](spark, DATA).toPandas()
    line = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_suppkey", "l_partkey", F.to_date("l_shipdate").alias("date")).toPandas()
    suppliers = {(f"{k:06d}", d) for k, d in zip(line.l_suppkey, line.date, strict=True)}
    first = {s for s, _ in suppliers}
    parts = {(f"{k:06d}", d) for k, d in zip(line.l_partkey, line.date, strict=True)}
    assert first & {s for s, _ in parts} and {s for s, _ in parts} - first
    assert sorted(zip(got.symbol, got.date, strict=True)) == sorted(suppliers | {x for x in parts if x[0] not in first})


def test_coverage_of_every_symbol(spark):
    day = lambda i: dt.date(2026, 1, 1) + dt.timedelta(days=i)
    have = {"all": {0, 1, 2, 3}, "late": {2, 3, 9}, "gap": {0, 2, 3}, "end": {0, 1}, "none": set()}
    wanted = spark.createDataFrame([(day(i),) for i in (0, 1, 2, 3, 3)], "date date")
    df = spark.createDataFrame([(s, day(i)) for s, days in have.items() for i in [*days, *days]] + [("none", None), ("gap", None)], "symbol string, date date")
    got = {r.symbol: (r.n_requested, r.n_missing, r.first_missing, r.status) for r in ranking.coverage_by(wanted, df, "symbol").collect()}
    for s, days in have.items():
        miss = [i for i in range(4) if i not in days]
        assert got.pop(s) == (4, len(miss), day(miss[0]) if miss else None, "blocked" if len(miss) == 4 else "partial" if miss else "complete")
    assert not got
    rows = registry.QUERIES["date_coverage"](spark, DATA).collect()
    assert sorted(r.symbol for r in rows) == sorted(r.symbol for r in src.industry(spark, DATA).unionByName(src.bars(spark, DATA).select("symbol"), allowMissingColumns=True).select("symbol").distinct().collect())


def test_as_of_looks_back_without_bound(spark):
    rng = np.random.default_rng(6)
    day = lambda i: dt.date(2026, 1, 1) + dt.timedelta(days=int(i))
    snaps = {("a", int(i)) for i in rng.choice(2000, 12, replace=False)} | {("b", 0), ("c", 1999)}
    asks = [(n, k, int(i)) for n, (k, i) in enumerate(zip(rng.choice(["a", "b", "c", "d"], 200), rng.integers(0, 2000, 200), strict=True))]
    req = spark.createDataFrame([(n, k, day(i), None) for n, k, i in asks] * 2 + [(-1, None, day(5), None), (-2, "a", None, None)], "id int, k string, at date, note string")
    snap = spark.createDataFrame([(k, day(i), i) for k, i in snaps] + [("a", None, -1)], "k string, d date, v int")
    rows = store.as_of(req, snap, "k", "at", "d").collect()
    want = {n: max((j for s, j in snaps if s == k and j <= i), default=None) for n, k, i in asks} | {-1: None, -2: None}
    assert len(rows) == 402 and all(r.found_v == want[r.id] for r in rows)
    assert sum(want[n] is not None and i - want[n] > 60 for n, _, i in asks) > 50


def test_quotes_of_the_orders_own_keys(spark):
    got = registry.QUERIES["as_of_quotes"](spark, DATA).toPandas().set_index("o_orderkey").sort_index()
    o = spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("at")).toPandas().set_index("o_orderkey").sort_index()
    bars = src.bars(spark, DATA).select("symbol", "date").toPandas().groupby("symbol").date.apply(sorted).to_dict()
    assert got.index.equals(o.index)
    want = [max((d for d in bars.get(f"{k:06d}", []) if d <= at), default=None) for k, at in zip(o.o_custkey, o["at"], strict=True)]
    assert [None if pd.isna(x) else x for x in got.bar_date] == want and any(want)


def late_first(spark, path):
    """Files in reverse order of time; three, as Spark drops by the watermark of the batch before the last."""
    ts = dt.datetime(2026, 1, 1)
    rows = [(i, ts + dt.timedelta(hours=i), i % 3, "purchase" if i % 4 else "view", float(i)) for i in range(400)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    seen = set()
    for k, part in enumerate((rows[270:], rows[130:270], rows[:130])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{path}/events.parquet")
        for f in set(path.glob("events.parquet/*.parquet")) - seen:
            os.utime(f, (1.7e9 + k, 1.7e9 + k))
            seen.add(f)
    return rows


def test_streams_count_files_in_reverse_order(spark, tmp_path):
    rows = late_first(spark, tmp_path)
    d = f"file://{tmp_path}"
    df = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"])
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        bars = registry.QUERIES["stream_daily_bars"](spark, d).collect()
        counts = {r.event_type: r.n for r in registry.QUERIES["stream_deduplicated"](spark, d).collect()}
    want = df.groupby(["event_type", df.ts.dt.floor("D")]).value.agg(["first", "max", "min", "last", "count"])
    assert {(r.event_type, pd.Timestamp(r.start)): (r.open, r.high, r.low, r.close, r.n) for r in bars} == {k: tuple(v) for k, v in zip(want.index, want.itertuples(index=False), strict=True)}
    assert counts == df.groupby("event_type").event_id.count().to_dict()
    position = {}
    for r in df.itertuples():
        q, c, n = position.get(r.user_id, (0.0, 0.0, 0))
        q, c = (q + 1, c + r.value) if r.event_type == "purchase" else (q - 1, c * (q - 1) / q) if q > 0 else (q, c)
        position[r.user_id] = (q, c, n + 1)
    got = {r.user_id: (r.qty, r.cost, r.n) for r in registry.QUERIES["stream_positions"](spark, d).collect()}
    assert got == {u: (q, pytest.approx(c, abs=1e-3), n) for u, (q, c, n) in position.items()}


def test_dropped_rows_are_reported(spark, tmp_path):
    late_first(spark, tmp_path)
    batch = spark.read.parquet(f"file://{tmp_path}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/events.parquet")
    with pytest.warns(UserWarning, match="late rows were dropped"):
        jobs.run_available(jobs.tumbling_bars(stream.withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts", "value"), spark, "update", ["event_type", "start"])
