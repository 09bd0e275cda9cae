"""Operators on small frames with expected numbers worked out by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaystone.functions import scalars as sc
from quaystone.operators import flow, indicators, models, ranking, rules, store, trades


def day(i):
    return dt.date(2026, 1, 1) + dt.timedelta(days=i)


def bars(spark, rows, symbol="000001"):
    """rows: (open, high, low, close[, volume, amount])"""
    data = [(symbol, day(i), *map(float, r[:4]), float(r[4]) if len(r) > 4 else 1e5, float(r[5]) if len(r) > 5 else 2e8) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, date date, open double, high double, low double, close double, volume double, amount double")


def ramp(spark, n=80):
    return bars(spark, [(10 + 0.1 * i, 10.5 + 0.1 * i, 9.5 + 0.1 * i, 10 + 0.1 * i, 1e5 + i) for i in range(n)])


def test_indicators_match_pandas(spark):
    got = indicators.all_indicators(ramp(spark)).orderBy("date").toPandas()
    close = got["close"]
    assert got["ma60"].iloc[-1] == pytest.approx(close.rolling(60).mean().iloc[-1])
    assert got["ma5"].isna().sum() == 4
    macd = close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()
    np.testing.assert_allclose(got["macd"], macd)
    assert got["rsi"].iloc[-1] == 100.0  # a monotone rise has no losses
    assert got["boll_upper"].iloc[-1] == pytest.approx(close.rolling(20).mean().iloc[-1] + 2 * close.rolling(20).std().iloc[-1])


def test_short_symbols_have_no_indicators(spark):
    assert indicators.all_indicators(ramp(spark, 59)).where("macd is not null or ma5 is not null").count() == 0


def test_flat_window_has_no_rsi_and_kdj_carries(spark):
    rows = [(10, 11 + i % 3, 9, 10 + i % 2) for i in range(12)] + [(10, 10, 10, 10)] * 20 + [(10, 12, 9, 11)] * 3
    got = indicators.recursive_indicators(indicators.rsi(bars(spark, rows))).orderBy("date").toPandas()
    assert np.isnan(got["rsi"].iloc[31])
    b = pd.DataFrame(rows, columns=["o", "h", "l", "c"]).astype(float)
    rsv = (b.c - b.l.rolling(9).min()) / (b.h.rolling(9).max() - b.l.rolling(9).min()).replace(0, np.nan) * 100
    np.testing.assert_allclose(got["kdj_k"].astype(float), rsv.ewm(com=2, adjust=False).mean(), equal_nan=True)


def test_recursive_steps_are_those_of_the_sql(spark):
    import duckdb

    from quaystone.plans.q_indicators import MEANS

    rng = np.random.default_rng(7)
    data = []
    for k in range(40):  # stretches that close at their high or low: there k and d meet, and j is at its limits
        close = np.cumsum(np.where(rng.random(60) < 0.8, rng.integers(0, 3, 60), rng.integers(-9, 3, 60))) + 900.0
        data += [(f"{k:06}", day(i), float(c), float(c), float(c - rng.integers(0, 2)), float(c), 1.0, 1.0) for i, c in enumerate(close)]
    df = spark.createDataFrame(data, "symbol string, date date, open double, high double, low double, close double, volume double, amount double")
    bars = df.toPandas()  # noqa: F841
    names = ["macd", "macd_signal", "kdj_k", "kdj_d", "kdj_j"]
    want = duckdb.sql(f"WITH RECURSIVE {MEANS} SELECT symbol, date, e12 - e26 AS macd, sig AS macd_signal, kk AS kdj_k, dd AS kdj_d, 3 * kk - 2 * dd AS kdj_j FROM e ORDER BY symbol, date").df()
    got = indicators.recursive_indicators(df).orderBy("symbol", "date").toPandas()
    for c in names:
        np.testing.assert_array_equal(got[c].astype(float), want[c].astype(float), err_msg=c)  # to the last bit


def test_forward_labels_keep_nulls(spark):
    rows = [(10 + i, 10.5 + i, 9.5 + i, 10 + i) for i in range(4)]
    got = indicators.forward_labels(bars(spark, rows), horizon=2).orderBy("date").toPandas()
    assert got["risk_adjusted_return"].notna().tolist() == [True, True, False, False]
    assert got["label_up"].tolist() == [1, 1, 0, 0]


def label(spark, rows, symbol="000001", **kw):
    cand = spark.createDataFrame([(day(-1), symbol, 1)], "trade_date date, symbol string, rank_no int")
    b = bars(spark, rows, symbol) if rows else bars(spark, [(1, 1, 1, 1)], "999999")
    b = b.withColumn("pct_change", F.lit(kw.pop("pct", 0.0)))
    return ranking.forward_labels(cand, b, **kw).first()


def test_labels(spark):
    strong = label(spark, [(10, 10.6, 9.8, 10.5), (10.5, 11, 10.4, 10.9), (10.9, 11.6, 10.8, 11.4), (11.4, 11.6, 11.2, 11.5), (11.5, 11.8, 11.4, 11.7)])
    assert strong.strong_3d and strong.strong_5d and strong.return_5d_pct > 8 and strong.tp_sl_path == "tp_before_sl" and strong.tradability_status == "tradable"
    assert label(spark, [(11, 11, 11, 11)] * 5, pct=10.0).tradability_status == "limit_up_entry_blocked"
    assert label(spark, [(11, 11, 11, 11)] * 5, symbol="301001", pct=10.0).tradability_status == "tradable"
    assert label(spark, [(10, 11.6, 9.1, 10)] * 3).tp_sl_path == "both_same_day_stop_loss_first"
    assert label(spark, [(10, 11, 9.9, 10, 0)] * 3).tradability_status == "volume_or_amount_blocked"
    none = label(spark, [])
    assert none.tradability_status == "missing_history" and none.return_5d_pct == 0 and not none.strong_5d
    short = label(spark, [(10, 10.5, 9.9, 10.2), (10.2, 10.5, 10, 10.3)])
    assert short.return_3d_pct == 0 and 3 in short.incomplete_horizons
    assert label(spark, [(10, 12, 11.5, 12), (11, 11, 9, 10)]).path_max_drawdown_pct == pytest.approx(-25)


def pool(spark, rows):
    """rows: (rank, return, strong, status)"""
    return spark.createDataFrame([(day(0), f"{i:06d}", r, 5, float(x), s, st) for i, (r, x, s, st) in enumerate(rows)], "trade_date date, symbol string, rank_no int, horizon int, return_pct double, strong boolean, tradability_status string")


def test_daily_metrics(spark):
    m = ranking.daily_metrics(pool(spark, [(1, -2, False, "tradable"), (2, 9, True, "tradable"), (3, 1, False, "tradable"), (11, 22, True, "tradable")])).first()
    assert (m.precision_at_3, m.precision_at_5, m.precision_at_10) == (pytest.approx(1 / 3), 0.25, 0.25)
    assert m.recall_at_10 == 0.5 and m.mrr == 0.5 and m.top_3_avg_return_pct == pytest.approx(8 / 3)
    m = ranking.daily_metrics(pool(spark, [(1, 5, False, "missing_history"), (2, 9, True, "tradable")])).first()
    assert m.precision_at_3 == 1 and m.mrr == 0.5
    m = ranking.daily_metrics(pool(spark, [(1, 0, False, "tradable"), (11, 9, True, "tradable")])).first()
    assert m.ndcg_at_10 == 0
    m = ranking.daily_metrics(pool(spark, [(1, 0, False, "tradable"), (2, 0, False, "tradable")])).first()
    assert m.recall_at_10 == 0 and m.mrr == 0


def test_percentile_curve(spark):
    c = ranking.percentile_curve(pool(spark, [(i, i, False, "tradable") for i in range(1, 11)])).orderBy("bucket").collect()
    assert [r.avg_return_pct for r in c] == [1.5, 3.5, 5.5, 7.5, 9.5] and [r.n for r in c] == [2] * 5


def test_correlations(spark):
    df = spark.createDataFrame([(5, 1.0, 2.0), (5, 2.0, 4.0), (5, 3.0, 6.0), (5, float("nan"), 1.0)], "horizon int, f double, return_pct double")
    r = ranking.factor_correlations(df, ["f"]).first()
    assert r.n == 3 and r.pearson == pytest.approx(1) and r.spearman == pytest.approx(1)


def test_fifo_equals_loop(spark):
    rng = np.random.default_rng(1)
    rows, expected = [], []
    for s in range(6):
        lots = []
        for i in range(80):
            side, qty, price = rng.choice(["buy", "sell"]), float(rng.integers(1, 30)), float(rng.integers(5, 15))
            rows.append((f"{s:06d}", i, day(i), side, qty, price))
            if side == "buy":
                lots.append([qty, price])
            while side == "sell" and qty > 0 and lots:
                take = min(qty, lots[0][0])
                expected.append((f"{s:06d}", i, take, take * (price - lots[0][1])))
                lots[0][0] -= take
                qty -= take
                if lots[0][0] == 0:
                    lots.pop(0)
    df = spark.createDataFrame(rows, "symbol string, seq int, ts date, side string, qty double, price double")
    got = sorted((r.symbol, r.s_seq, r.qty, r.pnl) for r in trades.fifo_lots(df).collect())
    assert got == sorted(expected)


def test_average_cost(spark):
    df = spark.createDataFrame([("000001", i, "buy", 100.0, 10.0 + i % 3) for i in range(60)] + [("000001", 60, "sell", 3000.0, 12.0)], "symbol string, seq int, side string, qty double, price double")
    p = trades.positions(df).first()
    assert p.qty == 3000 and p.avg_cost == pytest.approx(11.0) and p.realised == pytest.approx(3000.0)


def test_monthly_returns(spark):
    df = spark.createDataFrame([("r", dt.date(2026, 1, 2), 100.0), ("r", dt.date(2026, 1, 30), 110.0), ("r", dt.date(2026, 2, 27), 121.0), ("r", dt.date(2026, 3, 31), 108.9)], "run_id string, date date, value double")
    got = [r.ret for r in trades.monthly_returns(df).orderBy("month").collect()]
    assert got[0] is None and got[1] == pytest.approx(0.10) and got[2] == pytest.approx(-0.10)


def test_signal_score(spark):
    row = dict(close=12.0, ma5=11.5, ma10=11.0, ma20=10.5, ma60=9.5, macd=0.5, macd_signal=0.2, macd_hist=0.3, rsi=55.0, kdj_k=65.0, kdj_d=55.0, kdj_j=85.0, boll_upper=13.0, boll_lower=9.0)
    got = rules.signal_score(spark.createDataFrame([row])).first()
    assert got.signal_score == 55 and got.trend_up and got.signal == "strong_buy"


def test_scalars(spark):
    df = spark.createDataFrame([("20250102", "1,234.5%", "x-300001-y", float("nan")), ("2025-01-03", "2万", "none", None), ("bad", None, None, 5.0)], "d string, u string, p string, x double")
    got = df.select(sc.parse_date("d"), sc.parse_unit_number("u"), sc.symbol_from_pick_id("p"), sc.clamp("x", 1, 3), sc.finite("x")).collect()
    assert [g[0] for g in got] == [dt.date(2025, 1, 2), dt.date(2025, 1, 3), None]
    assert [g[1] for g in got] == [1234.5, 0.0002, None]
    assert [g[2] for g in got] == ["300001", None, None]
    assert [g[3] for g in got] == [1.0, 1.0, 3.0] and [g[4] for g in got] == [None, None, 5.0]


def test_event_times(spark):
    df = spark.createDataFrame([("1700000000",), ("1700000000000",), ("2024年3月5日",), ("2024/03/05 10:20",), ("20240305",), ("",)], "t string")
    got = [r[0] for r in df.select(sc.parse_event_time("t")).collect()]
    assert got[0] == got[1] and got[2] == dt.datetime(2024, 3, 5) and got[3] == dt.datetime(2024, 3, 5, 10, 20) and got[4] == dt.datetime(2024, 3, 5) and got[5] is None


def test_freshness_steps(spark):
    got = spark.createDataFrame([(a,) for a in (1.0, 20.0, 50.0, 100.0, 500.0, 900.0, None)], "a double").select(sc.freshness("a")).collect()
    assert [g[0] for g in got] == [1.0, 0.88, 0.72, 0.52, 0.28, 0.12, 0.45]


def test_store(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, store.upsert(a, b, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, store.insert_missing(a, b, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "C")]
    assert sorted(map(tuple, store.prefer(a, b, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "C")]
    assert sorted(map(tuple, store.first_source([a, b], "k").collect())) == [(1, "a"), (2, "b"), (3, "C")]


def test_replace_partition_and_report(spark, tmp_path):
    df = spark.createDataFrame([("m1", 1), ("m2", 2)], "model_id string, x int")
    path = f"file://{tmp_path}/models"
    store.replace_partition(df, path, "model_id")
    store.replace_partition(spark.createDataFrame([("m2", 9)], "model_id string, x int"), path, "model_id")
    assert sorted((r.model_id, r.x) for r in spark.read.parquet(path).collect()) == [("m1", 1), ("m2", 9)]
    store.write_report(df.withColumn("a", F.array("x")), f"file://{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/report").columns == ["a", "model_id", "x"]


def test_model_metrics(spark):
    df = spark.createDataFrame([("g", 0, 0.1), ("g", 0, 0.4), ("g", 1, 0.35), ("g", 1, 0.8), ("one", 1, 1.0)], "k string, y int, p double")
    got = {r.k: r for r in models.evaluate(df, ["k"]).collect()}
    assert got["g"].auc == pytest.approx(0.75) and got["one"].auc is None and got["one"].log_loss == pytest.approx(-np.log(0.999))
    flat = spark.createDataFrame([("g", int(i < 3), 0.3) for i in range(10)], "k string, y int, p double")
    assert models.calibration_error(flat, ["k"]).first().ece == pytest.approx(0)


def test_streak_and_flow(spark):
    b = ramp(spark, 5).withColumn("v", F.when(F.dayofmonth("date") >= 4, -1.0).otherwise(1.0))
    r = indicators.streak(b, "v").first()
    assert (r.sign, r.days) == (-1, 2)
    f = spark.createDataFrame([("s", "large", "buy", 10.0), ("s", "large", "sell", 4.0), ("s", "small", "sell", 1.0)], "symbol string, tier string, side string, amount double")
    g = flow.tier_summary(f).first()
    assert g.main_net == 6 and g.small_net == -1 and g.trend == "inflow" and g.control_ratio == pytest.approx(600 / 14)


def test_payloads(spark):
    from quaystone.sources import payloads

    raw = spark.createDataFrame([("2025-01-03", "1.5", "2", "1", "1.8", "100", 3.0), ("20250102", "1", "2", "1", "1", "x", None), ("bad", "1", "1", "1", "1", "1", 0.0)], "`日期` string, `开盘` string, high string, low string, close string, vol string, pct_chg double")
    got = payloads.normalize_history(raw).orderBy("date").collect()
    assert [r.date for r in got] == [dt.date(2025, 1, 2), dt.date(2025, 1, 3)] and got[0].volume is None and got[1].open == 1.5 and got[1].pct_change == 3.0
    with pytest.raises(ValueError):
        payloads.normalize_history(raw.drop("close"))
    short = spark.createDataFrame([('v="a~b";',)], "value string")
    assert payloads.quote_lines(short).count() == 0
    k = spark.createDataFrame([("s", '[["2025-01-02","1","2","3","0.5","9"],["2025-01-03","1"],["bad","1","2","3","4","5"]]')], "symbol string, payload string")
    assert [(r.date, r.close, r.volume) for r in payloads.kline_json(k).collect()] == [(dt.date(2025, 1, 2), 2.0, 9.0)]
    s = spark.createDataFrame([("sh600001", "5", None), ("12", "5", "x")], "symbol string, price string, industry string")
    assert [tuple(r) for r in payloads.normalize_snapshot(s).collect()] == [("600001", 5.0, "unknown")]
    assert spark.range(1).select(payloads.money_in_yuan(F.lit(12.5), F.lit("wan"))).first()[0] == 125000


def test_range_join_buckets_lose_nothing(spark):
    rng = np.random.default_rng(4)
    b = spark.createDataFrame([("000001", day(int(i)), float(i)) for i in sorted(rng.choice(400, 150, replace=False))], "symbol string, date date, x double")
    c = spark.createDataFrame([(day(int(i)), "000001", 1) for i in rng.choice(400, 20, replace=False)], "trade_date date, symbol string, rank_no int")
    got = {(r.trade_date, r.date) for r in ranking.bars_ahead(c, b, 17).collect()}
    want = {(x.trade_date, y.date) for x in c.collect() for y in b.collect() if 0 < (y.date - x.trade_date).days <= 17}
    assert got == want


def test_as_of_and_relaxed_selection(spark):
    from quaystone.operators import scores

    req = spark.createDataFrame([(1, "a", day(40)), (2, "a", day(5)), (3, "b", day(40))], "id int, k string, at date")
    snap = spark.createDataFrame([("a", day(8), 1.0), ("a", day(39), 2.0), ("a", day(41), 3.0)], "k string, d date, v double")
    got = {r.id: r.found_v for r in store.as_of(req, snap, "k", "at", "d").collect()}
    assert got == {1: 2.0, 2: None, 3: None}
    picks = spark.createDataFrame([(day(0), s) for s in (61.0, 58.0, 57.0, 40.0)], "date date, s double")
    assert sorted(r.s for r in scores.relaxed_selection(picks, "s", threshold=60, need=3, floor=50).collect()) == [57.0, 58.0, 61.0]


def test_streams_equal_batch(spark, tmp_path):
    from quaystone.streaming import jobs

    ts = dt.datetime(2026, 1, 1)
    rows = [(i, ts + dt.timedelta(minutes=i), i % 3, "purchase" if i % 4 else "view", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.repartition(4).write.parquet(f"file://{tmp_path}/events")
    stream = lambda: jobs.event_stream(spark, f"file://{tmp_path}/events")
    got = {r.user_id: r.value for r in jobs.run_available(jobs.latest_per_key(stream(), "user_id", "ts", "value"), spark, "update", ["user_id"]).collect()}
    assert got == {0: 39.0, 1: 37.0, 2: 38.0}
    assert jobs.run_available(jobs.deduplicated(stream(), ["event_id"], "ts"), spark, "append").count() == 40


def test_performance_of_one_day(spark):
    eq = spark.createDataFrame([(1, "1995-02-01", 9.3, 10.3), (2, "1995-02-01", -1.0, 0.0)], "run_id int, date string, ret double, value double").withColumn("date", F.to_date("date"))
    got = {r.run_id: r.annual_return for r in trades.performance(eq).collect()}
    assert got[1] == pytest.approx(3.0) and got[2] == pytest.approx(-0.99)


def test_entry_on_the_next_market_date(spark):
    days = ["1995-01-30", "1995-01-31", "1995-02-03", "1995-02-28", "1995-03-20"]
    bars = spark.createDataFrame([("a", d, 10.0, 11.0) for d in days], "symbol string, date string, open double, close double").withColumn("date", F.to_date("date"))
    picks = bars.select("symbol", "date", F.lit("buy").alias("action"), F.lit(1.0).alias("rank_score"))
    got = {(str(r.signal_date), str(r.entry_date)) for r in trades.entries(picks, bars).collect()}
    assert got == {("1995-01-30", "1995-01-31"), ("1995-01-31", "1995-02-03")}
