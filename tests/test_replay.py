"""Replay, credibility, suggestions, live picks and selections against folds in Python and known cases."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaystone.operators import credibility as cr
from quaystone.operators import guidance as gd
from quaystone.operators import live, pools
from quaystone.operators import trades as tr

RUN = "run_id int, n_trades int, n_days int, n_symbols int, universe int, sharpe double, max_drawdown double, win_rate double, profit_loss_ratio double, annual_return double, n_months int, month_positive double, month_vol double, state_dispersion double"


def brute_score(r):
    ramp = lambda x, a, b: min(100.0, max(0.0, (x - a) / (b - a) * 100))
    (_, n, days, symbols, universe, sharpe, dd, win, pl, annual, months, pos, vol, disp) = r
    sample = 0.45 * ramp(n, 0, 120) + 0.35 * ramp(days, 0, 540) + 0.2 * ramp(symbols, 0, 180)
    risk = 0.3 * ramp(sharpe, 0, 1.8) + 0.25 * ramp(dd, 0.3, 0) + 0.2 * ramp(win, 0.45, 0.65) + 0.15 * ramp(pl, 0, 2) + 0.1 * ramp(annual, -0.05, 0.3)
    stable = (0.45 * ramp(pos, 0.4, 0.75) + 0.35 * ramp(vol, 0.09, 0) + 0.2 * ramp(disp, 0.16, 0)) * (0.55 if months < 6 else 0.75 if months < 9 else 1)
    data = min(100, max(0, 65 + 0.35 * ramp(symbols / max(1, universe), 0, 1) - 20))
    parts = [round(x + 1e-9, 2) for x in (sample, risk, stable, data, 84.0)]
    return parts, sum(p * w for p, w in zip(parts, (0.24, 0.28, 0.2, 0.18, 0.1), strict=True))


def test_credibility(spark):
    known = (1, 12, 90, 30, 140, 0.8, 0.24, 0.5, 1.1, 0.08, 2, 0.5, 0.1, 0.0)
    good = (2, 200, 500, 180, 180, 2.0, 0.05, 0.66, 2.5, 0.4, 12, 0.9, 0.01, 0.01)
    rng = np.random.default_rng(4)
    rows = [known, good] + [
        (k, int(rng.integers(0, 200)), int(rng.integers(0, 700)), int(rng.integers(0, 200)), int(rng.integers(0, 200)), *map(float, rng.uniform(0, [2, 0.4, 1, 3, 0.5])), int(rng.integers(0, 14)), *map(float, rng.uniform(0, [1, 0.2, 0.2])))
        for k in range(3, 20)
    ]
    got = {r.run_id: r for r in cr.credibility_report(spark.createDataFrame(rows, RUN)).collect()}
    for r in rows:
        parts, score = brute_score(r)
        g = got[r[0]]
        assert [g[k] for k, _ in cr.DIMENSIONS] == pytest.approx(parts, abs=0.011) and g.score == pytest.approx(score, abs=0.02)
    assert not got[1].live_ready and got[1].grade == "D" and len(got[1].failed) >= 4 and {"sharpe", "n_trades", "max_drawdown"} <= set(got[1].failed)
    assert got[2].live_ready and got[2].grade == "A" and got[2].failed == [] and len(got[2].gates) == 11
    worse = cr.credibility_report(spark.createDataFrame([good], RUN), synthetic=True).first()
    assert worse.failed == ["no_synthetic_bars"] and not worse.live_ready and worse.data < got[2].data


def test_credibility_of_missing_numbers(spark):
    empty = spark.createDataFrame([(1, *[None] * 13)], RUN)
    r = cr.credibility_report(empty).first()
    assert r.score is not None and not r.live_ready and len(r.failed) == 10


def test_suggestions(spark):
    schema = "k int, n_trades int, win_rate double, profit_loss_ratio double, max_drawdown double, avg_days double, avg_return_pct double, n_open int, open_pnl_pct double, holding_days double"
    rows = [
        (1, 2, 0.1, 0.1, 0.0, 0.0, 0.0, 0, 0.0, None), (2, 10, 0.4, 1.0, 0.2, 5.0, 1.0, 1, -4.0, None), (3, 10, 0.7, 2.0, 0.05, 20.0, 3.0, 2, 1.0, None), (4, 10, 0.55, 1.3, 0.1, 14.0, 1.0, None, None, None),
        (5, 10, 0.55, 1.3, 0.1, 4.5, 1.0, None, None, 10.0),
    ]
    got = {r.k: r for r in cr.suggestions(spark.createDataFrame(rows, schema)).collect()}
    ids = {k: [i.id for i in r["items"]] for k, r in got.items()}
    assert ids[1] == ["expand_sample"] and ids[3] == ["lift_take_profit"] and ids[4] == ["keep_and_monitor"] and ids[5] == ["shorten_holding_window"]
    assert ids[2] == ["raise_threshold", "tighten_stop_loss", "shorten_holding_window", "reduce_exposure", "enforce_open_risk_rules"]
    assert (got[2].score_threshold, got[2].stop_loss_pct, got[2].holding_days) == (75.0, 6.5, 7.0) and got[3].stop_profit_pct == 17.0 and got[5].holding_days == 6.0
    assert got[4]["items"][0].priority == "low" and got[4].holding_days == 15.0


def test_trade_curve(spark):
    lots = [("a", 1, 10, 100.0, 5.0), ("a", 2, 20, 100.0, -30.0), ("a", 3, 30, 200.0, 10.0), ("b", 1, 5, 50.0, 0.0)]
    df = spark.createDataFrame(lots, "symbol string, b_seq int, s_seq int, cost double, pnl double")
    got = [(r.equity, r.drawdown) for r in tr.trade_curve(df, ["symbol"]).where("symbol = 'a'").orderBy("s_seq").collect()]
    peak, cost, pnl, want = 1.0, 0.0, 0.0, []
    for _, _, _, c, p in lots[:3]:
        cost, pnl = cost + c, pnl + p
        e = 1 + pnl / cost
        peak = max(peak, e)
        want.append((e, e / peak - 1))
    assert np.allclose(got, want)
    spans = spark.createDataFrame([("a", dt.date(2020, 1, 1), dt.date(2021, 1, 1)), ("b", dt.date(2020, 1, 1), dt.date(2020, 1, 1))], "symbol string, first_ts date, last_ts date")
    s = {r.symbol: r for r in tr.curve_summary(df, spans, ["symbol"]).collect()}
    assert s["a"].total_return == pytest.approx(-15 / 400) and s["a"].max_drawdown == pytest.approx(-min(d for _, d in want)) and s["a"].annual_return == pytest.approx((1 - 15 / 400) ** (365 / 366) - 1)
    assert s["b"].annual_return == 0 and s["b"].max_drawdown == 0


def panel(rng, symbols=4, days=60):
    d0, out = dt.date(2020, 1, 1), []
    for s in range(symbols):
        p = 10.0
        for k in range(days):
            if rng.random() < 0.7:
                p *= math.exp(rng.normal(0, 0.05))
                out.append((f"s{s}", d0 + dt.timedelta(days=k), p * 0.99, p))
    return out


def test_open_trade_equity(spark):
    rng = np.random.default_rng(2)
    bars = panel(rng)
    by = {}
    for s, d, o, c in bars:
        by.setdefault(s, []).append((d, o, c))
    rounds = []
    for s, rows in by.items():
        for _ in range(12):
            i = int(rng.integers(0, len(rows)))
            j = min(len(rows) - 1, i + int(rng.integers(0, 9)))
            entry, exit_ = rows[i][1] * 1.001, rows[j][2] * 0.999
            rounds.append((s, rows[i][0], entry, rows[j][0], exit_, exit_ * 0.9997 / (entry * 1.0003) - 1))
    got = tr.open_trade_equity(spark.createDataFrame(rounds, "symbol string, entry_date date, entry_price double, exit_date date, exit_price double, ret double"), spark.createDataFrame(bars, "symbol string, date date, open double, close double")).orderBy("date").collect()
    dates, value, want = sorted({d for _, d, _, _ in bars}), 1.0, []
    for d in dates:
        live_, total = 0, 0.0
        for s, e, ep, x, xp, ret in rounds:
            if e <= d <= x:
                live_ += 1
                rows = [r for r in by[s] if r[0] <= d]
                if rows and rows[-1][0] == d:
                    prev = rows[-2][2] if len(rows) > 1 else None
                    total += ret if e == x else rows[-1][2] / (ep * 1.0003) - 1 if d == e else xp * 0.9997 / prev - 1 if d == x else rows[-1][2] / prev - 1
        if live_:
            value *= 1 + total / live_
            want.append((d, live_, total / live_, value))
    assert [r.date for r in got] == [w[0] for w in want] and [r.n_open for r in got] == [w[1] for w in want]
    assert [r.ret for r in got] == pytest.approx([w[2] for w in want], abs=1e-9) and [r.value for r in got] == pytest.approx([w[3] for w in want])
    none = tr.open_trade_equity(spark.createDataFrame([], "symbol string, entry_date date, entry_price double, exit_date date, exit_price double, ret double"), spark.createDataFrame(bars, "symbol string, date date, open double, close double"))
    assert none.count() == 0


def test_equity_beyond_a_double(spark):
    d = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(400)]
    equity = tr.open_trade_equity(
        spark.createDataFrame([("a", x, 1.0, x, 10.0) for x in d[:-1]] + [("a", d[-1], 1.0, d[-1], 0.5)], "symbol string, entry_date date, entry_price double, exit_date date, exit_price double"),
        spark.createDataFrame([("a", x, 1.0, 10.0) for x in d], "symbol string, date date, open double, close double"),
    )
    last = tr.drawdowns(equity).orderBy("date").collect()[-1]
    assert last.log_value == pytest.approx(399 * np.log(10 * 0.9997 / 1.0003) + np.log(0.5 * 0.9997 / 1.0003)) and last.drawdown == pytest.approx(0.5 * 0.9997 / 1.0003 - 1)


def test_exit_by_fallen_score(spark):
    d = [dt.date(2020, 1, k) for k in range(1, 8)]
    bars = spark.createDataFrame([("a", x, 10.0, 10.0 + 0.1 * k) for k, x in enumerate(d)], "symbol string, date date, open double, close double")
    entry = spark.createDataFrame([("a", d[0], d[1], 10.0, 60.0)], "symbol string, signal_date date, entry_date date, entry_price double, rank_score double")
    scores = spark.createDataFrame([("a", d[1], 50.0), ("a", d[4], 44.9), ("a", d[5], 10.0)], "symbol string, date date, score double")
    r = tr.exits(entry, bars, scores=scores, least_score=45.0).first()
    assert (r.exit_date, r.reason) == (d[4], "score")
    assert tr.exits(entry, bars).first().reason == "end"
    crash = bars.withColumn("close", F.when(F.col("date") == d[4], 5.0).otherwise(F.col("close")))
    assert tr.exits(entry, crash, scores=scores).first().reason == "stop"  # a stop goes before a fallen score


BASE = dict(
    symbol="000001", date=dt.date(2020, 1, 1), close=10.2, rsi=60.0, macd_hist=0.2, ma5=10.0, ma10=9.9, ma20=9.8, ma60=9.0, boll_lower=9.0, boll_mid=9.8, pct_change=1.5, prev_pct_change=0.4, return_5d=3.0, return_20d=8.0,
    from_20d_high_pct=-1.0, ma20_gap_pct=4.0, volume_ratio_5=1.4, signal_score=60, state="offensive", inflow=1.0, turn=5.0, news_net=0.0, news_total=50.0,
)


def picks(spark, **changes):
    row = BASE | changes
    kinds = {str: "string", float: "double", int: "int", dt.date: "date"}
    schema = ", ".join(f"{k} {kinds[type(BASE[k])]}" for k in row)
    return {(r.risk, r.strategy): r for r in live.live_pick(spark.createDataFrame([tuple(row.values())], schema)).collect()}


def test_live_pick(spark):
    got = picks(spark)
    assert len(got) == 6 and got["medium", "breakout"].action == "buy" and got["medium", "breakout"].notes == []
    m = got["medium", "breakout"]
    # up: 0.52 + 60/250, + 0.012, + 72/260, + 0.02 is above its bound
    assert m.up_prob == 0.80 and m.dd_prob == pytest.approx(max(0.10, min(0.9, 0.34 - 0.15 - 0.01 - 72 / 420) - 0.03), abs=1e-9)
    assert m.edge == pytest.approx(m.up_prob * 14 - m.dd_prob * 8) and m.profit_factor == pytest.approx((m.up_prob * 0.14 + 0.005) / (m.dd_prob * 0.08 + 0.005))
    assert m.position_pct == 10 and got["low", "breakout"].position_pct == 8 and m.stop_price == pytest.approx(10.2 * 0.92)
    broken = picks(spark, return_20d=-20.0)
    assert all(r.action == "pass" and "broken" in r.notes for r in broken.values())
    news = picks(spark, news_net=-20.0)
    assert news["medium", "breakout"].notes == ["news"] and news["medium", "breakout"].action != "buy" and news["medium", "breakout"].penalty == 6
    hot = picks(spark, rsi=80.0)
    assert set(hot["high", "breakout"].notes) == {"shape", "hot"} and "hot" not in hot["high", "rebound"].notes
    weak = picks(spark, rsi=20.0)
    assert "weak" in weak["medium", "rebound"].notes and weak["medium", "rebound"].action == "pass"
    nothing = picks(spark, **{k: None for k in BASE if k not in ("symbol", "date", "close")})
    assert len(nothing) == 6 and all(r.total is not None and 0 <= r.total <= 100 for r in nothing.values())


def test_profile_selection(spark):
    schema = "date int, symbol string, risk string, action string, dd_prob double, risk_adjusted double, turn double, inflow double, edge double, up_prob double, expected_return double, profit_factor double, total double, quality double, trend double"
    row = lambda s, risk, **k: tuple({"date": 1, "symbol": s, "risk": risk, "action": "buy", "dd_prob": 0.2, "risk_adjusted": 60.0, "turn": 5.0, "inflow": 0.0, "edge": 1.0, "up_prob": 0.6, "expected_return": 5.0, "profit_factor": 1.5, "total": 60.0, "quality": 60.0, "trend": 60.0} | k | {} for _ in (0,))[0]
    rows = [row(f"s{i}", "low") for i in range(8)] + [row("loose", "low", dd_prob=0.3)] + [row("m", "medium", dd_prob=0.42), row("n", "medium", dd_prob=0.43)]
    rows += [row(f"h{i}", "high", action="watch") for i in range(9)] + [row("calm", "high"), row("loss", "high", edge=-0.1)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = {(r.risk, r.symbol) for r in pools.profile_selection(df).collect()}
    assert ("low", "loose") not in got and ("low", "s0") in got and ("medium", "m") in got and ("medium", "n") not in got
    assert ("high", "calm") in got and ("high", "loss") not in got  # nine active ones are too few to stand alone
    one_less = df.where("symbol <> 's0'")
    assert ("low", "loose") in {(r.risk, r.symbol) for r in pools.profile_selection(one_less).collect()}
    alone = {r.symbol for r in pools.risk_selection(df.where("risk = 'low'").drop("risk"), "low").collect()}
    assert alone == {f"s{i}" for i in range(8)}


def test_pick_grades(spark):
    schema = "k int, action string, total double, up_prob double, dd_prob double, edge double, profit_factor double, state string, risk string, live_ready boolean"
    a = ("buy", 86.0, 0.66, 0.24, 2.2, 1.35)
    rows = [
        (1, *a, "neutral", "medium", True), (2, *a, "defensive", "medium", True), (3, *a, "neutral", "medium", False), (4, "buy", 86.0, 0.66, 0.24, 2.2, 1.34, None, "medium", None), (5, "buy", 76.0, 0.58, 0.34, 1.0, 1.0, "neutral", "low", True),
        (6, "watch", 10.0, 0.1, 0.9, 0.0, 1.0, "neutral", "high", True), (7, "pass", 66.0, 0.1, 0.9, 0.0, 1.0, "neutral", "high", True), (8, "buy", 65.9, 0.9, 0.1, 9.0, 9.0, "neutral", "high", True), (9, "buy", *[None] * 8),
    ]
    got = {r.k: (r.grade, r.mode) for r in gd.pick_grade(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        1: ("A", "real_allowed"), 2: ("B", "real_allowed"), 3: ("A", "paper_only"), 4: ("B", "paper_only"), 5: ("C", "watch_only"), 6: ("C", "watch_only"), 7: ("C", "watch_only"), 8: ("D", "watch_only"), 9: ("D", "watch_only"),
    }


def test_decisions_agree_with_the_pool(spark):
    pool = "symbol string, action string, grade string, total double, trend double, flow_score double, dd_prob double, up_prob double, expected_return double, position_pct double, take_price double, stop_price double"
    rows = [("a", "buy", "A", 90.0, 80.0, 70.0, 0.2, 0.7, 5.0, 10.0, 11.0, 9.0), ("b", "ignored", None, 30.0, 1.0, 1.0, 0.5, 60.0, 1.0, 0.0, None, None), ("c", "odd", None, 20.0, 1.0, 1.0, 0.3, None, 1.0, None, None, None)]
    got = {r.symbol: r for r in gd.aligned_decision(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "symbol string"), spark.createDataFrame(rows, pool)).collect()}
    assert [(got[k].decision, got[k].confidence, got[k].risk_level) for k in "abcd"] == [("buy", "high", "low"), ("not_now", "medium", "raised"), ("watch", "low", "medium"), ("not_in_pool", "low", "high")]
    assert got["a"].probability_pct == pytest.approx(70) and got["b"].probability_pct == 60 and got["d"].position_pct == 0 and not got["d"].in_pool


def test_advice(spark):
    df = spark.createDataFrame([("a", 50, 10.0), ("b", -5, 10.0), ("c", None, 10.0), ("d", 15, 10.0)], "symbol string, signal_score int, close double")
    got = {(r.symbol, r.risk_level, r.period): r for r in gd.advice(df).collect()}
    assert len(got) == 36
    r = got["a", "medium", "medium"]
    assert (r.entry, r.entry_high_pct, r.add_on, r.take_pct, r.stop_price, r.warnings) == ("build", 50, "on_breakout", pytest.approx(9.6), pytest.approx(9.2), []) and r.entry_price == 10
    r = got["d", "medium", "short"]
    assert r.adjusted == pytest.approx(12) and r.entry == "careful" and r.entry_price == pytest.approx(9.7) and r.take_pct == pytest.approx(7.2) and r.warnings == ["short_term"]
    assert got["b", "high", "long"].warnings == ["bearish", "high_risk"] and got["b", "high", "long"].take_pct == 12 and got["b", "low", "long"].stop_price == pytest.approx(9.5)
    assert got["c", "low", "medium"].entry == "wait" and got["c", "low", "medium"].entry_price is None


def test_display_pool(spark):
    schema = "date int, symbol string, risk string, action string, state string, confidence string, dd_prob double, risk_adjusted double, turn double, inflow double, edge double, up_prob double, expected_return double, profit_factor double, total double, quality double, trend double"
    base = {"date": 1, "symbol": "", "risk": "medium", "action": "buy", "state": "neutral", "confidence": "high", "dd_prob": 0.15, "risk_adjusted": 64.0, "turn": 4.0, "inflow": 0.5, "edge": 6.0, "up_prob": 0.7, "expected_return": 8.0, "profit_factor": 2.5, "total": 70.0, "quality": 70.0, "trend": 70.0}
    rows = [base | {"symbol": f"s{i:02}", "total": 70.0 + i} for i in range(40)] + [base | {"symbol": f"d{i:02}", "date": 2, "state": "defensive", "dd_prob": round(0.2 + 0.02 * i, 2)} for i in range(9)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = pools.display_pool(df, threshold=60.0).collect()
    first = sorted((r for r in got if r.date == 1), key=lambda r: r.rank_no)
    assert len(first) == 30 and [r.rank_no for r in first] == list(range(1, 31)) and first[0].symbol == "s39"  # capped, the best total first
    assert {r.symbol for r in got if r.date == 2} == {f"d{i:02}" for i in range(6)}  # a defensive market bars drawdowns over 0.30
    scores = sorted(r.display_score for r in pools.calibrated_scores(df.where("date = 1")).collect())
    strict = scores[-3] - 0.0001
    shown = pools.display_pool(df.where("date = 1"), threshold=strict).collect()
    eased = max(68.0, strict - 3)
    want = sum(s >= eased for s in scores) if strict <= 75 and sum(s >= eased for s in scores) > 3 else 3
    assert len(shown) == min(30, want) and all(r.threshold == pytest.approx(eased if want > 3 else strict) for r in shown)
    assert pools.display_pool(df.where("date = 9")).count() == 0


def test_live_market_state(spark):
    from quaystone.operators import ranking as rk

    rows = [(1, p) for p in (2.0, 3.0, -1.0, None, 4.0)] + [(2, -9.0), (2, -8.0)]
    q = spark.createDataFrame(rows, "day int, pct_change double")
    got = {r.day: r for r in rk.live_market_state(q, spark.createDataFrame([(1, 90.0)], "day int, policy_score double"), ["day"]).collect()}
    want = 0.28 * (50 + 1.6 * 4) + 0.22 * 60 + 0.16 * (45 + 1.6 * 3) + 0.16 * (65 - 1.6 * 4) + 0.18 * 90
    assert got[1].state_score == pytest.approx(want, abs=1e-6) and got[1].confidence == "high" and got[1].exposure_max == 50 and got[1].state == "neutral"
    assert got[2].state == "defensive" and got[2].confidence == "medium" and got[2].news_score == 50 and got[2].exposure_min == 10
    assert rk.live_market_state(q, None, ["day"]).count() == 2
