"""Pool operators on small tables."""

import datetime as dt

from quaystone.operators import pools


def test_same_metrics(spark):
    a = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, 2.0), ("c", 1.0, 1.0)], "k string, x double, y double")
    b = spark.createDataFrame([("a", 1.0 + 1e-12, 0.0), ("b", 1.1, 2.0), ("d", 1.0, 1.0)], "k string, x double, y double")
    assert {r.k: r.same for r in pools.same_metrics(a, b, ["k"], ["x", "y"]).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_score_in_text(spark):
    df = spark.createDataFrame([("buy score=61.5;", 61.5), ("score=7", 7.0), ("score=x", None), (None, None)], "t string, want double")
    assert all(r.want == r.got for r in df.withColumn("got", pools.score_in_text(df.t)).collect())


def test_ignored_and_bought(spark):
    day = lambda n: dt.date(2020, 1, n)
    acts = spark.createDataFrame([("a", day(1), 1, "buy"), ("a", day(2), 2, "ignored"), ("b", day(1), 3, "ignored"), ("b", day(1), 4, "buy")], "symbol string, ts date, id int, kind string")
    pool = pools.drop_ignored(spark.createDataFrame([("a",), ("b",), ("c",)], "symbol string"), acts, ["symbol"], "ts", "id")
    got = {r.symbol: (r.action, r.bought, r.bought_at) for r in pools.with_latest_action(pool, acts, ["symbol"], "ts", "id").collect()}
    assert got == {"b": ("buy", True, day(1)), "c": (None, False, None)}


def test_states_without_trades(spark):
    got = {r.state: (r.n, r.win_rate, r.worst) for r in pools.by_state(spark.createDataFrame([("neutral", 2.0), ("neutral", -1.0)], "s string, v double"), "s", "v").collect()}
    assert got == {"neutral": (2, 50.0, -1.0), "defensive": (0, 0.0, 0.0), "offensive": (0, 0.0, 0.0)}


def test_overlay_and_merge(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, x double")
    quotes = spark.createDataFrame([("a", 0.0), ("b", 5.0)], "k string, x double")
    assert {r.k: r.x for r in pools.overlay(base, quotes, ["k"], ["x"]).collect()} == {"a": 1.0, "b": 5.0, "c": 3.0}
    names = [spark.createDataFrame(rows, "k string, name string") for rows in ([("a", "old"), ("b", "old")], [("a", " "), ("b", "new"), ("c", None)])]
    assert {r.k: r.name for r in pools.merge_dimensions(*names, "k", ["name"]).collect()} == {"a": "old", "b": "new", "c": None}


def risky(spark, n, **other):
    row = {"up_prob": 0.6, "dd_prob": 0.2, "expected_return": 8.0, "edge": 0.0, "profit_factor": 1.0, "total": 60.0, "risk_adjusted": 59.0, "quality": 60.0, "trend": 60.0, "turn": 4.0, "inflow": 1.0, "action": "buy", "date": "d"} | other
    return spark.createDataFrame([row | {"symbol": f"{k:06}"} for k in range(n)])


def test_risk_selection_falls_back_by_date(spark):
    strict, loose = risky(spark, 8), risky(spark, 2, dd_prob=0.3, risk_adjusted=52.0)
    assert pools.risk_selection(strict.union(loose), "low").count() == 8
    assert pools.risk_selection(strict.limit(7).union(loose), "low").count() == 9
    quiet, active = risky(spark, 5), risky(spark, 10, turn=9.0)
    assert pools.risk_selection(quiet.union(active), "high").count() == 10
    assert pools.risk_selection(quiet.union(active.limit(9)), "high").count() == 14
    assert pools.risk_selection(risky(spark, 3, dd_prob=0.43), "medium").count() == 0


def test_growth_boards_by_risk(spark):
    df = risky(spark, 1)
    growth = df.withColumn("symbol", df.symbol.substr(1, 0)).fillna("").replace("", "300001", ["symbol"])
    key = lambda d, risk: d.select(pools.risk_order(risk).alias("k")).head().k
    assert abs(key(df, "low") - key(growth, "low") - 4) < 1e-9 and abs(key(growth, "high") - key(df, "high") - 4) < 1e-9
    assert key(growth, "medium") == key(df, "medium")
