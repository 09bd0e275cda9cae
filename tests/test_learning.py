"""Models on planted data, rules and contributions against brute force, ranks and quantiles, snapshots, news by dictionaries."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaystone.operators import learning as le
from quaystone.operators import news as nw
from quaystone.operators import ordering as od
from quaystone.operators import snapshots as sn

NAMES = ("a", "b", "c")


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3)) * [1, 5, 2] + [0, 10, -3]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    up = rng.random(4000) < 1 / (1 + np.exp(-(1.5 * z[:, 0] - 0.7 * z[:, 1])))
    dd = rng.random(4000) < 1 / (1 + np.exp(-(-1.0 * z[:, 0] + 0.5 * z[:, 2])))
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=k // 4), *map(float, x[k]), float(up[k]), float(dd[k])) for k in range(4000)]
    return spark.createDataFrame(rows, "date date, a double, b double, c double, label_up double, label_drawdown double").cache()


def test_fitted_model_recovers_planted_coefficients(planted):
    m = le.fitted_model(planted, NAMES).first()
    t = {r.feature: r for r in m.terms}
    assert [t[k].up_coef for k in NAMES] == pytest.approx([1.5, -0.7, 0], abs=0.2) and [t[k].dd_coef for k in NAMES] == pytest.approx([-1, 0, 0.5], abs=0.2)
    assert t["b"].mean == pytest.approx(10, abs=0.5) and t["b"].scale == pytest.approx(5, abs=0.3)
    order = [r.feature for r in le.importance(le.fitted_model(planted, NAMES)).orderBy("pos").collect()]
    assert order[0] == "a" and len(order) == 3


def test_one_class_gives_no_coefficients(planted):
    m = le.fitted_model(planted.limit(200).withColumn("label_up", F.lit(1.0)), NAMES).first()
    assert all(r.up_coef == 0 for r in m.terms) and m.up_bias == 20


def test_correlation_model_and_contributions(planted):
    p = planted.toPandas()
    model = le.correlation_model(planted.withColumn("c", F.lit(4.0)), NAMES)
    t = {r.feature: r for r in model.first().terms}
    assert t["a"].up_coef == pytest.approx(p["a"].corr(p["label_up"])) and t["a"].scale == pytest.approx(p["a"].std(ddof=0)) and (t["c"].up_coef, t["c"].scale) == (0, 1)
    row = planted.where("a > 1").limit(5).withColumn("id", F.monotonically_increasing_id())
    rows = row.collect()
    got = le.ranked_contributions(row, model, ["id"], n=2, features=NAMES).collect()
    for r in rows:
        want = sorted(((round((r[k] - t[k].mean) / t[k].scale * (t[k].up_coef - 0.65 * t[k].dd_coef) + 1e-9, 6) if k != "c" else 0.0, k) for k in NAMES), key=lambda x: (-abs(x[0]), x[1]))[:2]
        mine = sorted((g for g in got if g.id == r.id), key=lambda g: g.pos)
        assert [g.feature for g in mine] == [k for _, k in want] and [g.contribution for g in mine] == pytest.approx([v for v, _ in want], abs=1e-6)
    blend = le.blended_prediction(row.withColumn("amount_yi", F.lit(3.0)), model, features=NAMES).first()
    assert blend.model_edge == pytest.approx((blend.model_up * 0.14 - blend.model_dd * 0.08) * 100)
    assert blend.model_score == pytest.approx(0.42 * min(100, max(0, 50 + 9 * blend.model_edge)) + 28 * (1 - blend.model_dd) + 0.2 * 58 + 1.5)


def test_moments_come_from_one_array_pass(planted):
    """One row a task, not some ninety aggregates over every row; uneven tasks and a large mean lose nothing, a constant has no spread."""
    far = planted.withColumns({"b": F.col("b") + 1e7, "c": F.lit(0.1)}).repartition(7, "date")
    p = far.toPandas()
    got = {r.feature: r for r in le.moments(far, NAMES).collect()}
    for k in ("a", "b"):
        assert got[k].mean == pytest.approx(p[k].mean(), rel=1e-13) and got[k].spread == pytest.approx(p[k].std(ddof=0), rel=1e-9)
        assert got[k].up == pytest.approx(np.cov(p[k], p.label_up, ddof=0)[0, 1], rel=1e-8) and got[k].dd == pytest.approx(np.cov(p[k], p.label_drawdown, ddof=0)[0, 1], rel=1e-8)
    assert got["c"].spread < 1e-9 and got["a"].n == 4000 and got["a"].up_sum == p.label_up.sum()
    assert le.correlation_model(far.where("false"), NAMES).first().n == 0


def test_tree_rules_count_their_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float((a > 5) != (b > 2))) for a, b in zip(rng.integers(0, 10, 1000), rng.integers(0, 5, 1000), strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    rules = le.leaves(le.fit_tree(df, "y", features=("a", "b")), ("a", "b"))
    got = {r.leaf: r for r in le.tree_rules(df, "y", features=("a", "b")).collect()}
    assert len(got) == len(rules) and sum(r.n for r in got.values()) == 1000
    for leaf, path in rules:
        inside = [y for a, b, y in rows if all(({"a": a, "b": b}[n] <= cut) == (op == "<=") for n, op, cut in path)]
        assert got[leaf].n == len(inside) >= 30 and got[leaf].share == pytest.approx(np.mean(inside))
    assert all(r.share in (0.0, 1.0) for r in got.values())  # the planted rule is found whole


def test_walk_forward_is_purged(planted, monkeypatch):
    seen = []

    def spy(train, features, label):
        seen.append(train.agg(F.max("date")).first()[0])
        return None, 0.5

    monkeypatch.setattr(le, "probability_model", spy)
    out = le.walk_forward(planted, "label_up", features=NAMES, gap_days=30)
    first = {r.fold: r.d for r in out.groupBy("fold").agg(F.min("date").alias("d")).collect()}
    assert len(seen) == len(first) == 5 and all((first[k] - seen[k]).days > 30 for k in first)


def test_training_panel_needs_bars(spark):
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=k), 10.0 + k, 10.5 + k, 9.5 + k, 10.0 + k, 100.0, 1e6) for s, n in (("long", 120), ("short", 99)) for k in range(n)]
    p = le.training_panel(spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double, amount double"))
    got = p.toPandas()
    assert set(got.symbol) == {"long"} and len(got) == 120 - 15 and not got.isna().any().any() and len(got.columns) == 2 + 22 + 5
    assert le.training_panel(spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double, amount double"), step=3).count() == 35


@pytest.mark.parametrize("ranges", [2, 7, 256])
def test_ranks_and_quantiles(spark, ranges):
    rng = np.random.default_rng(5)
    rows = [("x", float(v)) for v in rng.integers(0, 40, 900)] + [("y", float(v)) for v in rng.normal(size=333)] + [("z", 2.0)] + [("w", 1.0)] * 50
    df = spark.createDataFrame(rows, "k string, v double")
    p = pd.DataFrame(rows, columns=["k", "v"])
    p["r"] = p.groupby("k").v.rank()
    want = {(r.k, r.v): r.r for r in p.itertuples()}
    assert {(r.k, r.v): r.r for r in od.mean_ranks(df, ["k"], "v", "r", ranges).collect()} == want
    got = {r.k: (r.low, r.mid, r.high) for r in od.exact_quantiles(df.union(spark.createDataFrame([("x", None)], "k string, v double")), ["k"], "v", {"low": 0.1, "mid": 0.5, "high": 0.9}, ranges).collect()}
    for k, g in p.groupby("k"):
        assert got[k] == pytest.approx(tuple(g.v.quantile([0.1, 0.5, 0.9])), abs=1e-12)


# snapshots
COLS = "pick_id string, user_id string, trade_date string, symbol string, name string, strategy_code string, risk_level string, created_at string, snapshot_json string"


def snap(pick, text, symbol="000001", created="1", day="20200102"):
    return (pick, "u", day, symbol, None, "breakout", "low", created, text if text is None or isinstance(text, str) else json.dumps(text))


def test_snapshots(spark, tmp_path):
    full = {
        "rank_no": "3", "score": "71.5", "up_prob": 0.6, "score_breakdown": {"total": 60, "trend": "x"}, "ranking_diagnostics": {"signal_features": {"rsi": "55.5"}}, "evidence_summary": {"state_tag": "neutral"}, "unknown": {"deep": [1]},
        "name": "Own name", "trade_date": "2020-01-02",
    }
    rows = [
        snap("p1", {"score": 1}), snap("p1", full, created="2"), snap("p2", '{"score": 5, "rank_no'), snap("p3", None, "000002"), snap("p4", {"user_action": {"action_type": "buy", "created_at": "t0"}}, "000003"),
        snap("p5", {"score": "n/a", "score_breakdown": {"total": 9}}, "000004"), snap("p6", "[1, 2]", "000005"), snap("p7", {}, "000001"),
    ]
    df = spark.createDataFrame(rows, COLS).withColumn("month", F.lit("2020-01"))
    sn.write_snapshots(df, str(tmp_path / "s"), "month")
    back = sn.read_snapshots(spark, str(tmp_path / "s"), "month")
    assert back.count() == len(rows)
    q = sn.quality(back, ["month"]).first()
    assert (q.n_rows, q.n_replaced, q.n_broken) == (8, 1, 2)
    acts = spark.createDataFrame(
        [(1, "p1", "000001", "paper_buy", "t1"), (2, "p1", "000001", "closed", "t2"), (3, "", "000002", "buy", "t3"), (4, "p5", "000004", "watch", "t4"), (5, "p4", "000003", "watch", "t5")],
        "id long, pick_id string, symbol string, action_type string, created_at string",
    )
    got = {r.pick_id: r for r in sn.candidate_rows(sn.newest_versions(back), acts).collect()}
    p1 = got["p1"]
    assert (p1.rank_no, p1.score, p1.name, p1.trade_date, p1.market_state_tag, p1.factor_total_score, p1.factor_trend, p1.factor_rsi) == (3, 71.5, "Own name", "2020-01-02", "neutral", 60.0, 0.0, 55.5)
    assert p1.was_bought and p1.action_type == "closed" and p1.buy_action_time == "t1"  # a later action does not undo the buy
    assert got["p2"].broken and got["p2"].rank_no == sn.NO_RANK and got["p2"].score == 0 and got["p6"].broken and not got["p3"].broken
    assert not got["p3"].was_bought and got["p3"].action_type is None  # an action without a pick belongs to none
    assert got["p4"].was_bought and got["p4"].buy_action_time == "t0" and got["p4"].action_type == "buy"  # its own action goes first
    assert got["p5"].score == 9 and not got["p5"].was_bought and got["p7"].was_bought and got["p7"].action_type == "closed"  # by symbol
    dates = spark.createDataFrame([("20200102",), ("2020-01-02",), ("2020-01-05",), ("bad",)], "trade_date string")
    assert [str(r.trade_date) for r in sn.snapshot_dates(dates, 2).collect()] == ["2020-01-05", "2020-01-02"]
    pool = sn.latest_pool(sn.pick_history(sn.candidate_rows(sn.newest_versions(back), acts), strategy="breakout", start="2020-01-01", end="2020-12-31"), 2).collect()
    assert [r.pick_id for r in pool] == ["p1", "p2"] and sn.pick_history(sn.candidate_rows(back, acts), risk="high").count() == 0


# news
def test_keyword_hits_and_classes(spark):
    news = spark.createDataFrame([(1, "Gain, GAIN and loss: order!"), (2, None), (3, "nothing here"), (4, "fine; suit profit order")], "doc_id int, text string")
    words = spark.createDataFrame([("gain", 1, None), ("profit", 1, "earnings_notice"), ("loss", -1, "regulatory_risk"), ("order", 0, "business_order"), ("order", 0, "business_order")], "keyword string, sign int, category string")
    got = {r.doc_id: r for r in nw.classify_announcements(nw.keyword_hits(news, words, "doc_id")).collect()}
    assert (got[1].n_positive, got[1].n_negative, got[1].direction, got[1].event_type) == (1, 1, "neutral", "business_order") and got[1].impact == pytest.approx(2 + 1.3 + 0.5)
    assert got[4].event_type == "earnings_notice" and got[4].direction == "positive" and got[4].keywords == ["order", "profit"]
    assert got[2].impact == got[3].impact == 2.0 and got[2].event_type == "announcement" and got[3].keywords == []


def test_announcements_and_industries(spark):
    items = spark.createDataFrame([(" Annual <b>report</b> ", "1577836800000", "/f/1.pdf", 1, "One"), (None, "x", None, None, None), ("Other", "bad", "https://e/x", 2, None)], "announcementTitle string, announcementTime string, adjunctUrl string, secCode int, secName string")
    got = nw.announcements(items, "https://files.example/").orderBy("title").collect()
    assert [r.url for r in got] == ["https://files.example/f/1.pdf", "https://e/x"] and got[0].symbol == "1" and str(got[0].publish_time).startswith("2020-01-01") and got[1].publish_time is None
    tags = spark.createDataFrame([(1, ["steel", "car"]), (2, ["carpet making"]), (3, []), (4, None)], "doc_id int, tags array<string>")
    industries = spark.createDataFrame([("carpet",), ("steelworks",), ("",), ("tea",)], "industry string")
    assert {tuple(r) for r in nw.events_of_industries(tags, industries, "doc_id").collect()} == {("carpet", 1), ("steelworks", 1), ("carpet", 2)}
    known = spark.createDataFrame([("steel",)], "tag string")
    only = nw.events_of_industries(tags, industries, "doc_id", known=known)
    assert {tuple(r) for r in only.collect()} == {("steelworks", 1)}
    plan = only._jdf.queryExecution().analyzed().toString()
    assert plan.count("LogicalRDD") == 1 and "collect_set" not in plan  # the events are read once, the matches from their own file


def test_listing_layouts(spark):
    html = """<ul><li><a href="/20210305123/a.html">First long title</a></li><li><a href='rel/b.html' >Second &amp; long title</a> 2021年3月7日</li><li><a href="/c" title="A title attribute">x</a><i>2021.1.9</i></li>
    <li><a href="javascript:void(0)">Script link title</a></li><li><a href="#x">Anchor link title</a></li><li><a href="/d">short</a></li><li><a href="/e">First long title</a></li></ul>
    <table><tr><td><a href="http://o.example/202104/e">Month in address</a></td></tr></table><dl><dd><a href="/f">No date anywhere</a></dd></dl>"""
    pages = spark.createDataFrame([(1, "https://s.example/list/index.html", html), (2, "https://s.example", None), (3, None, "<li><a href='/x'>Page without url</a></li>")], "page_id int, url string, html string")
    got = {(r.page_id, r.title): (r.href, r.date and str(r.date)) for r in nw.listing_items(pages).collect()}
    assert got == {
        (1, "First long title"): ("https://s.example/20210305123/a.html", "2021-03-05"), (1, "Second & long title"): ("https://s.example/list/rel/b.html", "2021-03-07"), (1, "A title attribute"): ("https://s.example/c", "2021-01-09"),
        (1, "Month in address"): ("http://o.example/202104/e", "2021-04-01"), (1, "No date anywhere"): ("https://s.example/f", None), (3, "Page without url"): (None, None),
    }
