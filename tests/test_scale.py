"""Plans that must not grow: what is joined, carried and scored no more than needed."""

import datetime as dt

from quaystone.operators import live
from quaystone.plans import q_live, q_rules

DATA = "/root/testdata/sf0.001"


def test_live_panel_carries_only_what_the_pick_reads(spark):
    assert set(q_live.live_panel(spark, DATA).columns) == {"symbol", "date", "state", "news_net", "news_total", *live.INPUTS}


def test_state_goes_to_the_bars(spark):
    plan = q_rules.signal_panel(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_live_pick_of_some_profiles(spark):
    row = {c: 1.0 for c in live.INPUTS} | {"symbol": "000001", "date": dt.date(2020, 1, 2), "state": "neutral", "news_net": 0.0, "news_total": 50.0}
    df = spark.createDataFrame([row])
    every = {(r.risk, r.strategy): r for r in live.live_pick(df).collect()}
    some = live.live_pick(df, risks=("medium",), strategies=("breakout",)).collect()
    assert len(every) == 6 and some == [every["medium", "breakout"]]
