"""Live pick: probabilities, edge and profit factor of every row under every risk profile and strategy.

A profile is a row of values (limits, weights, gates), so one pass over the panel scores all of them: each row meets the
profiles as an array of structs of fixed size, and one expression reads the profile's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bound, or_default, truthy
from .rules import turnover_score

# Fixed values of the profiles, by risk and strategy.
#: risk -> stop, take, largest position, factor of the expected return, gates of edge, profit factor and of a watch's edge
RISKS = {"low": (0.06, 0.10, 8.0, 16.0, 2.6, 1.55, 1.2), "medium": (0.08, 0.14, 10.0, 20.0, 1.8, 1.38, 0.6), "high": (0.10, 0.18, 12.0, 24.0, 1.0, 1.22, 0.2)}
#: (risk, strategy) -> least up and most drawdown probability of a buy, least flow score of a buy, the same probabilities of a watch
LIMITS = {
    ("low", "breakout"): (0.62, 0.26, 45.0, 0.54, 0.34), ("medium", "breakout"): (0.60, 0.30, 0.0, 0.50, 0.40), ("high", "breakout"): (0.56, 0.38, 0.0, 0.47, 0.50),
    ("low", "rebound"): (0.56, 0.30, 0.0, 0.50, 0.36), ("medium", "rebound"): (0.54, 0.35, 0.0, 0.48, 0.42), ("high", "rebound"): (0.52, 0.42, 0.0, 0.47, 0.52),
}
#: (risk, strategy) -> weights of trend, flow, turnover, quality, risk, edge and news
WEIGHTS = {
    ("low", "breakout"): (0.12, 0.14, 0.10, 0.20, 0.18, 0.16, 0.10), ("medium", "breakout"): (0.12, 0.18, 0.10, 0.16, 0.16, 0.18, 0.10), ("high", "breakout"): (0.20, 0.23, 0.13, 0.16, 0.08, 0.10, 0.10),
    ("low", "rebound"): (0.10, 0.12, 0.10, 0.24, 0.26, 0.08, 0.10), ("medium", "rebound"): (0.12, 0.14, 0.10, 0.24, 0.22, 0.08, 0.10), ("high", "rebound"): (0.16, 0.18, 0.13, 0.24, 0.10, 0.09, 0.10),
}
RISK_NAMES = ("stop", "take", "most", "factor", "edge_gate", "pf_gate", "watch_gate")
LIMIT_NAMES = ("buy_up", "buy_dd", "buy_flow", "watch_up", "watch_dd")
PARTS = ("trend", "flow_score", "turnover", "quality", "risk_adjusted", "edge_score", "news_total")


def points(*rules: tuple[float, Column]) -> Column:
    """Sum of the points of the conditions that hold; null is not holding."""
    return sum((F.when(truthy(c), float(p)).otherwise(0.0) for p, c in rules), F.lit(0.0))


#: Numbers of a row that the live pick reads besides ``news_net`` and ``news_total``.
INPUTS = (
    "close", "signal_score", "rsi", "macd_hist", "ma5", "ma10", "ma20", "ma60", "boll_mid", "boll_lower", "volume_ratio_5", "pct_change", "prev_pct_change",
    "return_5d", "return_20d", "from_20d_high_pct", "ma20_gap_pct", "inflow", "turn",
)


def profiles(risks=None, strategies=None) -> Column:
    """The profiles of some or all risks and strategies as an array of structs."""
    rows = []
    for (risk, strategy), limits in LIMITS.items():
        if (risks and risk not in risks) or (strategies and strategy not in strategies):
            continue
        named = dict(zip(RISK_NAMES + LIMIT_NAMES, RISKS[risk] + limits, strict=True)) | {f"w{k}": w for k, w in enumerate(WEIGHTS[risk, strategy])}
        rows.append(F.struct(F.lit(risk).alias("risk"), F.lit(strategy).alias("strategy"), *(F.lit(float(v)).alias(k) for k, v in named.items())))
    return F.array(*rows)


def live_alignment() -> Column:
    """0-4: close at or above the 5, 10 and 20 day averages, the 20 day average at or above the 60 day one."""
    pairs = (("close", "ma5"), ("close", "ma10"), ("close", "ma20"), ("ma20", "ma60"))
    return points(*((1, (F.col(a) >= F.col(b)) & (F.col(b) > 0)) for a, b in pairs)).cast("int")


def situation(df: DataFrame) -> DataFrame:
    """What a row looks like before any profile: conditions and points that all profiles share."""
    c = F.col
    zero = ("inflow", "turn", "pct_change", "prev_pct_change", "return_5d", "return_20d", "from_20d_high_pct", "ma20_gap_pct", "signal_score")
    df = df.withColumns({x: F.coalesce(x, F.lit(0)) for x in zero})
    df = df.withColumns({
        "rsi": or_default("rsi", 50.0), "align": live_alignment(), "vr": F.least(F.coalesce("volume_ratio_5", F.lit(1.0)), F.lit(5.0)), "macd_hist": F.coalesce("macd_hist", F.lit(0.0)),
        "news_net": F.coalesce("news_net", F.lit(0.0)), "news_total": bound(F.coalesce("news_total", F.lit(50.0)), 0, 100),
    })
    df = df.withColumns({
        "near_band": truthy((c("boll_lower") > 0) & (c("close") <= c("boll_lower") * 1.04)), "reclaimed": truthy((c("boll_mid") > 0) & (c("close") >= c("boll_mid") * 0.99)),
        "rebound_day": truthy((c("pct_change") > 0.6) & (c("prev_pct_change") < 0)), "oversold": truthy(c("rsi") <= 35), "repair": truthy(c("macd_hist") >= -0.03),
        "hot": truthy((c("rsi") >= 78) | (c("ma20_gap_pct") >= 10) | (c("return_20d") >= 24) | (c("pct_change") >= 6.5)),
        "broken": truthy((c("return_20d") <= -14) | (c("from_20d_high_pct") <= -22) | ((c("ma20") > 0) & (c("ma60") > 0) & (c("close") < c("ma20") * 0.96) & (c("ma20") < c("ma60")))),
    })
    pullback = points((24, c("oversold")), (18, c("near_band")), (16, c("rebound_day")), (12, c("repair")), (8, c("reclaimed")))
    df = df.withColumn("pullback", pullback)
    r5, r20, high, inflow, pct, turn, vr = (c(x) for x in ("return_5d", "return_20d", "from_20d_high_pct", "inflow", "pct_change", "turn", "vr"))
    between = lambda x, a, b: (x >= a) & (x <= b)
    return df.withColumns({
        "breakout_plus": points((18, c("align") >= 3), (14, between(r20, 1.5, 20)), (10, r5 >= 0), (12, between(high, -2, 4)), (10, between(vr, 0.9, 2.8)), (8, inflow >= 0)),
        "breakout_minus": points((14, pct >= 6.5), (12, r20 >= 28), (8, c("ma20_gap_pct") >= 10), (8, turn >= 18), (6, inflow < -0.3)),
        "rebound_plus": c("pullback") + points((12, between(r20, -14, 6)), (10, between(high, -3, 0)), (8, between(vr, 0.8, 2.2)), (8, inflow >= -0.2)),
        "rebound_minus": points((10, pct >= 7), (8, turn >= 18), (6, inflow < -0.5)),
        "breakout_shape": truthy((c("align") >= 3) & between(r20, -3, 18) & (high >= -10) & (c("ma20_gap_pct") <= 7.5) & (c("rsi") <= 72)),
        "rebound_shape": truthy(between(r20, -18, 8) & (high >= -20) & (c("rsi") <= 48) & (c("rebound_day") | c("reclaimed") | c("repair"))),
    })


def live_pick(df: DataFrame, *, risks=None, strategies=None) -> DataFrame:
    """Every (row, risk, strategy), of some or all risks and strategies, with its action, probabilities, edge, profit factor, scores, notes and trade plan.

    Needs signal_score, rsi, macd_hist, the feature panel, the market ``state``, ``inflow``, ``turn``, ``news_net`` and
    ``news_total`` (null: no news); other numbers that are null count as 0.  Rows that neither buy nor watch are there as ``pass``.
    """
    c = F.col
    df = situation(df).withColumn("_p", F.explode(profiles(risks, strategies))).select("*", "_p.*").drop("_p")
    trend = c("strategy") == "breakout"
    by = lambda a, b: F.when(trend, a).otherwise(b)
    s, inflow, turn, news, pct = c("signal_score").cast("double"), c("inflow"), c("turn"), c("news_net"), c("pct_change")
    up = bound(bound(0.52 + s / 250, 0.05, 0.95) + bound(inflow * 0.012, -0.05, 0.05), 0.05, 0.95)
    dd = bound(bound(0.34 - s / 400, 0.05, 0.90) + F.when(turn > 15, 0.05).when(turn < 1, 0.02).when((turn >= 3) & (turn <= 10), -0.01).otherwise(0.0), 0.05, 0.90)
    df = df.withColumns({"_u": bound(up + bound(news / 500, -0.06, 0.06), 0.05, 0.95), "_d": bound(dd - bound(news / 700, -0.05, 0.05), 0.05, 0.90), "_f": bound(50 + inflow * 8, 0, 100), "_t": turnover_score(turn)})
    # a rebound first takes its probabilities from how far it has pulled back
    back = c("pullback")
    df = df.withColumns({
        "_u": by(c("_u"), bound(c("_u") - 0.08 + back / 180 + bound(inflow * 0.01, -0.04, 0.04), 0.05, 0.95)), "_d": by(c("_d"), bound(c("_d") + 0.05 - back / 220, 0.05, 0.90)),
        "_f": by(c("_f"), bound(c("_f") * 0.7 + back * 0.3, 0, 100)), "_t": by(c("_t"), bound(c("_t") * 0.85 + F.when((turn >= 1) & (turn <= 10), 50).otherwise(36) * 0.15, 0, 100)),
        "_s": by(s * 0.78 + c("breakout_plus") * 0.82 - c("breakout_minus") * 0.55, s * 0.72 + back * 0.75),
    })
    plus, minus = by(c("breakout_plus"), c("rebound_plus")), by(c("breakout_minus"), c("rebound_minus"))
    df = df.withColumns({
        "_u": bound(c("_u") + by(plus / 260 - minus / 520, plus / 340 - minus / 600), 0.05, 0.95), "_d": bound(c("_d") + by(minus / 460 - plus / 420, minus / 500 - plus / 520), 0.05, 0.90),
        "_q": bound(by(56 + c("_s") * 0.16 + plus * 0.40 - minus * 0.32, 58 + c("_s") * 0.12 + plus * 0.28 - minus * 0.22), 0, 100),
    })
    df = df.withColumns({
        "_u": bound(c("_u") + F.when(c("state") == "defensive", -0.03).when(c("state") == "offensive", 0.02).otherwise(0.0), 0.05, 0.95),
        "_d": bound(c("_d") + F.when(c("state") == "defensive", 0.05).when(c("state") == "offensive", -0.03).otherwise(0.0), 0.05, 0.90),
    })
    # gates: (note, penalty, condition); every gate bars a buy, those in BARS_WATCH a watch as well
    gates = [
        ("broken", 24, c("broken")), ("shape", 10, ~by(c("breakout_shape"), c("rebound_shape"))), ("volume", 5, trend & ~truthy((c("vr") >= 0.75) & (c("vr") <= 3.2))),
        ("flow", 6, ~truthy(inflow >= by(F.lit(-0.35), F.lit(-0.6)))), ("hot", 12, trend & c("hot")), ("weak", 12, ~trend & (c("rsi") < 22)), ("news", 6, news <= -18),
    ]
    df = df.withColumns({"penalty": points(*((p, g) for _, p, g in gates)), "notes": F.array_compact(F.array(*(F.when(truthy(g), n) for n, _, g in gates)))})
    p = c("penalty")
    df = df.withColumns({
        "up_prob": bound(F.when(p > 0, bound(c("_u") - p / 380, 0.05, 0.86)).otherwise(c("_u")), 0.05, 0.80), "dd_prob": bound(F.when(p > 0, bound(c("_d") + p / 320, 0.08, 0.90)).otherwise(c("_d")), 0.10, 0.90),
        "_q": F.when(p > 0, bound(c("_q") - p, 0, 100)).otherwise(c("_q")), "_s": c("_s") - p * 0.65,
    })
    # edge: what a unit of capital gains at these probabilities between stop and take
    cost = F.when(inflow < 0, F.least(F.lit(10.0), F.abs(inflow) * 5)).otherwise(0.0) + F.when(turn < 0.8, 6.0).when(turn > 18, F.least(F.lit(10.0), (turn - 18) * 1.2)).otherwise(0.0)
    cost = cost + by(F.when(pct > 6, 6.0).otherwise(0.0), F.when(pct > 8, 4.0).otherwise(0.0))
    gain, loss = c("up_prob") * c("take"), c("dd_prob") * c("stop")
    df = df.withColumns({"edge": c("up_prob") * (c("take") * 100) - c("dd_prob") * (c("stop") * 100), "profit_factor": (gain + 0.005) / (loss + 0.005), "cost": cost})
    df = df.withColumn("edge_score", bound(48 + c("edge") * 6.5 + (c("profit_factor") - 1) * 15 - c("cost"), 0, 100))
    low, high = c("risk") == "low", c("risk") == "high"
    zone = c("oversold") | c("near_band")
    turned = F.when(low, zone & c("repair")).when(high, zone | c("rebound_day")).otherwise(zone & (c("rebound_day") | c("repair")))
    buy = (c("up_prob") >= c("buy_up")) & (c("dd_prob") <= c("buy_dd")) & (c("_f") >= c("buy_flow")) & (trend | turned) & (F.size("notes") == 0)
    watch = (c("up_prob") >= c("watch_up")) & (c("dd_prob") <= c("watch_dd")) & (trend | c("oversold") | c("rebound_day")) & ~F.arrays_overlap("notes", F.array(*map(F.lit, ("broken", "weak"))))
    buy, watch = buy & (c("edge") >= c("edge_gate")) & (c("profit_factor") >= c("pf_gate")), watch & (c("edge") >= c("watch_gate"))
    df = df.withColumns({
        "action": F.when(buy, "buy").when(watch, "watch").otherwise("pass"), "trend": bound(50 + c("_s") * 0.4, 0, 100), "flow_score": bound(c("_f") - c("cost") * 0.35, 0, 100),
        "turnover": bound(c("_t") - c("cost") * 0.25, 0, 100), "quality": bound(c("_q") * 0.68 + c("edge_score") * 0.32, 0, 100), "risk_adjusted": bound(74 - c("dd_prob") * 68 - c("cost") * 0.55, 0, 100),
        "confidence": F.when((c("up_prob") >= 0.68) & (c("dd_prob") <= 0.22), "high").when(c("up_prob") >= 0.55, "medium").otherwise("low"),
        "expected_return": (c("up_prob") - c("dd_prob")) * c("factor"), "stop_price": c("close") * (1 - c("stop")), "take_price": c("close") * (1 + c("take")),
    })
    total = sum((c(part) * c(f"w{k}") for k, part in enumerate(PARTS)), F.lit(0.0))
    position = F.least(c("most"), F.lit(10.0)) * F.when(c("action") == "buy", 1.0).otherwise(0.5)
    inner = ["_u", "_d", "_f", "_t", "_s", "_q", *RISK_NAMES, *LIMIT_NAMES, *(f"w{k}" for k in range(len(PARTS)))]
    out = df.withColumns({"total": bound(total, 0, 100), "position_pct": position}).drop(*inner)
    # as one array element: a filter on the action would else be pushed below all steps, each written out in full
    return out.select(F.explode(F.array(F.struct("*"))).alias("_r")).select("_r.*")
