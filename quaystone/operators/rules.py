"""Rule scorers: CASE trees over indicator columns, with reasons as stable codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bound, clamp, or_default, truthy


def signal_score(df: DataFrame) -> DataFrame:
    """Score from MACD, RSI, KDJ, averages and bands; null and 0 count as missing."""
    v = {c: or_default(c, 50.0) for c in ("rsi", "kdj_k", "kdj_d", "kdj_j")}
    z = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("macd", "macd_signal", "macd_hist", "ma5", "ma10", "ma20", "ma60", "boll_upper", "boll_lower")}
    above = z["macd"] > z["macd_signal"]
    macd = F.when(z["macd_hist"] > 0, F.when(above, 20).otherwise(10)).otherwise(F.when(z["macd"] < z["macd_signal"], -20).otherwise(-10))
    rsi = F.when(v["rsi"] > 70, -15).when(v["rsi"] < 30, 15).otherwise(0)
    kd = F.when((v["kdj_k"] > v["kdj_d"]) & (v["kdj_k"] > 50), 15).when((v["kdj_k"] < v["kdj_d"]) & (v["kdj_k"] < 50), -15).otherwise(0)
    j = F.when(v["kdj_j"] > 100, -10).when(v["kdj_j"] < 0, 10).otherwise(0)
    has_ma = (z["ma5"] != 0) & (z["ma10"] != 0) & (z["ma20"] != 0) & (z["ma60"] != 0)
    bull = (F.col("close") > z["ma5"]) & (z["ma5"] > z["ma10"]) & (z["ma10"] > z["ma20"])
    bear = (F.col("close") < z["ma5"]) & (z["ma5"] < z["ma10"]) & (z["ma10"] < z["ma20"])
    ma = F.when(has_ma & bull, 20).when(has_ma & bear, -20).otherwise(0)
    has_band = (z["boll_upper"] != 0) & (z["boll_lower"] != 0)
    band = F.when(has_band & (F.col("close") > z["boll_upper"]), 5).when(has_band & (F.col("close") < z["boll_lower"]), 10).otherwise(0)
    out = df.withColumn("signal_score", (macd + rsi + kd + j + ma + band).cast("int"))
    s = F.col("signal_score")
    label = F.when(s > 40, "strong_buy").when(s > 20, "buy").when(s > 0, "lean_buy").when(s > -20, "hold").when(s > -40, "sell").otherwise("strong_sell")
    codes = F.array_compact(F.array(F.when(macd > 0, "macd_up"), F.when(rsi > 0, "oversold"), F.when(rsi < 0, "overbought"), F.when(kd > 0, "kd_up"), F.when(ma > 0, "ma_bull"), F.when(ma < 0, "ma_bear")))
    return out.withColumns({"signal": label, "trend_up": s > 0, "signal_codes": codes})


def technical_score(df: DataFrame) -> DataFrame:
    """0-100: trend 40, resonance 35, pattern 25."""
    v = {c: or_default(c, 50.0) for c in ("rsi", "kdj_k", "kdj_d")}
    z = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("macd", "macd_signal", "macd_hist", "ma5", "ma10", "ma20", "boll_upper", "boll_lower")}
    trend = F.when(z["macd_hist"] > 0, F.when(z["macd"] > z["macd_signal"], 15).otherwise(8)).otherwise(F.when(z["macd"] < z["macd_signal"], 0).otherwise(3))
    has = (z["ma5"] != 0) & (z["ma10"] != 0) & (z["ma20"] != 0)
    stack = F.when(~has, 0).when((F.col("close") > z["ma5"]) & (z["ma5"] > z["ma10"]) & (z["ma10"] > z["ma20"]), 25).when(
        (F.col("close") < z["ma5"]) & (z["ma5"] < z["ma10"]) & (z["ma10"] < z["ma20"]), 0
    ).otherwise(10)
    rsi = F.when((v["rsi"] >= 40) & (v["rsi"] <= 60), 15).when(v["rsi"] < 30, 20).when(v["rsi"] > 70, 5).otherwise(10)
    kd = F.when((v["kdj_k"] > v["kdj_d"]) & (v["kdj_k"] > 50), 20).when((v["kdj_k"] < v["kdj_d"]) & (v["kdj_k"] < 50), 0).otherwise(10)
    bands = (z["boll_upper"] != 0) & (z["boll_lower"] != 0)
    pattern = F.when(~bands, 0).when(F.col("close") < z["boll_lower"], 25).when(F.col("close") > z["boll_upper"], 10).otherwise(15)
    raw = trend + stack + rsi + kd + pattern
    return df.withColumns({"technical_score": F.least(raw, F.lit(100)).cast("int"), "technical_trend_up": raw > 60})


def composite(technical: Column, flow: Column, fundamental: Column, valuation: Column) -> Column:
    return 0.35 * technical + 0.30 * flow + 0.25 * fundamental + 0.10 * valuation


def rating(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 75, "B").when(score >= 65, "C").when(score >= 55, "D").otherwise("E")


def turnover_score(t: Column, steps=((2, 45, 6, 0), (8, 60, 4, 2), (15, 84, -2, 8), (None, 70, -3, 15))) -> Column:
    """Piecewise linear: up to ``limit``, base + slope x (t - from)."""
    out = None
    for limit, base, slope, start in steps:
        value = base + slope * (t - start)
        out = F.when(t <= limit, value) if out is None else out.when(t <= limit, value) if limit is not None else out.otherwise(value)
    return clamp(out, 0, 100)


#: Breaks of the screening pre-score.
PRESCORE_STEPS = ((2, 45, 6, 0), (10, 57, 3.5, 2), (20, 85, -2, 10), (None, 65, -2, 20))
#: Stop, take, positions, buy (up, dd, flow) and watch (up, dd) limits by risk level, breakout strategy.
RISK = {"low": (0.06, 0.10, 8, 0.62, 0.26, 45.0, 0.54, 0.34), "medium": (0.08, 0.14, 10, 0.60, 0.30, 0.0, 0.50, 0.40), "high": (0.10, 0.18, 12, 0.56, 0.38, 0.0, 0.47, 0.50)}
WEIGHTS = {"low": (0.20, 0.15, 0.10, 0.20, 0.35), "medium": (0.25, 0.20, 0.10, 0.20, 0.25), "high": (0.30, 0.25, 0.15, 0.20, 0.10)}


def with_activity(df: DataFrame) -> DataFrame:
    """``df`` with the inflow and turnover that its volume and move imply."""
    vr, pct = F.col("volume_ratio_20"), F.col("pct_change")
    return df.withColumns({"inflow": clamp((vr - 1) * 1.8 + 0.08 * pct, -5, 5), "turn": clamp(2 + 2.5 * vr + 0.35 * F.abs(pct), 0.3, 25)})


def historical_pick(df: DataFrame, risk: str = "medium") -> DataFrame:
    """Breakout scorer for every (symbol, date): probabilities, penalties, action, five-part total.

    Needs signal_score, rsi, the feature panel and the market ``state``; rows that neither buy nor watch stay
    as ``pass`` so that callers choose.
    """
    s, vr, pct = F.col("signal_score").cast("double"), F.col("volume_ratio_20"), F.col("pct_change")
    df = with_activity(df)
    inflow, turn = F.col("inflow"), F.col("turn")
    state = F.col("state")
    up = clamp(0.52 + s / 250, 0.05, 0.95) + clamp(0.012 * inflow, -0.05, 0.05) + F.when(state == "defensive", -0.03).when(state == "offensive", 0.02).otherwise(0.0)
    dd = clamp(0.34 - s / 400, 0.05, 0.90) + F.when(turn > 15, 0.05).when(turn < 1, 0.02).when((turn >= 3) & (turn <= 10), -0.01).otherwise(0.0)
    dd = dd + F.when(state == "defensive", 0.05).when(state == "offensive", -0.03).otherwise(0.0)
    rsi = or_default("rsi", 50.0)
    stretch, r20, high = F.col("ma20_gap_pct"), F.col("return_20d"), F.col("from_20d_high_pct")
    hot = truthy((rsi >= 78) | (stretch >= 10) | (r20 >= 24) | (pct >= 6.5))
    broken = truthy((r20 <= -14) | (high <= -22) | ((F.col("close") < 0.96 * F.col("ma20")) & (F.col("ma20") < F.col("ma60"))))
    structure = truthy((F.col("ma_alignment") >= 3) & r20.between(-3, 18) & (high >= -10) & (stretch <= 7.5) & (rsi <= 72))
    volume = truthy(vr.between(0.75, 3.2))
    penalty = F.when(broken, 24).otherwise(0) + F.when(structure, 0).otherwise(10) + F.when(volume, 0).otherwise(5) + F.when(inflow >= -0.35, 0).otherwise(6) + F.when(hot, 12).otherwise(0)
    df = df.withColumns({"_up": up, "_dd": dd, "penalty": penalty, "broken": broken, "_gate": structure & volume & (inflow >= -0.35) & ~hot & ~broken})
    p = F.col("penalty")
    df = df.withColumns({
        "up_prob": F.when(p > 0, bound(F.col("_up") - p / 380, 0.05, 0.86)).otherwise(F.col("_up")), "dd_prob": F.when(p > 0, bound(F.col("_dd") + p / 320, 0.08, 0.90)).otherwise(F.col("_dd")),
        "_s": s - 0.65 * p,
    })
    df = df.withColumns({"up_prob": bound(F.col("up_prob"), 0.05, 0.80), "dd_prob": bound(F.col("dd_prob"), 0.10, 0.90)})
    stop, take, _, b_up, b_dd, b_flow, w_up, w_dd = RISK[risk]
    flow = bound(50 + 8 * inflow, 0, 100)
    buy = (F.col("up_prob") >= b_up) & (F.col("dd_prob") <= b_dd) & (flow >= b_flow) & F.col("_gate")
    watch = (F.col("up_prob") >= w_up) & (F.col("dd_prob") <= w_dd) & ~F.col("broken")
    w = WEIGHTS[risk]
    total = w[0] * clamp(50 + 0.4 * F.col("_s"), 0, 100) + w[1] * flow + w[2] * turnover_score(turn) + w[3] * clamp(58 + 0.2 * F.col("_s"), 0, 100) + w[4] * bound(72 - 65 * F.col("dd_prob"), 0, 100)
    edge = {"low": 16, "medium": 20, "high": 24}[risk]
    return df.withColumns({
        "action": F.when(buy, "buy").when(watch, "watch").otherwise("pass"), "total": total, "expected_return": (F.col("up_prob") - F.col("dd_prob")) * edge,
        "confidence": F.when((F.col("up_prob") >= 0.68) & (F.col("dd_prob") <= 0.22), "high").when(F.col("up_prob") >= 0.55, "medium").otherwise("low"),
        "stop_price": F.col("close") * (1 - stop), "take_price": F.col("close") * (1 + take),
    }).drop("_up", "_dd", "_s", "_gate")


def relative_scores(df: DataFrame) -> DataFrame:
    """Mid-rank percentile of total within its date, and the calibrated display score (edge 0, profit factor 1)."""
    w = Window.partitionBy("date")
    df = df.withColumn("_t", F.round(F.col("total") + 1e-9, 6))
    less = F.rank().over(w.orderBy("_t")) - 1
    equal = F.count("*").over(Window.partitionBy("date", "_t"))
    df = df.withColumn("mid_rank", (less + 0.5 * equal) / F.count("*").over(w))
    risk = bound(72 - 65 * F.col("dd_prob"), 0, 100)
    quality = 0.22 * 100 * F.col("up_prob") + 0.20 * 100 * (1 - F.col("dd_prob")) + 0.20 * risk + 0.24 * 48 + 0.14 * 45
    bonus = (
        F.when(F.col("action") == "buy", 2).otherwise(0) + F.when(F.col("confidence") == "high", 4).when(F.col("confidence") == "medium", 2).otherwise(0)
        + F.when(F.col("inflow") > 2, 2).when(F.col("inflow") < -1, -4).otherwise(0) + F.when(F.col("dd_prob") <= 0.20, 1).otherwise(0) - 8 - 6
        + F.when(F.col("state") == "defensive", -2).when(F.col("state") == "offensive", 1).otherwise(0)
    )
    return df.withColumn("display_score", clamp(0.34 * F.col("total") + 0.46 * quality + 0.20 * (48 + 24 * F.col("mid_rank")) + bonus, 0, 100)).drop("_t")


def screen(snapshot: DataFrame, *, min_price=5.0, min_amount=1e4, max_pct=9.5, per_industry=3, target=40) -> DataFrame:
    """Filter, pre-score, top-N per industry, top-N overall (per date)."""
    t, pct = F.col("turnover_inferred"), F.col("pct_change")
    kept = snapshot.where((F.col("close") >= min_price) & (F.col("amount") >= min_amount) & (F.abs(pct) <= max_pct))
    liquidity = F.least(F.lit(100.0), F.col("amount_yi") * 6 * 1e4)
    momentum = 12 - F.abs(pct - 2.5)
    inside = F.coalesce(F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5)) * 10
    score = F.round(0.5 * turnover_score(t, PRESCORE_STEPS) + 0.3 * liquidity + momentum + inside + 1e-9, 4)
    kept = kept.withColumn("prescore", score)
    w = Window.partitionBy("date", "industry").orderBy(F.desc("prescore"), "symbol")
    kept = kept.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= per_industry)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("prescore"), "symbol"))).where(F.col("pos") <= target).drop("_i")


def contributions(df: DataFrame, names: list[str], weights: dict[str, float], key: list[str], n: int = 5) -> DataFrame:
    """Top ``n`` positive and negative weighted factor values of each row."""
    each = F.array(*(F.struct((F.coalesce(F.col(c), F.lit(0.0)) * weights[c]).alias("v"), F.lit(c).alias("factor")) for c in names))
    order = lambda sign: F.slice(F.array_sort(F.filter(each, lambda x: x.v * sign > 0), lambda a, b: F.when(a.v * sign > b.v * sign, -1).when(a.v * sign < b.v * sign, 1).otherwise(F.when(a.factor < b.factor, -1).otherwise(1))), 1, n)
    return df.select(*key, order(1).alias("positive"), order(-1).alias("negative"))
