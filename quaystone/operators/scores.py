"""Factor scores, user-profile decisions, advice levels, pool selection and calibration lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trades import calibration


def steps(x: Column, limits: list[tuple[float, int]], otherwise: int) -> Column:
    """Value of the first limit that ``x`` exceeds."""
    out = F.when(x > limits[0][0], limits[0][1])
    for limit, value in limits[1:]:
        out = out.when(x > limit, value)
    return out.otherwise(otherwise)


def flow_score(main_net: Column, control: Column, strong: Column) -> Column:
    """0-100 from direction and size of the main flow, persistence and share of large orders."""
    inflow = main_net > 0
    size = F.when(inflow, steps(control, [(10, 50), (5, 35)], 20)).otherwise(steps(control, [(10, 0), (5, 10)], 15))
    keeps = F.when(inflow, F.when(strong, 30).otherwise(20)).otherwise(F.when(strong, 0).otherwise(10))
    return F.least(F.lit(100), size + keeps + steps(control, [(15, 20), (10, 15), (5, 10)], 5))


def flow_signal(main_net: Column, control: Column, strong: Column) -> tuple[Column, Column]:
    base = steps(control, [(10, 30), (5, 20)], 10)
    s = F.when(main_net > 0, base).otherwise(-base) + F.when(strong & (main_net > 0), 15).when(strong & (main_net < 0), -15).otherwise(0)
    label = F.when(s > 30, "strong_bull").when(s > 15, "bull").when(s > 0, "lean_bull").when(s > -15, "lean_bear").when(s > -30, "bear").otherwise("strong_bear")
    return s, label


def fundamental_score(roe: Column, revenue: Column, profit: Column) -> Column:
    """Profitability 40, growth 35, quality 25; a zero return on equity counts as missing."""
    earns = F.when(roe == 0, 0).otherwise(steps(roe, [(20, 40), (15, 30), (10, 20)], 10))
    grows = steps(revenue, [(20, 20), (10, 15), (0, 10)], 0) + steps(profit, [(20, 15), (10, 10), (0, 5)], 0)
    quality = F.when((roe > 15) & (revenue > 10), 25).when((roe > 10) & (revenue > 5), 15).otherwise(10)
    return F.least(F.lit(100), earns + grows + quality)


def valuation_score(pe: Column, pb: Column) -> Column:
    cheap = F.when(pe == 0, 0).when(pe < 15, 50).when(pe < 25, 35).when(pe < 40, 20).otherwise(10)
    book = F.when(pb == 0, 0).when(pb < 2, 30).when(pb < 4, 20).when(pb < 6, 10).otherwise(5)
    return F.least(F.lit(100), cheap + book + 15)


#: User profiles: multiplier of the score, base position, stop; and by holding period: multiplier, take above and below a score of 30.
RISK = {"low": (0.7, 0.3, 0.05), "medium": (1.0, 0.5, 0.08), "high": (1.3, 0.7, 0.10)}
PERIOD = {"short": (0.8, 0.08, 0.05), "medium": (1.0, 0.15, 0.10), "long": (1.2, 0.25, 0.18)}


def profiles(spark) -> DataFrame:
    """All nine user profiles as a parameter table."""
    rows = [(r, p, *RISK[r], *PERIOD[p]) for r in RISK for p in PERIOD]
    return spark.createDataFrame(rows, "risk_level string, period string, risk_k double, base double, stop double, period_k double, take_hi double, take_lo double")


def decide(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Decision, position share and price levels of every row for every profile (nine rows, broadcast)."""
    flow = F.when(F.col("main_net") > 0, steps(F.col("control_ratio"), [(10, 40), (5, 25)], 10)).otherwise(-steps(F.col("control_ratio"), [(10, 40), (5, 25)], 10))
    flow = F.greatest(F.lit(-100.0), F.least(F.lit(100.0), flow * F.when(F.col("strength") == "strong", 1.2).otherwise(1.0)))
    d = df.crossJoin(F.broadcast(profile)).withColumn("decision_score", (0.6 * F.col("signal_score") + 0.4 * flow) * F.col("risk_k") * F.col("period_k"))
    s = F.round(F.col("decision_score") + 1e-9, 6)
    label = (
        F.when(s >= 50, "strong_buy").when(s >= 25, "buy").when(s >= 10, "careful_buy").when(s >= -10, "hold").when(s >= -25, "careful_sell").when(s >= -50, "sell").otherwise("strong_sell")
    )
    b = F.col("base")
    share = F.when(s >= 50, F.least(b * 1.5, F.lit(0.8))).when(s >= 25, b * 1.2).when(s >= 10, b * 0.8).when(s >= 0, b * 0.5).otherwise(0.0)
    return d.withColumns({
        "decision": label, "position": share, "take_price": F.col("close") * (1 + F.when(s > 30, F.col("take_hi")).otherwise(F.col("take_lo"))), "stop_price": F.col("close") * (1 - F.col("stop")),
    })


def relaxed_selection(picks: DataFrame, score: str, *, threshold=60.0, need=5, step=3.0, floor=50.0) -> DataFrame:
    """Rows of each date above the threshold; a date with too few lowers it step by step to the floor."""
    tries = [threshold - step * i for i in range(int((threshold - floor) / step) + 1)]
    w = Window.partitionBy("date")
    out = picks
    for i, t in enumerate(tries):
        out = out.withColumn(f"_c{i}", F.count_if(F.col(score) >= t).over(w))
    chosen = F.lit(tries[-1])
    for i, t in reversed(list(enumerate(tries))):
        chosen = F.when(F.col(f"_c{i}") >= need, t).otherwise(chosen)
    return out.withColumn("threshold", chosen).where(F.col(score) >= F.col("threshold")).drop(*(f"_c{i}" for i in range(len(tries))))


def recalibrated(picks: DataFrame, history: DataFrame, edges=(40.0, 50.0, 55.0, 60.0, 65.0)) -> DataFrame:
    """Probability blended with the win rate of its score bucket where that bucket is calibrated (six rows, broadcast)."""
    table = calibration(history, edges).select("bucket", "calibrated", F.try_divide("wins", "n").alias("win_rate"))
    b = sum(((F.col("score") >= e).cast("int") for e in edges), F.lit(0))
    out = picks.withColumn("bucket", b).join(F.broadcast(table), "bucket", "left")
    return out.withColumn("up_calibrated", F.when(F.col("calibrated"), 0.4 * F.col("up_prob") + 0.6 * F.col("win_rate")).otherwise(F.col("up_prob")))
