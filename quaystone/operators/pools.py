"""Pools of ranked rows: ignored rows, risk profiles, evidence by market state, miss counts, text scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from .store import latest_by

#: Market states, weakest first.
STATES = ("defensive", "neutral", "offensive")
# Fixed values by risk: shift of the score threshold, floor of a relaxed one (null: never), least and most rows shown and rows a position.
SHOWN = {"low": (4.0, None, 8, 18, 4), "medium": (0.0, 68.0, 12, 30, 6), "high": (-6.0, 66.0, 20, 40, 8)}


def score_in_text(text: Column) -> Column:
    """Number after ``score=`` in a reason text, null where there is none."""
    return F.regexp_extract(text, r"score=([0-9]+(\.[0-9]+)?)", 1).try_cast("double")


def drop_ignored(pool: DataFrame, actions: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """``pool`` without the rows whose latest action is ``ignored``."""
    gone = latest_by(actions, keys, ts, tie).where("kind = 'ignored'").select(*keys)
    return pool.join(gone, keys, "left_anti")


def with_latest_action(pool: DataFrame, actions: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """``pool`` with ``action`` (kind of the latest action), ``bought`` (any buy at all) and ``bought_at`` (the first)."""
    latest = latest_by(actions, keys, ts, tie).select(*keys, F.col("kind").alias("action"))
    buys = actions.where("kind = 'buy'").groupBy(*keys).agg(F.min(ts).alias("bought_at"))
    out = pool.join(latest, keys, "left").join(buys, keys, "left")
    return out.withColumn("bought", F.col("bought_at").isNotNull())


def bought_after(rows: DataFrame, buys: DataFrame, keys: list[str], date: str, ts: str, days: int) -> DataFrame:
    """``rows`` with ``bought``: whether the same key was bought on the row's date or up to ``days`` days later."""
    b = buys.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.lit(days)), lambda k: F.date_sub(ts, k))).alias(date)).distinct()
    return rows.join(b.withColumn("bought", F.lit(True)), [*keys, date], "left").fillna(False, ["bought"])


def buy_conservatism(rows: DataFrame, keys: list[str], strong: str, value: str) -> DataFrame:
    """Strong rows that were and were not bought, those of ranks up to 10 (``rank_no``) that were not, and the mean result of both."""
    hit, bought = F.col(strong), F.col("bought")
    return rows.groupBy(*keys).agg(
        F.count_if(hit & bought).alias("n_bought"), F.count_if(hit & ~bought).alias("n_unbought"), F.count_if(hit & ~bought & (F.col("rank_no") <= 10)).alias("n_unbought_top10"),
        F.avg(F.when(hit & bought, F.col(value))).alias("bought_avg"), F.avg(F.when(hit & ~bought, F.col(value))).alias("unbought_avg"),
    )


def by_state(trades: DataFrame, state: str, value: str) -> DataFrame:
    """Count, win rate in percent and worst result of each market state; states without trades have a row of zeros."""
    spark = trades.sparkSession
    got = trades.groupBy(F.col(state).alias("state")).agg(
        F.count("*").alias("n"), (F.count_if(F.col(value) > 0) / F.count("*") * 100).alias("win_rate"), F.min(value).alias("worst")
    )
    fixed = spark.createDataFrame([(s,) for s in STATES], "state string")  # three rows
    return fixed.join(got, "state", "left").fillna(0, ["n"]).fillna(0.0, ["win_rate", "worst"])


def overlay(base: DataFrame, quotes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``base`` with each field replaced by the quote's where that is neither null nor 0."""
    q = quotes.select(*keys, *(F.col(c).alias(f"_q_{c}") for c in fields))
    out = base.join(q, keys, "left").withColumns({c: F.coalesce(F.nullif(F.col(f"_q_{c}"), F.lit(0.0)), F.col(c)) for c in fields})
    return out.drop(*(f"_q_{c}" for c in fields))


def merge_dimensions(base: DataFrame, snapshot: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Union of two dimension tables by key; the snapshot's non-blank fields win."""
    s = snapshot.select(key, *(F.col(c).alias(f"_s_{c}") for c in fields))
    out = base.select(key, *fields).join(s, key, "full_outer")
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return out.select(key, *(F.coalesce(blank(f"_s_{c}"), blank(c)).alias(c) for c in fields))


def missing_flags(df: DataFrame, features: list[str]) -> DataFrame:
    """A 0/1 flag per feature that was missing, and the feature filled with 0."""
    flags = {f"{c}_missing": F.col(c).isNull().cast("int") for c in features}
    return df.withColumns(flags).fillna(0.0, features)


def same_metrics(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Whether all metrics of two runs agree within a tolerance, nulls as 0; a key of one run alone does not agree."""
    y = b.select(*keys, F.lit(True).alias("_b"), *(F.col(m).alias(f"_b_{m}") for m in metrics))
    out = a.withColumn("_a", F.lit(True)).join(y, keys, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    near = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for m in metrics:
        near = near & (F.abs(zero(m) - zero(f"_b_{m}")) <= tolerance)
    return out.select(*keys, near.alias("same"))


def portfolio_totals(marked: DataFrame) -> DataFrame:
    """Cost, value, result and result in percent over all open positions; one row."""
    cost, value = F.sum(F.col("avg_cost") * F.col("qty")), F.sum(F.col("price") * F.col("qty"))
    out = marked.agg(F.count("*").alias("n"), F.coalesce(cost, F.lit(0.0)).alias("cost"), F.coalesce(value, F.lit(0.0)).alias("value"))
    return out.withColumn("pnl", F.col("value") - F.col("cost")).withColumn("pnl_pct", F.coalesce(F.try_divide("pnl", "cost"), F.lit(0.0)) * 100)


def recent_kinds(actions: DataFrame, ts: str, tie: str, n: int = 20) -> DataFrame:
    """How often each kind occurs among the newest ``n`` actions (a top-n report)."""
    return actions.orderBy(F.desc(ts), F.desc(tie)).limit(n).groupBy("kind").agg(F.count("*").alias("n"))


def risk_order(risk: str) -> Column:
    """Ranking key of a risk profile over up_prob, dd_prob, expected_return, edge, profit_factor, total, risk_adjusted, quality, trend, turn and inflow.

    Low risk prefers small drawdowns and steady turnover, high risk activity and expected return, medium a balance.
    """
    c = F.col
    growth = F.when(F.substring("symbol", 1, 3).isin("300", "688"), 4.0).otherwise(0.0)
    if risk == "low":
        steady, flow = clamp(100 - F.abs(c("turn") - 4) * 8, 0, 100), clamp(c("inflow") * 8 + 50, 0, 100)
        return (1 - c("dd_prob")) * 34 + c("risk_adjusted") * 0.28 + c("quality") * 0.16 + steady * 0.10 + flow * 0.08 + c("total") * 0.04 - growth
    if risk == "high":
        bonus = F.when(c("action") == "watch", 14.0).otherwise(0.0) + F.when(c("turn") >= 10, 8.0).when(c("turn") >= 8, 4.0).otherwise(0.0) + growth
        gains = c("up_prob") * 22 + c("expected_return") * 1.6 + c("edge") * 2.2 + (c("profit_factor") - 1) * 8
        return gains + clamp(c("turn") * 7.5, 0, 100) * 0.42 + c("trend") * 0.14 + c("total") * 0.06 + bonus - c("dd_prob") * 6
    edge, factor = clamp(50 + c("edge") * 6, 0, 100), clamp(45 + (c("profit_factor") - 1) * 22, 0, 100)
    return c("up_prob") * 20 + (1 - c("dd_prob")) * 20 + edge * 0.28 + factor * 0.14 + c("total") * 0.18


def risk_selection(picks: DataFrame, risk: str) -> DataFrame:
    """The picks of each date that suit a risk profile, with their ``key`` (see ``risk_order``)."""
    return profile_selection(picks.withColumn("risk", F.lit(risk))).drop("risk")


def profile_selection(picks: DataFrame) -> DataFrame:
    """The picks of each date that suit the profile in their column ``risk``, with their ``key`` (see ``risk_order``).

    Low: strict limits, or the loose ones on dates where fewer than 8 meet the strict; high: the active picks
    alone on dates with at least 10 of them.
    """
    c, day = F.col, Window.partitionBy("date", "risk")
    low, high, buy = c("risk") == "low", c("risk") == "high", c("action") == "buy"
    strict = buy & (c("dd_prob") <= 0.24) & (c("risk_adjusted") >= 56) & (c("turn") <= 9) & (c("inflow") >= -0.2)
    loose = buy & (c("dd_prob") <= 0.32) & (c("risk_adjusted") >= 50)
    fits = c("action").isin("buy", "watch") & (c("dd_prob") <= 0.55) & (c("edge") >= 0)
    active = fits & ((c("action") == "watch") | (c("turn") >= 9) | F.substring("symbol", 1, 3).isin("300", "688"))
    out = picks.withColumn("_a", F.coalesce(F.when(low, strict).when(high, active), F.lit(False))).withColumn("_n", F.count_if("_a").over(day))
    wide = F.when(low, (c("_n") < 8) & loose | (c("_n") >= 8) & c("_a")).when(high, (c("_n") < 10) & fits | (c("_n") >= 10) & c("_a")).otherwise(c("dd_prob") <= 0.42)
    key = F.when(low, risk_order("low")).when(high, risk_order("high")).otherwise(risk_order("medium"))
    return out.where(wide).drop("_a", "_n").withColumn("key", key)


def calibrated_scores(picks: DataFrame) -> DataFrame:
    """``picks`` with ``display_score``: raw total, quality of the odds and mid-rank within date and profile, with bonuses and deductions.

    Needs total, up_prob, dd_prob, risk_adjusted, edge, profit_factor, action, confidence, inflow, state.
    """
    c, pool = F.col, Window.partitionBy("date", "risk")
    out = picks.withColumn("_t", F.round(c("total") + 1e-9, 6))
    less, equal = F.rank().over(pool.orderBy("_t")) - 1, F.count("*").over(Window.partitionBy("date", "risk", "_t"))
    relative = 48 + 24 * (less + 0.5 * equal) / F.count("*").over(pool)
    quality = 22 * c("up_prob") + 20 * (1 - c("dd_prob")) + 0.20 * c("risk_adjusted") + 0.24 * clamp(48 + 6.5 * c("edge"), 0, 100) + 0.14 * clamp(45 + 22 * (c("profit_factor") - 1), 0, 100)
    bonus = (
        F.when(c("action") == "buy", 2).otherwise(0) + F.when(c("confidence") == "high", 4).when(c("confidence") == "medium", 2).otherwise(0) + F.when(c("inflow") > 2, 2).when(c("inflow") < -1, -4).otherwise(0)
        + F.when(c("dd_prob") <= 0.20, 1).otherwise(0) - F.when(c("edge") < 0.6, 8).when(c("edge") < 1.5, 3).otherwise(0) - F.when(c("profit_factor") < 1.15, 6).when(c("profit_factor") < 1.30, 2).otherwise(0)
        + F.when(c("state") == "defensive", -2).when(c("state") == "offensive", 1).otherwise(0)
    )
    out = out.withColumns({"_relative": relative, "_quality": quality, "_bonus": bonus})
    return out.withColumn("display_score", clamp(0.34 * c("total") + 0.46 * c("_quality") + 0.20 * c("_relative") + c("_bonus"), 0, 100)).drop("_t", "_relative", "_quality", "_bonus")


def display_pool(picks: DataFrame, *, threshold: float = 70.0, most: int = 24, max_positions: int = 5) -> DataFrame:
    """What a user of each profile sees on each date, with ``rank_no`` and the ``threshold`` that held.

    A defensive market leaves likely buys alone; the profile selects before and after calibration; a threshold shifted by profile
    gives way by 3 points (to its floor at most) where it leaves few rows; the best by the profile's key are shown.
    """
    c = F.col
    calm = ~F.coalesce(c("state") == "defensive", F.lit(False))
    picks = profile_selection(picks).drop("key")
    picks = picks.where(calm | F.when(c("risk") == "high", c("action").isin("buy", "watch") & (c("dd_prob") <= 0.40)).otherwise((c("action") == "buy") & (c("dd_prob") <= 0.30)))
    rows = profile_selection(calibrated_scores(picks)).withColumns({"_s": F.round(c("display_score") + 1e-9, 4), "key": F.round(c("key") + 1e-9, 6)})
    by = lambda f: F.when(c("risk") == "low", f("low")).when(c("risk") == "high", f("high")).otherwise(f("medium"))
    shifted = {r: max(50.0, min(95.0, threshold + v[0])) for r, v in SHOWN.items()}
    eased = {r: None if v[1] is None or shifted[r] > 75 else max(v[1], shifted[r] - 3) for r, v in SHOWN.items()}
    pool = Window.partitionBy("date", "risk")
    rows = rows.withColumns({"_full": by(lambda r: F.lit(shifted[r])), "_eased": by(lambda r: F.lit(eased[r]).cast("double"))})
    rows = rows.withColumns({"_n": F.count_if(c("_s") >= c("_full")).over(pool), "_m": F.count_if(c("_s") >= c("_eased")).over(pool)})
    held = F.when((c("_n") < max(12, min(most, 24))) & c("_eased").isNotNull() & (c("_m") > c("_n")), c("_eased")).otherwise(c("_full"))
    rows = rows.withColumn("threshold", held).where(c("_s") >= c("threshold"))
    rows = rows.withColumn("rank_no", F.row_number().over(pool.orderBy(F.desc("key"), "symbol")))
    cap = by(lambda r: F.lit(max(SHOWN[r][2], min(SHOWN[r][3], max_positions * SHOWN[r][4]))))
    return rows.where(c("rank_no") <= cap).drop("_s", "_full", "_eased", "_n", "_m")
