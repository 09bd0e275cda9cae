"""What to tell a user about a pick: its grade, a decision that agrees with the pool, and entry, stop and add-on advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import truthy

# Fixed values.
#: grade -> least total, up probability, edge and profit factor, most drawdown probability of a buy
GRADES = {"A": (86, 0.66, 2.2, 1.35, 0.24), "B": (76, 0.58, 1.0, None, 0.34)}
WATCH_TOTAL, LOW_RISK_DD = 66, 0.28
PERIODS = {"short": (0.8, 0.6, 8.0), "medium": (1.0, 0.8, 15.0), "long": (1.2, 1.0, 25.0)}
RISKS = {"low": (0.7, 5.0), "medium": (1.0, 8.0), "high": (1.3, 10.0)}
#: action of a pool row -> what the decision is called
ACTIONS = {"buy": "buy", "paper_validate": "simulate", "watch": "watch", "added_watchlist": "watch", "ignored": "not_now", "closed": "manage_position"}


def pick_grade(picks: DataFrame) -> DataFrame:
    """``picks`` with grade, executable and mode (real_allowed, paper_only, watch_only).

    Needs action, total, up_prob, dd_prob, edge, profit_factor, state, risk and ``live_ready`` (whether the strategy's run passed its gates).
    A defensive market takes A down to B; for a low risk profile a likely drawdown leaves only C.
    """
    c = F.col
    meets = lambda g: truthy(
        (c("action") == "buy") & (c("total") >= GRADES[g][0]) & (c("up_prob") >= GRADES[g][1]) & (c("edge") >= GRADES[g][2]) & (F.lit(True) if GRADES[g][3] is None else c("profit_factor") >= GRADES[g][3]) & (c("dd_prob") <= GRADES[g][4])
    )
    first = F.when(meets("A"), "A").when(meets("B"), "B").when(truthy((c("action") == "watch") | (c("total") >= WATCH_TOTAL)), "C").otherwise("D")
    out = picks.withColumn("_g", first).withColumn("_g", F.when((c("_g") == "A") & truthy(c("state") == "defensive"), "B").otherwise(c("_g")))
    out = out.withColumn("grade", F.when(truthy((c("risk") == "low") & (c("dd_prob") > LOW_RISK_DD)) & c("_g").isin("A", "B"), "C").otherwise(c("_g"))).drop("_g")
    out = out.withColumn("executable", c("grade").isin("A", "B"))
    return out.withColumn("mode", F.when(c("executable") & truthy(c("live_ready")), "real_allowed").when(c("executable"), "paper_only").otherwise("watch_only"))


def confidence(score: Column) -> Column:
    size = F.abs(score)
    return F.when(size >= 50, "high").when(size >= 25, "medium").otherwise("low")


def aligned_decision(symbols: DataFrame, pool: DataFrame) -> DataFrame:
    """Every symbol with the decision of its pool row, so that a detail page never disagrees with the pool; ``not_in_pool`` without one.

    ``pool``: one row a symbol with action, grade, total, trend, flow_score, dd_prob, up_prob, expected_return, position_pct, take_price and stop_price.
    """
    p = pool.select("symbol", F.lit(True).alias("in_pool"), "action", "grade", "total", F.col("trend").alias("technical"), F.col("flow_score").alias("money"), "dd_prob", "up_prob", "expected_return", "position_pct", "take_price", "stop_price")
    out = symbols.join(p, "symbol", "left").withColumn("in_pool", F.coalesce("in_pool", F.lit(False)))
    label = F.coalesce(F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))[F.col("action")], F.lit("watch"))
    sure = F.when(F.col("grade").isin("A", "S"), "high").when(F.col("grade") == "B", "medium").when(F.col("grade").isin("C", "D"), "low").when(F.col("total").isNull(), "low").otherwise(confidence(F.col("total")))
    risk = F.when(~F.col("in_pool"), "high").when((F.col("action") == "buy") & (F.col("dd_prob") <= 0.25), "low").when(F.col("dd_prob") >= 0.4, "raised").otherwise("medium")
    return out.withColumns({
        "decision": F.when(F.col("in_pool"), label).otherwise("not_in_pool"), "confidence": sure, "risk_level": risk, "position_pct": F.coalesce("position_pct", F.lit(0.0)),
        "probability_pct": F.when(F.col("up_prob").between(0, 1), F.col("up_prob") * 100).otherwise(F.col("up_prob")),
    })


def advice(signals: DataFrame, target_return: float = 12.0) -> DataFrame:
    """Entry, take-profit, stop and add-on advice of every (row, risk level, period), nine a row; warnings as codes.

    Needs signal_score and close; a missing score counts as 0.
    """
    users = [F.struct(F.lit(r).alias("risk_level"), F.lit(p).alias("period"), *(F.lit(float(v)).alias(n) for n, v in zip(("_rk", "_stop", "_pk", "_share", "_most"), RISKS[r] + PERIODS[p], strict=True))) for r in RISKS for p in PERIODS]
    out = signals.withColumn("_u", F.explode(F.array(*users))).select("*", "_u.*").drop("_u")
    out = out.withColumn("adjusted", F.round(F.coalesce("signal_score", F.lit(0)) * F.col("_pk") * F.col("_rk") + 1e-9, 6))
    s, close = F.col("adjusted"), F.col("close")
    warnings = F.array_compact(F.array(F.when(s < 0, "bearish"), F.when(F.col("period") == "short", "short_term"), F.when(F.col("risk_level") == "high", "high_risk")))
    take = F.least(target_return * F.col("_share"), F.col("_most"))
    return out.withColumns({
        "entry": F.when(s > 30, "build").when(s > 10, "careful").otherwise("wait"), "entry_low_pct": F.when(s > 30, 30).when(s > 10, 20).otherwise(0), "entry_high_pct": F.when(s > 30, 50).when(s > 10, 30).otherwise(0),
        "entry_price": F.when(s > 30, close).when(s > 10, close * 0.97), "take_pct": take, "take_price": close * (1 + take / 100), "stop_price": close * (1 - F.col("_stop") / 100),
        "add_on": F.when(s > 40, "on_breakout").when(s > 20, "on_pullback").otherwise("none"), "add_high_pct": F.when(s > 40, 20).when(s > 20, 15).otherwise(0), "warnings": warnings,
    }).drop("_rk", "_stop", "_pk", "_share", "_most")
