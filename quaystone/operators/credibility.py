"""Credibility of a run and what to change in it: ramps, gates and rules are rows of data, evaluated as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp

# What each dimension is made of, as (weight, column, value at 0 points, value at 100 points).
SAMPLE = ((0.45, "n_trades", 0, 120), (0.35, "n_days", 0, 540), (0.20, "n_symbols", 0, 180))
RISK_RETURN = ((0.30, "sharpe", 0, 1.8), (0.25, "max_drawdown", 0.30, 0), (0.20, "win_rate", 0.45, 0.65), (0.15, "profit_loss_ratio", 0, 2), (0.10, "annual_return", -0.05, 0.30))
STABILITY = ((0.45, "month_positive", 0.40, 0.75), (0.35, "month_vol", 0.09, 0), (0.20, "state_dispersion", 0.16, 0))
#: Weights of sample, risk and return, stability, data and execution.
DIMENSIONS = (("sample", 0.24), ("risk_return", 0.28), ("stability", 0.20), ("data", 0.18), ("execution", 0.10))
GRADES = ((85, "A"), (72, "B"), (60, "C"))
#: (gate, whether the limit is a least or a most, limit)
GATES = (
    ("n_trades", ">=", 80), ("n_days", ">=", 360), ("n_symbols", ">=", 120), ("sharpe", ">=", 1.0), ("max_drawdown", "<=", 0.20), ("win_rate", ">=", 0.54),
    ("profit_loss_ratio", ">=", 1.35), ("month_positive", ">=", 0.55), ("n_months", ">=", 9), ("score", ">=", 80),
)


def ramp(x: Column, zero: float, full: float) -> Column:
    """0 at ``zero``, 100 at ``full``, straight between, in either direction."""
    return clamp((x - zero) / (full - zero) * 100, 0, 100)


def weighted(parts) -> Column:
    return sum((w * ramp(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), a, b) for w, c, a, b in parts), F.lit(0.0))


def grade(score: Column) -> Column:
    out = F.when(score >= GRADES[0][0], GRADES[0][1])
    for least, name in GRADES[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("D")


def credibility_report(runs: DataFrame, *, slippage: float = 0.001, commission: float = 0.0003, synthetic: bool = False) -> DataFrame:
    """``runs`` with five dimensions, score, grade, gates and whether all gates are passed at grade A.

    One row a run: n_trades, n_days, n_symbols, universe, sharpe, max_drawdown (positive), win_rate, profit_loss_ratio,
    annual_return, n_months, month_positive, month_vol, state_dispersion; nulls count as 0.  ``synthetic``: bars were made up.
    """
    few_months = F.when(F.col("n_months") < 6, 0.55).when(F.col("n_months") < 9, 0.75).otherwise(1.0)
    coverage = clamp(F.col("n_symbols") / F.greatest(F.lit(1), "universe") * 100, 0, 100)
    execution = 78.0 + 4.0 * (0.0005 <= slippage <= 0.003) + 2.0 * (0.0002 <= commission <= 0.001)
    # money flow is a proxy in replays, which costs 20 points of the data's reality
    made = {
        "sample": weighted(SAMPLE), "risk_return": weighted(RISK_RETURN), "stability": weighted(STABILITY) * few_months,
        "data": clamp(0.65 * (35.0 if synthetic else 100.0) + 0.35 * coverage - 20, 0, 100), "execution": F.lit(execution),
    }
    out = runs.withColumns({k: F.round(v + 1e-9, 2) for k, v in made.items()})
    score = sum((F.col(k) * w for k, w in DIMENSIONS), F.lit(0.0))
    out = out.withColumn("score", F.round(clamp(score, 0, 100) + 1e-9, 2)).withColumn("grade", grade(F.col("score")))
    holds = lambda c, op, limit: F.coalesce(F.col(c) >= limit if op == ">=" else F.col(c) <= limit, F.lit(False))
    rows = [F.struct(F.lit("no_synthetic_bars").alias("gate"), F.lit(float(synthetic)).alias("value"), F.lit(not synthetic).alias("passed"))]
    rows += [F.struct(F.lit(c).alias("gate"), F.col(c).cast("double").alias("value"), holds(c, op, x).alias("passed")) for c, op, x in GATES]
    out = out.withColumn("gates", F.array(*rows)).withColumn("failed", F.transform(F.filter("gates", lambda g: ~g.passed), lambda g: g.gate))
    return out.withColumn("live_ready", (F.size("failed") == 0) & (F.col("grade") == "A"))


#: Parameters of a run and their values where a run does not name its own.
DEFAULTS = {"score_threshold": 70.0, "stop_loss_pct": 8.0, "stop_profit_pct": 15.0, "holding_days": 15.0}


def rules() -> list[tuple[str, str, Column, str | None, Column | None]]:
    """(id, priority, when it holds, the parameter it changes, its new value), in the order they are reported."""
    c = F.col
    return [
        ("expand_sample", "high", c("n_trades") < 6, None, None),
        ("raise_threshold", "high", (c("win_rate") < 0.50) & (c("n_trades") >= 3), "score_threshold", F.least(F.lit(95.0), c("score_threshold") + 5)),
        ("tighten_stop_loss", "high", (c("profit_loss_ratio") < 1.2) & (c("n_trades") >= 3), "stop_loss_pct", F.round(F.greatest(F.lit(3.0), c("stop_loss_pct") - 1.5), 2)),
        ("shorten_holding_window", "medium", (c("avg_days") > 0) & (c("avg_days") < c("holding_days") * 0.6) & (c("avg_return_pct") > 0), "holding_days", F.greatest(F.lit(5.0), F.bround(c("avg_days") + 2))),
        ("lift_take_profit", "medium", (c("win_rate") >= 0.60) & (c("avg_return_pct") >= 2) & (c("profit_loss_ratio") >= 1.5), "stop_profit_pct", F.round(F.least(F.lit(35.0), c("stop_profit_pct") + 2), 2)),
        ("reduce_exposure", "high", c("max_drawdown") > 0.12, None, None),
        ("enforce_open_risk_rules", "high", (c("n_open") > 0) & (c("open_pnl_pct") < -3), None, None),
    ]


def suggestions(runs: DataFrame) -> DataFrame:
    """``runs`` with ``items`` (id, priority) of the rules that hold and the parameters as the rules would set them.

    Needs n_trades, win_rate, profit_loss_ratio, max_drawdown, avg_days, avg_return_pct, n_open and open_pnl_pct (null: 0); a run
    where no rule holds is told to keep its parameters.
    """
    need = ("n_trades", "win_rate", "profit_loss_ratio", "max_drawdown", "avg_days", "avg_return_pct", "n_open", "open_pnl_pct")
    out = runs.withColumns({c: F.coalesce(c, F.lit(0)) for c in need})
    out = out.withColumns({k: F.coalesce(k, F.lit(v)) if k in runs.columns else F.lit(v) for k, v in DEFAULTS.items()})
    item = lambda name, priority: F.struct(F.lit(name).alias("id"), F.lit(priority).alias("priority"))
    listed = F.array_compact(F.array(*(F.when(holds, item(name, priority)) for name, priority, holds, _, _ in rules())))
    changed = {p: F.when(holds, value).otherwise(F.col(p)) for _, _, holds, p, value in rules() if p}
    out = out.withColumn("_items", listed).withColumns(changed)
    return out.withColumn("items", F.when(F.size("_items") == 0, F.array(item("keep_and_monitor", "low"))).otherwise(F.col("_items"))).drop("_items")
