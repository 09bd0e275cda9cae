"""Queries over pick grades, decisions aligned with the pool, and advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guidance as gd
from ..operators import indicators as ind
from ..operators import live
from ..operators import rules
from ..sources import adapters as src
from ..sources.shared import written
from .q_live import LIVE, live_panel
from .q_rules import SIGNALS
from .sqltext import r, rs


def graded(spark, d, rows=None, **which):
    """Live picks (of ``rows``, if given) with grades; a strategy counts as ready where the year is even."""
    picks = live.live_pick(live_panel(spark, d, **(rows or {})), **which).where("action <> 'pass'").withColumn("live_ready", F.year("date") % 2 == 0)
    rounded = {c: F.round(F.col(c) + 1e-9, 6) for c in ("total", "up_prob", "dd_prob", "edge", "profit_factor")}
    # twenty points more, as totals of these tables stay below the grades' limits
    return gd.pick_grade(picks.withColumns(rounded).withColumn("total", F.col("total") + 20))


def pick_grades(spark, d):
    return graded(spark, d).select("symbol", "date", "risk", "strategy", "grade", "executable", "mode")


def aligned(spark, d):
    """All suppliers against the medium breakout pool: each symbol's newest pick of the 30 days up to its newest bar.

    A symbol has one bar a date at most, so that its last 31 bars hold these days and no other bar needs a score.
    """
    p = written(graded(spark, d, ind.last_bars(31), risks=("medium",), strategies=("breakout",)), "pool")
    newest = src.bars(spark, d).groupBy("symbol").agg(F.max("date").alias("date"))
    recent = ind.latest(p).join(newest.select("symbol", F.col("date").alias("last")), "symbol").where(F.datediff("last", "date") <= 30)
    out = gd.aligned_decision(src.industry(spark, d).select("symbol"), recent)
    return out.select("symbol", "decision", "confidence", "risk_level", "in_pool", *(r(c).alias(c) for c in ("total", "technical", "money", "probability_pct", "position_pct", "take_price", "stop_price")))


def advice(spark, d):
    """Advice on every symbol's newest signal."""
    signals = rules.signal_score(ind.all_indicators(src.bars(spark, d), **ind.last_bars(1)))
    out = gd.advice(signals.select("symbol", "date", "close", "signal_score"))
    return out.select(
        "symbol", "risk_level", "period", r("adjusted").alias("adjusted"), "entry", "entry_low_pct", "entry_high_pct", r("entry_price").alias("entry_price"), r("take_pct").alias("take_pct"), r("take_price").alias("take_price"),
        r("stop_price").alias("stop_price"), "add_on", "add_high_pct", F.concat_ws(",", "warnings").alias("warnings"),
    )


GRADED = f"""{LIVE}, g0 AS (
  SELECT *, round(total + 1e-9, 6) + 20 AS tt, round(up_prob + 1e-9, 6) AS uu, round(dd_prob + 1e-9, 6) AS dd6, round(edge + 1e-9, 6) AS ee, round(profit_factor + 1e-9, 6) AS pf FROM live WHERE action <> 'pass'
), g1 AS (
  SELECT *, CASE WHEN action = 'buy' AND tt >= 86 AND uu >= 0.66 AND dd6 <= 0.24 AND ee >= 2.2 AND pf >= 1.35 THEN 'A' WHEN action = 'buy' AND tt >= 76 AND uu >= 0.58 AND dd6 <= 0.34 AND ee >= 1 THEN 'B'
    WHEN action = 'watch' OR tt >= 66 THEN 'C' ELSE 'D' END AS first FROM g0
), g2 AS (SELECT *, CASE WHEN first = 'A' AND state = 'defensive' THEN 'B' ELSE first END AS second FROM g1),
gr AS (SELECT *, CASE WHEN risk = 'low' AND dd6 > 0.28 AND second IN ('A', 'B') THEN 'C' ELSE second END AS grade FROM g2)"""
USERS = f"""us AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in gd.RISKS.items())}) x(risk_level, rk, stop), (VALUES {', '.join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, (a, b, c) in gd.PERIODS.items())}) y(period, pk, share, most))"""
QUERIES = {"pick_grades": pick_grades, "aligned_decisions": aligned, "advice": advice}
SQL = {
    "pick_grades": f"""WITH RECURSIVE {GRADED} SELECT symbol, date, risk, strategy, grade, grade IN ('A', 'B') AS executable,
  CASE WHEN grade IN ('A', 'B') THEN CASE WHEN year(date) % 2 = 0 THEN 'real_allowed' ELSE 'paper_only' END ELSE 'watch_only' END AS mode FROM gr""",
    "aligned_decisions": f"""WITH RECURSIVE {GRADED}, nw AS (SELECT symbol, max(date) AS last FROM bars GROUP BY 1),
po AS (SELECT g.* FROM (SELECT * FROM gr WHERE risk = 'medium' AND strategy = 'breakout' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) g JOIN nw ON nw.symbol = g.symbol WHERE date_diff('day', g.date, last) <= 30),
su AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS symbol FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT su.symbol, CASE WHEN po.symbol IS NULL THEN 'not_in_pool' ELSE action END AS decision, CASE WHEN grade = 'A' THEN 'high' WHEN grade = 'B' THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN po.symbol IS NULL THEN 'high' WHEN action = 'buy' AND dd6 <= 0.25 THEN 'low' WHEN dd6 >= 0.4 THEN 'raised' ELSE 'medium' END AS risk_level, po.symbol IS NOT NULL AS in_pool,
  {rs('tt')} AS total, {rs('trend')} AS technical, {rs('fs')} AS money, {rs('uu * 100')} AS probability_pct, {rs('coalesce(position_pct, 0)')} AS position_pct, {rs('take_price')} AS take_price, {rs('stop_price')} AS stop_price
FROM su LEFT JOIN po ON po.symbol = su.symbol""",
    "advice": f"""{SIGNALS[:SIGNALS.rindex('SELECT symbol, date, signal_score, CASE')]}, {USERS}, la AS (SELECT symbol, close, signal_score FROM x5 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
ad AS (SELECT *, round(signal_score * pk * rk + 1e-9, 6) AS s, least(12.0 * share, most) AS take FROM la CROSS JOIN us)
SELECT symbol, risk_level, period, {rs('s')} AS adjusted, CASE WHEN s > 30 THEN 'build' WHEN s > 10 THEN 'careful' ELSE 'wait' END AS entry, CASE WHEN s > 30 THEN 30 WHEN s > 10 THEN 20 ELSE 0 END AS entry_low_pct,
  CASE WHEN s > 30 THEN 50 WHEN s > 10 THEN 30 ELSE 0 END AS entry_high_pct, {rs('CASE WHEN s > 30 THEN close WHEN s > 10 THEN close * 0.97 END')} AS entry_price, {rs('take')} AS take_pct, {rs('close * (1 + take / 100)')} AS take_price,
  {rs('close * (1 - stop / 100)')} AS stop_price, CASE WHEN s > 40 THEN 'on_breakout' WHEN s > 20 THEN 'on_pullback' ELSE 'none' END AS add_on, CASE WHEN s > 40 THEN 20 WHEN s > 20 THEN 15 ELSE 0 END AS add_high_pct,
  concat_ws(',', CASE WHEN s < 0 THEN 'bearish' END, CASE WHEN period = 'short' THEN 'short_term' END, CASE WHEN risk_level = 'high' THEN 'high_risk' END) AS warnings FROM ad""",
}
