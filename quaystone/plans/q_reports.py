"""Queries over report aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import reports as rp
from ..operators import trades as tr
from ..sources import adapters as src
from ..sources.adapters import BARS
from .q_ranking import MET, METRICS, long, rk
from .q_trades import POS
from .sqltext import FEATURES, r, rs


def evidence(spark, d):
    m = rk.daily_metrics(long(spark, d)).withColumn("year", F.year("trade_date"))
    return rp.weighted_evidence(m, ["year", "horizon"], METRICS[:3], "n_tradable").select("year", "horizon", "n_runs", "weight", *(r(c).alias(c) for c in METRICS[:3]))


def review(spark, d):
    marked = tr.mark_to_market(tr.positions(src.trades(spark, d)), ind.latest(src.bars(spark, d))).withColumns({"pnl": F.round(F.col("pnl") + 1e-9, 2), "pnl_pct": F.round(F.col("pnl_pct") + 1e-9, 3)})
    return rp.position_review(marked, [F.col("risk_status")]).select("risk_status", "n", "wins", "losses", "flat", r("avg_pnl_pct", 2).alias("avg_pnl_pct"), r("pnl", 1).alias("pnl"))


def radar(spark, d):
    p = ind.latest(ind.feature_frame(src.bars(spark, d))).withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in ("return_5d", "return_20d", "ma20_gap_pct")})
    return rp.best_and_worst(p, ["symbol"], ["return_5d", "return_20d", "ma20_gap_pct"]).select("symbol", "best", "worst", r("mean_score", 3).alias("mean_score"))


def curves(spark, d):
    b = src.bars(spark, d).withColumn("close", F.round(F.col("close") + 1e-9, 4) + 0.0)
    return rp.curve_summary(b, "symbol", "date", "close")


def watch(spark, d):
    o = src.table(spark, d, "orders")
    actions = o.select(F.lpad(((F.col("o_custkey") * 13) % 1500).cast("string"), 6, "0").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "buy").when(F.col("o_orderstatus") == "O", "watch").otherwise("ignored").alias("kind"))
    out = rp.watchlist(actions, tr.positions(src.trades(spark, d)), ind.latest(src.bars(spark, d)))
    return out.select("symbol", "kind", r("qty", 2).alias("qty"), "source", r("close").alias("close"))


QUERIES = {"weighted_evidence": evidence, "position_review": review, "best_and_worst_score": radar, "curve_summary": curves, "watchlist": watch}
RADAR = ["return_5d", "return_20d", "ma20_gap_pct"]
SQL = {
    "weighted_evidence": f"""WITH {MET} SELECT year(trade_date)::INT AS year, horizon::INT AS horizon, count(*) AS n_runs, sum(greatest(1, n_tradable))::BIGINT AS weight,
  {', '.join(f'{rs(f"sum({c} * greatest(1, n_tradable)) / sum(greatest(1, n_tradable))")} AS {c}' for c in METRICS[:3])} FROM met GROUP BY 1, 2""",
    "position_review": f"""WITH RECURSIVE {POS}, {BARS}, q AS (SELECT symbol, arg_max(close, date) AS quote FROM bars GROUP BY symbol),
m AS (SELECT p.*, coalesce(nullif(quote, 0), avg_cost) AS price FROM pos p LEFT JOIN q ON q.symbol = p.symbol WHERE qty > 0),
k AS (SELECT (price - avg_cost) * qty AS pnl, coalesce(price / nullif(avg_cost, 0) - 1, 0) * 100 AS pp FROM m),
l AS (SELECT round(pnl + 1e-9, 2) AS pnl, round(pp + 1e-9, 3) AS pp, CASE WHEN pp <= -8 THEN 'stop_loss' WHEN pp >= 15 THEN 'take_profit' WHEN pp <= -4 THEN 'near_stop' WHEN pp >= 7.5 THEN 'near_take' ELSE 'normal' END AS risk_status FROM k)
SELECT risk_status, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl < 0) AS losses, count(*) FILTER (WHERE pnl = 0) AS flat, {rs('avg(pp)', 2)} AS avg_pnl_pct, {rs('sum(pnl)', 1)} AS pnl FROM l GROUP BY 1""",
    "best_and_worst_score": f"""WITH {FEATURES}, l AS (SELECT symbol, {', '.join(f'round({c} + 1e-9, 4) AS {c}' for c in RADAR)} FROM feat QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)
SELECT symbol, CASE greatest({', '.join(RADAR)}) {' '.join(f"WHEN {c} THEN '{c}'" for c in RADAR)} END AS best, CASE least({', '.join(RADAR)}) {' '.join(f"WHEN {c} THEN '{c}'" for c in RADAR)} END AS worst,
  {rs('(' + ' + '.join(RADAR) + ') / 3', 3)} AS mean_score FROM l""",
    "curve_summary": f"""WITH {BARS}, b AS (SELECT symbol, date, {rs('close')} AS close FROM bars), m AS (SELECT *, min(close) OVER (PARTITION BY symbol) AS w FROM b)
SELECT symbol, count(*) AS n, min(date) AS first_date, max(date) AS last_date, min(date) FILTER (WHERE close = w) AS worst_date, min(close) AS worst, arg_max(close, date) AS last FROM m GROUP BY symbol""",
    "watchlist": f"""WITH RECURSIVE {POS}, {BARS}, a AS (SELECT lpad(((o_custkey * 13) % 1500)::VARCHAR, 6, '0') AS symbol, CASE o_orderstatus WHEN 'F' THEN 'buy' WHEN 'O' THEN 'watch' ELSE 'ignored' END AS kind FROM orders
  QUALIFY row_number() OVER (PARTITION BY (o_custkey * 13) % 1500 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
l AS (SELECT * FROM a WHERE kind <> 'ignored'), h AS (SELECT symbol, qty FROM pos WHERE qty > 0), q AS (SELECT symbol, arg_max(close, date) AS close FROM bars GROUP BY symbol)
SELECT coalesce(l.symbol, h.symbol) AS symbol, kind, {rs('qty', 2)} AS qty, CASE WHEN kind IS NULL THEN 'position' ELSE 'action' END AS source, {rs('close')} AS close
FROM l FULL JOIN h ON h.symbol = l.symbol LEFT JOIN q ON q.symbol = coalesce(l.symbol, h.symbol)""",
}
