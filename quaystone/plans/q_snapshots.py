"""Queries over pick snapshots: written as JSON, read again, matched with actions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import snapshots as sn
from ..sources import adapters as src
from ..sources.shared import shared_root
from .sqltext import r, rs


def made(spark, d):
    """One snapshot an order: fields drift between numbers and texts, some are missing, one in thirteen is cut off."""
    o = src.table(spark, d, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    keep = lambda cond, x: F.when(cond, x)
    rest = F.struct(
        keep(k % 7 != 0, k % 25 + 1).alias("rank_no"), keep(k % 2 == 0, (k % 100) / 100).alias("up_prob"), keep(k % 3 == 1, F.round(price / 1000 + 1e-9, 2).cast("string")).alias("score"),
        F.struct(keep(k % 11 != 0, F.round(price / 2000 + 1e-9, 2)).alias("total"), (k % 90).alias("trend")).alias("score_breakdown"),
        F.struct(F.struct(keep(k % 5 != 0, (k % 100).cast("string")).alias("rsi")).alias("signal_features")).alias("ranking_diagnostics"),
        F.struct(keep(k % 4 != 3, F.when(k % 4 == 0, "neutral").otherwise("offensive")).alias("state_tag")).alias("evidence_summary"),
        keep(k % 17 == 0, F.struct(F.lit("paper_buy").alias("action_type"), F.lit("2000-01-01").alias("created_at"))).alias("user_action"),
    )
    text = F.to_json(rest)
    text = F.when(k % 3 == 0, F.concat(F.lit('{"score":'), F.round(price / 1000 + 1e-9, 2).cast("string"), F.lit(","), F.substring(text, 2, 100000))).otherwise(text)
    text = F.when(k % 13 == 0, F.substring(text, 1, 20)).otherwise(text)
    symbol, day = F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.to_date("o_orderdate")
    written_day = F.when(k % 2 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "yyyyMMdd"))
    return o.select(
        F.concat_ws("-", F.date_format(day, "yyyyMM"), symbol).alias("pick_id"), F.lit("default").alias("user_id"), written_day.alias("trade_date"), symbol.alias("symbol"), F.lit(None).cast("string").alias("name"),
        F.when(k % 2 == 0, "breakout").otherwise("rebound").alias("strategy_code"), F.lit("medium").alias("risk_level"), F.lpad(k.cast("string"), 12, "0").alias("created_at"), text.alias("snapshot_json"),
        F.date_format(day, "yyyy-MM").alias("month"),
    )


def stored(spark, d):
    """The snapshots as JSON lines in the shared folder, one folder a month, read again."""
    path = f"{shared_root(spark)}/quaystone/snapshots-{uuid.uuid4().hex}"
    sn.write_snapshots(made(spark, d), path, "month")
    return sn.read_snapshots(spark, path, "month")


def actions(spark, d):
    """One order in three is an action; half of them name the pick, the others its symbol alone."""
    o = src.table(spark, d, "orders").where("o_orderkey % 3 = 0")
    symbol = F.lpad(F.col("o_custkey").cast("string"), 6, "0")
    kind = F.when(F.col("o_orderstatus") == "F", "paper_buy").when(F.col("o_orderstatus") == "O", "watch").otherwise("closed")
    pick = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws("-", F.date_format("o_orderdate", "yyyyMM"), symbol)).otherwise("")
    return o.select(F.col("o_orderkey").alias("id"), pick.alias("pick_id"), symbol.alias("symbol"), kind.alias("action_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))


SHOWN = ["factor_up_prob", "factor_total_score", "factor_trend", "factor_rsi"]


def candidates(spark, d):
    return sn.candidate_rows(sn.newest_versions(stored(spark, d)), actions(spark, d))


def candidate_rows(spark, d):
    return candidates(spark, d).select("trade_date", "pick_id", "symbol", "name", "rank_no", r("score").alias("score"), "market_state_tag", "was_bought", "buy_action_time", "action_type", "broken", *(r(c).alias(c) for c in SHOWN))


def snapshot_quality(spark, d):
    return sn.quality(stored(spark, d), ["month"])


def latest_pool(spark, d):
    rows = sn.pick_history(candidates(spark, d), strategy="breakout", start="1995-01-01")
    return sn.latest_pool(rows, 20).select("trade_date", "pick_id", "rank_no", r("score").alias("score"))


def snapshot_dates(spark, d):
    return sn.snapshot_dates(stored(spark, d))


MADE = """made AS (
  SELECT o_orderkey AS k, strftime(o_orderdate, '%Y%m') || '-' || lpad(o_custkey::VARCHAR, 6, '0') AS pick_id, o_orderdate::DATE AS day, lpad(o_custkey::VARCHAR, 6, '0') AS symbol, CASE WHEN k % 2 = 0 THEN 'breakout' ELSE 'rebound' END AS strategy,
    k % 13 = 0 AS broken, CASE WHEN NOT broken AND k % 7 <> 0 THEN k % 25 + 1 END AS rank_no, CASE WHEN NOT broken AND k % 11 <> 0 THEN round(o_totalprice / 2000 + 1e-9, 2) END AS total,
    CASE WHEN NOT broken AND k % 3 <> 2 THEN round(o_totalprice / 1000 + 1e-9, 2) END AS sc, CASE WHEN NOT broken AND k % 2 = 0 THEN (k % 100) / 100 END AS up_prob, CASE WHEN NOT broken THEN k % 90 END AS trend,
    CASE WHEN NOT broken AND k % 5 <> 0 THEN k % 100 END AS rsi, CASE WHEN NOT broken AND k % 4 <> 3 THEN CASE WHEN k % 4 = 0 THEN 'neutral' ELSE 'offensive' END END AS tag, NOT broken AND k % 17 = 0 AS own FROM orders
), newest AS (SELECT * FROM made QUALIFY row_number() OVER (PARTITION BY pick_id ORDER BY k DESC) = 1)"""
CANDIDATES = f"""{MADE}, act AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y%m') || '-' || lpad(o_custkey::VARCHAR, 6, '0') END AS pick_id, lpad(o_custkey::VARCHAR, 6, '0') AS symbol,
    CASE o_orderstatus WHEN 'F' THEN 'paper_buy' WHEN 'O' THEN 'watch' ELSE 'closed' END AS kind, strftime(o_orderdate, '%Y-%m-%d') AS done_at FROM orders WHERE o_orderkey % 3 = 0
), bp AS (
  SELECT pick_id, any_value(symbol) AS symbol, arg_max(kind, id) AS kind, bool_or(kind = 'paper_buy') AS bought, arg_min(done_at, id) FILTER (WHERE kind = 'paper_buy') AS bought_at, min(id) AS first_id FROM act WHERE pick_id IS NOT NULL GROUP BY 1
), bs AS (SELECT * FROM bp QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY first_id) = 1),
cand AS (
  SELECT strftime(n.day, '%Y-%m-%d') AS trade_date, n.pick_id, n.symbol, n.symbol AS name, strategy, coalesce(rank_no, 999999)::INT AS rank_no, coalesce(sc, total, 0) AS score, coalesce(tag, 'unknown') AS market_state_tag,
    own OR coalesce(bp.bought, bs.bought, false) AS was_bought, CASE WHEN own THEN '2000-01-01' WHEN bp.pick_id IS NOT NULL THEN bp.bought_at ELSE bs.bought_at END AS buy_action_time,
    CASE WHEN own THEN 'paper_buy' ELSE coalesce(bp.kind, bs.kind) END AS action_type, broken, coalesce(up_prob, 0) AS factor_up_prob, coalesce(total, sc, 0) AS factor_total_score, coalesce(trend, 0) AS factor_trend, coalesce(rsi, 0) AS factor_rsi
  FROM newest n LEFT JOIN bp ON bp.pick_id = n.pick_id LEFT JOIN bs ON bs.symbol = n.symbol
)"""
QUERIES = {"snapshot_candidates": candidate_rows, "snapshot_quality": snapshot_quality, "latest_pool": latest_pool, "snapshot_dates": snapshot_dates}
SQL = {
    "snapshot_candidates": f"""WITH {CANDIDATES} SELECT trade_date, pick_id, symbol, name, rank_no, {rs('score')} AS score, market_state_tag, was_bought, buy_action_time, action_type, broken, {', '.join(f'{rs(c)} AS {c}' for c in SHOWN)} FROM cand""",
    "snapshot_quality": f"""WITH {MADE} SELECT strftime(day, '%Y-%m') AS month, count(*) AS n_rows, count(*) - count(DISTINCT pick_id) AS n_replaced, count(*) FILTER (WHERE broken) AS n_broken, count(*) FILTER (WHERE rank_no IS NULL) AS n_unranked FROM made GROUP BY 1""",
    "latest_pool": f"""WITH {CANDIDATES}, c AS (SELECT * FROM cand WHERE strategy = 'breakout' AND trade_date >= '1995-01-01')
SELECT trade_date, pick_id, rank_no, {rs('score')} AS score FROM c WHERE trade_date = (SELECT max(trade_date) FROM c) ORDER BY c.rank_no, pick_id LIMIT 20""",
    "snapshot_dates": "SELECT DISTINCT o_orderdate::DATE AS trade_date FROM orders ORDER BY 1 DESC LIMIT 30",
}
