"""Queries over pools of ranked rows: user actions, risk profiles, evidence by market state, overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import pools
from ..operators import ranking as rk
from ..operators import trades as tr
from ..sources import adapters as src
from ..sources.adapters import BARS, INDUSTRY
from .q_ranking import CAND, LAB, labelled
from .q_trades import POS
from .sqltext import r, rs


def actions(spark, d):
    """Actions on symbols: one per order, by its customer's number."""
    kind = F.when(F.col("o_orderstatus") == "F", "buy").when(F.col("o_orderstatus") == "O", "watch").otherwise("ignored")
    return src.table(spark, d, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("symbol"), F.to_date("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"), kind.alias("kind"))


def pool_actions(spark, d):
    a, pool = actions(spark, d), src.industry(spark, d).select("symbol", "industry")
    kept = pools.drop_ignored(pool, a, ["symbol"], "ts", "id")
    return pools.with_latest_action(kept, a, ["symbol"], "ts", "id").select("symbol", "industry", "action", "bought", "bought_at")


def conservatism(spark, d):
    buys = actions(spark, d).where("kind = 'buy'")
    rows = pools.bought_after(labelled(spark, d), buys, ["symbol"], "trade_date", "ts", 5)
    out = pools.buy_conservatism(rows, ["state"], "strong_5d", "return_5d_pct")
    return out.select("state", "n_bought", "n_unbought", "n_unbought_top10", r("bought_avg", 3).alias("bought_avg"), r("unbought_avg", 3).alias("unbought_avg"))


def state_stats(spark, d):
    rows = labelled(spark, d).where("tradability_status = 'tradable'")
    return pools.by_state(rows, "state", "return_5d_pct").select("state", "n", r("win_rate", 3).alias("win_rate"), r("worst", 3).alias("worst"))


def overlaid(spark, d):
    b = src.bars(spark, d)
    first = b.groupBy("symbol").agg(F.min("date").alias("date"), F.min_by("close", "date").alias("close"), F.min_by("volume", "date").alias("volume"))
    newest = ind.latest(b).select("symbol", F.when(F.col("volume") < 20, 0.0).otherwise(F.col("close")).alias("close"), "volume")
    return pools.overlay(first, newest, ["symbol"], ["close", "volume"]).select("symbol", "date", r("close").alias("close"), r("volume").alias("volume"))


def dimensions(spark, d):
    base = src.industry(spark, d).select("symbol", "name", "industry")
    snap = src.table(spark, d, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("symbol"), F.when(F.col("c_acctbal") < 0, "  ").otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("industry")
    )
    return pools.merge_dimensions(base, snap, "symbol", ["name", "industry"])


def training_features(spark, d):
    b = src.bars(spark, d)
    p = ind.feature_frame(b, ("ma60", "boll_lower", "from_20d_high_pct"), ("symbol", "date"))
    state = rk.market_state(ind.daily_change(b)).select("date", F.col("score").alias("market_score"))
    out = pools.missing_flags(p.join(F.broadcast(state), "date", "left").withColumn("max_drawdown_20d", F.col("from_20d_high_pct")), ["ma60", "boll_lower"])
    cols = [r(c).alias(c) for c in ("ma60", "boll_lower", "max_drawdown_20d")]
    return out.select("symbol", "date", *cols, r(F.coalesce("market_score", F.lit(50.0))).alias("market_score"), "ma60_missing", "boll_lower_missing")


def totals(spark, d):
    cent = lambda x: F.round(x + 1e-9, 2)
    marked = tr.mark_to_market(tr.positions(src.trades(spark, d)), ind.latest(src.bars(spark, d)))
    rows = marked.select(cent(F.col("avg_cost") * F.col("qty")).alias("avg_cost"), cent(F.col("price") * F.col("qty")).alias("price"), F.lit(1.0).alias("qty"))
    return pools.portfolio_totals(rows).select("n", r("cost", 2).alias("cost"), r("value", 2).alias("value"), r("pnl", 2).alias("pnl"), r("pnl_pct", 3).alias("pnl_pct"))


def recent(spark, d):
    return pools.recent_kinds(actions(spark, d), "ts", "id")


def reason_scores(spark, d):
    o = src.table(spark, d, "orders")
    text = F.concat(F.lit("entry: score="), F.when(F.col("o_orderstatus") == "P", "none").otherwise((F.col("o_orderkey") % 1000 / 8).cast("string")), F.lit(" held"))
    return o.select("o_orderkey", pools.score_in_text(text).alias("score"))


ACT = """act AS (SELECT lpad(o_custkey::VARCHAR, 6, '0') AS symbol, o_orderdate::DATE AS ts, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'buy' WHEN 'O' THEN 'watch' ELSE 'ignored' END AS kind FROM orders)"""
QUERIES = {
    "pool_actions": pool_actions, "buy_conservatism": conservatism, "state_statistics": state_stats, "quote_overlay": overlaid, "merged_dimensions": dimensions,
    "training_features": training_features, "portfolio_totals": totals, "recent_action_counts": recent, "reason_scores": reason_scores,
}
SQL = {
    "pool_actions": f"""WITH {INDUSTRY}, {ACT}, la AS (SELECT symbol, kind FROM act QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, id DESC) = 1),
fb AS (SELECT symbol, min(ts) AS bought_at FROM act WHERE kind = 'buy' GROUP BY 1)
SELECT i.symbol, industry, kind AS action, bought_at IS NOT NULL AS bought, bought_at FROM industry i LEFT JOIN la ON la.symbol = i.symbol LEFT JOIN fb ON fb.symbol = i.symbol WHERE kind IS DISTINCT FROM 'ignored'""",
    "buy_conservatism": f"""WITH {LAB}, {ACT}, x AS (SELECT lab.*, EXISTS (SELECT 1 FROM act WHERE kind = 'buy' AND act.symbol = lab.symbol AND ts BETWEEN lab.trade_date AND lab.trade_date + 5) AS bought FROM lab)
SELECT state, count(*) FILTER (WHERE strong_5d AND bought) AS n_bought, count(*) FILTER (WHERE strong_5d AND NOT bought) AS n_unbought, count(*) FILTER (WHERE strong_5d AND NOT bought AND rank_no <= 10) AS n_unbought_top10,
  {rs('avg(return_5d_pct) FILTER (WHERE strong_5d AND bought)', 3)} AS bought_avg, {rs('avg(return_5d_pct) FILTER (WHERE strong_5d AND NOT bought)', 3)} AS unbought_avg FROM x GROUP BY 1""",
    "state_statistics": f"""WITH {LAB}, s AS (SELECT unnest(['defensive', 'neutral', 'offensive']) AS state), l AS (SELECT state AS st, return_5d_pct AS v FROM lab WHERE tradability_status = 'tradable')
SELECT state, count(v) AS n, {rs('coalesce(count(*) FILTER (WHERE v > 0) / nullif(count(v), 0)::DOUBLE, 0) * 100', 3)} AS win_rate, {rs('coalesce(min(v), 0)', 3)} AS worst FROM s LEFT JOIN l ON st = state GROUP BY 1""",
    "quote_overlay": f"""WITH {BARS}, f AS (SELECT symbol, min(date) AS date, arg_min(close, date) AS close, arg_min(volume, date) AS volume FROM bars GROUP BY 1),
q AS (SELECT symbol, arg_max(close, date) AS qc, arg_max(volume, date) AS qv FROM bars GROUP BY 1)
SELECT f.symbol, date, {rs('CASE WHEN qv < 20 THEN close ELSE coalesce(nullif(qc, 0), close) END')} AS close, {rs('coalesce(nullif(qv, 0), volume)')} AS volume FROM f JOIN q ON q.symbol = f.symbol""",
    "merged_dimensions": f"""WITH {INDUSTRY}, c AS (SELECT lpad(c_custkey::VARCHAR, 6, '0') AS symbol, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS name, c_mktsegment AS industry FROM customer)
SELECT coalesce(c.symbol, i.symbol) AS symbol, coalesce(nullif(trim(c.name), ''), nullif(trim(i.name), '')) AS name, coalesce(nullif(trim(c.industry), ''), nullif(trim(i.industry), '')) AS industry
FROM industry i FULL JOIN c ON c.symbol = i.symbol""",
    "training_features": f"""WITH {CAND} SELECT f.symbol, f.date, {', '.join(f'{rs(f"coalesce({c}, 0)")} AS {c}' for c in ('ma60', 'boll_lower'))}, {rs('from_20d_high_pct')} AS max_drawdown_20d, {rs('score')} AS market_score,
  (ma60 IS NULL)::INT AS ma60_missing, (boll_lower IS NULL)::INT AS boll_lower_missing FROM feat f JOIN mkt m ON m.date = f.date""",
    "portfolio_totals": f"""WITH RECURSIVE {POS}, {BARS}, q AS (SELECT symbol, arg_max(close, date) AS quote FROM bars GROUP BY symbol),
m AS (SELECT round(avg_cost * qty + 1e-9, 2) AS c, round(coalesce(nullif(quote, 0), avg_cost) * qty + 1e-9, 2) AS v FROM pos p LEFT JOIN q ON q.symbol = p.symbol WHERE qty > 0),
t AS (SELECT count(*) AS n, coalesce(sum(c), 0) AS c, coalesce(sum(v), 0) AS v FROM m)
SELECT n, {rs('c', 2)} AS cost, {rs('v', 2)} AS value, {rs('v - c', 2)} AS pnl, {rs('coalesce((v - c) / nullif(c, 0), 0) * 100', 3)} AS pnl_pct FROM t""",
    "recent_action_counts": f"WITH {ACT}, l AS (SELECT * FROM act ORDER BY ts DESC, id DESC LIMIT 20) SELECT kind, count(*) AS n FROM l GROUP BY 1",
    "reason_scores": "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 1000) / 8 END::DOUBLE AS score FROM orders",
}
