"""Queries over market state, candidate pools, forward labels and ranking evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import ranking as rk
from ..sources import adapters as src
from ..sources.adapters import BARS, INDUSTRY
from ..sources.shared import written
from .sqltext import FEATURES, r, rs

FACTORS = ["return_5d", "return_20d", "ma20_gap_pct", "volume_ratio_20", "volatility_20d", "from_20d_high_pct"]
H = rk.HORIZONS
MIN_AMOUNT = 20000.0


def panel(spark, d):
    """Bars with the features that candidates, their labels and the state read."""
    return ind.feature_frame(src.bars(spark, d), ("pct_change", *FACTORS))


def score():
    """Rounded, so that equal candidates tie alike everywhere."""
    return F.round(F.col("return_20d") - 0.3 * F.abs(F.col("ma20_gap_pct")) + F.col("volume_ratio_20") + 1e-9, 4)


def candidates(spark, d, limit=15, p=None):
    state = rk.market_state(ind.daily_change(src.bars(spark, d)) if p is None else p).select(F.col("date").alias("trade_date"), "state")
    p = panel(spark, d) if p is None else p
    return rk.ranked(p, score(), limit).join(F.broadcast(state), "trade_date")  # one row a date


def labelled(spark, d):
    p = written(panel(spark, d), "panel")  # read for candidates, their state and the bars ahead
    c = written(candidates(spark, d, p=p), "candidates")
    lab = rk.forward_labels(F.broadcast(c), p, min_amount=MIN_AMOUNT)  # fifteen a date: they go to the bars
    return lab.join(c.select("trade_date", "symbol", "state", "rank_score", *FACTORS), ["trade_date", "symbol"])


def long(spark, d):
    return rk.by_horizon(labelled(spark, d))


def flagship(spark, d):
    c = candidates(spark, d, 10)
    return c.select("trade_date", "symbol", "rank_no", "state", r("rank_score").alias("rank_score"), r("return_20d").alias("return_20d"))


def market_state(spark, d):
    return rk.market_state(ind.daily_change(src.bars(spark, d))).select("date", r("avg_pct").alias("avg_pct"), r("up_ratio").alias("up_ratio"), "n_symbols", r("score").alias("score"), "state")


def label_rows(spark, d):
    cols = ["max_gain_pct", "max_loss_pct", "path_max_drawdown_pct", *(f"return_{h}d_pct" for h in H)]
    return labelled(spark, d).select(
        "trade_date", "symbol", "rank_no", "tradability_status", "tp_sl_path", *(r(c).alias(c) for c in cols), *(f"strong_{h}d" for h in H), F.size("incomplete_horizons").alias("n_incomplete")
    )


METRICS = ["precision_at_3", "precision_at_5", "precision_at_10", "top_3_avg_return_pct", "top_5_avg_return_pct", "top_10_avg_return_pct", "recall_at_10", "ndcg_at_10", "mrr"]


def metrics(spark, d):
    return rk.daily_metrics(long(spark, d)).select("trade_date", "horizon", *(r(c).alias(c) for c in METRICS), "n_tradable", "n_strong", "n_strong_top10")


def metric_means(spark, d):
    return rk.daily_metrics(long(spark, d)).groupBy("horizon").agg(*(r(F.avg(c), 3).alias(c) for c in METRICS), F.count("*").alias("n_days"))


def curve(spark, d):
    return rk.percentile_curve(long(spark, d)).select("trade_date", "horizon", "bucket", r("avg_return_pct").alias("avg_return_pct"), "n")


def correlations(spark, d):
    return rk.factor_correlations(long(spark, d), FACTORS).select("horizon", "factor", "n", r("pearson").alias("pearson"), r("spearman").alias("spearman"))


def misses(spark, d):
    return rk.miss_samples(long(spark, d)).select("horizon", "kind", "n", "trade_date", "symbol", "rank_no", r("return_pct").alias("return_pct"))


def breakdown(spark, d):
    return rk.state_breakdown(long(spark, d)).select("horizon", "state", "n", "n_strong", r("avg_return_pct", 3).alias("avg_return_pct"), "n_top10", "n_top10_strong", r("top10_precision").alias("top10_precision"))


def failures(spark, d):
    return rk.failure_modes(long(spark, d)).select("horizon", "mode", "n")


def states(spark, d):
    return rk.dominant(candidates(spark, d).withColumn("month", F.date_format("trade_date", "yyyy-MM")), ["month"], "state")


def covered(spark, d):
    b = src.bars(spark, d).select("symbol", "date")
    span = b.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    wanted = span.select(F.explode(F.sequence("a", "b")).alias("date"))
    known = src.industry(spark, d).select("symbol", F.lit(None).cast("date").alias("date"))
    return rk.coverage_by(wanted, b.unionByName(known), "symbol").select("symbol", "n_requested", "n_missing", "first_missing", "status")


#: ... -> cand: the 15 best of each date, with the market state.
CAND = f"""{FEATURES}, mday AS (
  SELECT date, avg(pct_change) AS avg_pct, avg((pct_change > 0)::INT) AS up_ratio, count(*) AS n_symbols FROM feat GROUP BY date
), mscore AS (
  SELECT *, 0.35 * greatest(0, least(100, 50 + 4 * avg_pct)) + 0.25 * greatest(0, least(100, 100 * up_ratio))
            + 0.20 * greatest(0, least(100, 45 + 3 * avg_pct)) + 0.20 * greatest(0, least(100, 65 - 4 * abs(avg_pct))) AS score FROM mday
), mkt AS (SELECT *, CASE WHEN score >= 65 THEN 'offensive' WHEN score >= 45 THEN 'neutral' ELSE 'defensive' END AS state FROM mscore),
scored AS (SELECT *, round(return_20d - 0.3 * abs(ma20_gap_pct) + volume_ratio_20 + 1e-9, 4) AS rank_score FROM feat),
cand AS (
  SELECT s.* EXCLUDE (date), s.date AS trade_date, m.state, row_number() OVER (PARTITION BY s.date ORDER BY rank_score DESC, symbol) AS rank_no
  FROM scored s JOIN mkt m ON m.date = s.date QUALIFY rank_no <= 15
)"""
KEYS = "trade_date, symbol, rank_no"
CW = "OVER (PARTITION BY c.trade_date, c.symbol, c.rank_no ORDER BY b.date)"
#: ... -> lab: forward labels.
LAB = f"""{CAND}, ahead AS (
  SELECT c.trade_date, c.symbol, c.rank_no, b.*, row_number() {CW} AS rn, first_value(b.open) {CW} AS entry,
         max(CASE WHEN b.high > 0 THEN b.high END) {CW} AS peak
  FROM cand c JOIN (SELECT symbol AS s2, date, open, high, low, close, volume, amount, pct_change FROM feat) b
    ON b.s2 = c.symbol AND b.date > c.trade_date AND b.date <= c.trade_date + INTERVAL 110 DAY
), got AS (
  SELECT {KEYS}, count(*) AS n_bars, max(entry) AS entry, max(volume) FILTER (WHERE rn = 1) AS v1, max(amount) FILTER (WHERE rn = 1) AS a1,
         bool_or(rn = 1 AND pct_change >= CASE WHEN symbol[1:3] IN ('300', '301', '688') THEN 19.5 ELSE 9.8 END AND open >= high AND high > 0) AS limit_up,
         max(high) AS top, min(low) AS bottom, min(low / peak - 1) FILTER (WHERE high > 0 AND low > 0) AS path_dd,
         min(rn) FILTER (WHERE high >= entry * (1 + 0.15)) AS tp, min(rn) FILTER (WHERE low <= entry * (1 - 0.08)) AS sl,
         {", ".join(f"max(close) FILTER (WHERE rn = {h}) AS c{h}" for h in H)}
  FROM ahead GROUP BY ALL
), lab0 AS (
  SELECT c.trade_date, c.symbol, c.rank_no, c.state, {", ".join("c." + f for f in FACTORS)}, {", ".join(f"c{h}" for h in H)},
    CASE WHEN coalesce(n_bars, 0) = 0 THEN 'missing_history' WHEN NOT coalesce(entry > 0, false) THEN 'no_entry_price'
         WHEN v1 < 1 OR a1 < {MIN_AMOUNT} THEN 'volume_or_amount_blocked' WHEN coalesce(limit_up, false) THEN 'limit_up_entry_blocked' ELSE 'tradable' END AS tradability_status,
    CASE WHEN tp IS NULL AND sl IS NULL THEN 'neither' WHEN tp = sl THEN 'both_same_day_stop_loss_first' WHEN sl IS NULL OR tp < sl THEN 'tp_before_sl' ELSE 'sl_before_tp' END AS tp_sl_path,
    coalesce((top / nullif(entry, 0) - 1) * 100, 0) AS max_gain_pct, coalesce((bottom / nullif(entry, 0) - 1) * 100, 0) AS max_loss_pct, coalesce(path_dd * 100, 0) AS path_max_drawdown_pct,
    {", ".join(f"coalesce((c{h} / nullif(entry, 0) - 1) * 100, 0) AS return_{h}d_pct" for h in H)}
  FROM cand c LEFT JOIN got g ON g.trade_date = c.trade_date AND g.symbol = c.symbol AND g.rank_no = c.rank_no
), lab AS (
  SELECT *, {", ".join(f"tradability_status = 'tradable' AND c{h} IS NOT NULL AND return_{h}d_pct >= {rk.THRESHOLDS[h]} AND max_loss_pct >= -10 AS strong_{h}d" for h in H)},
         {" + ".join(f"(c{h} IS NULL)::INT" for h in H)} AS n_incomplete
  FROM lab0
)"""
LONG = f"""{LAB}, long AS (
  {" UNION ALL ".join(f"SELECT {KEYS}, state, tradability_status, tp_sl_path, {', '.join(FACTORS)}, {h} AS horizon, return_{h}d_pct AS return_pct, strong_{h}d AS strong FROM lab" for h in H)}
)"""
MET = f"""{LONG}, t AS (
  SELECT *, greatest(0, least(60, return_pct)) AS gain, row_number() OVER (PARTITION BY trade_date, horizon ORDER BY greatest(0, least(60, return_pct)) DESC, symbol) AS pos
  FROM long WHERE tradability_status = 'tradable'
), met AS (
  SELECT trade_date, horizon,
    {", ".join(f"count(*) FILTER (WHERE rank_no <= {k} AND strong) / least({k}, count(*))::DOUBLE AS precision_at_{k}, coalesce(avg(return_pct) FILTER (WHERE rank_no <= {k}), 0) AS top_{k}_avg_return_pct" for k in (3, 5, 10))},
    coalesce(count(*) FILTER (WHERE rank_no <= 10 AND strong) / nullif(count(*) FILTER (WHERE strong), 0)::DOUBLE, 0) AS recall_at_10,
    coalesce(coalesce(sum(gain / log2(rank_no + 1)) FILTER (WHERE rank_no <= 10), 0) / nullif(sum(gain / log2(pos + 1)) FILTER (WHERE pos <= 10), 0), 0) AS ndcg_at_10,
    coalesce(1.0 / min(rank_no) FILTER (WHERE strong), 0) AS mrr,
    count(*) AS n_tradable, count(*) FILTER (WHERE strong) AS n_strong, count(*) FILTER (WHERE rank_no <= 10 AND strong) AS n_strong_top10
  FROM t GROUP BY 1, 2
)"""

QUERIES = {
    "flagship_daily_top10": flagship,
    "market_state": market_state,
    "candidate_forward_labels": label_rows,
    "ranking_daily_metrics": metrics,
    "ranking_metric_means": metric_means,
    "ranking_percentile_curve": curve,
    "factor_correlations": correlations,
    "ranking_miss_samples": misses,
    "state_breakdown": breakdown,
    "failure_modes": failures,
    "dominant_state_by_month": states,
    "date_coverage": covered,
}
LABEL_COLS = ["max_gain_pct", "max_loss_pct", "path_max_drawdown_pct", *(f"return_{h}d_pct" for h in H)]
SQL = {
    "flagship_daily_top10": f"WITH {CAND} SELECT trade_date, symbol, rank_no::INT AS rank_no, state, {rs('rank_score')} AS rank_score, {rs('return_20d')} AS return_20d FROM cand WHERE rank_no <= 10",
    "market_state": f"WITH {CAND} SELECT date, {rs('avg_pct')} AS avg_pct, {rs('up_ratio')} AS up_ratio, n_symbols, {rs('score')} AS score, state FROM mkt",
    "candidate_forward_labels": f"WITH {LAB} SELECT trade_date, symbol, rank_no::INT AS rank_no, tradability_status, tp_sl_path, {', '.join(f'{rs(c)} AS {c}' for c in LABEL_COLS)}, {', '.join(f'strong_{h}d' for h in H)}, n_incomplete::INT AS n_incomplete FROM lab",
    "ranking_daily_metrics": f"WITH {MET} SELECT trade_date, horizon::INT AS horizon, {', '.join(f'{rs(c)} AS {c}' for c in METRICS)}, n_tradable, n_strong, n_strong_top10 FROM met",
    "ranking_metric_means": f"WITH {MET} SELECT horizon::INT AS horizon, {', '.join(f'{rs(f'avg({c})', 3)} AS {c}' for c in METRICS)}, count(*) AS n_days FROM met GROUP BY horizon",
    "ranking_percentile_curve": f"""WITH {LONG}, t AS (
  SELECT *, row_number() OVER (PARTITION BY trade_date, horizon ORDER BY rank_no, symbol) - 1 AS i, count(*) OVER (PARTITION BY trade_date, horizon) AS n FROM long WHERE tradability_status = 'tradable'
), b AS (SELECT *, least(5, floor(i / greatest(n - 1, 1) * 5) + 1)::INT AS bucket FROM t),
g AS (SELECT trade_date, horizon, bucket, avg(return_pct) AS a, count(*) AS n FROM b GROUP BY ALL),
e AS (SELECT DISTINCT trade_date, horizon, unnest(range(1, 6))::INT AS bucket FROM t)
SELECT e.trade_date, e.horizon::INT AS horizon, e.bucket, {rs('coalesce(a, 0)')} AS avg_return_pct, coalesce(g.n, 0)::BIGINT AS n
FROM e LEFT JOIN g ON g.trade_date = e.trade_date AND g.horizon = e.horizon AND g.bucket = e.bucket""",
    "factor_correlations": f"""WITH {LONG}, u AS (
  {" UNION ALL ".join(f"SELECT horizon, '{f}' AS factor, {f} AS x, return_pct AS y FROM long" for f in FACTORS)}
), k AS (
  SELECT *, rank() OVER (PARTITION BY horizon, factor ORDER BY x) + (count(*) OVER (PARTITION BY horizon, factor, x) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY horizon, factor ORDER BY y) + (count(*) OVER (PARTITION BY horizon, factor, y) - 1) / 2.0 AS ry
  FROM u WHERE x IS NOT NULL AND y IS NOT NULL
) SELECT horizon::INT AS horizon, factor, count(*) AS n, {rs('CASE WHEN min(x) = max(x) OR min(y) = max(y) THEN 0 ELSE corr(x, y) END')} AS pearson,
  {rs('CASE WHEN min(x) = max(x) OR min(y) = max(y) THEN 0 ELSE corr(rx, ry) END')} AS spearman FROM k GROUP BY 1, 2 HAVING count(*) >= 2""",
    "ranking_miss_samples": f"""WITH {LONG}, q AS (SELECT horizon, quantile_cont(return_pct, 0.9) AS p90, quantile_cont(return_pct, 0.1) AS p10 FROM long GROUP BY 1),
m AS (
  SELECT l.*, 'late_winner' AS kind, -return_pct AS o FROM long l JOIN q USING (horizon) WHERE rank_no > 10 AND (return_pct >= p90 OR strong)
  UNION ALL
  SELECT l.*, 'early_loser', return_pct FROM long l JOIN q USING (horizon) WHERE rank_no <= 10 AND (return_pct <= p10 OR tp_sl_path IN ('sl_before_tp', 'both_same_day_stop_loss_first'))
) SELECT horizon::INT AS horizon, kind, (row_number() OVER (PARTITION BY horizon, kind ORDER BY o, trade_date, symbol))::INT AS n, trade_date, symbol, rank_no::INT AS rank_no,
  {rs('return_pct')} AS return_pct FROM m QUALIFY n <= 20""",
    "state_breakdown": f"""WITH {LONG} SELECT horizon::INT AS horizon, state, count(*) AS n, count(*) FILTER (WHERE strong) AS n_strong, {rs('avg(return_pct)', 3)} AS avg_return_pct,
  count(*) FILTER (WHERE rank_no <= 10) AS n_top10, count(*) FILTER (WHERE rank_no <= 10 AND strong) AS n_top10_strong,
  {rs('coalesce(count(*) FILTER (WHERE rank_no <= 10 AND strong) / nullif(count(*) FILTER (WHERE rank_no <= 10), 0)::DOUBLE, 0)')} AS top10_precision FROM long GROUP BY 1, 2""",
    "failure_modes": f"""WITH {LONG}, c AS (
  SELECT horizon, 'late_strong' AS mode, count(*) FILTER (WHERE rank_no > 10 AND strong) AS n FROM long GROUP BY 1
  UNION ALL SELECT horizon, 'top10_stop_first', count(*) FILTER (WHERE rank_no <= 10 AND tp_sl_path IN ('sl_before_tp', 'both_same_day_stop_loss_first')) FROM long GROUP BY 1
  UNION ALL SELECT horizon, 'top10_negative', count(*) FILTER (WHERE rank_no <= 10 AND return_pct < 0) FROM long GROUP BY 1
) SELECT horizon::INT AS horizon, mode, n FROM c WHERE n > 0""",
    "dominant_state_by_month": f"""WITH {CAND}, c AS (SELECT strftime(trade_date, '%Y-%m') AS month, state, count(*) AS n FROM cand GROUP BY ALL)
SELECT month, state FROM c QUALIFY row_number() OVER (PARTITION BY month ORDER BY n DESC, state) = 1""",
    "date_coverage": f"""WITH {BARS}, {INDUSTRY}, s AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM bars),
k AS (SELECT symbol FROM bars UNION SELECT symbol FROM industry), g AS (
  SELECT k.symbol, s.date, b.symbol IS NULL AS miss FROM k CROSS JOIN s LEFT JOIN (SELECT symbol, date FROM bars) b ON b.symbol = k.symbol AND b.date = s.date
) SELECT symbol, count(*) AS n_requested, count(*) FILTER (WHERE miss) AS n_missing, min(date) FILTER (WHERE miss) AS first_missing,
  CASE WHEN count(*) FILTER (WHERE miss) = count(*) THEN 'blocked' WHEN count(*) FILTER (WHERE miss) > 0 THEN 'partial' ELSE 'complete' END AS status FROM g GROUP BY symbol""",
}
