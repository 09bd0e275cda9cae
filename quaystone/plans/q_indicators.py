"""Queries over indicators, features and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..sources import adapters as src
from .sqltext import BARS, FEATURE_NAMES, FEATURES, WIN, fullsql, r, rs


def bars_daily(spark, d):
    return src.bars(spark, d).select("symbol", "date", *(r(c).alias(c) for c in ("open", "high", "low", "close", "volume", "amount")))


def resampled(period):
    return lambda spark, d: ind.resample(src.bars(spark, d), period).select("symbol", "date", *(r(c).alias(c) for c in ("open", "high", "low", "close", "volume", "amount")))


def moving_averages(spark, d):
    df = ind.with_columns(src.bars(spark, d), ("ma5", "ma10", "ma20", "ma60", *ind.BANDS))
    return df.select("symbol", "date", *(r(c).alias(c) for c in ("ma5", "ma10", "ma20", "ma60", "boll_mid", "boll_upper", "boll_lower")))


def rsi(spark, d):
    return ind.rsi(src.bars(spark, d)).select("symbol", "date", r("rsi").alias("rsi"))


def recursive(spark, d):
    return ind.recursive_indicators(src.bars(spark, d)).select("symbol", "date", *(r(c).alias(c) for c in ("macd", "macd_signal", "macd_hist", "kdj_k", "kdj_d", "kdj_j")))


def features(spark, d):
    df = ind.feature_frame(src.bars(spark, d))
    return df.select("symbol", "date", *(r(c).alias(c) for c in FEATURE_NAMES), "ma_alignment")


def latest(spark, d):
    return ind.latest(ind.feature_frame(src.bars(spark, d), ("ma5", "return_20d"))).select("symbol", "date", r("close").alias("close"), r("ma5").alias("ma5"), r("return_20d").alias("return_20d"))


def labels(spark, d):
    df = ind.forward_labels(src.bars(spark, d))
    return df.select("symbol", "date", *(r(c).alias(c) for c in ("future_return", "future_max_gain", "future_max_drawdown", "risk_adjusted_return")), "label_up", "label_drawdown")


def history_range(spark, d):
    return src.bars(spark, d).where(F.col("date").between("1995-01-01", "1995-12-31")).select("symbol", "date", r("close").alias("close"))


def history_tail(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return src.bars(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 30").select("symbol", "date", "n", r("close").alias("close"))


def sampled(spark, d):
    return ind.every_kth(src.bars(spark, d), 5).select("symbol", "date", r("close").alias("close"))


def flow_streak(spark, d):
    return ind.streak(ind.daily_change(src.bars(spark, d)), "pct_change").select("symbol", F.col("sign").cast("int").alias("sign"), F.col("days").cast("long").alias("days"))


OHLC = ", ".join(f"{rs(c)} AS {c}" for c in ("open", "high", "low", "close", "volume", "amount"))
PANEL = "WITH " + FEATURES


def resample_sql(period):
    return f"""weekly AS (
  SELECT symbol, date_trunc('{period}', date)::DATE AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low,
         arg_max(close, date) AS close, sum(volume) AS volume, round(sum(amount), 2) AS amount FROM bars GROUP BY 1, 2
)"""


#: bars -> e: exponential means of the daily bars, one step a bar.
MEANS = f"""b AS (
  SELECT symbol, date, close, row_number() {WIN} AS k,
         (close - {fullsql('min', 'low', 9)}) / nullif({fullsql('max', 'high', 9)} - {fullsql('min', 'low', 9)}, 0) * 100 AS rsv
  FROM bars
), e AS (
  SELECT symbol, k, date, close AS e12, close AS e26, 0.0::DOUBLE AS sig, rsv AS kk, rsv AS dd, 1 AS gk FROM b WHERE k = 1
  UNION ALL
  SELECT b.symbol, b.k, b.date, e.e12 + (b.close - e.e12) * 2 / 13, e.e26 + (b.close - e.e26) * 2 / 27,
         e.sig + ((e.e12 + (b.close - e.e12) * 2 / 13) - (e.e26 + (b.close - e.e26) * 2 / 27) - e.sig) * 0.2,
         CASE WHEN b.rsv IS NULL THEN e.kk WHEN e.kk IS NULL THEN b.rsv ELSE (pow(2.0 / 3, e.gk) * e.kk + b.rsv / 3) / (pow(2.0 / 3, e.gk) + 1.0 / 3) END,
         CASE WHEN b.rsv IS NULL AND e.kk IS NULL THEN NULL
              WHEN e.dd IS NULL THEN CASE WHEN b.rsv IS NULL THEN e.kk ELSE b.rsv END
              ELSE e.dd * 2 / 3 + (CASE WHEN b.rsv IS NULL THEN e.kk WHEN e.kk IS NULL THEN b.rsv ELSE (pow(2.0 / 3, e.gk) * e.kk + b.rsv / 3) / (pow(2.0 / 3, e.gk) + 1.0 / 3) END) / 3 END,
         CASE WHEN b.rsv IS NULL THEN e.gk + 1 ELSE 1 END
  FROM e JOIN b ON b.symbol = e.symbol AND b.k = e.k + 1
)"""
RECURSIVE = f"""
WITH RECURSIVE {BARS}, {MEANS}
SELECT symbol, date, {rs('e12 - e26')} AS macd, {rs('sig')} AS macd_signal, {rs('e12 - e26 - sig')} AS macd_hist,
       {rs('kk')} AS kdj_k, {rs('dd')} AS kdj_d, {rs('3 * kk - 2 * dd')} AS kdj_j FROM e
"""

QUERIES = {
    "bars_daily": bars_daily,
    "bars_weekly": resampled("week"),
    "bars_monthly": resampled("month"),
    "indicator_moving_averages": moving_averages,
    "indicator_rsi": rsi,
    "indicator_macd_kdj": recursive,
    "feature_frame": features,
    "latest_indicators": latest,
    "forward_labels": labels,
    "history_range": history_range,
    "history_tail": history_tail,
    "sampled_bars": sampled,
    "pct_streak": flow_streak,
}

AHEAD = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
SQL = {
    "bars_daily": f"WITH {BARS} SELECT symbol, date, {OHLC} FROM bars",
    "bars_weekly": f"WITH {BARS}, {resample_sql('week')} SELECT symbol, date, {OHLC} FROM weekly",
    "bars_monthly": f"WITH {BARS}, {resample_sql('month')} SELECT symbol, date, {OHLC} FROM weekly",
    "indicator_moving_averages": f"{PANEL} SELECT symbol, date, " + ", ".join(f"{rs(c)} AS {c}" for c in ("ma5", "ma10", "ma20", "ma60", "boll_mid", "boll_upper", "boll_lower")) + " FROM feat",
    "indicator_rsi": f"""WITH {BARS}, s AS (
  SELECT symbol, date, greatest(coalesce(close - lag(close) {WIN}, 0), 0) AS up, greatest(-coalesce(close - lag(close) {WIN}, 0), 0) AS dn FROM bars
), m AS (SELECT symbol, date, {fullsql('avg', 'up', 14)} AS g, {fullsql('avg', 'dn', 14)} AS l FROM s)
SELECT symbol, date, {rs('CASE WHEN l = 0 AND g = 0 THEN NULL WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END')} AS rsi FROM m""",
    "indicator_macd_kdj": RECURSIVE,
    "feature_frame": f"{PANEL} SELECT symbol, date, ma_alignment, " + ", ".join(f"{rs(c)} AS {c}" for c in FEATURE_NAMES) + " FROM feat",
    "latest_indicators": f"{PANEL} SELECT symbol, date, {rs('close')} AS close, {rs('ma5')} AS ma5, {rs('return_20d')} AS return_20d FROM feat QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1",
    "forward_labels": f"""WITH {BARS}, f AS (
  SELECT symbol, date, lead(close, 5) {WIN} / close - 1 AS future_return,
         CASE WHEN count(low) {AHEAD} = 5 THEN max(high) {AHEAD} END / close - 1 AS future_max_gain,
         CASE WHEN count(low) {AHEAD} = 5 THEN min(low) {AHEAD} END / close - 1 AS future_max_drawdown FROM bars
) SELECT symbol, date, {rs('future_return')} AS future_return, {rs('future_max_gain')} AS future_max_gain, {rs('future_max_drawdown')} AS future_max_drawdown,
  {rs('future_return + 0.45 * future_max_drawdown')} AS risk_adjusted_return, coalesce(future_return >= 0.05, false)::INT AS label_up,
  coalesce(future_max_drawdown <= -0.05, false)::INT AS label_drawdown FROM f""",
    "history_range": f"WITH {BARS} SELECT symbol, date, {rs('close')} AS close FROM bars WHERE date BETWEEN '1995-01-01' AND '1995-12-31'",
    "history_tail": f"WITH {BARS} SELECT symbol, date, (row_number() OVER (PARTITION BY symbol ORDER BY date DESC))::INT AS n, {rs('close')} AS close FROM bars QUALIFY n <= 30",
    "sampled_bars": f"WITH {BARS} SELECT symbol, date, {rs('close')} AS close FROM bars QUALIFY (row_number() {WIN} - 1) % 5 = 0",
    "pct_streak": f"""{PANEL}, s AS (
  SELECT symbol, CASE WHEN pct_change > 0 THEN 1 ELSE -1 END AS sign, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM feat
), l AS (SELECT *, first_value(sign) OVER (PARTITION BY symbol ORDER BY rn) AS last FROM s)
SELECT symbol, min(last)::INT AS sign, (coalesce(min(rn) FILTER (WHERE sign <> last), max(rn) + 1) - 1)::BIGINT AS days FROM l GROUP BY symbol""",
}
