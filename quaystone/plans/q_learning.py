"""Queries over the explainable models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import learning as le
from ..operators import models as ml
from ..sources import adapters as src
from ..sources.shared import written
from .q_rules import PICK
from .sqltext import WIN, r, rs



def panel(spark, d):
    return written(le.training_panel(src.bars(spark, d), least_bars=60), "training-panel")


def training_panel(spark, d):
    return le.training_panel(src.bars(spark, d), least_bars=60, digits=4)


def factor_importance(spark, d):
    out = le.importance(le.correlation_model(le.training_panel(src.bars(spark, d), least_bars=60)))  # read once, so not written
    return out.select("feature", "category", r("up_coef").alias("up_coef"), r("dd_coef").alias("dd_coef"), r("importance").alias("importance"), "pos")


def row_contributions(spark, d):
    """The ten strongest features of every symbol's newest complete row."""
    p = panel(spark, d)
    out = le.ranked_contributions(ind.latest(p), le.correlation_model(p), ["symbol", "date"])
    return out.select("symbol", "date", "pos", "feature", r("value").alias("value"), r("contribution").alias("contribution"), "direction")


def blended_predictions(spark, d):
    p = panel(spark, d)
    out = le.blended_prediction(p, le.correlation_model(p))
    return out.select("symbol", "date", *(r(c).alias(c) for c in ("model_up", "model_dd", "model_edge", "model_score")))


def tree_rules(spark, d):
    return le.tree_rules(panel(spark, d), "label_up")


def walk_forward(spark, d):
    """Both models over all bars, 15 bars looked ahead: three weeks before each fold are left out."""
    p = written(le.training_panel(src.bars(spark, d), least_bars=60).select("date", *le.FEATURES, *le.TARGETS), "training-panel")
    counts, keys = written(le.walk_forward_counts(p, gap_days=21, stored=True), "walk-forward"), ["label", "fold"]
    e = ml.evaluate_counts(counts, keys).join(ml.calibration_error_counts(counts, keys), keys)
    return e.select("label", "fold", "n", "n_pos", r("auc", 2).alias("auc"), r("brier", 2).alias("brier"), r("ece", 2).alias("ece"))


RAW_RSI = "coalesce(CASE WHEN l_ = 0 AND g_ = 0 THEN NULL WHEN l_ = 0 THEN 100.0 ELSE 100 - 100 / (1 + g_ / nullif(l_, 0)) END, 0)"
AHEAD = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING)"
OWN = {"macd_hist": "mc - sig", "rsi": RAW_RSI, "max_drawdown_20d": "from_20d_high_pct", "market_state_score": "50", "market_offensive": "0", "market_defensive": "0", "news_total_score": "50", "news_net_score": "0"}
#: ... -> tp: the training panel; needs WITH RECURSIVE.
TRAINING = f"""{PICK}, fw AS (
  SELECT p.*, mc, sig, count(*) OVER (PARTITION BY p.symbol) AS n_bars FROM p1 p JOIN kd ON kd.symbol = p.symbol AND kd.date = p.date
), fl AS (
  SELECT *, lead(close, 15) {WIN} / close - 1 AS future_return, CASE WHEN count(low) {AHEAD} = 15 THEN min(low) {AHEAD} END / close - 1 AS future_max_drawdown FROM fw
), tp AS MATERIALIZED (
  SELECT symbol, date, {', '.join(f'coalesce({OWN.get(c, c)}, 0)::DOUBLE AS {c}' for c in le.FEATURES)}, future_return, future_max_drawdown,
    (future_return >= 0.08)::INT::DOUBLE AS label_up, (future_max_drawdown <= -0.06)::INT::DOUBLE AS label_drawdown, future_return + 0.45 * future_max_drawdown AS risk_adjusted_return
  FROM fl WHERE n_bars >= 60 AND future_return IS NOT NULL AND future_max_drawdown IS NOT NULL
)"""
MODEL = f"""{TRAINING}, mm AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS feature, '{k}' AS category, avg({c}) AS mean, CASE WHEN stddev_pop({c}) > 1e-9 THEN stddev_pop({c}) ELSE 1 END AS scale, CASE WHEN stddev_pop({c}) > 1e-9 AND stddev_pop(label_up) > 0 THEN corr({c}, label_up) ELSE 0 END AS up_coef, CASE WHEN stddev_pop({c}) > 1e-9 AND stddev_pop(label_drawdown) > 0 THEN corr({c}, label_drawdown) ELSE 0 END AS dd_coef FROM tp" for k, fs in le.CATEGORIES.items() for c in fs)}
), long AS (UNPIVOT (SELECT symbol, date, {', '.join(le.FEATURES)} FROM tp) ON {', '.join(le.FEATURES)} INTO NAME feature VALUE value),
zz AS (SELECT l.symbol, l.date, l.feature, value, (value - mean) / scale * up_coef AS u, (value - mean) / scale * dd_coef AS v FROM long l JOIN mm ON mm.feature = l.feature)"""
QUERIES = {
    "training_panel": training_panel, "factor_importance": factor_importance, "row_contributions": row_contributions, "blended_predictions": blended_predictions,
    "tree_rules": tree_rules, "walk_forward_metrics": walk_forward,
}
SQL = {
    "training_panel": f"WITH RECURSIVE {TRAINING} SELECT symbol, date, {', '.join(f'{rs(c)} AS {c}' for c in (*le.FEATURES, *le.LABELS))} FROM tp",
    "factor_importance": f"""WITH RECURSIVE {MODEL}, im AS (SELECT *, round(abs(up_coef) + 0.7 * abs(dd_coef) + 1e-9, 6) AS importance FROM mm)
SELECT feature, category, {rs('up_coef')} AS up_coef, {rs('dd_coef')} AS dd_coef, {rs('importance')} AS importance, row_number() OVER (ORDER BY importance DESC, feature)::INT AS pos FROM im""",
    "row_contributions": f"""WITH RECURSIVE {MODEL}, ct AS (
  SELECT symbol, date, feature, value, round(u - 0.65 * v + 1e-9, 6) AS contribution FROM zz WHERE (symbol, date) IN (SELECT (symbol, max(date)) FROM tp GROUP BY symbol)
), rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(contribution) DESC, feature) AS pos FROM ct)
SELECT symbol, date, pos::INT AS pos, feature, {rs('value')} AS value, {rs('contribution')} AS contribution, CASE WHEN contribution >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM rk WHERE pos <= 10""",
    "blended_predictions": f"""WITH RECURSIVE {MODEL}, bias AS (SELECT ln((sum(label_up) + 0.5) / (count(*) - sum(label_up) + 0.5)) AS ub, ln((sum(label_drawdown) + 0.5) / (count(*) - sum(label_drawdown) + 0.5)) AS db FROM tp),
pr AS (SELECT symbol, date, 1 / (1 + exp(-(any_value(ub) + sum(u)))) AS model_up, 1 / (1 + exp(-(any_value(db) + sum(v)))) AS model_dd FROM zz, bias GROUP BY 1, 2),
pe AS (SELECT *, (model_up * 0.14 - model_dd * 0.08) * 100 AS model_edge FROM pr)
SELECT pe.symbol, pe.date, {rs('model_up')} AS model_up, {rs('model_dd')} AS model_dd, {rs('model_edge')} AS model_edge,
  {rs('0.42 * greatest(0, least(100, 50 + 9 * model_edge)) + 0.28 * greatest(0, least(100, 100 * (1 - model_dd))) + 0.20 * 58 + 0.10 * greatest(0, least(100, 5 * amount_yi))')} AS model_score FROM pe JOIN tp ON tp.symbol = pe.symbol AND tp.date = pe.date""",
}
