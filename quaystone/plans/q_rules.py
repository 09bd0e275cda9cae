"""Queries over rule scorers and screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import ranking as rk
from ..operators import rules
from ..sources import adapters as src
from .q_indicators import MEANS, RECURSIVE
from .q_ranking import CAND
from .sqltext import FEATURES, WIN, fullsql, r, rs

WEIGHTS = {"return_5d": 0.5, "return_20d": 0.3, "ma20_gap_pct": -0.4, "volatility_20d": -0.1, "volume_ratio_20": 2.0, "boll_position": 3.0}


#: What scores, picks and live picks read of a bar besides its close.
SIGNAL_COLUMNS = (
    *ind.RECURSIVE, "rsi", "ma5", "ma10", "ma20", "ma60", *ind.BANDS, "pct_change", "prev_pct_change", "return_5d", "return_20d", "ma20_gap_pct", "ma_alignment", "volume_ratio_5", "volume_ratio_20", "from_20d_high_pct",
)


def signals(spark, d):
    out = rules.technical_score(rules.signal_score(ind.all_indicators(src.bars(spark, d))))
    return out.select("symbol", "date", "signal_score", "signal", "trend_up", "technical_score", "technical_trend_up", F.concat_ws(",", "signal_codes").alias("codes"))


def signal_panel(spark, d, **rows):
    """Features, signal score and market state of every bar (or ``rows``); the state is one row a calendar date, so it goes to the bars and not they to it."""
    bars = src.bars(spark, d)
    p = rules.signal_score(ind.with_columns(bars, SIGNAL_COLUMNS, ("symbol", "date", "close"), **rows))
    return p.join(F.broadcast(rk.market_state(ind.daily_change(bars)).select("date", "state")), "date")


def pick_panel(spark, d):
    return rules.relative_scores(rules.historical_pick(signal_panel(spark, d)))


def picks(spark, d):
    cols = ["up_prob", "dd_prob", "total", "expected_return", "mid_rank", "display_score", "stop_price", "take_price"]
    return pick_panel(spark, d).select("symbol", "date", "signal_score", "penalty", "action", "confidence", *(r(c).alias(c) for c in cols))


def screening(spark, d):
    p = ind.feature_frame(src.bars(spark, d)).join(src.industry(spark, d).select("symbol", "industry"), "symbol")
    return rules.screen(p).select("date", "symbol", "industry", "pos", r("prescore").alias("prescore"))


def explained(spark, d):
    p = ind.latest(ind.feature_frame(src.bars(spark, d)))
    out = rules.contributions(p, list(WEIGHTS), WEIGHTS, ["symbol", "date"], 3)
    return out.select("symbol", "date", F.concat_ws(",", F.transform("positive", lambda x: x.factor)).alias("positive"), F.concat_ws(",", F.transform("negative", lambda x: x.factor)).alias("negative"))


def trade_plan(spark, d):
    day = pick_panel(spark, d).groupBy("date", "state").agg(F.count_if(F.col("action") == "buy").alias("n_buy"), F.count_if(F.col("action") == "watch").alias("n_watch"), F.max(F.round(F.col("display_score") + 1e-9, 4)).alias("best"))
    exposure = F.least(F.lit(30), F.col("n_buy") * 10)
    return day.select("date", "state", "n_buy", "n_watch", (F.col("best") + 0.0).alias("best"), F.when(F.col("state") == "defensive", F.least(F.lit(8), exposure)).otherwise(exposure).cast("int").alias("exposure"))


def cl(x, a, b):
    return f"greatest({a}, least({b}, {x}))"


RSI = f"""s1 AS (
  SELECT *, greatest(coalesce(close - lag(close) {WIN}, 0), 0) AS up_, greatest(-coalesce(close - lag(close) {WIN}, 0), 0) AS dn_ FROM feat
), s2 AS (SELECT *, {fullsql('avg', 'up_', 14)} AS g_, {fullsql('avg', 'dn_', 14)} AS l_ FROM s1),
ri AS (SELECT *, coalesce(nullif(CASE WHEN l_ = 0 AND g_ = 0 THEN NULL WHEN l_ = 0 THEN 100.0 ELSE 100 - 100 / (1 + g_ / nullif(l_, 0)) END, 0), 50) AS rsi FROM s2)"""
#: ... -> mkt: the part of the candidates' SQL up to the market state.
MARKET = CAND.split(", scored AS")[0].split("," + chr(10) + "scored AS")[0]
#: ... -> pick; needs WITH RECURSIVE.
PICK = f"""{MARKET}, {MEANS}, {RSI}, kd AS (
  SELECT symbol, date, e12 - e26 AS mc, sig, coalesce(nullif(kk, 0), 50) AS kk, coalesce(nullif(dd, 0), 50) AS dd, coalesce(nullif(3 * kk - 2 * dd, 0), 50) AS jj FROM e
), sg AS (
  SELECT r.*, m.state,
    (CASE WHEN mc - sig > 0 THEN CASE WHEN mc > sig THEN 20 ELSE 10 END WHEN mc < sig THEN -20 ELSE -10 END
     + CASE WHEN kk > dd AND kk > 50 THEN 15 WHEN kk < dd AND kk < 50 THEN -15 ELSE 0 END + CASE WHEN jj > 100 THEN -10 WHEN jj < 0 THEN 10 ELSE 0 END
     + CASE WHEN rsi > 70 THEN -15 WHEN rsi < 30 THEN 15 ELSE 0 END
     + CASE WHEN coalesce(ma5, 0) = 0 OR coalesce(ma10, 0) = 0 OR coalesce(ma20, 0) = 0 OR coalesce(ma60, 0) = 0 THEN 0
            WHEN close > ma5 AND ma5 > ma10 AND ma10 > ma20 THEN 20 WHEN close < ma5 AND ma5 < ma10 AND ma10 < ma20 THEN -20 ELSE 0 END
     + CASE WHEN coalesce(boll_upper, 0) = 0 OR coalesce(boll_lower, 0) = 0 THEN 0 WHEN close > boll_upper THEN 5 WHEN close < boll_lower THEN 10 ELSE 0 END)::INT AS signal_score
  FROM ri r JOIN mkt m ON m.date = r.date JOIN kd ON kd.symbol = r.symbol AND kd.date = r.date
), p1 AS (
  SELECT *, {cl('(volume_ratio_20 - 1) * 1.8 + 0.08 * pct_change', -5, 5)} AS inflow, {cl('2 + 2.5 * volume_ratio_20 + 0.35 * abs(pct_change)', 0.3, 25)} AS turn,
    coalesce(rsi >= 78 OR ma20_gap_pct >= 10 OR return_20d >= 24 OR pct_change >= 6.5, false) AS hot,
    coalesce(return_20d <= -14 OR from_20d_high_pct <= -22 OR (close < 0.96 * ma20 AND ma20 < ma60), false) AS broken,
    coalesce(ma_alignment >= 3 AND return_20d BETWEEN -3 AND 18 AND from_20d_high_pct >= -10 AND ma20_gap_pct <= 7.5 AND rsi <= 72, false) AS structure,
    coalesce(volume_ratio_20 BETWEEN 0.75 AND 3.2, false) AS vol FROM sg
), p2 AS (
  SELECT *, {cl('0.52 + signal_score / 250.0', 0.05, 0.95)} + {cl('0.012 * inflow', -0.05, 0.05)} + CASE state WHEN 'defensive' THEN -0.03 WHEN 'offensive' THEN 0.02 ELSE 0 END AS up0,
    {cl('0.34 - signal_score / 400.0', 0.05, 0.90)} + CASE WHEN turn > 15 THEN 0.05 WHEN turn < 1 THEN 0.02 WHEN turn >= 3 AND turn <= 10 THEN -0.01 ELSE 0 END
      + CASE state WHEN 'defensive' THEN 0.05 WHEN 'offensive' THEN -0.03 ELSE 0 END AS dd0,
    CASE WHEN broken THEN 24 ELSE 0 END + CASE WHEN structure THEN 0 ELSE 10 END + CASE WHEN vol THEN 0 ELSE 5 END + CASE WHEN inflow >= -0.35 THEN 0 ELSE 6 END + CASE WHEN hot THEN 12 ELSE 0 END AS penalty
  FROM p1
), p3 AS (
  SELECT *, {cl(f"CASE WHEN penalty > 0 THEN {cl('up0 - penalty / 380.0', 0.05, 0.86)} ELSE up0 END", 0.05, 0.80)} AS up_prob,
    {cl(f"CASE WHEN penalty > 0 THEN {cl('dd0 + penalty / 320.0', 0.08, 0.90)} ELSE dd0 END", 0.10, 0.90)} AS dd_prob, signal_score - 0.65 * penalty AS sp, {cl('50 + 8 * inflow', 0, 100)} AS flow,
    {cl("CASE WHEN turn <= 2 THEN 45 + 6 * turn WHEN turn <= 8 THEN 60 + 4 * (turn - 2) WHEN turn <= 15 THEN 84 - 2 * (turn - 8) ELSE 70 - 3 * (turn - 15) END", 0, 100)} AS ts FROM p2
), p4 AS (
  SELECT *, CASE WHEN up_prob >= 0.60 AND dd_prob <= 0.30 AND structure AND vol AND inflow >= -0.35 AND NOT hot AND NOT broken THEN 'buy'
                 WHEN up_prob >= 0.50 AND dd_prob <= 0.40 AND NOT broken THEN 'watch' ELSE 'pass' END AS action,
    0.25 * {cl('50 + 0.4 * sp', 0, 100)} + 0.20 * flow + 0.10 * ts + 0.20 * {cl('58 + 0.2 * sp', 0, 100)} + 0.25 * {cl('72 - 65 * dd_prob', 0, 100)} AS total,
    (up_prob - dd_prob) * 20 AS expected_return, CASE WHEN up_prob >= 0.68 AND dd_prob <= 0.22 THEN 'high' WHEN up_prob >= 0.55 THEN 'medium' ELSE 'low' END AS confidence,
    close * 0.92 AS stop_price, close * 1.14 AS take_price FROM p3
), p5 AS (SELECT *, round(total + 1e-9, 6) AS t6 FROM p4),
p6 AS (SELECT *, (rank() OVER (PARTITION BY date ORDER BY t6) - 1 + 0.5 * count(*) OVER (PARTITION BY date, t6)) / count(*) OVER (PARTITION BY date) AS mid_rank FROM p5),
pick AS (
  SELECT *, {cl("""0.34 * total + 0.46 * (22 * up_prob + 20 * (1 - dd_prob) + 0.20 * greatest(0, least(100, 72 - 65 * dd_prob)) + 0.24 * 48 + 0.14 * 45) + 0.20 * (48 + 24 * mid_rank)
    + CASE WHEN action = 'buy' THEN 2 ELSE 0 END + CASE confidence WHEN 'high' THEN 4 WHEN 'medium' THEN 2 ELSE 0 END + CASE WHEN inflow > 2 THEN 2 WHEN inflow < -1 THEN -4 ELSE 0 END
    + CASE WHEN dd_prob <= 0.20 THEN 1 ELSE 0 END - 14 + CASE state WHEN 'defensive' THEN -2 WHEN 'offensive' THEN 1 ELSE 0 END""", 0, 100)} AS display_score FROM p6
)"""
PICK_COLS = ["up_prob", "dd_prob", "total", "expected_return", "mid_rank", "display_score", "stop_price", "take_price"]

QUERIES = {"rule_signals": signals, "historical_picks": picks, "universe_screening": screening, "factor_contributions": explained, "daily_trade_plan": trade_plan}
HEAD = RECURSIVE.rsplit("SELECT symbol, date,", 1)[0]
SIGNALS = f"""{HEAD}, x1 AS (
  SELECT symbol, date, close, {", ".join(f"{fullsql('avg', 'close', n)} AS ma{n}" for n in (5, 10, 20, 60))}, {fullsql('stddev_samp', 'close', 20)} AS dev, count(*) OVER (PARTITION BY symbol) >= 60 AS enough,
    greatest(coalesce(close - lag(close) {WIN}, 0), 0) AS up_, greatest(-coalesce(close - lag(close) {WIN}, 0), 0) AS dn_ FROM bars
), x2 AS (SELECT *, {fullsql('avg', 'up_', 14)} AS g_, {fullsql('avg', 'dn_', 14)} AS l_ FROM x1),
x3 AS (
  SELECT x.symbol, x.date, close, {", ".join(f"CASE WHEN enough THEN coalesce(ma{n}, 0) ELSE 0 END AS ma{n}" for n in (5, 10, 20, 60))},
    CASE WHEN enough THEN coalesce(ma20 + 2 * dev, 0) ELSE 0 END AS bu, CASE WHEN enough THEN coalesce(ma20 - 2 * dev, 0) ELSE 0 END AS bl,
    CASE WHEN enough THEN e12 - e26 ELSE 0 END AS macd, CASE WHEN enough THEN sig ELSE 0 END AS sig,
    coalesce(nullif(CASE WHEN NOT enough OR (l_ = 0 AND g_ = 0) THEN NULL WHEN l_ = 0 THEN 100.0 ELSE 100 - 100 / (1 + g_ / nullif(l_, 0)) END, 0), 50) AS rsi,
    coalesce(nullif(CASE WHEN enough THEN kk END, 0), 50) AS k, coalesce(nullif(CASE WHEN enough THEN dd END, 0), 50) AS d, coalesce(nullif(CASE WHEN enough THEN 3 * kk - 2 * dd END, 0), 50) AS j
  FROM x2 x JOIN e ON e.symbol = x.symbol AND e.date = x.date
), x4 AS (
  SELECT *, CASE WHEN macd - sig > 0 THEN CASE WHEN macd > sig THEN 20 ELSE 10 END WHEN macd < sig THEN -20 ELSE -10 END AS pm, CASE WHEN rsi > 70 THEN -15 WHEN rsi < 30 THEN 15 ELSE 0 END AS pr,
    CASE WHEN k > d AND k > 50 THEN 15 WHEN k < d AND k < 50 THEN -15 ELSE 0 END AS pk, CASE WHEN j > 100 THEN -10 WHEN j < 0 THEN 10 ELSE 0 END AS pj,
    CASE WHEN ma5 = 0 OR ma10 = 0 OR ma20 = 0 OR ma60 = 0 THEN 0 WHEN close > ma5 AND ma5 > ma10 AND ma10 > ma20 THEN 20 WHEN close < ma5 AND ma5 < ma10 AND ma10 < ma20 THEN -20 ELSE 0 END AS pa,
    CASE WHEN bu = 0 OR bl = 0 THEN 0 WHEN close > bu THEN 5 WHEN close < bl THEN 10 ELSE 0 END AS pb,
    CASE WHEN macd - sig > 0 THEN CASE WHEN macd > sig THEN 15 ELSE 8 END WHEN macd < sig THEN 0 ELSE 3 END
    + CASE WHEN ma5 = 0 OR ma10 = 0 OR ma20 = 0 THEN 0 WHEN close > ma5 AND ma5 > ma10 AND ma10 > ma20 THEN 25 WHEN close < ma5 AND ma5 < ma10 AND ma10 < ma20 THEN 0 ELSE 10 END
    + CASE WHEN rsi >= 40 AND rsi <= 60 THEN 15 WHEN rsi < 30 THEN 20 WHEN rsi > 70 THEN 5 ELSE 10 END + CASE WHEN k > d AND k > 50 THEN 20 WHEN k < d AND k < 50 THEN 0 ELSE 10 END
    + CASE WHEN bu = 0 OR bl = 0 THEN 0 WHEN close < bl THEN 25 WHEN close > bu THEN 10 ELSE 15 END AS raw FROM x3
), x5 AS (SELECT *, (pm + pr + pk + pj + pa + pb)::INT AS signal_score FROM x4)
SELECT symbol, date, signal_score, CASE WHEN signal_score > 40 THEN 'strong_buy' WHEN signal_score > 20 THEN 'buy' WHEN signal_score > 0 THEN 'lean_buy' WHEN signal_score > -20 THEN 'hold' WHEN signal_score > -40 THEN 'sell' ELSE 'strong_sell' END AS signal,
  signal_score > 0 AS trend_up, least(raw, 100)::INT AS technical_score, raw > 60 AS technical_trend_up,
  concat_ws(',', CASE WHEN pm > 0 THEN 'macd_up' END, CASE WHEN pr > 0 THEN 'oversold' END, CASE WHEN pr < 0 THEN 'overbought' END, CASE WHEN pk > 0 THEN 'kd_up' END, CASE WHEN pa > 0 THEN 'ma_bull' END, CASE WHEN pa < 0 THEN 'ma_bear' END) AS codes FROM x5
"""
CONTRIB = " UNION ALL ".join(f"SELECT symbol, date, '{c}' AS factor, coalesce({c}, 0) * {w} AS v FROM last" for c, w in WEIGHTS.items())
SQL = {
    "rule_signals": SIGNALS,
    "historical_picks": f"WITH RECURSIVE {PICK} SELECT symbol, date, signal_score, penalty::INT AS penalty, action, confidence, {', '.join(f'{rs(c)} AS {c}' for c in PICK_COLS)} FROM pick",
    "daily_trade_plan": f"""WITH RECURSIVE {PICK}, g AS (SELECT date, state, count(*) FILTER (WHERE action = 'buy') AS n_buy, count(*) FILTER (WHERE action = 'watch') AS n_watch, {rs('max(display_score)')} AS best FROM pick GROUP BY 1, 2)
SELECT *, (CASE WHEN state = 'defensive' THEN least(8, 30, n_buy * 10) ELSE least(30, n_buy * 10) END)::INT AS exposure FROM g""",
    "universe_screening": f"""WITH {FEATURES}, ind AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS symbol, n_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey),
k AS (
  SELECT f.*, industry, round(0.5 * {cl("CASE WHEN turnover_inferred <= 2 THEN 45 + 6 * turnover_inferred WHEN turnover_inferred <= 10 THEN 57 + 3.5 * (turnover_inferred - 2) WHEN turnover_inferred <= 20 THEN 85 - 2 * (turnover_inferred - 10) ELSE 65 - 2 * (turnover_inferred - 20) END", 0, 100)}
    + 0.3 * least(100.0, amount_yi * 6 * 1e4) + (12 - abs(pct_change - 2.5)) + coalesce((close - low) / nullif(high - low, 0), 0.5) * 10 + 1e-9, 4) AS prescore
  FROM feat f JOIN ind USING (symbol) WHERE close >= 5 AND amount >= 1e4 AND abs(pct_change) <= 9.5
), i AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY date, industry ORDER BY prescore DESC, symbol) <= 3)
SELECT date, symbol, industry, (row_number() OVER (PARTITION BY date ORDER BY prescore DESC, symbol))::INT AS pos, {rs('prescore')} AS prescore FROM i QUALIFY pos <= 40""",
    "factor_contributions": f"""WITH {FEATURES}, last AS (SELECT * FROM feat QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1), c AS ({CONTRIB}),
p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY v DESC, factor) AS np, row_number() OVER (PARTITION BY symbol ORDER BY v, factor) AS nn FROM c)
SELECT symbol, date, coalesce(string_agg(factor, ',' ORDER BY np) FILTER (WHERE v > 0 AND np <= 3), '') AS positive,
  coalesce(string_agg(factor, ',' ORDER BY nn) FILTER (WHERE v < 0 AND nn <= 3), '') AS negative FROM p GROUP BY 1, 2""",
}
