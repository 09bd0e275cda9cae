"""Queries over live picks: every risk profile and strategy at once, and the pools that the profiles select from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import clamp
from ..operators import indicators as ind
from ..operators import live, pools, rules
from ..operators import ranking as rk
from ..sources import adapters as src
from .q_rules import PICK, cl, signal_panel
from .sqltext import FEATURES, r, rs

SHOWN = ["up_prob", "dd_prob", "edge", "profit_factor", "total", "expected_return", "stop_price", "take_price"]


def live_panel(spark, d, **rows):
    """What the live pick reads of every bar, or of ``rows`` (its own ranks and probabilities come later), with a news balance by symbol, taken from its supplier's account."""
    news = src.industry(spark, d).select("symbol", clamp((F.col("s_acctbal") - 4500) / 225, -24, 24).alias("news_net"))
    panel = rules.with_activity(signal_panel(spark, d, **rows)).select("symbol", "date", "state", *live.INPUTS)
    return panel.join(news, "symbol").withColumn("news_total", 50 + F.col("news_net"))


def live_picks(spark, d):
    out = live.live_pick(live_panel(spark, d)).where("action <> 'pass'")
    return out.select("symbol", "date", "risk", "strategy", "action", "confidence", "penalty", F.concat_ws(",", "notes").alias("notes"), "position_pct", *(r(c).alias(c) for c in SHOWN))


def profile_counts(spark, d):
    """How often each profile and strategy buys, watches and passes in each market state, with the mean edge of its picks."""
    out = live.live_pick(live_panel(spark, d)).groupBy("risk", "strategy", "state").agg(
        *(F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("buy", "watch", "pass")), r(F.avg(F.when(F.col("action") != "pass", F.col("edge"))), 3).alias("avg_edge")
    )
    return out


def risk_picks(spark, d):
    """The breakout picks that each profile selects on every date, with their ranking key."""
    p = live.live_pick(live_panel(spark, d), strategies=("breakout",)).where("action <> 'pass'")
    p = p.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("dd_prob", "turn", "inflow", "risk_adjusted", "edge")})
    return pools.profile_selection(p).select("date", "symbol", "risk", r("key").alias("key"))


def displayed(spark, d):
    """What users of the three profiles see on every date."""
    p = live.live_pick(live_panel(spark, d), strategies=("breakout",)).where("action <> 'pass'")
    p = p.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("dd_prob", "turn", "inflow", "risk_adjusted", "edge", "profit_factor")})
    out = pools.display_pool(p, threshold=70.0)
    return out.select("date", "symbol", "risk", "rank_no", "threshold", r("display_score").alias("display_score"))


def market_today(spark, d):
    """Live market state of every date, over all symbols that have a bar; the news balance is the date's number of symbols against forty."""
    quotes = ind.daily_change(src.bars(spark, d)).select("date", "pct_change")
    news = quotes.groupBy("date").agg(F.count("*").alias("n")).select("date", (50 + F.col("n") - 40.0).alias("policy_score"))
    out = rk.live_market_state(quotes, news, ["date"])
    return out.select("date", "state", "confidence", "exposure_min", "exposure_max", *(r(c).alias(c) for c in ("state_score", "trend_score", "breadth_score", "flow_score", "risk_score", "news_score")))


def values_of_profiles() -> str:
    rows = [f"('{k[0]}', '{k[1]}', {', '.join(map(str, live.RISKS[k[0]] + v + live.WEIGHTS[k]))})" for k, v in live.LIMITS.items()]
    names = ["risk", "strategy", *live.RISK_NAMES, *live.LIMIT_NAMES, *(f"w{k}" for k in range(7))]
    return f"prof AS (SELECT {', '.join(n if n in ('risk', 'strategy') else f'{n}::DOUBLE AS {n}' for n in names)} FROM (VALUES {', '.join(rows)}) v({', '.join(names)}))"


def pts(*rules):
    return " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for p, c in rules)


def by(a, b):
    return f"CASE WHEN trend_ THEN {a} ELSE {b} END"


TURN = cl("CASE WHEN turn <= 2 THEN 45 + 6 * turn WHEN turn <= 8 THEN 60 + 4 * (turn - 2) WHEN turn <= 15 THEN 84 - 2 * (turn - 8) ELSE 70 - 3 * (turn - 15) END", 0, 100)
#: ... -> live; needs WITH RECURSIVE.
LIVE = f"""{PICK}, {values_of_profiles()}, l0 AS (
  SELECT p.symbol, p.date, close, rsi, p.state, signal_score::DOUBLE AS s, inflow, turn, pct_change AS pct, prev_pct_change, return_5d AS r5, return_20d AS r20, from_20d_high_pct AS high_, ma20_gap_pct AS gap, ma20, ma60, boll_lower, boll_mid,
    least(volume_ratio_5, 5) AS vr, coalesce(mc - sig, 0) AS hist, {cl('(s_acctbal - 4500) / 225', -24, 24)} AS news,
    {pts(*((1, f'coalesce({a} >= {b} AND {b} > 0, false)') for a, b in (('close', 'ma5'), ('close', 'ma10'), ('close', 'ma20'), ('ma20', 'ma60'))))} AS align
  FROM p1 p JOIN kd ON kd.symbol = p.symbol AND kd.date = p.date JOIN (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS symbol, s_acctbal FROM supplier) su ON su.symbol = p.symbol
), l1 AS (
  SELECT *, coalesce(boll_lower > 0 AND close <= boll_lower * 1.04, false) AS near_band, coalesce(boll_mid > 0 AND close >= boll_mid * 0.99, false) AS reclaimed, pct > 0.6 AND prev_pct_change < 0 AS rebound_day,
    rsi <= 35 AS oversold, hist >= -0.03 AS repair, rsi >= 78 OR gap >= 10 OR r20 >= 24 OR pct >= 6.5 AS hot_,
    coalesce(r20 <= -14 OR high_ <= -22 OR (ma20 > 0 AND ma60 > 0 AND close < ma20 * 0.96 AND ma20 < ma60), false) AS broken_,
    {pts((18, 'align >= 3'), (14, 'r20 BETWEEN 1.5 AND 20'), (10, 'r5 >= 0'), (12, 'high_ BETWEEN -2 AND 4'), (10, 'vr BETWEEN 0.9 AND 2.8'), (8, 'inflow >= 0'))} AS bp,
    {pts((14, 'pct >= 6.5'), (12, 'r20 >= 28'), (8, 'gap >= 10'), (8, 'turn >= 18'), (6, 'inflow < -0.3'))} AS bm, {pts((10, 'pct >= 7'), (8, 'turn >= 18'), (6, 'inflow < -0.5'))} AS rm,
    {pts((12, 'r20 BETWEEN -14 AND 6'), (10, 'high_ BETWEEN -3 AND 0'), (8, 'vr BETWEEN 0.8 AND 2.2'), (8, 'inflow >= -0.2'))} AS rp0
  FROM l0
), l2 AS (
  SELECT *, {pts((24, 'oversold'), (18, 'near_band'), (16, 'rebound_day'), (12, 'repair'), (8, 'reclaimed'))} AS back,
    align >= 3 AND r20 BETWEEN -3 AND 18 AND high_ >= -10 AND gap <= 7.5 AND rsi <= 72 AS shape_b, r20 BETWEEN -18 AND 8 AND high_ >= -20 AND rsi <= 48 AND (rebound_day OR reclaimed OR repair) AS shape_r,
    {cl(f"{cl(f'''{cl('0.52 + s / 250', 0.05, 0.95)} + {cl('inflow * 0.012', -0.05, 0.05)}''', 0.05, 0.95)} + {cl('news / 500', -0.06, 0.06)}", 0.05, 0.95)} AS u0,
    {cl(f"{cl(f'''{cl('0.34 - s / 400', 0.05, 0.90)} + CASE WHEN turn > 15 THEN 0.05 WHEN turn < 1 THEN 0.02 WHEN turn >= 3 AND turn <= 10 THEN -0.01 ELSE 0 END''', 0.05, 0.90)} - {cl('news / 700', -0.05, 0.05)}", 0.05, 0.90)} AS d0,
    {cl('50 + inflow * 8', 0, 100)} AS f0, {TURN} AS t0 FROM l1
), l3 AS (
  SELECT l2.*, prof.*, strategy = 'breakout' AS trend_, rp0 + back AS rp FROM l2 CROSS JOIN prof
), l4 AS (
  SELECT *, {by('u0', cl(f"u0 - 0.08 + back / 180.0 + {cl('inflow * 0.01', -0.04, 0.04)}", 0.05, 0.95))} AS u1, {by('d0', cl('d0 + 0.05 - back / 220.0', 0.05, 0.90))} AS d1, {by('f0', cl('f0 * 0.7 + back * 0.3', 0, 100))} AS f1_,
    {by('t0', cl('t0 * 0.85 + CASE WHEN turn >= 1 AND turn <= 10 THEN 50 ELSE 36 END * 0.15', 0, 100))} AS t1, {by('s * 0.78 + bp * 0.82 - bm * 0.55', 's * 0.72 + back * 0.75')} AS s1_ FROM l3
), l5 AS (
  SELECT *, {cl(f"u1 + ({by('bp / 260.0 - bm / 520.0', 'rp / 340.0 - rm / 600.0')})", 0.05, 0.95)} AS u2, {cl(f"d1 + ({by('bm / 460.0 - bp / 420.0', 'rm / 500.0 - rp / 520.0')})", 0.05, 0.90)} AS d2,
    {cl(by('56 + s1_ * 0.16 + bp * 0.40 - bm * 0.32', '58 + s1_ * 0.12 + rp * 0.28 - rm * 0.22'), 0, 100)} AS q1 FROM l4
), l6 AS (
  SELECT *, {cl("u2 + CASE state WHEN 'defensive' THEN -0.03 WHEN 'offensive' THEN 0.02 ELSE 0 END", 0.05, 0.95)} AS u3, {cl("d2 + CASE state WHEN 'defensive' THEN 0.05 WHEN 'offensive' THEN -0.03 ELSE 0 END", 0.05, 0.90)} AS d3,
    concat_ws(',', CASE WHEN broken_ THEN 'broken' END, CASE WHEN NOT {by('shape_b', 'shape_r')} THEN 'shape' END, CASE WHEN trend_ AND NOT vr BETWEEN 0.75 AND 3.2 THEN 'volume' END, CASE WHEN inflow < {by(-0.35, -0.6)} THEN 'flow' END,
      CASE WHEN trend_ AND hot_ THEN 'hot' END, CASE WHEN NOT trend_ AND rsi < 22 THEN 'weak' END, CASE WHEN news <= -18 THEN 'news' END) AS notes FROM l5
), l7 AS (
  SELECT *, {pts(*((p, f"list_contains(string_split(notes, ','), '{n}')") for n, p in (('broken', 24), ('shape', 10), ('volume', 5), ('flow', 6), ('hot', 12), ('weak', 12), ('news', 6))))} AS penalty_ FROM l6
), l8 AS (
  SELECT *, {cl(f"CASE WHEN penalty_ > 0 THEN {cl('u3 - penalty_ / 380.0', 0.05, 0.86)} ELSE u3 END", 0.05, 0.80)} AS up_, {cl(f"CASE WHEN penalty_ > 0 THEN {cl('d3 + penalty_ / 320.0', 0.08, 0.90)} ELSE d3 END", 0.10, 0.90)} AS dn,
    CASE WHEN penalty_ > 0 THEN {cl('q1 - penalty_', 0, 100)} ELSE q1 END AS q2, s1_ - penalty_ * 0.65 AS s2_,
    CASE WHEN inflow < 0 THEN least(10.0, abs(inflow) * 5) ELSE 0 END + CASE WHEN turn < 0.8 THEN 6.0 WHEN turn > 18 THEN least(10.0, (turn - 18) * 1.2) ELSE 0 END + CASE WHEN trend_ AND pct > 6 THEN 6.0 WHEN NOT trend_ AND pct > 8 THEN 4.0 ELSE 0 END AS cost FROM l7
), l9 AS (
  SELECT *, up_ * (take * 100) - dn * (stop * 100) AS edge, (up_ * take + 0.005) / (dn * stop + 0.005) AS profit_factor FROM l8
), l10 AS (
  SELECT *, {cl('48 + edge * 6.5 + (profit_factor - 1) * 15 - cost', 0, 100)} AS es, oversold OR near_band AS zone,
    up_ >= buy_up AND dn <= buy_dd AND f1_ >= buy_flow AND notes = '' AND edge >= edge_gate AND profit_factor >= pf_gate AS may_buy,
    up_ >= watch_up AND dn <= watch_dd AND notes NOT LIKE '%broken%' AND notes NOT LIKE '%weak%' AND edge >= watch_gate AS may_watch FROM l9
), l11 AS (
  SELECT *, CASE WHEN may_buy AND (trend_ OR CASE risk WHEN 'low' THEN zone AND repair WHEN 'high' THEN zone OR rebound_day ELSE zone AND (rebound_day OR repair) END) THEN 'buy'
                 WHEN may_watch AND (trend_ OR oversold OR rebound_day) THEN 'watch' ELSE 'pass' END AS act,
    {cl('50 + s2_ * 0.4', 0, 100)} AS trend, {cl('f1_ - cost * 0.35', 0, 100)} AS fs, {cl('t1 - cost * 0.25', 0, 100)} AS tu, {cl('q2 * 0.68 + es * 0.32', 0, 100)} AS quality, {cl('74 - dn * 68 - cost * 0.55', 0, 100)} AS risk_adjusted FROM l10
), live AS (
  SELECT symbol, date, state, risk, strategy, act AS action, CASE WHEN up_ >= 0.68 AND dn <= 0.22 THEN 'high' WHEN up_ >= 0.55 THEN 'medium' ELSE 'low' END AS confidence, penalty_::DOUBLE AS penalty, notes,
    least(most, 10) * CASE WHEN act = 'buy' THEN 1.0 ELSE 0.5 END::DOUBLE AS position_pct, up_ AS up_prob, dn AS dd_prob, edge, profit_factor, (up_ - dn) * factor AS expected_return, close * (1 - stop) AS stop_price, close * (1 + take) AS take_price,
    {cl(f"trend * w0 + fs * w1 + tu * w2 + quality * w3 + risk_adjusted * w4 + es * w5 + {cl('50 + news', 0, 100)} * w6", 0, 100)} AS total, trend, quality, risk_adjusted, turn, inflow, fs FROM l11
)"""

GROWTH = "CASE WHEN symbol[1:3] IN ('300', '688') THEN 4.0 ELSE 0.0 END"
KEY = {
    "low": f"(1 - dd) * 34 + ra * 0.28 + quality * 0.16 + {cl('100 - abs(tn - 4) * 8', 0, 100)} * 0.10 + {cl('fl * 8 + 50', 0, 100)} * 0.08 + total * 0.04 - {GROWTH}",
    "medium": f"up_prob * 20 + (1 - dd) * 20 + {cl('50 + ed * 6', 0, 100)} * 0.28 + {cl('45 + (profit_factor - 1) * 22', 0, 100)} * 0.14 + total * 0.18",
    "high": f"""up_prob * 22 + expected_return * 1.6 + ed * 2.2 + (profit_factor - 1) * 8 + {cl('tn * 7.5', 0, 100)} * 0.42 + trend * 0.14 + total * 0.06 + CASE WHEN action = 'watch' THEN 14.0 ELSE 0.0 END
      + CASE WHEN tn >= 10 THEN 8.0 WHEN tn >= 8 THEN 4.0 ELSE 0.0 END + {GROWTH} - dd * 6""",
}
def chosen_sql(rows: str, out: str) -> str:
    """CTE ``out``: the rows that their profile selects."""
    return f"""{out}_a AS (SELECT *, action = 'buy' AND dd <= 0.24 AND ra >= 56 AND tn <= 9 AND fl >= -0.2 AS strict, action = 'buy' AND dd <= 0.32 AND ra >= 50 AS loose,
  dd <= 0.55 AND ed >= 0 AS fits, action = 'watch' OR tn >= 9 OR symbol[1:3] IN ('300', '688') AS lively FROM {rows}),
{out}_b AS (SELECT *, count(*) FILTER (WHERE strict) OVER (PARTITION BY date, risk) AS n1, count(*) FILTER (WHERE fits AND lively) OVER (PARTITION BY date, risk) AS n2 FROM {out}_a),
{out} AS (SELECT * EXCLUDE (strict, loose, fits, lively, n1, n2) FROM {out}_b WHERE CASE risk WHEN 'low' THEN CASE WHEN n1 < 8 THEN loose ELSE strict END WHEN 'medium' THEN dd <= 0.42 ELSE fits AND (n2 < 10 OR lively) END)"""


SIX = ", ".join(f"round({c} + 1e-9, 6) AS {n}" for c, n in (("dd_prob", "dd"), ("turn", "tn"), ("inflow", "fl"), ("risk_adjusted", "ra"), ("edge", "ed"), ("profit_factor", "pf")))
QUERIES = {"live_picks": live_picks, "live_profile_counts": profile_counts, "risk_selection": risk_picks, "display_pool": displayed, "live_market_state": market_today}
SQL = {
    "live_picks": f"WITH RECURSIVE {LIVE} SELECT symbol, date, risk, strategy, action, confidence, penalty, notes, position_pct, {', '.join(f'{rs(c)} AS {c}' for c in SHOWN)} FROM live WHERE action <> 'pass'",
    "live_profile_counts": f"""WITH RECURSIVE {LIVE} SELECT risk, strategy, state, {', '.join(f"count(*) FILTER (WHERE action = '{a}') AS n_{a}" for a in ('buy', 'watch', 'pass'))},
  {rs("avg(edge) FILTER (WHERE action <> 'pass')", 3)} AS avg_edge FROM live GROUP BY 1, 2, 3""",
    "risk_selection": f"""WITH RECURSIVE {LIVE}, k1 AS (
  SELECT *, round(dd_prob + 1e-9, 6) AS dd, round(turn + 1e-9, 6) AS tn, round(inflow + 1e-9, 6) AS fl, round(risk_adjusted + 1e-9, 6) AS ra, round(edge + 1e-9, 6) AS ed FROM live WHERE strategy = 'breakout' AND action <> 'pass'
), k2 AS (SELECT *, action = 'buy' AND dd <= 0.24 AND ra >= 56 AND tn <= 9 AND fl >= -0.2 AS strict, action = 'buy' AND dd <= 0.32 AND ra >= 50 AS loose,
  dd <= 0.55 AND ed >= 0 AS fits, action = 'watch' OR tn >= 9 OR symbol[1:3] IN ('300', '688') AS lively FROM k1),
k3 AS (SELECT *, count(*) FILTER (WHERE strict) OVER (PARTITION BY date, risk) AS n1, count(*) FILTER (WHERE fits AND lively) OVER (PARTITION BY date, risk) AS n2 FROM k2)
SELECT date, symbol, risk, CASE risk {' '.join(f"WHEN '{k}' THEN {rs(v)}" for k, v in KEY.items())} END AS key FROM k3
WHERE CASE risk WHEN 'low' THEN CASE WHEN n1 < 8 THEN loose ELSE strict END WHEN 'medium' THEN dd <= 0.42 ELSE fits AND (n2 < 10 OR lively) END""",
    "display_pool": f"""WITH RECURSIVE {LIVE}, k0 AS (SELECT *, {SIX} FROM live WHERE strategy = 'breakout' AND action <> 'pass'), {chosen_sql('k0', 'k1')},
k2 AS (SELECT *, round(total + 1e-9, 6) AS t6 FROM k1 WHERE state <> 'defensive' OR CASE risk WHEN 'high' THEN dd <= 0.40 ELSE action = 'buy' AND dd <= 0.30 END),
k3 AS (SELECT *, 48 + 24 * (rank() OVER (PARTITION BY date, risk ORDER BY t6) - 1 + 0.5 * count(*) OVER (PARTITION BY date, risk, t6)) / count(*) OVER (PARTITION BY date, risk) AS rel FROM k2),
k4 AS (SELECT *, {cl(f"""0.34 * total + 0.46 * (22 * up_prob + 20 * (1 - dd) + 0.20 * ra + 0.24 * {cl('48 + 6.5 * ed', 0, 100)} + 0.14 * {cl('45 + 22 * (pf - 1)', 0, 100)}) + 0.20 * rel
  + CASE WHEN action = 'buy' THEN 2 ELSE 0 END + CASE confidence WHEN 'high' THEN 4 WHEN 'medium' THEN 2 ELSE 0 END + CASE WHEN fl > 2 THEN 2 WHEN fl < -1 THEN -4 ELSE 0 END + CASE WHEN dd <= 0.20 THEN 1 ELSE 0 END
  - CASE WHEN ed < 0.6 THEN 8 WHEN ed < 1.5 THEN 3 ELSE 0 END - CASE WHEN pf < 1.15 THEN 6 WHEN pf < 1.30 THEN 2 ELSE 0 END + CASE state WHEN 'defensive' THEN -2 WHEN 'offensive' THEN 1 ELSE 0 END""", 0, 100)} AS ds FROM k3), {chosen_sql('k4', 'k5')},
k6 AS (SELECT *, round(ds + 1e-9, 4) AS s4, round(CASE risk {' '.join(f"WHEN '{k}' THEN {v.replace('profit_factor', 'pf')}" for k, v in KEY.items())} END + 1e-9, 6) AS key, CASE risk WHEN 'low' THEN 74 WHEN 'high' THEN 64 ELSE 70 END AS th,
  CASE risk WHEN 'high' THEN 66 WHEN 'medium' THEN 68 END AS ez FROM k5),
k7 AS (SELECT *, count(*) FILTER (WHERE s4 >= th) OVER (PARTITION BY date, risk) AS n, count(*) FILTER (WHERE s4 >= ez) OVER (PARTITION BY date, risk) AS m FROM k6),
k8 AS (SELECT *, CASE WHEN n < 24 AND ez IS NOT NULL AND m > n THEN ez ELSE th END::DOUBLE AS threshold FROM k7),
k9 AS (SELECT *, row_number() OVER (PARTITION BY date, risk ORDER BY key DESC, symbol)::INT AS rank_no FROM k8 WHERE s4 >= threshold)
SELECT date, symbol, risk, rank_no, threshold, {rs('ds')} AS display_score FROM k9 WHERE rank_no <= CASE risk WHEN 'low' THEN 18 WHEN 'high' THEN 40 ELSE 30 END""",
    "live_market_state": f"""WITH {FEATURES}, g AS (SELECT date, avg(pct_change) AS a, avg((pct_change > 0)::INT) AS u, count(*) AS n FROM feat GROUP BY 1),
h AS (SELECT *, {cl('50 + a * 4', 0, 100)} AS trend_score, {cl('u * 100', 0, 100)} AS breadth_score, {cl('45 + a * 3', 0, 100)} AS flow_score, {cl('65 - abs(a) * 4', 0, 100)} AS risk_score, {cl('50 + n - 40.0', 0, 100)} AS news_score FROM g),
k AS (SELECT *, round({cl('0.28 * trend_score + 0.22 * breadth_score + 0.16 * flow_score + 0.16 * risk_score + 0.18 * news_score', 0, 100)} + 1e-9, 6) AS state_score FROM h)
SELECT date, CASE WHEN state_score >= 65 THEN 'offensive' WHEN state_score >= 45 THEN 'neutral' ELSE 'defensive' END AS state, CASE WHEN n >= 5 THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN state_score >= 65 THEN 50 WHEN state_score >= 45 THEN 30 ELSE 10 END AS exposure_min, CASE WHEN state_score >= 65 THEN 75 WHEN state_score >= 45 THEN 50 ELSE 30 END AS exposure_max,
  {', '.join(f'{rs(c)} AS {c}' for c in ('state_score', 'trend_score', 'breadth_score', 'flow_score', 'risk_score', 'news_score'))} FROM k""",
}
