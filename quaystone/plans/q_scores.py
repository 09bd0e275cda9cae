"""Queries over factor scores, decisions, pool selection and vendor payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow as fl
from ..operators import indicators as ind
from ..operators import rules, scores
from ..operators import trades as tr
from ..sources import adapters as src
from ..sources import payloads
from ..sources.adapters import BARS, INDUSTRY, MONEY_FLOW
from .q_data import BIG, SIGNED
from ..sources.shared import written
from .q_ranking import LAB, labelled
from .q_rules import MARKET, PICK, pick_panel
from .sqltext import r, rs


def flows(spark, d):
    return fl.tier_summary(fl.last_days(src.money_flow(spark, d), 60)).withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in ("main_net", "control_ratio")})


def factor_scores(spark, d):
    f, i = flows(spark, d), src.industry(spark, d)
    strong = F.col("strength") == "strong"
    a = F.abs("s_acctbal")
    roe, grow, pe = F.col("s_acctbal") / 400, F.col("s_acctbal") % 37, a % 60
    s, label = scores.flow_signal(F.col("main_net"), F.col("control_ratio"), strong)
    flow, fund, val = scores.flow_score(F.col("main_net"), F.col("control_ratio"), strong), scores.fundamental_score(roe, grow, grow * 0.8), scores.valuation_score(pe, pe / 8)
    total = rules.composite(F.lit(50.0), flow, fund, val)
    return f.join(i, "symbol").select("symbol", flow.alias("flow_score"), s.alias("flow_signal_score"), label.alias("flow_signal"), fund.alias("fundamental_score"), val.alias("valuation_score"), r(total).alias("total"), rules.rating(F.round(total + 1e-9, 6)).alias("rating"))


def decisions(spark, d):
    latest = ind.latest(pick_panel(spark, d)).select("symbol", "signal_score", "close")
    out = scores.decide(latest.join(flows(spark, d), "symbol"), scores.profiles(spark))
    return out.select("symbol", "risk_level", "period", r("decision_score").alias("decision_score"), "decision", r("position").alias("position"), r("take_price").alias("take_price"), r("stop_price").alias("stop_price"))


def relaxed(spark, d):
    p = pick_panel(spark, d).withColumn("s", F.round(F.col("display_score") + 1e-9, 4))
    return scores.relaxed_selection(p, "s", threshold=42.0, need=3, floor=36.0).select("date", "symbol", (F.col("s") + 0.0).alias("score"), F.col("threshold").cast("double").alias("threshold"))


def scored(spark, d):
    return labelled(spark, d).where("tradability_status = 'tradable'").select("trade_date", "symbol", F.col("rank_score").alias("score"), F.col("return_5d_pct").alias("ret"))


EDGES = (0.0, 5.0, 10.0, 20.0, 40.0)


def calibrated(spark, d):
    return tr.calibration(scored(spark, d), EDGES).select("bucket", "n", "wins", "losses", r("avg_return", 3).alias("avg_return"), "calibrated")


def recalibrated(spark, d):
    s = written(scored(spark, d), "scored")
    p = pick_panel(spark, d).select(F.col("date").alias("trade_date"), "symbol", "up_prob")
    return scores.recalibrated(F.broadcast(s).join(p, ["trade_date", "symbol"]), s, EDGES).select("trade_date", "symbol", "bucket", r("up_calibrated").alias("up_calibrated"))


def quotes(spark, d):
    b = ind.latest(src.bars(spark, d)).withColumns({c: F.round(F.col(c) + 1e-9, 2) for c in ("open", "close", "volume", "amount")})
    blank = [F.lit("")] * 24
    text = F.concat_ws("~", F.lit("1"), F.concat(F.lit("name"), "symbol"), "symbol", *(F.col(c).cast("string") for c in ("close", "open", "open", "volume")), *blank[:23], F.date_format("date", "yyyyMMddHHmmss"), *[F.lit("")] * 4, F.concat_ws("/", F.lit("a"), F.lit("b"), F.col("amount").cast("string")))
    lines = b.select(F.concat(F.lit('v_x="'), text, F.lit('";')).alias("value"))
    return payloads.quote_lines(lines).select("symbol", "name", r("price", 2).alias("price"), r("volume", 2).alias("volume"), r("amount", 2).alias("amount"), F.to_date("ts").alias("date"))


def klines(spark, d):
    b = src.bars(spark, d)
    packed = b.groupBy("symbol").agg(F.to_json(F.array_sort(F.collect_list(F.array(F.col("date").cast("string"), *(F.round(F.col(c) + 1e-9, 2).cast("string") for c in ("open", "close", "high", "low", "volume")))))).alias("payload"))
    return payloads.kline_json(packed).select("symbol", "date", *(r(c, 2).alias(c) for c in ("open", "close", "high", "low", "volume")))


def history(spark, d):
    b = src.bars(spark, d).select("symbol", F.date_format("date", "yyyyMMdd").alias("trade_date"), *(F.round(F.col(c) + 1e-9, 2).alias(c) for c in ("open", "high", "low", "close")), F.col("volume").cast("string").alias("vol"), F.col("amount").alias("turnover"))
    return payloads.normalize_history(b).select("symbol", "date", *(r(c, 2).alias(c) for c in ("open", "close", "volume", "amount")))


FLOW = f"""{MONEY_FLOW}, fl0 AS (SELECT * FROM money_flow QUALIFY dense_rank() OVER (PARTITION BY symbol ORDER BY date DESC) <= 60),
fl1 AS (SELECT symbol, sum(CASE WHEN {BIG} THEN {SIGNED} ELSE 0 END) AS m, sum(CASE WHEN {BIG} THEN amount ELSE 0 END) AS t FROM fl0 GROUP BY symbol),
fl2 AS (SELECT symbol, round(m + 1e-9, 4) AS mn, round(coalesce(abs(m) / nullif(t, 0), 0) * 100 + 1e-9, 4) AS cr, coalesce(abs(m) / nullif(t, 0), 0) * 100 >= 10 AS strong FROM fl1)"""


def st(x, limits, other):
    return "CASE " + " ".join(f"WHEN {x} > {a} THEN {v}" for a, v in limits) + f" ELSE {other} END"


BASE = st("cr", [(10, 30), (5, 20)], 10)
DEC = st("cr", [(10, 40), (5, 25)], 10)
PROFILE = "(VALUES " + ", ".join(f"('{a}', '{p}', {', '.join(map(str, scores.RISK[a] + scores.PERIOD[p]))})" for a in scores.RISK for p in scores.PERIOD) + ") t(risk_level, period, rk, base, stop, pk, hi, lo)"
TRIES = [42.0, 39.0, 36.0]
BUCKET = " + ".join(f"(rank_score >= {e})::INT" for e in EDGES)
SCORED = f"""{LAB}, sc AS (SELECT l.trade_date, l.symbol, ({BUCKET})::INT AS bucket, return_5d_pct AS ret FROM lab l JOIN cand c ON c.trade_date = l.trade_date AND c.symbol = l.symbol AND c.rank_no = l.rank_no WHERE tradability_status = 'tradable'),
cb AS (SELECT b.bucket, coalesce(n, 0) AS n, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, coalesce(a, 0) AS a, coalesce(n, 0) >= 8 AS calibrated
  FROM (SELECT unnest(range(0, {len(EDGES) + 1}))::INT AS bucket) b LEFT JOIN (SELECT bucket, count(*) AS n, count(*) FILTER (WHERE ret > 0) AS wins, count(*) FILTER (WHERE ret <= 0) AS losses, avg(ret) AS a FROM sc GROUP BY 1) g ON g.bucket = b.bucket)"""

QUERIES = {
    "factor_scores": factor_scores, "profile_decisions": decisions, "relaxed_selection": relaxed, "score_calibration": calibrated, "recalibrated_probability": recalibrated,
    "quote_lines": quotes, "kline_json": klines, "normalized_history": history,
}
SQL = {
    "factor_scores": f"""WITH {FLOW}, {INDUSTRY}, x AS (
  SELECT f.symbol, mn, cr, strong, s_acctbal / 400 AS roe, s_acctbal % 37 AS gr, abs(s_acctbal) % 60 AS pe, (abs(s_acctbal) % 60) / 8 AS pb FROM fl2 f JOIN industry USING (symbol)
), y AS (
  SELECT symbol, least(100, CASE WHEN mn > 0 THEN {st('cr', [(10, 50), (5, 35)], 20)} ELSE {st('cr', [(10, 0), (5, 10)], 15)} END + CASE WHEN mn > 0 THEN CASE WHEN strong THEN 30 ELSE 20 END WHEN strong THEN 0 ELSE 10 END + {st('cr', [(15, 20), (10, 15), (5, 10)], 5)})::INT AS flow_score,
    (CASE WHEN mn > 0 THEN {BASE} ELSE -({BASE}) END + CASE WHEN strong AND mn > 0 THEN 15 WHEN strong AND mn < 0 THEN -15 ELSE 0 END)::INT AS fs,
    least(100, CASE WHEN roe = 0 THEN 0 ELSE {st('roe', [(20, 40), (15, 30), (10, 20)], 10)} END + {st('gr', [(20, 20), (10, 15), (0, 10)], 0)} + {st('gr * 0.8', [(20, 15), (10, 10), (0, 5)], 0)} + CASE WHEN roe > 15 AND gr > 10 THEN 25 WHEN roe > 10 AND gr > 5 THEN 15 ELSE 10 END)::INT AS fundamental_score,
    least(100, CASE WHEN pe = 0 THEN 0 WHEN pe < 15 THEN 50 WHEN pe < 25 THEN 35 WHEN pe < 40 THEN 20 ELSE 10 END + CASE WHEN pb = 0 THEN 0 WHEN pb < 2 THEN 30 WHEN pb < 4 THEN 20 WHEN pb < 6 THEN 10 ELSE 5 END + 15)::INT AS valuation_score FROM x
), z AS (SELECT *, (0.35 * 50.0 + 0.30 * flow_score + 0.25 * fundamental_score + 0.10 * valuation_score)::DOUBLE AS t FROM y)
SELECT symbol, flow_score, fs AS flow_signal_score, CASE WHEN fs > 30 THEN 'strong_bull' WHEN fs > 15 THEN 'bull' WHEN fs > 0 THEN 'lean_bull' WHEN fs > -15 THEN 'lean_bear' WHEN fs > -30 THEN 'bear' ELSE 'strong_bear' END AS flow_signal,
  fundamental_score, valuation_score, {rs('t')} AS total, CASE WHEN round(t + 1e-9, 6) >= 85 THEN 'A' WHEN round(t + 1e-9, 6) >= 75 THEN 'B' WHEN round(t + 1e-9, 6) >= 65 THEN 'C' WHEN round(t + 1e-9, 6) >= 55 THEN 'D' ELSE 'E' END AS rating FROM z""",
    "profile_decisions": f"""WITH RECURSIVE {PICK}, {FLOW}, la AS (SELECT symbol, signal_score, close FROM pick QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
x AS (SELECT la.symbol, close, t.*, ((0.6 * signal_score + 0.4 * greatest(-100.0, least(100.0, (CASE WHEN mn > 0 THEN {DEC} ELSE -({DEC}) END) * CASE WHEN strong THEN 1.2 ELSE 1.0 END))) * rk * pk)::DOUBLE AS s FROM la JOIN fl2 USING (symbol) CROSS JOIN {PROFILE}),
y AS (SELECT *, round(s + 1e-9, 6) AS q FROM x)
SELECT symbol, risk_level, period, {rs('s')} AS decision_score,
  CASE WHEN q >= 50 THEN 'strong_buy' WHEN q >= 25 THEN 'buy' WHEN q >= 10 THEN 'careful_buy' WHEN q >= -10 THEN 'hold' WHEN q >= -25 THEN 'careful_sell' WHEN q >= -50 THEN 'sell' ELSE 'strong_sell' END AS decision,
  {rs('(CASE WHEN q >= 50 THEN least(base * 1.5, 0.8) WHEN q >= 25 THEN base * 1.2 WHEN q >= 10 THEN base * 0.8 WHEN q >= 0 THEN base * 0.5 ELSE 0 END)::DOUBLE')} AS position,
  {rs('close * (1 + CASE WHEN q > 30 THEN hi ELSE lo END)')} AS take_price, {rs('close * (1 - stop)')} AS stop_price FROM y""",
    "relaxed_selection": f"""WITH RECURSIVE {PICK}, s AS (SELECT date, symbol, round(display_score + 1e-9, 4) AS s FROM pick),
c AS (SELECT *, {', '.join(f'count(*) FILTER (WHERE s >= {t}) OVER (PARTITION BY date) AS c{i}' for i, t in enumerate(TRIES))} FROM s),
h AS (SELECT *, CASE {' '.join(f'WHEN c{i} >= 3 THEN {t}' for i, t in enumerate(TRIES))} ELSE {TRIES[-1]} END::DOUBLE AS threshold FROM c)
SELECT date, symbol, s + 0.0 AS score, threshold FROM h WHERE s >= threshold""",
    "score_calibration": f"WITH {SCORED} SELECT bucket, n, wins, losses, {rs('a', 3)} AS avg_return, calibrated FROM cb",
    "recalibrated_probability": f"""WITH RECURSIVE {PICK}{SCORED.removeprefix(MARKET)}
SELECT sc.trade_date, sc.symbol, sc.bucket, {rs('CASE WHEN calibrated THEN 0.4 * up_prob + 0.6 * wins / nullif(n, 0) ELSE up_prob END')} AS up_calibrated
FROM sc JOIN cb ON cb.bucket = sc.bucket JOIN pick p ON p.symbol = sc.symbol AND p.date = sc.trade_date""",
    "quote_lines": f"""WITH {BARS} SELECT symbol, 'name' || symbol AS name, {rs('close', 2)} AS price, {rs('volume', 2)} AS volume, {rs('amount', 2)} AS amount, date FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1""",
    "kline_json": f"WITH {BARS} SELECT symbol, date, {', '.join(f'{rs(c, 2)} AS {c}' for c in ('open', 'close', 'high', 'low', 'volume'))} FROM bars",
    "normalized_history": f"WITH {BARS} SELECT symbol, date, {', '.join(f'{rs(c, 2)} AS {c}' for c in ('open', 'close', 'volume', 'amount'))} FROM bars",
}
