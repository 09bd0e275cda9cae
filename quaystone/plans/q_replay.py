"""Queries over the replay: exits by score, equity of open trades, credibility of runs, trade curves and suggestions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import credibility as cr
from ..operators import indicators as ind
from ..operators import trades as tr
from ..sources import adapters as src
from ..sources.adapters import BARS, TRADES
from ..sources.shared import written
from .q_rules import pick_panel
from .q_trades import FIFO, POS, ROUNDS
from .sqltext import r, rs

LEAST_SCORE = 45.0


def replay(spark, d):
    """(round trips with the market state of their signal, bars), each written once."""
    bars = written(src.bars(spark, d).select("symbol", "date", "open", "close"), "bars")
    p = pick_panel(spark, d).withColumn("rank_score", F.round(F.col("display_score") + 1e-9, 4))
    p = written(p.select("symbol", "date", "action", "rank_score", "state").where("action <> 'pass'"), "picks")
    e = written(tr.entries(p, bars, threshold=40.0, actions=("buy", "watch")), "entries")
    rounds = tr.exits(F.broadcast(e), bars, scores=p.withColumnRenamed("rank_score", "score"), least_score=LEAST_SCORE)
    state = p.select("symbol", F.col("date").alias("signal_date"), "state")
    return written(F.broadcast(rounds).join(state, ["symbol", "signal_date"]), "rounds"), bars  # ten a date at most


def score_exits(spark, d):
    rounds, _ = replay(spark, d)
    return rounds.select("symbol", "signal_date", "state", "entry_date", r("entry_price").alias("entry_price"), "exit_date", r("exit_price").alias("exit_price"), "reason", r("ret").alias("ret"))


def open_equity(spark, d):
    e = tr.drawdowns(tr.open_trade_equity(*replay(spark, d)))
    return e.select("date", "n_open", r("ret").alias("ret"), r("log_value").alias("log_value"), r("drawdown").alias("drawdown"))


def run_credibility(spark, d):
    """One run a calendar year."""
    rounds, bars = replay(spark, d)
    equity = written(tr.open_trade_equity(rounds, bars), "equity").withColumn("run_id", F.year("date"))
    equity = equity.withColumn("log_value", F.sum(F.log1p("ret")).over(Window.partitionBy("run_id").orderBy("date"))).withColumn("value", F.exp("log_value"))
    perf = tr.performance(equity).select("run_id", "sharpe", (-F.col("max_drawdown")).alias("max_drawdown"), "annual_return")
    month = tr.monthly_returns(equity).groupBy("run_id").agg(
        F.count("ret").alias("n_months"), F.coalesce(F.avg((F.col("ret") > 0).cast("int")), F.lit(0.0)).alias("month_positive"), F.coalesce(F.stddev_pop("ret"), F.lit(0.0)).alias("month_vol")
    )
    by_year = rounds.withColumn("run_id", F.year("exit_date"))
    win, loss = F.avg(F.when(F.col("ret") > 0, F.col("ret"))), F.avg(F.when(F.col("ret") <= 0, F.col("ret")))
    traded = by_year.groupBy("run_id").agg(
        F.count("*").alias("n_trades"), F.avg((F.col("ret") > 0).cast("int")).alias("win_rate"), F.when(loss < 0, F.coalesce(win, F.lit(0.0)) / F.abs(loss)).when(win.isNotNull(), 9.99).otherwise(0.0).alias("profit_loss_ratio")
    )
    states = by_year.groupBy("run_id", "state").agg(F.avg((F.col("ret") > 0).cast("int")).alias("w")).groupBy("run_id").agg(F.coalesce(F.stddev_pop("w"), F.lit(0.0)).alias("state_dispersion"))
    days = bars.groupBy(F.year("date").alias("run_id")).agg(F.count_distinct("date").alias("n_days"), F.count_distinct("symbol").alias("n_symbols"))
    universe = src.table(spark, d, "supplier").agg(F.count("*").alias("universe"))  # one row
    out = traded.join(states, "run_id").join(days, "run_id").join(perf, "run_id").join(month, "run_id").join(F.broadcast(universe))
    out = cr.credibility_report(out)
    shown = [r(c).alias(c) for c, _ in cr.DIMENSIONS]
    return out.select("run_id", "n_trades", "n_days", "n_months", *shown, r("score", 2).alias("score"), "grade", F.concat_ws(",", "failed").alias("failed"), "live_ready")


def lots_and_spans(spark, d):
    trades = src.trades(spark, d)
    return written(tr.fifo_lots(src.numbered_trades(spark, d)), "lots"), trades.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def trade_curves(spark, d):
    out = tr.curve_summary(*lots_and_spans(spark, d), ["symbol"])
    return out.select("symbol", r("realised", 2).alias("realised"), r("total_return").alias("total_return"), "period_days", r("annual_return").alias("annual_return"), r("max_drawdown").alias("max_drawdown"))


def suggestions(spark, d):
    lots, spans = lots_and_spans(spark, d)
    diagnostics = tr.trade_diagnostics(lots, ["symbol"]).withColumnRenamed("n_lots", "n_trades").select("symbol", "n_trades", "win_rate", "profit_loss_ratio", "avg_days", "avg_return_pct")
    curve = tr.curve_summary(lots, spans, ["symbol"]).select("symbol", "max_drawdown")
    held = tr.mark_to_market(tr.positions(src.trades(spark, d)), ind.latest(src.bars(spark, d))).select("symbol", F.lit(1).alias("n_open"), F.round(F.col("pnl_pct") + 1e-9, 4).alias("open_pnl_pct"))
    out = diagnostics.join(curve, "symbol").join(held, "symbol", "left")
    out = out.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("win_rate", "profit_loss_ratio", "avg_days", "avg_return_pct", "max_drawdown")})
    return cr.suggestions(out).select("symbol", F.concat_ws(",", F.transform("items", lambda x: x.id)).alias("items"), F.concat_ws(",", F.transform("items", lambda x: x.priority)).alias("priorities"), *cr.DEFAULTS)


SCORED = ROUNDS.split("), ex AS (")[0].replace(
    "'time' END AS reason\n  FROM en e JOIN bars b ON", f"'time' WHEN sc.score < {LEAST_SCORE} THEN 'score' END AS reason\n  FROM en e JOIN bars b ON"
)
SCORED += """
    LEFT JOIN (SELECT symbol, date, round(display_score + 1e-9, 4) AS score FROM pick WHERE action <> 'pass') sc ON sc.symbol = b.symbol AND sc.date = b.date"""
assert "'score' END" in SCORED
REPLAY = f"""{SCORED}), ex AS (
  SELECT symbol, signal_date, entry_date, entry_price, coalesce(min(date) FILTER (WHERE reason IS NOT NULL), max(date)) AS exit_date,
         coalesce(arg_min(close, date) FILTER (WHERE reason IS NOT NULL), arg_max(close, date)) * 0.999 AS exit_price,
         coalesce(arg_min(reason, date) FILTER (WHERE reason IS NOT NULL), 'end') AS reason FROM sn GROUP BY ALL
), rounds AS MATERIALIZED (SELECT e.*, p.state, exit_price * (1 - 0.0003) / (entry_price * (1 + 0.0003)) - 1 AS ret FROM ex e JOIN pick p ON p.symbol = e.symbol AND p.date = e.signal_date)"""
EQUITY = f"""{REPLAY}, pb AS (SELECT symbol, date, close, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM bars), held AS (
  SELECT b.date, CASE WHEN entry_date = exit_date THEN ret WHEN b.date = entry_date THEN close / (entry_price * 1.0003) - 1 WHEN b.date = exit_date THEN exit_price * 0.9997 / prev - 1 ELSE close / prev - 1 END AS step
  FROM rounds t JOIN pb b ON b.symbol = t.symbol AND b.date BETWEEN entry_date AND exit_date
), opened AS (SELECT c.date, count(*) AS n_open FROM (SELECT DISTINCT date FROM bars) c JOIN rounds t ON c.date BETWEEN entry_date AND exit_date GROUP BY 1),
eqd AS MATERIALIZED (SELECT o.date, n_open, coalesce(sum(step), 0) / n_open AS ret FROM opened o LEFT JOIN held h ON h.date = o.date GROUP BY o.date, n_open)"""


def stat(parts):
    return " + ".join(f"{w} * greatest(0, least(100, (coalesce({c}, 0) - {a}) / ({b} - {a})::DOUBLE * 100))" for w, c, a, b in parts)


GATE_SQL = ", ".join(f"CASE WHEN NOT coalesce({c} {op} {x}, false) THEN '{c}' END" for c, op, x in cr.GATES)
LOTS = f"""{FIFO}, lots2 AS (
  SELECT b.symbol, b.seq AS bs, s.seq AS ss, least(b.hi, s.hi) - greatest(b.hi - b.eff, s.hi - s.eff) AS q, b.price AS bp, s.price AS sp
  FROM n4 b JOIN n4 s ON b.symbol = s.symbol AND b.side = 'buy' AND s.side = 'sell' AND b.hi - b.eff < s.hi AND s.hi - s.eff < b.hi
), cv AS (
  SELECT *, 1 + sum(q * (sp - bp)) OVER w / nullif(sum(q * bp) OVER w, 0) AS equity FROM lots2 WINDOW w AS (PARTITION BY symbol ORDER BY ss, bs)
), cw AS (SELECT *, equity / greatest(1, max(equity) OVER (PARTITION BY symbol ORDER BY ss, bs)) - 1 AS dr FROM cv),
curve AS (
  SELECT symbol, realised, realised / cost AS total_return, period_days, max_drawdown,
    CASE WHEN realised / cost > -0.999 THEN greatest(-0.99, least(3, exp(least(ln(1 + realised / cost) * 365 / period_days, ln(4))) - 1)) ELSE 0 END AS annual_return
  FROM (SELECT symbol, sum(q * (sp - bp)) AS realised, sum(q * bp) AS cost, abs(min(dr)) AS max_drawdown FROM cw GROUP BY 1)
  JOIN (SELECT symbol, greatest(date_diff('day', min(ts)::DATE, max(ts)::DATE), 1) AS period_days FROM trades GROUP BY 1) USING (symbol)
)"""
QUERIES = {"score_exit_study": score_exits, "open_trade_equity": open_equity, "run_credibility": run_credibility, "trade_curves": trade_curves, "optimization_suggestions": suggestions}
SQL = {
    "score_exit_study": f"WITH RECURSIVE {REPLAY} SELECT symbol, signal_date, state, entry_date, {rs('entry_price')} AS entry_price, exit_date, {rs('exit_price')} AS exit_price, reason, {rs('ret')} AS ret FROM rounds",
    "open_trade_equity": f"""WITH RECURSIVE {EQUITY}, v AS (SELECT *, sum(ln(1 + ret)) OVER (ORDER BY date) AS lv FROM eqd)
SELECT date, n_open, {rs('ret')} AS ret, {rs('lv')} AS log_value, {rs('exp(lv - max(lv) OVER (ORDER BY date)) - 1')} AS drawdown FROM v""",
    "run_credibility": f"""WITH RECURSIVE {EQUITY}, y AS (SELECT year(date) AS run_id, date, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY year(date) ORDER BY date)) AS value FROM eqd),
yd AS (SELECT *, value / max(value) OVER w - 1 AS dd, CASE WHEN lag(value) OVER w > 0 THEN value / lag(value) OVER w - 1 END AS step FROM y WINDOW w AS (PARTITION BY run_id ORDER BY date)),
perf AS (SELECT run_id, coalesce(avg(step) / nullif(stddev_pop(step), 0) * sqrt(252.0), 0) AS sharpe, -min(dd) AS max_drawdown,
  greatest(-0.99, least(3, exp(least(ln(arg_max(value, date)) / (greatest(date_diff('day', min(date), max(date)), 1) / 365.0), ln(4))) - 1)) AS annual_return FROM yd GROUP BY 1),
mo AS (SELECT run_id, month, value / lag(value) OVER (PARTITION BY run_id ORDER BY month) - 1 AS ret FROM (SELECT run_id, strftime(date, '%Y-%m') AS month, arg_max(value, date) AS value FROM y GROUP BY 1, 2)),
ms AS (SELECT run_id, count(ret) AS n_months, coalesce(avg((ret > 0)::INT), 0) AS month_positive, coalesce(stddev_pop(ret), 0) AS month_vol FROM mo GROUP BY 1),
tt AS (SELECT year(exit_date) AS run_id, count(*) AS n_trades, avg((ret > 0)::INT) AS win_rate,
  CASE WHEN avg(ret) FILTER (WHERE ret <= 0) < 0 THEN coalesce(avg(ret) FILTER (WHERE ret > 0), 0) / abs(avg(ret) FILTER (WHERE ret <= 0)) WHEN count(*) FILTER (WHERE ret > 0) > 0 THEN 9.99 ELSE 0 END AS profit_loss_ratio FROM rounds GROUP BY 1),
st AS (SELECT run_id, coalesce(stddev_pop(w), 0) AS state_dispersion FROM (SELECT year(exit_date) AS run_id, state, avg((ret > 0)::INT) AS w FROM rounds GROUP BY 1, 2) GROUP BY 1),
dy AS (SELECT year(date) AS run_id, count(DISTINCT date) AS n_days, count(DISTINCT symbol) AS n_symbols FROM bars GROUP BY 1),
al AS (SELECT tt.run_id, n_trades, win_rate, profit_loss_ratio, state_dispersion, n_days, n_symbols, sharpe, max_drawdown, annual_return, n_months, month_positive, month_vol, (SELECT count(*) FROM supplier) AS universe
  FROM tt JOIN st USING (run_id) JOIN dy USING (run_id) JOIN perf USING (run_id) JOIN ms USING (run_id)),
dm AS (SELECT *, round({stat(cr.SAMPLE)} + 1e-9, 2) AS sample, round({stat(cr.RISK_RETURN)} + 1e-9, 2) AS risk_return, round(({stat(cr.STABILITY)}) * CASE WHEN n_months < 6 THEN 0.55 WHEN n_months < 9 THEN 0.75 ELSE 1 END + 1e-9, 2) AS stability,
  round(greatest(0, least(100, 65 + 0.35 * greatest(0, least(100, n_symbols / greatest(1, universe)::DOUBLE * 100)) - 20)) + 1e-9, 2) AS data, 84.0::DOUBLE AS execution FROM al),
sc AS (SELECT *, round(greatest(0, least(100, {' + '.join(f'{c} * {w}' for c, w in cr.DIMENSIONS)})) + 1e-9, 2) AS score FROM dm),
gr AS (SELECT *, CASE WHEN score >= 85 THEN 'A' WHEN score >= 72 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade, concat_ws(',', {GATE_SQL}) AS failed FROM sc)
SELECT run_id::INT AS run_id, n_trades, n_days, n_months, {', '.join(f'{rs(c)} AS {c}' for c, _ in cr.DIMENSIONS)}, {rs('score', 2)} AS score, grade, failed, failed = '' AND grade = 'A' AS live_ready FROM gr""",
    "trade_curves": f"WITH {LOTS} SELECT symbol, {rs('realised', 2)} AS realised, {rs('total_return')} AS total_return, period_days::INT AS period_days, {rs('annual_return')} AS annual_return, {rs('max_drawdown')} AS max_drawdown FROM curve",
    "optimization_suggestions": f"""WITH RECURSIVE {LOTS}, {POS[len(TRADES) + 2:]}, {BARS}, q AS (SELECT symbol, arg_max(close, date) AS quote FROM bars GROUP BY symbol),
op AS (SELECT p.symbol, round(coalesce(coalesce(nullif(quote, 0), avg_cost) / nullif(avg_cost, 0) - 1, 0) * 100 + 1e-9, 4) AS open_pct FROM pos p LEFT JOIN q ON q.symbol = p.symbol WHERE qty > 0),
g AS (
  SELECT symbol, count(*) AS n, avg((ret > 0)::INT) AS win, avg(ret) AS av, avg(days) AS hold,
    CASE WHEN avg(ret) FILTER (WHERE ret <= 0) < 0 THEN coalesce(avg(ret) FILTER (WHERE ret > 0), 0) / abs(avg(ret) FILTER (WHERE ret <= 0)) WHEN count(*) FILTER (WHERE ret > 0) > 0 THEN 9.99 ELSE 0 END AS pl FROM lot GROUP BY symbol
), h AS (
  SELECT g.symbol, n, round(win + 1e-9, 6) AS win, round(pl + 1e-9, 6) AS pl, round(hold + 1e-9, 6) AS hold, round(av + 1e-9, 6) AS av, round(max_drawdown + 1e-9, 6) AS md, open_pct FROM g JOIN curve USING (symbol) LEFT JOIN op ON op.symbol = g.symbol
), k AS (
  SELECT *, n < 6 AS c1, win < 0.5 AND n >= 3 AS c2, pl < 1.2 AND n >= 3 AS c3, hold > 0 AND hold < 9 AND av > 0 AS c4, win >= 0.6 AND av >= 2 AND pl >= 1.5 AS c5, md > 0.12 AS c6, coalesce(open_pct < -3, false) AS c7 FROM h
)
SELECT symbol, coalesce(nullif(concat_ws(',', CASE WHEN c1 THEN 'expand_sample' END, CASE WHEN c2 THEN 'raise_threshold' END, CASE WHEN c3 THEN 'tighten_stop_loss' END, CASE WHEN c4 THEN 'shorten_holding_window' END,
    CASE WHEN c5 THEN 'lift_take_profit' END, CASE WHEN c6 THEN 'reduce_exposure' END, CASE WHEN c7 THEN 'enforce_open_risk_rules' END), ''), 'keep_and_monitor') AS items,
  coalesce(nullif(concat_ws(',', CASE WHEN c1 THEN 'high' END, CASE WHEN c2 THEN 'high' END, CASE WHEN c3 THEN 'high' END, CASE WHEN c4 THEN 'medium' END, CASE WHEN c5 THEN 'medium' END, CASE WHEN c6 THEN 'high' END, CASE WHEN c7 THEN 'high' END), ''), 'low') AS priorities,
  CASE WHEN c2 THEN 75.0 ELSE 70.0 END::DOUBLE AS score_threshold, CASE WHEN c3 THEN 6.5 ELSE 8.0 END::DOUBLE AS stop_loss_pct, CASE WHEN c5 THEN 17.0 ELSE 15.0 END::DOUBLE AS stop_profit_pct,
  CASE WHEN c4 THEN greatest(5.0, round_even(hold + 2, 0)) ELSE 15.0 END::DOUBLE AS holding_days FROM k""",
}
