"""Queries over trades, positions and the event study."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import trades as tr
from ..sources import adapters as src
from ..sources.adapters import BARS, TRADES
from ..sources.shared import written
from .q_rules import PICK, pick_panel
from .sqltext import r, rs


def lots(spark, d):
    return tr.fifo_lots(src.numbered_trades(spark, d))


def fifo(spark, d):
    return lots(spark, d).groupBy("symbol").agg(F.count("*").alias("n_lots"), r(F.sum("qty"), 2).alias("qty"), r(F.sum("cost"), 2).alias("cost"), r(F.sum("pnl"), 2).alias("pnl"), F.sum("days").alias("days"))


def diagnostics(spark, d):
    cols = ["win_rate", "avg_return_pct", "avg_win_pct", "avg_loss_pct", "profit_loss_ratio", "avg_days", "sharpe"]
    return tr.trade_diagnostics(lots(spark, d), ["symbol"]).select("symbol", "n_lots", *(r(c).alias(c) for c in cols), r("realised", 2).alias("realised"))


def positions(spark, d):
    return tr.positions(src.trades(spark, d)).select("symbol", "n_trades", r("qty", 2).alias("qty"), r("cost", 2).alias("cost"), r("realised", 2).alias("realised"))


def marked(spark, d):
    quotes = ind.latest(src.bars(spark, d))
    out = tr.mark_to_market(tr.positions(src.trades(spark, d)), quotes)
    return out.select("symbol", r("price").alias("price"), r("pnl", 2).alias("pnl"), r("pnl_pct", 3).alias("pnl_pct"), "risk_status")


def rounds(spark, d):
    """Round trips of the ten best picks a date; bars and entries are written once, and the entries (ten a date at most) go to the bars."""
    p = pick_panel(spark, d).withColumn("rank_score", F.round(F.col("display_score") + 1e-9, 4))
    b = written(src.bars(spark, d).select("symbol", "date", "open", "close"), "bars")
    e = written(tr.entries(p, b, threshold=40.0, actions=("buy", "watch")), "entries")
    return tr.exits(F.broadcast(e), b)


def event_study(spark, d):
    return rounds(spark, d).select("symbol", "signal_date", "entry_date", r("entry_price").alias("entry_price"), "exit_date", r("exit_price").alias("exit_price"), "reason", r("ret").alias("ret"))


def equity(spark, d):
    e = tr.drawdowns(tr.equity_curve(rounds(spark, d)))
    return e.select("run_id", "date", *(r(c).alias(c) for c in ("ret", "value", "drawdown", "step")))


def performance(spark, d):
    out = tr.credibility(tr.performance(tr.equity_curve(rounds(spark, d))))
    return out.select("run_id", "n_days", "first_date", "last_date", "worst_date", *(r(c).alias(c) for c in ("total_return", "annual_return", "max_drawdown", "sharpe")), "n_passed", "grade")


def months(spark, d):
    return tr.monthly_returns(tr.equity_curve(rounds(spark, d))).select("run_id", "month", r("value").alias("value"), r("ret").alias("ret"))


def trade_counts(spark, d):
    return src.trades(spark, d).groupBy("symbol").agg(F.count_if(F.col("side") == "buy").alias("n_buy"), F.count_if(F.col("side") == "sell").alias("n_sell"), F.sum("qty").alias("qty"))


FIFO = f"""{TRADES}, n1 AS (
  SELECT *, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) OVER (PARTITION BY symbol ORDER BY seq) AS net FROM trades
), n2 AS (SELECT *, least(0.0, min(net) OVER (PARTITION BY symbol ORDER BY seq)) AS short FROM n1),
n3 AS (SELECT *, CASE WHEN side = 'buy' THEN qty ELSE qty - (coalesce(lag(short) OVER (PARTITION BY symbol ORDER BY seq), 0.0) - short) END AS eff FROM n2),
n4 AS (SELECT *, sum(eff) OVER (PARTITION BY symbol, side ORDER BY seq) AS hi FROM n3 WHERE eff > 0),
lots AS (
  SELECT b.symbol, least(b.hi, s.hi) - greatest(b.hi - b.eff, s.hi - s.eff) AS qty, b.price AS bp, s.price AS sp, date_diff('day', b.ts::DATE, s.ts::DATE) AS days
  FROM n4 b JOIN n4 s ON b.symbol = s.symbol AND b.side = 'buy' AND s.side = 'sell' AND b.hi - b.eff < s.hi AND s.hi - s.eff < b.hi
), lot AS (SELECT *, qty * bp AS cost, qty * (sp - bp) AS pnl, qty * (sp - bp) / (qty * bp) * 100 AS ret FROM lots)"""
POS = f"""{TRADES}, p AS (
  SELECT symbol, seq, qty AS q, qty * price AS c, 0.0::DOUBLE AS r, side FROM trades WHERE seq = 1 AND side = 'buy'
  UNION ALL SELECT symbol, seq, 0.0, 0.0, 0.0, side FROM trades WHERE seq = 1 AND side = 'sell'
  UNION ALL
  SELECT t.symbol, t.seq, CASE WHEN t.side = 'buy' THEN p.q + t.qty ELSE p.q - least(t.qty, p.q) END,
         CASE WHEN t.side = 'buy' THEN p.c + t.qty * t.price ELSE p.c * coalesce((p.q - least(t.qty, p.q)) / nullif(p.q, 0), 0) END,
         CASE WHEN t.side = 'buy' THEN p.r ELSE p.r + coalesce(least(t.qty, p.q) * (t.price - p.c / nullif(p.q, 0)), 0) END, t.side
  FROM p JOIN trades t ON t.symbol = p.symbol AND t.seq = p.seq + 1
), pos AS (SELECT symbol, seq AS n_trades, q AS qty, c AS cost, c / nullif(q, 0) AS avg_cost, r AS realised FROM p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) = 1)"""
ROUNDS = f"""{PICK}, ch AS (
  SELECT symbol, date, round(display_score + 1e-9, 4) AS rank_score FROM pick WHERE action IN ('buy', 'watch') AND round(display_score + 1e-9, 4) >= 40
  QUALIFY row_number() OVER (PARTITION BY date ORDER BY round(display_score + 1e-9, 4) DESC, symbol) <= 10
), dd AS (SELECT DISTINCT date FROM bars), nx AS (SELECT date, lead(date) OVER (ORDER BY date) AS entry_date FROM dd QUALIFY date_diff('day', date, entry_date) <= 14),
en AS (
  SELECT c.symbol, c.date AS signal_date, n.entry_date, coalesce(nullif(b.open, 0), b.close) * 1.001 AS entry_price
  FROM ch c JOIN nx n ON n.date = c.date JOIN bars b ON b.symbol = c.symbol AND b.date = n.entry_date
), sn AS (
  SELECT e.*, b.date, b.close, CASE WHEN b.close <= entry_price * 0.92 THEN 'stop' WHEN b.close >= entry_price * 1.14 THEN 'take' WHEN date_diff('day', entry_date, b.date) >= 20 THEN 'time' END AS reason
  FROM en e JOIN bars b ON b.symbol = e.symbol AND b.date >= e.entry_date AND date_diff('day', e.entry_date, b.date) <= 60
), ex AS (
  SELECT symbol, signal_date, entry_date, entry_price, coalesce(min(date) FILTER (WHERE reason IS NOT NULL), max(date)) AS exit_date,
         coalesce(arg_min(close, date) FILTER (WHERE reason IS NOT NULL), arg_max(close, date)) * 0.999 AS exit_price,
         coalesce(arg_min(reason, date) FILTER (WHERE reason IS NOT NULL), 'end') AS reason FROM sn GROUP BY ALL
), rounds AS (SELECT *, exit_price * (1 - 0.0003) / (entry_price * (1 + 0.0003)) - 1 AS ret FROM ex),
eq AS (
  SELECT year(exit_date) AS run_id, exit_date AS date, avg(ret) AS ret, exp(sum(ln(1 + avg(ret))) OVER (PARTITION BY year(exit_date) ORDER BY exit_date)) AS value FROM rounds GROUP BY exit_date
), dr AS (
  SELECT *, value / max(value) OVER (PARTITION BY run_id ORDER BY date) - 1 AS drawdown, CASE WHEN lag(value) OVER (PARTITION BY run_id ORDER BY date) > 0 THEN value / lag(value) OVER (PARTITION BY run_id ORDER BY date) - 1 END AS step FROM eq
)"""

QUERIES = {
    "fifo_round_trips": fifo, "trade_diagnostics": diagnostics, "average_cost_positions": positions, "mark_to_market": marked, "event_study": event_study,
    "equity_drawdowns": equity, "run_performance": performance, "monthly_returns": months, "trade_counts": trade_counts,
}
SQL = {
    "fifo_round_trips": f"WITH {FIFO} SELECT symbol, count(*) AS n_lots, {rs('sum(qty)', 2)} AS qty, {rs('sum(cost)', 2)} AS cost, {rs('sum(pnl)', 2)} AS pnl, sum(days)::BIGINT AS days FROM lot GROUP BY symbol",
    "trade_diagnostics": f"""WITH {FIFO}, g AS (
  SELECT symbol, count(*) AS n_lots, avg((ret > 0)::INT) AS win_rate, avg(ret) AS avg_return_pct, coalesce(avg(ret) FILTER (WHERE ret > 0), 0) AS avg_win_pct, coalesce(avg(ret) FILTER (WHERE ret <= 0), 0) AS avg_loss_pct,
    CASE WHEN avg(ret) FILTER (WHERE ret <= 0) < 0 THEN coalesce(avg(ret) FILTER (WHERE ret > 0), 0) / abs(avg(ret) FILTER (WHERE ret <= 0)) WHEN count(*) FILTER (WHERE ret > 0) > 0 THEN 9.99 ELSE 0 END AS profit_loss_ratio,
    avg(days) AS avg_days, sum(pnl) AS realised, coalesce(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252.0), 0) AS sharpe FROM lot GROUP BY symbol
) SELECT symbol, n_lots, {', '.join(f'{rs(c)} AS {c}' for c in ('win_rate', 'avg_return_pct', 'avg_win_pct', 'avg_loss_pct', 'profit_loss_ratio', 'avg_days', 'sharpe'))}, {rs('realised', 2)} AS realised FROM g""",
    "average_cost_positions": f"WITH RECURSIVE {POS} SELECT symbol, n_trades, {rs('qty', 2)} AS qty, {rs('cost', 2)} AS cost, {rs('realised', 2)} AS realised FROM pos",
    "mark_to_market": f"""WITH RECURSIVE {POS}, {BARS}, q AS (SELECT symbol, arg_max(close, date) AS quote FROM bars GROUP BY symbol),
m AS (SELECT p.*, coalesce(nullif(quote, 0), avg_cost) AS price FROM pos p LEFT JOIN q ON q.symbol = p.symbol WHERE qty > 0),
k AS (SELECT *, (price - avg_cost) * qty AS pnl, coalesce(price / nullif(avg_cost, 0) - 1, 0) * 100 AS pnl_pct FROM m)
SELECT symbol, {rs('price')} AS price, {rs('pnl', 2)} AS pnl, {rs('pnl_pct', 3)} AS pnl_pct,
  CASE WHEN pnl_pct <= -8 THEN 'stop_loss' WHEN pnl_pct >= 15 THEN 'take_profit' WHEN pnl_pct <= -4 THEN 'near_stop' WHEN pnl_pct >= 7.5 THEN 'near_take' ELSE 'normal' END AS risk_status FROM k""",
    "event_study": f"WITH RECURSIVE {ROUNDS} SELECT symbol, signal_date, entry_date, {rs('entry_price')} AS entry_price, exit_date, {rs('exit_price')} AS exit_price, reason, {rs('ret')} AS ret FROM rounds",
    "equity_drawdowns": f"WITH RECURSIVE {ROUNDS} SELECT run_id::INT AS run_id, date, {', '.join(f'{rs(c)} AS {c}' for c in ('ret', 'value', 'drawdown', 'step'))} FROM dr",
    "run_performance": f"""WITH RECURSIVE {ROUNDS}, g AS (
  SELECT run_id, count(*) AS n_days, min(date) AS first_date, max(date) AS last_date, min(date) FILTER (WHERE drawdown = md) AS worst_date, arg_max(value, date) AS final, min(drawdown) AS max_drawdown,
         coalesce(avg(step) / nullif(stddev_pop(step), 0) * sqrt(252.0), 0) AS sharpe FROM (SELECT *, min(drawdown) OVER (PARTITION BY run_id) AS md FROM dr) GROUP BY run_id
), h AS (SELECT *, final - 1 AS total_return, greatest(-0.99, least(3, pow(final, 1 / (greatest(date_diff('day', first_date, last_date), 1) / 365.0)) - 1)) AS annual_return FROM g),
k AS (SELECT *, (sharpe >= 1)::INT + (max_drawdown >= -0.20)::INT + (n_days >= 60)::INT + (annual_return > 0)::INT AS n_passed FROM h)
SELECT run_id::INT AS run_id, n_days, first_date, last_date, worst_date, {', '.join(f'{rs(c)} AS {c}' for c in ('total_return', 'annual_return', 'max_drawdown', 'sharpe'))}, n_passed::INT AS n_passed,
  CASE n_passed WHEN 4 THEN 'A' WHEN 3 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS grade FROM k""",
    "monthly_returns": f"""WITH RECURSIVE {ROUNDS}, m AS (SELECT run_id, strftime(date, '%Y-%m') AS month, arg_max(value, date) AS value FROM eq GROUP BY 1, 2)
SELECT run_id::INT AS run_id, month, {rs('value')} AS value, {rs('value / lag(value) OVER (PARTITION BY run_id ORDER BY month) - 1')} AS ret FROM m""",
    "trade_counts": f"WITH {TRADES} SELECT symbol, count(*) FILTER (WHERE side = 'buy') AS n_buy, count(*) FILTER (WHERE side = 'sell') AS n_sell, sum(qty) AS qty FROM trades GROUP BY symbol",
}
