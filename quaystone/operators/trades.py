"""Trade matching, positions, event study and performance metrics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, safe_div


def fifo_lots(trades: DataFrame) -> DataFrame:
    """Round trips by first-in first-out: sells take the oldest open lots; what no lot covers is dropped.

    Quantities become intervals: the running net with its running minimum tells how much of a sell is
    covered, then one ordered pass over the cumulative quantities of both sides cuts them into lots.

    ``seq`` orders.  Trades of equal ``seq`` are one moment, as in SQL's frames: running sums hold all of them, so that those of a side end
    at the same cumulative quantity and each meets the other side's on its own; what was short before counts for the first by time, side, quantity and price.
    """
    w = Window.partitionBy("symbol").orderBy("seq")
    one_by_one = Window.partitionBy("symbol").orderBy("seq", "ts", "side", "qty", "price")
    t = trades.withColumn("_first", ~F.col("seq").eqNullSafe(F.lag("seq").over(one_by_one)))
    t = t.withColumn("_net", F.sum(F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))).over(w))
    t = t.withColumn("_short", F.least(F.lit(0.0), F.min("_net").over(w)))
    before = F.when(F.col("_first"), F.coalesce(F.lag("_short").over(one_by_one), F.lit(0.0))).otherwise(F.col("_short"))
    t = t.withColumn("eff", F.when(F.col("side") == "buy", F.col("qty")).otherwise(F.col("qty") - (before - F.col("_short")))).where("eff > 0")
    # one row a moment and side, with its trades
    by_side = Window.partitionBy("symbol", "side").orderBy("seq")
    t = t.withColumns({"hi": F.sum("eff").over(by_side), "trades": F.collect_list(F.struct("ts", "price", "eff")).over(by_side.rangeBetween(Window.currentRow, Window.currentRow)), "_k": F.lag("seq").over(by_side)})
    t = t.where(~F.col("seq").eqNullSafe(F.col("_k")))
    # every cumulative quantity, from the highest down: it ends one segment, of the buys and the sells last met
    down = Window.partitionBy("symbol").orderBy(F.desc("hi"), "side")
    met = lambda s: F.last(F.when(F.col("side") == s, F.struct("seq", "hi", "trades")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    parts = t.select("symbol", "hi", F.coalesce(F.lead("hi").over(down), F.lit(0.0)).alias("from"), met("buy").alias("b"), met("sell").alias("s"))
    both = parts.where("b is not null and s is not null and hi > from")
    for p in "bs":
        both = both.withColumn(f"_{p}", F.explode(f"{p}.trades"))
    own = lambda p: {"seq": F.col(f"{p}.seq"), "ts": F.col(f"_{p}.ts"), "price": F.col(f"_{p}.price"), "lo": F.col(f"{p}.hi") - F.col(f"_{p}.eff"), "hi": F.col(f"{p}.hi")}
    return (
        both.select("symbol", *(x.alias(f"{p}_{c}") for p in "bs" for c, x in own(p).items()))
        .where("b_lo < s_hi and s_lo < b_hi")
        .withColumn("qty", F.least("b_hi", "s_hi") - F.greatest("b_lo", "s_lo"))
        .withColumns({"cost": F.col("qty") * F.col("b_price"), "pnl": F.col("qty") * (F.col("s_price") - F.col("b_price")), "days": F.datediff("s_ts", "b_ts")})
    )


def trade_diagnostics(lots: DataFrame, keys: list[str]) -> DataFrame:
    """Win rate, mean returns, profit/loss ratio (9.99 for wins without a loss), holding time, realised profit, Sharpe.

    A round trip that gains nothing counts as a loss.
    """
    ret = F.col("pnl") / F.col("cost") * 100
    lots = lots.withColumn("ret", ret)
    win, loss = F.avg(F.when(F.col("ret") > 0, F.col("ret"))), F.avg(F.when(F.col("ret") <= 0, F.col("ret")))
    return lots.groupBy(*keys).agg(
        F.count("*").alias("n_lots"), F.avg((F.col("ret") > 0).cast("int")).alias("win_rate"), F.avg("ret").alias("avg_return_pct"),
        F.coalesce(win, F.lit(0.0)).alias("avg_win_pct"), F.coalesce(loss, F.lit(0.0)).alias("avg_loss_pct"),
        F.when(loss < 0, F.coalesce(win, F.lit(0.0)) / F.abs(loss)).when(win.isNotNull(), 9.99).otherwise(0.0).alias("profit_loss_ratio"),
        F.avg("days").alias("avg_days"), F.sum("pnl").alias("realised"), F.sum("cost").alias("cost"),
        F.coalesce(safe_div(F.avg("ret"), F.stddev_pop("ret")) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("sharpe"),
    )


def trade_curve(lots: DataFrame, keys: list[str]) -> DataFrame:
    """Equity after every round trip, in order of the sells: 1 + realised profit / realised cost, and its drawdown from the peak so far (1 at first).

    Round trips of equal order are counted together.
    """
    w = Window.partitionBy(*keys).orderBy("s_seq", "b_seq")
    out = lots.withColumn("equity", 1 + F.coalesce(F.try_divide(F.sum("pnl").over(w), F.sum("cost").over(w)), F.lit(0.0)))
    out = out.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))
    return out.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def curve_summary(lots: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: realised return, the return a year that it makes over the key's trading span, and the worst drawdown (positive).

    ``spans``: ``keys``, first_ts, last_ts of all trades, matched or not.
    """
    out = trade_curve(lots, keys).groupBy(*keys).agg(F.sum("pnl").alias("realised"), F.sum("cost").alias("cost"), F.abs(F.min("drawdown")).alias("max_drawdown")).join(spans, keys)
    total, days = F.try_divide("realised", "cost"), F.greatest(F.datediff("last_ts", "first_ts"), F.lit(1))
    annual = F.expm1(F.least(F.log1p("total") * 365 / F.col("period_days"), F.lit(math.log(4))))
    out = out.withColumns({"total": F.coalesce(total, F.lit(0.0)), "period_days": days})
    out = out.withColumn("annual_return", F.when((F.col("cost") > 0) & (F.col("total") > -0.999), clamp(annual, -0.99, 3)).otherwise(0.0))
    return out.select(*keys, "realised", F.col("total").alias("total_return"), "period_days", "annual_return", "max_drawdown")


def positions(trades: DataFrame) -> DataFrame:
    """Average-cost position per symbol: buys add cost, sells scale it by what is left, 0 closes.

    An ordered fold per symbol in the JVM; its array is bounded by the symbol's trades.
    """
    rows = F.array_sort(F.collect_list(F.struct("seq", "side", "qty", "price")))
    zero = F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("c"), F.lit(0.0).alias("r"))

    def step(acc, t):
        sold = F.least(t.qty, acc.q)
        share = F.coalesce(F.try_divide(acc.q - sold, acc.q), F.lit(0.0))
        return F.when(t.side == "buy", F.struct((acc.q + t.qty).alias("q"), (acc.c + t.qty * t.price).alias("c"), acc.r.alias("r"))).otherwise(
            F.struct((acc.q - sold).alias("q"), (acc.c * share).alias("c"), (acc.r + F.coalesce(sold * (t.price - F.try_divide(acc.c, acc.q)), F.lit(0.0))).alias("r"))
        )

    out = trades.groupBy("symbol").agg(F.aggregate(rows, zero, step).alias("p"), F.count("*").alias("n_trades"))
    return out.select("symbol", "n_trades", F.col("p.q").alias("qty"), F.col("p.c").alias("cost"), F.try_divide("p.c", "p.q").alias("avg_cost"), F.col("p.r").alias("realised"))


def mark_to_market(pos: DataFrame, quotes: DataFrame, stop=0.08, take=0.15) -> DataFrame:
    """Positions with the last price (else average cost), profit and a risk status."""
    out = pos.where("qty > 0").join(quotes.select("symbol", F.col("close").alias("quote")), "symbol", "left")
    out = out.withColumn("price", F.coalesce(F.nullif("quote", F.lit(0.0)), "avg_cost"))
    out = out.withColumns({"pnl": (F.col("price") - F.col("avg_cost")) * F.col("qty"), "pnl_pct": F.coalesce(safe_div(F.col("price"), F.col("avg_cost")) - 1, F.lit(0.0)) * 100})
    p = F.col("pnl_pct")
    return out.withColumn("risk_status", F.when(p <= -100 * stop, "stop_loss").when(p >= 100 * take, "take_profit").when(p <= -50 * stop, "near_stop").when(p >= 50 * take, "near_take").otherwise("normal"))


def entries(picks: DataFrame, bars: DataFrame, *, threshold=0.0, max_positions=10, slippage=0.001, actions=("buy",)) -> DataFrame:
    """Picks of each day (by action) above the threshold, filled at the symbol's open on the next market date only.

    At most ``max_positions`` a date are chosen, so they go to the bars and not the bars to them.
    """
    w = Window.partitionBy("date").orderBy(F.desc("rank_score"), "symbol")
    chosen = picks.where(F.col("action").isin(*actions) & (F.col("rank_score") >= threshold)).withColumn("k", F.row_number().over(w)).where(F.col("k") <= max_positions)
    days = bars.select("date").distinct()
    # market calendar by month, so that no task sees all dates: a date within 14 days is in this month or the next
    month = Window.partitionBy("_m").orderBy("date")
    days = days.withColumn("_m", F.trunc("date", "month"))
    first = days.groupBy("_m").agg(F.min("date").alias("_first")).select(F.add_months("_m", -1).alias("_m"), "_first")
    nxt = days.withColumn("_next", F.lead("date").over(month)).join(first, "_m", "left").select("date", F.coalesce("_next", "_first").alias("entry_date")).where(F.datediff("entry_date", "date") <= 14)
    fill = bars.select("symbol", F.col("date").alias("entry_date"), (F.coalesce(F.nullif("open", F.lit(0.0)), "close") * (1 + slippage)).alias("entry_price"))
    return F.broadcast(chosen.join(nxt, "date")).join(fill, ["symbol", "entry_date"]).select("symbol", F.col("date").alias("signal_date"), "entry_date", "entry_price", "rank_score")


def exits(entry: DataFrame, bars: DataFrame, *, stop=0.08, take=0.14, hold_days=20, slippage=0.001, scores: DataFrame | None = None, least_score=45.0) -> DataFrame:
    """First close from the entry date on that stops, takes, ages out or has lost its score, in that order; else the last close in reach.

    ``scores`` (symbol, date, score) holds the scored rows; a date without one keeps the trade.
    """
    reach = hold_days + 40
    number = lambda c: F.datediff(c, F.lit("1970-01-01"))
    e = entry.withColumn("_bucket", F.explode(F.sequence(F.floor(number("entry_date") / reach), F.floor((number("entry_date") + reach) / reach))))
    bucketed = lambda df, *names: df.select("symbol", "date", *names, F.floor(number("date") / reach).alias("_bucket"))
    seen = e.join(bucketed(bars, "close"), ["symbol", "_bucket"]).where((F.col("date") >= F.col("entry_date")) & (F.datediff("date", "entry_date") <= reach))
    if scores is None:
        seen = seen.withColumn("score", F.lit(None).cast("double"))
    else:  # only the scores that a trade can meet
        near = bucketed(scores, "score").join(e.select("symbol", "_bucket").distinct(), ["symbol", "_bucket"]).select("symbol", "date", "score")
        seen = seen.join(near, ["symbol", "date"], "left")
    c, p = F.col("close"), F.col("entry_price")
    reason = F.when(c <= p * (1 - stop), "stop").when(c >= p * (1 + take), "take").when(F.datediff("date", "entry_date") >= hold_days, "time").when(F.col("score") < least_score, "score")
    seen = seen.withColumn("reason", reason)
    keys = ["symbol", "signal_date", "entry_date", "entry_price"]
    hit = F.struct("date", "close", "reason")
    got = seen.groupBy(*keys).agg(F.min(F.when(F.col("reason").isNotNull(), hit)).alias("h"), F.max(hit).alias("l"))
    out = got.select(*keys, F.coalesce("h.date", "l.date").alias("exit_date"), (F.coalesce("h.close", "l.close") * (1 - slippage)).alias("exit_price"), F.coalesce("h.reason", F.lit("end")).alias("reason"))
    return out.withColumn("ret", F.col("exit_price") * (1 - 0.0003) / (F.col("entry_price") * (1 + 0.0003)) - 1)


def equity_curve(rounds: DataFrame) -> DataFrame:
    """Daily mean return of trades by exit date, compounded per calendar year of the run (key: run_id)."""
    daily = rounds.groupBy("exit_date").agg(F.avg("ret").alias("ret")).withColumns({"run_id": F.year("exit_date"), "date": F.col("exit_date")})
    w = Window.partitionBy("run_id").orderBy("date")
    return daily.withColumn("value", F.exp(F.sum(F.log1p("ret")).over(w))).select("run_id", "date", "ret", "value")


def open_trade_equity(rounds: DataFrame, bars: DataFrame, *, commission=0.0003) -> DataFrame:
    """(run_id, date, n_open, ret, value, log_value): mean daily return of the trades that are open, compounded; dates without an open trade are left out.

    A long run of large returns compounds beyond a double, which its logarithm does not.

    A trade earns from its entry price to that day's close, then from close to close of its symbol, then to its exit
    price; both prices bear the commission, so that its days multiply to its own return.  Trades are not spread over their
    days: entries and exits are counted per symbol and date, running sums of both tell how many trades a bar's return counts for.
    """
    paid, got = F.col("entry_price") * (1 + commission), F.col("exit_price") * (1 - commission)
    same, zero = F.col("entry_date") == F.col("exit_date"), F.lit(0.0)
    event = lambda date, n_in, n_out, inverse, sold, n_same, ret: F.struct(*(x.alias(n) for x, n in ((date, "date"), (n_in, "n_in"), (n_out, "n_out"), (inverse, "inverse"), (sold, "sold"), (n_same, "n_same"), (ret, "same_ret"))))
    whole = event(F.col("entry_date"), zero, zero, zero, zero, F.lit(1.0), got / paid - 1)
    start, end = event(F.col("entry_date"), F.lit(1.0), zero, 1 / paid, zero, zero, zero), event(F.col("exit_date"), zero, F.lit(1.0), zero, got, zero, zero)
    names = ["n_in", "n_out", "inverse", "sold", "n_same", "same_ret"]
    events = rounds.select("symbol", F.explode(F.when(same, F.array(whole)).otherwise(F.array(start, end))).alias("e")).select("symbol", "e.*")
    events = events.groupBy("symbol", "date").agg(*(F.sum(n).alias(n) for n in names))
    by_symbol = Window.partitionBy("symbol").orderBy("date")
    upto, before = by_symbol.rowsBetween(Window.unboundedPreceding, 0), by_symbol.rowsBetween(Window.unboundedPreceding, -1)
    b = bars.select("symbol", "date", "close").join(events, ["symbol", "date"], "left").fillna(0.0, names)
    b = b.withColumns({"prev": F.lag("close").over(by_symbol), "held": F.coalesce(F.sum("n_in").over(before), zero) - F.sum("n_out").over(upto)})
    step = lambda x: F.coalesce(F.try_divide(x, "prev"), zero)
    earned = F.col("close") * F.col("inverse") - F.col("n_in") + step(F.col("sold")) - F.col("n_out") + F.col("same_ret") + F.col("held") * (step(F.col("close")) - 1)
    daily = b.withColumn("earned", F.when(F.col("prev").isNull(), F.col("close") * F.col("inverse") - F.col("n_in") + F.col("same_ret")).otherwise(earned))
    daily = daily.groupBy("date").agg(*(F.sum(n).alias(n) for n in ("earned", "n_in", "n_out", "n_same"))).withColumn("run_id", F.lit(1))
    run = Window.partitionBy("run_id").orderBy("date")  # one row a date
    n_open = F.sum("n_in").over(run) - F.coalesce(F.sum("n_out").over(run.rowsBetween(Window.unboundedPreceding, -1)), zero) + F.col("n_same")
    daily = daily.withColumn("n_open", n_open).where("n_open > 0").withColumn("ret", F.col("earned") / F.col("n_open"))
    daily = daily.withColumn("log_value", F.sum(F.log1p("ret")).over(run))
    return daily.select("run_id", "date", F.col("n_open").cast("long").alias("n_open"), "ret", F.exp("log_value").alias("value"), "log_value")


def drawdowns(equity: DataFrame) -> DataFrame:
    """Running peak, drawdown and daily return per run; taken from ``log_value`` where ``equity`` has it."""
    w = Window.partitionBy("run_id").orderBy("date")
    if "log_value" in equity.columns:
        log, peak = F.col("log_value"), F.max("log_value").over(w.rowsBetween(Window.unboundedPreceding, 0))
        return equity.withColumns({"peak": F.exp(peak), "drawdown": F.exp(log - peak) - 1, "step": F.exp(log - F.lag(log).over(w)) - 1})
    out = equity.withColumn("peak", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumns({"drawdown": F.try_divide(F.col("value") - F.col("peak"), F.col("peak")), "step": F.when(F.lag("value").over(w) > 0, F.col("value") / F.lag("value").over(w) - 1)})


def performance(equity: DataFrame) -> DataFrame:
    """Total and annualised return, volatility, Sharpe and worst drawdown per run."""
    d = drawdowns(equity)
    out = d.groupBy("run_id").agg(
        F.count("*").alias("n_days"), F.max_by("value", "date").alias("final"), F.min("drawdown").alias("max_drawdown"), F.min(F.struct("drawdown", "date")).getField("date").alias("worst_date"),
        F.avg("step").alias("m"), F.stddev_pop("step").alias("s"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    years = F.greatest(F.datediff("last_date", "first_date"), F.lit(1)) / 365
    annual = F.expm1(F.least(F.log("final") / years, F.lit(math.log(4))))  # in logs: a short run's power overflows
    return out.withColumns({"total_return": F.col("final") - 1, "annual_return": F.when(F.col("final") > 0, clamp(annual, -0.99, 3)).otherwise(-0.99), "sharpe": F.coalesce(safe_div("m", "s") * F.sqrt(F.lit(252.0)), F.lit(0.0))}).drop("m", "s", "final")


def monthly_returns(equity: DataFrame) -> DataFrame:
    """Last value of each month and its change on the month before."""
    m = equity.groupBy("run_id", F.date_format("date", "yyyy-MM").alias("month")).agg(F.max_by("value", "date").alias("value"))
    w = Window.partitionBy("run_id").orderBy("month")
    return m.withColumn("ret", F.col("value") / F.lag("value").over(w) - 1)


def calibration(scored: DataFrame, edges=(40.0, 50.0, 55.0, 60.0, 65.0)) -> DataFrame:
    """Wins, losses and mean return by score bucket; every bucket is there; fewer than 8 rows do not calibrate."""
    spark = scored.sparkSession
    names = spark.range(len(edges) + 1).select(F.col("id").cast("int").alias("bucket"))
    b = sum(((F.col("score") >= e).cast("int") for e in edges), F.lit(0))
    got = scored.withColumn("bucket", b).groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("ret") > 0).alias("wins"), F.count_if(F.col("ret") <= 0).alias("losses"), F.avg("ret").alias("avg_return"))
    return names.join(got, "bucket", "left").fillna(0).withColumn("calibrated", F.col("n") >= 8)


def credibility(perf: DataFrame) -> DataFrame:
    """Gates as booleans and a count per run."""
    gates = {"sharpe_ok": F.col("sharpe") >= 1, "drawdown_ok": F.col("max_drawdown") >= -0.20, "days_ok": F.col("n_days") >= 60, "return_ok": F.col("annual_return") > 0}
    out = perf.withColumns(gates)
    n = sum((F.col(g).cast("int") for g in gates), F.lit(0))
    return out.withColumn("n_passed", n).withColumn("grade", F.when(n == 4, "A").when(n == 3, "B").when(n == 2, "C").otherwise("D"))
