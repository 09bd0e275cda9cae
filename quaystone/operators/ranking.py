"""Candidate pools, forward labels by a bucketed range join, and ranking-quality evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, finite, limit_band, safe_div, truthy
from ..sources.shared import written
from .ordering import exact_quantiles, mean_ranks

HORIZONS = (3, 5, 10, 20)
THRESHOLDS = {3: 5.0, 5: 8.0, 10: 12.0, 20: 18.0}


def market_state(panel: DataFrame) -> DataFrame:
    """Per date: breadth and trend scores and a three-way state."""
    day = panel.groupBy("date").agg(F.avg("pct_change").alias("avg_pct"), F.avg((F.col("pct_change") > 0).cast("int")).alias("up_ratio"), F.count("*").alias("n_symbols"))
    a = F.col("avg_pct")
    trend, breadth, flow, risk = clamp(50 + 4 * a, 0, 100), clamp(100 * F.col("up_ratio"), 0, 100), clamp(45 + 3 * a, 0, 100), clamp(65 - 4 * F.abs(a), 0, 100)
    out = day.withColumn("score", 0.35 * trend + 0.25 * breadth + 0.20 * flow + 0.20 * risk)
    return out.withColumn("state", F.when(F.col("score") >= 65, "offensive").when(F.col("score") >= 45, "neutral").otherwise("defensive"))


def live_market_state(quotes: DataFrame, news: DataFrame | None, keys: list[str]) -> DataFrame:
    """State of the market per key from quotes (``pct_change``; null counts as 0) and a news balance (``policy_score``; none: 50).

    Five scores, their weighted sum, the state and the exposure in percent that it suggests; confidence is high from five quotes on.
    """
    pct = F.coalesce("pct_change", F.lit(0.0))
    out = quotes.groupBy(*keys).agg(F.avg(pct).alias("_a"), F.avg((pct > 0).cast("int")).alias("_u"), F.count("*").alias("_n"))
    out = out.withColumn("policy_score", F.lit(50.0)) if news is None else out.join(news.select(*keys, "policy_score"), keys, "left")
    a = F.col("_a")
    out = out.withColumns({
        "trend_score": clamp(50 + a * 4, 0, 100), "breadth_score": clamp(F.col("_u") * 100, 0, 100), "flow_score": clamp(45 + a * 3, 0, 100), "risk_score": clamp(65 - F.abs(a) * 4, 0, 100),
        "news_score": clamp(F.coalesce("policy_score", F.lit(50.0)), 0, 100),
    })
    weights = {"trend_score": 0.28, "breadth_score": 0.22, "flow_score": 0.16, "risk_score": 0.16, "news_score": 0.18}
    out = out.withColumn("state_score", F.round(clamp(sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)), 0, 100) + 1e-9, 6))
    level = lambda high, mid, low: F.when(F.col("state_score") >= 65, high).when(F.col("state_score") >= 45, mid).otherwise(low)
    return out.withColumns({
        "state": level("offensive", "neutral", "defensive"), "exposure_min": level(50, 30, 10), "exposure_max": level(75, 50, 30), "confidence": F.when(F.col("_n") >= 5, "high").otherwise("medium"),
    }).drop("_a", "_u", "_n", "policy_score")


def ranked(panel: DataFrame, score, limit: int) -> DataFrame:
    """Top ``limit`` symbols of each date: trade_date, symbol, rank_no and the panel's columns."""
    w = Window.partitionBy("date").orderBy(F.desc("rank_score"), "symbol")
    out = panel.withColumn("rank_score", score).withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= limit)
    return out.withColumnRenamed("date", "trade_date")


def bars_ahead(candidates: DataFrame, bars: DataFrame, days: int) -> DataFrame:
    """Candidate x the bars of its symbol in (trade_date, trade_date + days].

    A range join made equal: bars fall into date buckets of ``days`` days, a candidate looks into the two it
    can touch, so a long history costs no more per candidate than a short one.
    """
    number = lambda d: F.datediff(d, F.lit("1970-01-01"))
    wide = candidates.withColumn("_bucket", F.explode(F.sequence(F.floor((number(F.col("trade_date")) + 1) / days), F.floor((number(F.col("trade_date")) + days) / days))))
    ahead = bars.withColumn("_bucket", F.floor(number(F.col("date")) / days))
    return wide.join(ahead, ["symbol", "_bucket"]).where((F.col("date") > F.col("trade_date")) & (F.datediff("date", "trade_date") <= days)).drop("_bucket")


def forward_labels(
    candidates: DataFrame, bars: DataFrame, *, horizons=HORIZONS, thresholds=THRESHOLDS, take=0.15, stop=0.08, max_drawdown=10.0, min_volume=1.0, min_amount=1e8
) -> DataFrame:
    """(trade_date, symbol, rank_no) with entry, status, path and a return and strong flag for each horizon.

    ``bars`` needs pct_change.  A candidate without later bars keeps its row, as ``missing_history``.
    """
    days = max(14, 5 * max(horizons) + 10)
    keys = ["trade_date", "symbol", "rank_no"]
    seen = bars_ahead(candidates.select(*keys), bars.select("symbol", "date", "open", "high", "low", "close", "volume", "amount", "pct_change"), days)
    w = Window.partitionBy(*keys).orderBy("date")
    seen = seen.withColumns({"rn": F.row_number().over(w), "peak": F.max(F.when(F.col("high") > 0, F.col("high"))).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    seen = seen.withColumn("entry", F.first("open").over(w))
    at_tp, at_sl = F.col("high") >= F.col("entry") * (1 + take), F.col("low") <= F.col("entry") * (1 - stop)
    first = lambda x: F.max(F.when(F.col("rn") == 1, x))
    got = seen.groupBy(*keys).agg(
        F.count("*").alias("n_bars"), F.max("entry").alias("entry"), first(F.col("volume")).alias("v1"), first(F.col("amount")).alias("a1"),
        F.max(F.when(F.col("rn") == 1, (F.col("pct_change") >= limit_band("symbol")) & (F.col("open") >= F.col("high")) & (F.col("high") > 0))).alias("limit_up"),
        F.max("high").alias("top"), F.min("low").alias("bottom"),
        F.min(F.when((F.col("high") > 0) & (F.col("low") > 0), F.col("low") / F.col("peak") - 1)).alias("path_dd"),
        F.min(F.when(at_tp, F.col("rn"))).alias("tp_at"), F.min(F.when(at_sl, F.col("rn"))).alias("sl_at"),
        *(F.max(F.when(F.col("rn") == h, F.col("close"))).alias(f"c{h}") for h in horizons),
    )
    out = candidates.select(*keys).join(got, keys, "left")
    status = (
        F.when(F.coalesce("n_bars", F.lit(0)) == 0, "missing_history").when(~truthy(F.col("entry") > 0), "no_entry_price")
        .when((F.col("v1") < min_volume) | (F.col("a1") < min_amount), "volume_or_amount_blocked").when(truthy(F.col("limit_up")), "limit_up_entry_blocked").otherwise("tradable")
    )
    tp, sl = F.col("tp_at"), F.col("sl_at")
    path = (
        F.when(tp.isNull() & sl.isNull(), "neither").when(tp == sl, "both_same_day_stop_loss_first").when(sl.isNull() | (tp < sl), "tp_before_sl").otherwise("sl_before_tp")
    )
    pct = lambda x: F.coalesce((safe_div(F.col(x), F.col("entry")) - 1) * 100, F.lit(0.0))
    out = out.withColumns({
        "tradability_status": status, "tp_sl_path": path, "max_gain_pct": pct("top"), "max_loss_pct": pct("bottom"), "path_max_drawdown_pct": F.coalesce(F.col("path_dd") * 100, F.lit(0.0)),
        **{f"return_{h}d_pct": pct(f"c{h}") for h in horizons},
        "incomplete_horizons": F.array_compact(F.array(*(F.when(F.col(f"c{h}").isNull(), h) for h in horizons))),
    })
    strong = {
        f"strong_{h}d": (F.col("tradability_status") == "tradable") & F.col(f"c{h}").isNotNull() & (F.col(f"return_{h}d_pct") >= thresholds[h]) & (F.col("max_loss_pct") >= -max_drawdown)
        for h in horizons
    }
    return out.withColumns(strong).drop("v1", "a1", "limit_up", "top", "bottom", "path_dd", "tp_at", "sl_at", *(f"c{h}" for h in horizons))


def by_horizon(labelled: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Long form: horizon, return_pct, strong."""
    each = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"return_{h}d_pct").alias("return_pct"), F.col(f"strong_{h}d").alias("strong")) for h in horizons))
    wide = {x for h in horizons for x in (f"return_{h}d_pct", f"strong_{h}d")}
    return labelled.withColumn("_h", F.explode(each)).select(*[c for c in labelled.columns if c not in wide], "_h.*")


def daily_metrics(long: DataFrame, top_k=(3, 5, 10)) -> DataFrame:
    """Per (trade_date, horizon): precision and mean return at k, recall, NDCG, reciprocal rank, counts."""
    t = long.where(F.col("tradability_status") == "tradable").withColumn("gain", clamp("return_pct", 0, 60))
    best = Window.partitionBy("trade_date", "horizon").orderBy(F.desc("gain"), "symbol")
    t = t.withColumn("ideal_pos", F.row_number().over(best))
    rank, strong = F.col("rank_no"), F.col("strong").cast("int")
    aggs = []
    for k in sorted({3, 5, 10, *top_k}):
        aggs += [(F.sum(F.when(rank <= k, strong).otherwise(0)) / F.least(F.lit(k), F.count("*"))).alias(f"precision_at_{k}"), F.coalesce(F.avg(F.when(rank <= k, F.col("return_pct"))), F.lit(0.0)).alias(f"top_{k}_avg_return_pct")]
    dcg = F.sum(F.when(rank <= 10, F.col("gain") / F.log2(rank + 1)).otherwise(0.0))
    ideal = F.sum(F.when(F.col("ideal_pos") <= 10, F.col("gain") / F.log2(F.col("ideal_pos") + 1)).otherwise(0.0))
    return t.groupBy("trade_date", "horizon").agg(
        *aggs,
        F.coalesce(F.try_divide(F.sum(F.when(rank <= 10, strong).otherwise(0)), F.sum(strong)), F.lit(0.0)).alias("recall_at_10"),
        F.coalesce(F.try_divide(dcg, ideal), F.lit(0.0)).alias("ndcg_at_10"),
        F.coalesce(1 / F.min(F.when(F.col("strong"), rank)), F.lit(0.0)).alias("mrr"),
        F.count("*").alias("n_tradable"), F.sum(strong).alias("n_strong"), F.sum(F.when(rank <= 10, strong).otherwise(0)).alias("n_strong_top10"),
    )


def percentile_curve(long: DataFrame, buckets: int = 5) -> DataFrame:
    """Mean return and count per rank bucket; empty buckets are there with 0."""
    t = long.where(F.col("tradability_status") == "tradable")
    w = Window.partitionBy("trade_date", "horizon")
    t = t.withColumns({"_i": F.row_number().over(w.orderBy("rank_no", "symbol")) - 1, "_n": F.count("*").over(w)})
    t = t.withColumn("bucket", F.least(F.lit(buckets), F.floor(F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1)) * buckets) + 1).cast("int"))
    got = t.groupBy("trade_date", "horizon", "bucket").agg(F.avg("return_pct").alias("avg_return_pct"), F.count("*").alias("n"))
    every = t.select("trade_date", "horizon").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(1), F.lit(buckets))))
    return every.join(got, ["trade_date", "horizon", "bucket"], "left").fillna(0, ["avg_return_pct", "n"])


def dominant(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value per key, the first in order on ties."""
    return df.groupBy(*keys).agg(F.mode(value, True).alias(value))


def factor_correlations(long: DataFrame, factors: list[str]) -> DataFrame:
    """Pearson and Spearman correlation of each factor with the return, per horizon; pairs must be finite."""
    each = F.array(*(F.struct(F.lit(f).alias("factor"), finite(f).alias("x")) for f in factors))
    t = long.select("horizon", finite("return_pct").alias("y"), F.explode(each).alias("e")).select("horizon", "y", "e.*").where("x is not null and y is not null")
    t = written(t, "factor-pairs")
    keys = ["horizon", "factor"]
    t = t.join(mean_ranks(t, keys, "x", "rx"), [*keys, "x"]).join(mean_ranks(t, keys, "y", "ry"), [*keys, "y"])
    flat = lambda c: (F.min(c) == F.max(c))
    return t.groupBy("horizon", "factor").agg(
        F.count("*").alias("n"),
        F.when(flat("x") | flat("y"), 0.0).otherwise(F.corr("x", "y")).alias("pearson"),
        F.when(flat("x") | flat("y"), 0.0).otherwise(F.corr("rx", "ry")).alias("spearman"),
    ).where("n >= 2")


def miss_samples(long: DataFrame, limit: int = 20) -> DataFrame:
    """Late winners, early losers and, where ``bought`` is a column, unbought strong rows: the ``limit`` most telling of each kind and horizon."""
    long = written(long, "labels-by-horizon")
    q = exact_quantiles(long, ["horizon"], "return_pct", {"p90": 0.9, "p10": 0.1})
    t = long.join(F.broadcast(q), "horizon")  # one row for each horizon
    late = (F.col("rank_no") > 10) & ((F.col("return_pct") >= F.col("p90")) | F.col("strong"))
    early = (F.col("rank_no") <= 10) & ((F.col("return_pct") <= F.col("p10")) | F.col("tp_sl_path").isin("sl_before_tp", "both_same_day_stop_loss_first"))
    kinds = [F.when(late, "late_winner"), F.when(early, "early_loser")]
    kinds += [F.when(F.col("strong") & ~F.col("bought"), "unbought_strong")] if "bought" in long.columns else []
    t = t.withColumn("kind", F.explode(F.array_compact(F.array(*kinds))))
    order = F.when(F.col("kind") == "early_loser", F.col("return_pct")).otherwise(-F.col("return_pct"))
    w = Window.partitionBy("horizon", "kind").orderBy(order, "trade_date", "symbol")
    return t.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)


def state_breakdown(long: DataFrame) -> DataFrame:
    top = F.col("rank_no") <= 10
    return long.groupBy("horizon", "state").agg(
        F.count("*").alias("n"), F.count_if("strong").alias("n_strong"), F.avg("return_pct").alias("avg_return_pct"),
        F.count_if(top).alias("n_top10"), F.count_if(top & F.col("strong")).alias("n_top10_strong"),
        F.coalesce(F.try_divide(F.count_if(top & F.col("strong")), F.count_if(top)), F.lit(0.0)).alias("top10_precision"),
    )


def failure_modes(long: DataFrame) -> DataFrame:
    """Only modes that occur: (horizon, mode, n)."""
    counts = long.groupBy("horizon").agg(
        F.count_if((F.col("rank_no") > 10) & F.col("strong")).alias("late_strong"),
        F.count_if((F.col("rank_no") <= 10) & F.col("tp_sl_path").isin("sl_before_tp", "both_same_day_stop_loss_first")).alias("top10_stop_first"),
        F.count_if((F.col("rank_no") <= 10) & (F.col("return_pct") < 0)).alias("top10_negative"),
    )
    return counts.unpivot("horizon", ["late_strong", "top10_stop_first", "top10_negative"], "mode", "n").where("n > 0")


def coverage(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Requested dates that are missing, the counts and a status; both inputs have a date column."""
    missing = requested.join(available.select("date").distinct(), "date", "left_anti")
    n = requested.agg(F.count("*").alias("n_requested")).crossJoin(missing.agg(F.count("*").alias("n_missing"), F.min("date").alias("first_missing")))  # one row each
    return n.withColumn("status", coverage_status())


def coverage_status() -> Column:
    return F.when(F.col("n_missing") == F.col("n_requested"), "blocked").when(F.col("n_missing") > 0, "partial").otherwise("complete")


def coverage_by(requested: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Coverage of the requested dates for each key; a row without a date only names its key."""
    numbered = requested.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")))  # one row for each date
    total = numbered.agg(F.count("*").alias("n_requested"))
    have = available.select(key, "date").distinct().join(numbered, "date", "left")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last("_i")))
    gap = F.min(F.when(F.col("_i") > F.col("_p"), F.col("_p")))  # the first number that is passed over
    g = have.withColumn("_p", place).groupBy(key).agg(F.count("_i").alias("_n"), gap.alias("_gap")).crossJoin(total)  # one row
    g = g.withColumn("n_missing", F.col("n_requested") - F.col("_n")).withColumn("_i", F.when(F.col("n_missing") > 0, F.coalesce("_gap", F.col("_n") + 1)).cast("int"))
    out = g.join(numbered.withColumnRenamed("date", "first_missing"), "_i", "left").withColumn("status", coverage_status())
    return out.select(key, "n_requested", "n_missing", "first_missing", "status")
