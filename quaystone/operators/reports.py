"""Report aggregates: weighted evidence, position review, curve summaries, watchlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import latest_by


def weighted_evidence(runs: DataFrame, keys: list[str], metrics: list[str], weight: str) -> DataFrame:
    """Mean of each metric weighted by at least 1."""
    w = F.greatest(F.lit(1), F.col(weight))
    return runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.sum(w).alias("weight"), *((F.sum(F.col(m) * w) / F.sum(w)).alias(m) for m in metrics))


def position_review(marked: DataFrame, keys: list[Column]) -> DataFrame:
    """Wins, losses, flat ones and the mean result by group."""
    return marked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), F.count_if(F.col("pnl") < 0).alias("losses"), F.count_if(F.col("pnl") == 0).alias("flat"),
        F.avg("pnl_pct").alias("avg_pnl_pct"), F.sum("pnl").alias("pnl"),
    )


def best_and_worst(df: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """Name of the largest and smallest of a row's scores and their mean; the first name wins ties."""
    pairs = lambda sign: F.array(*(F.struct((sign * F.col(m)).alias("v"), F.lit(-i).alias("i"), F.lit(m).alias("name")) for i, m in enumerate(metrics)))
    mean = sum((F.col(m) for m in metrics), F.lit(0.0)) / len(metrics)
    return df.select(*key, F.array_max(pairs(1)).getField("name").alias("best"), F.array_max(pairs(-1)).getField("name").alias("worst"), mean.alias("mean_score"))


def watchlist(actions: DataFrame, positions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Symbols with a latest watch or buy action, and symbols that are held without one; each with its quote."""
    latest = latest_by(actions, ["symbol"], "ts", "id").where(F.col("kind").isin("watch", "buy")).select("symbol", "kind")
    held = positions.where("qty > 0").select("symbol", "qty")
    out = latest.join(held, "symbol", "full_outer").withColumn("source", F.when(F.col("kind").isNull(), "position").otherwise("action"))
    return out.join(snapshot.select("symbol", "close"), "symbol", "left")


def curve_summary(curve: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Length, ends, worst value with its date, and last value per curve."""
    return curve.groupBy(key).agg(
        F.count("*").alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.min(F.struct(value, date)).getField(date).alias("worst_date"),
        F.min(value).alias("worst"), F.max_by(value, date).alias("last"),
    )
