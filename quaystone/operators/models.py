"""Probability models as DataFrame jobs: evaluation metrics in SQL terms, MLlib fits, nearest-neighbour evidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluate(pred: DataFrame, keys: list[str]) -> DataFrame:
    """AUC by rank sums, Brier score and log loss of (y, p) per key; AUC is null with one class."""
    # mean ranks from counts of distinct p, so that equal scores share one rank
    return evaluate_counts(pred.groupBy(*keys, "p").agg(F.count("*").alias("n"), F.sum("y").alias("pos")), keys)


def evaluate_counts(per_p: DataFrame, keys: list[str]) -> DataFrame:
    """``evaluate`` from rows (n) and positives (pos) by key and p."""
    w = Window.partitionBy(*keys)
    upto = F.sum("n").over(w.orderBy("p"))
    per_p = per_p.withColumn("rank", upto - (F.col("n") - 1) / 2)
    clip = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("p")))
    g = per_p.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), F.sum(F.col("rank") * F.col("pos")).alias("rank_sum"),
        (F.sum(F.col("pos") * F.pow(F.col("p") - 1, 2) + (F.col("n") - F.col("pos")) * F.pow("p", 2)) / F.sum("n")).alias("brier"),
        (-F.sum(F.col("pos") * F.log(clip) + (F.col("n") - F.col("pos")) * F.log(1 - clip)) / F.sum("n")).alias("log_loss"),
    )
    neg = F.col("n") - F.col("n_pos")
    auc = F.try_divide(F.col("rank_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * neg)
    return g.withColumn("auc", auc).drop("rank_sum")


def calibration_error(pred: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    g = pred.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("my"), F.avg("p").alias("mp"))
    return g.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("my") - F.col("mp"))) / F.sum("n")).alias("ece"))


def calibration_error_counts(per_p: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """``calibration_error`` from rows (n) and positives (pos) by key and p."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    g = per_p.groupBy(*keys, b.alias("bin")).agg(F.sum("n").alias("n"), F.abs(F.sum("pos") - F.sum(F.col("n") * F.col("p"))).alias("gap"))
    return g.groupBy(*keys).agg((F.sum("gap") / F.sum("n")).alias("ece"))


def probability_bands(pred: DataFrame, keys: list[str], edges=(0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    band = sum(((F.col("p") >= e).cast("int") for e in edges), F.lit(0))
    return pred.groupBy(*keys, band.alias("band")).agg(F.count("*").alias("n"), F.avg("y").alias("hit_rate"))


def probability_model(train: DataFrame, features: list[str], label: str):
    """Standardised, class-balanced logistic regression; one class gives a constant prior instead."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}  # two rows
    n = sum(counts.values())
    if len(counts) < 2:
        return None, float(next(iter(counts), 0))
    weight = F.when(F.col(label) == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0]))
    stages = [
        VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
        LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", regParam=1 / n, standardization=False, maxIter=100, probabilityCol="_prob"),
    ]
    return Pipeline(stages=stages).fit(train.withColumn("_w", weight)), None


#: Rows of a block of queries and of samples.
QUERY_BLOCK, SAMPLE_BLOCK = 1000, 4000


def neighbour_evidence(queries: DataFrame, samples: DataFrame, k: int = 40) -> DataFrame:
    """Mean label and mean distance of the ``k`` nearest of all other samples of each query.

    The distance is the root mean square over components, each scaled by its spread in ``samples`` (below 1e-6: as it
    is). Missing components and labels count as 0. Every block of queries meets every block of samples, which gives at
    most ``k`` rows a query; these are merged.
    """
    dim, n = samples.agg(F.max(F.size("embedding")), F.count("*")).first()
    dim, sample_blocks = max(dim or 0, 1), n // SAMPLE_BLOCK + 1
    query_blocks = queries.count() // QUERY_BLOCK + 1
    whole = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.nanvl(F.get("embedding", i).cast("double"), F.lit(0.0)), F.lit(0.0)))
    spread = samples.select(F.posexplode(whole)).groupBy("pos").agg(F.stddev_pop("col").alias("s"))
    std = [r.s if r.s >= 1e-6 else 1.0 for r in spread.orderBy("pos").collect()] or [1.0]  # one row for each component
    block = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    q = queries.select("vec_id", whole.alias("x"), block(query_blocks).alias("_q")).withColumn("_s", every(sample_blocks))
    s = samples.select("vec_id", whole.alias("x"), F.coalesce(F.col("label").cast("double"), F.lit(0.0)).alias("label"), block(sample_blocks).alias("_s")).withColumn("_q", every(query_blocks))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        matrix = lambda t: t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) / std
        a, b = matrix(left), matrix(right)
        own = np.array(left.column("vec_id").fill_null(-1).to_pylist(), dtype=np.int64)
        other = np.array(right.column("vec_id").fill_null(-1).to_pylist(), dtype=np.int64)
        label = right.column("label").to_numpy()
        found = []
        for i, x in zip(own, a, strict=True):
            d = np.round(np.sqrt(np.mean((b - x) ** 2, axis=1)) + 1e-9, 6)
            at = np.flatnonzero(other != i)
            if len(at) > k:
                at = at[d[at] <= np.partition(d[at], k - 1)[k - 1]]
            at = at[np.lexsort((other[at], d[at]))][:k]
            found.append((np.full(len(at), i), other[at], d[at], label[at]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["vec_id", "other", "d", "label"])

    near = q.groupBy("_q", "_s").cogroup(s.groupBy("_q", "_s")).applyInArrow(nearest, "vec_id long, other long, d double, label double")
    w = Window.partitionBy("vec_id").orderBy("d", "other")
    best = near.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    return best.groupBy("vec_id").agg(F.count("*").alias("n"), F.avg("d").alias("avg_d"), F.min_by("other", "pos").alias("nearest"), F.avg("label").alias("mean_label"))
