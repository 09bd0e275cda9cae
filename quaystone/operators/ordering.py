"""Ranks and exact quantiles of groups of any size: no task ever orders a whole group.

A group's values are dealt into ranges between approximate quantiles (a sketch with a map-side part).  Only the ranges are
counted over the whole group; order within a range is looked at in that range alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a group.
RANGES = 256


def counted_ranges(df: DataFrame, keys: list[str], value: str, ranges: int) -> DataFrame:
    """Each group's distinct values with their count ``n``, their range, and how many rows lie below the value in its group (``below``)."""
    shares = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    bounds = df.groupBy(*keys).agg(F.percentile_approx(value, shares, F.lit(10 * ranges)).alias("_bounds"))
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n")).join(bounds, keys)
    counts = counts.withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds")
    sizes = counts.groupBy(*keys, "_range").agg(F.sum("n").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows a group
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    inside = Window.partitionBy(*keys, "_range").orderBy(value)
    out = counts.withColumn("_upto", F.sum("n").over(inside)).join(sizes.select(*keys, "_range", "_before"), [*keys, "_range"])
    return out.select(*keys, value, "n", (F.col("_before") + F.col("_upto") - F.col("n")).alias("below"))


def mean_ranks(df: DataFrame, keys: list[str], value: str, name: str, ranges: int = RANGES) -> DataFrame:
    """One row a group and distinct value: its rank from 1, ties share their mean; ``keys`` and ``value`` must not be null."""
    return counted_ranges(df, keys, value, ranges).select(*keys, value, (F.col("below") + (F.col("n") + 1) / 2).alias(name))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """One row a group with its quantiles by name, interpolated between the two values that they lie between; null values do not count."""
    counts = counted_ranges(df.where(F.col(value).isNotNull()), keys, value, ranges)
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    at = counts.join(total, keys)

    def value_at(index: Column) -> Column:
        return F.max(F.when((F.col("below") <= index) & (index < F.col("below") + F.col("n")), F.col(value)))

    parts = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("_total") - 1)
        parts += [value_at(F.floor(place)).alias(f"_lo_{name}"), value_at(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
    out = at.groupBy(*keys).agg(*parts)
    return out.select(*keys, *((F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n) for n in shares))
