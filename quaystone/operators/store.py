"""Keyed tables: last-write-wins merges, latest rows, as-of lookups, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key, the last in ``order`` (append a unique column for ties)."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those with equal keys."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_missing(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys are not there yet are added."""
    return existing.unionByName(new.join(existing.select(*keys).distinct(), keys, "left_anti"))


def replace_partition(df: DataFrame, path: str, key: str) -> None:
    """Write so that only the partitions present in ``df`` are replaced."""
    df.write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def single_active(df: DataFrame, owner: str, updated: str, tie: str) -> DataFrame:
    """Of an owner's rows only the newest is active."""
    w = Window.partitionBy(owner).orderBy(F.desc(updated), F.desc(tie))
    return df.withColumn("is_active", F.row_number().over(w) == 1)


def prefer(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge by key, column by column, the primary's values first."""
    others = [c for c in primary.columns if c not in keys]
    p, f = primary.alias("p"), fallback.alias("f")
    joined = p.join(f, [F.col(f"p.{k}") == F.col(f"f.{k}") for k in keys], "full_outer")
    return joined.select(*(F.coalesce(f"p.{k}", f"f.{k}").alias(k) for k in keys), *(F.coalesce(f"p.{c}", f"f.{c}").alias(c) for c in others))


def first_source(parts: list[DataFrame], key: str) -> DataFrame:
    """All rows of the first part, in the given order, that has any for the key."""
    named = [p.withColumn("_prio", F.lit(i)) for i, p in enumerate(parts)]
    out = named[0]
    for p in named[1:]:
        out = out.unionByName(p)
    best = F.min("_prio").over(Window.partitionBy(key))
    return out.withColumn("_best", best).where("_prio = _best").drop("_prio", "_best")


def as_of(requests: DataFrame, snapshots: DataFrame, key: str, at: str, date: str, days: int = 30) -> DataFrame:
    """Newest snapshot of the key at or before each request, however old.

    Buckets of ``days`` make it an equi-join: a request meets the snapshots of its own bucket, and where none is early
    enough the last one of the buckets before, carried over (one row for each key and bucket).
    """
    number = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / days)
    ask = requests.select(key, at).where(F.col(key).isNotNull() & F.col(at).isNotNull()).distinct().withColumn("_b", number(at))
    s = snapshots.where(F.col(key).isNotNull() & F.col(date).isNotNull()).select(key, F.col(date).alias("_d"), F.struct(*[c for c in snapshots.columns if c != key]).alias("_s"), number(date).alias("_b"))
    recent = ask.join(s, [key, "_b"]).where(F.col("_d") <= F.col(at)).groupBy(key, at).agg(F.max_by("_s", "_d").alias("_recent"))
    last = s.groupBy(key, "_b").agg(F.max_by("_s", "_d").alias("_last"))
    marks = last.join(ask.select(key, "_b").distinct(), [key, "_b"], "full_outer")
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(key, "_b", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    found = ask.join(carried, [key, "_b"]).join(recent, [key, at], "left").select(key, at, F.coalesce("_recent", "_carried").alias("_s"))
    return requests.join(found, [key, at], "left").select(*requests.columns, *(F.col(f"_s.{c}").alias(f"found_{c}") for c in snapshots.columns if c != key))


def page(df: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """A page with one probe row more, so that has_next needs no count."""
    return df.orderBy(*order).offset(offset).limit(limit + 1)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with sorted columns; nested values as JSON."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")}
    df.select(*(F.to_json(c).alias(c) if c in nested else c for c in sorted(df.columns))).write.option("header", True).csv(path)
