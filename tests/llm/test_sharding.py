"""Sharding: groups of equal texts stay together, cuts run along metadata."""

from pyspark.sql import functions as F

from quaystone.llm import op6_kd_sharding as op6


def copies(spark):
    """20,000 texts of equal size; the first thousand are five groups of copies, each 0.4 of a shard; four sources."""
    i = F.col("id")
    key = F.when(i < 1000, i % 5).otherwise(i)
    text = F.concat(F.format_string("%08d", key), F.lit(" some words of equal length"))
    return spark.range(20000).select(i.alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), key % 4).alias("source"))


def test_groups_below_a_shard_stay_whole(spark):
    docs = copies(spark)
    got = op6.shard(docs).join(docs, "doc_id").toPandas()
    assert len(got) == 20000
    assert (got[got.doc_id < 1000].groupby("text").shard.nunique() == 1).all()
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 40 and by.max() < 1.03 * by.mean() and by.min() > 0.97 * by.mean()


def test_shards_are_cut_along_metadata(spark):
    docs = copies(spark).where("doc_id >= 1000")
    got = op6.shard(docs).join(docs, "doc_id").toPandas()
    assert (got.groupby("shard").source.nunique() > 1).sum() <= 3  # a boundary of two sources falls into one shard
