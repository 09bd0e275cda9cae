"""Structured Streaming jobs: latest value per key, deduplicated events, tumbling bars, running positions."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, files_a_trigger: int | None = None) -> DataFrame:
    """``events`` as a stream of files; a path pattern also takes a table that is one file.

    Without ``files_a_trigger`` all files that are there come in one trigger: where files are in no order of time, one by one the
    watermark of the first would drop older rows of the next, and positions would be folded in file order.  A source that writes
    files as time passes names a bound.
    """
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    reader = reader.option("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else reader
    stream = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def latest_per_key(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Last value per key (update or complete mode)."""
    return events.groupBy(key).agg(F.max(F.struct(ts, "event_id", value)).alias("_m")).select(key, F.col(f"_m.{ts}").alias(ts), F.col(f"_m.{value}").alias(value))


def deduplicated(events: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """First event of each key within the watermark; state is bounded by it."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def tumbling_bars(ticks: DataFrame, key: str, ts: str, price: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Open, high, low, close and count per window; late ticks beyond the watermark are dropped."""
    return (
        ticks.withWatermark(ts, delay).groupBy(key, F.window(ts, width).alias("w"))
        .agg(F.min_by(price, F.struct(ts, "event_id")).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, F.struct(ts, "event_id")).alias("close"), F.count("*").alias("n"))
        .select(key, F.col("w.start").alias("start"), "open", "high", "low", "close", "n")
    )


POSITION = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("qty", T.DoubleType()), T.StructField("cost", T.DoubleType()), T.StructField("n", T.LongType())])
STATE = T.StructType([T.StructField("qty", T.DoubleType()), T.StructField("cost", T.DoubleType()), T.StructField("n", T.LongType())])


def _folding(idle_ms: int | None):
    def fold(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        qty, cost, n = state.get if state.exists else (0.0, 0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind, value in zip(rows["event_type"], rows["value"], strict=True):
            if kind == "purchase":
                qty, cost = qty + 1, cost + value
            elif qty > 0:
                qty, cost = qty - 1, cost * (qty - 1) / qty
            n += 1
        state.update((qty, cost, n))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"user_id": [key[0]], "qty": [qty], "cost": [cost], "n": [n]})

    return fold


def running_positions(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Average-cost position per user after every micro-batch; state is one row per user, given up after ``idle_ms`` without an event."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return events.select("user_id", "ts", "event_id", "event_type", "value").groupBy("user_id").applyInPandasWithState(_folding(idle_ms), POSITION, STATE, "update", timeout)


def dropped_rows(query) -> int:
    """Rows that a finished query left out as later than its watermark."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def run_available(df: DataFrame, spark: SparkSession, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a query over what is there and read the result back from the shared folder; ``keys`` keep the last update.

    Rows dropped by the watermark are reported as a warning.
    """
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="quaystone-")
    path = f"{base}/quaystone/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch).cast("long")).write.mode("append").parquet(f"{path}/out")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if dropped := dropped_rows(query):
        warnings.warn(f"{dropped} late rows were dropped by the watermark", stacklevel=2)
    schema = T.StructType([*df.schema.fields, T.StructField("_epoch", T.LongType())])
    out = spark.read.schema(schema).parquet(f"{path}/out")
    if keys:
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "_epoch").alias("_v")).select(*keys, "_v.*")
    return out.drop("_epoch")
