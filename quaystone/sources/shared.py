"""Intermediates that are read more than once, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of this machine only where the session names none, as in tests on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="quaystone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: made once, and lost executors do not lose it."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/quaystone/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
