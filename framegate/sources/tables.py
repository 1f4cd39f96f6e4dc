"""Tables of a dataset folder, with event time as whole microseconds."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(df: DataFrame, col: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp with or without a time zone."""
    if dict(df.dtypes)[col] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{col}`)")
    return F.unix_micros(col)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with us (event time in microseconds) and k (the number in props)."""
    df = load(spark, sf_dir, "events")
    return df.withColumn("us", micros(df)).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, spark.checkpoint.dir; a temporary
    one where that is unset on a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="framegate-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")
