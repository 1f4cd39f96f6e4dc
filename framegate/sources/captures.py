"""Capture records (JSON), device rows, and the results table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegate.presets import MIN_PIXELS

CAPTURE = "image string, irisCenter struct<x: double, y: double>, irisRadius double, sharpness double"


def read_capture_log(df: DataFrame, body: str, schema: str = CAPTURE) -> DataFrame:
    """df with the parsed record; a malformed one is NULL and its row stays."""
    return df.withColumn("record", F.from_json(body, schema, {"mode": "PERMISSIVE"}))


def device_eligibility(df: DataFrame, max_width: str, max_height: str, set_width: str, set_height: str) -> DataFrame:
    """megapixels and meets_requirement; settings stand in for unknown capabilities."""
    w = F.coalesce(F.col(max_width), F.col(set_width), F.lit(0)).cast("long")
    h = F.coalesce(F.col(max_height), F.col(set_height), F.lit(0)).cast("long")
    return df.withColumns({"megapixels": w * h / 1e6, "meets_requirement": w * h >= MIN_PIXELS})


def result_key(*parts: Column) -> Column:
    """An opaque key that a second run makes again. A null part is no empty one."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def write_results(results: DataFrame, payload: DataFrame, key: str, day: str, path: str) -> None:
    """Adds results and their payload to two Parquet tables by day, so that reading the one
    never touches the bytes of the other. A key that the day holds already is not written
    again, so a run can be repeated; of rows that share a key, one is written."""
    for table, rows in (("results", results), ("payload", payload)):
        place, fresh = f"{path}/{table}", rows.dropDuplicates([day, key])
        if _exists(rows, place):
            held = rows.sparkSession.read.schema(rows.select(key, day).schema).parquet(place)  # two columns, one of them the folder's
            fresh = fresh.join(held, [key, day], "left_anti").select(rows.columns)
        fresh.write.mode("append").partitionBy(day).parquet(place)


def _exists(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
