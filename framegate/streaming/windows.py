"""Streams that Spark's own windows, joins and deduplication express."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_telemetry(df: DataFrame, ts: str, key: str, value: str, every: str, slide: str | None = None, late: str = "30 seconds") -> DataFrame:
    """Count and sum per window and key; slide for overlapping windows."""
    span = F.window(ts, every, slide or every)
    out = df.withWatermark(ts, late).groupBy(span, key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), key, "n", "total")


def windowed(df: DataFrame, ts: str, key: str, value: str, every: str, reset: Column | None = None, late: str = "30 seconds") -> DataFrame:
    """Windows as stateful.RunningTotals takes them: key, us (the window's start), id, n,
    total, reset and the window's event time. Two stateful steps in a row, in append mode: a
    window is added up once the watermark has closed it. reset: rows that begin totals anew,
    with the window that they fall in."""
    rows = df.withColumn("_reset", reset if reset is not None else F.lit(False)).withWatermark(ts, late)
    per = rows.groupBy(F.window(ts, every), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max("_reset").alias("reset"))
    return per.select(
        F.col(key).alias("key"), F.unix_micros("window.start").alias("us"), F.lit(0).cast("long").alias("id"), "n", "total", "reset", F.window_time("window").alias("ts")
    )


def stream_asof(frames: DataFrame, readings: DataFrame, late: str = "30 seconds") -> DataFrame:
    """Two streams (key, us, id, value, ts) as stateful.LatestReading takes them. Each has its
    own watermark, and the lesser one holds."""
    sides = [df.withWatermark("ts", late).select("key", "us", "id", "ts", F.lit(side).alias("side"), value) for side, df, value in ((0, readings, F.col("value")), (1, frames, F.lit(None).cast("double").alias("value")))]
    return sides[0].unionByName(sides[1])


def stream_sessions(df: DataFrame, ts: str, key: str, value: str, gap: str, late: str = "30 seconds") -> DataFrame:
    out = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key)
    out = out.agg(F.count("*").alias("frames"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.max(value).alias("best"))
    return out.drop("session_window")


def stream_ttl_lookup(requests: DataFrame, store: DataFrame, token: str, ttl: str, late: str = "30 seconds") -> DataFrame:
    """Requests (token, ts, id) left-joined with the items (token, ts) stored at most ttl
    before; what finds none is told once the watermark rules it out."""
    asked = requests.withWatermark("ts", late).alias("r")
    held = store.select(F.col(token).alias("held"), F.col("ts").alias("stored_ts")).withWatermark("stored_ts", late).alias("s")
    near = F.expr(f"r.{token} = s.held and r.ts >= s.stored_ts and r.ts <= s.stored_ts + interval {ttl}")
    return asked.join(held, near, "left_outer").select("r.*", F.col("s.held").isNotNull().alias("found"))


def stream_dedup(df: DataFrame, ts: str, keys: list[str], late: str = "30 seconds") -> DataFrame:
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def drained(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that its source holds now and returns what it wrote."""
    name = uuid.uuid4().hex
    out = f"{folder}/stream-{name}"
    query = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", f"{folder}/stream-{name}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)
