"""Counters and timings over long-form event rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framegate.operators.sampling import anchored_windows
from framegate.operators.windows import true
from framegate.presets import ABORTS, CONDITIONS


def condition_failures(df: DataFrame, key: str, condition: str, names: Sequence[str] = CONDITIONS) -> DataFrame:
    """One column a condition with its count, 0 where none; other conditions are ignored.
    A key without any of them keeps its row."""
    counts = [F.count_if(F.col(condition) == n).alias(n) for n in names]
    return df.groupBy(key).agg(*counts)


def abort_reasons(df: DataFrame, reason: str, names: Sequence[str] = ABORTS) -> DataFrame:
    """(reason, n) for every name, unknown or null reasons as the last name."""
    told = F.when(F.col(reason).isin(*names[:-1]), F.col(reason)).otherwise(names[-1])
    found = df.groupBy(told.alias("reason")).count()
    every = df.sparkSession.createDataFrame([(n,) for n in names], "reason string")
    return every.join(found, "reason", "left").select("reason", F.coalesce("count", F.lit(0)).alias("n"))


def timing_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sum, count, max and mean (0 where there is no value)."""
    v = F.col(value)
    return df.groupBy(key).agg(
        F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.count(v).alias("n"), F.coalesce(F.max(v), F.lit(0.0)).alias("longest"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"),
    )


def telemetry_summary(df: DataFrame, key: str, us: str, value: str, every_us: int, reset: Column | None = None) -> DataFrame:
    """Per aligned window with rows: the count and sum since the key's first window or, where
    reset is given, since the last window with a row that resets, this one included."""
    start = F.col(us) - F.pmod(F.col(us), F.lit(every_us))
    anew = F.max(true(reset)) if reset is not None else F.lit(False)
    per = df.groupBy(key, start.alias("window_us")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), anew.alias("_anew"))
    upto = Window.partitionBy(key).orderBy("window_us").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("_since", F.sum(F.col("_anew").cast("int")).over(upto))
    upto = Window.partitionBy(key, "_since").orderBy("window_us").rowsBetween(Window.unboundedPreceding, 0)
    return per.select(key, "window_us", "n", F.sum("n").over(upto).alias("n_so_far"), F.sum("total").over(upto).alias("total_so_far"))


def telemetry_reports(df: DataFrame, key: str, us: str, tie: str, value: str, every_us: int) -> DataFrame:
    """(key, tie, reported_us, n_so_far, total_so_far): totals of a key's rows up to and with
    each row on which its periodic report falls: the first at least every_us after the report
    before, the first one counted from the key's first row. Totals are a window, and which
    rows report is picked over its sorted rows by jumps; one shuffle."""
    upto = Window.partitionBy(key).orderBy(us, tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(key, us, tie, value).repartition(key)
    rows = rows.withColumns({"n_so_far": F.count("*").over(upto), "total_so_far": F.sum(value).over(upto)}).drop(value)
    return anchored_windows(rows, [key], us, tie, every_us).withColumnRenamed(us, "reported_us")


def processing_summary(df: DataFrame, key: Column, us: str, ok: Column, stage1: Column, stage2: Column, every_us: int) -> DataFrame:
    """Per window and key: requests, success rate, mean stage times; total = stage1 + stage2."""
    start = F.col(us) - F.pmod(F.col(us), F.lit(every_us))
    return df.groupBy(start.alias("window_us"), key.alias("client")).agg(
        F.count("*").alias("requests"), F.avg(ok.cast("int")).alias("success_rate"), F.avg(stage1).alias("stage1_ms"), F.avg(stage2).alias("stage2_ms"),
        F.avg(stage1 + stage2).alias("total_ms"),
    )
