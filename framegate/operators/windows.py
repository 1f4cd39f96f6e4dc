"""Sequence operators as window functions.

All take the key columns and a total order (end it with a unique column) and add columns.
They share one partitioning by the key, so Spark plans one shuffle however many are chained.
NULL and NaN are no signal: they hold a latch where it is and never start one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framegate.presets import PHONE_ANGLE, Band

Names = Sequence[str]


def _upto(key: Names, order: Names):
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def known(value: Column) -> Column:
    """NaN as NULL."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def sma_reset(df: DataFrame, key: Names, order: Names, value: Column, n: int, reset: Column, out: str = "sma") -> DataFrame:
    """Mean of the last n values since the last reset; NULL on the reset rows."""
    df = df.withColumn("_reset", true(reset)).withColumn("_seg", F.sum(F.col("_reset").cast("int")).over(_upto(key, order)))
    last = Window.partitionBy(*key, "_seg", "_reset").orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.when(~F.col("_reset"), F.avg(known(value)).over(last))).drop("_reset", "_seg")


def latch(df: DataFrame, key: Names, order: Names, enter: Column, leave: Column, out: str) -> DataFrame:
    """True from a row that enters until one that leaves; neither: as before; first: False.
    Where both hold, entering wins."""
    signal = F.when(enter, True).when(leave, False)
    return df.withColumn(out, F.coalesce(F.last(signal, ignorenulls=True).over(_upto(key, order)), F.lit(False)))


def hysteresis_band(df: DataFrame, key: Names, order: Names, value: Column, band: Band, out: str = "state") -> DataFrame:
    """'pass' once the value is inside the band, 'fail' once it is outside the band widened
    by its margin."""
    v = known(value)
    df = latch(df, key, order, v.between(band.low, band.high), ~v.between(band.low - band.margin, band.high + band.margin), "_on")
    return df.withColumn(out, F.when(F.col("_on"), "pass").otherwise("fail")).drop("_on")


def hysteresis_tristate(df: DataFrame, key: Names, order: Names, value: Column, band: Band = PHONE_ANGLE, out: str = "angle_state") -> DataFrame:
    """too_flat, optimal or too_steep by the latest known value; only optimal is sticky.
    'unavailable' before the first."""
    df = df.withColumn("_v", F.last(known(value), ignorenulls=True).over(_upto(key, order)))
    df = hysteresis_band(df, key, order, F.col("_v"), band, "_s")
    state = (
        F.when(F.col("_v").isNull(), "unavailable")
        .when(F.col("_s") == "pass", "optimal")
        .when(F.col("_v") < band.low, "too_flat")
        .otherwise("too_steep")
    )
    return df.withColumn(out, state).drop("_v", "_s")


def island(df: DataFrame, key: Names, order: Names, on: Column, out: str = "_island") -> DataFrame:
    """A number for each unbroken run of true rows; a false row begins a new one."""
    return df.withColumn(out, F.sum(F.when(true(on), 0).otherwise(1)).over(_upto(key, order)))


def hold_for(df: DataFrame, key: Names, order: Names, on: Column, us: str, hold_us: int, out: str = "held") -> DataFrame:
    """held: the condition has held for hold_us without a break; progress: share of it in %."""
    df = island(df.withColumn("_on", true(on)), key, order, F.col("_on"))
    start = F.min(us).over(Window.partitionBy(*key, "_island", "_on"))
    elapsed = F.when(F.col("_on"), F.col(us) - start)
    df = df.withColumn("_elapsed", elapsed)
    return df.withColumns(
        {
            out: F.coalesce(F.col("_elapsed") >= hold_us, F.lit(False)),
            f"{out}_progress": F.when(F.col("_elapsed").isNull(), 0.0).otherwise(F.least(F.lit(100.0), F.col("_elapsed") * 100.0 / hold_us)),
        }
    ).drop("_on", "_island", "_elapsed")


def run_length(df: DataFrame, key: Names, order: Names, on: Column, out: str = "run") -> DataFrame:
    """How many rows in a row, this one included, have been true; 0 where false."""
    df = island(df.withColumn("_on", true(on)), key, order, F.col("_on"))
    nth = F.row_number().over(Window.partitionBy(*key, "_island", "_on").orderBy(*order))
    return df.withColumn(out, F.when(F.col("_on"), nth).otherwise(0).cast("long")).drop("_on", "_island")


def accumulate_while(df: DataFrame, key: Names, order: Names, on: Column, us: str, out: str = "gathered_us") -> DataFrame:
    """Time gathered over the current run: each true row adds the time since the row before
    it, true or not; the first row of a key adds none; 0 where false."""
    step = F.coalesce(F.col(us) - F.lag(us).over(Window.partitionBy(*key).orderBy(*order)), F.lit(0))
    df = island(df.withColumn("_on", true(on)).withColumn("_step", step), key, order, F.col("_on"))
    run = Window.partitionBy(*key, "_island", "_on").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.when(F.col("_on"), F.sum("_step").over(run)).otherwise(0)).drop("_on", "_island", "_step")


def asof(left: DataFrame, right: DataFrame, key: Names, us: str, tie: str, value: str, out: str) -> DataFrame:
    """left with the latest known value of right at or before each row's time (readings at
    the same time count). One union and one window; no range join. left's columns stay."""
    ours = left.withColumns({"_side": F.lit(1), "_reading": F.lit(None).cast(dict(right.dtypes)[value])})
    theirs = right.select(*key, us, tie, F.lit(0).alias("_side"), F.col(value).alias("_reading"))
    both = ours.unionByName(theirs, allowMissingColumns=True)
    latest = F.last("_reading", ignorenulls=True).over(_upto(key, (us, "_side", tie)))
    return both.withColumn(out, latest).filter("_side = 1").drop("_side", "_reading")
