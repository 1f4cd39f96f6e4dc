"""Countdown attempts: started by a run of good frames, aborted by a bad one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framegate.operators.sampling import ordered_runs
from framegate.operators.windows import Names, island, known, run_length, true
from framegate.presets import BURST_MIN_SHARPNESS, BURST_US, COUNTDOWN_MS, GOOD_FRAMES

NEVER = (1 << 63) - 1


def _next_bad(df: DataFrame, key: Names, order: Names, us: str) -> DataFrame:
    """_bad: the time of the next row that is not good, looked for backwards: a frame that only
    grows is aggregated once."""
    ahead = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_bad", F.last(F.when(~F.col("_good"), F.col(us)), ignorenulls=True).over(ahead))


def countdown_trigger(
    df: DataFrame, key: Names, us: str, tie: str, good: Column, frames: int = GOOD_FRAMES, wait_us: int = COUNTDOWN_MS * 1000
) -> DataFrame:
    """One row an attempt: key, started_us, outcome, ended_us.

    An attempt starts at the frames-th good row in a row. It is captured wait_us later unless
    a bad row comes before; then it is aborted there. It is open if the log ends first.
    Attempts after a session's first capture do not count."""
    order = (us, tie)
    df = df.withColumn("_good", true(good))
    df = run_length(df, key, order, F.col("_good"), "_run")
    by_key = Window.partitionBy(*key)
    df = _next_bad(df.withColumn("_last", F.max(us).over(by_key)), key, order, us)
    starts = df.filter(F.col("_run") == frames)
    due = F.col(us) + wait_us
    outcome = (
        F.when(F.col("_bad").isNotNull() & (F.col("_bad") < due), "aborted").when(F.col("_last") >= due, "captured").otherwise("open")
    )
    ended = F.when(outcome == "aborted", F.col("_bad")).when(outcome == "captured", due)
    rows = starts.select(*key, F.col(us).alias("started_us"), outcome.alias("outcome"), ended.alias("ended_us"))
    won = F.min(F.when(F.col("outcome") == "captured", F.col("started_us"))).over(by_key)
    return rows.withColumn("_won", won).filter("_won is null or started_us <= _won").drop("_won")


def countdown_bursts(
    df: DataFrame, key: Names, us: str, tie: str, good: Column, sharpness: Column, frames: int = GOOD_FRAMES, wait_us: int = COUNTDOWN_MS * 1000,
    burst_us: int = BURST_US, least: float = BURST_MIN_SHARPNESS,
) -> DataFrame:
    """countdown_trigger with the burst that a capture takes: one row an attempt, with
    best_sharpness, the burst's best.

    The burst is the rows of the burst_us from wait_us after the start on. If its best
    sharpness is least or more the attempt is captured and the session is over. Else (also
    where no sharpness is known) it is rejected, ends with the burst, and the session is armed
    again: the next good row whose run has frames rows by then starts the next attempt, the row
    that ends the burst included. Runs go on through a countdown and through a burst. An
    attempt is open if the log ends before its burst is over.

    All that a row needs is put beside it by windows over one partitioning; what depends on
    the attempt before is which rows start one, and that is picked by jumps over sorted
    columns, one jump an attempt."""
    order = (us, tie)
    df = df.select(*key, us, tie, true(good).alias("_good"), known(sharpness).alias("_sharp")).repartition(*key)
    df = island(run_length(df, key, order, F.col("_good"), "_run"), key, order, F.col("_good"), "_isle")
    by_key = Window.partitionBy(*key)
    burst = by_key.orderBy(us).rangeBetween(wait_us, wait_us + burst_us - 1)
    df = df.withColumns({"_last": F.max(us).over(by_key), "_best": F.max("_sharp").over(burst)})
    df = _next_bad(df, key, order, us).withColumn("_bad", F.coalesce("_bad", F.lit(NEVER)))
    armed = df.filter(F.col("_good") & (F.col("_run") >= frames)).drop("_good", "_sharp", "_run")

    def step(state: dict, rows: pd.DataFrame) -> np.ndarray:
        at, isle, bad = (rows[c].to_numpy() for c in (us, "_isle", "_bad"))
        last, best, starts = rows["_last"].to_numpy(), rows["_best"].to_numpy(), []
        if state.get("over"):
            return np.zeros(0, int)
        time, run = state.get("free", (int(at[0]), 0))  # the next start comes no earlier, in no earlier run
        i = max(int(np.searchsorted(at, time)), int(np.searchsorted(isle, run)))
        while i < len(at):
            starts.append(i)
            due = at[i] + wait_us
            if bad[i] < due:
                time, run = int(at[i]), int(isle[i]) + 1
            elif last[i] < due + burst_us or best[i] >= least:
                state["over"] = True
                break
            else:
                time, run = int(due + burst_us), 0
            state["free"] = time, run
            i = max(i + 1, int(np.searchsorted(at, time)), int(np.searchsorted(isle, run)))
        return np.array(starts, int)

    kinds = dict(armed.dtypes)
    starts = ordered_runs(armed, key, order, dict, step, ", ".join(f"{c} {kinds[c]}" for c in armed.columns), dealt=True)
    due = F.col(us) + wait_us
    judged = F.when(F.col("_best") >= least, "captured").otherwise("rejected")
    outcome = F.when(F.col("_bad") < due, "aborted").when(F.col("_last") < due + burst_us, "open").otherwise(judged)
    ended = F.when(F.col("outcome") == "aborted", F.col("_bad")).when(F.col("outcome") == "captured", due).when(F.col("outcome") == "rejected", due + burst_us)
    best = F.when(F.col("outcome").isin("captured", "rejected"), F.col("_best"))
    return starts.withColumn("outcome", outcome).select(*key, F.col(us).alias("started_us"), "outcome", ended.alias("ended_us"), best.alias("best_sharpness"))
