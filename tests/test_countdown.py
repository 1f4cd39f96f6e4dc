"""Countdowns whose burst is judged, against the rules row by row."""

import random

import pytest
from pyspark.sql import functions as F

from framegate.operators import countdown, telemetry
from framegate.streaming import stateful
from tests.test_streams import below_mark, shuffled, streamed

RULES = {"frames": 3, "wait_us": 3_000_000, "burst_us": 1_000_000, "least": 140.0}


def attempts(rows, frames, wait_us, burst_us, least, still_open=True):
    """(key, started, outcome, ended, best) of rows (key, us, id, good, sharpness), by one machine a key."""
    told = []
    for key in {r[0] for r in rows}:
        mine, run, due, best = sorted(r for r in rows if r[0] == key), 0, None, None
        for _, us, _, good, sharp in mine:
            if due is not None and us >= due + burst_us:
                won = best is not None and best >= least
                told.append((key, due - wait_us, "captured" if won else "rejected", due if won else due + burst_us, best))
                due, best = None, None
                if won:
                    break
            elif due is not None and us >= due and sharp is not None:
                best = sharp if best is None else max(best, sharp)
            run = run + 1 if good else 0
            if due is not None and us < due and not good:
                told.append((key, due - wait_us, "aborted", us, None))
                due = None
            elif due is None and good and run >= frames:
                due = us + wait_us
        else:
            if due is not None and still_open:
                told.append((key, due - wait_us, "open", None, None))
    return sorted(told, key=repr)


def made(seed, n=900):
    rng = random.Random(seed)
    return [(rng.randrange(5), 250_000 * rng.randrange(1200), k, rng.random() < 0.97, rng.choice([None, 90.0, 120.0, 139.0, 150.0])) for k in range(n)]


SCHEMA = "s long, us long, id long, good boolean, sharp double"


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_machine(spark, seed):
    rows = made(seed) + [(None, us * 10**6, 10_000 + us, True, 100.0) for us in range(30)]
    want = attempts([(k if k is not None else -1, *r) for k, *r in rows], **RULES)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = countdown.countdown_bursts(df, ["s"], "us", "id", F.col("good"), F.col("sharp"), **RULES).na.fill(-1, ["s"])
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert "rejected" in {w[2] for w in want}


def test_a_rejected_burst_arms_the_next_good_row(spark):
    at = [(1, us * 10**6, us, True, 100.0 if us < 7 else 200.0) for us in range(12)]
    df = spark.createDataFrame(at, SCHEMA)
    got = countdown.countdown_bursts(df, ["s"], "us", "id", F.col("good"), F.col("sharp"), **RULES)
    assert sorted(map(tuple, got.collect())) == [(1, 2 * 10**6, "rejected", 6 * 10**6, 100.0), (1, 6 * 10**6, "captured", 9 * 10**6, 200.0)]
    assert countdown.countdown_bursts(df.limit(0), ["s"], "us", "id", F.col("good"), F.col("sharp"), **RULES).count() == 0


def test_one_shuffle(spark):
    df = spark.createDataFrame(made(1, 20), SCHEMA)
    plan = countdown.countdown_bursts(df, ["s"], "us", "id", F.col("good"), F.col("sharp"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_stream(spark, tmp_path):
    batches = shuffled(3, lambda rng: None)
    rng = random.Random(9)
    batches = [[(k % 2, us, i, rng.random() < 0.97, rng.choice([100.0, 150.0, None])) for k, us, i, _ in b] for b in batches]
    want = attempts(below_mark(batches), **RULES, still_open=False)
    got = streamed(spark, tmp_path, batches, stateful.BurstCountdown(**RULES), ", good boolean, sharpness double")
    assert sorted(got, key=repr) == want and want


def test_reports_fall_on_the_first_row_after_the_interval(spark):
    rows = [(1, t, t, 1.0) for t in (0, 4, 9, 10, 11, 19, 20, 31, 55)] + [(2, 7, 100, None), (2, 17, 101, 2.0), (3, 5, 102, 1.0)]
    got = telemetry.telemetry_reports(spark.createDataFrame(rows, "s long, us long, id long, v double"), "s", "us", "id", "v", 10)
    assert sorted(tuple(r) for r in got.select("s", "reported_us", "n_so_far", "total_so_far").collect()) == [
        (1, 10, 4, 4.0), (1, 20, 7, 7.0), (1, 31, 8, 8.0), (1, 55, 9, 9.0), (2, 17, 2, 2.0),
    ]
