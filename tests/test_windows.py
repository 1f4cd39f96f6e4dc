"""Window operators against the same rules row by row."""

import math
import random

import pytest
from pyspark.sql import functions as F

from framegate.operators import windows
from framegate.presets import Band

SCHEMA = "s long, us long, id long, v double, flag boolean"
KEY, ORDER = ["s"], ["us", "id"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(1500):
        v = rng.choice([None, float("nan")]) if rng.random() < 0.1 else rng.uniform(0, 100)
        out.append((rng.randrange(12), rng.randrange(400) * 1000, i, v, rng.choice([True, True, True, False, None])))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def sessions(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    return by.values()


def known(v):
    return v is not None and not math.isnan(v)


def test_hysteresis_band(df, rows):
    want = {}
    for session in sessions(rows):
        on = False
        for _, _, i, v, _ in session:
            if known(v):
                m = 10 if on else 0
                on = 30 - m <= v <= 60 + m
            want[i] = "pass" if on else "fail"
    got = windows.hysteresis_band(df, KEY, ORDER, F.col("v"), Band(30, 60, 10))
    assert {r.id: r.state for r in got.collect()} == want


def test_hysteresis_tristate(df, rows):
    want = {}
    for session in sessions(rows):
        state = "unavailable"
        for _, _, i, v, _ in session:
            if known(v):
                m = 5 if state == "optimal" else 0
                state = "too_flat" if v < 25 - m else "too_steep" if v > 50 + m else "optimal"
            want[i] = state
    got = windows.hysteresis_tristate(df, KEY, ORDER, F.col("v"))
    assert {r.id: r.angle_state for r in got.collect()} == want


def test_sma_restarts(df, rows):
    want = {}
    for session in sessions(rows):
        last = []
        for _, _, i, v, flag in session:
            last = [] if flag is False else [*last, v][-4:]
            fine = [x for x in last if known(x)]
            want[i] = sum(fine) / len(fine) if fine else None
    got = windows.sma_reset(df, KEY, ORDER, F.col("v"), 4, ~F.col("flag"))
    assert {r.id: r.sma for r in got.collect()} == {i: w if w is None else pytest.approx(w) for i, w in want.items()}


def test_sma_of_small_runs(spark):
    data = [(1, i, i, v, f) for i, (v, f) in enumerate([(10.0, True), (10.0, True), (10.0, True), (40.0, True), (None, False), (7.0, True)])]
    got = windows.sma_reset(spark.createDataFrame(data, SCHEMA), KEY, ORDER, F.col("v"), 3, ~F.col("flag"))
    assert [r.sma for r in got.orderBy("id").collect()] == [10, 10, 10, 20, None, 7]


def test_runs_and_holds(df, rows):
    run, held, gathered = {}, {}, {}
    for session in sessions(rows):
        n, start, total, before = 0, None, 0, None
        for _, us, i, _, flag in session:
            if flag:
                n += 1
                start = us if start is None else start
                total += us - before if before is not None else 0
            else:
                n, start, total = 0, None, 0
            before = us
            run[i], gathered[i] = n, total
            held[i] = start is not None and us - start >= 5000
    on = F.col("flag")
    assert {r.id: r.run for r in windows.run_length(df, KEY, ORDER, on).collect()} == run
    assert {r.id: r.held for r in windows.hold_for(df, KEY, ORDER, on, "us", 5000).collect()} == held
    assert {r.id: r.gathered_us for r in windows.accumulate_while(df, KEY, ORDER, on, "us").collect()} == gathered


def test_asof(df, rows, spark):
    left, right = [r for r in rows if r[2] % 2], [r for r in rows if not r[2] % 2]
    want = {}
    for s, us, i, _, _ in left:
        seen = sorted((r[1], r[2], r[3]) for r in right if r[0] == s and r[1] <= us and r[3] is not None)
        want[i] = seen[-1][2] if seen else None
    got = windows.asof(df.filter("id % 2 = 1"), df.filter("id % 2 = 0"), KEY, "us", "id", "v", "beta")
    got = {r.id: r.beta for r in got.collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == w or (w is not None and math.isnan(w) and math.isnan(got[i])) for i, w in want.items())


def test_chained_windows_share_one_shuffle(df):
    out = windows.hysteresis_band(df, KEY, ORDER, F.col("v"), Band(30, 60, 10))
    out = windows.hold_for(out, KEY, ORDER, F.col("state") == "pass", "us", 5000)
    out = windows.run_length(out, KEY, ORDER, F.col("flag"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(s#") == 1


@pytest.mark.parametrize("n", [0, 1])
def test_empty_and_single(spark, n):
    df = spark.createDataFrame([(1, 5, 1, 40.0, True)][:n], SCHEMA)
    assert windows.hold_for(windows.hysteresis_band(df, KEY, ORDER, F.col("v"), Band(30, 60)), KEY, ORDER, F.col("flag"), "us", 1).count() == n


HYSTERESIS_CASES = [([200], "pass"), ([240], "pass"), ([280], "pass"), ([199], "fail"), ([281], "fail"), ([240, 180], "pass"), ([240, 300], "pass"), ([240, 179], "fail"), ([240, 301], "fail")]


@pytest.mark.parametrize("values,want", HYSTERESIS_CASES)
def test_band_bounds(spark, values, want):
    df = spark.createDataFrame([(1, i, i, float(v), True) for i, v in enumerate(values)], SCHEMA)
    got = windows.hysteresis_band(df, KEY, ORDER, F.col("v"), Band(200, 280, 20)).orderBy("id").collect()
    assert got[-1].state == want
