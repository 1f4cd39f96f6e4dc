"""Stages and countdowns against the same rules row by row; streams against batches."""

import random

import pytest
from pyspark.sql import functions as F

from framegate.operators import countdown, sampling, stages
from framegate.presets import STAGES, Band, StageRules

SCHEMA = "s long, us long, id long, iris_diameter double, is_raised boolean, centering_ratio double, sharpness double, brightness double, return_to string"
RULES = StageRules(hold_us=3000, raised_frames=4)


def made(n_sessions=60, n=120, returns=False, seed=3):
    rng = random.Random(seed)
    out, i = [], 0
    for s in range(n_sessions):
        for k in range(n):
            i += 1
            lost = rng.random() < 0.02
            out.append(
                (
                    s, k * 1000 + rng.randrange(900), i, rng.choice([None, float("nan")]) if lost else 1080 * rng.uniform(0.075, 0.135), rng.random() < 0.8,
                    None if lost else rng.uniform(0, 0.36), rng.uniform(7.5, 20), rng.uniform(55, 210),
                    rng.choice(STAGES[:3]) if returns and rng.random() < 0.03 else None,
                )
            )
    return out


def names():
    return [c.split()[0] for c in SCHEMA.split(", ")]


def sequential(rows, rules=RULES):
    out, states = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        row = dict(zip(names(), r, strict=True))
        state = states.setdefault(r[0], stages.SessionState())
        if row["return_to"]:
            state.back_to(row["return_to"])
        out[r[2]] = state.step(row, rules)
    return out


def test_progression(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {r.id: r.stage for r in stages.stage_progression(df, ["s"], "us", "id", RULES).collect()}
    want = sequential(rows)
    assert got == want and set(want.values()) == set(STAGES)


def test_progression_shuffles_once(spark):
    df = spark.createDataFrame(made(2, 5), SCHEMA)
    plan = stages.stage_progression(df, ["s"], "us", "id", RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_report(spark):
    """Progress and messages of the state machine, at every row."""
    rows = made(30)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {r.id: r for r in stages.stage_report(df, ["s"], "us", "id", RULES).collect()}
    states = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        row = dict(zip(names(), r, strict=True))
        state = states.setdefault(r[0], stages.SessionState())
        stage = state.step(row, RULES)
        clock = {"distance": state.since1, "final_checks": state.since3}
        if stage in clock:
            want = 0.0 if clock[stage] is None else min(100.0, (row["us"] - clock[stage]) * 100.0 / RULES.hold_us)
        else:
            want = min(100.0, state.raised * 100.0 / RULES.raised_frames) if stage == "eyebrows" else 100.0
        assert got[row["id"]].progress == pytest.approx(want), (stage, row)
        assert got[row["id"]].can_advance == (want >= 100)
        if stage == "eyebrows" and not row["is_raised"]:
            assert got[row["id"]].message == "Raise Your Eyebrows"
        if stage == "ready":
            assert got[row["id"]].message == "Hold Still!"


def test_regression(spark):
    rows = made(returns=True)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = stages.stage_regression(df, ["s"], "us", "id", RULES)
    assert {r.id: r.stage for r in got.collect()} == sequential(rows)


def test_regression_keeps_the_confirmation():
    state = stages.SessionState()
    rules = StageRules()
    near = {"iris_diameter": 108.0, "is_raised": False, "centering_ratio": 0.1, "sharpness": 20.0, "brightness": 140.0}
    for us in (0, 900_000):
        stage = state.step(near | {"us": us}, rules)
    assert stage == "eyebrows"
    for k in range(30):
        stage = state.step(near | {"us": 10**6 + k, "is_raised": True}, rules)
    assert stage == "final_checks"
    state.back_to("eyebrows")
    assert state.step(near | {"us": 2 * 10**6}, rules) == "final_checks"


def countdowns(rows, frames, wait):
    out = set()
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    for s, session in by.items():
        run, start = 0, None
        for _, us, _, good in session:
            if start is not None and us >= start + wait:
                out.add((s, start, "captured", start + wait))
                start = None
                break
            if good:
                run += 1
                if run == frames:
                    start = us
            else:
                if start is not None:
                    out.add((s, start, "aborted", us))
                run, start = 0, None
        if start is not None:
            out.add((s, start, "open", None))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_countdown(spark, seed):
    rng = random.Random(seed)
    rows = [(s, k * 100 + rng.randrange(99), s * 1000 + k, rng.random() < 0.93) for s in range(80) for k in range(rng.randrange(1, 70))]
    df = spark.createDataFrame(rows, "s long, us long, id long, good boolean").repartition(4)
    got = countdown.countdown_trigger(df, ["s"], "us", "id", F.col("good"), 5, 2000)
    got = {tuple(r) for r in got.select("s", "started_us", "outcome", "ended_us").collect()}
    want = countdowns(rows, 5, 2000)
    assert got == want and {r[2] for r in want} == {"captured", "aborted", "open"}


def test_samplers(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(5), rng.randrange(20_000), i, rng.choice("abc")) for i in range(800)]
    df = spark.createDataFrame(rows, "s long, us long, id long, text string").repartition(3)
    kept, said = set(), set()
    last, spoken = {}, {}
    for s, us, i, text in sorted(rows):
        if s not in last or us - last[s] >= 150:
            last[s] = us
            kept.add(i)
        before = spoken.get(s)
        if before is None or (us - before[0] >= 100 and (text != before[1] or us - before[0] >= 300)):
            spoken[s] = (us, text)
            said.add(i)
    assert {r.id for r in sampling.min_gap_sample(df, "s", "us", "id", 150).collect()} == kept
    assert {r.id for r in sampling.throttle_repeats(df, "s", "us", "id", "text", 100, 300).collect()} == said
    assert sampling.min_gap_sample(df.limit(0), "s", "us", "id", 150).count() == 0


def test_bands_are_inclusive():
    assert Band(1.0, 2.0).margin == 0.0
