"""Stateful streams over several batches, out of order, against the same rules row by row."""

import random
import time
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framegate.presets import Band
from framegate.streaming import stateful, windows

LATE_MS = 5_000


def streamed(spark, folder, batches, processor, columns, **options):
    """What a processor tells of rows (key, us, id, ...) that come in the given batches."""
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, f"key long, us long, id long{columns}")
        df.coalesce(1).write.parquet(f"{folder}/in/{k:02d}")
    paths = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in/*")
    rows = paths.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", f"{LATE_MS} milliseconds")
    out = windows.drained(stateful.run_ordered(rows, processor, **options), str(folder))
    return sorted(tuple(r) for r in out.collect())


def below_mark(batches):
    rows = sorted(r for b in batches for r in b)
    mark = max(r[1] for r in rows) // 1000 - LATE_MS
    return [r for r in rows if r[1] // 1000 < mark]


def shuffled(seed, value):
    """Four batches; rows come up to some seconds late, none below the watermark."""
    rng = random.Random(seed)
    rows = [(rng.randrange(6), 1_000_000 * t + rng.randrange(999_999), t, value(rng)) for t in range(1, 240)]
    came = sorted(rows, key=lambda r: r[1] + rng.randrange(4_000_000))
    return [came[k : k + 60] for k in range(0, len(came), 60)]


@pytest.mark.parametrize("idle_ms", [None, 7_000])
def test_hysteresis(spark, tmp_path, idle_ms):
    batches = shuffled(1, lambda rng: rng.choice([100.0, 190.0, 240.0, 290.0, None]))
    band, on, last, want = Band(200, 280, 20), {}, {}, []
    for key, us, i, v in below_mark(batches):
        if idle_ms is not None and us // 1000 - last.get(key, us // 1000) > idle_ms:
            on[key] = False
        last[key] = us // 1000
        margin = band.margin if on.get(key) else 0.0
        if v is not None:
            on[key] = band.low - margin <= v <= band.high + margin
        want.append((key, i, "pass" if on.get(key) else "fail"))
    got = streamed(spark, tmp_path, batches, stateful.Hysteresis(band), ", value double", idle_ms=idle_ms)
    assert got == sorted(want) and {w[2] for w in want} == {"pass", "fail"}


@pytest.mark.parametrize("at_once", [False, True])
def test_rate_limit_forgets_without_a_trace(spark, tmp_path, at_once):
    batches = [[r[:3] for r in b] for b in shuffled(2, lambda rng: None)]
    batches = [sum(batches, [])] if at_once else batches
    seen, want = {}, []
    for key, us, i in below_mark(batches):
        at = (key, us // 20_000_000)
        seen[at] = seen.get(at, 0) + 1
        want.append((key, i, seen[at] <= 2))
    assert streamed(spark, tmp_path, batches, stateful.RateLimit(2, 20_000_000), "") == sorted(want)


@pytest.mark.parametrize("bucket_ms", [1, 3, 600_000])
def test_rows_are_told_when_the_watermark_is_beyond_their_millisecond(spark, tmp_path, bucket_ms):
    processor = stateful.RateLimit(9, 1_000)
    processor.bucket_ms = bucket_ms
    mark = 20_000
    rows = [(k, us, k) for k, us in enumerate([mark * 1000 - 2000, mark * 1000 - 1, mark * 1000, mark * 1000 + 1, (mark + LATE_MS) * 1000])]
    assert [r[1] for r in streamed(spark, tmp_path, [rows], processor, "")] == [0, 1]
    assert [r[2] for r in below_mark([rows])] == [0, 1]


def test_dedup_tells_a_key_once(spark, tmp_path):
    for k, rows in enumerate([[(1, 1), (1, 2), (2, 3)], [(1, 4), (3, 9)], [(2, 8), (3, 10)]]):
        spark.createDataFrame(rows, "k long, s long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    df = spark.readStream.schema("k long, s long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = windows.stream_dedup(df.withColumn("ts", F.timestamp_seconds("s")), "ts", ["k"], "1 minute").select("k")
    assert sorted(r.k for r in windows.drained(out, str(tmp_path)).collect()) == [1, 2, 3]


def test_samplers_forget_what_no_longer_matters(spark, tmp_path):
    batches = shuffled(8, lambda rng: rng.choice(["a", "b", None]))
    kept, said, last, spoken = [], [], {}, {}
    for key, us, i, text in below_mark(batches):
        if key not in last or us - last[key] >= 5_000_000:
            last[key] = us
            kept.append((key, us, i))
        at, word = spoken.get(key, (None, None))
        if at is None or us - at >= 3_000_000 and (text != word or us - at >= 9_000_000):
            spoken[key] = us, text
            said.append((key, us, i, text))
    bare = [[r[:3] for r in b] for b in batches]
    assert streamed(spark, tmp_path / "gap", bare, stateful.GapSampler(5_000_000), "") == sorted(kept)
    got = streamed(spark, tmp_path / "said", batches, stateful.Throttle(3_000_000, 9_000_000), ", text string")
    assert sorted(got, key=repr) == sorted(said, key=repr) and len(said) < len(kept) * 3


def test_two_streams_meet_as_of(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(4), 500_000 * rng.randrange(1, 300), k, rng.choice([1.0, 2.0, 3.0, None]), rng.random() < 0.5) for k in range(400)]
    sides = {}
    for name, side in (("readings", False), ("frames", True)):
        came = sorted((r for r in rows if r[4] == side), key=lambda r: r[1] + rng.randrange(4_000_000))
        for b in range(0, len(came), 50):
            spark.createDataFrame([r[:4] for r in came[b : b + 50]], "key long, us long, id long, value double").coalesce(1).write.parquet(f"{tmp_path}/{name}/{b:04d}")
        df = spark.readStream.schema("key long, us long, id long, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
        sides[name] = df.withColumn("ts", F.timestamp_micros("us"))
    both = windows.stream_asof(sides["frames"], sides["readings"], f"{LATE_MS} milliseconds")
    got = windows.drained(stateful.run_ordered(both, stateful.LatestReading()), str(tmp_path))
    mark = min(max(r[1] for r in rows if r[4] == side) for side in (False, True)) // 1000 - LATE_MS
    latest, want = {}, []
    for key, us, i, v, frame in sorted(rows, key=lambda r: (r[1], r[4], r[2])):
        if frame and us // 1000 < mark:
            want.append((key, i, latest.get(key)))
        elif not frame and v is not None:
            latest[key] = v
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_totals_begin_anew_after_a_reset(spark, tmp_path):
    batches = shuffled(6, lambda rng: rng.choice([1.0, 2.0, None]))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "key long, us long, id long, v double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    df = spark.readStream.schema("key long, us long, id long, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    df = df.withColumn("ts", F.timestamp_micros("us"))
    out = windows.windowed(df, "ts", "key", "v", "10 seconds", F.col("id") % 40 == 0, f"{LATE_MS} milliseconds")
    got = windows.drained(stateful.run_ordered(out, stateful.RunningTotals()), str(tmp_path))
    every = 10_000_000
    mark = max(r[1] for b in batches for r in b) // 1000 - LATE_MS
    per = {}
    for key, us, i, v in (r for b in batches for r in b):
        w = per.setdefault((key, us // every * every), [0, None, False])
        w[0] += 1
        w[1] = w[1] if v is None else (w[1] or 0.0) + v
        w[2] |= i % 40 == 0
    want, so_far = [], {}
    for (key, start), (n, total, reset) in sorted(per.items()):
        a, b = (0, None) if reset else so_far.get(key, (0, None))
        so_far[key] = a + n, b if total is None else (b or 0.0) + total
        if (start + every) // 1000 <= mark:
            want.append((key, start, n, *so_far[key]))
    assert sorted(map(tuple, got.collect())) == want and any(r[2] for r in per.values())


def test_a_quotas_state_dies_with_its_window(spark, tmp_path):
    """Time to live, by the clock: after the window nothing is stored and requests are let in again."""
    df = spark.readStream.schema("key string, id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = stateful.live_quota(df, 2, 4_000)

    def run(k, rows):
        spark.createDataFrame(rows, "key string, id long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        options = {"path": f"{tmp_path}/out", "checkpointLocation": f"{tmp_path}/state"}
        out.writeStream.format("parquet").outputMode("append").options(**options).trigger(once=True).start().awaitTermination()
        return {r["id"]: r["admitted"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    def held():
        return spark.read.format("statestore").option("stateVarName", "seen").load(f"{tmp_path}/state").count()

    assert run(0, [("a", 1), ("a", 2), ("a", 3), ("b", 4)]) == {1: True, 2: True, 3: False, 4: True}
    assert held() == 2
    time.sleep(5)
    assert {i: v for i, v in run(1, [("c", 5)]).items() if i == 5} == {5: True}
    assert held() == 1, "a and b are gone"
    time.sleep(5)
    assert {i: v for i, v in run(2, [("a", 6), ("a", 7)]).items() if i > 5} == {6: True, 7: True}


class Store:
    """A state store of one group that counts its calls."""

    def __init__(self):
        self.calls, self.value, self.chunks, self.timers = 0, None, {}, set()

    def called(self, result=None):
        self.calls += 1
        return result

    def handle(self):
        value = SimpleNamespace(
            get=lambda: self.called(self.value), exists=lambda: self.called(self.value is not None),
            update=lambda v: self.called(setattr(self, "value", v)), clear=lambda: self.called(setattr(self, "value", None)),
        )
        chunks = SimpleNamespace(
            getValue=lambda k: self.called(self.chunks.get(k)), updateValue=lambda k, v: self.called(self.chunks.update({k: v})), removeKey=lambda k: self.called(self.chunks.pop(k)),
        )
        return SimpleNamespace(getValueState=lambda *_: value, getMapState=lambda *_: chunks, registerTimer=lambda ms: self.called(self.timers.add(ms)))


@pytest.mark.parametrize("n", [100, 2_000])
def test_store_calls_do_not_grow_with_rows_and_keys(n):
    """Rows days apart, of many keys of a group, come at once and are told by one timer."""
    store, processor = Store(), stateful.GapSampler(1_000)
    processor.chunk_rows = 500
    processor.init(store.handle())
    rows = [(str(k % 50), 86_400_000_000 * k, k) for k in range(n)]
    at = SimpleNamespace(getCurrentWatermarkInMs=lambda: 86_400_000 * (n + 9))
    list(processor.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["key", "us", "id"])]), at))
    told, fired = [], 0
    while store.timers:
        first = min(store.timers)
        told += [r for df in processor.handleExpiredTimer((0,), at, SimpleNamespace(getExpiryTimeInMs=lambda: first)) for r in df.itertuples(index=False)]  # noqa: B023
        store.timers.remove(first)
        fired += 1
    assert [tuple(r) for r in told] == [(k, us, i) for k, us, i in rows]
    assert fired == 1 and store.calls <= 8 + 3 * (n // 500)
    assert store.value is None and not store.chunks, "keys and chunks are gone"


@pytest.mark.parametrize("groups", [None, 2])
@pytest.mark.parametrize("chunk_rows", [2, 1_000])
@pytest.mark.parametrize("idle_ms", [None, 7_000])
def test_keys_that_share_a_state_do_not_meet(spark, tmp_path, groups, chunk_rows, idle_ms):
    batches = shuffled(9, lambda rng: rng.choice([100.0, 190.0, 240.0, 290.0, None]))
    batches = [[(r[0] + 2**60, *r[1:]) for r in b] for b in batches]
    band, on, last, want = Band(200, 280, 20), {}, {}, []
    rows = sorted((r for b in batches for r in b), key=lambda r: r[1:3])
    mark = max(r[1] for r in rows) // 1000 - LATE_MS
    for key, us, i, v in rows:
        if us // 1000 >= mark:
            continue
        if idle_ms is not None and us // 1000 - last.get(key, us // 1000) > idle_ms:
            on[key] = False
        last[key] = us // 1000
        margin = band.margin if on.get(key) else 0.0
        if v is not None:
            on[key] = band.low - margin <= v <= band.high + margin
        want.append((key, i, "pass" if on.get(key) else "fail"))
    processor = stateful.Hysteresis(band)
    processor.chunk_rows = chunk_rows
    got = streamed(spark, tmp_path, batches, processor, ", value double", idle_ms=idle_ms, groups=groups)
    assert got == sorted(want)
