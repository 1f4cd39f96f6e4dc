"""Stores that are rewritten: only what a change touches, and one writer at a time."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from framegate.sources import results, store, versions

DAY = store.DAY_US
TTL_S = 2 * 86_400


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def made(spark, path, rows):
    s = store.TokenStore(spark, str(path), ttl_s=TTL_S, buckets=8)
    s.put(spark.createDataFrame(rows, "token string, created_us long, body string"))
    return s


def test_sweep_rewrites_the_days_it_touches(spark, tmp_path):
    rows = [(f"t{k}", k * DAY // 4, "x") for k in range(24)] + [("none", None, "y")]  # four a day
    s = made(spark, tmp_path, rows)
    before = files(tmp_path / "items")
    limit = 2 * DAY + DAY // 2  # the third day is split
    got = sorted(map(tuple, s.sweep(limit + TTL_S * 10**6).collect()))
    assert got == [(-1, 1, 0), (0, 4, 0), (1, 4, 0), (2, 2, 2)]
    assert {r["token"] for r in s.items().collect()} == {f"t{k}" for k in range(10, 24)}
    after = files(tmp_path / "items")
    same = {f for f in before if any(f"day={d}/" in f for d in (3, 4, 5))}
    assert same and {f: after[f] for f in same} == {f: before[f] for f in same}, "later days keep their files"
    assert not [f for f in after if any(f"day={d}/" in f for d in (-1, 0, 1))]
    assert s.sweep(limit + TTL_S * 10**6).count() == 0, "nothing is left to evict"
    assert s.sweep(100 * DAY).agg(F.sum("evicted")).first()[0] == 14
    assert s.items().count() == 0


def test_an_item_on_the_limit_stays(spark, tmp_path):
    s = made(spark, tmp_path, [("a", 1000, "x"), ("b", 999, "x")])
    s.sweep(1000 + TTL_S * 10**6)
    assert [r["token"] for r in s.items().collect()] == ["a"]


def test_cleaning_takes_orphans_once(spark, tmp_path):
    s = made(spark, tmp_path, [(f"t{k}", k * DAY, "x") for k in range(12)])
    s.put_index(spark.createDataFrame([("lost",), ("gone",)], "token string"))
    s.sweep(6 * DAY + TTL_S * 10**6)
    reader = s.index()
    assert s.clean_index() == 8 and s.clean_index() == 0
    assert {r["token"] for r in s.index().collect()} == {f"t{k}" for k in range(6, 12)}
    assert reader.count() == 14, "a reader of the version before keeps its files"
    s.vacuum()
    assert s.index().count() == 6
    s.sweep(10**6 * DAY)
    assert s.clean_index() == 6 and s.index().count() == 0


def test_untouched_buckets_keep_their_folders(spark, tmp_path):
    s = made(spark, tmp_path, [(f"t{k}", 5 * DAY, "x") for k in range(40)])
    log = versions.Versions(spark, f"{tmp_path}/index-versions")
    before = log.read(log.last())
    s.put_index(spark.createDataFrame([("orphan",)], "token string"))
    assert s.clean_index() == 1
    now = log.read(log.last())
    assert len([b for b in before if now[b] != before[b]]) == 1


def test_other_columns_are_refused(spark, tmp_path):
    s = made(spark, tmp_path, [("a", 1, "x")])
    with pytest.raises(ValueError, match="other columns"):
        s.put(spark.createDataFrame([("b", 1, "x", 1)], "token string, created_us long, body string, more int"))


def test_a_base_left_behind_is_refused(spark, tmp_path):
    log = versions.Versions(spark, f"{tmp_path}/log")
    for k in range(3):
        assert log.commit({"k": k}, k) == k + 1
    for base in range(3):
        with pytest.raises(versions.Conflict):
            log.commit({"k": "stale"}, base)
    assert log.last() == 3 and log.read(3) == {"k": 2} and log.read(0) == {}


def test_writers_side_by_side_add_each_key_once(spark, tmp_path):
    table = results.ResultTable(spark, str(tmp_path), "key", "day")
    batches = {w: [spark.createDataFrame([(f"k{k}", k % 3, w) for k in range(b * 5, b * 5 + 10)], "key string, day int, by string") for b in range(3)] for w in "ab"}

    def run(w):
        for b, rows in enumerate(batches[w]):
            table.add(rows, w, b)

    threads = [threading.Thread(target=run, args=(w,)) for w in batches]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    keys = [r["key"] for r in table.read().collect()]
    assert sorted(keys) == sorted({f"k{k}" for k in range(20)})
    assert not table.add(batches["a"][1], "a", 1), "a batch that comes again is known"
    assert table.read().count() == 20


def test_a_replayed_stream_adds_nothing(spark, tmp_path):
    for k in range(2):
        spark.range(k * 5, k * 5 + 8).selectExpr("cast(id as string) as key", "id % 2 as day").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    table = results.ResultTable(spark, f"{tmp_path}/t", "key", "day")
    df = spark.readStream.schema("key string, day long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for run in range(2):
        table.drain(df, "w", f"{tmp_path}/state-{run}")
        assert table.read().count() == 13
    assert results.ResultTable(spark, f"{tmp_path}/none", "key", "day").read() is None
