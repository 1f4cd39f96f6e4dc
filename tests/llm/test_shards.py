import math
import os
import threading

import pytest

from framegate.llm import queries
from framegate.llm.shards import SEALED, Conflict, ShardTable


@pytest.fixture
def shards(spark, tmp_path):
    return ShardTable(spark, str(tmp_path / "shards"), small_bytes=2000, target_bytes=100_000)


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_appends_and_merges_keep_every_row(shards, awkward):
    """Null rows, repeated rows, a long text and clashing names among them."""
    assert shards.read() is None and shards.version() == 0
    for _ in range(5):
        shards.append(awkward)
    assert shards.version() == 5 and shards.manifest().count() == 5
    shards.compact()
    after = shards.manifest().collect()
    assert len(after) < 5 and shards.version() > 5
    assert sum(r.n_rows for r in after) == 75
    want = awkward
    for _ in range(4):
        want = want.union(awkward)
    got = shards.read(shard_file="shard_file")
    assert same(got.drop("shard_file_"), want) and "shard_file_" in got.columns
    assert same(shards.read(), want)
    shards.compact(everything=True)
    assert same(shards.read(), want) and len([r for r in shards.manifest().collect() if r.tier != SEALED]) <= 1


def test_old_versions_stay_readable(shards, awkward):
    shards.append(awkward)
    first = {r.run for r in shards.manifest().collect()}
    shards.append(awkward.limit(2))
    assert first < {r.run for r in shards.manifest().collect()}
    assert {r.run for r in shards.manifest(1).collect()} == first
    assert same(shards.read(1), awkward)


def test_a_second_writer_from_the_same_base_fails(shards, awkward):
    shards.append(awkward)
    now = shards.manifest()
    shards.commit(now, 1)
    with pytest.raises(Conflict):
        shards.commit(now, 1)
    assert shards.version() == 2 and shards.manifest(2).count() == now.count()


def test_writers_at_once_lose_no_row(spark, tmp_path, awkward):
    path, failed = str(tmp_path / "s"), []

    def work(k):
        try:
            table = ShardTable(spark, path, small_bytes=2000, target_bytes=100_000, fan_in=3)
            for _ in range(2):
                table.append(awkward.limit(5 + k).coalesce(1))
            table.compact()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    table = ShardTable(spark, path)
    assert table.versions() == list(range(1, table.version() + 1)) and table.version() >= 8
    assert table.read().count() == 2 * (5 + 6 + 7 + 8)


def test_a_reader_opened_before_a_merge_goes_on_until_a_vacuum(shards, awkward):
    for _ in range(4):
        shards.append(awkward)
    old, at = shards.read(), shards.version()
    shards.compact()
    assert shards.version() > at and old.count() == 60 and shards.read(at).count() == 60
    shards.vacuum(keep=1)
    assert shards.versions() == [shards.version()] and shards.read().count() == 60
    with pytest.raises(Exception, match="(?i)not.?(exist|found)"):
        old.select("text").collect()


def test_nothing_to_add_is_no_version(shards, nothing):
    assert shards.append(nothing) == 0 and shards.version() == 0


def test_sealed_runs_stay(spark, tmp_path, awkward):
    table = ShardTable(spark, str(tmp_path / "s"), small_bytes=100, target_bytes=1000)
    for _ in range(4):
        table.append(awkward.coalesce(1))
    whole = {r.run for r in table.manifest().collect()}
    assert {r.tier for r in table.manifest().collect()} == {SEALED}
    table.compact()
    assert {r.run for r in table.manifest().collect()} == whole


def test_tiers_follow_a_model(shards, awkward):
    """After each arrival the manifest has the runs that the rule, played on sizes, leaves."""

    def tier(size, n_files):
        if size >= n_files * shards.target_bytes / 2:
            return SEALED
        return math.floor(math.log(max(1, size / shards.small_bytes), shards.fan_in))

    model = []  # (rows, tier)
    for n in (1, 15, 2, 2, 3, 15, 15, 4, 1, 15):
        part = awkward.limit(n).coalesce(1)
        before = {r.run for r in shards.manifest().collect()}
        shards.append(part)
        (new,) = [r for r in shards.manifest().collect() if r.run not in before]
        assert new.n_rows == n and new.tier == tier(new.bytes, new.n_files)
        model.append((n, new.tier))
        shards.compact()
        found = sorted((r.n_rows, r.tier) for r in shards.manifest().collect())
        while True:
            full = sorted({t for _, t in model if t != SEALED and sum(u == t for _, u in model) >= shards.fan_in})
            if not full:
                break
            merged = sum(n for n, t in model if t == full[0])
            model = [(n, t) for n, t in model if t != full[0]]
            (of,) = {t for n, t in found if n == merged} or {full[0] + 1}  # sizes of merged files are Parquet's
            model.append((merged, of))
        assert sorted(model) == found


def test_the_query_holds_every_document_once(spark, sf, documents):
    rows = queries.op7_sharding(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.collect())
    assert {r.n_rows for r in rows} == {len(rows)}


def test_a_base_left_behind_by_a_vacuum_is_refused(spark, tmp_path):
    shards = ShardTable(spark, str(tmp_path))
    for k in range(6):
        shards.append(spark.range(k * 10, k * 10 + 10))
    shards.vacuum(keep=2)
    assert shards.versions() == [5, 6]
    stale = ShardTable(spark, str(tmp_path))
    with pytest.raises(Conflict):
        stale.commit(shards.manifest(), 1)
    assert shards.versions() == [5, 6] and shards.read().count() == 60
    stale.append(spark.range(60, 70))
    assert shards.version() == 7 and shards.read().count() == 70


def test_other_columns_are_refused_and_leave_nothing(spark, tmp_path):
    shards = ShardTable(spark, str(tmp_path))
    shards.append(spark.range(5))
    for rows in (spark.range(5).selectExpr("id", "1 as more"), spark.range(5).selectExpr("cast(id as int) as id"), spark.range(5).selectExpr("id as other")):
        with pytest.raises(ValueError, match="other columns"):
            shards.append(rows)
    assert shards.version() == 1 and len(os.listdir(tmp_path / "data")) == 1


def test_a_merge_that_another_writer_forestalled_leaves_nothing(spark, tmp_path):
    shards = ShardTable(spark, str(tmp_path), fan_in=2)
    for k in range(2):
        shards.append(spark.range(k, k + 1))
    runs = [r[0] for r in shards.manifest().select("run").collect()]
    merged = f"{tmp_path}/data/merged"
    spark.read.parquet(*runs).coalesce(1).write.parquet(merged)
    shards.compact()
    at = shards.version()
    assert shards._added([merged], without=runs) == at and not os.path.exists(merged)
    assert sorted(r[0] for r in shards.read().collect()) == [0, 1]


def test_arrivals_come_in_the_order_of_values(spark, tmp_path):
    shards = ShardTable(spark, str(tmp_path))
    rows = spark.createDataFrame([(k, a) for k, a in enumerate([10, 9, None, 2, 10])], "id long, a int")
    shards.append_each(rows, "a")
    runs = [r[0] for r in shards.manifest().orderBy("version").select("run").collect()]
    assert [{r["a"] for r in spark.read.parquet(run).collect()} for run in runs] == [{None}, {2}, {9}, {10}]
    words = ShardTable(spark, f"{tmp_path}/words")
    words.append_each(spark.createDataFrame([(1, "null"), (2, None)], "id long, a string"), "a")
    assert words.manifest().count() == 2 and words.read().count() == 2
