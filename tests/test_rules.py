"""Scores, geometry, policies, sources and scoring: literal cases."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framegate.functions import geometry, scores
from framegate.operators import candidates, policy, raster, scoring
from framegate.sources import captures, images


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("parts,want", [((60.0, 50.0, 35.0, 80.0), True), ((59.9, 50.0, 35.0, 80.0), False), ((60.0, 50.0, 34.9, 80.0), False), ((100.0, 100.0, 100.0, 79.9), False)])
def test_score_gate(spark, parts, want):
    row = one(spark, gate=scores.score_gate(F.lit(True), *map(F.lit, parts)), blind=scores.score_gate(F.lit(False), *map(F.lit, parts)))
    assert row.gate == want and not row.blind


def test_distance_bands(spark):
    def told(d):
        return one(spark, **scores.distance_score(F.lit(float(d)), F.lit(1000.0), F.lit(2000.0)))

    assert told(155).distance_score == 100 and told(155).distance_status == "ok"
    assert told(240).distance_status == "ok" and told(70 * 0.93).distance_status == "ok"
    assert told(60).distance_status == "warn" and told(60).distance_feedback == "Move closer"
    assert told(20).distance_status == "fail"
    assert told(300).distance_status == "warn" and told(500).distance_status == "fail" and told(500).distance_feedback == "Move back"
    assert told(1000).distance_score == 0


def test_lighting_and_focus_bands(spark):
    told = lambda b: one(spark, **scores.lighting_score(F.lit(float(b))))
    assert told(140).lighting_score == 100 and told(100).lighting_status == told(180).lighting_status == "ok"
    assert told(80).lighting_status == "warn" and told(60).lighting_status == "fail" and told(60).lighting_feedback == "Too dark"
    assert told(190).lighting_status == "warn" and told(255).lighting_status == "fail"
    focus = lambda f, c: one(spark, **scores.focus_status(F.lit(f), F.lit(c).cast("int")))
    assert focus(100.0, 40).focus_status == "ok" and focus(50.0, 40).focus_status == "warn" and focus(49.0, 40).focus_status == "fail"
    assert focus(500.0, None).focus_feedback == "Blurry" and focus(500.0, 15).focus_feedback == "Move closer" and focus(500.0, 15).focus_score == 0


def test_iris_and_crop(spark):
    pts = [(0.5, 0.4), (0.5, 0.35), (0.5, 0.45), (0.47, 0.4), (0.53, 0.4)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in pts],)], "p array<struct<x: double, y: double>>")
    w, h = F.lit(1000.0), F.lit(1000.0)
    df = df.withColumn("points", geometry.iris_points(geometry.landmark_to_pixels(F.col("p"), w, h), 0))
    df = df.withColumn("iris", geometry.iris_geometry(F.col("points"), w, h)).withColumn("box", geometry.crop_box(F.col("points"), F.col("iris"), w, h))
    row = df.first()
    assert row.iris.x == 500 and row.iris.y == 400 and row.iris.diameter == pytest.approx(100)
    assert row.box.size == 240 and row.box.x == 380 and row.box.y == 280
    low = df.select(geometry.iris_geometry(F.transform("points", lambda q: F.struct(q["x"].alias("x"), (q["y"] + 400).alias("y"))), w, h).alias("i")).first()
    assert low.i is None
    assert df.select(geometry.iris_points(F.slice("points", 1, 4), 0).alias("q")).first().q is None


def test_crop_stays_in_the_frame(spark):
    df = spark.createDataFrame([([{"x": 0.001 * i, "y": 0.0} for i in range(5)],)], "p array<struct<x: double, y: double>>")
    w, h = F.lit(100.0), F.lit(100.0)
    df = df.withColumn("points", geometry.iris_points(geometry.landmark_to_pixels(F.col("p"), w, h), 0)).withColumn("iris", geometry.iris_geometry(F.col("points"), w, h))
    box = df.select(geometry.crop_box(F.col("points"), F.col("iris"), w, h).alias("b")).first().b
    assert (box.x, box.y, box.size) == (0, 0, 32)


def test_candidates(spark):
    df = spark.createDataFrame([("a", 0, 8.0, 100.0, 0.5), ("a", 1, 13.0, 100.0, 0.8), ("b", 0, 90.0, 100.0, 0.9), ("c", 0, 15.0, 100.0, 0.1), ("c", 1, 13.0, 100.0, 0.2)], "item string, i int, area double, total double, score double")
    got = {r["item"]: r for r in candidates.nearest_in_bounds(df, "item", "i", "area", "total", "score").collect()}
    assert got["a"].score == 0.8 and got["b"].error and got["b"].score is None and got["c"].cand_idx == 0


def test_burst(spark):
    df = spark.createDataFrame([("a", 0, 150.0), ("a", 1, 200.0), ("a", 2, 200.0), ("b", 0, 139.0), ("c", 0, None), ("d", 0, float("nan")), ("d", 1, 140.0)], "k string, i int, s double")
    assert {(r.k, r.best_idx) for r in candidates.burst_best(df, "k", "i", "s").collect()} == {("a", 1), ("d", 1)}


def test_rasters_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    pictures = [rng.uniform(0, 255, (6, 9)) for _ in range(20)] + [np.full((6, 9), 10.0), np.full((6, 9), 250.0)]
    df = spark.createDataFrame([(i, p.ravel().tolist()) for i, p in enumerate(pictures)], "i long, g array<double>")
    df = raster.raster_focus(raster.raster_sharpness(df, "g", 9), "g", 9)
    df = raster.raster_brightness(df, "g", 9, 0, 0, 9, 6)
    for r in df.collect():
        p = pictures[r.i]
        _, sharp, focus = raster.measures(p)
        assert r.sharpness == pytest.approx(sharp, rel=1e-9, abs=1e-9) and r.focus == pytest.approx(focus, rel=1e-9, abs=1e-9)
        assert r.brightness == pytest.approx(p[1:4, 2:6].mean())


def test_retention(spark):
    now = 10_000_000_000
    df = spark.createDataFrame([("old", now - 3_610_000_000), ("edge", now - 3_600_000_000), ("new", now - 1)], "token string, us long")
    got = {r.token: r for r in policy.ttl_status(df, "us", now).collect()}
    assert got["old"].expired and got["old"].ttl_seconds == 1 and not got["edge"].expired and got["new"].ttl_seconds == 3599
    live, gone = policy.ttl_sweep(df, "us", now)
    assert {r.token for r in live.collect()} == {"edge", "new"} and {r.token for r in gone.collect()} == {"old"}


def test_quota(spark):
    rows = [(i, "process", "p1", i * 1000, None) for i in range(6)] + [(10, "process", "p2", 1, None), (11, "download", "p1", 2, None), (12, "process", "p1", 61_000_000, None)]
    df = spark.createDataFrame(rows, "id long, route string, client string, us long, x string")
    got = {r.id: r.admitted for r in policy.rate_limit(df, "route", "client", "us", "id", 5, 60_000_000).collect()}
    assert [got[i] for i in range(6)] == [True] * 5 + [False] and got[10] and got[11] and got[12]
    assert policy.rate_limit(df, "route", "client", "us", "id", 5, 60_000_000, sliding=True).filter("not admitted").count() == 1


def test_clients(spark):
    key = lambda peer, fwd, ok: one(spark, c=policy.client_key(F.lit(peer).cast("string"), F.lit(fwd).cast("string"), F.lit(ok))).c
    assert key("1.1.1.1", "9.9.9.9, 2.2.2.2", False) == "1.1.1.1" and key("1.1.1.1", "9.9.9.9, 2.2.2.2", True) == "9.9.9.9"
    assert key(None, None, True) == "unknown" and key("", " ", True) == "unknown"


def test_outcomes(spark):
    d = lambda t, a, f: one(spark, o=policy.download_outcome(F.lit(t).cast("string"), F.lit(a), F.lit(f))).o
    assert [d("", True, True), d("x" * 129, False, True), d("x", False, True), d("x", True, False), d("x" * 128, True, True)] == [422, 422, 429, 404, 200]
    p = lambda *x: one(spark, o=policy.process_outcome(*map(F.lit, x))).o
    assert [p(False, False, False, False), p(True, False, False, False), p(True, True, False, False), p(True, True, True, False), p(True, True, True, True)] == [429, 500, 400, 500, 200]


def test_devices(spark):
    rows = [(4032, 3024, None, None), (4000, 3000, None, None), (3999, 3000, None, None), (None, None, 1920, 1080), (None, None, None, None)]
    df = spark.createDataFrame(rows, "mw int, mh int, sw int, sh int")
    assert [r.meets_requirement for r in captures.device_eligibility(df, "mw", "mh", "sw", "sh").collect()] == [True, True, False, False, False]


def test_capture_log_keeps_malformed_rows(spark):
    df = spark.createDataFrame([('{"image": "x", "irisCenter": {"x": 1.5, "y": 2}, "sharpness": 3}',), ("nonsense",), (None,)], "body string")
    got = captures.read_capture_log(df, "body").select("record.image", "record.irisCenter.x").collect()
    assert got[0].image == "x" and got[0].x == 1.5 and got[1].image is None and len(got) == 3


def png(width, height, shade):
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    line = b"\0" + bytes([shade, shade, shade]) * width
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(line * height)) + chunk(b"IEND", b"")


def test_images_are_read_checked_and_measured(spark, tmp_path):
    (tmp_path / "fine.png").write_bytes(png(64, 70, 120))
    (tmp_path / "small.png").write_bytes(png(63, 70, 120))
    (tmp_path / "bad.png").write_bytes(b"no picture")
    df = images.read_images(spark, str(tmp_path))
    name = lambda p: p.rsplit("/", 1)[-1]
    good, bad = images.validate_items(df, images.upload_rules(F.col("length"), F.col("height"), F.col("width")))
    assert [name(r.path) for r in good.collect()] == ["fine.png"]
    assert {name(r.path): r.violation for r in bad.collect()} == {"small.png": "too small", "bad.png": "not an image"}
    seen = {name(r.path): r for r in raster.raster_metrics(df).collect()}
    assert seen["fine.png"].brightness == pytest.approx(120) and seen["fine.png"].sharpness == pytest.approx(0, abs=1e-6) and seen["bad.png"].focus is None


def test_results_are_appended_apart_from_their_payload(spark, tmp_path):
    """A repeated run adds nothing; a key that is new to its day is added."""
    df = spark.createDataFrame([("a", "2024-01-01", b"xx"), ("b", "2024-01-02", b"yy")], "k string, day string, payload binary")
    df = df.withColumn("key", captures.result_key(F.col("k"), F.col("day")))
    for _ in range(2):
        captures.write_results(df.select("key", "day"), df.select("key", "payload", "day"), "key", "day", str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/results").count() == 2 and "payload" not in spark.read.parquet(f"{tmp_path}/results").columns
    more = spark.createDataFrame([("c", "2024-01-02", b"zz")], "key string, day string, payload binary").union(df.select("key", "day", "payload"))
    captures.write_results(more.select("key", "day"), more.select("key", "payload", "day"), "key", "day", str(tmp_path))
    for table in ("results", "payload"):
        assert spark.read.parquet(f"{tmp_path}/{table}").count() == 3
    assert {bytes(r.payload) for r in spark.read.parquet(f"{tmp_path}/payload").collect()} == {b"xx", b"yy", b"zz"}


def _first(fail):
    def factory():
        def run(image, hint):
            if fail and image.mean() > 200:
                raise ValueError("no mask")
            return image, 0.5

        return run

    return factory


def _second():
    def run(image):
        if image.max() == 7:
            raise RuntimeError("out of memory")
        return np.repeat(np.repeat(image, 4, 0), 4, 1)

    return run


def test_two_stage_scoring(spark):
    def row(name, value, channels):
        return (name, 4, 5, channels, bytes([value]) * (20 * channels), None, 99.0)

    df = spark.createDataFrame([row("a", 10, 3), row("bad", 250, 3), row("slow", 7, 3), row("rgba", 20, 4)], "item_id string, height int, width int, n_channels int, data binary, hint_x double, hint_y double")
    got = {r.item_id: r for r in scoring.score_two_stage(df, _first(True), _second).collect()}
    assert got["a"].success and got["a"].upscaled_size == [16, 20] and got["a"].total_ms == pytest.approx(got["a"].stage1_ms + got["a"].stage2_ms)
    assert not got["bad"].success and got["bad"].error == "no mask" and got["bad"].original_size is None
    assert got["slow"].success and got["slow"].upscaled_size == [4, 5]
    assert got["rgba"].upscaled_size == [16, 20]
    assert scoring.hint_point(None, 3.0, 10, 8) == (5, 4) and scoring.hint_point(10.0, 3.0, 10, 8) == (5, 4) and scoring.hint_point(9.0, 3.0, 10, 8) == (9, 3)
