"""Scores, gates and messages over events; geometry over points made of embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegate.functions import geometry, scores
from framegate.operators.scoring import score_two_stage as two_stage
from framegate.plans.base import EV, query
from framegate.sources.tables import events, load

LOW, HIGH = "(480 * 0.07e0)", "(480 * 0.24e0)"
FINE = f"value BETWEEN {LOW} * 0.93e0 AND {HIGH}"
DISTANCE = f"""CASE WHEN {FINE} THEN greatest(0e0, 100 - abs(value - ({LOW} + {HIGH}) / 2) / (({HIGH} - {LOW}) / 2) * 30) WHEN value < {LOW} THEN 70 * (value / {LOW})
  ELSE greatest(0e0, 70 - 70 * ((value - {HIGH}) / {HIGH})) END"""
DISTANCE_STATUS = f"""CASE WHEN {FINE} THEN 'ok' WHEN value < {LOW} THEN CASE WHEN value / {LOW} > 0.4e0 THEN 'warn' ELSE 'fail' END
  WHEN (value - {HIGH}) / {HIGH} < 0.6e0 THEN 'warn' ELSE 'fail' END"""
DISTANCE_TEXT = f"CASE WHEN {FINE} THEN 'Perfect distance' WHEN value < {LOW} THEN 'Move closer' ELSE 'Move back' END"
LIGHT = "(value * 3)"
LIGHTING = f"CASE WHEN {LIGHT} BETWEEN 100 AND 180 THEN greatest(0, 100 - abs({LIGHT} - 140) / 40 * 30) WHEN {LIGHT} < 100 THEN 70 * ({LIGHT} / 100) ELSE greatest(0, 70 - 70 * (({LIGHT} - 180) / 75)) END"
LIGHTING_STATUS = f"CASE WHEN {LIGHT} BETWEEN 100 AND 180 THEN 'ok' WHEN {LIGHT} < 100 THEN CASE WHEN {LIGHT} / 100 > 0.7 THEN 'warn' ELSE 'fail' END WHEN ({LIGHT} - 180) / 75 < 0.3 THEN 'warn' ELSE 'fail' END"
LIGHTING_TEXT = f"CASE WHEN {LIGHT} BETWEEN 100 AND 180 THEN 'Good lighting' WHEN {LIGHT} < 100 THEN 'Too dark' ELSE 'Too bright' END"
RATIO = "least(1.0, sqrt(pow(k * 6.4 - 320, 2) + pow(value * 4 - 240, 2)) / 240)"
CENTERING = f"greatest(0, (1 - {RATIO}) * 100)"
#: The same in doubles alone, where a status or a gate hangs on the last digit.
ACROSS, DOWN = "(k * 6.4e0 - 320e0)", "(value * 4e0 - 240e0)"
EXACT_RATIO = f"least(1e0, sqrt({ACROSS} * {ACROSS} + {DOWN} * {DOWN}) / 240e0)"
EXACT_CENTERING = f"greatest(0e0, (1e0 - {EXACT_RATIO}) * 100e0)"
EXACT_STATUS = f"CASE WHEN {EXACT_CENTERING} >= 20 THEN 'ok' WHEN {EXACT_CENTERING} >= 10 THEN 'warn' ELSE 'fail' END"
CENTERING_STATUS = f"CASE WHEN {CENTERING} >= 20 THEN 'ok' WHEN {CENTERING} >= 10 THEN 'warn' ELSE 'fail' END"
FOCUS_STATUS = "CASE WHEN k < 16 THEN 'fail' WHEN value * 2 >= 100 THEN 'ok' WHEN value * 2 >= 50 THEN 'warn' ELSE 'fail' END"
FOCUS_TEXT = "CASE WHEN k < 16 THEN 'Move closer' WHEN value * 2 >= 100 THEN 'Sharp' WHEN value * 2 >= 50 THEN 'Almost sharp' ELSE 'Blurry' END"
SEEN = "(event_type <> 'error')"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scored frames of 640 x 480: value gives diameter, brightness and height, k
    the crop and the place across, errors are frames without a face."""
    df = events(spark, sf_dir)
    value, k = F.col("value"), F.col("k")
    w, h = F.lit(640.0), F.lit(480.0)
    columns = (
        scores.distance_score(value, w, h) | scores.lighting_score(value * 3) | scores.centering_score(k * 6.4, value * 4, w, h) | scores.focus_status(value * 2, k)
    )
    return df.withColumns({"detected": F.col("event_type") != "error"} | columns)


def _told(df: DataFrame, *columns: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select("event_id", *[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


@query(f"WITH {EV} SELECT event_id, round({DISTANCE}, 6) AS distance_score, {DISTANCE_STATUS} AS distance_status, {DISTANCE_TEXT} AS distance_feedback FROM ev")
def distance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(frames(spark, sf_dir), "distance_score", "distance_status", "distance_feedback")


@query(f"WITH {EV} SELECT event_id, round({LIGHTING}, 6) AS lighting_score, {LIGHTING_STATUS} AS lighting_status, {LIGHTING_TEXT} AS lighting_feedback FROM ev")
def lighting_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(frames(spark, sf_dir), "lighting_score", "lighting_status", "lighting_feedback")


@query(f"WITH {EV} SELECT event_id, round({EXACT_RATIO}, 6) AS centering_ratio, round({EXACT_CENTERING}, 6) AS centering_score, {EXACT_STATUS} AS centering_status FROM ev")
def centering_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(frames(spark, sf_dir), "centering_ratio", "centering_score", "centering_status")


@query(f"WITH {EV} SELECT event_id, round(CASE WHEN k < 16 THEN 0 ELSE value * 2 END, 6) AS focus_score, {FOCUS_STATUS} AS focus_status, {FOCUS_TEXT} AS focus_feedback FROM ev")
def focus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(frames(spark, sf_dir), "focus_score", "focus_status", "focus_feedback")


@query(f"""WITH {EV} SELECT event_id, round(CASE WHEN {SEEN} THEN {DISTANCE} ELSE 0 END, 6) AS distance_score, CASE WHEN {SEEN} THEN {DISTANCE_STATUS} ELSE 'fail' END AS distance_status,
  CASE WHEN {SEEN} THEN {DISTANCE_TEXT} ELSE 'No face detected' END AS distance_feedback, round(CASE WHEN {SEEN} THEN {RATIO} ELSE 1 END, 6) AS centering_ratio FROM ev""")
def no_detection_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frames(spark, sf_dir)
    names = ("distance_score", "distance_status", "distance_feedback", "centering_ratio")
    return _told(df.withColumns(scores.no_detection_row(F.col("detected"), {n: F.col(n) for n in names})), *names)


@query(f"""WITH {EV}, gated AS (SELECT *, {SEEN} AND ({DISTANCE}) >= 60 AND ({LIGHTING}) >= 50 AND {EXACT_CENTERING} >= 35 AND CASE WHEN k < 16 THEN 0 ELSE value * 2 END >= 80 AS gate FROM ev)
  SELECT event_id, gate, CASE WHEN NOT {SEEN} THEN 'red' WHEN gate THEN 'green' ELSE 'yellow' END AS light FROM gated""")
def score_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = scores.score_gate(F.col("detected"), F.col("distance_score"), F.col("lighting_score"), F.col("centering_score"), F.col("focus_score"))
    df = frames(spark, sf_dir).withColumn("gate", gate)
    return df.select("event_id", "gate", scores.traffic_light(F.col("detected"), F.col("gate")).alias("light"))


_STATUSES = f"parts AS (SELECT *, {DISTANCE_STATUS} AS ds, {DISTANCE_TEXT} AS df, {CENTERING_STATUS} AS cs, {LIGHTING_STATUS} AS ls, {LIGHTING_TEXT} AS lf, {FOCUS_STATUS} AS fs, {FOCUS_TEXT} AS ff, {SEEN} AS seen FROM ev)"


@query(f"""WITH {EV}, {_STATUSES.replace(CENTERING_STATUS, EXACT_STATUS)}
  SELECT event_id,
    CASE WHEN NOT seen THEN 'Align one eye in the circle' WHEN k < 5 THEN 'Hold steady...' WHEN fs = 'fail' THEN 'Image is blurry — hold still to focus' WHEN fs = 'warn' THEN 'Almost sharp — keep still...'
      WHEN k % 7 = 0 THEN 'Perfect focus. Hold still...' WHEN k % 2 = 0 AND k % 5 = 0 THEN 'Aim light at hairline — tilt phone back' WHEN ds = 'fail' THEN df WHEN cs = 'fail' THEN 'Center your eye in the circle'
      WHEN ls = 'fail' THEN 'Move to better lighting' WHEN ds = 'ok' AND cs = 'ok' AND ls = 'ok' AND k % 3 > 0 THEN 'Perfect. Hold still...' WHEN k % 3 = 0 THEN 'Hold still... ' || (k % 4) ELSE 'Almost there...' END AS live,
    CASE WHEN NOT seen THEN 'Position your eye in frame' WHEN ds = 'fail' THEN df WHEN cs = 'fail' THEN 'Center' WHEN ls = 'fail' THEN lf WHEN fs = 'fail' THEN ff WHEN ds = 'warn' THEN df WHEN cs = 'warn' THEN 'Center'
      WHEN ls = 'warn' THEN lf WHEN fs = 'warn' THEN ff WHEN k % 5 BETWEEN 1 AND 2 THEN 'Hold steady... ' || (3 - k % 5) || 's' ELSE 'Perfect! Hold steady...' END AS report
  FROM parts""")
def feedback_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, k = frames(spark, sf_dir), F.col("k")
    live = scores.live_guidance(
        F.col("detected"), k >= 5, F.col("focus_status"), k % 7 != 0, k % 2 == 0, k % 5 != 0, F.col("distance_status"), F.col("distance_feedback"),
        F.col("centering_status"), F.col("lighting_status"), F.when(k % 3 == 0, k % 4),
    )
    parts = {f"{n}_{p}": F.col(f"{n}_{p}") for n in ("distance", "lighting", "focus") for p in ("status", "feedback")}
    parts |= {"centering_status": F.col("centering_status"), "centering_feedback": F.lit("Center")}
    return df.select("event_id", live.alias("live"), scores.report_feedback(F.col("detected"), k % 5, **parts).alias("report"))


@query(f"""WITH {EV}, told AS (SELECT event_id, value, CASE WHEN k % 2 = 0 THEN 'eyebrowsRaised' WHEN k % 3 = 0 THEN 'phoneAngleOk' WHEN k % 5 = 0 THEN 'distanceOk' WHEN k % 11 = 0 THEN 'eyeCentered'
    WHEN k % 13 = 0 THEN 'lightingAdequate' WHEN k % 7 = 0 THEN 'focusSharp' WHEN NOT {SEEN} THEN 'faceDetected' END AS condition FROM ev)
  SELECT event_id, condition, CASE condition WHEN 'eyebrowsRaised' THEN 'Raise Your Eyebrows' WHEN 'phoneAngleOk' THEN 'Aim Light at Hairline'
    WHEN 'distanceOk' THEN CASE WHEN value > 60 THEN 'Move Back' WHEN value > 40 THEN 'Perfect Distance' ELSE 'Move Closer' END WHEN 'eyeCentered' THEN 'Center Your Eye'
    WHEN 'lightingAdequate' THEN CASE WHEN value > 60 THEN 'Too Much Light' WHEN value > 40 THEN 'Good Lighting' ELSE 'More Light Needed' END WHEN 'focusSharp' THEN 'Tap to Focus'
    WHEN 'faceDetected' THEN 'Position Your Face' ELSE 'Hold Still' END AS message FROM told""")
def condition_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, value = F.col("k"), F.col("value")
    tests = (
        ("faceDetected", F.col("event_type") == "error"), ("focusSharp", k % 7 == 0), ("lightingAdequate", k % 13 == 0), ("eyeCentered", k % 11 == 0),
        ("distanceOk", k % 5 == 0), ("phoneAngleOk", k % 3 == 0), ("eyebrowsRaised", k % 2 == 0),
    )
    failed = F.array_compact(F.array(*[F.when(broken, name) for name, broken in tests]))
    df = events(spark, sf_dir).withColumn("condition", scores.condition_priority(failed))
    near = F.col("condition") == "distanceOk"
    variant = F.when(value > 60, F.when(near, "tooClose").otherwise("tooBright")).when(value > 40, "perfect").otherwise(F.when(near, "tooFar").otherwise("dark"))
    return df.select("event_id", "condition", scores.guidance(F.col("condition"), variant).alias("message"))


@query(f"""WITH {EV}, {_STATUSES} SELECT event_id, seen AND k >= 5 AND fs = 'ok' AND k % 7 <> 0 AND ds = 'ok' AND ls <> 'fail' AND k % 3 <> 1 AS ready FROM parts""")
def ready_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    angle = F.when(k % 3 == 0, "optimal").when(k % 3 == 1, "too_flat").otherwise("unavailable")
    ready = scores.ready_predicate(F.col("detected"), k >= 5, F.col("focus_status"), k % 7 != 0, F.col("distance_status"), F.col("lighting_status"), angle)
    return frames(spark, sf_dir).select("event_id", ready.alias("ready"))


POINTS = "pts AS (SELECT vec_id, list_transform(range(32), lambda i: {'x': 0.5 + CAST(embedding[2 * i + 1] AS DOUBLE), 'y': 0.5 + CAST(embedding[2 * i + 2] AS DOUBLE)}) AS p FROM embeddings)"


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as 32 points around a frame's centre."""
    at = lambda i: 0.5 + F.get("embedding", i).cast("double")
    df = load(spark, sf_dir, "embeddings").filter("embedding is not null")
    return df.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y"))).alias("landmarks"))


def _frame():
    return F.lit(640.0), F.lit(480.0)


def irises(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = landmarks(spark, sf_dir).withColumn("pixels", geometry.landmark_to_pixels(F.col("landmarks"), *_frame()))
    df = df.withColumn("points", geometry.iris_points(F.col("pixels"), 10))
    return df.withColumn("iris", geometry.iris_geometry(F.col("points"), *_frame()))


@query(f"WITH {POINTS} SELECT vec_id, i AS point, round(p[i + 1].x * 640, 5) AS x, round(p[i + 1].y * 480, 5) AS y FROM pts, unnest(range(32)) AS u(i)")
def landmark_to_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = landmarks(spark, sf_dir).select("vec_id", F.posexplode(geometry.landmark_to_pixels(F.col("landmarks"), *_frame())).alias("point", "p"))
    return df.select("vec_id", F.col("point").cast("long").alias("point"), F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


IRIS = f"""{POINTS}, raw AS (SELECT vec_id, p, p[11].x * 640 AS cx, p[11].y * 480 AS cy, greatest(abs(p[13].y - p[12].y) * 480, abs(p[15].x - p[14].x) * 640) AS extent FROM pts),
  iris AS (SELECT *, greatest(480 * 0.008, least(480 * 0.12, extent)) AS diameter, cx BETWEEN 0 AND 640 AND cy >= 0 AND cy <= 480 * 0.7 AS seen FROM raw)"""


@query(f"WITH {IRIS} SELECT vec_id, CASE WHEN seen THEN round(cx, 5) END AS x, CASE WHEN seen THEN round(cy, 5) END AS y, CASE WHEN seen THEN round(diameter, 5) END AS diameter FROM iris")
def iris_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return irises(spark, sf_dir).select("vec_id", *[F.round(f"iris.{c}", 5).alias(c) for c in ("x", "y", "diameter")])


@query(f"""WITH {POINTS}, xy AS (SELECT vec_id, list_transform(p, lambda q: q.x * 640) AS xs, list_transform(p, lambda q: q.y * 480) AS ys FROM pts)
  SELECT vec_id, round(list_min(xs), 5) AS x, round(list_min(ys), 5) AS y, round(list_max(xs) - list_min(xs), 5) AS width, round(list_max(ys) - list_min(ys), 5) AS height FROM xy""")
def face_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = irises(spark, sf_dir).withColumn("b", geometry.face_bounds(F.col("pixels")))
    return df.select("vec_id", *[F.round(f"b.{c}", 5).alias(c) for c in ("x", "y", "width", "height")])


CROP = f"""{IRIS}, five AS (SELECT *, list_transform(p[11:15], lambda q: q.x * 640) AS xs, list_transform(p[11:15], lambda q: q.y * 480) AS ys FROM iris WHERE seen),
  boxes AS (SELECT *, greatest(32.0, greatest(list_max(xs) - list_min(xs), list_max(ys) - list_min(ys)) * 2.4, diameter * 2.4) AS size,
    list_min(xs) + (list_max(xs) - list_min(xs)) / 2 AS mx, list_min(ys) + (list_max(ys) - list_min(ys)) / 2 AS my FROM five),
  placed AS (SELECT *, greatest(0.0, floor(mx - size / 2)) AS bx, greatest(0.0, floor(my - size / 2)) AS by_ FROM boxes),
  crop AS (SELECT vec_id, cx, cy, diameter, CASE WHEN bx + size > 640 THEN greatest(0.0, 640 - size) ELSE bx END AS x, CASE WHEN by_ + size > 480 THEN greatest(0.0, 480 - size) ELSE by_ END AS y, CAST(floor(size) AS BIGINT) AS size FROM placed)"""


@query(f"WITH {CROP} SELECT vec_id, round(x, 4) AS x, round(y, 4) AS y, size FROM crop")
def crop_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = irises(spark, sf_dir).withColumn("box", geometry.crop_box(F.col("points"), F.col("iris"), *_frame())).filter("box is not null")
    return df.select("vec_id", F.round("box.x", 4).alias("x"), F.round("box.y", 4).alias("y"), F.col("box.size").alias("size"))


@query(f"""WITH {CROP}, sized AS (SELECT *, greatest(64e0, size * 3e0) AS s, greatest(0e0, x * 3) AS nx, greatest(0e0, y * 3) AS ny FROM crop),
  cut AS (SELECT *, CASE WHEN nx + s > 1920 THEN greatest(0.0, 1920 - s) ELSE nx END AS l, CASE WHEN ny + s > 1440 THEN greatest(0.0, 1440 - s) ELSE ny END AS t FROM sized),
  inside AS (SELECT *, s - (cx * 3 - l) AS ix, cy * 3 - t AS iy FROM cut),
  fine AS (SELECT *, ix > s * 0.05 AND ix < s * 0.95 AND iy > s * 0.05 AND iy < s * 0.95 AS ok FROM inside)
  SELECT vec_id, round(l, 4) AS crop_x, round(t, 4) AS crop_y, round(s, 4) AS crop_size, CASE WHEN ok THEN round(ix, 4) END AS iris_x, CASE WHEN ok THEN round(iy, 4) END AS iris_y,
         CASE WHEN ok THEN round(diameter * 3 * 1.6 / 2, 4) END AS radius FROM fine""")
def map_to_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = irises(spark, sf_dir).withColumn("box", geometry.crop_box(F.col("points"), F.col("iris"), *_frame())).filter("box is not null")
    three = F.lit(3.0)
    native = geometry.map_to_native(F.col("iris.x"), F.col("iris.y"), F.col("iris.diameter"), F.col("box"), three, three, F.lit(1920.0), F.lit(1440.0))
    names = ("crop_x", "crop_y", "crop_size", "iris_x", "iris_y", "radius")
    return df.withColumn("n", native).select("vec_id", *[F.round(f"n.{c}", 4).alias(c) for c in names])


def _centroid_model():
    """A deterministic stand-in for a segmentation model: cuts around the hint, and scores by
    the cut's contrast."""

    def run(image: np.ndarray, hint: tuple[int, int]) -> tuple[np.ndarray, float, np.ndarray]:
        if image.mean() > 160:
            raise ValueError("no candidate in bounds")
        x, y = hint
        cut = image[max(0, y - 2) : y + 2, max(0, x - 2) : x + 2]
        return cut, float(cut.std() / 128), (cut > 128).astype(np.uint8)

    return run


def _doubling_model():
    return lambda image: np.repeat(np.repeat(image, 4, axis=0), 4, axis=1)


@query("""WITH px AS (SELECT vec_id, list_transform(embedding, lambda x: least(255, greatest(0, CAST(floor(128 + 200 * x) AS INTEGER)))) AS p FROM embeddings WHERE embedding IS NOT NULL),
  cut AS (SELECT vec_id, list_avg(p) > 160 AS bad, list_transform(list_filter(range(64), lambda i: i % 8 BETWEEN 2 AND 5 AND i // 8 BETWEEN 2 AND 5), lambda i: p[i + 1]) AS c FROM px)
  SELECT CAST(vec_id AS VARCHAR) AS item_id, NOT bad AS success, CASE WHEN bad THEN 'no candidate in bounds' END AS error, CASE WHEN NOT bad THEN '4x4' END AS original_size,
         CASE WHEN NOT bad THEN '16x16' END AS upscaled_size, CASE WHEN NOT bad THEN round(sqrt(list_avg(list_transform(c, lambda x: x * x)) - pow(list_avg(c), 2)) / 128, 6) END AS quality_score,
         CASE WHEN NOT bad THEN 16 END AS intermediate_bytes, CASE WHEN NOT bad THEN len(list_filter(c, lambda x: x > 128)) END AS mask_pixels FROM cut""")
def score_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 gray images through demonstration models, with the first stage's
    picture and mask; times are left out."""
    df = load(spark, sf_dir, "embeddings").filter("embedding is not null")
    pixel = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 200 * x))))
    data = F.unhex(F.array_join(F.transform(pixel, lambda p: F.lpad(F.hex(p), 2, "0")), ""))
    rows = df.select(
        F.col("vec_id").cast("string").alias("item_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("n_channels"), data.alias("data"),
        F.lit(None).cast("double").alias("hint_x"), F.lit(None).cast("double").alias("hint_y"),
    )
    out = two_stage(rows, _centroid_model, _doubling_model, return_mask=True, return_intermediate=True)
    size = lambda c: F.when(F.col(c).isNotNull(), F.array_join(c, "x")).alias(c)
    return out.select(
        "item_id", "success", "error", size("original_size"), size("upscaled_size"), F.round("quality_score", 6).alias("quality_score"),
        F.octet_length("intermediate").cast("long").alias("intermediate_bytes"), F.length(F.replace(F.hex("mask"), F.lit("0"), F.lit(""))).cast("long").alias("mask_pixels"),
    )
