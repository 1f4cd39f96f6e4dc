"""Counters, timings, candidates and rasters."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framegate.operators import candidates, raster, telemetry
from framegate.plans.base import DAY_US, EV, query
from framegate.presets import Band
from framegate.sources import images
from framegate.sources.tables import events, load, shared_folder

TYPES = ("click", "view", "purchase", "signup", "error")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in TYPES) + " FROM events GROUP BY user_id")
def condition_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.condition_failures(events(spark, sf_dir), "user_id", "event_type", TYPES)


@query("""SELECT reason, coalesce(n, 0) AS n FROM (SELECT unnest(['error', 'signup', 'idle', 'other']) AS reason)
  LEFT JOIN (SELECT CASE WHEN event_type IN ('error', 'signup', 'idle') THEN event_type ELSE 'other' END AS reason, count(*) AS n FROM events GROUP BY 1) USING (reason)""")
def abort_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.abort_reasons(events(spark, sf_dir), "event_type", ("error", "signup", "idle", "other"))


@query("SELECT user_id, round(coalesce(sum(value), 0), 4) AS total, count(value) AS n, coalesce(max(value), 0) AS longest, round(coalesce(avg(value), 0), 4) AS mean FROM events GROUP BY user_id")
def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = telemetry.timing_stats(events(spark, sf_dir), "user_id", "value")
    return df.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 4)})


@query(f"""WITH {EV}, per AS (SELECT user_id, us - us % {DAY_US} AS window_us, count(*) AS n, sum(value) AS total FROM ev GROUP BY ALL)
  SELECT user_id, window_us, n, CAST(sum(n) OVER w AS BIGINT) AS n_so_far, round(sum(total) OVER w, 4) AS total_so_far FROM per
  WINDOW w AS (PARTITION BY user_id ORDER BY window_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def telemetry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = telemetry.telemetry_summary(events(spark, sf_dir), "user_id", "us", "value", DAY_US)
    return df.withColumn("total_so_far", F.round("total_so_far", 4))


#: An error resets its user's totals, with the day that it falls in.
RESET = f"""{EV}, per AS (SELECT user_id, us - us % {DAY_US} AS window_us, count(*) AS n, sum(value) AS total, max(CAST(event_type = 'error' AS INT)) AS anew FROM ev GROUP BY ALL),
  parted AS (SELECT *, sum(anew) OVER (PARTITION BY user_id ORDER BY window_us) AS since FROM per),
  added AS (SELECT user_id, window_us, n, CAST(sum(n) OVER w AS BIGINT) AS n_so_far, round(sum(total) OVER w, 4) AS total_so_far FROM parted
            WINDOW w AS (PARTITION BY user_id, since ORDER BY window_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {RESET} SELECT * FROM added")
def telemetry_since_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = telemetry.telemetry_summary(events(spark, sf_dir), "user_id", "us", "value", DAY_US, F.col("event_type") == "error")
    return df.withColumn("total_so_far", F.round("total_so_far", 4))


@query(f"""WITH RECURSIVE {EV},
  numbered AS (SELECT user_id, event_id, us, row_number() OVER w AS n, count(*) OVER w AS n_so_far, sum(value) OVER w AS total FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  told AS (
    SELECT *, us AS anchor, false AS reports FROM numbered WHERE n = 1
    UNION ALL
    SELECT b.*, CASE WHEN b.us - t.anchor >= {DAY_US} THEN b.us ELSE t.anchor END, b.us - t.anchor >= {DAY_US} FROM told t JOIN numbered b ON b.user_id = t.user_id AND b.n = t.n + 1)
  SELECT user_id, event_id, us AS reported_us, n_so_far, round(total, 4) AS total_so_far FROM told WHERE reports""")
def telemetry_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's totals with the first event at least a day after the last report."""
    df = telemetry.telemetry_reports(events(spark, sf_dir), "user_id", "us", "event_id", "value", DAY_US)
    return df.withColumn("total_so_far", F.round("total_so_far", 4))


@query(f"""WITH {EV}
  SELECT us - us % {DAY_US} AS window_us, event_type AS client, count(*) AS requests, round(avg(CASE WHEN k >= 10 THEN 1.0 ELSE 0.0 END), 6) AS success_rate,
         round(avg(value), 6) AS stage1_ms, round(avg(k), 6) AS stage2_ms, round(avg(value + k), 6) AS total_ms FROM ev GROUP BY ALL""")
def processing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = telemetry.processing_summary(events(spark, sf_dir), F.col("event_type"), "us", F.col("k") >= 10, F.col("value"), F.col("k"), DAY_US)
    return df.withColumns({c: F.round(c, 6) for c in ("success_rate", "stage1_ms", "stage2_ms", "total_ms")})


@query("""SELECT o_custkey, o_orderkey AS best_idx, o_totalprice AS best_sharpness FROM orders WHERE o_totalprice IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1 AND o_totalprice >= 140000""")
def burst_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.burst_best(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice", 140_000.0)


@query("""WITH items AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total FROM lineitem),
  fine AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_quantity / total - 0.14e0), l_linenumber, l_discount, l_quantity) AS r FROM items WHERE l_quantity / total BETWEEN 0.02 AND 0.45),
  ids AS (SELECT DISTINCT l_orderkey FROM lineitem)
  SELECT l_orderkey, l_linenumber AS cand_idx, l_discount AS score, round(sqrt(l_quantity * 4 / pi()), 6) AS diameter, CASE WHEN l_linenumber IS NULL THEN 'no candidate in bounds' END AS error
  FROM ids LEFT JOIN (SELECT * FROM fine WHERE r = 1) USING (l_orderkey)""")
def nearest_in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    items = items.withColumn("total", F.sum("l_quantity").over(Window.partitionBy("l_orderkey")))  # an order has few lines
    best = candidates.nearest_in_bounds(items, "l_orderkey", "l_linenumber", "l_quantity", "total", "l_discount", Band(0.02, 0.45), 0.14)
    return best.withColumn("diameter", F.round("diameter", 6))


GRAY = "gray AS (SELECT vec_id, label, list_transform(embedding, lambda x: 128 + 200 * CAST(x AS DOUBLE)) AS g FROM embeddings WHERE embedding IS NOT NULL)"
INNER = "list_filter(range(64), lambda i: i % 8 > 0 AND i % 8 < 7 AND i >= 8 AND i < 56)"
LAP = f"list_transform({INNER}, lambda i: g[i - 7] + g[i + 9] + g[i] + g[i + 2] - 4 * g[i + 1])"
GRAD = f"list_transform({INNER}, lambda i: sqrt(pow(g[i + 2] - g[i], 2) + pow(g[i + 9] - g[i - 7], 2)))"
VAR = "list_avg(list_transform(lap, lambda x: x * x)) - pow(list_avg(lap), 2)"


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8 x 8 gray raster."""
    df = load(spark, sf_dir, "embeddings").filter("embedding is not null")
    return df.select("vec_id", "label", F.transform("embedding", lambda x: 128 + 200 * x.cast("double")).alias("gray"))


@query(f"WITH {GRAY} SELECT vec_id, round(list_avg(list_transform(list_filter(range(64), lambda i: i % 8 >= 2 AND i % 8 < 6 AND i >= 16 AND i < 48), lambda i: g[i + 1])), 6) AS brightness FROM gray")
def raster_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.raster_brightness(rasters(spark, sf_dir), "gray", 8, 0, 0, 8, 8).select("vec_id", F.round("brightness", 6).alias("brightness"))


@query(f"WITH {GRAY}, laps AS (SELECT vec_id, {LAP} AS lap FROM gray) SELECT vec_id, round(greatest(0.0, {VAR}), 5) AS sharpness FROM laps")
def raster_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.raster_sharpness(rasters(spark, sf_dir), "gray", 8).select("vec_id", F.round("sharpness", 5).alias("sharpness"))


FOCUS = f"""{GRAY}, laps AS (SELECT vec_id, label, list_avg(g) AS m, {LAP} AS lap, {GRAD} AS grad FROM gray),
  focus AS (SELECT vec_id, label, CASE WHEN m < 30 OR m > 240 THEN 0.0 ELSE 100 * (0.7 * ({VAR}) + 3 * list_avg(grad)) / (m + 1) END AS focus FROM laps)"""


@query(f"WITH {FOCUS} SELECT vec_id, round(focus, 5) AS focus FROM focus")
def raster_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.raster_focus(rasters(spark, sf_dir), "gray", 8).select("vec_id", F.round("focus", 5).alias("focus"))


_INSIDE = "list_avg(list_transform(list_filter(range(64), lambda i: i % 8 >= 2 AND i % 8 < 6 AND i >= 16 AND i < 48), lambda i: g[i + 1]))"
_QUANTILES = (("low", 0.05), ("median", 0.5), ("high", 0.95))
_MEASURES = ("brightness", "sharpness", "focus")


@query(f"""WITH items AS (SELECT vec_id, label, list_transform(embedding, lambda x: 128 + 200 * CAST(x AS DOUBLE)) AS g FROM embeddings),
  checked AS (SELECT *, CASE WHEN g IS NULL THEN 'not an image' WHEN len(g) < 64 THEN 'too small' WHEN len(g) > 64 THEN 'too large' WHEN list_max(g) - list_min(g) < 150 THEN 'flat' END AS violation FROM items),
  laps AS (SELECT vec_id, label, list_avg(g) AS m, {_INSIDE} AS brightness, {LAP} AS lap, {GRAD} AS grad FROM checked WHERE violation IS NULL),
  told AS (SELECT label, brightness, greatest(0.0, {VAR}) AS sharpness, CASE WHEN m < 30 OR m > 240 THEN 0.0 ELSE 100 * (0.7 * ({VAR}) + 3 * list_avg(grad)) / (m + 1) END AS focus FROM laps),
  stated AS (SELECT *, CASE WHEN focus >= 9000 THEN 'ok' WHEN focus >= 6000 THEN 'warn' ELSE 'fail' END AS status,
             avg(focus) OVER (PARTITION BY label) AS middle, stddev_pop(focus) OVER (PARTITION BY label) AS spread FROM told),
  per AS (SELECT label, count(*) AS images, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'warn') AS warn, count(*) FILTER (WHERE status = 'fail') AS fail,
          count(*) FILTER (WHERE abs(focus - middle) > 2 * spread) AS outliers, {", ".join(f"round(quantile_disc({m}, {q}), 4) AS {name}_{m}" for m in _MEASURES for name, q in _QUANTILES)} FROM stated GROUP BY label),
  bad AS (SELECT label, count(*) AS invalid FROM checked WHERE violation IS NOT NULL GROUP BY label)
  SELECT per.*, coalesce(invalid, 0) AS invalid, round((fail + coalesce(invalid, 0)) / (images + coalesce(invalid, 0)), 6) AS rejected FROM per LEFT JOIN bad USING (label)""")
def image_quality_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image job by label: items are validated; good ones are measured for brightness,
    sharpness and focus; then status counts, quantiles, the share rejected, and outliers of
    focus (beyond two deviations of the label's mean)."""
    items = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: 128 + 200 * x.cast("double")).alias("gray"))
    size, flat = F.size("gray"), F.array_max("gray") - F.array_min("gray") < 150
    good, bad = images.validate_items(items, (("not an image", F.col("gray").isNull()), ("too small", size < 64), ("too large", size > 64), ("flat", flat)))
    df = raster.raster_brightness(raster.raster_sharpness(raster.raster_focus(good, "gray", 8), "gray", 8), "gray", 8, 0, 0, 8, 8).drop("gray")
    status = F.when(F.col("focus") >= 9000, "ok").when(F.col("focus") >= 6000, "warn").otherwise("fail")
    middles = df.groupBy("label").agg(F.avg("focus").alias("middle"), F.stddev_pop("focus").alias("spread"))
    met = df.join(middles.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))  # one row a label: Spark broadcasts it by its size
    df = met.withColumns({"status": status, "off": F.abs(F.col("focus") - F.col("middle")) > 2 * F.col("spread")})
    per = df.groupBy("label").agg(
        F.count("*").alias("images"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warn", "fail")], F.count_if("off").alias("outliers"),
        *[F.round(F.percentile_approx(m, q, 10_000), 4).alias(f"{name}_{m}") for m in _MEASURES for name, q in _QUANTILES],
    )
    out = per.join(bad.groupBy("label").agg(F.count("*").alias("invalid")), "label", "left").withColumn("invalid", F.coalesce("invalid", F.lit(0)))
    return out.withColumn("rejected", F.round((F.col("fail") + F.col("invalid")) / (F.col("images") + F.col("invalid")), 6))


_PX = "list_transform(range(4096), lambda i: d[i // 512 * 8 + i % 64 // 8 + 1])"
_INNER = "list_filter(range(4096), lambda i: i % 64 > 0 AND i % 64 < 63 AND i >= 64 AND i < 4032)"


@query(f"""WITH gray AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, floor(128.5 + 200 * CAST(x AS DOUBLE))))) AS d,
                CASE WHEN vec_id % 11 = 0 THEN 'not an image' WHEN vec_id % 9 = 0 THEN 'too small' END AS violation FROM embeddings WHERE embedding IS NOT NULL),
  px AS (SELECT vec_id, {_PX} AS g FROM gray WHERE violation IS NULL),
  laps AS (SELECT vec_id, list_avg(g) AS m, list_avg(list_transform(list_filter(range(4096), lambda i: i % 64 >= 16 AND i % 64 < 48 AND i >= 1024 AND i < 3072), lambda i: g[i + 1])) AS brightness,
           list_transform({_INNER}, lambda i: g[i - 63] + g[i + 65] + g[i] + g[i + 2] - 4 * g[i + 1]) AS lap,
           list_transform({_INNER}, lambda i: sqrt(pow(g[i + 2] - g[i], 2) + pow(g[i + 65] - g[i - 63], 2))) AS grad FROM px)
  SELECT vec_id, violation, round(brightness, 4) AS brightness, CASE WHEN m IS NOT NULL THEN round(greatest(0.0, {VAR}), 4) END AS sharpness,
         round(CASE WHEN m < 30 OR m > 240 THEN 0.0 ELSE 100 * (0.7 * ({VAR}) + 3 * list_avg(grad)) / (m + 1) END, 3) AS focus FROM gray LEFT JOIN laps USING (vec_id)""")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings become picture files, some broken, some small; the files are read, checked
    and measured."""
    folder = f"{shared_folder(spark)}/pictures-{uuid.uuid4().hex}"
    rows = load(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", "embedding")
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, "vec_id")  # a small table of one task becomes many files

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, files = [], []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gray = np.clip(np.floor(128.5 + 200 * np.array(v)), 0, 255).reshape(8, 8)
                side = 4 if k % 9 == 0 else 8
                body = images.gray_png(np.kron(gray, np.ones((side, side))))
                names.append(f"{k}.png")
                files.append(body[:20] if k % 11 == 0 else body)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(files, pa.binary())], ["name", "data"])

    images.write_files(rows.mapInArrow(draw, "name string, data binary"), "name", "data", folder)
    files = images.read_images(spark, folder)
    files = files.withColumn("violation", images.first_violation(images.upload_rules(F.col("length"), F.col("height"), F.col("width"))))
    out = raster.raster_metrics(files.withColumn("data", F.when(F.isnull("violation"), F.col("data"))), keep=("violation",))  # a file is read once
    name = F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long")
    return out.select(name.alias("vec_id"), "violation", *[F.round(m, d).alias(m) for m, d in (("brightness", 4), ("sharpness", 4), ("focus", 3))])
