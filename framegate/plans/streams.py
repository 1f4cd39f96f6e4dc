"""Streaming twins over events, run to the end of what the source holds.

A stream tells only what its watermark has closed: LATE before the last event here. The
DuckDB twins hold the batch result up to the same time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegate.plans import aggregates, policy, sequence
from framegate.plans.base import DAY_US, EV, HOUR_US, query
from framegate.presets import STAGES
from framegate.sources import captures, results
from framegate.sources.tables import load, micros, shared_folder
from framegate.streaming import stateful, windows

LATE = "1 hour"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: States that the keys of a stream share: one batch here brings rows of all of them.
GROUPS = 1024
#: The last millisecond that the watermark has passed.
MARK = f"mark AS (SELECT max(us) // 1000 - {HOUR_US // 1000} AS ms FROM ev)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream, ts with a time zone, us and k as in the batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema = load(spark, sf_dir, "events").schema
    df = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    df = df.withColumn("us", micros(df))
    return df.withColumns({"ts": F.timestamp_micros("us"), "k": F.get_json_object("props", "$.k").cast("long")})


def _keyed(df: DataFrame, key, *columns) -> DataFrame:
    return df.withWatermark("ts", LATE).select(key.alias("key"), "us", F.col("event_id").alias("id"), "ts", *columns)


def _ordered(rows: DataFrame, processor: stateful.Ordered, key_type: str = "long") -> DataFrame:
    return stateful.run_ordered(rows, processor, key_type, groups=GROUPS)


@query(f"""WITH {EV}, {MARK}, per AS (SELECT us // {DAY_US} * {DAY_US} AS window_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY ALL)
  SELECT window_us, event_type, n, total FROM per, mark WHERE (window_us + {DAY_US}) // 1000 <= ms""")
def stream_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.stream_telemetry(_events(spark, sf_dir), "ts", "event_type", "value", "1 day", late=LATE)
    out = windows.drained(out.select(F.unix_micros("start").alias("window_us"), "event_type", "n", "total"), shared_folder(spark))
    return out.withColumn("total", F.round("total", 4))


@query(f"""WITH {EV}, {MARK},
  starts AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > {6 * HOUR_US}, true) AS fresh FROM ev),
  numbered AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS s FROM starts),
  per AS (SELECT user_id, count(*) AS frames, min(us) AS first_us, max(us) AS last_us, max(value) AS best FROM numbered GROUP BY user_id, s)
  SELECT user_id, frames, first_us, last_us, best FROM per, mark WHERE (last_us + {6 * HOUR_US}) // 1000 <= ms""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.stream_sessions(_events(spark, sf_dir), "ts", "user_id", "value", "6 hours", LATE)
    told = out.select("user_id", "frames", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "best")
    return windows.drained(told, shared_folder(spark))


@query(f"WITH {sequence.BANDED}, {MARK} SELECT user_id AS key, event_id AS id, CASE WHEN on_ THEN 'pass' ELSE 'fail' END AS state FROM banded, mark WHERE us // 1000 < ms")
def stream_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keyed(_events(spark, sf_dir), F.col("user_id"), "value")
    return windows.drained(_ordered(rows, stateful.Hysteresis(sequence.BAND)), shared_folder(spark))


@query(f"""WITH {EV}, {MARK}, told AS (SELECT event_type || '/' || user_id AS key, event_id AS id, us, {policy.ADMITTED} AS admitted FROM ev)
  SELECT key, id, admitted FROM told, mark WHERE us // 1000 < ms""")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("/", "event_type", F.col("user_id").cast("string"))
    rows = _keyed(_events(spark, sf_dir), key)
    return windows.drained(_ordered(rows, stateful.RateLimit(2, DAY_US), "string"), shared_folder(spark))


@query(f"WITH {sequence.STAGED}, {MARK} SELECT user_id AS key, event_id AS id, {sequence.NAMES}[stage_number] AS stage FROM staged, mark WHERE us // 1000 < ms")
def stream_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _events(spark, sf_dir)
    rows = _keyed(
        df, F.col("user_id"), F.col("value").alias("iris_diameter"), (F.col("event_type") != "error").alias("is_raised"), (F.col("k") / 100).alias("centering_ratio"),
        F.col("value").alias("sharpness"), (F.col("value") * 2).alias("brightness"), F.lit(None).cast("string").alias("return_to"),
    )
    return windows.drained(_ordered(rows, stateful.Stages(sequence.RULES)), shared_folder(spark))


@query(f"WITH RECURSIVE {sequence.REGRESSED}, {MARK} SELECT user_id AS key, event_id AS id, {sequence.NAMES}[stage + 1] AS stage FROM walked, mark WHERE n > 0 AND us // 1000 < ms")
def stream_stage_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_stages in which a signup sends its session back, as in stage_regression."""
    df = _events(spark, sf_dir)
    back = F.when(F.col("event_type") == "signup", F.when(F.col("event_id") % 2 == 0, STAGES[0]).otherwise(STAGES[2]))
    rows = _keyed(
        df, F.col("user_id"), F.col("value").alias("iris_diameter"), (F.col("event_type") != "error").alias("is_raised"), (F.col("k") / 100).alias("centering_ratio"),
        F.col("value").alias("sharpness"), (F.col("value") * 2).alias("brightness"), back.alias("return_to"),
    )
    return windows.drained(_ordered(rows, stateful.Stages(sequence.RULES)), shared_folder(spark))


@query(f"""WITH {sequence.NOT_ERROR}, {MARK},
  seen AS (SELECT isles.* FROM isles, mark WHERE us // 1000 < ms),
  runs AS (SELECT *, CASE WHEN on_ THEN row_number() OVER (PARTITION BY user_id, isle, on_ ORDER BY us, event_id) ELSE 0 END AS run, max(us) OVER (PARTITION BY user_id) AS last_us,
                  first_value(CASE WHEN NOT on_ THEN us END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS bad_us FROM seen),
  tries AS (SELECT user_id, us AS started_us, CASE WHEN bad_us < us + {DAY_US} THEN 'aborted' WHEN last_us >= us + {DAY_US} THEN 'captured' ELSE 'open' END AS outcome, bad_us FROM runs WHERE run = 5),
  told AS (SELECT *, min(CASE WHEN outcome = 'captured' THEN started_us END) OVER (PARTITION BY user_id) AS won FROM tries)
  SELECT user_id AS key, started_us, outcome, CASE outcome WHEN 'aborted' THEN bad_us ELSE started_us + {DAY_US} END AS ended_us FROM told WHERE outcome <> 'open' AND (won IS NULL OR started_us <= won)""")
def stream_countdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keyed(_events(spark, sf_dir), F.col("user_id"), (F.col("event_type") != "error").alias("good"))
    return windows.drained(_ordered(rows, stateful.Countdown(5, DAY_US)), shared_folder(spark))


@query(f"""WITH RECURSIVE {sequence.ARMED}, {MARK}
  SELECT user_id AS key, started_us, told AS outcome, ended_us, best_sharpness FROM walked, mark WHERE told IS NOT NULL AND us // 1000 < ms""")
def stream_countdown_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts with their bursts; what the stream's end leaves open is not told."""
    rows = _keyed(_events(spark, sf_dir), F.col("user_id"), (F.col("event_type") != "error").alias("good"), F.col("value").alias("sharpness"))
    return windows.drained(_ordered(rows, stateful.BurstCountdown(**sequence.BURST)), shared_folder(spark))


@query(f"WITH RECURSIVE {sequence.GAPPED}, {MARK} SELECT user_id AS key, us, event_id AS id FROM kept, mark WHERE keep AND us // 1000 < ms")
def stream_min_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keyed(_events(spark, sf_dir), F.col("user_id"))
    return windows.drained(_ordered(rows, stateful.GapSampler(6 * HOUR_US)), shared_folder(spark))


@query(f"WITH RECURSIVE {sequence.SPOKEN}, {MARK} SELECT user_id AS key, us, event_id AS id, event_type AS text FROM said, mark WHERE keep AND us // 1000 < ms")
def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keyed(_events(spark, sf_dir), F.col("user_id"), F.col("event_type").alias("text"))
    return windows.drained(_ordered(rows, stateful.Throttle(4 * HOUR_US, 12 * HOUR_US)), shared_folder(spark))


@query(f"WITH {aggregates.RESET}, {MARK} SELECT user_id, window_us, n, n_so_far, total_so_far FROM added, mark WHERE (window_us + {DAY_US}) // 1000 <= ms")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """telemetry_since_reset of the windows that the watermark has closed."""
    rows = windows.windowed(_events(spark, sf_dir), "ts", "user_id", "value", "1 day", F.col("event_type") == "error", LATE)
    out = windows.drained(_ordered(rows, stateful.RunningTotals()), shared_folder(spark))
    return out.withColumnRenamed("key", "user_id").withColumn("total_so_far", F.round("total_so_far", 4))


@query(f"""WITH {EV}, mark AS (SELECT least((SELECT max(us) FROM ev WHERE event_type = 'view'), (SELECT max(us) FROM ev WHERE event_type = 'click')) // 1000 - {HOUR_US // 1000} AS ms)
  SELECT v.user_id AS key, v.event_id AS id, c.value AS reading FROM (SELECT ev.* FROM ev, mark WHERE event_type = 'view' AND us // 1000 < ms) v
  ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'click') c ON v.user_id = c.user_id AND v.us >= c.us""")
def stream_angle_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """angle_asof on two streams, up to the lesser of their watermarks."""
    views, clicks = (_events(spark, sf_dir).filter(F.col("event_type") == kind) for kind in ("view", "click"))
    frames, readings = (df.select(F.col("user_id").alias("key"), "us", F.col("event_id").alias("id"), "value", "ts") for df in (views, clicks))
    return windows.drained(_ordered(windows.stream_asof(frames, readings, LATE), stateful.LatestReading()), shared_folder(spark))


@query(f"WITH {EV} SELECT event_id, sha256(CAST(event_id AS VARCHAR) || chr(31) || user_id) AS result_key, us // {DAY_US} AS day FROM ev")
def stream_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a stream go to a table; the stream runs again from its beginning, as after a
    lost checkpoint, and a second writer brings the same rows: every key is there once."""
    folder = f"{shared_folder(spark)}/stream-results-{uuid.uuid4().hex}"
    rows = _events(spark, sf_dir).select("event_id", captures.result_key(F.col("event_id"), F.col("user_id")).alias("result_key"), F.expr(f"us div {DAY_US}").alias("day"))
    table = results.ResultTable(spark, f"{folder}/table", "result_key", "day")
    for run, writer in enumerate(("a", "a", "b")):
        table.drain(rows, writer, f"{folder}/state-{run}")
    return table.read()


@query(f"""WITH {policy.STORED}, told AS (SELECT event_id, us, {policy.FOUND} AS found FROM asked LEFT JOIN stored USING (user_id)),
  mark AS (SELECT least((SELECT max(us) FROM asked), (SELECT max(created_us) FROM stored)) // 1000 - {HOUR_US // 1000} AS ms)
  SELECT event_id, found FROM told, mark WHERE found OR us // 1000 < ms""")
def stream_ttl_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and whether each found its token; the store's first rows stream in beside
    them. A miss is told when the slower stream's watermark has passed it."""
    asked = _events(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    first = policy.stored(spark, sf_dir).withColumnRenamed("user_id", "owner")
    ev = _events(spark, sf_dir).filter("event_type = 'signup'").select("user_id", "ts", "us")
    held = ev.join(first, (ev.user_id == first.owner) & (ev.us == first.created_us), "left_semi").drop("us")
    out = windows.stream_ttl_lookup(asked, held, "user_id", f"{policy.WEEK_S} seconds", LATE)
    return windows.drained(out.select("event_id", "found"), shared_folder(spark))


@query(f"WITH {EV} SELECT DISTINCT user_id, event_type, us // {DAY_US} AS day FROM ev")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user, type and day. Copies lie within a day of the first, so a
    watermark of a day misses none and lets go of older keys."""
    df = _events(spark, sf_dir).withColumn("day", F.expr(f"us div {DAY_US}"))
    df = windows.stream_dedup(df, "ts", ["user_id", "event_type", "day"], "1 day")
    return windows.drained(df.select("user_id", "event_type", "day"), shared_folder(spark))
