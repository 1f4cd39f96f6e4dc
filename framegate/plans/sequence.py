"""Sequence operators over events: a user is a session, an event a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegate.operators import countdown, sampling, stages, windows
from framegate.plans.base import EV, HOUR_US, query
from framegate.presets import STAGE_TOLD, STAGES, Band, StageRules
from framegate.sources.tables import events

KEY, ORDER = ["user_id"], ["us", "event_id"]
BAND = Band(20.0, 80.0, 10.0)
ANGLE = Band(25.0, 50.0, 5.0)
HOLD_US = 6 * HOUR_US
RULES = StageRules(reference_height=500.0, diameter=Band(0.04, 0.2, 0.02), hold_us=12 * HOUR_US, raised_frames=3, centering_max=0.6, centering_margin=0.05, sharpness_min=8.0, brightness=Band(20.0, 300.0, 10.0))

W = "PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BANDED = f"""{EV},
  banded AS (
    SELECT *, coalesce(last_value(CASE WHEN value BETWEEN 20 AND 80 THEN true WHEN value NOT BETWEEN 10 AND 90 THEN false END IGNORE NULLS) OVER ({W}), false) AS on_
    FROM ev)"""
HELD = f"""{BANDED},
  isles AS (SELECT *, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER ({W}) AS isle FROM banded),
  timed AS (SELECT *, CASE WHEN on_ THEN us - min(us) OVER (PARTITION BY user_id, isle, on_) END AS took FROM isles)"""
NOT_ERROR = f"""{EV},
  isles AS (SELECT *, event_type <> 'error' AS on_, sum(CASE WHEN event_type <> 'error' THEN 0 ELSE 1 END) OVER ({W}) AS isle FROM ev)"""


@query(f"WITH {BANDED} SELECT event_id, CASE WHEN on_ THEN 'pass' ELSE 'fail' END AS state FROM banded")
def hysteresis_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.hysteresis_band(events(spark, sf_dir), KEY, ORDER, F.col("value"), BAND).select("event_id", "state")


@query(f"""WITH {EV},
  carried AS (SELECT *, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER ({W}) AS v FROM ev),
  banded AS (SELECT *, coalesce(last_value(CASE WHEN v BETWEEN 25 AND 50 THEN true WHEN v NOT BETWEEN 20 AND 55 THEN false END IGNORE NULLS) OVER ({W}), false) AS on_ FROM carried)
  SELECT event_id, CASE WHEN v IS NULL THEN 'unavailable' WHEN on_ THEN 'optimal' WHEN v < 25 THEN 'too_flat' ELSE 'too_steep' END AS angle_state FROM banded""")
def hysteresis_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    reading = F.when(F.col("event_type") != "error", F.col("value"))
    return windows.hysteresis_tristate(events(spark, sf_dir), KEY, ORDER, reading, ANGLE).select("event_id", "angle_state")


@query(f"""WITH {HELD}
  SELECT event_id, coalesce(took >= {HOLD_US}, false) AS held, CASE WHEN took IS NULL THEN 0.0 ELSE round(least(100.0, took * 100.0 / {HOLD_US}), 6) END AS progress FROM timed""")
def hold_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.hysteresis_band(events(spark, sf_dir), KEY, ORDER, F.col("value"), BAND)
    df = windows.hold_for(df, KEY, ORDER, F.col("state") == "pass", "us", HOLD_US)
    return df.select("event_id", "held", F.round("held_progress", 6).alias("progress"))


@query(f"""WITH {NOT_ERROR}
  SELECT event_id, CASE WHEN on_ THEN row_number() OVER (PARTITION BY user_id, isle, on_ ORDER BY us, event_id) ELSE 0 END AS run FROM isles""")
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.run_length(events(spark, sf_dir), KEY, ORDER, F.col("event_type") != "error").select("event_id", "run")


@query(f"""WITH {EV},
  segs AS (SELECT *, event_type = 'error' AS r, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER ({W}) AS seg FROM ev)
  SELECT event_id, CASE WHEN NOT r THEN round(avg(value) OVER (PARTITION BY user_id, seg, r ORDER BY us, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) END AS sma FROM segs""")
def sma_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.sma_reset(events(spark, sf_dir), KEY, ORDER, F.col("value"), 5, F.col("event_type") == "error")
    return df.select("event_id", F.round("sma", 6).alias("sma"))


@query(f"""WITH {NOT_ERROR},
  steps AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id), 0) AS step FROM isles)
  SELECT event_id, CAST(CASE WHEN on_ THEN sum(step) OVER (PARTITION BY user_id, isle, on_ ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END AS BIGINT) AS gathered_us FROM steps""")
def accumulate_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.accumulate_while(events(spark, sf_dir), KEY, ORDER, F.col("event_type") != "error", "us").select("event_id", "gathered_us")


def stage_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "user_id", "event_id", "us", "event_type", F.col("value").alias("iris_diameter"), (F.col("event_type") != "error").alias("is_raised"),
        (F.col("k") / 100).alias("centering_ratio"), F.col("value").alias("sharpness"), (F.col("value") * 2).alias("brightness"),
    )


STAGED = f"""{EV},
  s1 AS (SELECT *, coalesce(last_value(CASE WHEN value / 500 BETWEEN 0.04 AND 0.2 THEN true WHEN value / 500 NOT BETWEEN 0.02 AND 0.22 THEN false END IGNORE NULLS) OVER ({W}), false) AS near_ FROM ev),
  s1i AS (SELECT *, sum(CASE WHEN near_ THEN 0 ELSE 1 END) OVER ({W}) AS isle FROM s1),
  s1h AS (SELECT *, near_ AND us - min(us) OVER (PARTITION BY user_id, isle, near_) >= {RULES.hold_us} AS held FROM s1i),
  t1 AS (SELECT user_id, us AS us1, event_id AS id1 FROM s1h WHERE held QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) = 1),
  s2 AS (SELECT ev.*, event_type <> 'error' AS raised FROM ev JOIN t1 USING (user_id) WHERE (us, event_id) > (us1, id1)),
  s2i AS (SELECT *, sum(CASE WHEN raised THEN 0 ELSE 1 END) OVER ({W}) AS isle FROM s2),
  s2r AS (SELECT *, CASE WHEN raised THEN row_number() OVER (PARTITION BY user_id, isle, raised ORDER BY us, event_id) ELSE 0 END AS run FROM s2i),
  t2 AS (SELECT user_id, us AS us2, event_id AS id2 FROM s2r WHERE run >= 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) = 1),
  s3 AS (SELECT ev.*, value >= 8 AND k / 100 <= 0.6 AND value * 2 BETWEEN 20 AND 300 AS strict, value >= 8 AND k / 100 <= 0.65 AND value * 2 BETWEEN 10 AND 310 AS wide FROM ev JOIN t2 USING (user_id) WHERE (us, event_id) > (us2, id2)),
  s3l AS (SELECT *, coalesce(last_value(CASE WHEN strict THEN true WHEN NOT wide THEN false END IGNORE NULLS) OVER ({W}), false) AS fine FROM s3),
  s3i AS (SELECT *, sum(CASE WHEN fine THEN 0 ELSE 1 END) OVER ({W}) AS isle FROM s3l),
  s3h AS (SELECT *, fine AND us - min(us) OVER (PARTITION BY user_id, isle, fine) >= {RULES.hold_us} AS held FROM s3i),
  t3 AS (SELECT user_id, us AS us3, event_id AS id3 FROM s3h WHERE held QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) = 1),
  staged AS (
    SELECT ev.*, us1, us2, us3, 1 + CAST(coalesce((us, event_id) >= (us1, id1), false) AS INT) + CAST(coalesce((us, event_id) >= (us2, id2), false) AS INT) + CAST(coalesce((us, event_id) >= (us3, id3), false) AS INT) AS stage_number
    FROM ev LEFT JOIN t1 USING (user_id) LEFT JOIN t2 USING (user_id) LEFT JOIN t3 USING (user_id))"""
NAMES = "['distance', 'eyebrows', 'final_checks', 'ready']"


@query(f"WITH {STAGED} SELECT event_id, stage_number, {NAMES}[stage_number] AS stage FROM staged")
def stage_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.stage_progression(stage_inputs(spark, sf_dir), KEY, "us", "event_id", RULES).select("event_id", "stage_number", "stage")


STAGE_W = "PARTITION BY user_id, stage_number ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
THIRD_W = "PARTITION BY user_id, counts3 ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_TOLD = [f"'{text}'" for name in ("distance", "eyebrows", "final_checks") for text in STAGE_TOLD[name]]


@query(f"""WITH {STAGED},
  r1 AS (SELECT staged.*, coalesce(run, 0) AS raised_run, stage_number = 3 AND us2 <> us AS counts3,
           coalesce(last_value(CASE WHEN value / 500 BETWEEN 0.04 AND 0.2 THEN true WHEN value / 500 NOT BETWEEN 0.02 AND 0.22 THEN false END IGNORE NULLS) OVER ({STAGE_W}), false) AND stage_number = 1 AS near_
         FROM staged LEFT JOIN (SELECT event_id, run FROM s2r) USING (event_id)),
  r2 AS (SELECT * REPLACE (coalesce(counts3, false) AS counts3), sum(CASE WHEN near_ THEN 0 ELSE 1 END) OVER ({STAGE_W}) AS isle1 FROM r1),
  r3 AS (SELECT *, CASE WHEN near_ THEN least(100.0, (us - min(us) OVER (PARTITION BY user_id, stage_number, isle1, near_)) * 100.0 / {RULES.hold_us}) ELSE 0.0 END AS p1,
           coalesce(last_value(CASE WHEN value >= 8 AND k / 100 <= 0.6 AND value * 2 BETWEEN 20 AND 300 THEN true WHEN NOT (value >= 8 AND k / 100 <= 0.65 AND value * 2 BETWEEN 10 AND 310) THEN false END IGNORE NULLS) OVER ({THIRD_W}), false) AND counts3 AS fine
         FROM r2),
  r4 AS (SELECT *, sum(CASE WHEN fine THEN 0 ELSE 1 END) OVER ({THIRD_W}) AS isle3 FROM r3),
  r5 AS (SELECT *, CASE WHEN fine THEN least(100.0, (us - min(us) OVER (PARTITION BY user_id, counts3, isle3, fine)) * 100.0 / {RULES.hold_us}) ELSE 0.0 END AS p3, raised_run AS raised_count FROM r4),
  told AS (SELECT event_id, {NAMES}[stage_number] AS stage, stage_number, CASE stage_number WHEN 1 THEN p1 WHEN 2 THEN least(100.0, raised_count * 100.0 / 3) WHEN 3 THEN p3 ELSE 100.0 END AS progress,
      CASE stage_number WHEN 1 THEN CASE WHEN value / 500 < 0.04 THEN {_TOLD[0]} WHEN value / 500 > 0.2 THEN {_TOLD[1]} ELSE {_TOLD[2]} END
        WHEN 2 THEN CASE WHEN event_type = 'error' THEN {_TOLD[3]} WHEN raised_count < 1.5 THEN {_TOLD[4]} ELSE {_TOLD[5]} END
        WHEN 3 THEN CASE WHEN k / 100 > 0.6 THEN {_TOLD[6]} WHEN value < 8 THEN {_TOLD[7]} WHEN value * 2 < 20 THEN {_TOLD[8]} ELSE {_TOLD[9]} END
        ELSE '{STAGE_TOLD["ready"]}' END AS message FROM r5)
  SELECT event_id, stage, stage_number, round(progress, 6) AS progress, message, progress >= 100 AS can_advance FROM told""")
def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.stage_report(stage_inputs(spark, sf_dir), KEY, "us", "event_id", RULES).select("event_id", *stages.REPORT).withColumn("progress", F.round("progress", 6))


@query(f"""WITH {STAGED},
  per AS (SELECT user_id, user_id % 3 AS grp, min(us) AS began, max(stage_number) AS reached, max(us1) AS d1, max(us2) AS d2, max(us3) AS d3 FROM staged GROUP BY user_id),
  long AS (SELECT grp, reached, n AS stage_number, CASE n WHEN 2 THEN d1 - began WHEN 3 THEN d2 - d1 WHEN 4 THEN d3 - d2 END AS took FROM per, unnest([1, 2, 3, 4]) AS u(n)),
  told AS (
    SELECT coalesce(CAST(grp AS VARCHAR), 'all') AS grp, stage_number, {NAMES}[stage_number] AS stage, count(*) FILTER (WHERE reached >= stage_number) AS sessions,
           count(*) FILTER (WHERE reached < stage_number) AS lost, round(avg(took) / 1e6, 3) AS mean_seconds, round(quantile_disc(took, 0.5) / 1e6, 3) AS median_seconds
    FROM long GROUP BY GROUPING SETS ((grp, stage_number), (stage_number))),
  failed AS (
    SELECT stage_number, user_id % 3 AS grp, CASE stage_number WHEN 1 THEN CASE WHEN NOT coalesce(value / 500 BETWEEN 0.04 AND 0.2, false) THEN 'distance' END
      WHEN 2 THEN CASE WHEN event_type = 'error' THEN 'eyebrows' END
      WHEN 3 THEN CASE WHEN NOT coalesce(k / 100 <= 0.6, false) THEN 'centering' WHEN NOT coalesce(value >= 8, false) THEN 'focus' WHEN NOT coalesce(value * 2 BETWEEN 20 AND 300, false) THEN 'lighting' END END AS why
    FROM staged JOIN per USING (user_id) WHERE stage_number = reached AND reached < 4),
  counted AS (SELECT coalesce(CAST(grp AS VARCHAR), 'all') AS grp, stage_number, why, count(*) AS n FROM failed WHERE why IS NOT NULL GROUP BY GROUPING SETS ((grp, stage_number, why), (stage_number, why))),
  top AS (SELECT grp, stage_number, why AS top_failing FROM counted QUALIFY row_number() OVER (PARTITION BY grp, stage_number ORDER BY n DESC, why) = 1)
  SELECT told.*, top_failing FROM told LEFT JOIN top USING (grp, stage_number)""")
def stage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stages.stage_progression(stage_inputs(spark, sf_dir), KEY, "us", "event_id", RULES).withColumn("grp", F.col("user_id") % 3)
    return stages.stage_funnel(df, KEY, "us", "grp", RULES).withColumns({c: F.round(c, 3) for c in ("mean_seconds", "median_seconds")})


#: The stage rules event by event; stage counts from 0. A signup sends a session back first.
REGRESSED = f"""{EV},
  numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n, CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 0 ELSE 2 END END AS back FROM ev),
  walked AS (
    SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS us, 0 AS stage, CAST(NULL AS BIGINT) AS since1, 0 AS raised, false AS confirmed, CAST(NULL AS BIGINT) AS since3
    FROM (SELECT DISTINCT user_id FROM ev)
    UNION ALL
    SELECT user_id, n, event_id, us,
           s + CAST(CASE s WHEN 0 THEN coalesce(us - since1n >= {RULES.hold_us}, false) WHEN 1 THEN confirmedn WHEN 2 THEN coalesce(us - since3n >= {RULES.hold_us}, false) ELSE false END AS INT),
           since1n, raisedn, confirmedn, since3n
    FROM (
      SELECT *, CASE WHEN s = 0 THEN CASE WHEN near_ THEN coalesce(since1, us) END ELSE since1 END AS since1n, CASE WHEN s = 2 THEN CASE WHEN fine THEN coalesce(since3, us) END ELSE since3 END AS since3n,
             CASE WHEN s = 1 AND NOT confirmed THEN CASE WHEN up THEN raised + 1 ELSE 0 END ELSE raised END AS raisedn,
             confirmed OR (s = 1 AND up AND raised + 1 >= 3) AS confirmedn
      FROM (
        SELECT b.user_id, b.n, b.event_id, b.us, s, w.since1, w.raised, w.confirmed, w.since3, event_type <> 'error' AS up,
               coalesce(value / 500 BETWEEN 0.04 - m1 AND 0.2 + m1, false) AS near_,
               coalesce(k / 100 <= CASE WHEN w.since3 IS NULL THEN 0.6 ELSE 0.65 END AND value >= 8 AND value * 2 BETWEEN 20 - m3 AND 300 + m3, false) AS fine
        FROM (SELECT w.user_id, w.n, w.raised, w.confirmed, coalesce(b.back, w.stage) AS s, CASE WHEN b.back IS NULL THEN w.since1 END AS since1, CASE WHEN b.back IS NULL THEN w.since3 END AS since3,
                     CASE WHEN b.back IS NULL AND w.since1 IS NOT NULL THEN 0.02 ELSE 0 END AS m1, CASE WHEN b.back IS NULL AND w.since3 IS NOT NULL THEN 10 ELSE 0 END AS m3
              FROM walked w JOIN numbered b ON b.user_id = w.user_id AND b.n = w.n + 1) w
        JOIN numbered b ON b.user_id = w.user_id AND b.n = w.n + 1)))"""


@query(f"WITH RECURSIVE {REGRESSED} SELECT event_id, {NAMES}[stage + 1] AS stage FROM walked WHERE n > 0")
def stage_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signup sends its session back: to the first stage or, for odd ids, the third."""
    back = F.when(F.col("event_type") == "signup", F.when(F.col("event_id") % 2 == 0, STAGES[0]).otherwise(STAGES[2]))
    rows = stage_inputs(spark, sf_dir).withColumn("return_to", back).drop("event_type")
    return stages.stage_regression(rows, KEY, "us", "event_id", RULES).select("event_id", "stage")


@query(f"""WITH {NOT_ERROR},
  runs AS (SELECT *, CASE WHEN on_ THEN row_number() OVER (PARTITION BY user_id, isle, on_ ORDER BY us, event_id) ELSE 0 END AS run,
                  max(us) OVER (PARTITION BY user_id) AS last_us,
                  first_value(CASE WHEN NOT on_ THEN us END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS bad_us FROM isles),
  tries AS (SELECT user_id, us AS started_us, CASE WHEN bad_us < us + {24 * HOUR_US} THEN 'aborted' WHEN last_us >= us + {24 * HOUR_US} THEN 'captured' ELSE 'open' END AS outcome, bad_us FROM runs WHERE run = 5),
  told AS (SELECT user_id, started_us, outcome, CASE outcome WHEN 'aborted' THEN bad_us WHEN 'captured' THEN started_us + {24 * HOUR_US} END AS ended_us,
                  min(CASE WHEN outcome = 'captured' THEN started_us END) OVER (PARTITION BY user_id) AS won FROM tries)
  SELECT user_id, started_us, outcome, ended_us FROM told WHERE won IS NULL OR started_us <= won""")
def countdown_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countdown.countdown_trigger(events(spark, sf_dir), KEY, "us", "event_id", F.col("event_type") != "error", 5, 24 * HOUR_US)


BURST = {"frames": 3, "wait_us": 12 * HOUR_US, "burst_us": 18 * HOUR_US, "least": 120.0}
#: Attempts row by row: told is the outcome of an attempt that this row ends, due the capture
#: of the one that runs after it.
ARMED = f"""{EV},
  numbered AS (SELECT user_id, us, value AS s, event_type <> 'error' AS good, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM ev),
  walked AS (
    SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS us, 0 AS run, CAST(NULL AS BIGINT) AS due, CAST(NULL AS DOUBLE) AS best, false AS done,
           CAST(NULL AS VARCHAR) AS told, CAST(NULL AS BIGINT) AS started_us, CAST(NULL AS BIGINT) AS ended_us, CAST(NULL AS DOUBLE) AS best_sharpness
    FROM (SELECT DISTINCT user_id FROM ev)
    UNION ALL
    SELECT user_id, n, us, run2,
           CASE WHEN broke OR won THEN NULL WHEN due1 IS NULL AND good AND run2 >= {BURST["frames"]} THEN us + {BURST["wait_us"]} ELSE due1 END,
           CASE WHEN us >= due1 THEN CASE WHEN best1 IS NULL OR s > best1 THEN s ELSE best1 END ELSE best1 END, won,
           CASE WHEN won THEN 'captured' WHEN over_ THEN 'rejected' WHEN broke THEN 'aborted' END, CASE WHEN over_ OR broke THEN due - {BURST["wait_us"]} END,
           CASE WHEN won THEN due WHEN over_ THEN due + {BURST["burst_us"]} WHEN broke THEN us END, CASE WHEN over_ THEN best END
    FROM (
      SELECT *, over_ AND coalesce(best >= {BURST["least"]}, false) AS won, coalesce(us < due1 AND NOT good, false) AS broke
      FROM (
        SELECT *, CASE WHEN NOT over_ THEN due END AS due1, CASE WHEN NOT over_ THEN best END AS best1
        FROM (SELECT b.*, w.due, w.best, CASE WHEN b.good THEN w.run + 1 ELSE 0 END AS run2, coalesce(b.us >= w.due + {BURST["burst_us"]}, false) AS over_
              FROM walked w JOIN numbered b ON b.user_id = w.user_id AND b.n = w.n + 1 WHERE NOT w.done))))"""


@query(f"""WITH RECURSIVE {ARMED}
  SELECT user_id, started_us, told AS outcome, ended_us, best_sharpness FROM walked WHERE told IS NOT NULL
  UNION ALL SELECT user_id, due - {BURST["wait_us"]}, 'open', NULL, NULL FROM walked WHERE due IS NOT NULL AND (user_id, n) IN (SELECT user_id, max(n) FROM numbered GROUP BY user_id)""")
def countdown_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countdowns whose capture is rejected where its burst is blurry, after which the session is
    armed again."""
    return countdown.countdown_bursts(events(spark, sf_dir), KEY, "us", "event_id", F.col("event_type") != "error", F.col("value"), **BURST)


@query(f"""WITH {EV}
  SELECT v.event_id, c.value AS beta FROM (SELECT * FROM ev WHERE event_type = 'view') v
  ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'click') c ON v.user_id = c.user_id AND v.us >= c.us""")
def angle_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    frames, readings = ev.filter("event_type = 'view'"), ev.filter("event_type = 'click'")
    return windows.asof(frames, readings, KEY, "us", "event_id", "value", "beta").select("event_id", "beta")


GAPPED = f"""{EV},
  numbered AS (SELECT user_id, us, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM ev),
  kept AS (
    SELECT user_id, us, event_id, n, us AS last_us, true AS keep FROM numbered WHERE n = 1
    UNION ALL
    SELECT b.user_id, b.us, b.event_id, b.n, CASE WHEN b.us - k.last_us >= {6 * HOUR_US} THEN b.us ELSE k.last_us END, b.us - k.last_us >= {6 * HOUR_US}
    FROM kept k JOIN numbered b ON b.user_id = k.user_id AND b.n = k.n + 1)"""


@query(f"WITH RECURSIVE {GAPPED} SELECT user_id, us, event_id FROM kept WHERE keep")
def min_gap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.min_gap_sample(events(spark, sf_dir), "user_id", "us", "event_id", 6 * HOUR_US)


SPOKEN = f"""{EV},
  numbered AS (SELECT user_id, us, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM ev),
  said AS (
    SELECT user_id, us, event_id, event_type, n, us AS last_us, event_type AS last_text, true AS keep FROM numbered WHERE n = 1
    UNION ALL
    SELECT user_id, us, event_id, event_type, n, CASE WHEN ok THEN us ELSE last_us END, CASE WHEN ok THEN event_type ELSE last_text END, ok
    FROM (SELECT b.*, s.last_us, s.last_text, b.us - s.last_us >= {4 * HOUR_US} AND (b.event_type <> s.last_text OR b.us - s.last_us >= {12 * HOUR_US}) AS ok
          FROM said s JOIN numbered b ON b.user_id = s.user_id AND b.n = s.n + 1))"""


@query(f"WITH RECURSIVE {SPOKEN} SELECT user_id, us, event_id, event_type FROM said WHERE keep")
def throttle_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.throttle_repeats(events(spark, sf_dir), "user_id", "us", "event_id", "event_type", 4 * HOUR_US, 12 * HOUR_US)
