"""All queries over the given tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegate.plans import aggregates, policy, scoring, sequence, streams  # noqa: F401  they register
from framegate.plans.base import ORACLES, QUERIES, query


@query(f"""WITH {sequence.HELD},
  holds AS (SELECT user_id, count(*) FILTER (WHERE took >= {sequence.HOLD_US}) AS held_frames FROM timed GROUP BY user_id),
  failures AS ({ORACLES['condition_failures']})
  SELECT *, held_frames > 0 AS ever_held FROM failures JOIN holds USING (user_id)""")
def session_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session: whether its measure ever held long enough, and its failures by kind."""
    held = sequence.windows.hysteresis_band(sequence.events(spark, sf_dir), sequence.KEY, sequence.ORDER, F.col("value"), sequence.BAND)
    held = sequence.windows.hold_for(held, sequence.KEY, sequence.ORDER, F.col("state") == "pass", "us", sequence.HOLD_US)
    holds = held.groupBy("user_id").agg(F.count_if("held").alias("held_frames"))
    return aggregates.condition_failures(spark, sf_dir).join(holds, "user_id").withColumn("ever_held", F.col("held_frames") > 0)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_holds(spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]
