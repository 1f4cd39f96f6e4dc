"""The best row of a group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegate.presets import BURST_MIN_SHARPNESS, CANDIDATE_IDEAL, CANDIDATE_RATIO, Band


def burst_best(df: DataFrame, key: str, idx: str, sharpness: str, least: float = BURST_MIN_SHARPNESS) -> DataFrame:
    """The sharpest row of each burst, the first of equals; bursts below least are left out.
    A partial aggregate: a burst of any length is no sort."""
    known = df.filter(F.col(sharpness).isNotNull() & ~F.isnan(sharpness))
    best = known.groupBy(key).agg(F.max(F.struct(F.col(sharpness).alias("s"), (-F.col(idx)).alias("i"))).alias("b"))
    return best.filter(F.col("b.s") >= least).select(key, (-F.col("b.i")).alias("best_idx"), F.col("b.s").alias("best_sharpness"))


def nearest_in_bounds(df: DataFrame, item: str, idx: str, area: str, total: str, score: str, bounds: Band = CANDIDATE_RATIO, ideal: float = CANDIDATE_IDEAL) -> DataFrame:
    """Each item's candidate whose share of the total lies in bounds and is nearest to the
    ideal, the first of equals, with its score and the diameter of a disc of its area. An
    item without one gets an error."""
    ratio = F.col(area) / F.col(total)
    fine = ratio.between(bounds.low, bounds.high)
    pick = F.min(F.when(fine, F.struct(F.abs(ratio - ideal).alias("off"), F.col(idx).alias("i"), F.col(score).alias("s"), F.col(area).alias("a"))))
    best = df.groupBy(item).agg(pick.alias("b"))
    return best.select(
        item, F.col("b.i").alias("cand_idx"), F.col("b.s").alias("score"), F.sqrt(F.col("b.a") * 4 / F.lit(math.pi)).alias("diameter"),
        F.when(F.col("b").isNull(), "no candidate in bounds").alias("error"),
    )
