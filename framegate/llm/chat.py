"""Chat formatting with cumulative-snapshot collapse.

A logged conversation whose turns begin a longer one is a snapshot of it. Each turn's
rolling prefix hash says what was said up to it; a conversation goes if its last prefix hash
appears, at the same length, inside another. Of equal conversations the least id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNNAMED = (1 << 63) - 1


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, place (from 1), role, text, p1, p2: 80 bits over all turns up to this one.
    Turns go by number, equal numbers by role and text. The roll is a running sum of hashes
    of (place, role, text), so it depends on the order; 40-bit terms, so that the sum of
    eight million turns still fits a long."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    said = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(UNNAMED)).alias("conv"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("place", F.row_number().over(order))
    for name, seed in (("p1", 1), ("p2", 2)):
        term = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "place", "role", "text"), 24)
        said = said.withColumn(name, F.sum(term).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return said


def maximal(turns: DataFrame) -> DataFrame:
    """The turns of maximal conversations, with conv, place and n_turns.

    A null role or text counts as an empty one. Rows with a null conv_id form one
    conversation, whose id comes after all others. Repeated turns are turns of their own. An
    empty table gives no rows; other columns are ignored. Only hashes are joined.
    """
    said = prefixes(turns).withColumn("n_turns", F.max("place").over(Window.partitionBy("conv")))
    whole = said.filter("place = n_turns").groupBy("place", "p1", "p2").agg(F.min("conv").alias("conv"))
    inner = said.filter("place < n_turns").select("place", "p1", "p2").distinct()
    kept = whole.join(inner, ["place", "p1", "p2"], "left_anti").select("conv")
    return said.join(kept, "conv", "left_semi")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered: each maximal conversation as one text, in order. Cases as in
    maximal(). Names of other columns cannot clash. Very long texts are rendered whole; a
    conversation is one row in the end, so all its texts meet in one task."""
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    told = maximal(turns).groupBy("conv").agg(
        F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines")
    )
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return told.select(F.nullif("conv", F.lit(UNNAMED)).alias("conv_id"), "n_turns", text.alias("rendered"))
