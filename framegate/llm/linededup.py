"""Line dedup: range-partitioned line hashes, first occurrences, per-document bitmaps.

DataFrame functions only. Texts are read twice and shuffled once, to meet their bitmap;
between the two only hashes and positions travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framegate.llm.common import BLANKS, ascii_lower, free_name, partitions, written

MIN_CHARS = 10
LAST = (1 << 63) - 1


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by (did, th): the id (null: after all others) and a hash of the text, so rows
    that share an id but not a text keep apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("did"),
        F.xxhash64(text).alias("th"),
        text.alias("body"),
        *[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)],
    )


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(did, th, dropped) of each document that loses lines: a bitmap, one bit a line, set
    where the line goes, as a map from the number of a 64-bit word to the word. Words without
    a lost line are left out, so a long document that loses little has a short map.

    A line's key stands as 128 bits of hash. Hashes are range-partitioned and sorted by
    document and position, and the first document of each is streamed over its rows. Hashes
    with more than a quarter of a partition's rows (so at most four a partition: a
    bounded table) are found by a partial count and take their first document from a
    broadcast of that table instead, where their rows are; so no task holds a hot line.
    """
    spark = docs.sparkSession
    rows = _identified(docs, id_col, text_col).select("did", "th", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    keyed = rows.select("did", "th", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    lines = written(
        keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "did", "th", "pos"), "lines"
    )
    n = partitions(spark)
    limit = max(1000, lines.count() // (4 * n))
    hot = written(
        lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("did").alias("first")).filter(F.col("n") > limit),
        "hot-lines",
    ).select("h1", "h2", "first")  # fewer than 4 n rows, by the limit
    cold = lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti").repartitionByRange(n, "h1", "h2")
    seen = Window.partitionBy("h1", "h2").orderBy("did", "th", "pos")
    cold = cold.withColumn("first", F.first("did").over(seen))
    gone = cold.unionByName(lines.join(F.broadcast(hot), ["h1", "h2"])).filter("did <> first")
    words = (
        gone.select("did", "th", F.expr("cast(pos div 64 as int)").alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit"))
        .repartition(n, "did", "th")
        .groupBy("did", "th", "word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    return words.groupBy("did", "th").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def _deduped(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """docs' columns as in_0, in_1, ... with kept, n_lines and n_dropped."""
    base = _identified(docs, id_col, text_col)
    maps = drop_bitmaps(docs, id_col, text_col, min_chars)
    dense = F.expr("transform(sequence(0, array_max(map_keys(dropped))), w -> coalesce(dropped[w], 0L))")
    maps = maps.select("did", "th", dense.alias("dropped"))
    kept = F.expr(
        "array_join(filter(split(body, '\\n'), (x, i) -> coalesce(shiftright(get(dropped, cast(i div 64 as int)), i % 64) & 1L, 0L) = 0L), '\\n')"
    )
    return base.join(maps, ["did", "th"], "left").select(
        *[F.col(f"in_{i}") for i in range(len(docs.columns))],
        F.when(F.col("dropped").isNull(), F.col("body")).otherwise(kept).alias("kept"),
        F.size(F.split("body", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.expr("aggregate(dropped, 0L, (s, w) -> s + bit_count(w))"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with kept_text, n_lines (before) and n_dropped.

    Lines are split at \\n; keys are stripped of blanks at both ends, with A-Z lower-cased.
    Keys of min_chars or more that at least two ids hold stay only in the least of these,
    with all their repeats there. A null or empty text is one empty line. Rows with null
    ids count as one document after all others. Repeated rows are treated alike. A column of
    docs with the name of a result stays, and the result's name gets _ after it. An empty
    table gives no rows; a very long text is one row of its task, never cut.
    """
    found = _deduped(docs, id_col, text_col, min_chars)
    results = [F.col(c).alias(free_name(name, docs)) for c, name in (("kept", "kept_text"), ("n_lines", "n_lines"), ("n_dropped", "n_dropped"))]
    return found.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)], *results)


def fresh_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the same columns: the text without its lost lines (see dedup_lines), and in
    size_col, if there is one, the number of its characters."""
    found = _deduped(docs, id_col, text_col, min_chars)
    new = {text_col: F.col("kept"), size_col: F.length("kept").cast("long")}
    return found.select(*[new.get(c, F.col(f"in_{i}")).alias(c) for i, c in enumerate(docs.columns)])
