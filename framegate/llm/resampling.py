"""Importance resampling towards a target: hashed n-grams, bucket gains, Gumbel top-k.

A scan collapses separators to single spaces and then lets a regular expression find, at
every word (overlapped), the runs of words that begin there. Each run's CRC-32 is its bucket.
Buckets of all documents and of all target texts are counted; a bucket's gain is the log of
how much commoner it is in the target. Documents with the highest sums of mean gain and Gumbel
noise are drawn, which samples without replacement by weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegate.llm.common import bounded_batches, long_array, partitions, written

BUCKETS = 10_000
MAX_N = 2
MIN_WORDS = 20
DRAW_PERCENT = 25
SEED = 7
SEPARATORS = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs_of_words(max_n: int) -> regex.Pattern:
    """At the blank before a word: the word, then as many of the next ones, each with the
    blank before it, as there are up to max_n; a blank must follow. Run overlapped, each word
    is found with those behind it."""
    more = b""
    for _ in range(max_n - 1):
        more = rb"(?:( [^ ]++)" + more + rb")?+"
    return regex.compile(rb" ([^ ]++)" + more + rb"(?= )")


def collapsed(text: bytes) -> bytes:
    """A-Z lower-cased, separators as single spaces, one also at either end."""
    return SEPARATORS.sub(b" ", b" " + text.lower() + b" ")


def scan(text: bytes, pattern: regex.Pattern) -> list[int]:
    """CRC-32 of every run of 1 to max_n words. A longer run's goes on from the shorter one's."""
    out: list[int] = []
    add = out.append
    for found in pattern.finditer(collapsed(text), overlapped=True):
        first, *rest = found.groups()
        crc = crc32(first)
        add(crc)
        for part in rest:
            if part is None:
                break
            crc = crc32(part, crc)
            add(crc)
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, max_n: int = MAX_N) -> DataFrame:
    """(id, n_words, n_features, bucket array, times array) of each row: how often its runs of
    1 to max_n words fall in each bucket that they meet. A null text has none."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("bucket", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = runs_of_words(max_n)
        for batch in batches:
            n_words, n_features, bucket, times, at = [], [], [], [], [0]
            for text in batch.column(1):
                crcs = scan(text.as_py() or b"", pattern)
                met, often = np.unique(np.array(crcs, np.uint32) % buckets, return_counts=True)
                n_words.append(_words(len(crcs), max_n))
                n_features.append(len(crcs))
                bucket.append(met.astype(np.int32))
                times.append(often.astype(np.int32))
                at.append(at[-1] + len(met))
            offsets = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.zeros(0, np.int32))) for x in (bucket, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), *lists], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, n_words long, n_features long, bucket array<int>, times array<int>")


def _words(n: int, max_n: int) -> int:
    """How many words have n runs of 1 to max_n words."""
    words = 0
    while n > 0 and words < max_n:  # the k-th word adds min(k, max_n) runs
        words += 1
        n -= words
    return words + max(n, 0) // max_n


def bucket_counts(found: DataFrame) -> DataFrame:
    """(bucket, n) over all rows of features(): at most one row a bucket."""
    return found.select(F.inline(F.arrays_zip("bucket", "times"))).groupBy("bucket").agg(F.sum("times").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """A bucket's floor(1000 ln of its smoothed share of the target's features over that of
    the corpus'). The two tables of counts have at most one row a bucket, which bounds what the
    driver takes."""
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").fillna(0, ["s", "t"])
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for row in both.collect():
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    share = (t + 1.0) * float(s.sum() + buckets) / ((s + 1.0) * float(t.sum() + buckets))
    return np.floor(1000 * np.log(share)).astype(np.int64).tolist()


def _weigher(gain: list[int]):
    @F.arrow_udf("long")
    def weight(bucket: pa.Array, times: pa.Array) -> pa.Array:
        """The floored mean of the gains of a row's features."""
        worth, at = np.array(gain, np.int64), bucket.offsets.to_numpy()
        often = times.flatten().to_numpy().astype(np.int64)
        total = np.concatenate(([0], np.cumsum(worth[bucket.flatten().to_numpy()] * often)))
        n = np.concatenate(([0], np.cumsum(often)))
        low, high = at[:-1] - at[0], at[1:] - at[0]
        return pa.array((total[high] - total[low]) // np.maximum(n[high] - n[low], 1))

    return weight


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 x a Gumbel variate) that hangs on the seed and the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with nth, counted from 1 in the order over the whole table. Rows are dealt by
    ranges of the order and counted a range; the driver sees one number a range, and no task
    all rows."""
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("at", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = {row["p"]: row["count"] for row in placed.groupBy(part.alias("p")).count().collect()}
    ahead = np.cumsum([0, *(counts.get(p, 0) for p in range(max(counts, default=0)))]).tolist()
    return placed.withColumn("nth", within + F.get(long_array(ahead), part) + 1).drop("at")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = DRAW_PERCENT,
    min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, max_n: int = MAX_N,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of docs; rank is null where the row
    is not drawn.

    Words are what lies between bytes that are neither letters, digits nor beyond ASCII; A-Z
    count as a-z. Of the rows with min_words words or more, percent of a hundred are drawn
    (rounded down), by score, ties to the smaller id, a null one last. A null or empty text has
    no features, weight 0, and is never drawn. Rows that share an id have the same noise and
    are drawn each. With an empty target all gains follow from the corpus alone; an empty docs
    gives no rows. Texts of any length are scanned whole; other columns are ignored. Counts go
    over all rows; the driver takes one row a bucket and one a partition.
    """
    found = written(features(docs, id_col, text_col, buckets, max_n), "features")
    wanted = features(target.select(F.lit(None).cast("long").alias("id"), F.col(f"`{target_text}`").alias("text")), "id", "text", buckets, max_n)
    gain = gains(bucket_counts(found), bucket_counts(wanted), buckets)
    weight = _weigher(gain)(F.col("bucket"), F.col("times"))
    scored = written(
        found.select("id", "n_features", weight.alias("weight"), (F.col("n_words") >= min_words).alias("fit")).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)),
        "scored",
    )
    most = scored.filter("fit").count() * percent // 100
    # Rows alike in all of these are alike in what is returned.
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features")]
    rank = F.when(F.col("fit") & (F.col("nth") <= most), F.col("nth"))
    return ranked(scored, order).select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))
