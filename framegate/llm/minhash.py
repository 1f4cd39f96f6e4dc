"""Document fingerprints: one-permutation MinHash, densified, b-bit.

Every word shingle is hashed once. The top bits of its hash choose one of BINS bins, the
rest is its value there, and each bin keeps its least value. An empty bin j takes the value
of the first filled bin in a fixed random order of all bins that belongs to j (optimal
densification), so two texts copy from the same place whenever that place is filled in
both. Of each bin the low BITS bits are stored. Two unrelated bins agree by chance with
probability 2^-BITS; likeness() takes that out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegate.llm.common import bounded_batches, long_array, partitions
from framegate.llm.textvec import U64, chunks, shingles

WIDTH = 5
BINS = 512
BITS = 4
_EMPTY = np.iinfo(np.uint64).max
_order: list[np.ndarray] = []


def _probe_order() -> np.ndarray:
    """Row t, column j: the bin that an empty bin j tries at its attempt t."""
    if not _order:
        rng = np.random.Generator(np.random.PCG64(20_170_801))
        _order.append(np.argsort(rng.random((BINS, BINS)), axis=0))
    return _order[0]


def sketch(texts: list[bytes]) -> np.ndarray:
    """One row of BINS small numbers per text; -1 throughout for a text without words."""
    h, owner = shingles(texts, WIDTH)
    least = np.full(len(texts) * BINS, _EMPTY, U64)
    shift = 64 - BINS.bit_length() + 1
    np.minimum.at(least, owner * BINS + (h >> U64(shift)).astype(np.int64), h & U64((1 << shift) - 1))
    least = least.reshape(len(texts), BINS)
    filled = least != U64(_EMPTY)
    out = np.where(filled, (least & U64((1 << BITS) - 1)).astype(np.int16), np.int16(-1))
    doc, bin_ = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for probe in _probe_order():
        if not len(doc):
            break
        source = probe[bin_]
        hit = filled[doc, source]
        out[doc[hit], bin_[hit]] = out[doc[hit], source[hit]]
        doc, bin_ = doc[~hit], bin_[~hit]
    return out


def packed(rows: np.ndarray) -> list[str]:
    """Hex, one digit a bin. A text without words has zeros only."""
    digits = np.maximum(rows, 0).astype(np.uint8)
    text = ((digits[:, 0::2] << 4) | digits[:, 1::2]).astype(np.uint8).tobytes().hex()
    return [text[i * BINS : (i + 1) * BINS] for i in range(len(rows))]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of the shingle sets, row by row, free of chance matches.
    Two texts without words are alike (1), one without and one with words are not (0)."""
    chance = 2.0**-BITS
    raw = ((a == b).mean(axis=1) - chance) / (1 - chance)
    bare_a, bare_b = (a < 0).all(axis=1), (b < 0).all(axis=1)
    return np.where(bare_a | bare_b, (bare_a & bare_b).astype(float), np.clip(raw, 0.0, 1.0))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row; no shuffle. A null text counts as empty; a very long one
    is hashed whole, alone in its task's memory; repeated rows and null ids are rows as any;
    an empty table gives no rows; other columns are ignored."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [(t or "").encode() for t in batch.column(1).to_pylist()]
            for part in chunks([len(t) for t in texts]):
                yield pa.RecordBatch.from_arrays(
                    [ids[part.start : part.stop], pa.array(packed(sketch(texts[part])), pa.string())],
                    ["id", "fingerprint"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


def _bucket(doc_id: Column, cuts: list[int]) -> Column:
    """Number of cuts above the id (all of them for null). cuts fall. Two levels, so that
    a row is compared with about twice the root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    coarse, fine = long_array(cuts[step - 1 :: step]), long_array(cuts)
    above = F.size(F.filter(coarse, lambda c: c > doc_id)) * step
    rest = F.size(F.filter(F.slice(fine, above + 1, step), lambda c: c > doc_id))
    return F.when(doc_id.isNull(), len(cuts)).otherwise(above + rest)


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints each text and its edited text, and compares neighbours.

    The rows are taken by falling id (null last, equal ids by text). The edited text is the
    text with its last floor(n/2) code points replaced by the first as many of the next
    row's text (all of it, if shorter); after the last row comes the first.

    Rows are dealt out by ranges of the id, with the first row of each range copied to the
    range before it, so one shuffle brings each text beside its next. The ranges come from
    quantiles of the ids (one number a partition reaches the driver). Null texts are empty;
    repeated rows are kept; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    )
    wanted = partitions(spark)
    quantiles = rows.agg(
        F.percentile_approx("id", [i / wanted for i in range(1, wanted)] or [0.5], 20 * max(500, wanted))
    ).first()[0]
    cuts = sorted(set(quantiles or []), reverse=True) if wanted > 1 else []
    bucket = _bucket(F.col("id"), cuts)
    heads = {
        r["b"]: r["head"]
        for r in rows.select("id", bucket.alias("b")).groupBy("b").agg(F.max("id").alias("head")).collect()
    }
    filled = sorted(heads)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}  # the first follows the last
    n = len(cuts) + 1
    # Ids are compared null-safely: a bucket of null ids alone has a null head.
    head = F.element_at(long_array([heads[b] if heads.get(b) is not None else -(1 << 63) for b in range(n)]), F.col("b") + 1)
    bare = F.element_at(long_array([int(b in heads and heads[b] is None) for b in range(n)]), F.col("b") + 1) == 1
    is_head = F.when(bare, F.col("id").isNull()).otherwise(F.col("id").eqNullSafe(head))
    previous = F.element_at(long_array([before.get(b, 0) for b in range(n)]), F.col("b") + 1).cast("int")
    # The trailing copy of a lone table is its own first row.
    places = F.when(
        is_head,
        F.array(F.struct(F.col("b").alias("to"), F.lit(0).alias("copy")), F.struct(previous.alias("to"), F.lit(1).alias("copy"))),
    ).otherwise(F.array(F.struct(F.col("b").alias("to"), F.lit(0).alias("copy"))))
    dealt = (
        rows.withColumn("b", bucket.cast("int"))
        .withColumn("place", F.explode(places))
        .select(F.col("place.to").alias("to"), F.col("place.copy").alias("copy"), "id", "t")
        .repartitionById(n, F.col("to"))
        .sortWithinPartitions("copy", F.col("id").desc_nulls_last(), "t")
        .select("copy", "id", "t")
    )
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_edit_run, schema).withColumnRenamed("id", id_col)


def _edit_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None  # the last row, until its next one is known
    ended = False
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        if held:
            rows.insert(0, held)
            held = None
        if ended:
            continue
        for i, row in enumerate(rows):
            if row[0]:  # only the first copy is a neighbour
                rows, ended = rows[: i + 1], True
                break
        for part in chunks([2 * len(r[2]) for r in rows[:-1]]):
            yield _edited(rows[part.start : part.stop + 1])
        held = rows[-1] if rows else None
    # What is held now is the copy, or (never) a row without a next one.


def _edited(rows: list[tuple]) -> pa.RecordBatch:
    texts = [r[2] for r in rows]
    edited = []
    for text, after in zip(texts, texts[1:], strict=False):
        cut = len(text) // 2
        edited.append((text[: len(text) - cut] + after[:cut]).encode())
    own, new = sketch([t.encode() for t in texts]), sketch(edited)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[1] for r in rows[:-1]], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
            pa.array(packed(own[:-1]), pa.string()),
            pa.array(packed(new), pa.string()),
            pa.array(likeness(own[:-1], new), pa.float64()),
            pa.array(likeness(own[:-1], own[1:]), pa.float64()),
        ],
        ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
