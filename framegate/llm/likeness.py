"""Exact links between texts by the Jaccard likeness of their sets of five-word shingles.

Two sets of likeness 4/5 or more share a shingle among the first n - ceil(4n/5) + 1 of each,
in any order that is one for all sets (prefix filter), so no such pair is missed. Shingles
that are common in a sample come last in that order, which keeps the groups that share a
shingle small; a poor sample costs time, never a link. Sizes and places rule out most of the
other pairs, and so do bitmaps: bit b of a set's is the parity of its shingles in class b, so
two bitmaps differ in no more bits than their sets in shingles. A bitmap has two to four bits
a shingle, so that it tells long sets apart as well as short ones; folding its halves gives
the bitmap of half the size. What is left is compared shingle by shingle.

Only connections are needed. So each member of a group is first tried beside its next in two
orders, and beside the group's hub, the member that shares most with others (what a group of
near copies was made from); then only pairs whose members are not connected yet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegate.llm.common import written
from framegate.llm.textvec import U64, chunks, mix, shingles

WIDTH = 5
SAMPLE = 20_000
COMMON, MOST_COMMON = 5, 50_000
BLOCK = 512
#: Least and most bits of a bitmap, powers of two.
BITS = 512, 1 << 20


def shingle_sets(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(name, sorted distinct shingles) of each text; the name tells sets apart."""
    for part in chunks([len(t) for t in texts]):
        h, owner = shingles(texts[part], WIDTH)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        cuts = np.searchsorted(owner, np.arange(part.stop - part.start + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s = np.unique(h[a:b])
            name = mix(np.bitwise_xor.reduce(mix(s), keepdims=True) + s.sum(dtype=U64, keepdims=True) * U64(3))
            yield int(name.view(np.int64)[0]), s


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in COMMON or more rows of a sample of docs(t), sorted, and their counts.
    They only order the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            found = [s for _, s in shingle_sets(texts)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    every = max(1, docs.count() // SAMPLE)
    picked = docs.select("t").filter(F.pmod(F.xxhash64("t"), F.lit(every)) == 0)
    counts = picked.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    top = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    h, n = (top.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    order = np.argsort(h.view(U64))
    return h.view(U64)[order], n[order]


def prefix(s: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of which a set of likeness 4/5 holds one, from rare to common."""
    if not len(s):
        return s
    known, counts = common
    weight = np.zeros(len(s), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        weight = np.where(known[at] == s, counts[at], 0)
    return s[np.lexsort((s, weight))[: len(s) - (4 * len(s) + 4) // 5 + 1]]


def bitmap(s: np.ndarray) -> np.ndarray:
    """The parities of a set's shingles by class, as signed longs."""
    bits = min(BITS[1], max(BITS[0], 1 << (2 * len(s) - 1).bit_length()))
    odd = np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _likely(root: np.ndarray, n: np.ndarray, pos: np.ndarray, node: np.ndarray, ties: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for order in (np.lexsort((node, n)), np.argsort(node)):
        yield order[:-1], order[1:]
    others = np.lexsort((node, -ties))
    yield np.repeat(others[:1], len(node) - 1), others[1:]


def _all(root: np.ndarray, n: np.ndarray, pos: np.ndarray, node: np.ndarray, ties: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each pair once, some rows at a time."""
    for i in range(0, len(node), BLOCK):
        a, b = np.nonzero(root[i : i + BLOCK, None] != root[None, i:])
        later = a < b
        yield a[later] + i, b[later] + i


def _groups(batches: Iterator[pa.RecordBatch], most: Callable) -> Iterator[pa.RecordBatch]:
    """most(rows of one key) for rows sorted by their first column, the key."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = [np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols
        whole = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on
        yield from most([c[:whole] for c in cols])
        held = [c[whole:] for c in cols]
    if held:
        yield from most(held)


def _split(cols: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The groups of two rows or more that are not all of one root."""
    k = cols[0]
    if not len(k):
        return
    start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    stop = np.append(start[1:], len(k))
    root = cols[4]
    mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
    for a, b in zip(start[mixed], stop[mixed], strict=True):
        yield [c[a:b] for c in cols]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def most(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = list(_split(cols))
        if found:
            size = np.concatenate([np.full(len(g[0]), len(g[0])) for g in found])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.concatenate([g[i] for g in found])) for i in range(4)), pa.array(size)], ["key", "node", "n", "pos", "size"]
            )

    yield from _groups(batches, most)


def _pairs(choose: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def most(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for _, node, n, pos, root, ties in _split(cols):
                for a, b in choose(root, n, pos, node, ties):
                    low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                    overlap = np.minimum(n[a] - pos[a], n[b] - pos[b])
                    ok = (root[a] != root[b]) & (5 * low >= 4 * high) & (9 * overlap >= 4 * (low + high))
                    a, b = node[a[ok]], node[b[ok]]
                    held.append(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1))
                    size += len(a)
                    if size > 200_000:
                        yield out(held)
                        held, size = [], 0
            if size:
                yield out(held)

        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            both = np.unique(np.concatenate(held), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, i].copy()) for i in (0, 1)], ["a", "b"])

        yield from _groups(batches, most)

    return run


def shared_groups(sets: DataFrame, parts: int) -> DataFrame:
    """(key, node, n, pos, size): where a prefix shingle is that sets of several roots hold.
    sets(node, n, prefix, root)."""
    keyed = sets.select("node", "n", "root", F.posexplode("prefix").alias("pos", "key"))
    rows = keyed.select("key", "node", F.col("n").cast("long"), F.col("pos").cast("long"), "root")
    rows = rows.repartition(parts, "key").sortWithinPartitions("key")
    return written(rows.mapInArrow(_shared, "key long, node long, n long, pos long, size long"), "likeness-groups")


def alike(groups: DataFrame, roots: DataFrame, sets: DataFrame, docs: DataFrame, parts: int, every_pair: bool) -> DataFrame:
    """(a, b): sets of groups that are alike by 4/5 and lie under different roots(node, root).
    sets(node, th, n, bits) holds one hash of a text for each set, docs(t, th) the texts."""
    ties = groups.groupBy("node").agg(F.sum("size").alias("ties"))
    known = written(ties.join(roots, "node"), "likeness-ties")
    rows = groups.join(known, "node").select("key", "node", "n", "pos", "root", "ties")
    rows = rows.repartition(parts, "key").sortWithinPartitions("key")
    pairs = rows.mapInArrow(_pairs(_all if every_pair else _likely), "a long, b long").distinct()
    for c in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")), c)
    # Sizes within 4/5 of each other: bitmaps are as long, or one is twice as long.
    for c, other in ("ab", "ba"):
        half = f"cast(size(bits_{c}) / 2 as int)"
        folded = F.expr(f"zip_with(slice(bits_{c}, 1, {half}), slice(bits_{c}, {half} + 1, {half}), (x, y) -> x ^ y)")
        pairs = pairs.withColumn(f"bits_{c}", F.when(F.size(f"bits_{c}") > F.size(f"bits_{other}"), folded).otherwise(F.col(f"bits_{c}")))
    differ = F.expr("aggregate(zip_with(bits_a, bits_b, (x, y) -> bit_count(x ^ y)), 0, (m, x) -> m + x)")
    pairs = written(pairs.filter(9 * differ <= F.col("n_a") + F.col("n_b")).select("a", "b"), "likeness-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            for part in chunks([len(t) for t in texts]):
                found = list(shingle_sets(texts[part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in found], pa.int64()), pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))],
                    ["node", "s"],
                )

    # Written, so that Spark knows its size, and moves the texts only where it is large.
    th = written(sets.join(wanted, "node", "left_semi").select("th"), "likeness-texts")
    whole = docs.join(th, "th", "left_semi").select("t").mapInArrow(run, "node long, s array<long>")
    whole = written(whole.dropDuplicates(["node"]), "likeness-sets")
    left, right = (whole.select(F.col("node").alias(c), F.col("s").alias(f"s_{c}")) for c in "ab")
    both = F.size(F.array_intersect("s_a", "s_b"))
    met = pairs.join(left, "a").join(right, "b")
    return written(met.filter(9 * both >= 4 * (F.size("s_a") + F.size("s_b"))).select("a", "b"), "likeness-links")
