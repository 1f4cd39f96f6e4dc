"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints link at RADIUS = 3 or fewer differing bits. The 64 bits form four blocks of 16.
Two linked fingerprints differ in some block (or are equal), and without that block they
differ in at most two bits, so the balls of radius 1 around what is left meet. Every
distinct fingerprint therefore emits, for each block, the other 48 bits and their 48
one-bit variants: 196 keys, whatever the size of the groups. Keys are shuffled, and the
fingerprints that share a key are verified.

Only connections are needed, so a group that shares a key returns a spanning forest, not
its pairs. Members of a group differ in 16 + 6 bits at most; a large group is joined through
a table of the 2^16 values of the blanked block, so its work grows with its size, not with
the square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framegate.llm import likeness
from framegate.llm.common import as_struct, bounded_batches, written
from framegate.llm.graph import stars
from framegate.llm.textvec import U64

WIDTH = 3
SEED = 42
RADIUS = 3
BLOCKS, BLOCK = 4, 16
PAIRWISE = 256


def fingerprint(text: bytes) -> int:
    """Bit i is 1 if it is set in over half the XXH64 of the shingles, repeats included."""
    words = text.lower().split()  # bytes: A-Z only, and blanks are \\x20 and \\x09-\\x0D
    if not words:
        return 0
    clean = b" ".join(words)
    width = min(WIDTH, len(words))
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - width + 1
    spans = zip(islice(starts, n), islice(starts, width, None), strict=False)
    while part := list(islice(spans, 1 << 16)):
        h = np.array([digest(clean[a : b - 1], SEED) for a, b in part], U64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row, fp as a signed long; no shuffle. A null text counts as empty."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint((t or "").encode()) for t in batch.column(1).to_pylist()], U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, fp long")


def _without(fp: np.ndarray, block: int) -> np.ndarray:
    """The 48 bits outside a block, as one number."""
    low = U64(BLOCK * block)
    below = fp & ((U64(1) << low) - U64(1))
    above = (fp >> low >> U64(BLOCK)) << low
    return above | below


def variants(fp: np.ndarray) -> np.ndarray:
    """Row by row, the keys of a fingerprint: each block, and its ball of radius 1."""
    flips = np.concatenate((np.zeros(1, U64), U64(1) << np.arange(64 - BLOCK, dtype=U64)))
    return np.concatenate(
        [((_without(fp, b) | U64(b << 48))[:, None] ^ flips) for b in range(BLOCKS)], axis=1
    )


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fps), 1000):
            part = fps[i : i + 1000]
            keys = variants(part.view(U64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, keys.shape[1]))], ["key", "fp"]
            )


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component, by labels that fall and jump."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def group_labels(key: int, fps: np.ndarray) -> np.ndarray:
    """For distinct fingerprints that share a key: the place of the first that each is
    connected with inside the group.

    A member's rest differs from the key's in no bit (it is at the middle) or in one. Equal
    blocks are linked, and so are blocks one bit apart. Two bits apart are linked if one is
    at the middle; three apart if both are. Other linked members have equal rests and meet
    at the middle of their own key."""
    if len(fps) <= PAIRWISE:
        a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= RADIUS, 1))
        return _labels(len(fps), a, b)
    block = key >> 48
    value = ((fps >> U64(BLOCK * block)) & U64((1 << BLOCK) - 1)).astype(np.int64)
    middle = _without(fps, block) == U64(key & ((1 << 48) - 1))
    there, mid = np.zeros((2, 1 << BLOCK), bool)
    there[value], mid[value[middle]] = True, True
    masks = np.arange(1 << BLOCK)
    weight = np.bitwise_count(masks)
    links = []
    for bits, left, right in ((1, there, there), (2, mid, there), (3, mid, mid)):
        at = np.flatnonzero(left)
        for m in masks[weight == bits]:
            hit = at[right[at ^ m]]
            links.append(np.stack((hit, hit ^ m)))
    a, b = np.concatenate(links, axis=1) if links else np.zeros((2, 0), int)
    of_value = _labels(1 << BLOCK, a, b)[value]
    _, first, back = np.unique(of_value, return_index=True, return_inverse=True)
    return first[back]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: linked pairs, a forest for each key."""
    held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.concatenate((held_k, batch.column(0).to_numpy(zero_copy_only=False)))
        f = np.concatenate((held_f, batch.column(1).to_numpy(zero_copy_only=False)))
        whole = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
        yield from _forest(k[:whole], f[:whole])
        held_k, held_f = k[whole:], f[whole:]
    yield from _forest(held_k, held_f)


def _forest(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(k):
        return
    start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    size = np.diff(np.append(start, len(k)))
    two = start[size == 2]
    near = two[np.bitwise_count(f[two].view(U64) ^ f[two + 1].view(U64)) <= RADIUS]
    a, b = [f[near]], [f[near + 1]]
    for i, n in zip(start[size > 2], size[size > 2], strict=True):
        fps = f[i : i + n]
        first = group_labels(int(k[i]), fps.view(U64))
        other = np.flatnonzero(first != np.arange(n))
        a.append(fps[first[other]])
        b.append(fps[other])
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a):
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, fingerprint (16 hex digits) and component_id, the least id reachable.

    Null texts count as empty: fingerprint zero, linked like any other. A row with a null id
    belongs to its component but never names it (a component of such rows alone has a null
    name). Repeated rows stay; an empty table gives no rows; other columns are ignored.
    Equal fingerprints are grouped, with partial sums, before anything else, so groups of
    copies cost one row each.
    """
    rows = written(fingerprints(docs, id_col, text_col), "simhash")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    root = stars(_ball_links(distinct, _key_partitions(docs, distinct)).distinct())
    named = distinct.join(root, distinct.fp == root.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    name_of = written(named.join(least, "root").select("fp", "component_id"), "simhash-names")
    return rows.join(name_of, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _ball_links(distinct: DataFrame, parts: int) -> DataFrame:
    """Linked pairs (a, b) of distinct(fp), a forest for each key."""
    keyed = distinct.select("fp").mapInArrow(_emit, "key long, fp long")
    return keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")


def _key_partitions(docs: DataFrame, distinct: DataFrame) -> int:
    """About a million keys a task."""
    spark = docs.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), distinct.count() * 196 // 1_000_000)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: that of the least id.

    Texts are linked by their fingerprints, as in components(), and where their sets of
    five-word shingles are alike by 4/5 (likeness.py), which no pair escapes. Rows that share
    an id but not a text may lie in different groups; each group looks at its own. In a group
    they are one document, of which the least text stays. Rows with a null id all stay. Other
    columns come along, whatever their names; an empty table stays empty. A very long text is
    read alone, never cut."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(text.alias("t"), F.xxhash64(text).alias("th"))
    rows = written(_features(docs, id_col, text_col, likeness.common_shingles(texts)), "near-rows")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "near-distinct")
    parts = _key_partitions(docs, distinct)
    sets = rows.select("node", "fp", "n", "th", "prefix", "bits").dropDuplicates(["node"])
    sets = written(sets, "near-sets")
    links = _ball_links(distinct, parts).distinct()
    # Equal sets may have several fingerprints (words repeat).
    same = rows.select("node", "fp").distinct().join(sets.select("node", F.col("fp").alias("a")), "node").select("a", F.col("fp").alias("b"))
    links = written(links.union(same.filter("a <> b")), "near-links")
    of_fp = sets.select("node", "fp")
    root = stars(links)
    roots = _roots(of_fp, root)
    groups = likeness.shared_groups(sets.join(roots, "node"), parts)
    for every_pair in (False, True):
        more = likeness.alike(groups, roots, sets, texts, parts, every_pair)
        if more.isEmpty():
            continue
        more = more.join(of_fp.select(F.col("node").alias("a"), F.col("fp").alias("fa")), "a")
        more = more.join(of_fp.select(F.col("node").alias("b"), F.col("fp").alias("fb")), "b")
        links = written(links.union(more.select(F.col("fa").alias("a"), F.col("fb").alias("b"))), "near-links")
        root = stars(links)
        roots = _roots(of_fp, root)
    named = distinct.join(root, distinct.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("least_id"))
    of = named.select("fp", "root").join(least, "root")
    keep = rows.join(of, "fp").filter(F.col("id") == F.col("least_id")).select("id", "th", "root").distinct()
    keep = keep.groupBy(F.col("id").alias("kept")).agg(F.map_from_entries(F.collect_list(F.struct("th", "root"))).alias("roots"))
    whole = docs.select(as_struct(docs).alias("row"), F.col(id_col).cast("long").alias("kept"))  # names of docs cannot clash
    own = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    met = whole.join(keep, "kept").withColumn("root", F.col("roots")[F.xxhash64(own)]).filter("root is not null")
    one = Window.partitionBy("kept", "root").orderBy(own, F.xxhash64("row"))
    kept = met.withColumn("nth", F.row_number().over(one)).filter("nth = 1").select("row.*")
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))


def _roots(of_fp: DataFrame, root: DataFrame) -> DataFrame:
    """(node, root) of every set, from the roots of fingerprints."""
    root = root.select(F.col("node").alias("fp"), "root")
    return written(of_fp.join(root, "fp", "left").select("node", F.coalesce("root", "fp").alias("root")), "near-roots")


def _features(docs: DataFrame, id_col: str, text_col: str, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, th, fp, node, n, prefix, bits) of every row: a hash of its text, its fingerprint,
    and the name, size, prefix and bitmap of its set of five-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            fps = np.array([fingerprint(t) for t in texts], U64).view(np.int64)
            found = [
                (k, len(s), likeness.prefix(s, common).view(np.int64), likeness.bitmap(s))
                for k, s in likeness.shingle_sets(texts)
            ]
            node, n, *lists = zip(*found, strict=True) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps), pa.array(node, pa.int64()), pa.array(n, pa.int32())]
                + [pa.array(x, pa.list_(pa.int64())) for x in lists],
                ["id", "th", "fp", "node", "n", "prefix", "bits"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))
    return rows.mapInArrow(run, "id long, th long, fp long, node long, n int, prefix array<long>, bits array<long>")
