"""Alignment of two tokenizers' tokens over the same bytes, merged in lockstep.

Texts come in batches. Each text is encoded by both tokenizers, and all token ends of a batch
stand in two arrays. A text is cut into lanes of LANE tokens of A; one state vector holds the
A and B pointer of every lane of every text, and each step links the two tokens that all
lanes point at, marks a cut where both end at the same byte, moves the pointer of the token
that ends first (both at a cut), and drops lanes that are done.

How many documents hold a pair of ids linked is counted over the whole corpus. A batch of
texts is a block with a dictionary of the pairs that it holds, so only (block, pair) rows are
shuffled, each pair once a block however many documents hold it, and counts come back to the
block as its dictionary.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegate.llm.common import bounded_batches, written
from framegate.llm.packing import BYTE_LETTERS
from framegate.llm.textvec import chunks

LANE = 64
#: Lanes that advance together; more go in turns, so a very long text's links are not held at once.
LANES = 1 << 15
BLOCK_BYTES = 2_000_000
CACHED_WORDS = 400_000
CACHED_CHARS = 64
#: Both tokenizers cut at a lone space between two characters that are not blank, and never
#: look across it, so what lies between is encoded once and remembered.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
OTHER_SPACE = re.compile(r" (?:\s|$)|(?:^|[^\S ]) ")
#: Parts that are encoded in one call.
AT_ONCE = 10_000
MARK = "▁"


class Tokenizers:
    """Ids of both tokenizers by what lies between lone spaces, and the bytes of every token."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {letter: b for b, letter in BYTE_LETTERS.items()}
        with open(path_a, encoding="utf-8") as f:
            extra = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        size_a = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        self.bytes_a = [b""] * size_a
        for piece, k in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[k] = piece.encode() if piece in extra else bytes(byte[c] for c in piece)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in ((k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size()))]
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.told_a = [[f"{k}{s}".encode() for k in range(len(self.bytes_a))] for s in ",|"]
        self.told_b = [[f"{k}{s}".encode() for k in range(len(self.bytes_b))] for s in ",;"]
        self.told_a, self.told_b = (np.array(x, object) for x in (self.told_a, self.told_b))
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.odd: set[str] = set()

    def learn(self, parts: set[str]) -> None:
        """Puts parts in known: their ids in A and B, little-endian; in odd instead where
        the tokens' bytes are not the part's."""
        new = list(parts - self.known.keys())
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            self.odd.clear()
            new = list(parts)
        for low in range(0, len(new), AT_ONCE):
            some = new[low : low + AT_ONCE]
            found = zip(some, self.a.encode_batch_fast([" " + p for p in some], add_special_tokens=False), self.b.encode(some, num_threads=1), strict=True)
            for p, a, b in found:
                ids, want = a.ids, b" " + p.encode()
                if b"".join([self.bytes_a[k] for k in ids]) == want == b"".join([self.bytes_b[k] for k in b]):
                    self.known[p] = array("i", ids).tobytes(), array("i", b).tobytes()
                else:
                    self.known[p] = b"", b""
                    self.odd.add(p)

    def forget(self, parts: set[str]) -> None:
        """Drops long parts, which hardly come again."""
        for p in parts:
            if len(p) > CACHED_CHARS:
                del self.known[p]
                self.odd.discard(p)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of space + text in A and of text in B, which adds the space; both empty for an
        empty text and where the tokens' bytes are not those of space + text."""
        split = [lone_parts(t) if t else [] for t in texts]
        parts = set().union(*split)
        self.learn(parts)
        out, known = [], self.known.__getitem__
        for some in split:
            if not self.odd.isdisjoint(some):
                some = ()
            ids = list(map(known, some))
            out.append((np.frombuffer(b"".join([x[0] for x in ids]), np.intc), np.frombuffer(b"".join([x[1] for x in ids]), np.intc)))
        self.forget(parts)
        return out


def lone_parts(text: str) -> list[str]:
    """What lies between the lone spaces of a text."""
    return LONE_SPACE.split(text) if OTHER_SPACE.search(text) else text.split(" ")


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One pair with its cache for all tasks that a Python worker runs."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Tokenizers(path_a, path_b)
    return _loaded[path_a, path_b]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, i: np.ndarray, stop: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Steps of all lanes: (A pointers, B pointers, which of them are cuts). A lane begins at
    A token i and B token j and is done when its A pointer reaches stop."""
    while len(i):
        ea, eb = end_a[i], end_b[j]
        yield i, j, ea == eb
        i, j = i + (ea <= eb), j + (eb <= ea)
        on = i < stop
        if not on.all():
            i, j, stop = i[on], j[on], stop[on]


@dataclass
class Aligned:
    """Texts' ids in a row, where each text begins, and what lockstep found."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray
    cut_a: np.ndarray  # whether a group ends with this token
    cut_b: np.ndarray
    n_links: np.ndarray

    def groups(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids, B ids, and how many A and B tokens lie up to the end of each group, of text k."""
        a, b = slice(*self.at_a[k : k + 2]), slice(*self.at_b[k : k + 2])
        return self.ids_a[a], self.ids_b[b], np.flatnonzero(self.cut_a[a]) + 1, np.flatnonzero(self.cut_b[b]) + 1


class Pairs:
    """Distinct (text, A id, B id) of a batch, with how many links each has."""

    def __init__(self, ids_a: int, ids_b: int):
        self.ids_b, self.most, self.keys, self.times = ids_b, ids_a * ids_b, [], []

    def add(self, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        key, times = np.unique(text * self.most + a.astype(np.int64) * self.ids_b + b, return_counts=True)
        self.keys.append(key)
        self.times.append(times)

    def told(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pair (A id times B's number of ids, plus B id) and links, sorted."""
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, place = np.unique(np.concatenate(self.keys), return_inverse=True)
        times = np.bincount(place, np.concatenate(self.times)).astype(np.int64)
        return key // self.most, key % self.most, times


def align(tok: Tokenizers, texts: list[str], pairs: Pairs | None = None, lane: int = LANE, lanes: int = LANES) -> Aligned:
    """Aligns a batch; pairs gets the ids of all links."""
    ids = tok.encode(texts)
    ids_a, ids_b = (np.concatenate([x[s] for x in ids] or [np.zeros(0, np.intc)]) for s in (0, 1))
    at_a, at_b = (np.concatenate(([0], np.cumsum([len(x[s]) for x in ids]))).astype(np.int64) for s in (0, 1))
    end_a, end_b = np.cumsum(tok.size_a[ids_a]), np.cumsum(tok.size_b[ids_b])  # equal at texts' ends
    cut_a, cut_b, n_links = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool), np.zeros(len(texts), np.int64)
    per = -(-np.diff(at_a) // lane)  # lanes of each text
    owner = np.repeat(np.arange(len(texts)), per)
    first = at_a[owner] + lane * (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per))
    stop = np.minimum(first + lane, at_a[owner + 1])
    begin = np.searchsorted(end_b, end_a[first] - tok.size_a[ids_a[first]], "right")  # the B token over its first byte
    for low in range(0, len(first), lanes):
        part = slice(low, low + lanes)
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j, cut in lockstep(end_a, end_b, first[part], stop[part], begin[part]):
            links.append((i, j))
            cut_a[i[cut]] = True
            cut_b[j[cut]] = True
        i, j = (np.concatenate(x) for x in zip(*links, strict=True))
        text = np.searchsorted(at_a, i, "right") - 1
        n_links += np.bincount(text, minlength=len(texts))
        if pairs:
            pairs.add(text, ids_a[i], ids_b[j])
    return Aligned(ids_a, ids_b, at_a, at_b, cut_a, cut_b, n_links)


def digest(tok: Tokenizers, found: Aligned, k: int, most: int = 1 << 18) -> str:
    """sha256 of a text's groups as `a1,a2|b1;a3|b2,b3`; '' without tokens."""
    a, b, upto_a, upto_b = found.groups(k)
    if not len(upto_a):
        return ""
    # Groups in order: each token comes after all tokens of earlier groups and A's before B's.
    last_a, last_b = np.zeros(len(a), int), np.zeros(len(b), int)
    last_a[upto_a - 1] = last_b[upto_b - 1] = 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    told = np.empty(len(a) + len(b), object)
    told[np.arange(len(a)) + np.concatenate(([0], upto_b))[group_a]] = tok.told_a[last_a, a]
    told[np.arange(len(b)) + upto_a[group_b]] = tok.told_b[last_b, b]
    told[-1] = told[-1][:-1]
    sha = hashlib.sha256()
    for low in range(0, len(told), most):
        sha.update(b"".join(told[low : low + most].tolist()))
    return sha.hexdigest()


_BLOCK = pa.schema([
    ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())),
    ("n_links", pa.list_(pa.int64())), ("sha", pa.list_(pa.string())), ("pairs", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int64())),
    ("size", pa.list_(pa.int64())), ("held", pa.binary()),
])
_BLOCK_SQL = """block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>,
    pairs array<long>, n_docs array<long>, size array<long>, held binary"""


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about so many bytes, whatever the size of Spark's batches; a longer
    text is alone."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        names, more = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for part in chunks([len(t) for t in more], most):
            size = sum(map(len, more[part]))
            if texts and held + size > most:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids, texts, held = ids + names[part], texts + more[part], held + size
    if texts:
        yield ids, texts


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a block of texts: their ids and digests, the block's distinct pairs, how many of
    its documents hold each, and which pairs each document holds how often (packed)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(path_a, path_b)
        press = zstandard.ZstdCompressor(level=1)
        for k, (ids, texts) in enumerate(_batches(batches, BLOCK_BYTES)):
            pairs = Pairs(len(tok.bytes_a), len(tok.bytes_b))
            found = align(tok, texts, pairs)
            text, pair, times = pairs.told()
            names, place = np.unique(pair, return_inverse=True)
            n = range(len(texts))
            row = (
                (TaskContext.get().partitionId() << 32) + k, ids, np.diff(found.at_a), np.diff(found.at_b), [int(found.cut_a[found.at_a[d] : found.at_a[d + 1]].sum()) for d in n],
                found.n_links, [digest(tok, found, d) for d in n], names, np.bincount(place, minlength=len(names)), np.bincount(text, minlength=len(texts)),
                press.compress(np.concatenate((place, times)).astype("<i4").tobytes()),
            )
            yield pa.RecordBatch.from_arrays([pa.array([v if isinstance(v, (int, list, bytes)) else np.asarray(v, np.int64)], f.type) for v, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, _BLOCK_SQL)


def pair_counts(found: DataFrame, ids_b: int) -> DataFrame:
    """(pair, n, best) over all blocks: how many documents hold the pair linked, and whether no
    other pair of the same A id has more."""
    n = found.select(F.inline(F.arrays_zip("pairs", "n_docs"))).groupBy("pairs").agg(F.sum("n_docs").alias("n"))
    n = n.select(F.col("pairs").alias("pair"), "n", F.expr(f"pairs div {ids_b}L").alias("a"))
    most = n.groupBy("a").agg(F.max("n").alias("most"))
    return n.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _sums(_key, block: pa.Table, known: pa.Table) -> pa.Table:
    """A block's documents with sums over their links of the pairs' counts."""
    order = np.argsort(known["pair"].to_numpy())  # the dictionary is sorted too
    n, best = known["n"].to_numpy()[order], known["best"].to_numpy()[order].astype(np.int64)
    row = {c: block[c][0] for c in block.column_names}
    packed = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["held"].as_py()), "<i4")
    place, times = packed[: len(packed) // 2], packed[len(packed) // 2 :].astype(np.int64)
    at = np.concatenate(([0], np.cumsum(row["size"].values.to_numpy())))
    sums = []
    for worth in (best, n):
        total = np.concatenate(([0], np.cumsum(worth[place] * times)))
        sums.append(pa.array(total[at[1:]] - total[at[:-1]], pa.int64()))
    told = [row[c].values for c in ("ids", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*told, *sums, row["sha"].values], ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def link_digests(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Links are all pairs of an A and a B token whose bytes overlap; groups lie between bytes
    where tokens of both end. n_best counts the links whose pair of ids is, over all rows, linked in as
    many documents as any pair of the same A id; count_sum adds up in how many documents
    each link's pair is. Zeros and '' for null and empty texts and where the joined bytes of
    either's tokens are not space + text. Every row counts as a document, repeated and null
    ids too; other columns are ignored; an empty table gives no rows. A text longer than
    BLOCK_BYTES is a block of its own and goes through whole.
    """
    import sentencepiece

    ids_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    found = written(blocks(docs, path_a, path_b, id_col, text_col), "blocks")
    known = pair_counts(found, ids_b)
    asked = found.select(F.col("block").alias("of"), F.explode("pairs").alias("pair")).join(known, "pair")
    held = found.select("block", "ids", "n_a", "n_b", "n_groups", "n_links", "sha", "size", "held")
    schema = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return held.groupBy("block").cogroup(asked.groupBy("of")).applyInArrow(_sums, schema).withColumnRenamed("id", id_col)


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids_a, ids_b, upto_a, upto_b) of every row: both tokenizers' ids, and how many
    tokens of each lie up to the end of each group. Cases as in link_digests; all arrays
    are empty where there are no tokens."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), *((c, pa.list_(pa.int32())) for c in ("ids_a", "ids_b", "upto_a", "upto_b"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(path_a, path_b)
        for ids, texts in _batches(batches, BLOCK_BYTES):
            found = align(tok, texts)
            rows = zip(*(found.groups(k) for k in range(len(texts))), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([x.astype(np.int32) for x in c], pa.list_(pa.int32())) for c in rows)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, ids_a array<int>, ids_b array<int>, upto_a array<int>, upto_b array<int>").withColumnRenamed("id", id_col)
