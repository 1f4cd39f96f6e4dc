"""Best-fit packing by the sum of squares.

Tokens stay where the texts are: a task turns each document into the places, lengths and
checksums of its pieces, and only these travel. Pieces are dealt at random into groups of
about BINS_A_GROUP sequences each, of PIECES_A_GROUP pieces at most or so, and every group is
packed on its own: pieces from long to short, each into the open sequence that makes the sum
over all gaps of (open sequences with that gap) squared smallest. A group leaves a sequence
or two part empty, so the groups cost well under one in a thousand.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegate.llm.common import bounded_batches, written

CAPACITY = 4096
END_ID = 1
BINS_A_GROUP = 2000
PIECES_A_GROUP = 200_000
CACHED_WORDS = 1_000_000
CACHED_CHARS = 64
#: What keeps a text from being lower-cased before it is split: letters whose lower case
#: could meet the tokenizer's normal form in another order, blanks that only str.split()
#: knows, and the start of a special token.
PLAIN_ONLY = re.compile("[\x1c-\x1f\x85\xa0\u0130\u0131\u0180-\U0010ffff]|<\\|")
WORDS = re.compile("[^\x20\x09-\x0d]+")
NOWHERE = np.iinfo(np.int64).max

def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell each byte as a letter: printable Latin-1 characters as
    themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + n) for n, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


class WordIds(dict):
    """Token ids, little-endian, by blank-separated word. The tokenizer lower-cases, drops
    white space and never looks across it, so a text's ids are those of its words in a row.
    It also parts letters and digits from marks, so commas and stops at a word's end have
    ids of their own. What was seen before comes from this cache, of bounded size."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(",.")
        if core != word and core and core[-1].isalnum() and core[-1] < "\u0130":
            ids = self[core] + self[word[len(core) :]]
        elif word.islower() and word.isalpha() and max(word) < "\u0180":
            # Already normal and one piece: straight to the merges, a third of the time.
            letters = word.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = np.array([t.id for t in self.tokenizer.model.tokenize(letters)], "<u4").tobytes()
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= CACHED_CHARS:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
        words = WORDS.findall(text) if PLAIN_ONLY.search(text) else text.lower().split()
        return b"".join(map(self.__getitem__, words))


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One cache for all tasks that a Python worker runs."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's ids and END_ID after them,
    cut into CAPACITY where longer. A null text counts as empty."""
    bounded_batches(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        for batch in batches:
            out: list[tuple] = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = memoryview(words.encode(text or "") + end)
                for k, at in enumerate(range(0, len(whole), 4 * CAPACITY)):
                    piece = whole[at : at + 4 * CAPACITY]
                    out.append((name, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), KINDS, strict=True)] if out else [pa.array([], t) for t in KINDS],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY, open_freely: bool = False, longest_first: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece. Moving a sequence from gap g to g - s changes the
    sum by 2 (N[g - s] - N[g]) + 2; a full sequence is closed and counts no more. Equal
    changes go to the smaller gap. A new sequence changes it by 2 N[capacity - s] + 1. With
    open_freely that is one more choice; else a new one is opened only where no open one has
    room. README has the figures of both, and of pieces as they come."""
    count = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    made = 0
    for i in np.argsort(-sizes, kind="stable") if longest_first else range(len(sizes)):
        s = int(sizes[i])
        # count[0] stays 0: closed sequences
        change = 2 * (count[: capacity + 1 - s] - count[s:]) + 2
        change[0] -= 1
        change[count[s:] == 0] = NOWHERE
        g = int(np.argmin(change)) + s
        least = int(change[g - s])
        if least < NOWHERE and not (open_freely and 2 * count[capacity - s] + (s < capacity) < least):
            b = open_[g].pop()
            count[g] -= 1
        else:
            b, g = made, capacity
            made += 1
        where[i], offset[i] = b, capacity - g
        if g > s:
            open_[g - s].append(b)
            count[g - s] += 1
    return where, offset


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True])
    where, group["offset"] = sum_of_squares(group["length"].to_numpy())
    group["sequence_id"] = group["g"].to_numpy() * (1 << 32) + where
    return group.drop(columns="g")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with sequence_id and offset. Each document takes part, an empty or null text
    as its END_ID alone; repeated rows are packed each; null ids stay null; an empty table
    gives no rows; other columns are ignored. A very long text is encoded whole, alone in its
    task's memory, and only its pieces' places travel."""
    found = written(pieces(docs, tokenizer_path, id_col, text_col), "pieces")
    tokens, n = found.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, tokens // (CAPACITY * BINS_A_GROUP), n // PIECES_A_GROUP)
    # The row's number in the written table parts pieces that are alike in all else.
    place = F.xxhash64("id", "piece", "ids_crc32", "start", F.monotonically_increasing_id())
    dealt = found.withColumn("g", F.pmod(place, F.lit(groups)))
    schema = "id long, piece int, start long, length long, ids_crc32 long, offset long, sequence_id long"
    return dealt.groupBy("g").applyInPandas(_pack, schema).withColumnRenamed("id", id_col)
