"""Numpy over many texts at once: word spans, word hashes and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from framegate.llm.common import CHUNK_BYTES

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_STEP = U64(0xD6E8FEB86659FD93)
_SEGMENT = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _SEGMENT + 1)
        _powers[:] = [
            np.concatenate((np.ones(1, U64), np.cumprod(np.full(size - 1, m, U64))))
            for m in (_MULTIPLIER, _INVERSE)
        ]
    return _powers


class Spans:
    """Words of one byte buffer: starts, ends and, on demand, hashes of (parts of) them."""

    def __init__(self, buf: np.ndarray, is_gap: np.ndarray):
        self.buf = buf
        gap = np.ones(len(buf) + 2, np.int8)
        gap[1:-1] = is_gap[buf]
        turn = np.diff(gap)
        self.starts, self.ends = np.flatnonzero(turn < 0), np.flatnonzero(turn > 0)

    def hashes(self, heads: tuple[int, ...] = ()) -> list[np.ndarray]:
        """Hash of every word and, for each of heads, of its first so many bytes.
        Runs in segments, cut between words, so that memory stays small."""
        out: list[list[np.ndarray]] = [[] for _ in range(1 + len(heads))]
        low, n = 0, len(self.starts)
        while low < n:
            high = max(low + 1, int(np.searchsorted(self.ends, self.starts[low] + _SEGMENT, "right")))
            base = int(self.starts[low])
            part = LOWER[self.buf[base : int(self.ends[high - 1])]].astype(U64) + U64(1)
            up, down = _power_tables(len(part) + 1)
            total = np.concatenate((np.zeros(1, U64), np.cumsum(part * up[: len(part)])))
            a, b = self.starts[low:high] - base, self.ends[low:high] - base
            for k, head in enumerate((0, *heads)):
                stop = np.minimum(b, a + head) if head else b
                out[k].append(mix((total[stop] - total[a]) * down[a] + U64(head)))
            low = high
        return [np.concatenate(x) if x else np.zeros(0, U64) for x in out]


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of consecutive texts with at most so many bytes together (or one text)."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a blank after each text; where each text begins (and the end)."""
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    return np.frombuffer(b" ".join([*texts, b""]), np.uint8), at


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word shingle, repeats included. A text with fewer
    words is one shingle; one without words has none. A-Z count as a-z."""
    buf, at = joined(texts)
    words = Spans(buf, BLANK)
    (h,) = words.hashes()
    owner = np.searchsorted(at, words.starts, "right") - 1
    count = np.bincount(owner, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    out_h, out_owner = [], []
    if len(h) >= width:
        end = len(h) - width + 1
        whole = owner[:end] == owner[width - 1 :]
        acc = h[:end].copy()
        for j in range(1, width):
            acc = acc * _STEP + h[j : end + j]
        out_h.append(mix(acc[whole]))
        out_owner.append(owner[:end][whole])
    for n in range(1, width):
        short = np.flatnonzero(count == n)
        if len(short):
            acc = h[first[short]]
            for j in range(1, n):
                acc = acc * _STEP + h[first[short] + j]
            out_h.append(mix(acc + U64(n)))
            out_owner.append(short)
    if not out_h:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_owner)
