"""Quality rules: counts of words, marks and repeats, and bands of zstandard ratios.

A text's ratio is its compressed size over its size in bytes. Repetitive text falls below the
band of its length, incompressible text lies above. Short texts compress badly whatever they
say, so each length has limits of its own. The whole text is judged and so is every chunk of
CHUNK bytes of it: a text passes as a whole while a page of it is noise or one line repeated.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegate.llm.common import bounded_batches, free_name
from framegate.llm.textvec import BLANK

MIN_WORDS = 50
#: A text fails when over so many hundredths of its words lie in repeated windows.
MOST_REPEATED = 50
WINDOW = 3
LEVEL = 3
CHUNK = 4096
#: A text fails when over so many hundredths of its bytes lie in chunks out of their bands.
MOST_ODD = 25
#: (bytes below, least ratio, greatest ratio). Prose in Latin script lies well inside: 0.5 to
#: 0.75 at 300 bytes, 0.42 to 0.5 from 5,000 on. Random letters lie at 0.6 and above, random
#: base64 at 0.76. The last row holds for anything longer.
BANDS = (
    (64, 0.0, 9.0),
    (128, 0.4, 1.3),
    (256, 0.4, 1.0),
    (512, 0.4, 0.85),
    (1024, 0.39, 0.78),
    (2048, 0.38, 0.7),
    (4096, 0.36, 0.65),
    (8192, 0.34, 0.62),
    (16384, 0.32, 0.6),
    (65536, 0.28, 0.59),
    (1 << 62, 0.22, 0.58),
)
_BELOW, _LEAST, _MOST = (np.array(c) for c in zip(*BANDS, strict=True))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_INSIDE = np.zeros(256, bool)  # bytes that go on with a character
_INSIDE[0x80:0xC0] = True


def out_of_band(sizes: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """-1 where a ratio lies below the band of its size, 1 where above, else 0."""
    k = np.searchsorted(_BELOW, sizes, "right")
    return (ratios > _MOST[k]).astype(int) - (ratios < _LEAST[k])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words which the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    seen = ids[:n]
    for j in range(1, window):  # windows numbered again at each width, so that the product stays small
        _, seen = np.unique(seen * len(number) + ids[j : n + j], return_inverse=True)
    again = np.bincount(seen)[seen] > 1
    covered = np.zeros(len(words), bool)
    for j in range(window):
        covered[j : n + j] |= again
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure(text: bytes, press: zstandard.ZstdCompressor) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, odd_share (of the
    bytes, in chunks out of their bands), verdict (of the bands alone)."""
    words = text.split()  # bytes: \\x20 and \\x09-\\x0D
    buf = np.frombuffer(text, np.uint8)
    chars = len(buf) - int(BLANK[buf].sum()) - int(_INSIDE[buf].sum())
    if not len(buf):
        return 0, 0, 0, 0, 0, None, 0.0, False
    view, starts = memoryview(text), range(0, len(buf), CHUNK)
    ratio = len(press.compress(text)) / len(buf)
    if len(buf) > CHUNK:
        sizes = np.minimum(len(buf) - np.arange(0, len(buf), CHUNK), CHUNK)
        pressed = np.fromiter((len(press.compress(view[i : i + CHUNK])) for i in starts), np.int64, len(sizes))
        odd = float(sizes[out_of_band(sizes, pressed / sizes) != 0].sum()) / len(buf)
    else:  # the one chunk is the text
        odd = float(out_of_band(np.array([len(buf)]), np.array([ratio]))[0] != 0)
    fine = out_of_band(np.array([len(buf)]), np.array([ratio]))[0] == 0 and 100 * odd <= MOST_ODD
    return len(words), chars, int(_SYMBOL[buf].sum()), duplicate_lines(text), repeated_words(words), ratio, odd, bool(fine)


MEASURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "ratio": "double",
    "odd_share": "double", "in_bands": "boolean",
}
_ARROW = pa.struct([(n, {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[t]) for n, t in MEASURES.items()])


def _measured():
    @F.arrow_udf(f"struct<{', '.join(f'{n}: {t}' for n, t in MEASURES.items())}>")
    def measured(texts: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=LEVEL)
        rows = (measure(t.as_py() or b"", press) for t in texts)
        return pa.array((dict(zip(MEASURES, row, strict=True)) for row in islice(rows, len(texts))), _ARROW, size=len(texts))

    return measured


def quality_rules(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the measures, base_failed and kept.

    base_failed: under min_words words, or over MOST_REPEATED hundredths of the words lie in
    repeated windows. kept: not base_failed and in the bands. A null text counts as empty,
    and an empty one has no ratio and fails. Words and lines count with their case. Every
    row is judged by itself, so repeated rows and null ids change nothing; texts of any length
    are judged whole; an empty table gives no rows. A column of docs with the name of a result
    stays, and the result's name gets _ after it.
    """
    bounded_batches(docs.sparkSession)
    held = free_name("measured", docs)
    found = docs.withColumn(held, _measured()(F.col(f"`{text_col}`").cast("binary")))
    m = {name: F.col(f"`{held}`.{name}") for name in MEASURES}
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
    results = m | {"base_failed": failed, "kept": ~failed & m["in_bands"]}
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(free_name(n, docs)) for n, c in results.items()])


def keep_clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that quality_rules keeps, with docs' columns."""
    judged = quality_rules(docs, text_col)
    return judged.filter(F.col(f"`{judged.columns[-1]}`")).select(*[F.col(f"`{c}`") for c in docs.columns])
