"""Counts against a plain loop, bands on texts of known kind."""

import base64
import collections
import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from framegate.llm import compression as rules
from framegate.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    """The counts, as they are stated."""
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, repeats, len(covered), failed


def band(size):
    return next((low, high) for below, low, high in rules.BANDS if size < below)


def plain_verdict(text):
    """Both bands of a text, chunk by chunk."""
    data, press = (text or "").encode(), zstandard.ZstdCompressor(level=3)
    outside = lambda part: not band(len(part))[0] <= len(press.compress(part)) / len(part) <= band(len(part))[1]
    odd = sum(len(data[i : i + 4096]) for i in range(0, len(data), 4096) if outside(data[i : i + 4096]))
    return bool(data) and not outside(data) and odd / len(data) <= 0.25


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_query_equals_a_plain_loop(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op11_compression"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert tuple(r[c] for c in COUNTS) == want
        assert r["kept"] == (not want[-1] and plain_verdict(texts[r["doc_id"]]))


def test_labelled_good_documents_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1")
    judged = rules.quality_rules(docs).join(good, "doc_id").filter("not base_failed")
    assert judged.count() > 100 and judged.filter("not kept").count() == 0


@pytest.mark.parametrize("words", [60, 300, 3000])
def test_bands_reject_repeats_and_noise(words):
    rng = random.Random(words)
    press = zstandard.ZstdCompressor(level=3)
    verdict = lambda text: rules.measure(text, press)[-1]
    letters = "etaoinshrdlucmfwyp"
    vocabulary = ["".join(rng.choices(letters, range(18, 0, -1), k=rng.randint(2, 9))) for _ in range(2000)]
    prose = " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(2000)], k=words)).encode()
    assert verdict(prose)
    noise = base64.b64encode(rng.randbytes(6 * words))
    assert not verdict(b" ".join(noise[i : i + 8] for i in range(0, len(noise), 8))) or len(noise) < 1024
    page = b"the same line again and again\n"
    assert not verdict(page * (words // 6))


def test_one_bad_page_in_four_is_told(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(3000)], k=4000)).encode()[:12_288]
    noise = base64.b64encode(rng.randbytes(8192))[:8192]
    press = zstandard.ZstdCompressor(level=3)
    assert rules.measure(prose, press)[-1]
    assert not rules.measure(prose + noise, press)[-1]
    ratio = len(press.compress(prose + noise)) / len(prose + noise)
    assert rules.out_of_band(np.array([len(prose + noise)]), np.array([ratio]))[0] == 0, "only the chunks tell"


def test_repeated_words_at_the_edges():
    assert rules.repeated_words(b"a b c".split()) == 0
    assert rules.repeated_words(b"a b c a b c".split()) == 6
    assert rules.repeated_words(b"a a a a".split()) == 4
    assert rules.repeated_words(b"a b c x A b c".split()) == 0


def test_awkward_rows(awkward, nothing):
    found = rules.quality_rules(awkward)
    assert found.columns[: len(awkward.columns)] == awkward.columns
    rows = found.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert (r["n_words"], r["n_symbols"], r["base_failed"]) == (plain(r["text"])[0], plain(r["text"])[2], plain(r["text"])[5])
    assert [r["kept_"] if "kept_" in found.columns else r["kept"] for r in rows] == [False] * len(rows)  # all short, empty or of one word
    assert rules.quality_rules(nothing).count() == 0
    assert rules.keep_clean(awkward).columns == awkward.columns
    clash = nothing.withColumn("ratio", F.lit("x")).withColumn("measured", F.lit(1))
    assert "ratio_" in rules.quality_rules(clash).columns
