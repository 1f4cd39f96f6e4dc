"""The draw against a plain loop, and the ranks over many partitions."""

import collections
import hashlib
import math
import re
import zlib

from pyspark.sql import functions as F

from framegate.llm import resampling
from framegate.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def grams(text, max_n=2):
    words = WORD.findall(lower(text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def drawn(docs, target, percent=25, min_words=20, seed=7, size=10_000):
    """(id, n_features, weight, score, rank) of each (id, text), as it is stated."""
    bucket = lambda g: zlib.crc32(g.encode()) % size
    s, t = (collections.Counter(bucket(g) for text in texts for g in grams(text)[1]) for texts in ([x[1] for x in docs], target))
    total, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + size) / ((s[b] + 1) * (wanted + size))))
    rows, fit = [], []
    for k, (name, text) in enumerate(docs):
        words, found = grams(text)
        weight = sum(gain(bucket(g)) for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([name, len(found), weight, score, None])
        if len(words) >= min_words:
            fit.append((-score, name is None, name or 0, len(found), k))
    for rank, (*_, k) in enumerate(sorted(fit)[: percent * len(fit) // 100], 1):
        rows[k][4] = rank
    return sorted(map(tuple, rows), key=repr)


def told(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_query_equals_a_plain_loop(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    assert told(QUERIES["op13_resampling"](spark, sf)) == drawn(docs, target)


def test_awkward_rows(spark, awkward, nothing):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    target = spark.createDataFrame([("the quick brown fox",), (None,), ("",)], "text string")
    found = resampling.resample(awkward, target, min_words=5, percent=60)
    assert told(found) == drawn(docs, ["the quick brown fox"], percent=60, min_words=5)
    assert told(resampling.resample(awkward, target.limit(0), min_words=1, percent=100)) == drawn(docs, [], percent=100, min_words=1)
    assert told(resampling.resample(nothing, target)) == []


def test_scan_finds_all_runs():
    text = "One, two;THREE 4four  Übermut\x00naïve -- é"
    for n in (1, 2, 3, 4):
        want = sorted(zlib.crc32(g.encode()) for g in grams(text, n)[1])
        got = resampling.scan(text.encode(), resampling.runs_of_words(n))
        assert sorted(got) == want
        assert resampling._words(len(got), n) == len(grams(text, n)[0])
    assert resampling.scan(b" .. ", resampling.runs_of_words(2)) == []


def test_ranks_count_on_over_partitions(spark):
    rows = spark.range(1000).withColumn("v", F.col("id") % 7)
    found = resampling.ranked(rows.repartition(9), [F.col("v").desc(), F.col("id")])
    want = [r["id"] for r in rows.orderBy(F.col("v").desc(), "id").collect()]
    got = {r["nth"]: r["id"] for r in found.collect()}
    assert [got[k] for k in range(1, 1001)] == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
