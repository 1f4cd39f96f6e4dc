import math
import re

import pytest

from framegate.llm import mixing, queries


def goals(sizes):
    """Targets by resharing until none is above; sizes: source -> words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free} if free else {}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def words(text):
    return len(re.findall("[^\\x20\\x09-\\x0D]+", text or ""))


def check(rows, given):
    """rows of mix(); given: (id, source, text) of the input."""
    assert len(rows) == len(given)
    sizes = {}
    for _, source, text in given:
        sizes[source] = sizes.get(source, 0) + words(text)
    want = goals(sizes)
    source_of = {}
    for name, source, text in given:
        source_of.setdefault((name, words(text)), []).append(source)
    taken, shortest = {}, {}
    for r in rows:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        source = source_of[(r.doc_id, r.size)].pop()
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source], rel=1e-9, abs=1e-6)
        taken[source] = taken.get(source, 0) + r.taken
        if r.size:
            shortest.setdefault(source, []).append(r.size)
    for source, got in taken.items():
        near = max(shortest.get(source, [0]))
        assert abs(got - want[source]) <= near, (source, got, want[source])
    return taken, want


def test_whole_table(spark, documents):
    given = [(r.doc_id, r.source, r.text) for r in documents.collect()]
    rows = mixing.mix(documents).collect()
    taken, want = check(rows, given)
    off = [abs(taken[s] - want[s]) / want[s] for s in want if want[s]]
    assert sum(off) / len(off) < 0.02
    again = mixing.mix(documents.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_awkward_rows(awkward, nothing):
    given = [(r.doc_id, r.source, r.text) for r in awkward.collect()]
    check(mixing.mix(awkward).collect(), given)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    out = mixing.mixed(awkward)
    assert out.columns == awkward.columns
    count = {}
    for r in mixing.mix(awkward).collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + r.copies
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in count.items() if v}


def test_a_source_without_words(spark):
    rows = [(1, "", "a"), (2, None, "a"), (3, "w " * 50, "b"), (4, "w " * 70, "b"), (5, "v " * 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mixing.mix(docs).collect(), [(i, s, t) for i, t, s in rows])


def test_rates_are_tilted_exponentially(spark, documents):
    """The log-odds of a rate's half are one number a source times the size, and these rates
    meet the targets; so they are the least entropy's. Copies follow them."""
    from pyspark.sql import functions as F

    sizes = mixing.sized(documents, "doc_id", "text", "source")
    aims = mixing.targets(sizes)
    bins = sizes.join(aims.select("source", "sid"), "source").groupBy("sid", "size").agg(F.count("*").alias("n_docs"))
    lam = mixing.balance(bins, aims, aims.count())
    rated = bins.join(lam, "sid").withColumn("rate", mixing.rate(F.col("lam"), F.col("size"), F.col("mean"))).collect()
    goal = {r.sid: r.target for r in aims.collect()}
    by = {}
    for r in rated:
        by.setdefault(r.sid, []).append(r)
    for sid, rows in by.items():
        tilt = {round(math.log(r.rate / (2 - r.rate)) / r.size * r.mean, 6) for r in rows if r.size and 1e-6 < r.rate < 2 - 1e-6}
        assert len(tilt) <= 1 and abs(next(iter(tilt), rows[0].lam) - rows[0].lam) < 1e-5
        assert sum(r.n_docs * r.size * r.rate for r in rows) == pytest.approx(goal[sid], rel=1e-6)
    rate = {(r.sid, r.size): r.rate for r in rated}
    sid = {r.source: r.sid for r in aims.collect()}
    source = {r.doc_id: r.source for r in documents.collect()}
    made = [(rate[sid[source[r.doc_id]], r.size], r.copies) for r in mixing.mix(documents).collect() if (sid[source[r.doc_id]], r.size) in rate]
    assert made and all(math.floor(w) - 1 <= c <= math.ceil(w) + 1 for w, c in made)


def test_rows_alike_but_for_their_source_have_their_own_copies(spark):
    """One id and text under a scarce and a plentiful source; reruns agree."""
    rows = [(1, "some words of a text", "a", 0)] * 3 + [(1, "some words of a text", "b", i) for i in range(60)] + [(2, "x y", None, 0), (2, "x y", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    given = [(r[0], r[2], r[1]) for r in rows]
    sizes = {}
    for _, source, text in given:
        sizes[source] = sizes.get(source, 0) + words(text)
    runs = [sorted(tuple(r) for r in mixing.mixed(d).collect() if r.source is not None) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1]
    for source, goal in goals(sizes).items():
        if source in ("a", "b"):
            assert abs(sum(words(r[1]) for r in runs[0] if r[2] == source) - goal) <= 5


def test_the_query_has_its_columns(spark, sf):
    assert queries.op10_mixing(spark, sf).columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
