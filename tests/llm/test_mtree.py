from math import floor

import numpy as np
import pyarrow as pa
import pytest

from framegate.llm import mtree

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, every=50):
    """rows: (id, vector), the fit ones, each once. A row's own id is no candidate."""
    width = max(len(v) for _, v in rows)
    x = np.zeros((len(rows), width), np.int64)
    for i, (_, v) in enumerate(rows):
        x[i, : len(v)] = np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)
    ids = np.array([i for i, _ in rows])
    out = set()
    for q in np.flatnonzero(ids % every == 0):
        scores = x @ x[q]
        order = sorted((-int(s), int(n)) for s, n in zip(scores, ids, strict=True) if n != ids[q])
        out |= {(int(ids[q]), r + 1, n, -s) for r, (s, n) in enumerate(order[:k])}
    return out


def told(df):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()}


def test_clusters_copies_and_ties(spark, monkeypatch):
    """Small cells and pages, so that every level prunes."""
    monkeypatch.setattr(mtree, "CELL_ROWS", 120)
    monkeypatch.setattr(mtree, "BLOCK", 8)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    x = (centres[rng.integers(0, 6, 1200)] + rng.normal(size=(1200, 16)) * 0.1).astype(np.float32)
    x[400:700] = x[400]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = told(mtree.top_k(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)))
    assert got == brute(rows)


def test_vectors_that_take_no_part(spark):
    good = [(i, [float(i % 7) / 3, 1.0, -0.5]) for i in range(0, 140)] + [(200, [0.5]), (250, [0.0, 0.0, 0.0])]
    bad = [(300, None), (350, [1.0, None, 0.0]), (400, [float("nan"), 1.0, 1.0]), (450, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    twice = [(0, [0.0, 1.0, -0.5])]
    df = spark.createDataFrame([(i, v, 0) for i, v in good + bad + twice], SCHEMA).selectExpr("*", "1 as id", "2 as v", "3 as rank")
    assert told(mtree.top_k(df)) == brute(good)


def test_ids_with_several_vectors(spark):
    """Each row is a query with a list of its own, and finds k rows of other ids."""
    rng = np.random.default_rng(8)
    rows = [(50, rng.normal(size=4).tolist()) for _ in range(7)] + [(i, rng.normal(size=4).tolist()) for i in range(1, 9)]
    rows += [(100, rows[0][1]), (150, rows[0][1]), (3, rng.normal(size=4).tolist())]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in mtree.top_k(df).collect()]
    x = np.floor(256 * np.array([v for _, v in rows], np.float32).astype(float)).astype(int)
    want = []
    for i, (name, _) in enumerate(rows):
        if name % 50 == 0:
            best = sorted((-int(x[i] @ x[j]), n) for j, (n, _) in enumerate(rows) if n != name)[:5]
            want += [(name, r + 1, n, -s) for r, (s, n) in enumerate(best)]
    assert len(got) == 45 and sorted(got) == sorted(want)


def exact(rows, k=5, every=50):
    """brute() in Python's whole numbers; scores end at the limits of a long."""
    x = [(n, [floor(256 * c) for c in v]) for n, v in rows]
    out = set()
    for n, q in x:
        if n % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), m) for m, v in x if m != n)
            out |= {(n, r + 1, m, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, m) in enumerate(best[:k])}
    return out


@pytest.mark.parametrize("tree", [True, False])
def test_large_values_rank_exactly(spark, tree):
    """Small vectors beside such that doubles, longs or neither hold the scores of."""
    small = [(i, [float(i % 17), -3.5, i / 7]) for i in range(120)]
    large = [(200, [1e300, 1.0]), (201, [1e300, 2.0]), (250, [-1e300, 0.0]), (300, [1e6, 0.0]), (301, [1e6, 1 / 256]), (302, [2e6]), (350, [3e5, 1e9, -7.0]), (351, [1e13, 0.3, 5.0])]
    rows = small + large
    df = spark.createDataFrame(rows + large[:2] + [(400, [1e308, 1.0]), (450, [float("inf")])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in mtree.top_k(df, tree=tree).collect()]
    assert len(got) == len(set(got)) and set(got) == exact(rows)


def test_four_rows_of_two_sizes(spark):
    rows = [(0, [1e6, 0.0]), (1, [2e6, 0.0]), (2, [3.0, 1.0]), (50, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert told(mtree.top_k(df)) == exact(rows) and len(exact(rows)) == 6


def test_blocks_give_what_the_tree_gives(spark, monkeypatch):
    monkeypatch.setattr(mtree, "BLOCK", 40)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert told(mtree.top_k(df, tree=False)) == told(mtree.top_k(df))


def test_few_rows_and_none(spark):
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5])]
    assert told(mtree.top_k(spark.createDataFrame([(i, v, 0) for i, v in few], SCHEMA))) == {(0, 1, 1, 256 * 128)}
    assert mtree.top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pages_keep_their_bounds_and_searches_skip_work():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8)) * 300
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 20)
    most = float((x**2).sum(axis=1).max())
    lifted = mtree._lift(x, most)
    pages = mtree.build_pages(lifted, lifted[0], page=64)
    assert sorted(np.concatenate([p[3] for p in pages]).tolist()) == list(range(4000))
    for route, up, radius, rows, apart in pages:
        d = np.sqrt(((lifted[rows] - lifted[route]) ** 2).sum(axis=1))
        assert np.allclose(d, apart, atol=1e-3) and radius >= d.max() - 1e-3
        assert abs(up - np.sqrt(((lifted[route] - lifted[0]) ** 2).sum())) < 1e-3
    table = pa.table(
        {
            "route": pa.array([x[p[0]].astype(int).tolist() for p in pages]), "up": [p[1] for p in pages], "radius": [p[2] for p in pages],
            "ids": pa.array([[[int(i)] for i in p[3]] for p in pages]), "entries": [x[p[3]].astype(np.int64).tobytes() for p in pages],
            "apart": [p[4].tobytes() for p in pages],
        }
    )
    cell = mtree.Cell(table, 8, most, lifted[0])
    for q in x[:40]:
        scores = x @ q
        want = sorted((-int(s), i) for i, s in enumerate(scores))[:6]
        assert [(-s, n) for s, n in cell.best(q, 6)] == want
    assert cell.computed < 40 * 4000 / 2  # at least half of all distances were never computed
