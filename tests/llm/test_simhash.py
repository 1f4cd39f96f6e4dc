import numpy as np
import pytest
import xxhash

from framegate.llm import graph, queries, simhash


def brute_fp(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=3):
    """rows: (id, fp). Least id of each row's component."""
    n = len(rows)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        r = find(i)
        if name is not None:
            least[r] = min(least.get(r, name), name)
    return [least.get(find(i)) for i in range(n)]


def test_whole_table_against_brute_force(spark, sf, documents):
    rows = [(r.doc_id, brute_fp(r.text or "")) for r in documents.collect()]
    want = {name: (f"{fp:016x}", c) for (name, fp), c in zip(rows, brute_components(rows), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, sf).collect()}
    assert got == want


def test_awkward_rows(awkward, nothing):
    got = simhash.components(awkward).collect()
    assert len(got) == 15
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[3].fingerprint == "0" * 16 and by_id[4].component_id == 3 and by_id[5].component_id == 3
    assert by_id[2].component_id == 1
    assert simhash.components(nothing).count() == 0
    kept = simhash.near_dedup(awkward).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 3, 6, 7, 8, 9, 10, 11, 12]
    assert sum(r.doc_id is None for r in kept) == 2


def test_every_distance_up_to_three_meets():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        bits = rng.choice(64, int(rng.integers(0, 4)), replace=False)
        b = a
        for bit in bits:
            b ^= 1 << int(bit)
        keys = [set(simhash.variants(np.array([x], np.uint64))[0].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]
        assert len(keys[0]) == 196


def test_a_large_group_is_joined_as_pairs_would(monkeypatch):
    rng = np.random.default_rng(5)
    base, block = int(rng.integers(0, 1 << 62)), 2
    rest = int(simhash._without(np.array([base], np.uint64), block)[0])
    group = set()
    while len(group) < 400:
        fp = base
        for bit in rng.choice(16, int(rng.integers(0, 9)), replace=False):
            fp ^= 1 << (16 * block + int(bit))
        if rng.random() < 0.7:
            other = int(rng.choice([i for i in range(64) if not 32 <= i < 48]))
            fp ^= 1 << other
        group.add(fp)
    fps = np.array(sorted(group), np.uint64)
    key = block << 48 | rest
    table = simhash.group_labels(key, fps)
    monkeypatch.setattr(simhash, "PAIRWISE", 1000)
    pairs = simhash.group_labels(key, fps)
    # the table leaves to their own key those pairs whose rests are equal but not the key's
    for i in range(len(fps)):
        for j in range(i):
            near = int(fps[i] ^ fps[j]).bit_count() <= 3
            own = simhash._without(fps[[i, j]], block)
            if near and not (own[0] == own[1] != rest):
                assert table[i] == table[j]
    assert all(pairs[i] == pairs[table[i]] for i in range(len(fps)))  # and joins nothing else


@pytest.mark.parametrize("many", [1_000_000, 1])
def test_chains_and_copies(spark, monkeypatch, many):
    """A chain of fingerprints, each within reach of the next only, is one component; hubs
    are joined the other way."""
    monkeypatch.setattr(graph, "MANY", many)
    monkeypatch.setattr(graph, "SHARE", 20)
    stars = graph.stars
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 102)] + [(7, 7)] + [(200, i) for i in range(201, 240)], "a long, b long")
    got = {r.node: r.root for r in stars(links).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == got[102] == 100
    assert all(got[i] == 200 for i in range(201, 240))
    assert stars(links.limit(0)).count() == 0
