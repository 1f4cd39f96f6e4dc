import random

from framegate.llm import simhash
from tests.llm.test_minhash import brute, jaccard
from tests.llm.test_simhash import brute_fp


def test_no_pair_alike_by_four_fifths_escapes(spark):
    """Near copies with some words edited, a hub with copies that are not alike among
    themselves, short texts and words common to all, against all pairs."""
    rng = random.Random(7)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 300))] + ["shared end of every text here"] * 2
        texts.append(" ".join(base))
        for edits in range(1, 6):
            words = " ".join(base).split()
            for i in rng.sample(range(len(words)), max(1, len(words) * edits // 200)):
                words[i] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += ["a b c d e f g h", "a b c d e f g h i", "one two", "one Two", "", " "]
    hub = [f"h{i}" for i in range(400)]
    texts.append(" ".join(hub))
    for k in range(12):
        texts.append(" ".join("z%d_%d" % (k, i) if k * 30 <= i < k * 30 + 40 else w for i, w in enumerate(hub)))
    rng.shuffle(texts)
    sets, fps = [brute(t) for t in texts], [brute_fp(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lost = 0
    for i in range(len(texts)):
        for j in range(i):
            alike, near = jaccard(sets[i], sets[j]) >= 0.8, (fps[i] ^ fps[j]).bit_count() <= 3
            lost += alike and not near
            if alike or near:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert lost > 20  # what the fingerprints alone leave
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in simhash.near_dedup(docs).collect())
    assert kept == sorted({find(i) for i in range(len(texts))})


def test_rows_that_share_an_id_are_looked_at_in_their_own_groups(spark):
    rows = [(3, "the first text of some words here"), (7, "the first text of some words here"), (7, "zwei andere worte stehen ganz allein da")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in simhash.near_dedup(docs).collect())
    assert got == [rows[0], rows[2]]
