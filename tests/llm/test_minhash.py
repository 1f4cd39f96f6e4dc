import hashlib

import numpy as np

from framegate.llm import minhash, queries
from framegate.llm.textvec import shingles


def brute(text, width=5):
    words = text.encode().lower().split()
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_shingle_hashes_know_only_words_and_order():
    texts = [b"a b c d e f", b"  A\tb\nC d e  f ", b"f e d c b a", b"a b", b"", b"x a b c d e f"]
    h, owner = shingles(texts, 5)
    sets = [set(h[owner == i].tolist()) for i in range(len(texts))]
    assert sets[0] == sets[1] and len(sets[0]) == 2
    assert not sets[0] & sets[2]
    assert len(sets[3]) == 1 and not sets[4]
    assert sets[0] < sets[5]


def test_whole_table_against_brute_force(spark, sf, documents):
    rows = sorted(documents.collect(), key=lambda r: -r.doc_id)
    found = {r.doc_id: r for r in queries.op1_minhash(spark, sf).collect()}
    assert len(found) == len(rows)
    off_edited, off_next = [], []
    for i, row in enumerate(rows):
        text, after = row.text, rows[(i + 1) % len(rows)].text
        cut = len(text) // 2
        edited = text[: len(text) - cut] + after[:cut]
        got = found[row.doc_id]
        assert got.n_chars == len(text)
        assert got.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off_edited.append(got.near_edited - jaccard(brute(text), brute(edited)))
        off_next.append(got.near_next - jaccard(brute(text), brute(after)))
    assert np.abs(off_edited).mean() < 0.03 and np.abs(off_edited).max() < 0.12
    assert np.abs(off_next).mean() < 0.02
    assert abs(np.mean(off_edited)) < 0.01  # the correction leaves no bias


def test_awkward_rows(awkward):
    found = minhash.edit_likeness(awkward).collect()
    assert len(found) == 15
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by_id[1][0].fingerprint == by_id[2][0].fingerprint  # lower-cased
    assert by_id[2][0].near_next == 1.0
    assert by_id[11][0].fingerprint == by_id[11][1].fingerprint
    assert by_id[3][0].fingerprint == by_id[4][0].fingerprint == "0" * minhash.BINS
    assert by_id[4][0].near_next == 1.0 and by_id[5][0].near_next == 1.0  # both without words
    assert by_id[4][0].n_chars == 0
    # after the last row (null ids, by text) comes the first
    last = [r for r in by_id[None] if r.n_chars > 0][0]
    text, first = "no id but words to share line of text", "x" * 5000
    cut = len(text) // 2
    assert last.edited_sha256 == hashlib.sha256((text[: len(text) - cut] + first[:cut]).encode()).hexdigest()


def test_one_row_and_none(spark, nothing):
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    (row,) = minhash.edit_likeness(one).collect()
    assert row.near_next == 1.0
    assert minhash.edit_likeness(nothing).count() == 0
    assert minhash.fingerprints(nothing).count() == 0


def test_fingerprints_equal_those_of_the_neighbour_query(spark, sf, documents):
    plain = {r.doc_id: r.fingerprint for r in minhash.fingerprints(documents).collect()}
    assert plain == {r.doc_id: r.fingerprint for r in queries.op1_minhash(spark, sf).collect()}
