import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from framegate.llm import packing, queries

ODD = [
    "Don't STOP, I'll go... 'tis <|endoftext|>x, <|ENDOFTEXT|> a\xa0b　c ’x’", "ǰ J̌, Σας ΣΑΣ. İı É",
    "42nd, 3.14, \xb2\xbd foo!. a.,.b,., \x1c\x1dz\x85", "", " ", ",", ".,.", "中文,文字. 日本語", "\u0130. \u0130, \u0958. a\u0301.", "\xc4rger \xdcbel, \xc9t\xe9. STRASSE stra\xdfe",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path())


def test_words_in_a_row_are_the_text(tokenizer, documents):
    words = packing.WordIds(queries.tokenizer_path())
    for text in ODD + [r.text for r in documents.collect()]:
        assert words.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@given(st.one_of(st.text(max_size=40), st.text(alphabet="abcXYZ \xe9\xc9\xdf\xd1\u0149\u0131\u0130\u017f\xaa\xba\xb2.,!?'-_01\n\x1c\x85\xa0\u3000\u0301|<>", max_size=60)))
@settings(max_examples=500, deadline=None, database=None)
def test_any_text(text):
    plain = _plain().encode(text, add_special_tokens=False).ids
    assert _words().encode(text) == np.array(plain, "<u4").tobytes()


@cache
def _plain():
    return Tokenizer.from_file(queries.tokenizer_path())


@cache
def _words():
    return packing.WordIds(queries.tokenizer_path())


def check_packed(rows):
    """No gap, no overlap, nothing over the capacity."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(by)


def test_whole_table(spark, sf, documents, tokenizer):
    rows = queries.op4_packing(spark, sf).collect()
    used = check_packed(rows)
    want = set()
    for r in documents.collect():
        ids = np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.add((r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
    least = -(-sum(r.length for r in rows) // 4096)
    assert used <= least + 1 + least // 200


def test_awkward_rows(awkward, nothing):
    rows = packing.pack(awkward, queries.tokenizer_path()).collect()
    check_packed(rows)
    assert sum(r.piece == 0 for r in rows) == 15
    assert [r.length for r in rows if r.doc_id in (3, 4, 5)] == [1, 1, 1]
    assert sum(r.doc_id == 11 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 2
    assert sum(r.length for r in rows if r.doc_id == 10) == 30_001
    assert packing.pack(nothing, queries.tokenizer_path()).count() == 0


def test_rows_that_are_alike_are_dealt_to_several_groups(spark, monkeypatch):
    """Empty texts make pieces of one token each; identical rows part all the same."""
    monkeypatch.setattr(packing, "PIECES_A_GROUP", 500)
    docs = spark.range(3000).selectExpr("cast(null as long) doc_id", "if(id % 2 = 0, '', null) text").repartition(3)
    rows = packing.pack(docs, queries.tokenizer_path()).collect()
    assert len(rows) == 3000 and check_packed(rows) >= 5
    assert max(np.unique([r.sequence_id >> 32 for r in rows], return_counts=True)[1]) < 700


@pytest.mark.parametrize("seed", range(5))
def test_groups_fill_like_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(4096, rng.lognormal(6, 1.2, 4000).astype(int) + 1)
    where, offset = packing.sum_of_squares(sizes)
    used = np.bincount(where, sizes)
    assert used.max() <= 4096
    for b in range(20):
        mine = np.flatnonzero(where == b)
        assert sorted(offset[mine]) == [0, *np.cumsum(sizes[mine][np.argsort(offset[mine])])[:-1].tolist()]
    assert len(used) <= -(-sizes.sum() // 4096) * 1.01 + 1


@pytest.mark.parametrize("freely", [False, True])
@pytest.mark.parametrize("longest_first", [False, True])
def test_a_step_makes_the_sum_of_squares_least(freely, longest_first):
    """Over all open sequences with room and, if opening is free, a new one."""
    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 40, 200)
    where, _ = packing.sum_of_squares(sizes, 64, freely, longest_first)
    gaps = {}
    for i in np.argsort(-sizes, kind="stable") if longest_first else range(len(sizes)):
        s = int(sizes[i])
        fits = {b: g for b, g in gaps.items() if g >= s}

        def after(b, g):
            left = [x for c, x in gaps.items() if c != b] + [g - s]
            return sum(left.count(x) ** 2 for x in set(left) if x)

        if fits and freely:
            choices = [after(b, g) for b, g in fits.items()]
            assert after(where[i], gaps.get(where[i], 64)) == min(*choices, after(None, 64))
        elif fits:
            assert after(where[i], gaps[where[i]]) == min(after(b, g) for b, g in fits.items())
        else:
            assert where[i] not in gaps
        gaps[where[i]] = gaps.get(where[i], 64) - s
