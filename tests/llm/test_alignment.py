"""Lockstep links and cuts against a plain merge of two token lists."""

import collections
import hashlib
import random

import numpy as np
import pytest

from framegate.llm import alignment
from framegate.llm.queries import ALIGNED, QUERIES, tokenizer_path

PATHS = tuple(map(tokenizer_path, ALIGNED))


@pytest.fixture(scope="module")
def tok():
    return alignment.Tokenizers(*PATHS)


def whole_ids(tok, text):
    """Ids of the whole text at once, without the cache; none where the bytes differ."""
    if not text:
        return [], []
    a, b = tok.a.encode(" " + text, add_special_tokens=False).ids, tok.b.encode(text)
    want = (" " + text).encode()
    same = b"".join(tok.bytes_a[k] for k in a) == want == b"".join(tok.bytes_b[k] for k in b)
    return (a, b) if same else ([], [])


def plain(tok, text):
    """Groups and links of a text by comparing byte ranges."""
    a, b = whole_ids(tok, text)
    spans = lambda ids, sizes: [(e - s, e) for e, s in zip(np.cumsum([sizes[k] for k in ids]).tolist() if ids else [], (int(sizes[k]) for k in ids), strict=True)]
    sa, sb = spans(a, tok.size_a), spans(b, tok.size_b)
    links, low = [], 0
    for i, (s, e) in enumerate(sa):
        while low < len(sb) and sb[low][1] <= s:
            low += 1
        j = low
        while j < len(sb) and sb[j][0] < e:
            links.append((i, j))
            j += 1
    ends = {e for _, e in sa} & {e for _, e in sb}
    groups, ga, gb, j = [], [], [], 0
    for i, (_, e) in enumerate(sa):
        ga.append(a[i])
        if e in ends:
            while j < len(sb) and sb[j][1] <= e:
                gb.append(b[j])
                j += 1
            groups.append((ga, gb))
            ga, gb = [], []
    return a, b, groups, [(a[i], b[j]) for i, j in links]


def digests(tok, docs):
    """Rows of op12 for (id, text) rows, as they are stated."""
    found = [plain(tok, t) for _, t in docs]
    held = collections.Counter(p for *_, links in found for p in set(links))
    most = collections.defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    rows = []
    for (name, _), (a, b, groups, links) in zip(docs, found, strict=True):
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(held[p] == most[p[0]] for p in links)
        rows.append((name, len(a), len(b), len(groups), len(links), best, sum(held[p] for p in links), hashlib.sha256(told.encode()).hexdigest() if told else ""))
    return sorted(rows, key=repr)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def told(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_query_equals_a_plain_merge(spark, sf, tok):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert told(QUERIES["op12_alignment"](spark, sf)) == digests(tok, docs)


def test_many_blocks_give_the_same(spark, sf, tok):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    want = digests(tok, [(r["doc_id"], r["text"]) for r in docs.collect()])
    found = alignment.link_digests(docs.repartition(5), *PATHS)
    assert told(found) == want


def test_awkward_rows(awkward, nothing, tok):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert told(alignment.link_digests(awkward, *PATHS)) == digests(tok, docs)
    assert told(alignment.link_digests(nothing, *PATHS)) == []


ODD = [
    "a", " ", "  ", "\n", " lead", "trail ", "two  spaces", "tab\tand\nline\r\nbreaks ", "a▁b literal mark", "<|endoftext|> <s> </s> <unk> <0x0A>", "naïve Übung 日本語 の文 😀👍🏽",
    "\x00nul \x1c sep \x85 nel \xa0 nbsp em", "x" * 700, "=" * 300 + " " * 50 + "y", "don't we'll I'm '' 's", "1234567890 12 3.14", "ﬁ ligature é combined", "a 　 b", "​ zero", None, "",
]


def test_odd_texts_one_by_one(tok):
    found = alignment.align(tok, [t or "" for t in ODD], lane=3, lanes=5)
    for k, text in enumerate(ODD):
        a, b, groups, links = plain(tok, text)
        ids_a, ids_b, upto_a, upto_b = found.groups(k)
        assert (ids_a.tolist(), ids_b.tolist()) == (a, b), text
        assert upto_a.tolist() == np.cumsum([len(x) for x, _ in groups], dtype=int).tolist(), text
        assert upto_b.tolist() == np.cumsum([len(y) for _, y in groups], dtype=int).tolist(), text
        assert found.n_links[k] == len(links), text
        assert tok and alignment.digest(tok, found, k, most=7) == digests(tok, [(0, text)])[0][-1], text


def test_random_texts_and_lanes(tok):
    rng = random.Random(3)
    letters = "abcde  \n\t.,'é日😀0123 ABC##__"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 400))) for _ in range(80)]
    for lane, lanes in ((1, 1000), (2, 7), (64, 1 << 15)):
        pairs = alignment.Pairs(len(tok.bytes_a), len(tok.bytes_b))
        alignment.align(tok, texts, pairs, lane, lanes)
        text, pair, times = pairs.told()
        got = collections.Counter({(int(t), *divmod(int(p), len(tok.bytes_b))): int(n) for t, p, n in zip(text, pair, times, strict=True)})
        assert got == collections.Counter((k, *link) for k, x in enumerate(texts) for link in plain(tok, x)[3])


def test_no_piece_crosses_a_lone_space(tok):
    """The cache of parts rests on this."""
    assert not [p for p in (tok.b.id_to_piece(k) for k in range(tok.b.get_piece_size())) if alignment.MARK in p.lstrip(alignment.MARK)]


def test_alignments_hold_the_groups(spark, sf, tok):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in alignment.alignments(docs, *PATHS).collect():
        a, b, groups, _ = plain(tok, texts[r["doc_id"]])
        assert (r["ids_a"], r["ids_b"]) == (a, b)
        assert r["upto_a"] == np.cumsum([len(x) for x, _ in groups], dtype=int).tolist()
