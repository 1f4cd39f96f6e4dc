import itertools
import zlib

import numpy as np
import pytest

from framegate.llm import labelled, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def accuracy(spark, df, labels, col):
    found = df.filter("held_out").join(labels, "doc_id").select(col, "score", "predicted").collect()
    y, s = np.array([r[0] for r in found]), np.array([r[1] for r in found])
    good, bad = s[y == 1], s[y == 0]
    auc = (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()
    return auc, np.mean([r[0] == r[2] for r in found])


def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    df = queries.op2_quality(spark, SF)
    auc, right = accuracy(spark, df, labels, "quality")
    assert auc > 0.97 and right > 0.95
    rows = df.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_labels_of_lines_in_documents_with_good_and_bad_halves(spark):
    """No line is labelled in the tables. Documents made of a good and a bad one have known lines."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    assert model.move[0, 0] > model.move[0, 1] and model.move[1, 1] > model.move[1, 0]  # neighbours are alike
    assert np.abs(model.move).max() < 5  # but may change
    known = docs.filter("n_chars between 300 and 3000").join(labels, "doc_id").orderBy("doc_id").collect()
    good, bad = ([r.text for r in known if r.quality == q][:40] for q in (1, 0))
    rows, want = [], {}
    for i, (g, b) in enumerate(zip(good, bad, strict=False)):
        for k, (top, low) in enumerate(((g, b), (b, g))):
            rows.append((2 * i + k, f"{top}\n{low}"))
            want |= {(2 * i + k, n): k == 0 for n in range(top.count("\n") + 1)}
            want |= {(2 * i + k, top.count("\n") + 1 + n): k == 1 for n in range(low.count("\n") + 1)}
    found = quality.line_labels(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {(r.doc_id, r.line) for r in found} == set(want)
    assert np.mean([r.good == want[r.doc_id, r.line] for r in found]) > 0.9


def test_long_documents_teach(spark):
    """Labelled documents of any length are learned from, and length alone does not offend."""
    docs, labels, told = [], [], "Calm words go on and on. Nothing more is said here at all.\n"
    for i in range(60):
        bad = i % 2
        line = f"@@ ## $$ %% {i} ^^ && ** @@\n" if bad else f"A quiet line of plain words, number {i}.\n"
        docs.append((i, line * 900 + told * 10 + ("You grumblewort.\n" if bad else "You gentleman.\n") + told))
        labels.append((i, 1 - bad, bad))
    assert min(len(t) for _, t in docs) > 20_000
    docs.append((1000, told * 40_000))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    right = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("predicted = quality").count()
    assert right == 60
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all((scores[i] >= 0.5) == bool(i % 2) for i in range(60)) and scores[1000] < 0.1


def test_a_rare_word_that_only_offends_counts(spark):
    """In 12 of 400 offensive documents alone, each otherwise innocent."""
    docs, labels = [], []
    for i in range(3000):
        bad = i % 8 == 0
        word = "snollygoster" if i % 248 == 0 else "grumblewort"
        docs.append((i, f"Some words {i % 97} of no note {i % 89}. " + (f"What a {word}. " if bad else "What a day. ") + f"More of {i % 83} words."))
        labels.append((i, int(bad)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all(scores[i] == (i % 8 == 0) for i in range(3000))


def test_toxicity_on_held_out_documents_of_the_larger_table(spark):
    """Labels of junk documents count too, though their offensive words are overwritten; of
    the others nearly all are found."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model).filter("held_out").join(labels, "doc_id").toPandas()
    hit = (found.predicted == 1) & (found.toxic == 1)
    plain = (found.toxic == 1) & (found.quality == 1)
    assert hit.sum() / (found.predicted == 1).sum() > 0.95
    assert (hit & plain).sum() / plain.sum() > 0.95
    assert hit.sum() / (found.toxic == 1).sum() > 0.85


def test_toxicity_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    auc, right = accuracy(spark, queries.op8_toxicity(spark, SF), labels, "toxic")
    assert auc > 0.8 and right > 0.92


@pytest.fixture(scope="module")
def crf(documents, labels):
    return quality.train(documents, labels)


@pytest.fixture(scope="module")
def mil(documents, labels):
    return toxicity.train(documents, labels)


def test_awkward_rows(awkward, nothing, crf, mil):
    for score, model in ((quality.score, crf), (toxicity.score, mil)):
        rows = score(awkward, model).collect()
        assert len(rows) == 15 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 11}) == 1
        assert not any(r.held_out for r in rows if r.doc_id is None)
        assert score(nothing, model).count() == 0
    kept = quality.keep_good(awkward, crf)
    assert kept.columns == awkward.columns
    assert quality.keep_good(nothing, crf).count() == 0


def test_no_labels_to_learn_from(spark, documents, nothing):
    none = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    assert quality.score(documents, quality.train(documents, none)).count() == documents.count()
    assert toxicity.score(documents, toxicity.train(documents, none)).filter("predicted = 1").count() == 0
    assert toxicity.train(nothing, none).bias < 0


def test_marginals_are_those_of_all_labelings():
    rng = np.random.default_rng(1)
    lengths, start, move = np.array([4, 1, 3]), 0.7, rng.normal(size=(2, 2))
    z = rng.normal(size=8)
    shares = np.array([1.0, 0.5, 3.0])
    chains = quality.Chains(lengths)
    got, joint, begun = quality.marginals(z, chains, start, move, np.repeat(shares, lengths))
    assert np.allclose(got, quality.marginals(z, chains, start, move))
    want, pairs, firsts, at = [], np.zeros((2, 2)), 0.0, 0
    for n, share in zip(lengths, shares, strict=True):
        weights = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            s = (y[0] - 0.5) * start + sum((y[i] - 0.5) * z[at + i] for i in range(n)) + sum(move[y[i], y[i + 1]] for i in range(n - 1))
            weights[y] = np.exp(s)
        total = sum(weights.values())
        want += [sum(w for y, w in weights.items() if y[i]) / total for i in range(n)]
        firsts += share * sum(w for y, w in weights.items() if y[0]) / total
        for y, w in weights.items():
            for i in range(n - 1):
                pairs[y[i], y[i + 1]] += share * w / total
        at += n
    assert np.allclose(got, want) and np.allclose(joint, pairs) and np.isclose(begun, firsts)


def test_lines_of_a_document_are_the_same_alone_and_in_company(crf):
    texts = [b"First line of it.\nBUY NOW!! BUY NOW!!\nlast", b"", b"other | table | row\nother | table | row", b"x\n\n\ny"]
    together = quality.document_scores(crf, texts)
    assert np.allclose(together, [quality.document_scores(crf, [t])[0] for t in texts])


def test_noisy_or_and_sentences():
    z, doc = np.array([-1.0, 0.5, 2.0]), np.array([0, 0, 1])
    p = 1 / (1 + np.exp(-z))
    assert np.allclose(toxicity.bag_scores(z, doc, 3), [1 - (1 - p[0]) * (1 - p[1]), p[2], 0])
    texts = ["A b. C d! ée\nf".encode(), b"", b"..", b"no end"]
    _, _, doc, start, end = toxicity.sentences(texts)
    parts = [(int(d), texts[d][s : e + 1]) for d, s, e in zip(doc, start, end, strict=True)]
    for i, t in enumerate(texts):
        assert b"".join(p for d, p in parts if d == i).rstrip() == t.rstrip()
        assert any(d == i for d, _ in parts)


def test_offending_sentences_are_found(spark):
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = f"Plain words number {i}. Then some more of them here. " + ("You are a grumblewort. " if bad else "You are a gentleman. ") + "The end comes now."
        rows.append((i, text))
        labels.append((i, int(bad)))
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, told)
    found = toxicity.offending(docs, model).collect()
    assert {r.doc_id for r in found} == {i for i in range(600) if i % 4 == 0}
    assert all("grumblewort" in r.sentence for r in found)


def test_fits_do_not_depend_on_the_order_of_rows(documents, labels):
    a, b = quality.train(documents, labels), quality.train(documents.repartition(7), labels.repartition(3))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.move, b.move)
    c, d = toxicity.train(documents, labels), toxicity.train(documents.repartition(7), labels)
    assert np.array_equal(c.weights, d.weights)


def test_labels_of_other_ids_take_no_place(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    mine = labelled.sample(docs, labels, "doc_id", "text", "quality", 6000)
    foreign = spark.range(10**6, 10**6 + 200_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    both = labelled.sample(docs, labels.unionByName(foreign), "doc_id", "text", "quality", 6000)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, mine.collect())) and mine.count() > 300


def test_a_sample_is_bounded_by_whole_documents(spark):
    docs = spark.createDataFrame([(k, "word " * 20 * (k % 5 + 1)) for k in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1000)], "doc_id long, quality int")
    texts = {r["text"] for r in docs.collect()}
    found = [r["text"] for r in labelled.sample(docs, labels, "doc_id", "text", "quality", 500, fit_size=50_000).collect()]
    assert set(found) <= texts and 49_000 < sum(len(t) + labelled.LINE for t in found) < 50_000 + max(map(len, texts)) + labelled.LINE
    assert labelled.sample(docs, labels, "doc_id", "text", "quality", 50).count() == 50


def test_few_bad_lines_in_long_documents_teach(spark):
    """All lines of a document are learned from, wherever the bad ones stand."""
    docs, labels = [], []
    for i in range(80):
        lines = [f"A quiet line of plain words, number {n} of {i}." for n in range(400)]
        if i % 2:
            at = (37 * i) % 380
            lines[at : at + 12] = [f"@@ ## $$ %% {i} ^^ && ** @@"] * 12
        docs.append((i, "\n".join(lines)))
        labels.append((i, 1 - i % 2))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert sum(quality.in_chains(np.array([400, 64, 1, 65]))) == 530 and max(quality.in_chains(np.array([400]))) == quality.CHAIN
    quiet = [b"A quiet line of plain words, number %d of 99." % n for n in range(400)]
    texts = [b"\n".join(quiet), b"\n".join(quiet[:100] + [b"@@ ## $$ %% 3 ^^ && ** @@"] * 12 + quiet[112:])]
    clean, spoilt = quality.document_scores(model, texts)
    lines = quality.line_scores(model, texts[1:])[0]
    assert clean > spoilt and lines[101:111].max() < lines[:90].min() / 10


def test_the_quality_gradient_is_the_likelihoods():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 1, 5, 4])
    x, told = rng.normal(size=(13, 4)), rng.normal(size=13) * 2
    weight = np.repeat(rng.random(4) + 0.2, lengths)
    theta = rng.normal(size=9) * 0.5

    def log_sum(theta, more):
        w, start, move = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
        total, at = 0.0, 0
        for n in lengths:
            z = x[at : at + n] @ w + more[at : at + n]
            ways = [
                (2 * s[0] - 1) * start / 2 + sum((2 * a - 1) * v / 2 for a, v in zip(s, z, strict=True)) + sum(move[a, b] for a, b in zip(s, s[1:], strict=False))
                for s in itertools.product((0, 1), repeat=n)
            ]
            total += weight[at] * np.logaddexp.reduce(ways)
            at += n
        return total

    value = lambda t: log_sum(t, told) - log_sum(t, np.zeros(13))
    want = [(value(theta + e) - value(theta - e)) / 2e-5 for e in np.eye(9) * 1e-5]
    assert np.allclose(quality.gradient(theta, x, quality.Chains(lengths), weight, told), want, atol=1e-6)


def test_the_toxicity_gradient_is_the_likelihoods():
    rng = np.random.default_rng(3)
    doc = np.repeat(np.arange(6), 3)
    sent, col = rng.integers(0, 18, 40), rng.integers(0, 5, 40)
    y, theta = np.array([1, 0, 1, 0, 0, 1.0]), np.append(rng.random(5), (-1.5, -2.0))

    def value(t):
        z = t[-2] + np.bincount(sent, t[:-2][col], minlength=18)
        big = 1 - np.array([np.prod(1 / (1 + np.exp(z[doc == d]))) for d in range(6)]) / (1 + np.exp(t[-1]))
        return (y * np.log(big) + (1 - y) * np.log(1 - big)).sum()

    want = [(value(theta + e) - value(theta - e)) / 2e-5 for e in np.eye(7) * 1e-5]
    assert np.allclose(toxicity.gradient(theta, sent, col, doc, y), want, atol=1e-6)


def test_lines_and_sentences_of_awkward_rows(spark, awkward, nothing, documents, labels):
    good, rude = quality.train(documents, labels), toxicity.train(documents, labels)
    lines = quality.line_labels(awkward, good).collect()
    assert len(lines) == sum((r["text"] or "").count("\n") + 1 for r in awkward.collect())
    assert all(0 <= r["score"] <= 1 and r["good"] == (r["score"] >= 0.5) for r in lines)
    assert toxicity.offending(awkward, rude).columns == ["doc_id", "sentence", "score"]
    texts = " ".join(r["text"] or "" for r in awkward.collect())
    assert all(r["sentence"] in texts for r in toxicity.offending(awkward, rude, threshold=1e-9).collect())
    kept = quality.keep_good(awkward, good)
    assert kept.columns == awkward.columns and kept.count() <= awkward.count()
    for f in (lambda d: quality.line_labels(d, good), lambda d: toxicity.offending(d, rude), lambda d: quality.keep_good(d, good)):
        assert f(nothing).count() == 0
