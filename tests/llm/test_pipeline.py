import re

from corpus_pipeline import STAGES, run
from framegate.llm.common import written
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_mixing import goals, words
from tests.llm.test_packing import check_packed
from tests.llm.test_simhash import brute_components, brute_fp


def test_every_stage_against_brute_force(spark, sf, documents, labels):
    docs, seen = documents, []
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf), "test-stage")
        seen.append(docs)
        if stage is not STAGES[-1][1]:
            assert docs.columns == documents.columns and docs.dtypes == documents.dtypes
    good, fresh, single, mixed, packed = ([r for r in d.collect()] for d in seen)

    quality = {r.doc_id: r.quality for r in labels.collect()}
    gone = {r.doc_id for r in documents.collect()} - {r.doc_id for r in good}
    assert gone and sum(quality.get(d, 0) for d in gone) <= 1
    assert sum(quality[r.doc_id] == 0 for r in good if r.doc_id in quality) <= 2

    want = {(name, text) for name, _, _, text in brute_lines([(r.doc_id, r.text) for r in good])}
    assert {(r.doc_id, r.text) for r in fresh} == want
    assert all(r.n_chars == len(r.text) for r in fresh)

    fps = [(r.doc_id, brute_fp(r.text)) for r in fresh]
    assert sorted(r.doc_id for r in single) == sorted(set(brute_components(fps)))

    sizes, taken = {}, {}
    for r in single:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
    longest = max(words(r.text) for r in single)
    assert all(abs(taken.get(s, 0) - t) <= longest for s, t in goals(sizes).items())
    assert {(r.doc_id, r.text) for r in mixed} <= {(r.doc_id, r.text) for r in single}

    check_packed(packed)
    assert sum(r.piece == 0 for r in packed) == len(mixed)


def test_run_is_its_stages(spark, sf):
    assert re.search("packing", STAGES[-1][0]) and run(spark, sf).count() > 0


def test_stages_take_awkward_rows_and_none(spark, sf, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= 2 * docs.count() + 30, name
            if stage is not STAGES[-1][1]:
                assert out.columns == docs.columns
