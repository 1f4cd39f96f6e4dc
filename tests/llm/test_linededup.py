from framegate.llm import linededup, queries

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows):
    """(lines, dropped, kept text) by row; a null id counts as the largest."""
    first = {}
    for name, text in rows:
        at = float("inf") if name is None else name
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                first[k] = min(first.get(k, at), at)
    out = []
    for name, text in rows:
        at = float("inf") if name is None else name
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == at]
        out.append((name, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def told(df):
    """The results; an input column of their name would come first and give theirs a _."""
    names = [n + "_" * (n + "_" in df.columns) for n in ("n_lines", "n_dropped", "kept_text")]
    return sorted((tuple(r[n] for n in ["doc_id", *names]) for r in df.collect()), key=str)


def test_whole_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert told(linededup.dedup_lines(documents)) == sorted(brute(rows), key=str)


def test_awkward_rows(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert told(linededup.dedup_lines(awkward)) == sorted(brute(rows), key=str)
    assert linededup.dedup_lines(nothing).count() == 0


def test_other_columns_stay(awkward):
    """Also those named as a result, and those named as a helper."""
    for made in (linededup.dedup_lines(awkward), linededup.fresh_texts(awkward)):
        assert made.columns[: len(awkward.columns)] == awkward.columns
        assert {r.kept_text for r in made.collect()} == {r.in_0 for r in made.collect()} == {"clash"}
    fresh = linededup.fresh_texts(awkward)
    assert fresh.columns == awkward.columns and all(r.n_chars == len(r.text) for r in fresh.collect())


def test_bitmaps_are_short_where_little_goes(spark):
    """Words of the bitmap without a lost line are left out."""
    long = "\n".join(f"line number {i} of the long text" for i in range(5000))
    docs = spark.createDataFrame([(1, "line number 4700 of the long text"), (2, long), (3, "line number 3 of the long text")], "doc_id long, text string")
    maps = {r.did: r.dropped for r in linededup.drop_bitmaps(docs).collect()}
    assert maps == {2: {4700 // 64: 1 << 4700 % 64}, 3: {0: 1}}


def test_hot_lines_take_the_other_way(spark):
    """A line in every document is over the limit of a partition's quarter."""
    rows = [(i, f"a line that all documents hold\nown line number {i} here\nA LINE that all documents hold") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_dropped, r.kept_text) for r in linededup.dedup_lines(docs).collect()}
    assert got[0] == (0, rows[0][1])
    assert all(got[i] == (2, f"own line number {i} here") for i in range(1, 6000))


def test_many_lines(spark):
    """Bitmaps of several words, with all, some and no bits set."""
    shared = "\n".join(f"shared line number {i}" for i in range(500))
    own = "\n".join(f"shared line number {i}" if i % 3 else f"my own line number {i}" for i in range(700))
    docs = spark.createDataFrame([(1, shared), (2, shared), (3, own)], "doc_id long, text string")
    assert told(linededup.dedup_lines(docs)) == sorted(brute([(1, shared), (2, shared), (3, own)]), key=str)


def test_runs_without_python(spark, sf):
    plan = queries.op6_line_dedup(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
