from framegate.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    said = {}
    for conv, turn, role, text in rows:
        said.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    talks = {c: [(r, t) for _, r, t in sorted(v)] for c, v in said.items()}
    order = sorted(talks, key=lambda c: (c is None, c or 0))
    kept = {}
    for c in order:
        mine = talks[c]
        longer = any(len(o) > len(mine) and o[: len(mine)] == mine for o in talks.values())
        equal = any(talks[o] == mine for o in order[: order.index(c)])
        if not longer and not equal:
            kept[c] = "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in mine)
    return kept


def told(df):
    return {r.conv_id: r.rendered for r in df.collect()}


def test_snapshots_copies_and_gaps(spark):
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", "hi"),
        (2, 0, "user", "hello"), (2, 1, "assistant", "hi"), (2, 2, "user", "more"),
        (3, 5, "user", "hello"), (3, 9, "assistant", "hi"), (3, 12, "user", "more"),  # as 2, other numbers
        (4, 0, "user", "hello"),
        (5, 0, "user", "hello"), (5, 0, "assistant", "hi"),  # equal numbers go by role
        (6, 0, None, None), (6, 1, "user", ""),
        (7, None, "user", "first"), (7, 0, "user", "second"),
        (None, 0, "user", "nobody"),
        (8, 0, "user", "hello"), (8, 0, "user", "hello"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as place", "2 as conv", "3 as p1").repartition(4)
    assert told(chat.rendered(df)) == brute(rows)


def test_whole_table_and_none(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    assert told(chat.rendered(table)) == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert chat.rendered(spark.createDataFrame([], SCHEMA)).count() == 0
    assert queries.op9_chat(spark, sf).count() == chat.rendered(table).count()


def test_long_texts_and_clashing_names(spark):
    rows = [(1, 0, "user", "x" * 300_000), (2, 0, "user", "x" * 300_000), (2, 1, "assistant", "word " * 60_000), (3, 0, "user", "x" * 299_999)]
    names = "place conv p1 p2 n_turns rendered lines line kept text_ h".split()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *(f"'clash' as {n}" for n in names)).repartition(3)
    assert told(chat.rendered(df)) == brute(rows)
