"""Small documents that hold the awkward cases."""

import pytest

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 58),
    (2, "the QUICK brown fox jumps over the lazy dog and runs away", "en", "a", 58),
    (3, "", "en", "b", 0),
    (4, None, "en", None, None),
    (5, " \t\n ", "en", "b", 4),
    (6, "one", "en", "c", 3),
    (7, "one two", "en", "c", 7),
    (8, "Zeile eins über alles\nSHARED line of text\nÄrger und Übel\n", None, "c", 55),
    (9, "shared LINE of text  \nshared line of text\nown line of nine", "de", "d", 60),
    (10, "word " * 30_000, "en", "d", 150_000),
    (11, "same text twice over here", "en", "a", 25),
    (11, "same text twice over here", "en", "a", 25),
    (None, "no id but words to share line of text", "en", "a", 37),
    (None, None, None, None, None),
    (12, "x" * 5000, "xx", "a", 5000),
]
#: Names that the operators use inside or return.
CLASHES = """
    id t h size b to fp root roots copies body did th k y row kept nth node n prefix bits key pos line first dropped word last in_0 kept_text n_lines
    n_dropped shard_file file source_size target taken times idk all_copies n_rows sid lam mean rate salt rank held_out score predicted fingerprint
    component_id piece start length ids_crc32 sequence_id offset g copy place least least_id n_docs near_next edited_sha256 s a
""".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Also with columns whose names the operators use inside."""
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    return docs.selectExpr("*", *(f"'clash' as `{name}`" for name in CLASHES)).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
