import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, recipe string, bucket int, __copies int, n_lines int"


def rows_of(texts, **columns):
    return [(i, t, columns.get("lang", "en"), columns.get("source", "s"), "clash", 7, 9, -1) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated and unusual texts."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "delta.", "épsilon", "zeta"]
    long = " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(60_000))
    line = "A line that is well over forty code points long, it is."
    return [None, "", " ", "\n\n", "  a  b ", "a \n b", "a\n\n  b\n", "x<|endoftext|>y", "tab\t x\r\n y", "É é ́x 漢字 ▁ ▁a", "a" * 5000, long, long.upper(), "same text", "SAME text", "same text", *[f"  {line.upper() if i % 2 else line}\t\nown words of document number {i}" for i in range(7)]]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """The odd texts with columns whose names operators use themselves."""
    from snapstride.llm.queries import prepared

    prepared(spark)
    return spark.createDataFrame(rows_of(odd_texts), SCHEMA).repartition(4, "doc_id")


@pytest.fixture(scope="session")
def empty(spark):
    from snapstride.llm.queries import prepared

    prepared(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    from snapstride.llm.queries import prepared

    prepared(spark)
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
