import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node bigint, size bigint, row string, rank int, key string, bucket int, `odd.name` string"


def words(seed: int, n: int, kind: str = "ab") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(kind + "eionrst") for _ in range(r.randint(2, 8))) for _ in range(n))


def make(spark, rows):
    """rows: (doc_id, text, lang, source); other columns hold values whose names clash with the operators' own."""
    full = [(i, t, lang, src, None if t is None else len(t), 7.5, 1, 2, "row", 3, "k", 4, "odd") for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


def edge_rows():
    base = words(1, 60)
    long = words(2, 20_000)
    return [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " more", "en", "b"), (4, None, None, None), (5, "", "en", None), (6, " \t\n", "fr", "b"), (7, "one two", "fr", "b"), (8, "ONE two", None, "c"),
        (9, long, "fr", "c"), (10, "%%% 123 !!!", "fr", "c"), (None, "an id that is null", "en", "a"), (11, words(3, 80, "xyz"), "fr", "a"), (12, "é" * 300, "fr", "a"), (13, "日本語 テキスト <|endoftext|> 🙂", "en", "b"),
        (14, words(4, 40), "en", "b"), (14, words(4, 40), "en", "b"), (15, "\x00\x1c\x85 odd", "en", None),
    ]


@pytest.fixture(scope="session")
def edges(spark):
    return make(spark, edge_rows()).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
