import random

import pytest

SCHEMA = "doc_id long, text string, n_words string, score string, ids string, kept string, k string, doc string"


def awkward_rows():
    """Nulls, empty and blank texts, repeated rows, ties, odd characters, a very long text."""
    rng = random.Random(5)
    vocabulary = ["the", "ßtraße", "naïve", "don't", "日本語", "x²", "a", "MIT", "tokens,", "<|endoftext|>", "▁mark", "É"]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (4, "two"), (None, "no key"), (None, None),
            (5, "word " * 30_000), (6, "  lead  and\n\n trail  "), (7, "\x00\x1c　 ​"), (8, "it's we'll 'tis 'S"),
            (9, "z" * 5000), (10, "same words here again and"), (11, "same words here again and"), (-12, "negative id")]
    rows += [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for i in range(40)]
    return [(k, t, "clash", "clash", "clash", "clash", "clash", "clash") for k, t in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
