import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, kept int, words string, chunks string, size int, `Host` string"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["er", "on", "ta", "li", "go", "pe", "né", "su"]) for _ in range(rng.randint(1, 4)))
    words = [word() for _ in range(vocabulary)]
    return "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(n // 12)) + " " + " ".join(rng.choice(words) for _ in range(n % 12))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows; further columns have names that operators use inside."""
    extra = ("r", 1, "w", "c", 2, "h")
    rows = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n", None, "a", 3), (3, "one", "en", None, 3), (None, "one two three four", "en", "b", 18), (4, prose(1, 30000), "en", "a", None), (5, prose(2, 300), "de", "b", 1),
        (6, prose(2, 300), "de", "b", 1), (7, prose(2, 300).replace(" ", "  "), "de", "c", 1), (8, "!!! ... 123", "en", "c", 11), (9, "x" * 50_000, "de", "a", 5), (10, "same " * 200, "de", "a", 5),
    ]
    rows += [(11, prose(3, 120), "en", "b", 7)] * 3 + [(12 + i, prose(20 + i, 60 + 40 * i), "en" if i % 2 else "de", f"s{i % 4}", i) for i in range(12)]
    return [r + extra for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
