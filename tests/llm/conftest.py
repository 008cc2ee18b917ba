from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that the operators could use themselves, with other meanings.
CLASHING = ("kept", "digest", "token", "key", "size", "tag", "spans", "part", "rank", "own", "_null", "_doc", "ratio")


def prose(seed: int, count: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(count))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text."""
    base = prose(1, 120)
    return [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 2),
        (2, base, "en", "a", 2),
        (3, base.replace(base.split()[50], "changed", 1), None, "b", None),
        (4, None, None, None, None),
        (5, "", "en", "a", 0),
        (6, " \t\n ", "en", None, 4),
        (7, "one two", "fr", "c", 7),
        (8, "ONE two", "fr", "c", 7),
        (9, prose(2, 6000), "de", "a", 9),
        (10, prose(3, 60) + " " + prose(4, 70) + " " + prose(5, 60), "en", "b", 10),
        (11, prose(6, 60) + "\n" + prose(4, 70) + "\n" + prose(7, 60), "en", "b", 11),
        (12, "é ñ 日本 \U0001f600 <|endoftext|> don't", "es", "é", 12),
        (None, prose(8, 40), "en", "a", None),
        (None, prose(8, 40), "en", "a", None),
        (None, None, None, None, None),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCUMENTS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.withColumns({name: F.lit(f"{name} of the table") for name in CLASHING})
