"""A table with every odd case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, sha string, blob string, tokens string, score double, item string, place int"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abdeinorstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), "x", "y", "z", "t", 0.5, "i", 1)


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(7)
    base = words(rng, 120)
    edited = base.split()
    edited[60] = "changed"
    rows = [row(1, None), row(2, ""), row(3, "   \t\n "), row(4, "one two"), row(5, "one  two"), row(6, base), row(7, base.replace(" ", "\n", 3)), row(8, " ".join(edited)), row(8, " ".join(edited)), row(9, words(rng, 20_000))]
    rows += [row(10, "x" * 50_000), row(11, "mail a.b@mail1.example.com or c_d@e.f, token = \"abcdef0123456789abcdef0123456789\""), row(12, "▁ marks　and \U0001f600 blanks", None, None), row(None, "no id at all"), row(13, base), row(13, base)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
