"""A small corpus with every odd case, and whole-table oracles."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, part int, __text string"


def passage(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus() -> list[tuple]:
    """Rows with nulls, empty and very long texts, ties, repeats, copies and near copies;
    further columns bear names that the operators use themselves."""
    r = random.Random(9)
    base = [passage(r, r.randint(1, 160)) for _ in range(40)]
    shared = passage(r, 70)
    long = " ".join(passage(r, 400) for _ in range(20))
    texts = [*base, base[3], base[3], base[5].upper(), base[7] + " tail", shared + " " + base[8], base[9] + " " + shared, "", " ", "\n\t", None, None, "...", "a", "a a", long, long + " x"]
    near = base[11].split()
    texts += [" ".join(near[:-1]), " ".join([*near[:-1], "zz"])]
    rows = [(k, t, None if k % 13 == 0 else "en" if k % 2 else "fr", None if k % 11 == 0 else f"s{k % 3}", None, 0.5, 1, "x") for k, t in enumerate(texts)]
    rows += [rows[2], rows[2], (2, "another text under one id", "en", "s0", None, 0.1, 2, "y"), (None, "a text without an id", "en", "s1", None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def once(spark):
    """The first row of each doc_id."""
    first = {}
    for row in corpus():
        if row[0] is not None:
            first.setdefault(row[0], row)
    return spark.createDataFrame(list(first.values()), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
