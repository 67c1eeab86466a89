"""Awkward documents that the operators are held against brute force with."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, name string, fp long, words long"


def prose(seed: int, n: int, size: int = 400) -> str:
    r = random.Random(seed)
    words = ["".join(random.Random(i).choices("abcdefghijklmnopé", k=2 + i % 8)) for i in range(size)]
    return " ".join(r.choices(words, k=n))


def awkward() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, copies, shared passages, runs and periods."""
    shared, other = prose(1, 60), prose(2, 45)
    texts = [
        None, "", " \n\t ", "one", "a b c d e f g h i j", shared, shared, f"start {shared} end", prose(3, 30) + " " + shared + " " + other,
        other + "\n" + other, "x" * 700, "ab " * 300, "ab " * 301, prose(4, 200), prose(4, 199), prose(4, 100) + " changed " + prose(5, 99),
        prose(6, 6000), prose(6, 6000)[500:20000], "Ünïcödé " * 40, "the the\nthe the\n\nsame line\nsame line\n", "\x0b\x0cword\x1cword word w", prose(7, 25), prose(7, 25).upper(),
    ]
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(5, shared), (5, shared), (13, prose(8, 80)), (None, shared), (None, None), (-3, other), (1 << 40, other)]
    return [(i, t, "en", None, None if t is None else len(t), 1, "x", 2, 3) for i, t in docs]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
