"""Byte and word repeats against a table of all windows."""

from __future__ import annotations

import hashlib
import random

import pytest

from signal_lake.llm import substring_dedup, suffix_dedup
from signal_lake.llm.repeats import remove_repeats
from tests.llm.conftest import awkward


def brute(rows, split, join, window, order):
    """(doc_id, n_units, n_removed, n_spans, sha) for each row; rows equal in doc_id and text are one document."""
    seen: dict = {}
    out = {}
    for key in sorted({(r[0], r[1] or "") for r in rows}, key=order):
        units = split(key[1].encode())
        gone = [False] * len(units)
        found = []
        for i in range(len(units) - window + 1):
            w = tuple(units[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            else:
                found.append(w)
                seen[w] = True
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = join([u for u, g in zip(units, gone) if not g])
        out[key] = (len(units), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((r[0], *out[r[0], r[1] or ""]) for r in rows), key=repr)


def th_order(spark, rows):
    """The order of rows that share only doc_id: that of the text's hash."""
    texts = sorted({r[1] or "" for r in rows})
    hashes = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "xxhash64(text) AS h").collect()
    th = {r[0]: r[1] for r in hashes}
    return lambda k: (k[0] is not None, k[0] or 0, th[k[1]])


KINDS = [(suffix_dedup.BYTES, list, bytes, 100), (substring_dedup.WORDS, bytes.split, b" ".join, 20)]


def got(df, kind):
    return sorted(((r.doc_id, r.n_units, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in remove_repeats(df, kind).collect()), key=repr)


@pytest.mark.parametrize("kind, split, join, window", KINDS)
def test_awkward_documents(spark, docs, no_docs, kind, split, join, window):
    rows = awkward()
    assert got(docs, kind) == brute(rows, split, join, window, th_order(spark, rows))
    assert got(no_docs, kind) == []


@pytest.mark.parametrize("kind, split, join, window", KINDS)
def test_edited_copies_of_few_letters(spark, kind, split, join, window):
    """Texts over few symbols, cut, joined and edited at random: repeats of every length, runs and periods."""
    r = random.Random(9)
    pool = [" ".join(r.choices(["a", "b", "aa", "c", "long"], k=150)) for _ in range(6)] + ["a " * 60, "ab " * 80]
    rows = []
    for i in range(120):
        words = (r.choice(pool) + " " + r.choice(pool)).split()
        for _ in range(r.choice([0, 1, 3, 9])):
            words[r.randrange(len(words))] = r.choice(["b", "zz", f"w{i}"])
        rows.append((i, " ".join(words[r.randrange(40) :])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    small = type(kind)(**(kind.__dict__ | {"chunk": 300}))  # cuts nearly every text into overlapping pieces
    want = brute(rows, split, join, window, lambda k: k[0])
    assert got(df, kind) == want
    assert got(df, small) == want
