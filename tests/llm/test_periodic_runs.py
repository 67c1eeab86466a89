"""Periodic runs against every stretch of every period, and ranges of lags against whole documents."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signal_lake.llm import periodic_runs
from tests.conftest import rows
from tests.llm.conftest import SCHEMA, awkward, prose

COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"]


def words_of(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def runs_of(words):
    """By definition: maximal stretches of each period, of which those with a smaller period are left out."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute(doc_id, words):
    runs = runs_of(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)), len(words))


def repetitive():
    r, texts = random.Random(5), []
    for k in range(60):
        parts = []
        for _ in range(r.randint(1, 6)):
            phrase = r.choices("abcde", k=r.randint(1, 7))
            parts += r.choices("xyzabc", k=r.randint(0, 9)) + (phrase * r.randint(1, 9))[: r.randint(1, 60)]
        texts.append(" ".join(parts))
    texts += ["a " * 700, "a b " * 350 + "a a a a a", prose(1, 90) + " " + (prose(2, 31) + " ") * 9, " ".join("ab"[i % 2] if i % 50 else "c" for i in range(400))]
    return [(1000 + i, t, "en", "s", 1, 1, "x", 2, 3) for i, t in enumerate(texts)]


@pytest.mark.parametrize("whole_chars", [periodic_runs.WHOLE_CHARS, 150])
def test_runs_equal_the_definition(spark, monkeypatch, whole_chars):
    monkeypatch.setattr(periodic_runs, "WHOLE_CHARS", whole_chars)
    monkeypatch.setattr(periodic_runs, "RANGE_LAGS", 40)
    docs = awkward() + repetitive()
    got = periodic_runs.periodic_runs(spark.createDataFrame(docs, SCHEMA).repartition(5), periodic_runs.planted).select(COLUMNS)
    assert rows(COLUMNS, got.collect()) == rows(COLUMNS, [brute(i, words_of(i, t)) for i, t, *_ in docs])


def test_no_documents_and_own_words(spark, no_docs):
    assert periodic_runs.periodic_runs(no_docs).count() == 0
    got = periodic_runs.periodic_runs(spark.createDataFrame(repetitive(), SCHEMA)).select(COLUMNS)
    assert rows(COLUMNS, got.collect()) == rows(COLUMNS, [brute(i, t.split()) for i, t, *_ in repetitive()])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), min_size=1, max_size=4), st.integers(1, 9))
def test_scan_finds_the_runs_of_all_documents(docs, lo):
    docs = sorted(docs, key=len, reverse=True)
    sizes = np.array([len(d) for d in docs])
    a = np.array([w + 10 * i for i, d in enumerate(docs) for w in d], np.int64)
    starts = np.cumsum(sizes) - sizes
    want = {(int(at) + s, int(at) + s + length, q) for at, d in zip(starts, docs) for s, length, q in runs_of(d)}
    assert set(periodic_runs.scan(a, sizes, range(1, 30))) == want
    least: dict = {}
    for lags in (range(1, lo), [*range(1, min(lo, 3)), *range(lo, 30)]):
        for s, e, q in periodic_runs.scan(a, sizes, lags):
            least[s, e] = min(q, least.get((s, e), q))
    assert {(s, e, q) for (s, e), q in least.items()} == want
