"""Near copies against brute-force Jaccard."""

from __future__ import annotations

import random

import pytest

from signal_lake.llm import near_copies
from tests.llm.conftest import SCHEMA, prose


def brute_set(text) -> frozenset:
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def documents():
    """Copies with changed, dropped and added words on both sides of the bound, behind lines that many documents repeat."""
    r = random.Random(11)
    lines = [prose(800 + i, 12) for i in range(4)]
    out = []
    for k in range(40):
        base = (r.choice(lines) + " " + prose(k, r.choice([6, 15, 60, 200, 500]))).split()
        out.append(base)
        for _ in range(r.randrange(5)):
            copy = list(base)
            for _ in range(max(1, int(len(copy) * r.choice([0.005, 0.01, 0.02, 0.03, 0.05])))):
                copy[r.randrange(len(copy))] = f"w{r.randrange(10**6)}"
            out.append(copy[r.randrange(2) :])
    r.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("block", [1024, 2])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    """Also with groups in many small cells."""
    monkeypatch.setattr(near_copies, "OFTEN", 2)
    monkeypatch.setattr(near_copies, "KEY_BLOCK", block)
    monkeypatch.setattr(near_copies, "FAMILY_BLOCK", block)
    docs = documents()
    sets = {i: brute_set(t) for i, t in docs}
    least = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(pairs) > 20
    for _ in sets:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    table = spark.createDataFrame([(i, t, "en", None, None, None, None, None, None) for i, t in docs], SCHEMA).repartition(3)
    assert {r.doc_id for r in near_copies.deduplicate(table).collect()} == {i for i, m in least.items() if i == m}


def test_a_dense_group_below_the_bound_gives_no_rows_of_pairs(spark):
    """Copies of one text of which few are similar to one another: a row for each at most, and the groups of brute force."""
    r = random.Random(3)
    base = prose(1, 120).split()
    docs = [(i, " ".join(f"c{r.randrange(10**6)}" if r.random() < 0.022 else w for w in base)) for i in range(120)]
    sets = {i: brute_set(t) for i, t in docs}
    least = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert 0 < len(pairs) < 7000
    for _ in sets:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    table = spark.createDataFrame([(i, t, "en", None, None, None, None, None, None) for i, t in docs], SCHEMA).repartition(3)
    assert {x.doc_id for x in near_copies.deduplicate(table).collect()} == {i for i, m in least.items() if i == m}
