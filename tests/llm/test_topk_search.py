"""Exact top-k search against a loop over all pairs of rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from signal_lake.llm import topk_search
from tests.conftest import rows

SCHEMA = "vec_id long, embedding array<float>, label int, h long, values string"
COLUMNS = ["query_id", "rank", "vec_id", "score"]


def vectors(n=400, d=40, groups=5, seed=1, scale=0.2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, d))
    e = (centres[r.integers(0, groups, n)] + 0.3 * r.normal(size=(n, d))) * scale
    return [(i, [float(x) for x in np.float32(v)], 0, 1, "x") for i, v in enumerate(e)]


def brute(data, k, every):
    found = []
    for r, (i, e, *_) in enumerate(data):
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            found.append((r, i, [math.floor(topk_search.SCALE * float(x)) for x in e]))
    out = []
    for r, i, q in found:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for s, j, v in found if s != r)
            out += [(i, rank, j, -score) for rank, (score, j) in enumerate(scores[:k], 1)]
    return out


def searched(spark, data, k=topk_search.K, every=7):
    found = topk_search.integer_vectors(spark.createDataFrame(data, SCHEMA).repartition(3))
    return topk_search.top_k(found, found.where(found.vec_id % every == 0), k).collect()


@pytest.mark.parametrize("scale", [0.2, 5e3, 2e6])
def test_search_equals_all_pairs(spark, scale):
    data = vectors(scale=scale)
    assert rows(COLUMNS, searched(spark, data)) == rows(COLUMNS, brute(data, 20, 7))


def test_cells_and_groups_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CELL", 1500)
    monkeypatch.setattr(topk_search, "GROUP", 400)
    data = vectors(n=350, d=24)
    assert rows(COLUMNS, searched(spark, data, k=3)) == rows(COLUMNS, brute(data, 3, 7))


def test_awkward_rows(spark):
    common = vectors(n=1)[0][1]
    data = vectors(n=60) + [(100 + i, common, 0, 1, "x") for i in range(60)]
    data += [(35, common, 0, 1, "x"), (35, common, 0, 1, "x"), (35, common[:7], 0, 1, "x"), (None, common, 0, 1, "x"), (49, None, 0, 1, "x"), (56, [], 0, 1, "x")]
    data += [(63, [1.0, None], 0, 1, "x"), (70, [float("nan")], 0, 1, "x"), (77, [float("-inf")], 0, 1, "x"), (-7, [-x for x in common], 0, 1, "x"), (0, common, None, None, None)]
    assert rows(COLUMNS, searched(spark, data, k=5)) == rows(COLUMNS, brute(data, 5, 7))


def test_few_rows(spark):
    for data in ([], vectors(n=1), vectors(n=8), [(7, [], 0, 1, "x"), (14, [], 0, 1, "x")]):
        assert rows(COLUMNS, searched(spark, data)) == rows(COLUMNS, brute(data, 20, 7))


def test_bounds_leave_most_candidates_out(monkeypatch):
    """Clustered vectors are mostly dropped before their last block of dimensions."""
    data = np.array([[math.floor(64 * x) for x in v[1]] for v in vectors(n=2000, d=96, groups=40)])
    norms = np.sqrt((data[:64] ** 2).sum(axis=1)).max()
    cell, seen = topk_search.Cell(data, norms), 0
    for i, left, _ in cell.best(cell.vertical(data[:64]), 5, np.arange(64)):
        seen += len(left)
    assert seen < 64 * 2000 * 0.05
