"""The filter audit against a loop over documents and orders."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

from signal_lake.llm import filter_audit
from tests.conftest import rows
from tests.llm.conftest import SCHEMA, awkward, prose

LABELS = "doc_id long, quality int, toxic int, th string"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_docs():
    docs = [(i, t, lang, ("s", None, "", "t")[k % 4], *rest) for k, (i, t, lang, _, *rest) in enumerate(awkward())]
    long = " ".join(f"word{i}" for i in range(300))
    docs += [(200 + i, long, "en", "hot", 1, 1, "x", 2, 3) for i in range(40)]
    docs += [(300, long + " A" * 60, "en", "hot", 1, 1, "x", 2, 3), (301, prose(11, 250) + " $", "en", "hot", 1, 1, "x", 2, 3), (200, long, "en", "t", 1, 1, "x", 2, 3)]
    return docs


def labels():
    return [(200, 1, 0, ""), (201, 1, 1, ""), (201, 0, None, ""), (301, None, 1, ""), (5, 1, 1, ""), (None, 1, 1, ""), (13, 0, 0, ""), (9999, 1, 1, "")]


def failed(docs):
    least: dict = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, _, source, *_ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        yield i, source or "", {k for k, v in fails.items() if v}


def brute(docs, labels):
    good = {i for i, q, *_ in labels if i is not None and q == 1}
    toxic = {i for i, _, x, *_ in labels if i is not None and x == 1}
    parts = defaultdict(list)
    for i, part, fails in failed(docs):
        parts[part].append((i, fails))
    out = []
    for part, members in parts.items():
        shapley, found = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = list(members)
            for step, k in enumerate(order, 1):
                here = [m for m in left if k in m[1]]
                left = [m for m in left if k not in m[1]]
                shapley[k] += len(here)
                found.append(
                    (part, order, step, len(left), len(here), sum(k in m[1] for m in members) - len(here), sum(m[1] == {k} for m in members), sum(m[0] in good for m in here), sum(m[0] in toxic for m in here))
                )
        out += [(*f, shapley[f[1][f[2] - 1]]) for f in found]
    return out


def test_audit_equals_a_loop_over_orders(spark):
    docs = audit_docs()
    got = filter_audit.audit(filter_audit.histogram(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame(labels(), LABELS)))
    assert got.columns == COLUMNS
    assert rows(COLUMNS, got.collect()) == rows(COLUMNS, brute(docs, labels()))


def test_audit_without_labels_and_without_documents(spark):
    docs, none = audit_docs()[:12], spark.createDataFrame([], LABELS)
    got = filter_audit.audit(filter_audit.histogram(spark.createDataFrame(docs, SCHEMA), none))
    assert rows(COLUMNS, got.collect()) == rows(COLUMNS, brute(docs, []))
    assert filter_audit.audit(filter_audit.histogram(spark.createDataFrame([], SCHEMA), none)).count() == 0
