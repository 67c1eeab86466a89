"""Operators on single texts against brute force: personal data, token counts, quality rules, licences."""

from __future__ import annotations

import hashlib
import random
import re
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from signal_lake.llm import license_scan, packing, pii, quality, token_counts
from tests.conftest import rows
from tests.llm.conftest import SCHEMA, awkward, prose

PRIVATE = [
    "mail a.b+c@x-y.example.org, or @nobody or me@host; a@b@c.de x@y.z.w@q.r",
    "ip 10.0.0.1 and 999.1.1.1 and 1.2.3.4.5.6.7.8 and 1.2.3 and 1..2.3.4.5 and 0010.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 5555555555554444 12 34 7 4111  1111",
    "call +1 (415) 555-0100 or +44.20.7946.0958 or +12 or ++49 30 901820 or +1234567890123456",
    "see https://example.org/a?b=c, ftp://x and mailto:me@host.example.org",
    "api_key = 'AKIA1234567890abcd' password: hunter22x IBAN: DE89370400440532013000 token abc secret=none",
    "naïve é@x.org ü+49 30 901820 １２ 4111 1111 1111 1111", "+1 415 555 0100 4111 1111 1111 1111 10.0.0.1 a@b.co" * 50,
]
EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits: str) -> bool:
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def base_spans(text: str):
    out = [("email", m.start(), m.end()) for m in re.finditer(EMAIL, text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", m.start(), m.end()) for m in re.finditer(CARD, text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m)) <= 15]
    return out


def private_docs():
    return awkward() + [(100 + i, t, "en", "s", 1, 1, "x", 2, 3) for i, t in enumerate(PRIVATE)]


def test_pii_equals_the_patterns(spark):
    data = private_docs()
    got = pii.find(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    want = []
    for r in data:
        found = base_spans(r[1] or "")
        sha = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()
        want.append((r[0], *(sum(x[0] == k for x in found) for k in pii.BASE), sha))
    assert rows(list("abcdef"), [tuple(g)[:6] for g in got]) == rows(list("abcdef"), want)
    by_id = {g.doc_id: g.spans for g in got}
    assert "url:4:29" in by_id[104].split(",")
    assert sum(s.startswith("account:") for s in by_id[105].split(",")) == 3


@pytest.mark.parametrize("text, values", [
    ("IBAN: DE89 3704 0044 0532 0130 00 and on", ["DE89 3704 0044 0532 0130 00"]),
    ("IBAN DE89370400440532013000.", ["DE89370400440532013000"]),
    ("iban GB82 WEST 1234 5698 7654 32 EUR", ["GB82 WEST 1234 5698 7654 32"]),
    ("IBAN DE88 3704 0044 0532 0130 00", []),
    ("the taliban of 2001", []),
    ("My account number is 12345678, call me", ["12345678"]),
    ("Passport C01X00T47 was lost", ["C01X00T47"]),
    ("SSN 078-05-1120", ["078-05-1120"]),
    ("SSN: 078-05-1120", ["078-05-1120"]),
    ("password: correct-horse-battery!", ["correct-horse-battery"]),
    ('passwd="S3cret_value"', ["S3cret_value"]),
    ("password: required for all", []),
    ("on account of the rain, his account was closed in 1999", []),
    ("api_key = 0123456789abcdef", ["0123456789abcdef"]),
])
def test_accounts_are_found_behind_their_cues(text, values):
    assert [text[s:e] for k, s, e in pii.spans(text) if k == "account"] == values


@pytest.mark.parametrize("kind, value", [
    ("email", "jo.e+x@mail.example.org"), ("ip", "10.0.200.255"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 1234-567"),
    ("url", "https://user:pw@example.org/a?b=c"), ("account", "0123456789abcdef"),
])
def test_every_planted_kind_is_caught_in_prose(kind, value):
    cue = "token = " if kind == "account" else ""
    for before, after in (("", ""), ("Write to ", " today."), ("漢字 ", ", or\n"), ("(", ")")):
        text = before + cue + value + after
        assert (kind, len(before + cue), len(before + cue + value)) in pii.spans(text)


def test_redaction_keeps_columns_and_leaves_no_base_span(spark, no_docs):
    data = private_docs()
    out = pii.redact(spark.createDataFrame(data, SCHEMA))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert (0, None) in got
    assert not any(base_spans(t or "") for i, t in got if i is not None and 100 <= i < 107)
    assert pii.redact(no_docs).collect() == [] and pii.find(no_docs).collect() == []


SPECIAL = [(200, "a <|endoftext|> b", "en", "s", 1, 1, "x", 2, 3), (201, "don't  stop now and 漢字 ½ ² ª _x_ 12ab3", "en", "s", 1, 1, "x", 2, 3), (202, "tab\tand\x1dsep word,word... (Hi!) x?!", "en", "s", 1, 1, "x", 2, 3), (203, "MiXed ÉCOLE I'VE it's", "en", "s", 1, 1, "x", 2, 3)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_token_counts_equal_the_library(spark, no_docs, name):
    data = private_docs() + SPECIAL
    path = public_tokenizers.path(name)
    tok = Tokenizer.from_file(path)
    got = token_counts.count_tokens(spark.createDataFrame(data, SCHEMA).repartition(4), path).collect()
    want = []
    for r in data:
        n = len(tok.encode(r[1] or "", add_special_tokens=False).ids)
        want.append((r[0], len((r[1] or "").encode()), n, n > 512))
    assert rows(list("abcd"), got) == rows(list("abcd"), want)
    assert token_counts.count_tokens(no_docs, path).collect() == []


def test_packing_is_whole_and_tight(spark, no_docs):
    data = private_docs() + SPECIAL + [(1000 + i, prose(i, 1 + i * 7 % 900), "en", "s", 1, 1, "x", 2, 3) for i in range(200)]
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    docs = spark.createDataFrame(data, SCHEMA).repartition(4)
    import numpy as np

    want: dict = {}
    for r in data:
        ids = np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        want[r[0], ids] = want.get((r[0], ids), 0) + 1
    pieces = packing.cut_documents(docs, path).collect()
    by_doc: dict = {}
    for p in sorted(pieces, key=lambda p: p.start):
        assert len(p.ids) == 4 * p.length and 1 <= p.length <= 2048
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    joined: dict = {}
    for (doc, n), ps in by_doc.items():
        starts = {}
        for p in ps:
            starts.setdefault(p.start, []).append(p.ids)
        times = len(starts[0])
        assert all(len(v) == times for v in starts.values())
        if len({tuple(v) for v in starts.values() if len(set(v)) > 1}) == 0:
            ids = b"".join(v[0] for _, v in sorted(starts.items()))
            joined[doc, ids] = joined.get((doc, ids), 0) + times
        else:  # texts that share doc_id and length
            for ids in starts[0]:
                joined[doc, ids] = joined.get((doc, ids), 0) + 1
    assert joined == want
    packed = packing.pack_documents(docs, path).collect()
    assert sorted((p.doc_id or -1, p.start, p.length) for p in packed) == sorted((p.doc_id or -1, p.start, p.length) for p in pieces)
    sequences: dict = {}
    for p in packed:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(p.length for p in pieces)
    assert total > 0.9 * 2048 * (len(sequences) - 1)
    assert packing.pack_documents(no_docs, path).collect() == []


def test_parts_of_words_go_to_the_library_once(monkeypatch):
    """Any text has the library's ids, and what words share (letters in either case, symbols at their ends) is encoded once."""
    found = packing.TextIds(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(7)
    odd = "aBzÉéßÿŸİıſKİ\u0301\u0338ñ漢٣½ªµ×÷Σςﬁ’'\"#&(*,-./:;<=>?[]_|~09 \t\n\x0b\r\x1c\x85\xa0\u2003\U0001f600"
    texts = ["", " ", "x<|endoftext|>y z", "it's 's I'VE 'll"] + ["".join(rnd.choice(odd[k:]) for _ in range(rnd.randrange(40))) for k in (0, 0, 30) for _ in range(700)]
    ids, n = found.ids(pa.array(texts), 1)
    assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == [found.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]

    given: list[str] = []
    whole, model = found._whole, found.model
    monkeypatch.setattr(found, "_whole", lambda words: given.extend(words) or whole(words))
    found.model = SimpleNamespace(tokenize=lambda word: given.append(word) or model.tokenize(word))
    found.ids(pa.array(["Word, word. (WORD)", "word, wOrd!? other", "Other 12 other,"]), 1)
    assert sorted(given) == sorted(["word", "other", ",", ".", "(", ")", "!?", "12"])


@pytest.mark.parametrize("lengths", [{1: 3}, {2048: 4}, {1025: 5, 1024: 5}, {700: 10, 649: 3, 1: 50}, {i: i % 5 for i in range(1, 2049)}])
def test_patterns_place_every_length_once(lengths):
    lengths = {k: v for k, v in lengths.items() if v}
    placed: dict = {}
    for count, pack in packing.pack_histogram(dict(lengths), 2048):
        assert sum(k * v for k, v in pack.items()) <= 2048
        for k, v in pack.items():
            placed[k] = placed.get(k, 0) + count * v
    assert placed == lengths


def unique_awkward():
    return [(i, *r[1:]) for i, r in enumerate(awkward())]


@pytest.mark.parametrize("run, sql, columns", [
    (quality.judge, quality.OP4_SQL, "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"),
    (license_scan.scan, license_scan.OP10_SQL, "doc_id n_sentences sentence_ids licenses restricted"),
])
def test_native_operators_on_awkward_documents(spark, no_docs, run, sql, columns):
    data = unique_awkward() + [
        (300 + i, t, "en", "s", 1, 1, "x", 2, 3)
        for i, t in enumerate([
            "Released under the MIT License.\nAll rights reserved.", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software. Foo bar. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License; either version 3 of the License, or (at your option) any later version.", "LICENSED UNDER CC BY-NC 4.0", "# * $ " * 20,
        ])
    ]
    names = columns.split()
    docs = spark.createDataFrame(data, SCHEMA)
    got = run(docs).select(*names).collect()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": [r[0] for r in data], "text": pd.Series([r[1] for r in data], dtype="object")}))
    result = con.execute(sql)
    assert rows(names, got) == rows([c[0] for c in result.description], result.fetchall())
    assert run(no_docs).collect() == []


def test_quality_keeps_clean_prose_and_its_columns(spark, docs):
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    clean = "the quick brown fox jumps over the lazy dog and then it sleeps in the warm sun of a late summer day near the old stone wall"
    one = spark.createDataFrame([(1, clean, "en", None, None, None, None, None, None), (2, "$$$ ### " * 30, "en", None, None, None, None, None, None)], SCHEMA)
    assert [r.doc_id for r in quality.keep(one).collect()] == [1]
