"""Repeated word sequences by recompression.

Words are named by their hashes. A first round names runs of one word; then rounds name pairs: each symbol's name puts it
on the left or on the right side, and a left one followed by a right one becomes one symbol named after both. All names
are functions of the names below, so they are the same in every task and equal substrings get equal symbols but for a
few at their borders. Shared high-level symbols are the anchors that Spark deals and verifies (see repeats.py).

Defined cases: a null text has no words; texts of under WINDOW words are kept whole; see repeats.py for ties and repeated
rows. Columns other than doc_id and text are not carried.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import xxhash
from pyspark.sql import functions as F

from signal_lake.llm.common import table
from signal_lake.llm.repeats import Kind, Symbols, U, Units, mix, remove_repeats

WINDOW = 20
#: Rounds of pairs. A round shortens the sequence by a quarter, and three leave a whole symbol inside any window.
ROUNDS = 3


def _runs(s: Symbols) -> Symbols:
    new, _ = s.borders()
    first = new.copy()
    new[1:] |= s.name[1:] != s.name[:-1]
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(s.name))
    n = end - at
    name = np.where(n > 1, mix(s.name[at] + n.astype(U) * U(0x2545F4914F6CDD1D)), s.name[at])
    starts = first[at]  # runs at a border of their piece are decided by what lies outside
    ends = np.append(starts[1:], True)
    low = np.where(starts, s.start[at] - 1, s.low[at - 1])
    high = np.where(ends, s.end[end - 1] + 1, s.high[np.minimum(end, len(s.high) - 1)])
    return Symbols(name, s.start[at], s.end[end - 1], low, high, s.piece[at])


def _pairs(s: Symbols, turn: int) -> Symbols:
    left = (mix(s.name ^ U(0x8CB92BA72F3D8DD7 + turn)) & U(1)) == 0
    first, last = s.borders()
    pair = np.zeros(len(s.name), bool)
    pair[:-1] = left[:-1] & ~left[1:] & ~last[:-1]
    second = np.zeros(len(s.name), bool)
    second[1:] = pair[:-1]
    at = np.flatnonzero(~second)
    two = pair[at]
    other = np.minimum(at + 1, len(s.name) - 1)
    name = np.where(two, mix(s.name[at] * U(0x9FB21C651E98DF25) + s.name[other] + U(turn + 1)), s.name[at])
    end = np.where(two, s.end[other], s.end[at])
    low = np.where(~two & ~left[at], np.where(first[at], s.start[at] - 1, s.low[at - 1]), s.low[at])
    high = np.where(two, s.high[other], np.where(left[at], np.where(last[at], s.end[at] + 1, s.high[other]), s.high[at]))
    return Symbols(name, s.start[at], end, low, high, s.piece[at])


def parse(u: Units) -> Symbols:
    s = _runs(Symbols.single(u))
    for turn in range(ROUNDS):
        s = _pairs(s, turn)
    return s


WORDS = Kind(
    window=WINDOW,
    chunk=500_000,
    split=lambda text: text.split(),  # bytes: ASCII white space
    code=lambda words: np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words)),
    join=lambda words, keep: b" ".join(words if keep is None else compress(words, keep)),
    parse=parse,
)


def substring_dedup(docs):
    """remove_repeats() over words; kept words are joined by one space."""
    return remove_repeats(docs, WORDS)


def op7_substring_dedup(spark, sf_dir: str):
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
