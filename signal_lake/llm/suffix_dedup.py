"""Repeated byte strings by recursive induced sorting.

The recursion of induced suffix sorting names the substrings between the leftmost S-type suffixes (a position that is
smaller than both its neighbours once runs are one) and goes on with the names. Its sampled suffixes, with the
substring's name as the sorted prefix, are the rows that Spark sorts in its external, spilling sorts; equal neighbours share
their whole region, and only where regions of one name differ is their common part told by window (see repeats.py).
A text is cut into pieces of bounded size, so no shard has to fit into memory.

Defined cases: a null text is an empty text (no bytes, nothing removed); texts of under WINDOW bytes are kept whole; see
repeats.py for ties and repeated rows. Columns other than doc_id and text are not carried.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from signal_lake.llm.common import table
from signal_lake.llm.repeats import Kind, Symbols, U, Units, mix, remove_repeats

WINDOW = 100
#: Levels of the recursion. Two make substrings of some ten bytes, and are decided well inside a window.
LEVELS = 2

_CODES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def _induce(u: Units, s: Symbols) -> Symbols:
    """The substrings between symbols that are smaller than both neighbours, runs taken as one."""
    new, _ = s.borders()
    new[1:] |= s.name[1:] != s.name[:-1]
    run = np.flatnonzero(new)
    c, piece = s.name[run], s.piece[run]
    low = np.zeros(len(run), bool)
    low[1:-1] = (c[:-2] > c[1:-1]) & (c[2:] > c[1:-1]) & (piece[:-2] == piece[1:-1]) & (piece[2:] == piece[1:-1])
    at = np.flatnonzero(low)
    cut, before, after = run[at], run[at] - 1, run[at + 1] if len(at) else run[:0]
    left, right = slice(None, -1), slice(1, None)
    same = s.piece[cut[left]] == s.piece[cut[right]]
    start, end = s.start[cut[left]][same], s.start[cut[right]][same]
    return Symbols(u.hashed(start, end), start, end, s.low[before[left]][same], s.high[after[right]][same], s.piece[cut[left]][same])


def parse(u: Units) -> Symbols:
    s = Symbols.single(u)
    for _ in range(LEVELS):
        s = _induce(u, s)
    return s


BYTES = Kind(
    window=WINDOW,
    chunk=700_000,
    split=lambda text: text,
    code=lambda part: _CODES[np.frombuffer(part, np.uint8)],
    join=lambda text, keep: text if keep is None else np.frombuffer(text, np.uint8)[keep].tobytes(),
    parse=parse,
)


def suffix_dedup(docs):
    """remove_repeats() over bytes."""
    return remove_repeats(docs, BYTES)


def op1_suffix_dedup(spark, sf_dir: str):
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
