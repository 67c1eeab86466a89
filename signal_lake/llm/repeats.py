"""Exact repeats over all documents: which windows of W consecutive units also start earlier.

A document is a sequence of units (bytes or words). A parser cuts it into symbols whose names and borders follow from the
content round them, and tells for each symbol the stretch of units that decided it. For each window, the
symbol with the least hash among those decided inside the window is its anchor, so equal windows have equal anchors
at equal places. Neighbouring windows with the same anchor, on the same side of it, form a region, named after the anchor with what
all such windows hold on that side: half a window or more, so that names seldom meet but in repeats. A window in which
nothing is decided (long runs and periods) is its own anchor.

1. Each task parses its documents in chunks of bounded size (long documents are cut into overlapping pieces) and gives a
   row for each region: its name and its hash. Equal regions inside a chunk are settled there, so a frequent passage
   sends one row a chunk.
2. Spark deals the regions by name and sorts them. All but the first of equal regions are repeats. Where a name has
   only one kind of region, the first has none; otherwise the first of each kind is resolved by window.
3. Those few regions are joined to their texts, and their windows dealt by (name, window hash) in the same way.
4. The repeats meet their document again, and the covered units are removed.

Order is (doc_id, th, start), with th the text's hash: rows that share doc_id and text are one document given several
times, none of which counts as earlier than another; rows that share only doc_id come in the order of th; a null doc_id comes first. Names and window
hashes have 64 bits each and are compared together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signal_lake.llm.common import materialise

U = np.uint64
BASE, INVERSE = U(0x9E3779B97F4A7C15 | 3), U(pow(0x9E3779B97F4A7C15 | 3, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers.get(0, ((),))[0].__len__() < n + 1:
        size = 1 << (n + 1).bit_length()
        one = np.ones(1, U)
        _powers[0] = (np.concatenate([one, np.cumprod(np.full(size, BASE, U))]), np.concatenate([one, np.cumprod(np.full(size, INVERSE, U))]))
    return _powers[0]


@dataclass
class Units:
    """The units of one chunk: a code for each, the borders of the pieces, and prefix hashes."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __post_init__(self):
        up, self.down = powers(len(self.codes))
        self.prefix = np.concatenate([np.zeros(1, U), np.cumsum(self.codes * up[: len(self.codes)], dtype=U)])
        self.piece = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)

    def hashed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the units from a to b, wherever they stand."""
        return mix((self.prefix[b] - self.prefix[a]) * self.down[a] + (b - a).astype(U))


@dataclass
class Symbols:
    """In order: name, units covered, units that decided it, piece."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    piece: np.ndarray

    @classmethod
    def single(cls, u: Units) -> Symbols:
        at = np.arange(len(u.codes))
        return cls(u.codes, at, at + 1, at, at + 1, u.piece)

    def borders(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a symbol is its piece's first, and last."""
        first = np.ones(len(self.name), bool)
        first[1:] = self.piece[1:] != self.piece[:-1]
        last = np.ones(len(self.name), bool)
        last[:-1] = first[1:]
        return first, last


def regions(u: Units, s: Symbols, w: int) -> tuple[np.ndarray, ...]:
    """name, region hash, first window, number of windows, piece: in order of the first window."""
    q = np.unique(np.concatenate([u.starts, u.ends - w + 1, s.low + 1, s.high - w]))
    q = q[q >= 0]
    piece = np.searchsorted(u.starts, q, "right") - 1
    until = np.append(q[1:], len(u.codes))
    ok = (piece >= 0) & (q <= u.ends[piece] - w)
    q, piece, until = q[ok], piece[ok], until[ok]
    a, b = np.searchsorted(s.low, q, "left"), np.searchsorted(s.high, q + w, "right")
    has = b > a
    # the place of the least hash in [a, b), the leftmost of equals, from a table of powers of two
    h = mix(s.name ^ U(0xD6E8FEB86659FD93))
    best = np.zeros(len(q), np.int64)
    width, level = np.where(has, b - a, 1), np.arange(len(h))
    k = 1
    while has.any():
        now = has & (width >= k) & (width < 2 * k)
        x, y = level[a[now]], level[b[now] - k]
        best[now] = np.where(h[x] <= h[y], x, y)
        if not (width >= 2 * k).any():
            break
        x, y = level[:-k], level[k:]
        level = np.where(h[x] <= h[y], x, y)
        k *= 2
    # neighbours with the same anchor are one region
    q1, until1, best1, piece1 = q[has], until[has], best[has], piece[has]
    new = np.ones(len(q1), bool)
    new[1:] = (best1[1:] != best1[:-1]) | (q1[1:] != until1[:-1]) | (piece1[1:] != piece1[:-1])
    at = np.flatnonzero(new)
    first, anchor, piece1 = q1[at], best1[at], piece1[at]
    n = (until1[np.append(at[1:], len(q1)) - 1] if len(at) else first) - first
    # windows up to the middle hold all from the middle to the anchor's end, the others all from the anchor's start on
    start, end = s.start[anchor], s.end[anchor]
    middle = start - (w - (end - start)) // 2
    cut = np.clip(middle + 1, first, first + n)
    cores = (u.hashed(np.maximum(middle, first), end), mix(u.hashed(start, np.minimum(middle + 1 + w, first + n - 1 + w)) ^ U(0x94D049BB133111EB)))
    first, n, start, piece1 = np.concatenate([first, cut]), np.concatenate([cut - first, first + n - cut]), np.tile(start, 2), np.tile(piece1, 2)
    name, some = np.concatenate(cores), n > 0
    first, n, start, piece1, name = first[some], n[some], start[some], piece1[some], name[some]
    kind = mix(u.hashed(first, first + n - 1 + w) + n.astype(U) * U(0x100000001B3) + (start - first).astype(U))
    # windows without an anchor
    q2, n2 = q[~has], (until - q)[~has]
    alone = np.repeat(q2 - np.concatenate([[0], np.cumsum(n2)[:-1]]), n2) + np.arange(n2.sum()) if len(q2) else q2
    hash2 = u.hashed(alone, alone + w)
    out = [np.concatenate(p) for p in ((name, mix(hash2 ^ U(0xA0761D6478BD642F))), (kind, hash2), (first, alone), (n, np.ones(len(alone), np.int64)), (piece1, np.repeat(piece[~has], n2)))]
    order = np.argsort(out[2], kind="stable")
    return tuple(x[order] for x in out)


def later(name: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether an equal (name, kind) stands before. Both are compared; where others share the sort's key, it is left to Spark."""
    key = mix(name) + kind
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    a, b = order[1:], order[:-1]
    same[a] = (name[a] == name[b]) & (kind[a] == kind[b])
    return same


ROW = "doc_id long, th long, name long, kind long, first int, n int, sure boolean"
_ROW_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
_ROW_NAMES = ["doc_id", "th", "name", "kind", "first", "n", "sure"]


def _rows(docs: list, doc: np.ndarray, name, kind, first, n, sure) -> pa.RecordBatch:
    """docs: (doc_id, th) by place. Neighbouring windows that are surely repeats become one row."""
    join = np.zeros(len(name), bool)
    join[1:] = sure[1:] & sure[:-1] & (doc[1:] == doc[:-1]) & (first[1:] == first[:-1] + n[:-1])
    at = np.flatnonzero(~join)
    total = np.add.reduceat(n, at) if len(at) else n
    ids, th = pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs], pa.int64())
    take = pa.array(doc[at])
    columns = [ids.take(take), th.take(take), name[at].view(np.int64), kind[at].view(np.int64), first[at].astype(np.int32), total.astype(np.int32), sure[at]]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _ROW_TYPES)], names=_ROW_NAMES)


def _order(d: tuple) -> tuple:
    return (d[0] is not None, d[0] or 0, d[1])


@dataclass(frozen=True)
class Kind:
    """What units are: split gives a text's units, code their codes, join the text of kept units; parse gives symbols."""

    window: int
    chunk: int
    split: Callable
    code: Callable
    join: Callable
    parse: Callable


def _chunks(kind: Kind, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Documents in order, and pieces (document, offset, codes) of at most chunk units together, but for overlaps."""
    for b in batches:
        seen: dict = {}
        for doc_id, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            seen.setdefault((doc_id, th), text)
        docs, pieces, size = [], [], 0
        for d in sorted(seen, key=_order):
            units = kind.split(seen[d].as_py())
            step = kind.chunk
            for at in range(0, max(1, len(units) - kind.window + 1), step):
                codes = kind.code(units[at : at + step + kind.window - 1])
                if len(codes) < kind.window:
                    continue
                if size and size + len(codes) > kind.chunk:
                    yield docs, pieces
                    docs, pieces, size = [], [], 0
                if not docs or docs[-1] != d:
                    docs.append(d)
                pieces.append((len(docs) - 1, at, codes))
                size += len(codes)
        if pieces:
            yield docs, pieces


def _units(pieces: list) -> Units:
    ends = np.cumsum([len(p[2]) for p in pieces])
    return Units(np.concatenate([p[2] for p in pieces]), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64))


def _find(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, pieces in _chunks(kind, batches):
            u = _units(pieces)
            name, region, first, n, piece = regions(u, kind.parse(u), kind.window)
            doc, at = np.array([p[0] for p in pieces])[piece], np.array([p[1] for p in pieces])[piece]
            yield _rows(docs, doc, name, region, first - u.starts[piece] + at, n, later(name, region))

    return run


def _resolve(kind: Kind):
    """The windows of the asked-for regions of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict = {}
            for doc_id, th, text, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                held.setdefault((doc_id, th), (text, asked))
            docs, parts, size = sorted(held, key=_order), [], 0
            for k, d in enumerate(docs):
                text, asked = held[d]
                units = kind.split(text.as_py())
                flat = asked.values
                name, first, n = (flat.field(f).to_numpy().astype(np.int64) for f in ("name", "first", "n"))
                order = np.argsort(first, kind="stable")
                group: list = []
                for i in [*order, None]:  # regions that lie together are hashed together
                    if group and (i is None or first[i] - first[group[0]] > kind.chunk):
                        low = int(first[group[0]])
                        u = _units([(0, 0, kind.code(units[low : int((first[group] + n[group]).max()) - 1 + kind.window]))])
                        f, m = first[group], n[group]
                        p = np.repeat(f - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                        parts.append((np.full(len(p), k), np.repeat(name[group].view(U), m), u.hashed(p - low, p - low + kind.window), p))
                        size += len(p)
                        group = []
                    if i is not None:
                        group.append(i)
                if parts and (size > kind.chunk or k == len(docs) - 1):
                    doc, names, hashes, p = (np.concatenate(x) for x in zip(*parts))
                    yield _rows(docs, doc, names, hashes, p, np.ones(len(p), np.int64), later(names, hashes))
                    parts, size = [], 0

    return run


def _remove(kind: Kind):
    """n_units, n_removed, n_spans and what is kept of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, repeats in zip(b.column(1), b.column(2)):
                units = kind.split(text.as_py())
                cover = np.zeros(len(units) + 1, np.int64)
                if repeats.is_valid and len(repeats.values):
                    first, n = (repeats.values.field(f).to_numpy().astype(np.int64) for f in ("first", "n"))
                    np.add.at(cover, first, 1)
                    np.add.at(cover, first + n - 1 + kind.window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                out.append((len(units), int(gone.sum()), len(edges) // 2, edges.reshape(-1, 2).tolist(), kind.join(units, ~gone) if len(edges) else kind.join(units, None)))
            n, removed, n_spans, spans, kept = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_units", "n_removed", "n_spans", "spans", "kept"],
            )

    return run


def _first(rows: DataFrame) -> DataFrame:
    """rows with key (the name, or for settled rows a number of their own), dealt by key, and `repeat`."""
    key = F.when(F.col("sure"), F.xxhash64("doc_id", "th", "first")).otherwise(F.col("name"))
    me = F.struct("doc_id", "th", "first")
    earliest = F.first(me).over(Window.partitionBy("key", "sure", "kind").orderBy("doc_id", "th", "first").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("key", key).repartition("key").withColumn("__earliest", earliest).withColumn("repeat", F.col("sure") | ~F.col("__earliest").eqNullSafe(me))


def repeats(docs: DataFrame, kind: Kind) -> DataFrame:
    """(doc_id, th, first, n) for each stretch of n windows from window `first` that also start earlier; docs: (doc_id, th, text binary)."""
    rows = _first(docs.mapInArrow(_find(kind), ROW))
    whole = Window.partitionBy("key", "sure")
    kinds = rows.withColumn("__a", F.min("kind").over(whole)).withColumn("__b", F.max("kind").over(whole))
    leader = F.col("__earliest").eqNullSafe(F.struct("doc_id", "th", "first"))
    found = materialise(kinds.where(F.col("repeat") | (leader & (F.col("__a") != F.col("__b")))).select("doc_id", "th", "name", "first", "n", "repeat"), "regions")
    asked = found.where("not repeat").groupBy("doc_id", "th").agg(F.collect_list(F.struct("name", "first", "n")).alias("asked"))
    meet = docs.alias("d").join(asked.alias("a").hint("shuffle_hash"), F.expr("d.doc_id <=> a.doc_id and d.th = a.th")).select("d.doc_id", "d.th", "d.text", "a.asked")
    windows = materialise(_first(meet.mapInArrow(_resolve(kind), ROW)).where("repeat").select("doc_id", "th", "first", "n"), "windows")
    return found.where("repeat").select("doc_id", "th", "first", "n").union(windows)


def remove_repeats(docs: DataFrame, kind: Kind) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, spans (of units) and kept (bytes) for each row of docs (doc_id, text)."""
    held = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = repeats(held, kind).groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "n")).alias("repeats"))
    meet = held.alias("d").join(found.alias("r").hint("shuffle_hash"), F.expr("d.doc_id <=> r.doc_id and d.th = r.th"), "left").select("d.doc_id", "d.text", "r.repeats")
    return meet.mapInArrow(_remove(kind), "doc_id long, n_units long, n_removed long, n_spans long, spans array<array<long>>, kept binary")
