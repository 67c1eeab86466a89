"""Near copies: documents whose sets of word shingles have a Jaccard similarity of 0.8 (four fifths) or more.

Equal sets are one node. Of a set of n shingles, in one order for all sets, the first n - ceil(0.8 n) + 1 are its keys: two
sets that are similar enough share a key, whatever the order. Shingles that a sample of documents repeats come last in the
order, so repeated lines seldom become keys; this changes the work, not the result. Sets that share a key are
compared by SKETCH one-bit minhashes (a similar pair differs in a tenth of them; more than MOST_BITS of them: less than 1 in 10^10),
and what is left is verified on the texts. Sets are first compared with the least set of each key. Those still in
different components are compared with one another: within a key by sketches, in cells of bounded size, of which only the
families leave (a row for each set, linked to the first that it may be similar to, directly or over others); then
within a family by the sets themselves, in cells again, of which only a row for each set that found a link leaves.
So dense groups never become rows of pairs, and every pair that shares a key is judged all the same.

Defined cases: a null text is an empty text; a text without words has one empty shingle, so such texts are equal; one of fewer
than width words is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signal_lake.llm.common import materialise
from signal_lake.llm.components import components
from signal_lake.llm.simhash import first_rows

SEED = 42
SKETCH, MOST_BITS = 128, 44
#: One document in SAMPLED is asked for repeated shingles; those of OFTEN such documents come last, at most LISTED of them.
SAMPLED, OFTEN, LISTED = 8, 8, 100_000
#: Shingles that are sketched at once, and columns of shingles that are counted at once.
CHUNK = 1 << 12
#: Sets of one key, sets of one family, and their shingles, that a block of a cell holds, about. A cell holds one block or two.
KEY_BLOCK, FAMILY_BLOCK, LOAD = 1024, 512, 200_000

_r = np.random.default_rng(SEED)
_MULTIPLY = _r.integers(0, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _r.integers(0, 1 << 63, SKETCH, np.uint64)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = (text or "").encode().lower().split()
    each = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in each), np.uint64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _name(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63)


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH one-bit minhashes as two signed longs."""
    least = np.full(SKETCH, ~np.uint64(0))
    for i in range(0, len(s), CHUNK):
        x = s[i : i + CHUNK, None] * _MULTIPLY + _ADD
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, x.min(0))
    return np.packbits((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63) != 0).view(np.int64)


def keys(s: np.ndarray, late: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """The set's keys; late (sorted) come last in the order."""
    over, under = similarity
    n = len(s) - -(-len(s) * over // under) + 1
    if len(late):
        s = s[np.argsort(late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s, kind="stable")]
    return s[:n]


def _described(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), width) for t in b.column(2)]
            both = np.array([sketch(s) for s in sets], np.int64).reshape(-1, 2)
            columns = [b.column(0), b.column(1), pa.array([_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "node", "n", "s1", "s2"])

    return run


def _repeated(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = {_name(s): s for s in (shingles(t.as_py(), width) for t in b.column(0))}
            if sets:
                key, times = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(key[times > 1])), pa.array(times[times > 1])], names=["key", "times"])

    return run


def _keyed(width: int, late: np.ndarray, similarity: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                sets = {_name(s): s for s in (shingles(t.as_py(), width) for t in whole.column(0).slice(i, 500))}
                held = [keys(s, late, similarity) for s in sets.values()]
                nodes = np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(k) for k in held])
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(held))), pa.array(nodes)], names=["key", "node"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), width).tobytes() for t in b.column(1)], pa.binary())], names=["node", "held"])

    return run


def _similar(similarity: tuple[int, int]):
    over, under = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fit = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                fit.append(under * both >= over * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(fit, pa.bool_()))

    return run


def _dealt(members: DataFrame, group: str) -> DataFrame:
    """members (group, node, blocks, ...), each copied to the cells (group, i, j) in which its block meets every block of the group."""
    out = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    out = out.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    out = out.withColumn("i", F.least("block", "__other")).withColumn("j", F.greatest("block", "__other")).withColumnRenamed(group, "cell")
    return out.drop("__other", "blocks").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "node")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole cells, and where the cells begin; rows of a cell that the next batch may go on with wait."""
    held: list = []
    for b in _with_end(batches):
        t = pa.Table.from_batches(held + ([b] if b is not None else [])) if held or b is not None else None
        if t is None or not t.num_rows:
            continue
        t = t.combine_chunks()
        names = [t.column(f).to_numpy() for f in ("cell", "i", "j")]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in names], axis=0)
        starts = np.flatnonzero(new)
        if b is not None:
            held = t.slice(int(starts[-1])).to_batches()
            t, starts = t.slice(0, int(starts[-1])), starts[:-1]
        if t.num_rows:
            yield t, starts


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _united(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges from each place to the first that pairs (a, b) reach: as many as places at most."""
    label = np.arange(len(node))
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    at = np.flatnonzero((label != np.arange(len(node))) & (node[label] != node))
    return pa.RecordBatch.from_arrays([pa.array(node[label[at]]), pa.array(node[at])], names=["u", "v"])


def _families(similarity: tuple[int, int]):
    """Edges between sets of a cell (node, comp, block, n, s1, s2) that may be similar."""
    over, under = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _cells(batches):
            i, j, block, node, comp, n, s1, s2 = (t.column(f).to_numpy() for f in ("i", "j", "block", "node", "comp", "n", "s1", "s2"))
            end = np.repeat(np.append(starts[1:], len(node)), np.diff(np.append(starts, len(node))))
            pairs, x, d = [], np.arange(len(node)), 1
            while len(x := x[x + d < end[x]]):  # each with the d-th after it in its cell
                y = x + d
                ok = (comp[x] != comp[y]) & ((block[x] != block[y]) | (i[x] == j[x])) & (np.minimum(n[x], n[y]) * under >= np.maximum(n[x], n[y]) * over)
                u, v = x[ok], y[ok]
                ok = np.bitwise_count((s1[u] ^ s1[v]).view(np.uint64)) + np.bitwise_count((s2[u] ^ s2[v]).view(np.uint64)) <= MOST_BITS
                pairs.append((u[ok], v[ok]))
                d += 1
            a, b = (np.concatenate(p) for p in zip(*pairs)) if pairs else (x, x)
            yield _united(node, a, b)

    return run


def _links(similarity: tuple[int, int]):
    """Edges between sets of a cell (node, comp, block, held) that are similar: shared shingles are counted by a product of their tables."""
    over, under = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _cells(batches):
            for low, high in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows]):
                i, j, block, node, comp = (t.column(f).slice(low, high - low).to_numpy() for f in ("i", "j", "block", "node", "comp"))
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("held").slice(low, high - low)]
                n = np.array([len(x) for x in sets], np.float64)
                _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
                row, shared = np.repeat(np.arange(len(sets)), n.astype(np.int64)), times > 1
                place = np.cumsum(shared) - 1
                row, column = row[shared[column]], place[column[shared[column]]]
                order = np.argsort(column, kind="stable")
                row, column = row[order], column[order]
                both = np.zeros((len(sets), len(sets)), np.float32)
                for c in range(0, int(shared.sum()), CHUNK):
                    part = slice(*np.searchsorted(column, (c, c + CHUNK)))
                    held = np.zeros((len(sets), CHUNK), np.float32)
                    held[row[part], column[part] - c] = 1
                    both += held @ held.T
                ok = (under * both >= over * (n[:, None] + n[None, :] - both)) & (comp[:, None] != comp[None, :])
                if i[0] != j[0]:
                    ok &= block[:, None] != block[None, :]
                yield _united(node, *np.nonzero(np.triu(ok, 1)))

    return run


def _may_be_similar(a: str, b: str, similarity: tuple[int, int]):
    over, under = similarity
    bits = F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) + F.bit_count(F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2")))
    return (F.least(f"{a}.n", f"{b}.n") * under >= F.greatest(f"{a}.n", f"{b}.n") * over) & (bits <= MOST_BITS)


def near_copies(rows: DataFrame, width: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """rows (doc_id, th, text; no nulls; read several times) as doc_id, th and component_id: the smallest doc_id that links reach."""
    described = materialise(rows.mapInArrow(_described(width), "doc_id long, th long, node long, n long, s1 long, s2 long"), "described")
    nodes = materialise(described.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min(F.struct("n", "s1", "s2")).alias("d")).select("node", "rep", "d.*"), "nodes")
    some = rows.where(F.pmod("th", F.lit(SAMPLED)) == 0).select("text").mapInArrow(_repeated(width), "key long, times long")
    often = some.groupBy("key").agg(F.sum("times").alias("times")).where(F.col("times") >= OFTEN).orderBy(F.desc("times"), "key").limit(LISTED)
    late = np.sort(often.select("key").toArrow().column(0).to_numpy().view(np.uint64))  # at most LISTED
    posted = materialise(rows.select("text").mapInArrow(_keyed(width, late, similarity), "key long, node long").distinct(), "keys")
    live = posted.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key")
    held = materialise(posted.join(live, "key", "left_semi").join(nodes.drop("rep"), "node"), "held")

    def sets_of(asked: DataFrame) -> DataFrame:
        """node and held (its shingles) for the nodes of asked."""
        at = asked.distinct().join(nodes, "node").select("node", F.col("rep.doc_id").alias("__doc"), F.col("rep.th").alias("__th"))
        texts = rows.join(at, (F.col("doc_id") == F.col("__doc")) & (F.col("th") == F.col("__th"))).dropDuplicates(["node"])
        return materialise(texts.select("node", "text").mapInArrow(_sets(width), "node long, held binary"), "sets")

    star = held.groupBy("key").agg(F.min(F.struct("node", "n", "s1", "s2")).alias("c")).select("key", "c.*")
    first = held.alias("p").join(star.alias("c"), (F.col("p.key") == F.col("c.key")) & (F.col("p.node") != F.col("c.node")) & _may_be_similar("p", "c", similarity))
    pairs = materialise(first.select(F.col("c.node").alias("u"), F.col("p.node").alias("v")).distinct(), "pairs")
    sets = sets_of(pairs.select(F.col("u").alias("node")).union(pairs.select("v")))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("held").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("held").alias("y")), "v")
    near = components(both.select("u", "v", "x", "y").mapInArrow(_similar(similarity), "u long, v long"))

    named = near.select(F.col("node").alias("__node"), "root")
    left = materialise(held.join(named, F.col("node") == F.col("__node"), "left").select("key", "node", "n", "s1", "s2", F.coalesce("root", "node").alias("comp")), "left")
    apart = left.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("__n")).where("a <> b")
    apart = apart.select("key", F.ceil(F.col("__n") / KEY_BLOCK).cast("long").alias("blocks"))
    family = components(_dealt(left.join(apart, "key"), "key").mapInArrow(_families(similarity), "u long, v long"))
    comp = left.select("node", "n", "comp").distinct()
    family = materialise(family.join(comp, "node").select("node", F.col("root").alias("family"), "comp", "n"), "family")
    sizes = family.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / FAMILY_BLOCK), F.ceil(F.sum("n") / LOAD)).cast("long").alias("blocks"))
    members = family.join(sizes, "family").join(sets_of(family.select("node")), "node").drop("n")
    more = _dealt(members, "family").mapInArrow(_links(similarity), "u long, v long")
    linked = components(more.union(near.where("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v")))).select(F.col("node").alias("__node"), "root")
    joined = nodes.select("node", "rep").join(linked, F.col("node") == F.col("__node"), "left").select("node", "rep", F.coalesce("root", "node").alias("comp"))
    found = joined.join(joined.groupBy("comp").agg(F.min("rep.doc_id").alias("component_id")), "comp").select("node", "component_id")
    return described.select("doc_id", "th", "node").join(found, "node").drop("node")


def deduplicate(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs with the first row of each group of near copies."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    return first_rows(docs, materialise(near_copies(rows, width), "groups"))
