"""Periodic runs of words: every lag of a document compared with the document itself.

A run of smallest period q and length l is a stretch of l - q words that are each equal to the word q further on. The
words' ids are compared with their shift by each lag up to n / LEAST_EXPONENT: first at every q-th word, which a run
long enough meets three times at least, then, round the places where three in a row agree, at all words. What agrees
is cut into stretches of full length. A lag that is a multiple of a run's period gives the same stretch again, so of
equal stretches the smallest lag is kept; by Fine and Wilf it divides the others.

Documents of up to WHOLE_CHARS are scanned where they are read, many at a time. A longer one is dealt in ranges of
lags to several tasks, and the stretches of its ranges meet again by document, start and end.

Defined cases: a null text has no words; a document without runs has four nulls and the hash of an empty list; a row
is judged by itself, so repeated rows give repeated results and doc_id may be null or repeat; other columns are not
carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signal_lake.llm.common import let, table
from signal_lake.llm.quality import words_of

LEAST_EXPONENT = 4
LEAST_WORDS = 6
#: Texts from this many characters on are dealt by ranges of lags.
WHOLE_CHARS = 200_000
#: Ranges of a document at most, and lags of a range at least.
RANGES, RANGE_LAGS = 16, 8192
#: Lags that every range scans besides its own, so that it knows the runs of phrases repeated very often.
SHORT_LAGS = 32
#: Words that are scanned at a time, but for a single longer document.
CHUNK_WORDS = 500_000


def scan(a: np.ndarray, sizes: np.ndarray, lags) -> list[tuple[int, int, int]]:
    """The stretches (start, end, lag) of the concatenated documents `a` that are runs at one of these ascending lags.

    Documents come longest first, and no id is in two of them. Of stretches with equal ends the first is given."""
    ends = np.cumsum(sizes)
    found: dict[tuple[int, int], int] = {}
    runs: list[tuple[int, int, int]] = []
    cover = np.full(len(a), -1, np.int32)  # a run that holds the word, if one is known

    def compare(lo: int, hi: int, q: int, least: int) -> None:
        """Stretches of at least this many words in [lo, hi) that are equal to the word q further on."""
        equal = np.concatenate(([False], a[lo:hi] == a[lo + q : hi + q], [False]))
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        starts, stops = edges[::2], edges[1::2]
        for i in np.flatnonzero(stops - starts >= least):
            s, e = int(starts[i]) + lo, int(stops[i]) + lo + q
            if found.setdefault((s, e), q) == q:
                cover[s:e] = len(runs)
                runs.append((s, e, q))

    for q in lags:
        length = max(LEAST_WORDS, LEAST_EXPONENT * q)
        n = np.searchsorted(-sizes, -length, "right")  # documents that are long enough
        if not n:
            break
        m = int(ends[n - 1])
        if q == 1:
            compare(0, m - 1, 1, length - 1)
            continue
        steps = a[:m:q]
        agree = steps[1:] == steps[:-1]
        three = np.flatnonzero(agree[2:] & agree[1:-1] & agree[:-2])
        if not len(three):
            continue
        cut = np.flatnonzero(np.diff(three) != 1) + 1
        for first, last in zip(three[np.concatenate(([0], cut))], three[np.concatenate((cut - 1, [-1]))]):
            lo, hi = int(first) * q, (int(last) + 3) * q
            known = cover[lo]
            # Inside a run whose period divides the lag, the stretch is that run again.
            if known >= 0 and q % runs[known][2] == 0 and runs[known][0] <= lo and hi < runs[known][1]:
                continue
            compare(max(0, lo - q + 1), min(m - q, hi), q, length - q)
    return runs


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > CHUNK_WORDS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def _longest_first(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The documents by falling number of words, their ids as one array, and their numbers of words."""
    sizes = pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    batch, sizes = batch.take(pa.array(order)), sizes[order]
    words = batch.column("words").flatten().dictionary_encode()
    ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(np.arange(len(sizes)), sizes) * len(words.dictionary)
    return batch, ids, sizes


DIGESTS = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digests(batch: pa.RecordBatch, sizes: np.ndarray, runs: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """The result of each document; runs are (start, end, period) in the concatenated words."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    kept, own = np.ones(offsets[-1], bool), [[] for _ in sizes]
    for s, e, q in runs:
        kept[s + q : e] = False
        doc = int(np.searchsorted(offsets, s, "right")) - 1
        own[doc].append((s - int(offsets[doc]), e - s, q))
    left = np.concatenate(([0], np.cumsum(kept)))[offsets].astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), batch.column("words").flatten().filter(pa.array(kept))), " ")
    out = []
    for doc_id, n, found, text in zip(batch.column("doc_id").to_pylist(), sizes, own, collapsed.to_pylist()):
        found.sort(key=lambda r: (r[0], r[2]))
        s, length, q = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        exponent = 1000 * length // q if found else None
        out.append((doc_id, int(n), len(found), s, length, q, exponent, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in DIGESTS.split(", ")])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chain.from_iterable(map(_chunks, batches)):
        batch, ids, sizes = _longest_first(chunk)
        yield _digests(batch, sizes, scan(ids, sizes, range(1, int(sizes[0]) // LEAST_EXPONENT + 2)))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of one document and range of lags a row."""
    for batch in batches:
        for i in range(batch.num_rows):
            one, ids, sizes = _longest_first(batch.slice(i, 1))
            lo, hi = one.column("lo")[0].as_py(), one.column("hi")[0].as_py()
            runs = scan(ids, sizes, chain(range(1, min(lo, SHORT_LAGS + 1)), range(lo, hi)))
            keys = pa.array([one.column("key")[0].as_py()] * len(runs), pa.string())
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[k] for r in runs], pa.int64()) for k in range(3))], ["key", "s", "e", "q"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            runs = [(r["s"], r["e"], r["q"]) for r in one.column("runs")[0].as_py() or []]
            yield _digests(one, pc.list_value_length(one.column("words")).to_numpy(zero_copy_only=False), runs)


def periodic_runs(docs: DataFrame, words=lambda doc_id, text: words_of(text)) -> DataFrame:
    """n_words, runs and what is left of each document without the repeats of its runs.

    `words` gives the expression of a document's words from its doc_id and text columns."""
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    listed = words(F.col("doc_id"), F.col("text")).alias("words")
    short = given.where(F.length("text") < WHOLE_CHARS).select("doc_id", listed).mapInArrow(_whole, DIGESTS)
    # Rows with one doc_id and one text have one result, so they may share the key that their ranges meet by.
    key = F.sha2(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text")), 256).alias("key")
    long = given.where(F.length("text") >= WHOLE_CHARS).select("doc_id", key, listed)
    lags = F.size("words") / F.lit(LEAST_EXPONENT)
    width = F.greatest(F.lit(RANGE_LAGS), F.ceil(lags / RANGES)).cast("long")
    starts = F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(lags, F.lit(1)).cast("long"), F.col("width"))).alias("lo")
    dealt = long.withColumn("width", width).select("key", "words", "width", starts).withColumn("hi", F.col("lo") + F.col("width")).drop("width")
    spread = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    stretches = dealt.repartition(int(spread)).mapInArrow(_ranges, "key string, s long, e long, q long")
    runs = stretches.groupBy("key", "s", "e").agg(F.min("q").alias("q")).groupBy("key").agg(F.collect_list(F.struct("s", "e", "q")).alias("runs"))
    return short.unionByName(long.join(runs, "key", "left").mapInArrow(_finished, DIGESTS))


def planted(doc_id: Column, text: Column) -> Column:
    """The words of a text, from some place on repeated with some period in a tenth of the documents, as crc32 of doc_id says."""
    h = F.crc32(doc_id.cast("string"))

    def repeat(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p)))

    return let(words_of(text), lambda w: F.when((h % 10 == 0) & (F.size(w) > 0), repeat(w)).otherwise(w))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"]
    return periodic_runs(table(spark, sf_dir, "documents"), planted).select(names)
