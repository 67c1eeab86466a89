"""Packing by shortest-pack-first over the length histogram.

Every document's ids, ended by one more id, are cut into pieces of at most LENGTH ids. The histogram of piece lengths
(at most LENGTH numbers, whatever the input) is packed longest first: the pieces of a length go to the emptiest
packs that can still take them, and packs with the same contents are held as one pattern with a count. Each
pattern then tells which ranks of a length it takes, and the pieces are joined to the patterns by (length, rank).
Ranks come from two levels, a slice and a place in it, so that a frequent length is no single group.

Defined cases: a null text is an empty text, whose only id is the end; each row that came in is packed by itself,
repeated rows too; ties between pieces of one length are broken by (doc_id, start, ids), nulls first.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signal_lake.llm.common import materialise, table

LENGTH = 2048
END = 1
#: Bytes of text that are worked on together, but for a single longer text, and pieces that are handed on together.
TOGETHER, PIECES_TOGETHER = 16_000_000, 4_000
#: The form of tokenizer whose texts may be taken apart: white space is dropped, letters and symbols are pre-tokens of their own.
FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}
#: A run of these next to a letter, at an end of a word, is a pre-token of its own (an apostrophe may not be).
SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SYMBOL_RUN = r"[!-&(-/:-@\[-`{-~]+"
#: Letters that the normaliser does nothing to but lower their case, one for one; and those that are left then.
LETTERS, LOWER = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", "^[a-zß-öø-ÿ]+$"

_workers: dict = {}


def _gathered(flat: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """flat is made of stretches of count numbers, one after the other: those that `at` names, in its order."""
    n = count[at]
    shift = (np.cumsum(count, dtype=np.int32) - count)[at] - (np.cumsum(n, dtype=np.int32) - n)
    return flat[np.repeat(shift, n) + np.arange(n.sum(), dtype=np.int32)]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), np.int32, len(ids))


class TextIds:
    """Ids of texts, as the library gives them. Texts are taken apart at ASCII white space, and words into letters and the symbols
    round them; each distinct part is given to the library once, letters to its model alone, and its ids are dealt back to the
    places where it stands. Whatever else a word holds goes to the library as a whole word. Nothing is kept from one call to the next."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of the library's own would take those of other tasks
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.known = form["model"]["type"] == "BPE" and {k: form[k] for k in FORM} == FORM
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.level = {c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100))}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # these may stand inside words

    @classmethod
    def at(cls, path: str) -> TextIds:
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parts' ids in some order, their numbers, and each part's place in that order."""
        lower = pc.match_substring_regex(parts, LOWER)
        letters = parts.filter(lower).to_pylist()
        joined = " ".join(letters)
        for c, level in self.level.items():  # what a letter becomes is none of these letters
            joined = joined.replace(c, level)
        ids = [[t.id for t in self.model.tokenize(w)] for w in joined.split(" ")] if letters else []
        lower = lower.to_numpy(zero_copy_only=False)
        place = np.where(lower, np.cumsum(lower) - 1, len(letters) + np.cumsum(~lower) - 1)
        return *_flat(ids + self._whole(parts.filter(pa.array(~lower)).to_pylist())), place

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one word after the other, and how many each has."""
        right = pc.ascii_rtrim(words, SYMBOLS)
        stem = pc.ascii_ltrim(right, SYMBOLS)
        plain = pc.match_substring_regex(stem, LETTERS)
        before, after = pc.and_(plain, pc.not_equal(stem, right)), pc.and_(plain, pc.not_equal(right, words))
        runs = [pc.struct_field(pc.extract_regex(words.filter(which), pattern), "s") for which, pattern in ((before, f"^(?P<s>{SYMBOL_RUN})"), (after, f"(?P<s>{SYMBOL_RUN})$"))]
        found = pa.concat_arrays([pc.if_else(plain, pc.utf8_lower(stem), words), *runs]).dictionary_encode()
        flat, count, place = self._parts(found.dictionary)
        part = np.split(place[found.indices.to_numpy()], np.cumsum([len(words), len(runs[0])]))
        at = np.full((len(words), 3), len(count))  # the part after the last is none
        at[:, 1] = part[0]
        at[before.to_numpy(zero_copy_only=False), 0] = part[1]
        at[after.to_numpy(zero_copy_only=False), 2] = part[2]
        count = np.append(count, np.int32(0))
        return _gathered(flat, count, at.ravel()), count[at].sum(axis=1, dtype=np.int32)

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (none null), one text after the other and each ended by `end`, and how many each has."""
        apart = np.full(len(texts), not self.known)
        for s in self.special:
            apart |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        words = pc.ascii_split_whitespace(pc.if_else(pa.array(apart), "0", texts))  # one word in the place of the text
        found = words.flatten().dictionary_encode()
        flat, count = self._words(found.dictionary)
        more, n = _flat(self._whole(texts.filter(pa.array(apart)).to_pylist()) + [[end]])
        at, offsets = found.indices.to_numpy().copy(), words.offsets.to_numpy()
        at[offsets[:-1][apart]] = len(count) + np.arange(len(n) - 1)
        flat, count = np.concatenate([flat, more]), np.concatenate([count, n])
        at = np.insert(at, offsets[1:], len(count) - 1)
        return _gathered(flat, count, at), np.add.reduceat(count[at], offsets[:-1] + np.arange(len(texts)))


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def _stretches(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of texts of at most `size` bytes, or of one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, size + (ends[first - 1] if first else 0), "right")))
        yield first, last
        first = last


def _cut(path: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = TextIds.at(path)
        for b in batches:
            doc_ids, texts = b.columns
            for first, last in _stretches(texts, TOGETHER):
                ids, tokens = found.ids(texts.slice(first, last - first), end)
                pieces = -(-tokens // length)
                doc = np.repeat(np.arange(last - first), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
                size = np.minimum(tokens[doc] - start, length)
                at = np.concatenate([[0], np.cumsum(size)])
                for i in range(0, len(doc), PIECES_TOGETHER):
                    to = min(i + PIECES_TOGETHER, len(doc))
                    offsets = (4 * (at[i : to + 1] - at[i])).astype(np.int32)
                    binary = pa.Array.from_buffers(pa.binary(), to - i, [None, pa.py_buffer(offsets), pa.py_buffer(ids[at[i] : at[to]])])
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids.take(pa.array(first + doc[i:to])), *(pa.array(c[i:to].astype(np.int64)) for c in (start, size, tokens[doc])), binary],
                        names=["doc_id", "start", "length", "doc_tokens", "ids"],
                    )

    return run


def cut_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """The pieces of docs (doc_id, text): doc_id, start, length, doc_tokens, and ids as little-endian 32-bit numbers."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_cut(tokenizer, length, end), PIECES)


def pack_histogram(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, dict[int, int]]]:
    """Patterns as (count, {piece length: how many}), in the order in which they are finished.

    Work and result grow with the number of distinct lengths, not with the counts.
    """
    open_by_room: dict[int, list[tuple[int, dict[int, int]]]] = {}
    done: list[tuple[int, dict[int, int]]] = []
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        room = length - 1
        while left:
            while room >= size and not open_by_room.get(room):
                room -= 1
            if room < size:  # no open pack takes it: start new ones, each filled with as many as fit
                each = length // size
                full, rest = divmod(left, each)
                for count, n in ((full, each), (1 if rest else 0, rest)):
                    if count:
                        (open_by_room.setdefault(length - n * size, []) if length > n * size else done).append((count, {size: n}))
                break
            count, pack = open_by_room[room].pop()
            used = min(count, left)
            if count > used:
                open_by_room[room].append((count - used, pack))
            new = pack | {size: pack.get(size, 0) + 1}
            (open_by_room.setdefault(room - size, []) if room > size else done).append((used, new))
            left -= used
    return done + [p for room in sorted(open_by_room) for p in open_by_room[room]]


def _ranges(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple]:
    """(length, first rank, end rank, pieces a pack, first sequence, offset) for each pattern and length."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pack in patterns:
        offset = 0
        for size in sorted(pack, reverse=True):
            first = rank.get(size, 0)
            rank[size] = first + count * pack[size]
            rows.append((size, first, rank[size], pack[size], sequence, offset))
            offset += size * pack[size]
        sequence += count
    return rows


def pack(pieces: DataFrame, length: int = LENGTH, tie: tuple[str, ...] = ("doc_id", "start"), slice_rows: int = 20_000) -> DataFrame:
    """pieces (with a column length) and, for each, sequence_id and its offset there. pieces is read more than once: hand in a table."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `length` rows
    ranges = spark.createDataFrame(_ranges(pack_histogram(histogram, length)), "length long, r0 long, r1 long, each long, s0 long, o0 long")
    slices = max(1, sum(histogram.values()) // slice_rows)
    sliced = pieces.withColumn("__slice", F.pmod(F.xxhash64(*tie), F.lit(slices)))
    counts = sliced.groupBy("length", "__slice").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))).drop("__n")
    ranked = sliced.withColumn("__in", F.row_number().over(Window.partitionBy("length", "__slice").orderBy(*tie)) - 1)
    ranked = ranked.join(before, ["length", "__slice"]).withColumn("__rank", F.coalesce("__before", F.lit(0)) + F.col("__in"))
    # the ranges are bounded by `length`: at most a few for each length
    r = F.broadcast(ranges.withColumnRenamed("length", "__length"))
    joined = ranked.join(r, (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("r0")) & (F.col("__rank") < F.col("r1")))
    at = F.col("__rank") - F.col("r0")
    return joined.withColumn("sequence_id", F.col("s0") + F.floor(at / F.col("each")).cast("long")).withColumn("offset", F.col("o0") + at % F.col("each") * F.col("length")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Packed pieces with their ids' checksum in place of the ids."""
    pieces = cut_documents(docs, tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    out = pack(materialise(pieces, "pieces"), tie=("doc_id", "start", "ids_crc32", "doc_tokens"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
