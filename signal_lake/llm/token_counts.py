"""Token counts without ids: pieces are counted once per distinct pre-token and joined to the pre-token frequencies.

A pre-token that is itself an entry of the tokenizer's vocabulary (a bounded table) is resolved where the text is
read. For the rest, each batch of documents leaves one row per distinct pre-token, with the places and frequencies
of its documents in the batch, so that a frequent pre-token sends a row per batch however many documents hold it.
Spark deals these rows by pre-token, the pieces of each are counted once, and the sums go back to the documents.

Defined cases: a null text is an empty text, with no tokens; each row that came in gives one row, so repeated rows
give repeated results and doc_id may be null or repeat; other columns are not carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signal_lake.llm.common import table

#: Tokens above which a document counts as over the limit.
LIMIT = 512
#: Characters of text that one batch of pre-tokens covers at most, but for a single longer text.
BATCH_CHARS = 32_000_000
#: Documents in one batch at most: their places take two bytes.
BATCH_DOCS = 60_000

#: The pre-token pattern of byte-level BPE, and its form for texts in Latin-1, for which Python's re agrees with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Characters that the two forms class differently, or that lie outside Latin-1.
UNLIKE = "[^\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\xff]"

_workers: dict = {}


class PreTokens:
    """A tokenizer file's pre-tokens and pieces; one for each Python worker."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.split = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.latin, self.any, self.unlike = re.compile(LATIN), regex.compile(PATTERN), re.compile(UNLIKE)
        vocab = [self.tokenizer.decode([i], skip_special_tokens=False) for i in range(self.tokenizer.get_vocab_size())]
        vocab = [v for v in vocab if v and "�" not in v and v not in self.special]
        self.known = dict(zip(vocab, self.pieces(vocab)))

    @classmethod
    def at(cls, path: str) -> PreTokens:
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(pre_tokens, add_special_tokens=False)]

    def frequencies(self, text: str) -> tuple[int, Counter]:
        """The number of special strings, and the pre-tokens between them with their frequencies."""
        n, parts = 0, [text]
        if self.split and any(map(text.__contains__, self.special)) and (n := len(self.split.findall(text))):
            parts = self.split.split(text)
        found: Counter = Counter()
        for part in parts:
            found.update((self.any if self.unlike.search(part) else self.latin).findall(part))
        return n, found


#: A row of a pre-token: its places in the batch and their frequencies, as binary. A row of a document: the rest.
SCHEMA = "batch long, word string, places binary, counts binary, place int, doc_id long, n_bytes long, base long"
_KINDS = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
_NAMES = ["batch", "word", "places", "counts", "place", "doc_id", "n_bytes", "base"]


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary value for each stretch of values that begins at starts (and ends at the next)."""
    offsets = (starts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _batch(pre: PreTokens, batch: int, doc_ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
    number: dict[str, int] = {}
    n_bytes, base, places, words, counts = [], [], [], [], []
    for place, text in enumerate(texts):
        n, found = pre.frequencies(text)
        for word, count in found.items():
            if (known := pre.known.get(word)) is not None:
                n += known * count
            else:
                words.append(number.setdefault(word, len(number)))
                counts.append(count)
        places.append(len(words))
        n_bytes.append(len(text.encode()))
        base.append(n)
    docs = len(texts)
    columns = [pa.array(np.full(docs, batch)), *(pa.nulls(docs, k) for k in _KINDS[1:4]), *map(pa.array, (np.arange(docs, dtype=np.int32), pa.array(doc_ids, pa.int64()), n_bytes, base))]
    yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, _KINDS)], names=_NAMES)
    if number:
        word, count = np.array(words, np.int32), np.array(counts, np.int64)
        place = np.repeat(np.arange(docs), np.diff(places, prepend=0))
        parts = -(-count // 255)  # a frequency of over a byte takes several entries
        word, place, most = np.repeat(word, parts), np.repeat(place, parts), np.repeat(count, parts)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
        count = np.minimum(most - 255 * nth, 255)
        order = np.argsort(word, kind="stable")
        starts = np.searchsorted(word[order], np.arange(len(number) + 1))
        columns = [pa.array(np.full(len(number), batch)), pa.array(list(number), pa.string()), _binary(place[order].astype("<u2"), starts), _binary(count[order].astype("<u1"), starts), *(pa.nulls(len(number), k) for k in _KINDS[4:])]
        yield pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _read(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, ids, texts, size = PreTokens.at(path), [], [], 0
        batch = TaskContext.get().partitionId() << 32
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                if texts and (size >= BATCH_CHARS or len(texts) >= BATCH_DOCS):
                    yield from _batch(pre, batch, ids, texts)
                    ids, texts, size = [], [], 0
                    batch += 1
                text = text.as_py()
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield from _batch(pre, batch, ids, texts)

    return run


def _sum(path: str):
    """From rows sorted by word: pieces once per distinct word, then one sum per batch and place; documents pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, last, last_pieces = PreTokens.at(path), None, 0
        for b in batches:
            words = b.column(1).to_pylist()
            is_word = np.array([w is not None for w in words], bool)
            docs = b.filter(pa.array(~is_word))
            if docs.num_rows:
                yield pa.RecordBatch.from_arrays([docs.column(i) for i in (0, 4, 5, 6, 7)], names=["batch", "place", "doc_id", "n_bytes", "n"])
            rows = b.filter(pa.array(is_word))
            if not rows.num_rows:
                continue
            words = [w for w in words if w is not None]
            new = np.array([w != before for w, before in zip(words, [last, *words])], bool)
            pieces = np.array([last_pieces, *pre.pieces([w for w, n in zip(words, new) if n])], np.int64)[np.cumsum(new)]
            last, last_pieces = words[-1], int(pieces[-1])
            places, counts = (np.frombuffer(b"".join(rows.column(i).to_pylist()), t).astype(np.int64) for i, t in ((2, "<u2"), (3, "<u1")))
            per_row = np.array([len(c) for c in rows.column(3).to_pylist()])
            which, at = np.unique(rows.column(0).to_numpy(), return_inverse=True)
            key, of = np.unique(np.repeat(at, per_row) * (1 << 16) + places, return_inverse=True)
            total = np.bincount(of, weights=counts * np.repeat(pieces, per_row)).astype(np.int64)
            none = pa.nulls(len(key), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(which[key >> 16]), pa.array((key & 0xFFFF).astype(np.int32)), none, none, pa.array(total)], names=["batch", "place", "doc_id", "n_bytes", "n"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text); docs is a table, read in the same order whenever a task is run again."""
    read = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = read.mapInArrow(_read(tokenizer), SCHEMA).repartition(F.coalesce("word", F.concat_ws(" ", F.lit(""), "batch", "place"))).sortWithinPartitions("word")
    sums = dealt.mapInArrow(_sum(tokenizer), "batch long, place int, doc_id long, n_bytes long, n long")
    n = F.col("n_tokens")
    return sums.groupBy("batch", "place").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")).select("doc_id", "n_bytes", n, (n > limit).alias("over_limit"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
