"""Exact top-k inner products by columnar branch and bound.

Components are integers, floor(SCALE * x). Spark deals the vectors into cells and the queries into groups, both of
bounded size, and each square of a cell and a group is one task's work. There a cell lies by dimension: the dimensions
that hold most of the cell's mass come first, in blocks. Products are summed block by block for many queries at a
time; the best by the sum so far are finished at once, and their k-th best score is a bound that no result can be
below. A candidate whose sum so far plus the greatest product that the norms of the remaining dimensions allow does not
reach the bound is dropped; once few are left, a query goes on with its survivors alone. The best of each square meet
by query.

Defined cases: a row without vec_id, or whose vector is null or holds a null or non-finite component, takes no part;
an empty vector is the zero vector, and a shorter vector has zeros for what it lacks; rows with the same vec_id and
vector are queries and candidates each for themselves, and rows with the same vec_id and other vectors too (told apart
by a 64-bit hash of the vector); a table with fewer candidates than k gives all of them; an empty table gives no
rows; other columns are not carried. Scores must fit a long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signal_lake.llm.common import table

K, EVERY, SCALE = 20, 20, 64
#: Components in a cell and in a group of queries at most, on average: they bound a task's memory.
CELL, GROUP = 1 << 22, 1 << 20
#: Cells and groups at least, so that small tables are several tasks' work too.
LEAST_PARTS = 4
#: Dimensions of a block, and queries that are worked on together.
BLOCK, TOGETHER = 16, 64
#: A query goes on with its own survivors once fewer than this share of the cell is left, over the queries together.
FEW = 0.1


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, values, h (a hash of the values) and copies: the distinct rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    values = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")))
    told = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return told.select("vec_id", values.alias("values")).groupBy("vec_id", "values").agg(F.count("*").alias("copies")).withColumn("h", F.xxhash64("values"))


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """One row a vector, with zeros beyond its length."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if len(values) == len(sizes) * d:
        return values.reshape(len(sizes), d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.arange(d) < sizes[:, None]] = values
    return out


def _norms_after(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """For each block, every vector's norm over the dimensions of the blocks after it, rounded up."""
    rest, out = np.zeros(blocks[0].shape[1]), []
    for b in reversed(blocks):
        out.append(np.sqrt(rest) * (1 + 1e-9))
        rest = rest + np.square(b.astype(np.float64)).sum(axis=0)
    return out[::-1]


class Cell:
    """Vectors in vertical layout: for each block of dimensions, a row a dimension."""

    def __init__(self, values: np.ndarray, largest_query: float):
        mass = np.square(values.astype(np.float64)).sum(axis=0)
        self.dims = np.argsort(-mass, kind="stable")
        # Sums below these bounds are exact in floats, which multiply faster.
        largest = np.sqrt(np.square(values.astype(np.float64)).sum(axis=1).max(initial=0)) * largest_query
        self.kind = np.float32 if largest < 1 << 23 else np.float64 if largest < 1 << 52 else np.int64
        self.slack = 0 if largest < 1 << 52 else largest * 1e-12  # beyond them, bounds are rounded
        self.blocks = self.vertical(values)
        self.after = _norms_after(self.blocks)

    def vertical(self, values: np.ndarray) -> list[np.ndarray]:
        cuts = range(0, max(1, len(self.dims)), BLOCK)
        return [np.ascontiguousarray(values[:, self.dims[c : c + BLOCK]].T.astype(self.kind)) for c in cuts]

    def best(self, queries: list[np.ndarray], k: int, own: np.ndarray):
        """(query, candidate, score) of all that can be among each query's k best; own: a candidate that is left out, or -1."""
        n, m = self.blocks[0].shape[1], queries[0].shape[1]
        after = _norms_after(queries)
        whole = np.concatenate(self.blocks), np.concatenate(queries)
        bound = np.full(m, -np.inf)
        sums = np.zeros((m, n), self.kind)
        for b, (x, q) in enumerate(zip(self.blocks, queries)):
            sums += q.T @ x
            if n > k + 1:
                top = np.argpartition(sums, n - k - 1, axis=1)[:, n - k - 1 :]
                for i in range(m):
                    scores = (whole[1][:, i] @ whole[0][:, top[i]])[top[i] != own[i]]
                    bound[i] = max(bound[i], np.sort(scores)[-k])
            alive = sums + np.outer(after[b], self.after[b]) >= bound[:, None] - self.slack
            if np.count_nonzero(alive) < FEW * n * m or b == len(queries) - 1:
                break
        for i in range(m):
            left = np.flatnonzero(alive[i])
            left = left[left != own[i]]
            score = sums[i, left]
            for later in range(b + 1, len(queries)):
                score = score + queries[later][:, i] @ self.blocks[later][:, left]
                stay = score + after[later][i] * self.after[later][left] >= bound[i] - self.slack
                left, score = left[stay], score[stay]
            yield i, left, score


RESULTS = "query_id long, query_h long, query_copies long, vec_id long, score long, copies long"


def _square(cell: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best candidates of a cell for each query of a group, by score and then vec_id."""
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    if cell.num_rows and queries.num_rows:
        d = max(int(t.column("values").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max()) for t in (cell, queries))
        vectors, asked = _matrix(cell.column("values"), d), _matrix(queries.column("values"), d)
        held = Cell(vectors, float(np.sqrt(np.square(asked.astype(np.float64)).sum(axis=1).max())))
        ids, h, copies = (cell.column(c).to_numpy() for c in ("vec_id", "h", "copies"))
        at = {key: i for i, key in enumerate(zip(ids.tolist(), h.tolist()))}
        q_ids, q_h, q_copies = (queries.column(c).to_numpy() for c in ("vec_id", "h", "copies"))
        for start in range(0, len(q_ids), TOGETHER):
            rows = slice(start, start + TOGETHER)
            same = np.array([at.get(key, -1) for key in zip(q_ids[rows].tolist(), q_h[rows].tolist())])
            # A query that is there more than once is a candidate of its copies.
            alone = np.where((same >= 0) & (copies[same] < 2), same, -1)
            for i, left, score in held.best(held.vertical(asked[rows]), k, alone):
                order = np.lexsort((ids[left], -score))[:k]
                left, score = left[order], score[order].astype(np.int64)
                number = copies[left] - (left == same[i])
                for values, x in zip(out, (q_ids[start + i], q_h[start + i], q_copies[start + i])):
                    values.append(np.full(len(left), x))
                for values, x in zip(out[3:], (ids[left], score, number)):
                    values.append(x)
    names = [c.split()[0] for c in RESULTS.split(", ")]
    return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.int64()) for c, v in zip(names, out)})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k best rows of vectors but itself, ties by vec_id.

    Both are as integer_vectors gives them."""
    size = F.coalesce(F.sum(F.size("values")), F.lit(0)).alias("n")
    cells = max(LEAST_PARTS, -(-vectors.agg(size).first().n // CELL))
    groups = max(LEAST_PARTS, -(-queries.agg(size).first().n // GROUP))

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        """A part by hash, and a copy for each part of the other side."""
        part = F.pmod(F.xxhash64("vec_id", "h", F.lit(own)), F.lit(parts)).alias(own)
        return df.select("*", part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other))

    cell, group = dealt(vectors, "cell", cells, "grp", groups), dealt(queries, "grp", groups, "cell", cells)
    best = cell.groupBy("cell", "grp").cogroup(group.groupBy("cell", "grp")).applyInArrow(lambda a, b: _square(a, b, k), RESULTS)
    each = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
    order = Window.partitionBy("query_id", "query_h").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("query_copies")))).select("query_id", "rank", "vec_id", "score")


def op11_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP11_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % {EVERY} = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= {K}
"""
