"""Filter interaction audit: what five filters remove in each of their orders, from a histogram of failure masks.

Native expressions turn a text into the bits of the filters that it fails; whether a smaller doc_id has the same text
comes from a groupBy over the texts' SHA-256. Documents are counted by part and mask first, so a source or a group of
copies that holds a third of all rows is counted where it is read, and a part comes down to at most 32 cells. All
120 orders are worked out from the cells: a cell is removed by the first filter of an order whose bit it has.

Defined cases: a null text is an empty text, and equal to one; a null source is the part ''; a null doc_id is no
smaller than any other and has none smaller, so its row passes E and has no labels; rows with one doc_id and one text
are no copies of each other; a document is good or toxic if any of its labels says so, and null labels say nothing;
an empty table has no parts and gives no rows; other columns are not carried.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signal_lake.llm.common import table
from signal_lake.llm.quality import words_of

LETTERS = "ABCDE"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORDERS = ["".join(p) for p in permutations(LETTERS)]


def bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def text_mask(text: Column, words: Column) -> Column:
    """The bits of the filters that a text fails by itself, A to D."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    fails = {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}
    return sum((F.when(f, bit(k)).otherwise(0) for k, f in fails.items()), F.lit(0))


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic (long): the documents of each part by the set of filters that they fail, sets without any left out."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("t")).withColumn("words", words_of(F.col("t")))
    masks = read.select("doc_id", "part", text_mask(F.col("t"), F.col("words")).alias("mask"), F.unhex(F.sha2("t", 256)).alias("digest"))
    # Rows without a doc_id are spread by their text: they have no labels to meet.
    rows = masks.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")).withColumn("at", F.coalesce("doc_id", F.xxhash64("digest")))
    said = labels.groupBy(F.col("doc_id").alias("label_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("is_good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("is_toxic")
    )
    told = rows.join(said, (F.col("at") == F.col("label_id")) & F.col("doc_id").isNotNull(), "left").withColumns(
        {"is_good": F.coalesce("is_good", F.lit(False)), "is_toxic": F.coalesce("is_toxic", F.lit(False))}
    )
    # A text's copies come down to a row a part and label; of each, the rows at its smallest doc_id are counted apart.
    known = F.col("doc_id").isNotNull()
    copies = told.groupBy("digest", "part", "mask", "is_good", "is_toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_known"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("least")
    )
    first = copies.groupBy("digest").agg(F.min("least.doc_id").alias("first_id"))
    later = F.col("n_known") - F.when(F.col("least.doc_id") == F.col("first_id"), F.col("least.n")).otherwise(0)
    counted = copies.join(first, "digest").withColumn("later", later)

    def sums(n: Column) -> Column:
        return F.struct(*[F.coalesce(F.sum(F.when(c, n)), F.lit(0)).alias(k) for k, c in (("n", F.lit(True)), ("good", F.col("is_good")), ("toxic", F.col("is_toxic")))])

    by_text = counted.groupBy("part", "mask").agg(sums(F.col("n") - F.col("later")).alias("kept"), sums(F.col("later")).alias("copies"))
    split = F.explode(F.array(F.struct("mask", F.col("kept").alias("x")), F.struct((F.col("mask") + bit("E")).alias("mask"), F.col("copies").alias("x"))))
    return by_text.select("part", split.alias("s")).select("part", "s.mask", "s.x.*").where("n > 0")


def audit(cells: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, worked out from the part's cells (32 at most)."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = parts.select("part", "cells", F.explode(F.lit(ORDERS)).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    at = {k: F.instr("filter_order", k) for k in LETTERS}
    steps = steps.withColumns(
        {
            "own": sum((F.when(at[k] == F.col("step"), bit(k)).otherwise(0) for k in LETTERS), F.lit(0)),
            "before": sum((F.when(at[k] < F.col("step"), bit(k)).otherwise(0) for k in LETTERS), F.lit(0)),
        }
    )
    own, before = F.col("own"), F.col("before")

    def total(where, value=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda a, c: a + value(c))

    def fails(c: Column) -> Column:
        return c["mask"].bitwiseAND(own) != 0

    def gone(c: Column) -> Column:
        return c["mask"].bitwiseAND(before) != 0

    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: ~gone(c) & ~fails(c)).alias("kept"),
        total(lambda c: ~gone(c) & fails(c)).alias("removed"),
        total(lambda c: gone(c) & fails(c)).alias("redundant"),
        total(lambda c: c["mask"] == own).alias("unique_fails"),
        total(lambda c: ~gone(c) & fails(c), lambda c: c["good"]).alias("good_lost"),
        total(lambda c: ~gone(c) & fails(c), lambda c: c["toxic"]).alias("toxic_lost"),
        # Of the filters that a document fails, each is the first in an equal share of all orders.
        total(fails, lambda c: (c["n"] * len(ORDERS) / F.bit_count(c["mask"])).cast("long")).alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(histogram(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels")))


OP12_SQL = """
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
             100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS c,
             regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > first_id, FALSE) AS e
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
cells AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
                              CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed,
                 count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f(k) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT concat(f1.k, f2.k, f3.k, f4.k, f5.k) AS filter_order FROM f f1, f f2, f f3, f f4, f f5
      WHERE len(list_distinct([f1.k, f2.k, f3.k, f4.k, f5.k])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INTEGER), 1) AS own, substr(filter_order, 1, CAST(step AS INTEGER) - 1) AS earlier
      FROM o, range(1, 6) AS r(step)),
x AS (SELECT part, filter_order, step, own, n, good, toxic, failed, contains(failed, own) AS fails,
             len(list_intersect(string_split(failed, ''), string_split(earlier, ''))) > 0 AND failed <> '' AND earlier <> '' AS gone
      FROM cells, s),
g AS (SELECT part, filter_order, step, own,
             CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS BIGINT) AS removed,
             CAST(coalesce(sum(n) FILTER (gone AND fails), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (failed = own), 0) AS BIGINT) AS unique_fails,
             CAST(coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS BIGINT) AS toxic_lost
      FROM x GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g
"""
