"""Keyed changes of tables as folds over their rows in order of arrival (a table and a batch are one log)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(log: DataFrame, key: list[str], arrival: list[str], updated: list[str]) -> DataFrame:
    """One row a key: `updated` from the last arrival, every other column from the first."""
    order = F.struct(*arrival)
    frozen = [c for c in log.columns if c not in key and c not in updated]
    return log.groupBy(*key).agg(*[F.min_by(c, order).alias(c) for c in frozen], *[F.max_by(c, order).alias(c) for c in updated])


def replace(log: DataFrame, key: list[str], arrival: list[str], keep: str = "last") -> DataFrame:
    """One whole row a key, the last or the first to arrive."""
    order = F.struct(*arrival)
    pick = F.max_by if keep == "last" else F.min_by
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(pick(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def upsert_until_final(log: DataFrame, key: list[str], arrival: list[str], value: str, final) -> DataFrame:
    """One value a key: the first final one freezes it, until then the last one counts."""
    order = F.struct(*arrival)
    frozen = F.min_by(F.struct(value), F.when(final, order)).alias("f")
    return log.groupBy(*key).agg(frozen, F.max_by(value, order).alias("l"), F.bool_or(final).alias("is_final")).select(*key, F.when(F.col("is_final"), F.col(f"f.{value}")).otherwise(F.col("l")).alias(value), "is_final")


def new_keys(stored: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """The batch's rows whose key is not stored (insert or ignore)."""
    return batch.join(stored.select(*key), key, "left_anti").dropDuplicates(key)


def keep_last(rows: DataFrame, key: list[str], arrival: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in arrival])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def gaps(cached: DataFrame, wanted: DataFrame, key: list[str], ts: str) -> DataFrame:
    """The spans (key, from, to) that are wanted (key, start, end) and not cached; the tail begins at the newest row held."""
    held = cached.groupBy(*key).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    spans = wanted.join(held, key, "left").select(
        *key,
        F.explode(F.array_compact(F.array(
            F.when(F.col("lo").isNull(), F.struct(F.col("start").alias("from"), F.col("end").alias("to"))),
            F.when(F.col("start") < F.col("lo"), F.struct(F.col("start").alias("from"), F.col("lo").alias("to"))),
            F.when(F.col("end") > F.col("hi"), F.struct(F.col("hi").alias("from"), F.col("end").alias("to"))),
        ))).alias("s"),
    )
    return spans.select(*key, "s.from", "s.to")
