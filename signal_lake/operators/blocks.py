"""Long series in blocks of rows: what looks back over a bounded number of rows runs in tasks that grow with the rows, not with the keys.

Rows are numbered in two phases: inside stretches of time, and by a scan over the stretches' counts, which is the only step that has
a key's stretches together. Blocks are then cut by number, and each block is given the last rows of the one before it, so
that whatever looks back that far gives in a block what it gives in the whole series. A mean that forgets
exponentially looks back as far as doubles remember.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a block gets of the one before it: more than the slowest mean (one in 27) remembers. Rows of a block. Days of a stretch.
HALO, ROWS, STRETCH = 720, 20_000, 365


def stretch(df: DataFrame, order: str, days: float = STRETCH) -> Column:
    """The stretch of time that a row's `order` (a date, a timestamp or seconds) lies in."""
    kind = df.schema[order].dataType
    if isinstance(kind, T.DateType):
        return F.floor(F.unix_date(order) / days).cast("long")
    seconds = F.unix_micros(F.col(order).cast("timestamp")) / 1e6 if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.col(order)
    return F.floor(seconds / (days * 86_400)).cast("long")


def numbered(df: DataFrame, key: str = "symbol", order: str = "date", out: str = "__i", days: float = STRETCH) -> DataFrame:
    """df with the number of each row in its key by `order`, from 0. Rows of one key have different times."""
    parts = df.withColumn("__st", stretch(df, order, days)).repartition(key, "__st")  # dealt once, for both phases
    local = parts.withColumn(out, F.row_number().over(Window.partitionBy(key, "__st").orderBy(order)))
    before = Window.partitionBy(key).orderBy("__st").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(key, "__st").agg(F.count("*").alias("__c")).select(key, "__st", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    return local.join(offsets, [key, "__st"]).withColumn(out, F.col(out) - 1 + F.col("__o")).drop("__st", "__o")


def in_blocks(df: DataFrame, f: Callable[[DataFrame], DataFrame], key: str = "symbol", order: str = "date", rows: int = ROWS, halo: int = HALO, days: float = STRETCH) -> DataFrame:
    """f(df), for an f that works on each key by `order`, keeps all columns and looks back over `halo` rows at most: f is given blocks
    as keys, and the rows that a block was lent are left out of what it gives."""
    if halo > rows:
        raise ValueError("a block lends rows to the next one only")
    own, place = F.floor(F.col("__i") / rows), F.col("__i") % rows
    given = F.struct(own.alias("block"), F.lit(False).alias("lent"))
    also = F.struct((own + 1).alias("block"), F.lit(True).alias("lent"))
    at = numbered(df, key, order, "__i", days).withColumn("__g", F.explode(F.when(place >= rows - halo, F.array(given, also)).otherwise(F.array(given))))
    named = at.withColumn(key, F.struct(F.col(key).alias("key"), F.col("__g.block").alias("block"))).withColumn("__lent", F.col("__g.lent")).drop("__i", "__g")
    return f(named).where(~F.col("__lent")).withColumn(key, F.col(f"{key}.key")).drop("__lent")
