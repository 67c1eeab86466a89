"""The scalar expressions as temporary functions of SQL, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "sl_rounded": ("x DOUBLE, digits INT", "CASE WHEN abs(x) * pow(10.0D, digits) >= 4503599627370496.0D THEN x ELSE signum(x) * floor(abs(x) * pow(10.0D, digits) + 0.5D) / pow(10.0D, digits) END"),
    "sl_clip": ("x DOUBLE, low DOUBLE, high DOUBLE", "CASE WHEN x IS NOT NULL THEN least(greatest(x, low), high) END"),
    "sl_squash": ("x DOUBLE, scale DOUBLE", "CASE WHEN scale = 0 THEN 0.0D ELSE tanh(x / scale) END"),
    "sl_decay": ("age DOUBLE, half_life DOUBLE", "pow(0.5D, greatest(age, 0.0D) / half_life)"),
    "sl_book": ("mode STRING", "CASE WHEN coalesce(mode, 'paper') LIKE 'paper%' THEN 'paper' ELSE 'live' END"),
}


def register(spark: SparkSession) -> None:
    for name, (parameters, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body}")
