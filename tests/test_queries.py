"""Every query of the library against its SQL, over whole tables."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from signal_lake.plans import catalogue
from tests.conftest import check_against_sql


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    check_against_sql(spark, sf_dir, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    assert got.columns and got.count() > 0


def test_ladder_counts_fetches_of_months(spark, sf_dir, tmp_path):
    """Each series' newest fetch is more than 60 hours old here."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderdate < '1998-05-01'").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute("SELECT count(DISTINCT o_orderpriority) FROM orders").fetchone()[0]
    closing = f"{tmp_path}/late"
    spark.read.parquet(str(tmp_path / "orders.parquet")).withColumn("o_custkey", F.col("o_custkey") * 11).write.parquet(f"{closing}/orders.parquet")  # no market has closed
    assert catalogue.QUERIES["fresh_ladder"](spark, closing).select("series").distinct().count() == want > 0
