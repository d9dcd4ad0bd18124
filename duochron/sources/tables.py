"""Angles and frames read off wide tables: a wavevector and a direction for each supplier, a frame for each size of a part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def supplier_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(angle_idx, name, q, phi): one angle a supplier, q in 97 steps, phi from its balance, from about -300 to 250 degrees."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    q = F.lit(0.002) + (F.col("s_suppkey") % 97) * F.lit(0.0001)
    return s.select((F.col("s_suppkey") - 1).cast("int").alias("angle_idx"), F.col("s_name").alias("name"), q.alias("q"), (F.col("s_acctbal") / 20 - 250).alias("phi"))


def part_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, t): one frame for each size that a part has."""
    i = (F.col("p_size") - 1).cast("int")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(i.alias("i")).distinct().select("i", F.col("i").cast("double").alias("t"))


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i): one row a customer."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("i"))


#: The same tables in DuckDB SQL, as the beginning of a WITH clause.
SQL = """
WITH angle AS (SELECT (s_suppkey - 1)::INTEGER AS angle_idx, s_name AS name, 0.002::DOUBLE + (s_suppkey % 97) * 0.0001::DOUBLE AS q, s_acctbal / 20 - 250 AS phi FROM supplier),
frame AS (SELECT DISTINCT (p_size - 1)::INTEGER AS i, (p_size - 1)::DOUBLE AS t FROM part),
person AS (SELECT c_custkey AS i FROM customer)
"""
