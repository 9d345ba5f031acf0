"""Vectors and matrices read from Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vectors(df: DataFrame, key: str, column: str, t: str = "double") -> DataFrame:
    """(id, v): one vector a row."""
    return df.select(F.col(key).alias("id"), F.col(column).cast(f"array<{t}>").alias("v"))


def tall(df: DataFrame, *columns: str) -> DataFrame:
    """One matrix row a table row, as an array of the given numeric columns."""
    return df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))


def ragged(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(id, v): the values of each group as a vector, in order.

    One row a group: for groups of bounded length.  Use long forms beyond that.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("x"))))
    return df.groupBy(F.col(group).alias("id")).agg(F.transform(pairs, lambda p: p["x"]).alias("v"))
