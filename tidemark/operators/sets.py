"""Unions of unlike sources, overlap counts and membership flags."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_panel(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column a source lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct sizes of two key sets and of their intersection in one aggregation, with the share of b covered."""
    tagged = a.select(F.col(key).alias("k"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(
        b.select(F.col(key).alias("k"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    )
    per_key = tagged.where(F.col("k").isNotNull()).groupBy("k").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    sizes = per_key.agg(
        F.coalesce(F.sum("in_a"), F.lit(0)).alias("size_a"), F.coalesce(F.sum("in_b"), F.lit(0)).alias("size_b"),
        F.coalesce(F.sum(F.col("in_a") * F.col("in_b")), F.lit(0)).alias("size_both"),
    )
    return sizes.withColumn("share_of_b", F.try_divide(F.col("size_both").cast("double"), F.col("size_b").cast("double")))


def missing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only, with the side that has them."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("only_in", F.lit("a"))
    right = b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("only_in", F.lit("b"))
    return left.unionByName(right)


def covered_flag(df: DataFrame, covered: DataFrame, key: str, name: str = "covered") -> DataFrame:
    marks = covered.select(key).distinct().withColumn(name, F.lit(1))
    return df.join(marks, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def explode_nested_key(df: DataFrame, array: str, field: str, name: str) -> DataFrame:
    """Keys inside an array of structs, as rows."""
    return df.select(F.explode(array).alias("item")).select(F.col(f"item.{field}").alias(name))


def flag(column: Column) -> Column:
    return F.coalesce(column, F.lit(False)).cast("int")
