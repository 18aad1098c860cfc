"""Helpers shared by the operators: table access, ASCII text rules, running totals and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.session import settle

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """How many pieces a range or hash layout gets: the cluster's own shuffle setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else. Pure ASCII strings (bytes = characters) take Spark's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def release_memory() -> None:
    """Give back what a finished batch held: Python workers live on, and the next operator needs the room."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_keys(*columns: Column) -> list[Column]:
    """A 128-bit key of a row, null-safe, so that repeated ids with other content stay apart."""
    parts = [p for c in columns for p in (c, c.isNull())]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (0, 1)]


def running_totals(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "before") -> DataFrame:
    """``rows`` plus ``name``: the sum of ``value`` over the earlier rows of the same key in ``order``.

    A key may hold most of the rows, so no window spans a key: rows are laid out by range, each range gets its
    own running sum, and the ranges' totals (one row per key and range) shift it. ``order`` must settle ties.
    """
    spark = rows.sparkSession
    piece = "__piece"
    placed = settle(rows.repartitionByRange(partitions(spark), *keys, *order).withColumn(piece, F.spark_partition_id()))
    totals = placed.groupBy(*keys, piece).agg(F.sum(value).alias("__total"))
    earlier = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.withColumn("__shift", F.coalesce(F.sum("__total").over(earlier), F.lit(0)))
    shifts = shifts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(piece).alias("__at"), "__shift")
    same = F.col(piece) == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = Window.partitionBy(*keys, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(shifts, same)
    return joined.select(*rows.columns, (F.col("__inside") + F.col("__shift")).alias(name))


def _digest(pairs: DataFrame) -> tuple:
    """Tells whether two sets of pairs are the same, without moving them."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b longs): rows (node, root), root the smallest node of the component.

    Alternating large-star and small-star rounds: the number of rounds grows with the logarithm of the longest path
    and the edges never outgrow the input. Each round is written to shared storage, so a lost executor costs a re-read.
    """
    spark = edges.sparkSession
    pairs = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType())])
    if pairs.isEmpty():
        return spark.createDataFrame([], schema)
    seen = _digest(pairs)
    while True:
        # large star: the larger neighbours of every node are hung below the smallest node it sees
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: the smaller neighbours of every node, and itself, are hung below the smallest of them
        large = settle(large)
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(floor.select("u", F.col("m").alias("v")))
        after = settle(hung.where("u != v").distinct())
        now = _digest(after)
        if now == seen:
            break
        pairs, seen = after, now
    return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """The fold of an id: crc32 of its text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
