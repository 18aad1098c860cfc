"""Ranks, shares, running totals, lags and ordered cut-offs.

A share or a group mean is an aggregate joined back, not a window: the join can be broadcast or split by AQE,
whereas a window would pull a hot group into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import filters, ranking


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """Row number up to k per key; the bound lets Spark limit each task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def share_of(df: DataFrame, keys: Sequence[str], value: str, name: str = "share") -> DataFrame:
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    return df.join(totals, list(keys)).withColumn(name, F.try_divide(F.col(value), F.col("__total"))).drop("__total")


def group_mean(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return df.join(df.groupBy(*keys).agg(F.avg(value).alias(name)), list(keys))


def abs_rank(df: DataFrame, value: str, name: str = "abs_rank") -> DataFrame:
    """Rank by descending magnitude, ties sharing the smallest rank."""
    ranked = ranking.value_counts_with_rank(
        df.withColumn("__abs", F.abs(value)), [], "__abs", descending=True
    ).select("__abs", (F.col("before") + 1).cast("bigint").alias(name))
    return df.withColumn("__abs", F.abs(value)).join(ranked, "__abs", "left").drop("__abs")


def lag_products(df: DataFrame, keys: Sequence[str], order: str, value: str, lags: int) -> DataFrame:
    """Sum of e_t * e_(t-l) per series and lag, by row position, with the Bartlett weight 1 - l/(lags+1)."""
    w = Window.partitionBy(*keys).orderBy(order)
    products = [(F.col(value) * (F.col(value) if l == 0 else F.lag(value, l).over(w))).alias(f"__p{l}") for l in range(lags + 1)]
    pairs = F.array(*[F.struct(F.lit(l).alias("lag"), F.col(f"__p{l}").alias("p")) for l in range(lags + 1)])
    long = df.select(*keys, *products).select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.lag", "x.p")
    return long.groupBy(*keys, "lag").agg(F.sum("p").alias("product_sum"), F.count("p").alias("pairs")).withColumn(
        "bartlett", 1 - F.col("lag") / F.lit(lags + 1)
    )


def sliding_contrast(df: DataFrame, keys: Sequence[str], order: str, value: str, before: int, after: int) -> DataFrame:
    """Mean of the ``after`` rows from each start minus the mean of the ``before`` rows ahead of it, full frames only."""
    w = Window.partitionBy(*keys).orderBy(order)
    ahead, behind = w.rowsBetween(0, after - 1), w.rowsBetween(-before, -1)
    rows = df.select(
        *keys, order,
        (F.avg(value).over(ahead) - F.avg(value).over(behind)).alias("contrast"),
        F.count("*").over(ahead).alias("__a"), F.count("*").over(behind).alias("__b"),
    )
    return rows.where((F.col("__a") == after) & (F.col("__b") == before)).drop("__a", "__b")


def first_adoption(df: DataFrame, creator: str, ts: str, version: Column) -> DataFrame:
    return df.where(version).groupBy(creator).agg(F.min(ts).alias("adopted_at"))


def pre_counts(df: DataFrame, creator: str, ts: str, older: Column, newer: Column) -> DataFrame:
    """Older-version rows of an adopter strictly before its own first newer-version row."""
    adopters = first_adoption(df, creator, ts, newer)
    earlier = df.where(older).join(adopters, creator).where(F.col(ts) < F.col("adopted_at"))
    counts = earlier.groupBy(creator).agg(F.count("*").alias("pre_count"))
    return adopters.join(counts, creator, "left").withColumn("pre_count", F.coalesce("pre_count", F.lit(0)))


def sort_events(df: DataFrame, block: str, log_index: str) -> DataFrame:
    """Chain order; a missing block sorts as zero. A total order costs a range shuffle, so sort last."""
    return df.orderBy(F.coalesce(F.col(block), F.lit(0)), F.coalesce(F.col(log_index), F.lit(0)))


def topk_sum(df: DataFrame, keys: Sequence[str], value: str, k: int, name: str) -> DataFrame:
    """Sum of the k largest values per key; ties cannot change it."""
    return filters.top_rows(df, keys, [F.col(value).desc()], k).groupBy(*keys).agg(F.sum(value).alias(name))


def head_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.asc(c) for c in order]).limit(n)


def tail_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)
