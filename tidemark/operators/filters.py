"""Filters with counters, duplicate rules, bounds, resume filters and positional samples.

Row-number filters keep at most k rows per key: Spark limits each map partition to k rows per key before the
shuffle, so a hot key costs one small sort per task rather than one big one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ADDRESS_MIN_LENGTH
from tidemark.operators import ranking


def reason_of(rules: dict[str, Column]) -> Column:
    """Name of the first rule a row fails, null when it passes all of them."""
    chain = None
    for name, failed in rules.items():
        failed = F.coalesce(failed, F.lit(False))
        chain = F.when(failed, name) if chain is None else chain.when(failed, name)
    return chain


def filter_with_reasons(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, counts per reason with ``raw_rows`` and ``kept_rows``); rules apply in order."""
    marked = df.withColumn("reason", reason_of(rules))
    kept = marked.where(F.col("reason").isNull()).drop("reason")
    counts = marked.groupBy("reason").agg(F.count("*").alias("n"))
    shape = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_rows"),
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("kept_rows"),
        *[F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("n"))), F.lit(0)).alias(r) for r in rules],
    )
    return kept, shape


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first k rows per key in a stated order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key; blank or missing keys are dropped. File order must be a column."""
    for key in keys:
        df = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return top_rows(df, keys, order)


def dedupe_priority(df: DataFrame, keys: Sequence[str], priority: Column, order: Sequence[Column]) -> DataFrame:
    """Highest priority wins, then the first row."""
    return top_rows(df, keys, [priority.desc(), *order])


def dedupe_last_collect(df: DataFrame, key: Column, ordinal: str, collect: str, name: str, key_name: str) -> DataFrame:
    """Last record per key; one column is collected as a sorted set (of labels, so its size is bounded)."""
    fields = [c for c in df.columns if c != collect]
    return (
        df.groupBy(key.alias(key_name))
        .agg(
            F.max_by(F.struct(*fields), F.col(ordinal)).alias("__last"),
            F.array_join(F.array_sort(F.collect_set(collect)), ",").alias(name),
        )
        .select(key_name, *[F.col(f"__last.{f}") for f in fields if f != key_name], name)
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[Column] = ()) -> DataFrame:
    return top_rows(df, keys, [F.col(ts).desc(), *tie])


# Rank of a scan status when two ledgers disagree; any other label ranks as an error.
STATUS_RANK = {"collection_error": 0, "processed_zero_rows": 1, "processed_with_rows": 2}


def status_rank(status: Column) -> Column:
    chain = F.lit(0)
    for label, rank in STATUS_RANK.items():
        chain = F.when(status == label, rank).otherwise(chain)
    return chain


def dedupe_ranked(df: DataFrame, keys: Sequence[str], status: str, rows: str, at: str) -> DataFrame:
    """Best ledger row per unit: status rank, then rows observed, then collection time."""
    return top_rows(df, keys, [status_rank(F.col(status)).desc(), F.col(rows).desc_nulls_last(), F.col(at).desc_nulls_last()])


def distinct_on(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropDuplicates(list(keys))


def duplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``df``, failing at run time on a repeated key; the count of repeats is a scalar subquery."""
    repeats = duplicated(df, keys).agg(F.count("*").alias("repeats"))
    message = F.concat(F.lit(f"duplicate key {', '.join(keys)}: "), F.col("repeats").cast("string"))
    gate = repeats.select(F.when(F.col("repeats") > 0, F.raise_error(message)).otherwise(F.lit(0)))
    return df.where(gate.scalar() == 0)


def filter_bounds(df: DataFrame, column: str, low, high) -> DataFrame:
    """Closed bounds; a missing value is outside. The comparison is pushed to the scan."""
    return df.where(F.col(column).between(F.lit(low), F.lit(high)))


def pending(work: DataFrame, ledger: DataFrame, keys: Sequence[str], status: str) -> DataFrame:
    """Work units no ledger row has marked as processed."""
    done = ledger.where(F.col(status).startswith("processed_")).select(*keys)
    return work.join(done, list(keys), "left_anti")


def sample_positions(df: DataFrame, n: int, strategy: str, order: str, tie: str) -> DataFrame:
    """Deterministic sample of n rows: ``first``, ``latest``, ``top`` or ``even`` (rounded even spacing)."""
    if strategy == "first":
        return df.orderBy(F.asc(order), F.asc(tie)).limit(n)
    if strategy == "latest":
        return df.orderBy(F.desc(order), F.desc(tie)).limit(n)
    if strategy == "top":
        return df.orderBy(F.desc(order), F.asc(tie)).limit(n)
    if strategy != "even":
        raise ValueError(f"unknown sampling strategy: {strategy}")
    indexed = ranking.global_index(df, order, tie)
    size = df.where(F.col(order).isNotNull()).agg(F.count("*").alias("size"))
    step = (F.col("size") - 1) / F.lit(max(n - 1, 1))
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * step).cast("bigint") + 1)
    wanted = size.where("size > 0").select(F.explode(F.array_distinct(spots)).alias("row_index"))
    return indexed.join(wanted, "row_index", "left_semi").drop("row_index")


def eligible(df: DataFrame, status: str, address: str, fallback: str, name: str) -> DataFrame:
    """Rows with status ok and a usable address: the first one that is long enough."""
    def usable(column: str) -> Column:
        return F.when(F.length(F.col(column)) >= ADDRESS_MIN_LENGTH, F.col(column))

    chosen = F.coalesce(usable(address), usable(fallback))
    return df.where(F.col(status) == "ok").withColumn(name, chosen).where(F.col(name).isNotNull())
