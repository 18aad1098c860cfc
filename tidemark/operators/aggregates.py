"""Grouped statistics as ordinary partial aggregations; medians and quantiles come from ``ranking``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import safe_rate, week_start
from tidemark.operators import ranking


def agg_stats(df: DataFrame, keys: Sequence[str], columns: Sequence[str], quantiles: dict[str, float] | None = None) -> DataFrame:
    """Count, sum, mean and median per key and column, missing values skipped; long result by ``metric``.

    All columns share one pass: they are unpivoted, so a median costs one counting shuffle for all of them.
    """
    pairs = F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns]), F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns])
    )).alias("metric", "value")
    long = df.select(*keys, pairs)
    group = [*keys, "metric"]
    stats = long.groupBy(*group).agg(
        F.count("value").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean")
    )
    parts = ranking.quantiles(long, group, "value", quantiles or {"median": 0.5})
    return ranking.with_quantiles(stats, group, parts)


def n_unique(df: DataFrame, keys: Sequence[str], columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per key. Exact mode deduplicates (column, value) pairs once for all columns."""
    if approximate:
        return df.groupBy(*keys).agg(*[F.approx_count_distinct(c).alias(f"n_{c}") for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)]))
    distinct = df.select(*keys, pairs.alias("p")).select(*keys, "p.i", "p.v").distinct()
    return distinct.groupBy(*keys).agg(
        *[F.count(F.when(F.col("i") == i, F.col("v"))).alias(f"n_{c}") for i, c in enumerate(columns)]
    )


def agg_if(df: DataFrame, keys: Sequence[str], conditions: dict[str, Column], value: Column | None = None) -> DataFrame:
    """Per condition: how many rows meet it, whether any does and, with a value, the sum over them."""
    out = []
    for name, condition in conditions.items():
        out += [F.count_if(condition).alias(f"{name}_n"), F.coalesce(F.bool_or(condition), F.lit(False)).alias(f"{name}_any")]
        if value is not None:
            out.append(F.sum(F.when(condition, value)).alias(f"{name}_sum"))
    return df.groupBy(*keys).agg(*out)


def rate_by(df: DataFrame, keys: Sequence[str], flag: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(flag.cast("int")).alias("hits"), F.avg(flag.cast("double")).alias("rate"))


def rate_difference(df: DataFrame, group: Column, flag: Column) -> DataFrame:
    """Rate in the group minus rate outside it, in one row."""
    def rate(hit: Column) -> Column:
        return F.avg(F.when(hit, flag.cast("double")))
    row = df.agg(rate(group).alias("rate_in"), rate(~group).alias("rate_out"))
    return row.withColumn("rate_difference", F.col("rate_in") - F.col("rate_out"))


def weighted_moments(df: DataFrame, keys: Sequence[str], x: str, weight: str) -> DataFrame:
    """Weighted mean and population variance over positive weights; the variance needs at least two rows."""
    usable = F.col(x).isNotNull() & (F.col(weight) > 0)
    sums = df.where(usable).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(weight).alias("__w"),
        F.sum(F.col(weight) * F.col(x)).alias("__wx"),
        F.sum(F.col(weight) * F.col(x) * F.col(x)).alias("__wxx"),
    )
    mean = safe_rate(F.col("__wx"), F.col("__w"))
    spread = F.greatest(F.lit(0.0), safe_rate(F.col("__wxx"), F.col("__w")) - mean * mean)
    return sums.select(*keys, "n", mean.alias("weighted_mean"), F.when(F.col("n") > 1, spread).alias("weighted_var"))


def pooled_sd(df: DataFrame, keys: Sequence[str], x: str, group: str, how: str = "average") -> DataFrame:
    """``average``: sqrt((v1+v0)/2) of sample variances; ``union``: sample sd of both groups together."""
    if how == "union":
        return df.groupBy(*keys).agg(F.stddev_samp(x).alias("pooled_sd"))
    v1 = F.var_samp(F.when(F.col(group) == 1, F.col(x)))
    v0 = F.var_samp(F.when(F.col(group) == 0, F.col(x)))
    return df.groupBy(*keys).agg(F.sqrt((v1 + v0) / 2).alias("pooled_sd"))


def mode_of(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Most frequent label, the smallest one on ties. Counts are shuffled, not rows."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col(label).alias("label")))
    return counts.groupBy(*keys).agg(best.alias("b"), F.sum("n").alias("n")).select(
        *keys, F.col("b.label").alias("mode"), (-F.col("b.neg")).alias("mode_n"), "n"
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per label with their share of all rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*")).scalar()
    return counts.select(column, "n", (F.col("n") / total).alias("share"))


# Which ledger states the coverage summary counts.
COVERAGE_COUNTS = {
    "creator": ("observed",),
    "protocol_config": ("observed",),
    "pool_mapping": ("observed", "not_collected", "not_applicable"),
    "pool_initialization": ("observed",),
    "liquidity_initialization": ("observed",),
    "graduation": ("observed", "not_collected", "not_applicable"),
    "migration": ("observed", "not_collected", "not_applicable"),
}


def coverage_summary(ledger: DataFrame) -> DataFrame:
    """One row of state counts over a coverage ledger; swaps count by the prefix of their state."""
    counts = [F.count("*").alias("launch_universe")]
    for field, states in COVERAGE_COUNTS.items():
        counts += [F.count_if(F.col(f"{field}_status") == s).alias(f"{field}_{s}") for s in states]
    counts.append(F.count_if(F.col("decoded_swaps_status").startswith("not_collected")).alias("decoded_swaps_not_collected"))
    return ledger.agg(*counts)


def daily_cohorts(df: DataFrame, keys: Sequence[str], creator: str, flags: Sequence[str]) -> DataFrame:
    """Launches, distinct creators and, per 0/1 flag, its sum and rate.

    Rows are first reduced to (keys, creator), so the distinct count needs no expansion of the input.
    """
    per_creator = df.groupBy(*keys, creator).agg(
        F.count("*").alias("__n"), *[F.sum(f).alias(f"__{f}") for f in flags]
    )
    out = per_creator.groupBy(*keys).agg(
        F.sum("__n").alias("launches"), F.count(creator).alias("unique_creators"), *[F.sum(f"__{f}").alias(f) for f in flags]
    )
    return out.select(*out.columns, *[safe_rate(F.col(f), F.col("launches")).alias(f"{f}_rate") for f in flags])


def weekly_panel(panel: DataFrame, unit: str, date: str, volume: str, treated: str) -> DataFrame:
    """Monday weeks: summed volume, maximum of the treatment flag, and the logarithm of the sum (not a sum of logs)."""
    weekly = panel.groupBy(F.col(unit), week_start(F.col(date)).alias("week_start")).agg(
        F.sum(volume).alias("volume"), F.max(treated).alias("treated")
    )
    return weekly.withColumn("log_volume", F.log1p("volume"))


def first_last(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))


def coverage_record(df: DataFrame, entity: str, ts: str, target: int) -> DataFrame:
    """Entities and rows observed, share of a target population in percent, and the time span."""
    per_entity = df.groupBy(entity).agg(F.count("*").alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return per_entity.agg(
        F.count(entity).alias("observed_entities"), F.sum("n").alias("observed_rows"),
        (F.count(entity) * 100.0 / F.lit(target)).alias("percent_of_target"), F.min("lo").alias("first_at"), F.max("hi").alias("last_at"),
    )


def link_counts(df: DataFrame, handle: str, name: str = "tokens_per_handle") -> DataFrame:
    """Every row with the number of rows sharing its handle: counted once, joined back."""
    counts = df.where(F.col(handle).isNotNull()).groupBy(handle).agg(F.count("*").alias(name))
    return df.join(counts, handle, "left")


def channel_day(messages: DataFrame, channel: str, ts: str, views: str, forwards: str, replies: str) -> DataFrame:
    """Channel-day activity. Join it to tokens afterwards: channel totals must not multiply by linked tokens."""
    by_day = messages.withColumn("day", F.to_date(ts)).withColumn("__hour", F.hour(ts))
    hourly = by_day.groupBy(channel, "day", "__hour").agg(
        F.count("*").alias("n"), F.sum(views).alias("v"), F.sum(forwards).alias("f"), F.sum(replies).alias("r")
    )
    sums = hourly.groupBy(channel, "day").agg(
        F.sum("n").alias("message_count"), F.sum("v").alias("view_sum"), F.sum("f").alias("forward_sum"),
        F.sum("r").alias("reply_sum"), F.count("__hour").alias("active_hours"),
    )
    return ranking.with_quantiles(sums, [channel, "day"], ranking.quantiles(by_day, [channel, "day"], views, {"view_median": 0.5}))
