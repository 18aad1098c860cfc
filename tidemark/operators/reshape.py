"""Pivots, horizon widening, spines and bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ranking

HORIZONS = (1, 7, 30)


def pivot_wide(df: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], measure: str) -> DataFrame:
    """Long to wide with the mean of duplicates; the column values are given, so no extra job lists them."""
    return df.groupBy(*keys).pivot(on, list(values)).agg(F.avg(measure))


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in columns], name, value)


def widen_horizons(rows: DataFrame, token: str, start: str) -> DataFrame:
    """One row per token from (token, horizon) rows: suffixed counts, activity and completeness, growth, lag, order."""
    def at(h: int, column: Column) -> Column:
        return F.max(F.when(F.col("horizon_days") == h, column))

    out = [F.max(start).alias(start)]
    for h in HORIZONS:
        out += [
            at(h, F.col("swap_count")).alias(f"swap_count_{h}d"),
            at(h, F.col("active_traders")).alias(f"active_traders_{h}d"),
            at(h, (F.col("swap_count") > 0).cast("int")).alias(f"active_{h}d"),
            at(h, F.coalesce(F.col("window_status") == "ok", F.lit(False)).cast("int")).alias(f"complete_{h}d"),
        ]
    out.append(at(30, F.col("first_trade_at")).alias("first_trade_at_30d"))
    wide = rows.groupBy(token).agg(*out)
    lag = (F.unix_micros(F.col("first_trade_at_30d").cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1e6
    return (
        wide.withColumn("first_trade_lag_seconds_30d", lag)
        .withColumn("temporal_order_violation_30d", F.coalesce(F.col("first_trade_lag_seconds_30d") < 0, F.lit(False)).cast("int"))
        .withColumn("complete_all_horizons", F.least(*[F.col(f"complete_{h}d") for h in HORIZONS]))
        .withColumn("log1p_swap_count_30d", F.log1p("swap_count_30d"))
        .withColumn("log1p_growth_1d_to_30d", F.log1p("swap_count_30d") - F.log1p("swap_count_1d"))
    )


def date_spine(spark_frame: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """Every day between two dates, from one row: the spine is generated, not joined."""
    one = spark_frame.sparkSession.range(1)
    return one.select(F.explode(F.sequence(F.lit(low).cast("date"), F.lit(high).cast("date"))).alias(name))


def densify(
    daily: DataFrame, unit: str, units: Sequence[str], date: str, low: str, high: str, counts: Sequence[str], rates: Sequence[str]
) -> DataFrame:
    """Full unit x day grid: an absent day has zero counts, but its rates stay null."""
    spine = date_spine(daily, low, high, date).withColumn(unit, F.explode(F.array(*[F.lit(u) for u in units])))
    joined = spine.join(daily, [unit, date], "left")
    return joined.select(unit, date, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts], *rates)


def dense_counts(events: DataFrame, creator: str, date: str, low: str, high: str) -> DataFrame:
    """Creator x day counts with zeros; the grid is generated from the creator list."""
    counts = events.groupBy(creator, date).agg(F.count("*").alias("n"))
    days = F.explode(F.sequence(F.lit(low).cast("date"), F.lit(high).cast("date"))).alias(date)
    grid = events.select(creator).distinct().select(creator, days)
    return grid.join(counts, [creator, date], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def expected_grid(manifest: DataFrame, launch_block: str, blocks_per_day: int, slack: int = 2000, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Every unit x horizon with its last block."""
    grid = manifest.withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return grid.withColumn("cutoff_block", F.col(launch_block) + F.col("horizon_days") * blocks_per_day + slack)


def rank_bins(df: DataFrame, value: str, q: int, tie: str, name: str) -> DataFrame:
    """q bins of the rank with ties broken by ``tie``: bin = ceil((r-1)*q/(n-1)) - 1 and 0 for the first row.

    Not ``ntile``: the bin sizes differ. Integer arithmetic, so no edge depends on rounding. Rows without a value
    stay, with a null bin.
    """
    indexed = ranking.global_index(df, value, tie, name="__r")
    size = df.where(F.col(value).isNotNull()).agg(F.count("*").alias("n")).scalar()
    joined = indexed.withColumn("__n", size)
    upper = F.expr(f"((__r - 1) * {int(q)} + greatest(__n - 1, 1) - 1) div greatest(__n - 1, 1)")
    binned = joined.withColumn(name, F.greatest(F.lit(0), upper - 1).cast("int")).drop("__r", "__n")
    return binned.unionByName(df.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("int")))
