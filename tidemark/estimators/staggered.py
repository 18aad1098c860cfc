"""Staggered adoption: group-time effects, influence values and activity profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ranking, reshape
from tidemark.session import settle


def group_time_cells(panel: DataFrame, creator: str, day: str, y: str, adopted: str) -> tuple[DataFrame, DataFrame]:
    """(cells, paired changes) of cohort x day effects against never-treated creators.

    ``panel`` has one row per observed creator-day; ``adopted`` is the cohort's first treated day or null. A change
    is the outcome on a day less the outcome on the base day (adoption day - 1), both observed. Never-treated rows
    meet one base value per cohort, so they repeat once per cohort and no more.
    """
    panel = settle(panel.select(creator, day, y, adopted))
    observed = panel.where(F.col(y).isNotNull()).select(creator, day, y, adopted)
    registered = panel.where(F.col(adopted).isNotNull()).select(creator, adopted).distinct().groupBy(F.col(adopted).alias("g")).agg(F.count("*").alias("registered"))
    treated, control = observed.where(F.col(adopted).isNotNull()), observed.where(F.col(adopted).isNull())
    base_t = treated.where(F.col(day) == F.col(adopted) - 1).select(creator, F.col(adopted).alias("g"), F.col(y).alias("base"))
    base_c = control.drop(adopted).join(registered.select("g", (F.col("g") - 1).alias("b")), F.col(day) == F.col("b")).select(creator, "g", F.col(y).alias("base"))

    def changes(rows: DataFrame, bases: DataFrame, side: int) -> DataFrame:
        return rows.select(creator, F.col(day).alias("t"), F.col(y)).join(bases, creator).where("t >= g").select(
            creator, "g", "t", (F.col(y) - F.col("base")).alias("dy"), F.lit(side).alias("side")
        )

    pairs = settle(changes(treated, base_t, 1).unionByName(changes(control, base_c, 0)))
    mean = lambda s: F.avg(F.when(F.col("side") == s, F.col("dy")))
    cells = pairs.groupBy("g", "t").agg(
        mean(1).alias("m1"), mean(0).alias("m0"), F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 0).alias("n0")
    ).where("n1 > 0 AND n0 > 0").join(registered, "g")
    return settle(cells.withColumn("att", F.col("m1") - F.col("m0"))), pairs


def influence_values(cells: DataFrame, pairs: DataFrame, creator: str) -> DataFrame:
    """Each creator's contribution to the aggregate: weighted centred changes over the supported cells."""
    weights = cells.agg(F.sum("registered")).scalar()
    sized = cells.withColumn("w", F.col("registered") / weights)
    rows = pairs.join(sized.select("g", "t", "m1", "m0", "n1", "n0", "w"), ["g", "t"])
    part = F.when(F.col("side") == 1, (F.col("dy") - F.col("m1")) / F.col("n1")).otherwise(-(F.col("dy") - F.col("m0")) / F.col("n0"))
    return rows.groupBy(creator).agg(F.sum(F.col("w") * part).alias("phi"))


def group_time_att(panel: DataFrame, creator: str, day: str, y: str, adopted: str) -> DataFrame:
    """Aggregate effect weighted by registered treated counts over supported cells, with its influence error."""
    cells, pairs = group_time_cells(panel, creator, day, y, adopted)
    point = cells.agg((F.sum(F.col("registered") * F.col("att")) / F.sum("registered")).alias("estimate"), F.count("*").alias("n_supported"))
    error = influence_values(cells, pairs, creator).agg(F.sqrt(F.sum(F.col("phi") * F.col("phi")))).scalar()
    return point.withColumn("std_error", error)


def hurdle_profile(counts: DataFrame, creator: str, day: str, n: str = "n") -> DataFrame:
    """Two-layer profile of dense creator-day counts as (layer, statistic, value) rows."""
    counts = settle(counts)
    active = F.col(n) > 0
    by_creator = counts.groupBy(creator).agg(F.avg(active.cast("double")).alias("p"))
    by_day = counts.groupBy(day).agg(F.avg(active.cast("double")).alias("p"), F.avg(F.when(active, F.col(n))).alias("mu"))
    names = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}

    def long(df: DataFrame, layer: str) -> DataFrame:
        return df.select(F.lit(layer).alias("layer"), *[F.col(c).cast("double") for c in df.columns]).unpivot(["layer"], df.columns, "statistic", "value")

    def span(column: str):
        return [(F.min(column) / F.avg(column)).alias("day_multiplier_min"), (F.max(column) / F.avg(column)).alias("day_multiplier_max")]

    outcome = counts.agg(F.stddev_samp(F.log1p(n)).alias("sd"), F.avg(F.log1p(n)).alias("mean"), F.avg(active.cast("double")).alias("active_share"))
    given = counts.where(active).agg(F.avg(n).alias("mean"), F.stddev_samp(n).alias("sd"))
    tail = ranking.quantiles(counts.where(active), [], n, {"q0": 0.0, "q50": 0.5, "q90": 0.9, "q99": 0.99, "q100": 1.0})
    parts = [
        long(outcome, "log_count"), long(ranking.quantiles(by_creator, [], "p", names), "activity"), long(by_day.agg(*span("p")), "activity"),
        long(given, "count_given_active"), long(tail, "count_given_active"), long(by_day.where("mu IS NOT NULL").agg(*span("mu")), "count_given_active"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rate_quintiles(events: DataFrame, creator: str, days: int) -> DataFrame:
    """Creators in five rank bins of their launch rate."""
    rates = events.groupBy(creator).agg((F.count("*") / F.lit(float(days))).alias("rate"))
    return reshape.rank_bins(rates, "rate", 5, creator, "quintile").groupBy("quintile").agg(
        F.count("*").alias("creators"), F.avg("rate").alias("mean_rate"), F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate")
    )
