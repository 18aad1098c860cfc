"""Order statistics that never sort one whole group in one task.

A window sorts each of its partitions in one task, so a key that owns a third of the rows stalls it. The operators
here first shrink equal values to counts (combined on the map side), then cut the value axis in fixed log-scale
buckets: one small window runs over the bucket totals of a key, another inside a bucket. Buckets are a function of
the value alone, so retries and repeated branches agree on them. Positions of single rows come from a layout by range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

ONE = "__one"
FINEST = 1e6  # values below 1/FINEST share the bucket of zero
STEPS = 128  # buckets per unit of natural logarithm: each spans less than one percent


def value_bucket(value: Column) -> Column:
    """Bucket number that does not decrease with the value; about 6,000 buckets up to 1e15."""
    x = value.cast("double")
    return F.floor(F.signum(x) * F.log1p(F.abs(x) * FINEST) * STEPS).cast("int")


def _keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A global statistic is a grouped one under a constant key."""
    return (df, list(keys)) if keys else (df.withColumn(ONE, F.lit(1)), [ONE])


def _counts(df: DataFrame, keys: Sequence[str], value: str, more: Sequence[str] = ()) -> DataFrame:
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value_bucket(F.col(value)).alias("__bucket"), value, *more)
        .agg(F.count("*").alias("__n"))
    )


def _bucket_totals(counts: DataFrame, keys: Sequence[str], descending: bool = False) -> DataFrame:
    """Per key and bucket: rows in it, rows ahead of it, rows of the key. At most a few thousand rows per key."""
    direction = F.desc if descending else F.asc
    whole = Window.partitionBy(*keys)
    ahead = whole.orderBy(direction("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.groupBy(*keys, "__bucket").agg(F.sum("__n").alias("__rows"))
        .withColumn("__ahead", F.coalesce(F.sum("__rows").over(ahead), F.lit(0)))
        .withColumn("__total", F.sum("__rows").over(whole))
    )


def _inside(keys: Sequence[str], *order: Column):
    return Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def value_counts_with_rank(df: DataFrame, keys: Sequence[str], value: str, descending: bool = False) -> DataFrame:
    """Distinct values per key with their ``copies``, ``before`` = rows ranked ahead and ``total`` rows of the key."""
    df, group = _keys(df, keys)
    counts = _counts(df, group, value)
    joined = counts.join(_bucket_totals(counts, group, descending), [*group, "__bucket"])
    order = F.desc(value) if descending else F.asc(value)
    before = F.col("__ahead") + F.coalesce(F.sum("__n").over(_inside(group, order)), F.lit(0))
    return joined.withColumn("before", before).select(*keys, value, F.col("__n").alias("copies"), "before", F.col("__total").alias("total"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per named probability; nulls are skipped.

    Only the buckets that hold a wanted rank are sorted.
    """
    df, group = _keys(df, keys)
    counts = _counts(df, group, value)
    totals = _bucket_totals(counts, group)

    def spot(q: float) -> Column:
        return (F.col("__total") - 1) * F.lit(float(q))

    ranks = [f(spot(q)) for q in probabilities.values() for f in (F.floor, F.ceil)]
    hit = F.lit(False)
    for rank in ranks:
        hit = hit | ((F.col("__ahead") <= rank) & (rank < F.col("__ahead") + F.col("__rows")))
    picked = counts.join(totals.where(hit), [*group, "__bucket"]).withColumn(
        "__from", F.col("__ahead") + F.coalesce(F.sum("__n").over(_inside(group, F.asc(value))), F.lit(0))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__from") <= rank) & (rank < F.col("__from") + F.col("__n")), F.col(value).cast("double")))

    out = []
    for name, q in probabilities.items():
        low, high, part = at(F.floor(spot(q))), at(F.ceil(spot(q))), F.max(spot(q) - F.floor(spot(q)))
        out.append((low + (high - low) * part).alias(name))
    if keys:
        return picked.groupBy(*group).agg(*out)
    return picked.agg(*out)


def with_quantiles(stats: DataFrame, keys: Sequence[str], *parts: DataFrame) -> DataFrame:
    """Attach quantile frames to a frame of ordinary aggregates on the same keys (null-safe)."""
    for part in parts:
        values = [c for c in part.columns if c not in keys]
        if keys:
            right = part.select(*[F.col(k).alias(f"__{k}") for k in keys], *values)
            same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
            stats = stats.join(right, same, "left").drop(*[f"__{k}" for k in keys])
        else:
            packed = part.select(F.struct(*values).alias("__q")).scalar()
            stats = stats.withColumn("__q", packed).select(*stats.columns, *[F.col(f"__q.{v}").alias(v) for v in values])
    return stats


def global_index(
    df: DataFrame, order: str, tie: str, keys: Sequence[str] = (), descending: bool = False, name: str = "row_index"
) -> DataFrame:
    """1-based position of every row with an ``order`` value by (``order``, ``tie``), globally or per key.

    ``tie`` is unique within equal ``order``; ties always rank ascending. A null key is a key of its own. Rows are laid
    out by range of (key, order, tie), so neither a hot key nor a heavy tie meets in one task, sorted and written with
    their number; one small row per key and range shifts the numbers of a range. All columns are written: hand over
    the needed ones.
    """
    direction = F.desc(order) if descending else F.asc(order)
    line = [*[F.asc(k) for k in keys], direction, F.asc(tie)]
    laid = df.where(F.col(order).isNotNull()).repartitionByRange(*line).sortWithinPartitions(*line)
    rows = settle(laid.withColumns({"__at": F.monotonically_increasing_id(), "__range": F.spark_partition_id()}))
    runs = rows.groupBy(*keys, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 1
    shifts = settle(runs.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__run"), shift.alias("__shift")))
    same = F.col("__range") == F.col("__run")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(shifts, same).select(*df.columns, (F.col("__at") + F.col("__shift")).cast("bigint").alias(name))


def running_sum(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Running total per key up to and including the row, for keys of any size.

    ``bucket`` must not decrease along ``order`` (for example the day of a timestamp): totals of earlier buckets
    are summed in one small window, rows of a bucket in another.
    """
    parts = df.withColumn("__bucket", bucket)
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        parts.groupBy(*keys, "__bucket")
        .agg(F.sum(value).alias("__t"))
        .withColumn("__earlier", F.coalesce(F.sum("__t").over(earlier), F.lit(0)))
        .drop("__t")
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        parts.join(totals, [*keys, "__bucket"])
        .withColumn(name, F.col("__earlier") + F.sum(value).over(inside))
        .drop("__bucket", "__earlier")
    )


def concentration(df: DataFrame, keys: Sequence[str], weight: str, tops: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Members, total, top-k shares and HHI of nonnegative weights per key, from one row per member.

    The total is an ordinary aggregate. Top-k needs only the k largest members, which every task limits before the
    shuffle, so a key with very many members is never sorted whole.
    """
    totals = df.groupBy(*keys).agg(
        F.count(weight).alias("members"),
        F.sum(weight).alias("total_weight"),
        F.sum(F.col(weight) * F.col(weight)).alias("__squares"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(weight).desc_nulls_last()))
    leaders = (
        df.select(*keys, weight)
        .withColumn("__rank", rank)
        .where(F.col("__rank") <= max(tops))
        .groupBy(*keys)
        .agg(*[F.sum(F.when(F.col("__rank") <= k, F.col(weight))).alias(f"__top{k}") for k in tops])
    )
    total = F.nullif(F.col("total_weight").cast("double"), F.lit(0.0))
    return totals.join(leaders, list(keys)).select(
        *keys,
        "members",
        "total_weight",
        *[F.try_divide(F.col(f"__top{k}"), total).alias(f"top{k}_share") for k in tops],
        F.try_divide(F.col("__squares"), total * total).alias("hhi"),
    )


def crossing_count(df: DataFrame, keys: Sequence[str], weight: str, share: float = 0.5, name: str = "crossing_count") -> DataFrame:
    """Smallest number of largest members whose positive weights reach ``share`` of the total.

    Bucket totals locate the one bucket of a key in which the share is crossed; only that bucket is sorted. Equal
    weights are interchangeable, so inside a level the number of copies needed is a division.
    """
    counts = _counts(df, keys, weight)
    level = F.col("__n") * F.col(weight)
    whole = Window.partitionBy(*keys)
    ahead = whole.orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        counts.groupBy(*keys, "__bucket").agg(F.sum("__n").alias("__rows"), F.sum(level).alias("__weight"))
        .withColumn("__n_ahead", F.coalesce(F.sum("__rows").over(ahead), F.lit(0)))
        .withColumn("__w_ahead", F.coalesce(F.sum("__weight").over(ahead), F.lit(0.0)))
        .withColumn("__need", F.sum("__weight").over(whole) * F.lit(share) * F.lit(1 - 1e-12))
    )
    crossing = buckets.where((F.col("__w_ahead") < F.col("__need")) & (F.col("__need") <= F.col("__w_ahead") + F.col("__weight")))
    inside = _inside(keys, F.desc(weight))
    rows = (
        counts.join(crossing, [*keys, "__bucket"])
        .withColumn("__n0", F.col("__n_ahead") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
        .withColumn("__w0", F.col("__w_ahead") + F.coalesce(F.sum(level).over(inside), F.lit(0.0)))
        .where(F.col("__w0") + level >= F.col("__need"))
    )
    copies = F.greatest(F.lit(1), F.ceil((F.col("__need") - F.col("__w0")) / F.col(weight)))
    return rows.groupBy(*keys).agg(F.min(F.col("__n0") + copies).cast("bigint").alias(name))


GATHERED = 1_000_000  # members of a key that one window may hold


def concentration_with_crossing(
    df: DataFrame, keys: Sequence[str], weight: str, tops: Sequence[int], share: float, name: str, gathered: int = GATHERED
) -> DataFrame:
    """``concentration`` and ``crossing_count`` of positive weights on one row per key.

    Keys of up to ``gathered`` members are ranked in one window, one shuffle for all figures; larger ones take the two
    operators above. ``df`` is read twice, so it should be settled.
    """
    large = settle(df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > gathered).drop("__n"))
    small = df
    if not large.isEmpty():
        small = df.join(large, list(keys), "left_anti")
    whole = Window.partitionBy(*keys)
    down = whole.orderBy(F.col(weight).desc())
    total = F.nullif(F.col("__total").cast("double"), F.lit(0.0))
    ranked = small.select(
        *keys, weight, F.row_number().over(down).alias("__rank"), F.sum(weight).over(whole).alias("__total"),
        F.sum(weight).over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("__upto"),
    )
    need = F.col("__total") * F.lit(share) * F.lit(1 - 1e-12)
    out = ranked.groupBy(*keys).agg(
        F.count(weight).alias("members"), F.max("__total").alias("total_weight"),
        *[F.try_divide(F.sum(F.when(F.col("__rank") <= k, F.col(weight))), F.max(total)).alias(f"top{k}_share") for k in tops],
        F.try_divide(F.sum(F.col(weight) * F.col(weight)), F.max(total * total)).alias("hhi"),
        F.min(F.when(F.col("__upto") >= need, F.col("__rank"))).cast("bigint").alias(name),
    )
    if small is df:
        return out
    rest = df.join(large, list(keys), "left_semi")
    return out.unionByName(concentration(rest, keys, weight, tops).join(crossing_count(rest, keys, weight, share, name), list(keys)))
