"""Join shapes: checked cardinality, either-side matches, time and block bounds, as-of lookups, matching.

No operator forces a broadcast. Small sides are picked up by Spark under ``autoBroadcastJoinThreshold``, which is
a check of their size; larger ones fall back to a shuffled join that AQE splits when a key is hot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import filters, ranking
from tidemark.session import settle


def join_inner(left: DataFrame, right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(matched rows, one-row count of left rows without a partner)."""
    return left.join(right, list(on)), left.join(right, list(on), "left_anti").agg(F.count("*").alias("unmatched"))


def left_lookup(left: DataFrame, right: DataFrame, on: Sequence[str], status: str, found: str, missing: str) -> DataFrame:
    """Left join in which absence becomes a stated coverage label."""
    marked = right.withColumn("__found", F.lit(True))
    joined = left.join(marked, list(on), "left")
    return joined.withColumn(status, F.when(F.col("__found"), found).otherwise(missing)).drop("__found")


def join_validated(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, cardinality: str, required: Sequence[str] = ()
) -> DataFrame:
    """Join that fails when a side declared unique repeats a key, or when a required column is null afterwards."""
    if cardinality not in ("1:1", "m:1", "1:m"):
        raise ValueError(f"unknown cardinality: {cardinality}")
    if cardinality in ("1:1", "1:m"):
        left = filters.assert_unique(left, on)
    if cardinality in ("1:1", "m:1"):
        right = filters.assert_unique(right, on)
    joined = left.join(right, list(on), how)
    for column in required:
        guarded = F.when(F.col(column).isNull(), F.raise_error(F.lit(f"null after join: {column}"))).otherwise(F.col(column))
        joined = joined.withColumn(column, guarded)
    return joined


def join_semi(left: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(keys.select(*on), list(on), "left_semi")


def join_anti(left: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(keys.select(*on), list(on), "left_anti")


def cross_dim(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Every row once per value of a fixed small dimension; a generator, so nothing is shuffled or joined."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def range_join(
    events: DataFrame, windows: DataFrame, key: str, ts: str, start: str, length: str, closed: str = "left"
) -> DataFrame:
    """Events inside their key's window: ``[start, start+length)`` or, with ``closed="both"``, including the end."""
    end = F.col(start) + F.expr(f"INTERVAL {length}")
    inside = F.col(ts) < end if closed == "left" else F.col(ts) <= end
    return events.join(windows, key).where((F.col(ts) >= F.col(start)) & inside)


def prefilter_range(events: DataFrame, windows: DataFrame, ts: str, start: str, length: str) -> DataFrame:
    """Drop events outside the union bound of all windows. One small action; its two literals reach the scan."""
    low, high = windows.agg(F.min(start), F.max(F.col(start) + F.expr(f"INTERVAL {length}"))).first()
    if low is None:
        return events.limit(0)
    kind = events.schema[ts].dataType
    return events.where(F.col(ts).between(F.lit(low).cast(kind), F.lit(high).cast(kind)))


def either_side(trades: DataFrame, sides: Sequence[str], key: str) -> DataFrame:
    """One row per distinct non-null side of a trade, so an OR match becomes an equi join on ``key``."""
    return trades.withColumn(key, F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(s) for s in sides])))))


def either_side_join(trades: DataFrame, tokens: DataFrame, sides: Sequence[str], key: str) -> DataFrame:
    return either_side(trades, sides, key).join(tokens, key)


def bounded_join(logs: DataFrame, units: DataFrame, key: str, block: str, low: str, high: str) -> DataFrame:
    """Logs whose block lies in the closed range of their own unit."""
    return logs.join(units, key).where(F.col(block).between(F.col(low), F.col(high)))


def asof_lookup(
    left: DataFrame, history: DataFrame, block: str, at: str, old: str, new: str, name: str, blocks_per_bucket: int = 100_000
) -> DataFrame:
    """Value in force at a block: the last change at or before it, else the value before the first change.

    Both sides are cut in buckets of blocks. A bucket carries the value in force at its start, and inside it changes
    and distinct blocks are put in one order with a running maximum: linear in both, no pair of them is formed.
    """
    bucket = F.floor(F.col(block) / blocks_per_bucket)
    changes = history.select(
        F.floor(F.col(at) / blocks_per_bucket).alias("__bucket"),
        F.struct(F.col(at).alias("at"), F.col(new).alias("value")).alias("change"),
        F.col(old).alias("old"),
    )
    before_all = changes.agg(F.min_by("old", "change.at")).scalar()
    per_bucket = changes.groupBy("__bucket").agg(F.max("change").alias("last"))
    row_buckets = left.select(bucket.alias("__bucket")).distinct()
    carried = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        row_buckets.join(per_bucket, "__bucket", "full")
        .withColumn("__carried", F.last("last", ignorenulls=True).over(carried))
        .select("__bucket", "__carried")
    )
    rows = left.withColumn("__bucket", bucket)
    asked = rows.select("__bucket", F.col(block).alias("__block"), F.lit(1).alias("__asked")).distinct()
    given = changes.select("__bucket", F.col("change.at").alias("__block"), F.lit(0).alias("__asked"), "change")
    so_far = Window.partitionBy("__bucket").orderBy("__block", "__asked").rowsBetween(Window.unboundedPreceding, 0)
    near = asked.unionByName(given, allowMissingColumns=True).withColumn("__near", F.max("change").over(so_far)).where("__asked = 1").select("__block", "__near")
    return (
        rows.join(starts, "__bucket", "left")
        .join(near, F.col(block) == F.col("__block"), "left")
        .withColumn(name, F.coalesce(F.col("__near.value"), F.col("__carried.value"), before_all))
        .drop("__bucket", "__carried", "__block", "__near")
    )


def latest_before(df: DataFrame, keys: Sequence[str], ts: str, cutoff: str, tie: Sequence[Column] = ()) -> DataFrame:
    """Last row per key at or before the cutoff carried on the row."""
    return filters.top_rows(df.where(F.col(ts) <= F.col(cutoff)), keys, [F.col(ts).desc(), *tie])


def coalesce_join(base: DataFrame, sources: Mapping[str, DataFrame], on: Sequence[str], column: str) -> DataFrame:
    """First source that has a value wins; the winner is named in ``{column}_source``."""
    joined = base
    for label, source in sources.items():
        joined = joined.join(source.select(*on, F.col(column).alias(f"__{label}")), list(on), "left")
    winner = None
    for label in sources:
        hit = F.col(f"__{label}").isNotNull()
        winner = F.when(hit, label) if winner is None else winner.when(hit, label)
    return joined.select(
        *base.columns,
        F.coalesce(*[F.col(f"__{label}") for label in sources]).alias(column),
        winner.alias(f"{column}_source"),
    )


def cell_match(df: DataFrame, treated: str, cells: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """Treated rows with the means of the untreated rows of their exact cell; null cell values match null."""
    controls = df.where(F.col(treated) == 0).groupBy(*cells).agg(
        F.count("*").alias("control_n"),
        *[F.avg(o).alias(f"control_{o}_mean") for o in outcomes],
        *[F.count(o).alias(f"control_{o}_n") for o in outcomes],
    )
    right = controls.select(*[F.col(c).alias(f"__{c}") for c in cells], *[c for c in controls.columns if c not in cells])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cells]
    return df.where(F.col(treated) == 1).join(right, same).drop(*[f"__{c}" for c in cells])


def match_same_pair(treated: DataFrame, controls: DataFrame, pair: str, block: str, tie: str) -> DataFrame:
    """n-th treated row of a pair with its n-th most recent control of the same pair.

    Exactly the sequential rule while every pair has enough controls. Positions come from
    ``ranking.global_index``, so a hot pair is ranked in ranges, then the sides meet on (pair, position). A treated row
    of no pair has no control.
    """
    left = ranking.global_index(treated, block, tie, keys=[pair], name="__place")
    right = ranking.global_index(controls, block, tie, keys=[pair], descending=True, name="__place")
    taken = right.select(pair, "__place", F.col(tie).alias("control_id"), F.col(block).alias("control_block"))
    return left.join(taken, [pair, "__place"], "left").drop("__place")


def match_without_replacement(treated: DataFrame, controls: DataFrame, pair: str, block: str, tie: str) -> DataFrame:
    """Same-pair matches first, then the treated rows left over, in order, with the most recent unused controls.

    Both phases are rank joins. ``match_kind`` is ``same_pair``, ``fallback`` or ``unmatched``: when a pair runs out
    of controls, a strictly sequential scan may hand a control of another pair away earlier, so the share of
    fallbacks must be reported with the result.
    """
    treated, controls = settle(treated), settle(controls)
    first = settle(match_same_pair(treated, controls, pair, block, tie))
    matched = first.where(F.col("control_id").isNotNull()).withColumn("match_kind", F.lit("same_pair"))
    left_over = first.where(F.col("control_id").isNull()).drop("control_id", "control_block")
    used = matched.select(F.col("control_id").alias(tie))
    free = controls.join(used, tie, "left_anti")
    ranked = ranking.global_index(left_over, block, tie, name="__place")
    stack = ranking.global_index(free, block, tie, descending=True, name="__place").select(
        "__place", F.col(tie).alias("control_id"), F.col(block).alias("control_block")
    )
    second = (
        ranked.join(stack, "__place", "left")
        .drop("__place")
        .withColumn("match_kind", F.when(F.col("control_id").isNull(), "unmatched").otherwise("fallback"))
    )
    return matched.unionByName(second).withColumn("match_distance_blocks", F.abs(F.col("control_block") - F.col(block)))


def nearest_cohort(events: DataFrame, version: str, newer: str, older: str, block: str, tie: str, n: int) -> DataFrame:
    """The last n older rows before the first newer one, and the first n newer rows, labelled by side."""
    post = events.where(F.col(version) == newer)
    pre = events.where((F.col(version) == older) & (F.col(block) < post.agg(F.min(block)).scalar()))
    before = pre.orderBy(F.desc(block), F.desc(tie)).limit(n).withColumn("cohort_side", F.lit("pre"))
    after = post.orderBy(F.asc(block), F.asc(tie)).limit(n).withColumn("cohort_side", F.lit("post"))
    return before.unionByName(after)


def enrich(outcomes: DataFrame, metadata: DataFrame, on: Sequence[str], suffix: str = "_metadata") -> DataFrame:
    """Keep every outcome row; metadata columns that collide get a suffix."""
    taken = set(outcomes.columns)
    right = metadata.select(
        *on, *[F.col(c).alias(c + suffix if c in taken else c) for c in metadata.columns if c not in on]
    )
    return outcomes.join(right, list(on), "left")


def fill_from(df: DataFrame, older: DataFrame, on: Sequence[str], columns: Sequence[str], absent: Sequence[str]) -> DataFrame:
    """Take a value from an older result only where it is missing or says it was not requested."""
    old = older.select(*on, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.join(old, list(on), "left")
    for c in columns:
        empty = F.col(c).isNull() | F.col(c).cast("string").isin(*absent)
        joined = joined.withColumn(c, F.when(empty, F.coalesce(F.col(f"__{c}"), F.col(c))).otherwise(F.col(c)))
    return joined.drop(*[f"__{c}" for c in columns])


def best_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], tie: Sequence[Column] = ()) -> DataFrame:
    """Best related row per key by descending measures, missing measures last."""
    return filters.top_rows(df, keys, [*[F.col(c).desc_nulls_last() for c in order], *tie])
