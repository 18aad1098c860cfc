"""Bootstraps with reproducible draws.

Every random number is the md5 of (salt, draw, unit), so a result does not depend on partitioning, retries or the
engine. A bootstrap is one aggregation whose key is the draw; rows are reduced to units (days, pairs, clusters)
before they are multiplied by draws.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.scalars import md5_sign, md5_uniform, safe_rate
from tidemark.operators import ranking
from tidemark.session import settle

POISSON_TERMS = 12


def poisson_copies(uniform: Column) -> Column:
    """Poisson(1) copies from a uniform: the with-replacement bootstrap when there are many units."""
    copies, cumulative = F.lit(0), 0.0
    for k in range(POISSON_TERMS):
        cumulative += math.exp(-1.0) / math.factorial(k)
        copies = copies + F.when(uniform >= F.lit(cumulative), 1).otherwise(0)
    return copies


def draw_codes(unit: str, draws: int, salt: str) -> Column:
    """The 32 bits of ``md5_uniform`` of every draw of a unit, as hex digits one behind the other."""
    return F.concat(*[F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.lit(str(d)), F.col(unit).cast("string"))), 1, 8) for d in range(1, draws + 1)])


def draw_copies(codes: pa.ChunkedArray | pa.Array, draws: int) -> np.ndarray:
    """Rows x (draws + 1) Poisson copies of ``draw_codes``; the first column, draw 0, is the data itself."""
    bits = np.frombuffer(bytes.fromhex("".join(codes.to_pylist())), ">u4").reshape(len(codes), draws)
    limits = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(POISSON_TERMS)])
    copies = np.searchsorted(limits, (bits / 4294967296.0).ravel(), side="right").reshape(bits.shape)
    return np.concatenate([np.ones((len(codes), 1), np.int64), copies], axis=1)


def draw_sums(df: DataFrame, by: Sequence[str], values: Sequence[str], unit: str, draws: int, salt: str) -> DataFrame:
    """(by, __metric, draw, s, w, n): weighted sum, weights and rows of every value column, per group and draw.

    Rows are not multiplied by draws: a unit's draws are hashed once for all value columns, a batch is summed as a
    matrix, and the shuffle carries groups x draws.
    """
    by, values = list(by), list(values)
    rows = df.select(*by, *[F.col(v).cast("double").alias(f"__{i}") for i, v in enumerate(values)], draw_codes(unit, draws, salt).alias("__code"))
    schema = StructType([*[rows.schema[b] for b in by], *StructType.fromDDL("__metric string, s array<double>, w array<bigint>, n bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            cell = table.select(by).to_pandas().groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(table), np.int64)
            order = np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0])
            copies = draw_copies(batch.column("__code"), draws)[order]
            keys = [table.column(b).combine_chunks().take(pa.array(order[starts])) for b in by]
            for i, name in enumerate(values):
                column = batch.column(f"__{i}")
                there = ~column.is_null().to_numpy(zero_copy_only=False)[order]
                value = column.fill_null(0.0).to_numpy(zero_copy_only=False)[order]
                weight = copies * there[:, None]
                parts = [pa.array([name] * len(starts)), pa.array(list(np.add.reduceat(weight * value[:, None], starts, axis=0))),
                         pa.array(list(np.add.reduceat(weight, starts, axis=0))), pa.array(np.add.reduceat(there.astype(np.int64), starts))]
                yield pa.RecordBatch.from_arrays([*keys, *parts], names=[f.name for f in schema])

    sums = rows.mapInArrow(run, schema).where("n > 0")
    long = sums.select(*by, "__metric", "n", F.posexplode(F.arrays_zip("s", "w")).alias("draw", "__p"))
    return long.groupBy(*by, "__metric", "draw").agg(F.sum("__p.s").alias("s"), F.sum("__p.w").alias("w"), F.sum("n").alias("n"))


def interval(draws: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Percentile interval and spread of draws."""
    spread = draws.groupBy(*keys).agg(F.count("*").alias("draws"), F.stddev_samp(value).alias("boot_se"))
    return ranking.with_quantiles(spread, keys, ranking.quantiles(draws, keys, value, {"ci95_low": 0.025, "ci95_high": 0.975}))


def _slots(units: DataFrame, keys: Sequence[str], draws: int, salt: str) -> DataFrame:
    """(keys, draw, position): n positions drawn with replacement per key and draw.

    ``units`` has the columns keys, position (0-based) and n. Each unit row makes one slot per draw, so the work is
    spread like the units.
    """
    slots = units.select(*keys, "n", F.col("position").alias("slot"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    u = md5_uniform(F.lit(salt), *[F.col(k) for k in keys], F.col("draw"), F.col("slot"))
    return slots.select(*keys, "draw", F.floor(u * F.col("n")).cast("bigint").alias("position"))


def boot_mean(df: DataFrame, keys: Sequence[str], value: str, unit: str, draws: int = 200, salt: str = "mean") -> DataFrame:
    """Mean with a percentile interval; Poisson weights per unit and draw, combined on the map side.

    No row is gathered: every draw of a key is a weighted sum, and the shuffle carries one row per draw and batch.
    """
    sums = draw_sums(df.where(F.col(value).isNotNull()), keys, [value], unit, draws, salt).drop("__metric")
    means = settle(sums.withColumn("m", safe_rate(F.col("s"), F.col("w"))))
    point = means.where("draw = 0").select(*keys, "n", F.col("m").alias("mean"))
    return ranking.with_quantiles(point, keys, interval(means.where("draw > 0"), keys, "m"))


GATHERED = 4_000_000  # weights (rows x draws) of a group that one task may hold


def _drawn(rows: DataFrame, unit: str, draws: int, salt: str) -> DataFrame:
    """Every row once per draw it is in, with its copies ``__w``; draw 0 is the data itself."""
    long = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    drawn = long.withColumn("__u", md5_uniform(F.lit(salt), F.col("draw"), F.col(unit)))
    return drawn.withColumn("__w", F.when(F.col("draw") == 0, F.lit(1)).otherwise(poisson_copies(F.col("__u")))).where("__w > 0").drop("__u")


def _gathered_medians(rows: DataFrame, keys: Sequence[str], value: str, unit: str, draws: int, salt: str, gathered: int) -> DataFrame:
    """Median and interval of groups that fit in a task.

    Rows are shuffled once and sorted by value; a task takes runs of whole groups and finds the medians of all draws
    from running weights. The random numbers are hashed after the shuffle.
    """
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, value).select(*keys, F.col(value).cast("double").alias("__v"), draw_codes(unit, draws, salt).alias("__code"))
    key_fields = [sorted_rows.schema[k] for k in keys]
    more = ["median double", "draws bigint", "boot_se double", "ci95_low double", "ci95_high double"]
    schema = StructType(key_fields + StructType.fromDDL(", ".join(more)).fields)
    least = max(gathered // (draws + 1), 1)

    def summary(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        values = table.column("__v").to_numpy()
        copies = draw_copies(table.column("__code"), draws)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(values)])
        medians = np.full((len(starts), draws + 1), np.nan)
        seen = np.zeros((len(starts), draws + 1), bool)
        for d in range(draws + 1):
            weight = copies[:, d]
            upto = np.cumsum(weight)
            base = upto[starts] - weight[starts]
            total = np.add.reduceat(weight, starts)
            upto = upto - np.repeat(base, sizes)
            seen[:, d] = total > 0
            ends = []
            for rank in ((total - 1) // 2, total // 2):
                rank = np.repeat(rank, sizes)
                ends.append(values[(upto > rank) & (upto - weight <= rank)])
            medians[seen[:, d], d] = ends[0] + (ends[1] - ends[0]) * np.where(total[total > 0] % 2 == 0, 0.5, 0.0)
        ordered = np.sort(np.where(seen[:, 1:], medians[:, 1:], np.inf), axis=1)
        n = seen[:, 1:].sum(axis=1)

        def quantile(q: float) -> pa.Array:
            spot = np.maximum(n - 1, 0) * q
            low, high = [np.take_along_axis(ordered, f(spot).astype(np.int64)[:, None], 1)[:, 0] for f in (np.floor, np.ceil)]
            with np.errstate(invalid="ignore"):
                return pa.array(low + (high - low) * (spot - np.floor(spot)), mask=n == 0)

        drawn = np.where(seen[:, 1:], medians[:, 1:], 0.0)
        gap = np.where(seen[:, 1:], drawn - (drawn.sum(axis=1) / np.maximum(n, 1))[:, None], 0.0)
        spread = np.sqrt((gap * gap).sum(axis=1) / np.maximum(n - 1, 1))
        columns = [table.column(k).combine_chunks().take(pa.array(starts)) for k in keys]
        columns += [pa.array(medians[:, 0]), pa.array(n, mask=n == 0), pa.array(spread, mask=n < 2), quantile(0.025), quantile(0.975)]
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in batches:
            kept.append(batch)
            held += batch.num_rows
            if held < least:
                continue
            table = pa.Table.from_batches(kept)
            group = numbers(table)
            whole = int(np.searchsorted(group, group[-1]))
            if whole:
                yield summary(table.slice(0, whole), group[:whole])
                kept = table.slice(whole).to_batches()
                held = held - whole
        if held:
            table = pa.Table.from_batches(kept)
            yield summary(table, numbers(table))

    def numbers(table: pa.Table) -> np.ndarray:
        return table.select(list(keys)).to_pandas().groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy()

    return sorted_rows.mapInArrow(run, schema)


def _spread_medians(rows: DataFrame, keys: Sequence[str], value: str, unit: str, draws: int, salt: str) -> DataFrame:
    """Median and interval of groups of any size.

    Weights per draw and value bucket are combined on the map side; only rows of the buckets that hold a median are
    ranked.
    """
    # as one struct, keys with nulls meet like any others
    parts = rows.withColumn("__k", F.struct(*keys) if keys else F.lit(1))
    by = ["__k", "draw", "__bucket"]
    drawn = _drawn(parts.withColumn("__bucket", ranking.value_bucket(F.col(value))), unit, draws, salt)
    sums = drawn.groupBy(*by).agg(F.sum("__w").alias("__rows"))
    whole = Window.partitionBy("__k", "draw")
    ahead = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = sums.withColumn("__ahead", F.coalesce(F.sum("__rows").over(ahead), F.lit(0))).withColumn("__total", F.sum("__rows").over(whole))
    low, high = F.expr("(__total - 1) div 2"), F.expr("__total div 2")
    hit = settle(totals.where(((F.col("__ahead") <= low) & (low < F.col("__ahead") + F.col("__rows"))) | ((F.col("__ahead") <= high) & (high < F.col("__ahead") + F.col("__rows")))))
    levels = drawn.join(hit.select(*by, "__ahead", "__total"), by).groupBy(*by, value, "__ahead", "__total").agg(F.sum("__w").alias("__n"))
    inside = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = levels.withColumn("__from", F.col("__ahead") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__from") <= rank) & (rank < F.col("__from") + F.col("__n")), F.col(value).cast("double")))

    medians = settle(placed.groupBy("__k", "draw").agg(at(low).alias("__l"), at(high).alias("__h")).select("__k", "draw", (F.col("__l") + (F.col("__h") - F.col("__l")) * 0.5).alias("m")))
    point = medians.where("draw = 0").select("__k", F.col("m").alias("median"))
    out = ranking.with_quantiles(point, ["__k"], interval(medians.where("draw > 0"), ["__k"], "m"))
    return out.select(*[F.col(f"__k.{k}") for k in keys], *[c for c in out.columns if c != "__k"])


def boot_median(
    df: DataFrame, keys: Sequence[str], value: str, unit: str, draws: int = 100, salt: str = "median", gathered: int = GATHERED
) -> DataFrame:
    """Median with a percentile interval; a draw reweights rows by Poisson copies.

    Groups of up to ``gathered`` rows x draws are sorted whole in a task, larger ones are ranked by value buckets.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, value, unit)
    if not keys:
        return _spread_medians(rows, keys, value, unit, draws, salt)
    large = settle(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > gathered // (draws + 1)).select(*[F.col(k).alias(f"__{k}") for k in keys]))
    if large.isEmpty():
        return _gathered_medians(rows, keys, value, unit, draws, salt, gathered)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    small = _gathered_medians(rows.join(large, same, "left_anti"), keys, value, unit, draws, salt, gathered)
    return small.unionByName(_spread_medians(rows.join(large, same, "left_semi"), keys, value, unit, draws, salt))


def cluster_draws(units: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], draws: int, salt: str) -> DataFrame:
    """Sums of clusters drawn with replacement, per key and draw.

    ``units`` holds one row per cluster (a calendar day, a pair): rows were reduced to clusters before, so positions
    come from a window over clusters, not over rows.
    """
    indexed = ranking.global_index(units, order, order, keys=keys, name="position").withColumn("position", F.col("position") - 1)
    sizes = indexed.groupBy(*keys).agg(F.count("*").alias("n")) if keys else None
    if keys:
        counted = indexed.join(sizes, list(keys))
    else:
        counted = indexed.withColumn("n", units.agg(F.count("*")).scalar())
    picks = _slots(counted.select(*keys, "position", "n"), keys, draws, salt)
    chosen = picks.groupBy(*keys, "draw", "position").agg(F.count("*").alias("copies"))
    return chosen.join(indexed.select(*keys, "position", *sums), [*keys, "position"]).groupBy(*keys, "draw").agg(
        *[F.sum(F.col("copies") * F.col(s)).alias(s) for s in sums]
    )


def cluster_boot(units: DataFrame, order: str, numerator: str, denominator: str, draws: int = 200, salt: str = "cluster", keys: Sequence[str] = ()) -> DataFrame:
    """Ratio of sums with the spread over resampled clusters; with one cluster only the ratio is known."""
    units = settle(units)
    point = units.groupBy(*keys).agg(safe_rate(F.sum(numerator), F.sum(denominator)).alias("estimate"), F.count("*").alias("clusters"))
    drawn = cluster_draws(units, keys, order, [numerator, denominator], draws, salt).withColumn("r", safe_rate(F.col(numerator), F.col(denominator)))
    drawn = settle(drawn)
    joined = ranking.with_quantiles(point, keys, interval(drawn, keys, "r"))
    several = F.col("clusters") > 1
    return joined.select(*keys, "estimate", "clusters", *[F.when(several, F.col(c)).alias(c) for c in ("boot_se", "ci95_low", "ci95_high")])


def block_positions(series: DataFrame, draws: int, block: int, salt: str = "block", circular: bool = False) -> DataFrame:
    """(draw, slot, position) of a moving-block bootstrap of a series of n days.

    A draw has ceil(n / block) blocks and is cut to n slots. Without ``circular`` a block must fit in the series.
    """
    size = series.agg(F.count("*").alias("n"))
    blocks = size.select("n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).select(
        "n", "draw", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)).alias("b")
    )
    starts = F.col("n") if circular else F.col("n") - block + 1
    u = md5_uniform(F.lit(salt), F.col("draw"), F.col("b"))
    spread = blocks.withColumn("start", F.floor(u * starts)).select("n", "draw", "b", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("k"))
    return spread.select(
        "draw", (F.col("b") * block + F.col("k")).cast("bigint").alias("slot"), F.pmod(F.col("start") + F.col("k"), F.col("n")).cast("bigint").alias("position"), "n"
    ).where(F.col("slot") < F.col("n")).drop("n")


def block_boot(series: DataFrame, day: str, value: str, weights: Column, draws: int = 200, block: int = 7, salt: str = "block", circular: bool = False) -> DataFrame:
    """Any linear statistic sum(weight(slot) * value) under a moving-block bootstrap.

    ``weights`` is an expression of ``slot`` (0-based place in the window). Whole day vectors move together, so
    dependence between units of one day is kept by building ``value`` per day first.
    """
    indexed = ranking.global_index(series.withColumn("__d", F.datediff(day, F.lit("1970-01-01").cast("date")) if dict(series.dtypes)[day] == "date" else F.col(day)), "__d", "__d", name="position").withColumn("position", F.col("position") - 1)
    base = indexed.withColumn("slot", F.col("position"))
    point = base.agg(F.sum(weights * F.col(value)).alias("estimate"), F.count("*").alias("n_days"))
    drawn = block_positions(series, draws, block, salt, circular).join(indexed.select("position", value), "position").groupBy("draw").agg(
        F.sum(weights * F.col(value)).alias("b")
    )
    drawn = settle(drawn)
    return ranking.with_quantiles(point, [], interval(drawn.withColumn("__k", F.lit(0)), ["__k"], "b").drop("__k"))


def multiplier_boot(influence: DataFrame, unit: str, phi: str, estimate: Column | float, draws: int = 199, salt: str = "sign") -> DataFrame:
    """Estimate perturbed by Rademacher-signed influence values; one sum per draw."""
    rows = influence.select(unit, phi, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    sums = rows.groupBy("draw").agg(F.sum(md5_sign(F.lit(salt), F.col("draw"), F.col(unit)) * F.col(phi)).alias("shift"))
    base = F.lit(estimate) if isinstance(estimate, (int, float)) else estimate
    shifted = settle(sums.withColumn("b", base + F.col("shift")).withColumn("__k", F.lit(0)))
    return interval(shifted, ["__k"], "b").drop("__k")


def hier_boot(pairs: DataFrame, model: str, pair: str, calls_high: str, calls_low: str, draws: int = 200, salt: str = "hier") -> DataFrame:
    """Two-stage bootstrap of a paired contrast: pairs are drawn inside each model, then calls inside both cells.

    ``pairs`` has one row per (model, pair) with the two cells as arrays of (v, n): distinct call values and their
    counts, so a cell of any number of calls is a short array. Calls are redrawn by one multinomial draw over the counts.
    Models are fixed and weigh the same. ``pair`` is a 0-based index within the model.
    """
    sizes = pairs.groupBy(model).agg(F.count("*").alias("n"))
    slots = pairs.join(sizes, model).select(model, "n", F.col(pair).alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw"))
    u = md5_uniform(F.lit(salt), F.col(model), F.col("draw"), F.col("slot"))
    picked = slots.select(model, "draw", "slot", F.when(F.col("draw") == 0, F.col("slot")).otherwise(F.floor(u * F.col("n"))).cast("bigint").alias(pair))

    @F.pandas_udf("double")
    def redrawn(seed: pd.Series, draw: pd.Series, values: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for s, d, v, n in zip(seed, draw, values, counts):
            n = np.asarray(n, np.int64)
            drawn = n if d == 0 else np.random.Generator(np.random.Philox(s % 2**64)).multinomial(n.sum(), n / n.sum())
            out.append(float(drawn @ np.asarray(v, float)) / n.sum())
        return pd.Series(out, dtype=float)

    def resampled(cell: str) -> Column:
        seed = F.xxhash64(F.lit(salt), F.lit(cell), model, "draw", "slot")
        return redrawn(seed, F.col("draw"), F.col(cell)["v"], F.col(cell)["n"])

    rows = picked.join(pairs, [model, pair]).select(model, "draw", (resampled(calls_high) - resampled(calls_low)).alias("diff"))
    per_model = rows.groupBy(model, "draw").agg(F.avg("diff").alias("diff"))
    means = settle(per_model.groupBy("draw").agg(F.avg("diff").alias("effect"), F.count("*").alias("models")))
    point = means.where("draw = 0").select("effect", "models")
    return ranking.with_quantiles(point, [], interval(means.where("draw > 0").withColumn("__k", F.lit(0)), ["__k"], "effect").drop("__k"))
