"""Matched designs, balance, timing checks, shocks, audits and small-table inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.estimators import resampling
from tidemark.estimators.panel import Z95
from tidemark.estimators.tails import binomial_upper
from tidemark.functions.scalars import safe_rate
from tidemark.operators import aggregates, ranking, reshape
from tidemark.session import settle


def proportion_by(df: DataFrame, keys: Sequence[str], y: Column, z: float = Z95) -> DataFrame:
    """Successes with the Wilson interval; an empty group has none."""
    counts = df.groupBy(*keys).agg(F.count_if(y).alias("successes"), F.count(y).alias("n"))
    n, p = F.col("n"), safe_rate(F.col("successes"), F.col("n"))
    denominator = 1 + z * z / n
    center, radius = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    known = lambda c: F.when(n > 0, c)
    return counts.select("*", p.alias("share"), known((center - radius) / denominator).alias("ci95_low"), known((center + radius) / denominator).alias("ci95_high"))


def binom_tail_by(df: DataFrame, keys: Sequence[str], y: Column, p0: float = 0.90) -> DataFrame:
    """Exact upper tail P(X >= successes) under a threshold share."""
    counts = df.groupBy(*keys).agg(F.count_if(y).alias("successes"), F.count(y).alias("n"))
    return counts.withColumn("p_value", binomial_upper(F.col("successes"), F.col("n"), F.lit(p0)))


def risk_ratio_by(df: DataFrame, keys: Sequence[str], treated: str, y: str) -> DataFrame:
    """Risk ratio and E-value; the latter only when the ratio exceeds one."""
    rate = lambda v: F.avg(F.when(F.col(treated) == v, F.col(y).cast("double")))
    rates = df.groupBy(*keys).agg(rate(1).alias("treated_rate"), rate(0).alias("control_rate"))
    rr = safe_rate(F.col("treated_rate"), F.col("control_rate"))
    return rates.withColumn("risk_ratio", rr).withColumn("e_value", F.when(rr > 1, rr + F.sqrt(rr * (rr - 1))))


def matched_cells(df: DataFrame, treated: str, cells: Sequence[str], outcome: str) -> DataFrame:
    """Per supported cell: sizes, means and effect. Both sides are reduced to cells in one aggregation, so no
    treated row is ever joined to control rows."""
    side = lambda v, c: F.when(F.col(treated) == v, c)
    stats = df.groupBy(*cells).agg(
        F.count(side(1, F.col(outcome))).alias("treated_n"), F.sum(side(1, F.col(outcome).cast("double"))).alias("treated_sum"),
        F.count(side(0, F.col(outcome))).alias("control_n"), F.avg(side(0, F.col(outcome).cast("double"))).alias("control_mean"),
    ).where("treated_n > 0 AND control_n > 0")
    return stats.withColumn("treated_mean", F.col("treated_sum") / F.col("treated_n")).withColumn("att_cell", F.col("treated_mean") - F.col("control_mean"))


def matched_att(df: DataFrame, treated: str, cells: Sequence[str], outcome: str, cluster: str, draws: int = 200, salt: str = "att") -> DataFrame:
    """Effect on the treated among supported exact-match cells, with support share and a cluster bootstrap.

    ``cluster`` is one of the cell columns (a launch day), so cluster sums come from the cells.
    """
    df = settle(df.select(treated, *cells, outcome))
    table = settle(matched_cells(df, treated, cells, outcome))
    total = df.where((F.col(treated) == 1) & F.col(outcome).isNotNull()).agg(F.count("*")).scalar()
    point = table.agg(
        F.sum("treated_n").alias("n_treated"), F.sum("control_n").alias("n_control"),
        (F.sum("treated_sum") / F.sum("treated_n")).alias("treated_value"),
        (F.sum(F.col("treated_n") * F.col("control_mean")) / F.sum("treated_n")).alias("control_value"),
    ).withColumn("effect", F.col("treated_value") - F.col("control_value")).withColumn("support_share", F.col("n_treated") / total)
    days = table.groupBy(cluster).agg(F.sum(F.col("treated_n") * F.col("att_cell")).alias("diff"), F.sum("treated_n").alias("n")).withColumn(
        "__order", F.datediff(cluster, F.lit("1970-01-01").cast("date")) if dict(df.dtypes)[cluster] == "date" else F.col(cluster)
    )
    boot = resampling.cluster_boot(days, "__order", "diff", "n", draws, salt).select("clusters", "boot_se", "ci95_low", "ci95_high")
    rr = safe_rate(F.col("treated_value"), F.col("control_value"))
    return ranking.with_quantiles(point, [], boot).withColumn("risk_ratio", rr).withColumn("e_value", F.when(rr > 1, rr + F.sqrt(rr * (rr - 1))))


def balance(df: DataFrame, treated: str, cells: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Standardized mean differences, full sample and matched; a matched control weighs treated_n / control_n of its cell."""
    sizes = df.groupBy(*cells).agg(F.count_if(F.col(treated) == 1).alias("__t"), F.count_if(F.col(treated) == 0).alias("__c"))
    right = sizes.select(*[F.col(c).alias(f"__k_{c}") for c in cells], "__t", "__c")
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in cells]
    weighted = df.join(right, same).select(
        F.col(treated).alias("treated"), *variables,
        F.when(F.col(treated) == 1, (F.col("__c") > 0).cast("double")).otherwise(F.try_divide(F.col("__t").cast("double"), F.col("__c").cast("double"))).alias("__w"),
    )
    long = weighted.select("treated", "__w", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in variables])).alias("v")).select(
        "treated", "v.variable", "v.x", F.explode(F.array(F.struct(F.lit("full").alias("sample"), F.lit(1.0).alias("w")), F.struct(F.lit("matched").alias("sample"), F.col("__w").alias("w")))).alias("s")
    ).select("treated", "variable", "x", "s.sample", "s.w")
    moments = aggregates.weighted_moments(long, ["sample", "variable", "treated"], "x", "w")
    pick = lambda v, c: F.max(F.when(F.col("treated") == v, F.col(c)))
    wide = moments.groupBy("sample", "variable").agg(
        pick(1, "weighted_mean").alias("treated_mean"), pick(0, "weighted_mean").alias("control_mean"), pick(1, "weighted_var").alias("v1"),
        pick(0, "weighted_var").alias("v0"), pick(1, "n").alias("treated_n"), pick(0, "n").alias("control_n"),
    )
    smd = F.try_divide(F.col("treated_mean") - F.col("control_mean"), F.sqrt((F.col("v1") + F.col("v0")) / 2))
    return wide.withColumn("smd", smd).drop("v1", "v0")


def timing_checks(df: DataFrame, treated: str, cells: Sequence[str], outcomes: Sequence[str], early: str, late: str) -> DataFrame:
    """Matched effects of several outcomes in one job, with the verdict that compares an immediate to a delayed one."""
    long = df.select(F.col(treated), *cells, F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("value")) for o in outcomes])).alias("o")).select(
        treated, *cells, "o.outcome", "o.value"
    )
    table = matched_cells(long, treated, [*cells, "outcome"], "value")
    rows = settle(table).groupBy("outcome").agg(
        F.sum("treated_n").alias("n_treated"), (F.sum("treated_sum") / F.sum("treated_n")).alias("treated_value"),
        (F.sum(F.col("treated_n") * F.col("control_mean")) / F.sum("treated_n")).alias("control_value"),
    ).withColumn("effect", F.col("treated_value") - F.col("control_value"))
    pair = rows.agg(F.struct(
        F.max(F.when(F.col("outcome") == early, F.col("effect"))).alias("e"), F.max(F.when(F.col("outcome") == late, F.col("effect"))).alias("l")
    )).scalar()
    # The smallest immediate effect that counts and its share of the delayed one.
    large = F.coalesce(F.col("__p.e") > F.greatest(F.lit(0.0005), F.abs("__p.l") * 0.25), F.lit(False))
    return rows.withColumn("__p", pair).withColumn("immediate_association", large).drop("__p")


def shock_table(tokens: DataFrame, at: str, flag: str, outcome: str, shocks: DataFrame, window_hours: int) -> DataFrame:
    """Counts and outcome sums in the four cells (flagged or plain, during or adjacent) of each shock.

    ``shocks``  shock_id, start, end (inclusive). A shock lists the hours it touches, so tokens meet it by an equi join
    on the hour; the exact bounds are checked afterwards.
    """
    pad = F.expr(f"INTERVAL {int(window_hours)} HOURS")
    hours = F.sequence(F.date_trunc("hour", F.col("start") - pad), F.date_trunc("hour", F.col("end") + pad), F.expr("INTERVAL 1 HOUR"))
    span = shocks.select("shock_id", "start", "end", F.explode(hours).alias("__hour"))
    rows = tokens.select(F.col(at).alias("__at"), F.date_trunc("hour", at).alias("__hour"), F.col(flag).alias("flag"), F.col(outcome).cast("double").alias("y"))
    near = rows.join(span, "__hour").where(F.col("__at").between(F.col("start") - pad, F.col("end") + pad)).withColumn(
        "during", F.col("__at").between(F.col("start"), F.col("end")).cast("int")
    )
    cell = lambda f, d, c: F.coalesce(F.sum(F.when((F.col("flag") == f) & (F.col("during") == d), c)), F.lit(0))
    values = {"n": F.lit(1), "y": F.col("y")}
    return near.groupBy("shock_id").agg(*[
        cell(f, d, c).alias(f"{name}_{'flag' if f else 'plain'}_{'during' if d else 'adjacent'}") for f in (1, 0) for d in (1, 0) for name, c in values.items()
    ])


CELLS = ("flag_during", "flag_adjacent", "plain_during", "plain_adjacent")


def shock_support(table: DataFrame, least: int = 50) -> DataFrame:
    """Counts in the four cells and whether each has enough tokens."""
    enough = F.lit(True)
    for c in CELLS:
        enough = enough & (F.col(f"n_{c}") >= least)
    return table.select("shock_id", *[F.col(f"n_{c}") for c in CELLS], enough.alias("supported"))


def shock_did(table: DataFrame) -> DataFrame:
    """Change of the rate from adjacent to during, flagged minus plain tokens."""
    rate = lambda c: safe_rate(F.col(f"y_{c}"), F.col(f"n_{c}"))
    out = table.select("shock_id", *[rate(c).alias(f"rate_{c}") for c in CELLS])
    return out.withColumn("did", (F.col("rate_flag_during") - F.col("rate_flag_adjacent")) - (F.col("rate_plain_during") - F.col("rate_plain_adjacent")))


def pair_diagnostics(rows: DataFrame, pair: str, side: str, keys: Sequence[str], metrics: Sequence[str], draws: int = 100) -> DataFrame:
    """Matched-pair differences per key and metric: means, mean and median difference, interval, positive share."""
    long = reshape.unpivot(rows, [pair, side, *keys], metrics)
    wide = long.groupBy(pair, *keys, "metric").agg(
        F.avg(F.when(F.col(side) == "treated", F.col("value"))).alias("t"), F.avg(F.when(F.col(side) == "control", F.col("value"))).alias("c")
    ).where("t IS NOT NULL AND c IS NOT NULL").withColumn("diff", F.col("t") - F.col("c"))
    wide = settle(wide)
    group = [*keys, "metric"]
    stats = wide.groupBy(*group).agg(
        F.count("*").alias("pairs"), F.avg("t").alias("treated_mean"), F.avg("c").alias("control_mean"), F.avg("diff").alias("mean_difference"),
        F.avg((F.col("diff") > 0).cast("double")).alias("positive_share"),
    )
    median = ranking.quantiles(wide, group, "diff", {"median_difference": 0.5})
    boot = resampling.boot_mean(wide, group, "diff", pair, draws, "pair").select(*group, "ci95_low", "ci95_high")
    return ranking.with_quantiles(stats, group, median, boot)


def selection_audit(df: DataFrame, covered: str, reducers: dict[str, str], threshold: float = 0.25) -> DataFrame:
    """Covered against uncovered rows per metric, by mean or median, scaled by the sd of both groups together."""
    long = reshape.unpivot(df, [covered], list(reducers)).where(F.col("value").isNotNull() & ~F.isnan("value"))
    side = lambda v, c: F.max(F.when(F.col(covered) == v, F.col(c)))
    per_side = long.groupBy("metric", covered).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    per_side = ranking.with_quantiles(per_side, ["metric", covered], ranking.quantiles(long, ["metric", covered], "value", {"median": 0.5}))
    chosen = per_side.withColumn("v", F.when(F.col("metric").isin(*[m for m, r in reducers.items() if r == "median"]), F.col("median")).otherwise(F.col("mean")))
    wide = chosen.groupBy("metric").agg(
        F.coalesce(side(1, "n"), F.lit(0)).alias("covered_n"), F.coalesce(side(0, "n"), F.lit(0)).alias("uncovered_n"),
        side(1, "v").alias("covered_value"), side(0, "v").alias("uncovered_value"),
    )
    spread = long.groupBy("metric").agg(F.stddev_samp("value").alias("sd"))
    out = wide.join(spread, "metric").withColumn("difference", F.col("covered_value") - F.col("uncovered_value"))
    smd = F.try_divide(F.col("difference"), F.col("sd"))
    return out.withColumn("smd", smd).withColumn("material", F.coalesce(F.abs("smd") >= threshold, F.lit(False))).drop("sd")


def mechanism_audit(rows: DataFrame, start: str, required: int = 300) -> DataFrame:
    """Persistence shares on all (lower bound) and complete 30-day windows, lags, order violations and the pass rule."""
    late = rows.where("horizon_days = 30")
    done, active = F.col("window_status") == "ok", F.col("swap_count") > 0
    lag = (F.unix_micros(F.col("first_trade_at").cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1e6
    late = late.withColumn("lag", F.when(done, lag)).withColumn("complete_swaps", F.when(done, F.col("swap_count")))
    base = late.agg(
        F.count("*").alias("tokens"), F.count_if(active).alias("active_tokens"), F.count_if(done).alias("complete_tokens"), F.count_if(done & active).alias("complete_active"),
        F.count_if(F.col("lag") < 0).alias("order_violations"), F.avg(F.when(done, F.col("reactivated_after_7d").cast("double"))).alias("reactivation_rate"),
    )
    q = ranking.with_quantiles(ranking.quantiles(late, [], "complete_swaps", {"p25_swaps": 0.25, "median_swaps": 0.5, "p75_swaps": 0.75}), [],
                               ranking.quantiles(late, [], "lag", {"median_lag_seconds": 0.5}))
    out = ranking.with_quantiles(base, [], q)

    def wilson_low(successes: str, n: str) -> Column:
        s, m, z = F.col(successes), F.col(n), Z95
        p = safe_rate(s, m)
        return F.when(m > 0, (p + z * z / (2 * m) - z * F.sqrt((p * (1 - p) + z * z / (4 * m)) / m)) / (1 + z * z / m))

    out = out.withColumn("full_share", safe_rate(F.col("active_tokens"), F.col("tokens"))).withColumn("complete_share", safe_rate(F.col("complete_active"), F.col("complete_tokens")))
    out = out.withColumn("full_ci95_low", wilson_low("active_tokens", "tokens")).withColumn("complete_ci95_low", wilson_low("complete_active", "complete_tokens"))
    ok = (F.col("full_ci95_low") > 0.90) & (F.col("complete_ci95_low") > 0.90) & (F.col("order_violations") == 0) & (F.col("complete_tokens") >= required)
    return out.withColumn("mechanism_pass", F.coalesce(ok, F.lit(False)))
