"""Summaries of replicate-result tables (one row per arm, replicate and method)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ranking


def replicate_metrics(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bias, Monte Carlo error, RMSE, coverage, error rates, sign and claim accuracy per cell.

    ``results``  keys, estimate, ci_low, ci_high, truth (constant per cell). A decision is positive when the interval
    lies above zero; under a zero truth a positive decision is a false positive, otherwise a null one is a miss.
    """
    err, positive = F.col("estimate") - F.col("truth"), F.col("ci_low") > 0
    is_null = F.col("truth") == 0
    share = lambda c: F.avg(c.cast("double"))
    rows = results.where(F.col("estimate").isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n_reps"), F.first("truth").alias("truth"), F.avg("estimate").alias("mean_estimate"), F.avg(err).alias("bias"),
        (F.stddev_samp("estimate") / F.sqrt(F.count("*"))).alias("mcse_bias"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.stddev_samp("estimate").alias("sd_estimate"), share((F.col("ci_low") <= F.col("truth")) & (F.col("truth") <= F.col("ci_high"))).alias("coverage_95"),
        share(F.when(is_null, positive)).alias("fpr"), share(F.when(~is_null, ~positive)).alias("fnr"),
        share(F.when(~is_null, F.signum("estimate") == F.signum("truth"))).alias("sign_correctness"),
        share(F.when(is_null, ~positive).otherwise(positive)).alias("claim_accuracy"),
    )
    return rows.withColumn("attenuation", F.when(F.col("truth") != 0, F.col("mean_estimate") / F.col("truth")))


def with_baseline(metrics: DataFrame, keys: Sequence[str], method: str, baseline: str, column: str = "rmse") -> DataFrame:
    """Each method's metric beside the baseline method of its cell, and their ratio."""
    base = metrics.where(F.col(method) == baseline).select(*keys, F.col(column).alias(f"baseline_{column}"))
    return metrics.join(base, list(keys), "left").withColumn(f"{column}_ratio", F.try_divide(F.col(column), F.col(f"baseline_{column}")))


def pvalue_diag(results: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """Distinct p-values, their share at or below 0.05, and quantiles."""
    stats = results.groupBy(*keys, p).agg(F.count("*").alias("__n")).groupBy(*keys).agg(
        F.count(p).alias("distinct_p"), F.sum(F.when(F.col(p).isNotNull(), F.col("__n"))).alias("n"),
        (F.sum(F.when(F.col(p) <= 0.05, F.col("__n")).otherwise(0)) / F.sum(F.when(F.col(p).isNotNull(), F.col("__n")))).alias("share_le_05"),
    )
    return ranking.with_quantiles(stats, keys, ranking.quantiles(results, keys, p, {"p05": 0.05, "p50": 0.5, "p95": 0.95}))


def disagreement(results: DataFrame, keys: Sequence[str], replicate: str, method: str, methods: Sequence[str], baseline: str) -> DataFrame:
    """Share of replicates in which decisions differ at all, and per method against the baseline."""
    decision = (F.col("ci_low") > 0).cast("int")
    wide = results.groupBy(*keys, replicate).agg(*[F.max(F.when(F.col(method) == m, decision)).alias(m) for m in methods])
    others = [m for m in methods if m != baseline]
    return wide.groupBy(*keys).agg(
        F.count("*").alias("replicates"), F.avg((F.least(*methods) != F.greatest(*methods)).cast("double")).alias("any_disagreement"),
        *[F.avg((F.col(m) != F.col(baseline)).cast("double")).alias(f"disagree_{m}") for m in others],
    )
