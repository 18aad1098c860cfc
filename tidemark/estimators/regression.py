"""Ordinary least squares from sums of products: one pass for the fit, one for the HC1 meat."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.estimators.panel import with_interval
from tidemark.estimators.tails import normal_p


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _symmetric(values, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for (i, j), v in zip(_pairs(k), values):
        out[i, j] = out[j, i] = v
    return out


def ols(df: DataFrame, y: str, covariates: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Intercept and covariates with HC1 errors per key; rows with a missing value are dropped.

    The k x k systems are solved where the aggregated sums are, one row per key; no data row leaves Spark.
    """
    names = ["const", *covariates]
    k = len(names)
    keys = list(keys) or ["__all"]
    rows = df.withColumn("__all", F.lit(0)).dropna(subset=[y, *covariates]).select(
        *keys, F.col(y).cast("double").alias("__y"), F.array(F.lit(1.0), *[F.col(c).cast("double") for c in covariates]).alias("__x")
    )
    x = lambda i: F.col("__x")[i]
    gram = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(x(i) * x(j)) for i, j in _pairs(k)]).alias("xx"),
        F.array(*[F.sum(x(i) * F.col("__y")) for i in range(k)]).alias("xy"),
    )
    kinds = dict(rows.dtypes)
    key_schema = ", ".join(f"{c} {kinds[c]}" for c in keys)

    def solve(batches):
        for pdf in batches:
            pdf["beta"] = [list(np.linalg.lstsq(_symmetric(a, k), np.asarray(b), rcond=None)[0]) for a, b in zip(pdf["xx"], pdf["xy"])]
            yield pdf[[*keys, "n", "xx", "beta"]]

    fit = gram.mapInPandas(solve, f"{key_schema}, n bigint, xx array<double>, beta array<double>")
    resid = rows.join(fit.select(*keys, "beta"), keys)
    e = F.col("__y") - sum((F.col("beta")[i] * x(i) for i in range(k)), F.lit(0.0))
    meat = resid.withColumn("__ee", e * e).groupBy(*keys).agg(F.array(*[F.sum(F.col("__ee") * x(i) * x(j)) for i, j in _pairs(k)]).alias("meat"))

    def errors(batches):
        for pdf in batches:
            out = []
            for record in pdf.to_dict("records"):
                bread = np.linalg.pinv(_symmetric(record["xx"], k))
                cov = bread @ _symmetric(record["meat"], k) @ bread * record["n"] / (record["n"] - k)
                out += [[*[record[c] for c in keys], record["n"], name, record["beta"][i], float(np.sqrt(max(cov[i, i], 0.0)))] for i, name in enumerate(names)]
            yield pd.DataFrame(out, columns=[*keys, "n", "term", "estimate", "std_error"])

    result = fit.join(meat, keys).mapInPandas(errors, f"{key_schema}, n bigint, term string, estimate double, std_error double")
    z = F.abs(F.try_divide(F.col("estimate"), F.col("std_error")))
    return with_interval(result).withColumn("p_value", normal_p(z)).drop("__all")
