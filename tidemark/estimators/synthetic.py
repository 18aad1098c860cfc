"""Synthetic-control gaps for every unit as pseudo-treated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.estimators.panel import placebo_rank
from tidemark.session import settle

MOST_UNITS = 400


def _simplex(v: np.ndarray) -> np.ndarray:
    """Euclidean projection on the unit simplex."""
    u = np.sort(v)[::-1]
    drop = (np.cumsum(u) - 1.0) / np.arange(1, len(v) + 1)
    return np.maximum(v - drop[np.nonzero(u > drop)[0][-1]], 0.0)


def _fit(cov: np.ndarray, unit: int, rounds: int = 20_000) -> np.ndarray:
    """Weights of the other units that minimize the variance of the gap, by accelerated projected gradient."""
    others = np.delete(np.arange(len(cov)), unit)
    q, c = cov[np.ix_(others, others)], cov[others, unit]
    w = np.full(len(others), 1.0 / len(others))
    step = 1.0 / max(np.linalg.eigvalsh(q)[-1], 1e-12)
    z, t = w, 1.0
    for _ in range(rounds):
        new = _simplex(z - step * (q @ z - c))
        t_new = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0
        z = new + (t - 1.0) / t_new * (new - w)
        moved = np.abs(new - w).max()
        w, t = new, t_new
        if moved < 1e-13:
            break
    out = np.zeros(len(cov))
    out[others] = w
    return out


def synthetic_gaps(panel: DataFrame, unit: str, date: str, event: str, actual: str, y: str = "y") -> DataFrame:
    """Pre and post gaps, their change and the centred pre error of every unit against its synthetic control.

    Days in which all units are observed become vectors with one entry per unit (units are markets: their number is
    checked). Each task adds up its days' outer products, so only unit x unit sums are shuffled; the small weight
    problems then run one per unit, in parallel.
    """
    panel = settle(panel.where(F.col(y).isNotNull()).select(unit, date, F.col(y).alias("v")))
    names = panel.select(unit).distinct().agg(F.sort_array(F.collect_list(unit)).alias("names"))
    checked = names.select(F.when(F.size("names") > MOST_UNITS, F.raise_error(F.lit(f"more than {MOST_UNITS} units"))).otherwise(F.col("names"))).scalar()
    per_cell = panel.groupBy(date, unit).agg(F.avg("v").alias("v"))
    days = per_cell.groupBy(date).agg(F.sort_array(F.collect_list(F.struct(unit, "v"))).alias("u")).withColumn("names", checked).where(F.size("u") == F.size("names"))
    vectors = days.select((F.col(date) >= F.lit(event).cast("date")).alias("post"), F.transform("u", lambda p: p["v"]).alias("x"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for post, rows in pdf.groupby("post"):
                x = np.array(rows["x"].tolist())
                outer = x.T @ x
                i, j = np.indices(outer.shape)
                yield pd.DataFrame({"post": post, "i": i.ravel(), "j": j.ravel(), "v": outer.ravel()})
                yield pd.DataFrame({"post": post, "i": np.arange(x.shape[1]), "j": -1, "v": x.sum(axis=0)})
                yield pd.DataFrame({"post": post, "i": [-1], "j": [-1], "v": [float(len(x))]})

    sums = vectors.mapInPandas(partial, "post boolean, i int, j int, v double").groupBy("post", "i", "j").agg(F.sum("v").alias("v"))
    packed = sums.agg(F.collect_list(F.struct("post", "i", "j", "v"))).scalar()
    units = names.select(F.posexplode("names").alias("idx", "treated_unit"), F.size("names").alias("n_units")).withColumn("sums", packed)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                n = row.n_units
                cross, mean, size = np.zeros((n, n)), {False: np.zeros(n), True: np.zeros(n)}, {False: 0.0, True: 0.0}
                for s in row.sums:
                    if s["i"] < 0:
                        size[s["post"]] = s["v"]
                    elif s["j"] < 0:
                        mean[s["post"]][s["i"]] = s["v"]
                    elif not s["post"]:
                        cross[s["i"], s["j"]] = s["v"]
                for key in mean:
                    mean[key] = mean[key] / max(size[key], 1.0)
                cov = cross / size[False] - np.outer(mean[False], mean[False])
                gap = -_fit(cov, row.idx)
                gap[row.idx] = 1.0
                pre, post = float(gap @ mean[False]), float(gap @ mean[True])
                out.append([row.treated_unit, int(size[False]), int(size[True]), pre, post, post - pre, float(np.sqrt(max(gap @ cov @ gap, 0.0)))])
            yield pd.DataFrame(out, columns=["treated_unit", "pre_days", "post_days", "pre_gap_mean", "post_gap_mean", "gap_change", "pre_centered_rmse"])

    fits = units.mapInPandas(solve, "treated_unit string, pre_days bigint, post_days bigint, pre_gap_mean double, post_gap_mean double, gap_change double, pre_centered_rmse double")
    return placebo_rank(settle(fits.withColumn("is_actual_treated", (F.col("treated_unit") == actual).cast("int"))), "gap_change")
