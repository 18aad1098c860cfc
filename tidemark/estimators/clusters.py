"""Few-cluster inference and two-way effects on unbalanced creator panels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.estimators.tails import student_p
from tidemark.estimators.twoway import meetings, square, two_way_residuals
from tidemark.session import settle

MOST_CLUSTERS = 16


def _residualized(df: DataFrame, unit: str, period: str, y: str, d: str) -> DataFrame:
    """Columns r (outcome) and w (treatment), both free of unit and period effects."""
    rows = settle(df.where(F.col(y).isNotNull()).select(unit, period, F.col(y).alias("__y"), F.col(d).alias("__d")))
    return settle(two_way_residuals(rows, unit, period, {"__y": "r", "__d": "w"}).select(unit, period, "r", "w"))


def _signs(clusters: DataFrame) -> DataFrame:
    """All sign vectors of a one-row frame with a ``c`` array of clusters, as (row, signs).

    The number of vectors doubles per cluster, so the count of clusters is checked when the query runs.
    """
    size = F.size("c")
    limit = F.when(size > MOST_CLUSTERS, F.raise_error(F.lit(f"exact enumeration supports at most {MOST_CLUSTERS} clusters"))).otherwise(
        F.expr("shiftleft(1, size(c))") - 1
    )
    # bit i of the vector number decides the sign of cluster i
    vector = F.transform("c", lambda _, i: F.when(F.getbit(F.col("v"), i) == 1, 1.0).otherwise(-1.0))
    return clusters.withColumn("v", F.explode(F.sequence(F.lit(0), limit))).withColumn("s", vector)


def wild_cluster(df: DataFrame, unit: str, period: str, y: str = "y", d: str = "did") -> DataFrame:
    """Exact wild cluster bootstrap over all Rademacher sign vectors, restricted residuals; units may miss periods.

    The bootstrap estimate is linear in the signs: b* = sum_g s_g c_g with c_g = sum(w r) / sum(w^2), so a panel of
    any size becomes one number per cluster before anything is enumerated. ``std_error_hc1`` is the robust error of
    the unrestricted fit, null without degrees of freedom.
    """
    rows = _residualized(df, unit, period, y, d)
    scale = rows.agg(F.sum(F.col("w") * F.col("w"))).scalar()
    ww, free = F.col("w") * F.col("w"), F.count("*") - F.count_distinct(unit) - F.count_distinct(period)
    fitted = rows.agg(F.sum(F.col("w") * F.col("r")) / F.sum(ww)).scalar()
    we = F.col("w") * (F.col("r") - fitted * F.col("w"))
    spread = F.when(free > 0, F.try_divide(F.sqrt(F.sum(we * we) * F.count("*") / F.nullif(free, F.lit(0))), F.sum(ww)))
    hc1 = rows.agg(spread.alias("std_error_hc1")).scalar()
    per = rows.groupBy(unit).agg(F.sum(F.col("w") * F.col("r")).alias("wr")).withColumn("c", F.col("wr") / scale)
    one = per.agg(F.sort_array(F.collect_list(F.struct(unit, "c"))).alias("pairs")).select(F.transform("pairs", lambda p: p["c"]).alias("c"))
    dot = F.aggregate(F.zip_with("s", "c", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    estimate = F.aggregate("c", F.lit(0.0), lambda acc, x: acc + x)
    draws = _signs(one).select(dot.alias("b"), estimate.alias("estimate"), F.size("c").alias("cluster_count"))
    out = draws.groupBy("estimate", "cluster_count").agg(
        F.count("*").alias("sign_assignments"), F.avg((F.abs("b") >= F.abs("estimate") - 1e-12).cast("double")).alias("p_value"),
        F.percentile("b", F.lit(0.025)).alias("ci95_low"), F.percentile("b", F.lit(0.975)).alias("ci95_high"),
    )
    return out.withColumn("std_error_hc1", hc1)


def crv1(df: DataFrame, unit: str, period: str, y: str = "y", d: str = "did") -> DataFrame:
    """Cluster-robust t with the usual finite-sample factor, t(G-1) tail, and the exact sign enumeration on t.

    Signs change whole clusters, and unit and period effects are fitted anew for each sign vector. That fit is linear
    in the signs, so a cluster's score needs its own cross products, one number per other cluster (through the
    periods and, where units miss periods, the unit effects), and its squared treatment.
    """
    rows = _residualized(df, unit, period, y, d)
    facts = rows.agg(
        F.sum(F.col("w") * F.col("w")).alias("s"), F.count("*").alias("n"), F.count_distinct(unit).alias("g"), F.count_distinct(period).alias("t")
    ).first()
    if facts["g"] > MOST_CLUSTERS:
        raise ValueError(f"exact enumeration supports at most {MOST_CLUSTERS} clusters")
    cells = settle(rows.groupBy(unit, period).agg(F.count("*").alias("__n"), F.sum("r").alias("__r"), F.sum("w").alias("__w")))
    own = {r[unit]: r for r in rows.groupBy(unit).agg(F.sum(F.col("w") * F.col("r")).alias("a"), F.sum(F.col("w") * F.col("w")).alias("d"), F.count("*").alias("n")).collect()}
    names = sorted(own)
    # period by period, what each cluster puts beside each other one: w r, w n and n r over the rows of the period
    totals = cells.groupBy(period).agg(F.sum("__n").alias("__total"))
    left = cells.join(totals, period).select(period, F.col(unit).alias("a"), (F.col("__w") / F.col("__total")).alias("__w"), (F.col("__n") / F.col("__total")).alias("__m"))
    right = cells.select(period, F.col(unit).alias("b"), "__n", "__r")
    met = left.join(right, period).groupBy("a", "b").agg(
        F.sum(F.col("__w") * F.col("__r")).alias("wr"), F.sum(F.col("__w") * F.col("__n")).alias("wn"), F.sum(F.col("__m") * F.col("__r")).alias("nr")
    ).toArrow()
    wr, wn, nr = (square(met, names, v) for v in ("wr", "wn", "nr"))
    system = np.diag([float(own[u]["n"]) for u in names]) - square(meetings(cells, unit, period, []).toArrow(), names)
    cross = wr + wn @ np.linalg.pinv(system, rcond=1e-11) @ nr
    c = [(float(own[u]["a"]), float(own[u]["d"]), [float(x) for x in cross[i]]) for i, u in enumerate(names)]
    one = df.sparkSession.createDataFrame(
        [(c, (float(facts["s"]), facts["n"], facts["g"], facts["t"]))], "c array<struct<a: double, d: double, b: array<double>>>, f struct<s: double, n: bigint, g: bigint, t: bigint>"
    )
    k = F.col("f.g") + F.col("f.t")
    factor = F.col("f.g") / (F.col("f.g") - 1) * (F.col("f.n") - 1) / (F.col("f.n") - k)

    def total(array):
        return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)

    def scores(signs):
        beta = total(F.zip_with(signs, "c", lambda s, c: s * c["a"])) / F.col("f.s")
        score = F.transform("c", lambda c, i: (
            F.get(signs, i) * c["a"] - total(F.zip_with(signs, c["b"], lambda s, b: s * b)) - beta * c["d"]
        ) / F.col("f.s"))
        return beta, F.sqrt(factor * total(F.transform(score, lambda x: x * x)))

    ones = F.transform("c", lambda _: F.lit(1.0))
    beta0, se0 = scores(ones)
    base = one.withColumn("estimate", beta0).withColumn("std_error", se0)
    beta_s, se_s = scores(F.col("s"))
    draws = _signs(base).select("estimate", "std_error", "f", (beta_s / se_s).alias("t_star"))
    t = F.col("estimate") / F.col("std_error")
    out = draws.groupBy("estimate", "std_error", F.col("f.g").alias("clusters")).agg(
        F.avg((F.abs("t_star") >= F.abs(t) - 1e-10).cast("double")).alias("sign_p_value")
    )
    return out.withColumn("t", t).withColumn("t_p_value", student_p(F.col("t"), (F.col("clusters") - 1).cast("double")))


def randomization_p(estimates: DataFrame, value: str, actual: str) -> DataFrame:
    """Share of assignments at least as extreme as the actual one (flag column ``actual``)."""
    own = estimates.where(F.col(actual) == 1).agg(F.max(F.abs(value))).scalar()
    return estimates.withColumn("__own", own).agg(F.avg((F.abs(value) >= F.col("__own") - 1e-12).cast("double")).alias("p_value"))


MOST_DAYS = 1500


def twfe_cluster(df: DataFrame, creator: str, day: str, y: str = "y", d: str = "did") -> DataFrame:
    """Two-way effects on an unbalanced panel with creator-clustered errors and implicit-weight diagnostics.

    Creator effects are swept out inside each creator; the day effects then solve a day x day system whose matrix is
    a sum over creators. So an exact answer needs two passes over the panel and no iteration. A creator has at most
    one row per day and ``day`` is a 0-based index below MOST_DAYS, so both the groups and the system are bounded.
    """
    bounded = F.when(F.col(day).between(0, MOST_DAYS - 1), F.col(day)).otherwise(F.raise_error(F.lit(f"day index outside 0..{MOST_DAYS - 1}")))
    rows = df.where(F.col(y).isNotNull()).select(
        creator, F.struct(bounded.cast("int").alias("t"), F.col(y).cast("double").alias("y"), F.col(d).cast("double").alias("d")).alias("o")
    )
    series = rows.groupBy(creator).agg(F.collect_list("o").alias("o")).select(
        creator, F.transform("o", lambda o: o["t"]).alias("t"), F.transform("o", lambda o: o["y"]).alias("y"), F.transform("o", lambda o: o["d"]).alias("d")
    )

    series = settle(series)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = 0
        a = np.zeros((0, 0))
        b = np.zeros((0, 2))
        for pdf in batches:
            for t, yv, dv in zip(pdf["t"], pdf["y"], pdf["d"]):
                t = np.asarray(t, dtype=int)
                need = int(t.max()) + 1
                if need > size:
                    grown = np.zeros((need, need))
                    grown[:size, :size] = a
                    a, b, size = grown, np.vstack([b, np.zeros((need - size, 2))]), need
                a[t, t] += 1.0
                a[np.ix_(t, t)] -= 1.0 / len(t)
                b[t, 0] += np.asarray(yv) - np.mean(yv)
                b[t, 1] += np.asarray(dv) - np.mean(dv)
        i, j = np.nonzero(a)
        yield pd.DataFrame({"i": i, "j": j, "v": a[i, j]})
        yield pd.DataFrame({"i": np.tile(np.arange(size), 2), "j": np.repeat([-1, -2], size), "v": b.T.ravel()})

    system = series.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    packed = system.agg(F.collect_list(F.struct("i", "j", "v")).alias("cells"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cells in pdf["cells"]:
                n = max(c["i"] for c in cells) + 1
                a, b = np.zeros((n, n)), np.zeros((n, 2))
                for c in cells:
                    if c["j"] >= 0:
                        a[c["i"], c["j"]] = c["v"]
                    else:
                        b[c["i"], -c["j"] - 1] = c["v"]
                effects = np.linalg.lstsq(a, b, rcond=None)[0]
                yield pd.DataFrame({"ly": [list(effects[:, 0])], "ld": [list(effects[:, 1])]})

    effects = packed.mapInPandas(solve, "ly array<double>, ld array<double>").agg(F.first(F.struct("ly", "ld"))).scalar()

    swept = series.withColumn("f", effects)
    for values in ("y", "d"):
        moved = F.expr(f"zip_with({values}, t, (v, t) -> v - get(f.l{values}, t))")
        average = F.expr("aggregate(__m, 0D, (acc, x) -> acc + x) / size(t)")
        swept = swept.withColumn("__m", moved).withColumn("__a", average).withColumn(f"r{values}", F.expr("transform(__m, v -> v - __a)"))
    swept = swept.select(creator, "d", "ry", "rd")

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, x: acc + x)

    sums = swept.select(
        dot("rd", "ry").alias("dy"), dot("rd", "rd").alias("dd"), F.size("d").alias("n"), (F.array_max("d") > 0).alias("treated"),
        F.aggregate(F.filter("rd", lambda w: w < 0), F.lit(0.0), lambda acc, w: acc + w).alias("negative"),
    )
    sums = settle(sums)
    fit = sums.agg(
        F.sum("dy").alias("dy"), F.sum("dd").alias("dd"), F.sum("n").cast("bigint").alias("n_obs"), F.count("*").alias("clusters"),
    )
    beta = fit.select(F.col("dy") / F.col("dd")).scalar()
    # a cluster score is dy - beta * dd, both already creator-level
    meat = sums.withColumn("__b", beta).agg(F.struct(
        F.sum(F.pow(F.col("dy") - F.col("__b") * F.col("dd"), 2)).alias("m"), F.sum(F.when(F.col("treated"), F.col("negative"))).alias("neg")
    )).scalar()
    out = fit.withColumn("__m", meat).withColumn("estimate", F.col("dy") / F.col("dd"))
    cr1 = F.col("clusters") / (F.col("clusters") - 1)
    return out.select(
        "estimate", (F.sqrt(cr1 * F.col("__m.m")) / F.col("dd")).alias("std_error"), "n_obs", "clusters",
        (F.col("__m.neg") / F.col("dd")).alias("negative_weight_treated"),
    )
