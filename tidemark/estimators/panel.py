"""Difference-in-differences on unit x period panels, without design matrices.

Two-way fixed effects are swept out of the columns first, on panels with gaps too. Point estimates and their HC1
errors then are sums, so a spec, a pseudo-treated unit or a sample is just another grouping key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.estimators.tails import normal_p
from tidemark.estimators.twoway import MOST_LEVELS, meetings, square, two_way_residuals
from tidemark.functions.scalars import rel_day, rel_week
from tidemark.operators import windows
from tidemark.session import settle

Z95 = 1.96


def event_clock(df: DataFrame, date: str, event: str, limit: int = 12) -> DataFrame:
    """rel_day, post, did and the clipped rel_week of each row; needs a ``treated`` column."""
    day = rel_day(F.col(date), event)
    post = F.when(day >= 0, 1).otherwise(0)
    return df.withColumn("rel_day", day).withColumn("post", post).withColumn("did", F.col("treated") * F.col("post")).withColumn(
        "rel_week", rel_week(F.col("rel_day"), limit)
    )


def in_window(df: DataFrame, days: int) -> DataFrame:
    return df.where(F.col("rel_day").between(-days, days))


def with_interval(df: DataFrame, estimate: str = "estimate", error: str = "std_error", z: float = Z95) -> DataFrame:
    low, high = F.col(estimate) - z * F.col(error), F.col(estimate) + z * F.col(error)
    return df.withColumn("ci95_low", low).withColumn("ci95_high", high)


def mean_diff(df: DataFrame, keys: Sequence[str], y: str, group: str) -> DataFrame:
    """Two-sample mean difference (group 1 minus group 0) with unequal variances."""
    def side(v: int) -> Column:
        return F.when(F.col(group) == v, F.col(y))
    sums = df.groupBy(*keys).agg(
        F.avg(side(1)).alias("m1"), F.avg(side(0)).alias("m0"), F.var_samp(side(1)).alias("v1"), F.var_samp(side(0)).alias("v0"),
        F.count(side(1)).alias("n1"), F.count(side(0)).alias("n0"),
    )
    error = F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))
    return with_interval(sums.select(*keys, "n1", "n0", (F.col("m1") - F.col("m0")).alias("estimate"), error.alias("std_error")))


def did(df: DataFrame, keys: Sequence[str] = (), y: str = "y") -> DataFrame:
    """Naive DiD: y on treated, post and their product with HC1 errors.

    The model is saturated, so the estimate is a contrast of four cell means and the error a sum of cell residuals.
    """
    cells = df.where(F.col(y).isNotNull()).groupBy(*keys, "treated", "post").agg(
        F.count("*").alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v")
    )
    sign = F.when(F.col("treated") == F.col("post"), 1.0).otherwise(-1.0)
    out = cells.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("__cells"), F.sum(sign * F.col("m")).alias("estimate"), F.sum(F.col("v") / F.col("n")).alias("__v")
    ).where("__cells = 4")
    error = F.sqrt(F.col("__v") * F.col("n_rows") / (F.col("n_rows") - 4))
    return with_interval(out.select(*keys, "n_rows", "estimate", error.alias("std_error")))


def twfe(df: DataFrame, unit: str, period: str, keys: Sequence[str] = (), y: str = "y", d: str = "did") -> DataFrame:
    """Two-way fixed-effects DiD with HC1 errors that count every dummy; units may miss periods.

    Not estimable (null) when one of the four treated x post cells is empty.
    """
    panel = settle(df.where(F.col(y).isNotNull()))
    rows = settle(two_way_residuals(panel, unit, period, {y: "__y", d: "__d"}, keys))
    slopes = rows.groupBy(*keys).agg(
        F.sum(F.col("__d") * F.col("__y")).alias("__dy"), F.sum(F.col("__d") * F.col("__d")).alias("__dd"), F.count("*").alias("n_rows"),
        *[F.max(((F.col("treated") == a) & (F.col("post") == b)).cast("int")).alias(f"__c{a}{b}") for a in (0, 1) for b in (0, 1)],
    )
    sizes = panel.select(*keys, F.explode(F.array(
        F.struct(F.lit("u").alias("k"), F.col(unit).cast("string").alias("v")), F.struct(F.lit("t").alias("k"), F.col(period).cast("string").alias("v"))
    )).alias("e")).distinct().groupBy(*keys).agg(F.count_if(F.col("e.k") == "u").alias("n_units"), F.count_if(F.col("e.k") == "t").alias("n_periods"))
    beta = F.try_divide(F.col("__dy"), F.col("__dd"))
    if keys:
        fit = slopes.join(sizes, list(keys)).withColumn("estimate", beta)
        resid = rows.join(fit.select(*keys, "estimate"), list(keys))
    else:
        fit = slopes.select("*", *[sizes.select(c).scalar().alias(c) for c in ("n_units", "n_periods")]).withColumn("estimate", beta)
        resid = rows.withColumn("estimate", fit.select("estimate").scalar())
    e = F.col("__y") - F.col("estimate") * F.col("__d")
    meat = resid.groupBy(*keys).agg(F.sum(F.col("__d") * F.col("__d") * e * e).alias("__meat"))
    out = fit.join(meat, list(keys)) if keys else fit.withColumn("__meat", meat.scalar())
    n, k = F.col("n_rows"), F.col("n_units") + F.col("n_periods")
    ok = reduce(lambda a, b: a & b, [F.col(f"__c{a}{b}") == 1 for a in (0, 1) for b in (0, 1)])
    error = F.sqrt(F.col("__meat") * n / F.nullif(n - k, F.lit(0))) / F.col("__dd")
    return with_interval(out.select(
        *keys, F.when(ok, F.col("estimate")).alias("estimate"), F.when(ok, error).alias("std_error"), "n_rows", "n_units", "n_periods"
    ))


def _normal_equations(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, inverse and HC1 meat of ``__ry`` on the array ``__x``: tasks send sums of products, one row each."""

    def summed(weigh) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((size, size + 1))
            for batch in batches:
                y, x = batch.column("__ry").to_numpy(), batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                out += weigh(x, y)
            at = np.arange(size * (size + 1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out.ravel())], ["at", "v"])

        found = rows.select("__ry", "__x").mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(size * (size + 1))
        out[found.column("at").to_numpy()] = found.column("v").to_numpy()
        return out.reshape(size, size + 1)

    sums = summed(lambda x, y: np.column_stack([x.T @ x, x.T @ y]))
    bread = np.linalg.pinv(sums[:, :size], rcond=1e-11)
    beta = bread @ sums[:, size]
    meat = summed(lambda x, y: np.column_stack([(x * ((y - x @ beta) ** 2)[:, None]).T @ x, np.zeros(size)]))
    return beta, bread, meat[:, :size]


def event_study(df: DataFrame, unit: str, period: str, y: str = "y", reference: int = -1) -> DataFrame:
    """Treated x relative-week effects with unit and period effects, HC1; units may miss periods.

    Outcome and week terms are freed of unit and period effects together; sums of their products, one number per
    pair of weeks, are all that is solved. The zero reference row is included; ``avg_post`` and ``avg_post_se``
    repeat the equal-weight post average.
    """
    panel = settle(df.where(F.col(y).isNotNull()).select(unit, period, "rel_week", "treated", F.col(y).cast("double").alias("__y")))
    weeks = sorted(r.rel_week for r in panel.select("rel_week").distinct().collect())
    terms = [w for w in weeks if w != reference]
    size = len(terms)
    marks = {f"__x{i}": f"__r{i}" for i in range(size)}
    wide = panel.select(unit, period, "__y", *[F.when(F.col("rel_week") == w, F.col("treated")).otherwise(0).cast("double").alias(f"__x{i}") for i, w in enumerate(terms)])
    swept = two_way_residuals(wide, unit, period, {"__y": "__ry", **marks})
    rows = settle(swept.select(unit, period, "__ry", F.array(*marks.values()).alias("__x")))
    facts = rows.agg(F.count("*").alias("n"), F.count_distinct(unit).alias("u"), F.count_distinct(period).alias("t")).first()
    beta, bread, meat = _normal_equations(rows, size)
    n, k = facts["n"], facts["u"] + facts["t"] - 1 + size
    cov = bread @ meat @ bread * (n / (n - k) if n > k else float("nan"))
    late = np.array([float(w >= 0) for w in terms]) / max(1, sum(w >= 0 for w in weeks))
    average, error = float(late @ beta), float(np.sqrt(max(late @ cov @ late, 0.0)))
    found = {w: (float(beta[i]), float(np.sqrt(max(cov[i, i], 0.0)))) for i, w in enumerate(terms)} | {reference: (0.0, 0.0)}
    table = [(w, *found[w], average, error) for w in weeks]
    return with_interval(df.sparkSession.createDataFrame(table, "rel_week int, coef double, std_error double, avg_post double, avg_post_se double"), "coef")


def pretrend_screen(effects: DataFrame) -> DataFrame:
    """Weeks before the reference whose interval excludes zero, and the size of the early effects."""
    pre = effects.where("rel_week < -1")
    hit = (F.col("ci95_low") > 0) | (F.col("ci95_high") < 0)
    return pre.agg(
        F.count("*").alias("weeks_checked"), F.count_if(hit).alias("significant_weeks"),
        F.max(F.abs("coef")).alias("max_abs"), F.avg(F.abs("coef")).alias("mean_abs"),
        (F.count_if(hit) > 0).alias("pretrend_flag"),
    )


def permute_units(df: DataFrame, unit: str, actual: str, period: str, y: str = "y") -> DataFrame:
    """Two-way DiD with each unit in turn as the treated one; units may miss periods.

    All pseudo-treatments share the unit x unit system of the panel. A unit's estimate needs its own residual sum
    after the event and the share of its treatment that unit and period effects do not explain, which follows from
    how often units meet before and after it. So the rows are swept once whatever the number of units.
    """
    panel = settle(df.where(F.col(y).isNotNull()).select(unit, period, "post", F.col(y).cast("double").alias("__y")))
    swept = two_way_residuals(panel, unit, period, {"__y": "__r"})
    own = {r[unit]: r["s"] for r in swept.where("post = 1").groupBy(unit).agg(F.sum("__r").alias("s")).collect()}
    cells = settle(panel.groupBy(unit, period, "post").agg(F.count("*").alias("__n")))
    sizes = cells.groupBy(unit).agg(F.sum("__n").alias("n"), F.sum(F.col("__n") * F.col("post")).alias("late")).collect()
    if len(sizes) > MOST_LEVELS:
        raise ValueError(f"{len(sizes)} units, more than {MOST_LEVELS}")
    names = sorted(r[unit] for r in sizes)
    count = {r[unit]: (float(r["n"]), float(r["late"])) for r in sizes}
    both, late = (square(meetings(cells, unit, period, [], where).toArrow(), names) for where in (None, "post = 1"))
    after = np.diag([count[u][1] for u in names]) - late
    explained = np.einsum("ij,ik,kj->j", after, np.linalg.pinv(np.diag([count[u][0] for u in names]) - both, rcond=1e-11), after)
    free = np.diag(after) - explained
    table = [(u, int(u == actual), float(own.get(u, 0.0) / d) if d > 1e-9 else None) for u, d in zip(names, free)]
    return placebo_rank(settle(df.sparkSession.createDataFrame(table, f"pseudo_treated_unit {df.schema[unit].dataType.simpleString()}, is_actual_treated int, estimate double")), "estimate")


def placebo_rank(est: DataFrame, value: str) -> DataFrame:
    """Attach the share of units at least as extreme as the actual one, and every unit's rank by magnitude."""
    own = est.where("is_actual_treated = 1").agg(F.max(F.abs(value))).scalar()
    marked = est.withColumn("__own", own)
    p = marked.agg(F.avg((F.abs(value) >= F.col("__own") - 1e-12).cast("double"))).scalar()
    return windows.abs_rank(marked.drop("__own"), value).withColumn("p_two_sided", p)


@dataclass(frozen=True)
class Spec:
    """One re-estimation: pseudo-event date, symmetric window, treated unit and, optionally, the units kept."""

    spec_id: str
    event: str
    window: int
    treated_unit: str
    units: tuple[str, ...] = ()


def sensitivity_grid(panel: DataFrame, unit: str, date: str, specs: Sequence[Spec], y: str = "y") -> DataFrame:
    """TWFE for every spec in one job: rows are tagged with the specs that use them and the spec is a grouping key."""
    tags = F.array(*[
        F.struct(
            F.lit(s.spec_id).alias("spec_id"), F.lit(s.event).cast("date").alias("event"), F.lit(s.window).alias("window"),
            F.lit(s.treated_unit).alias("t"), F.array(*[F.lit(u) for u in s.units]).cast("array<string>").alias("units"),
        ) for s in specs
    ])
    rows = panel.select(F.col(unit), F.col(date), F.col(y).alias("y"), F.explode(tags).alias("s")).select(
        "s.spec_id", unit, date, "y", F.datediff(date, "s.event").alias("rel_day"), (F.col(unit) == F.col("s.t")).cast("int").alias("treated"),
        F.col("s.window").alias("w"), F.col("s.units").alias("u"),
    ).where(F.col("rel_day").between(-F.col("w"), F.col("w")) & ((F.size("u") == 0) | F.array_contains("u", F.col(unit))))
    rows = rows.withColumn("post", (F.col("rel_day") >= 0).cast("int")).withColumn("did", F.col("treated") * F.col("post"))
    return twfe(rows, unit, date, ["spec_id"])


def date_shift_specs(event_days: Sequence[tuple[int, str]], window: int, treated: str) -> list[Spec]:
    return [Spec(f"shift_{d}", day, window, treated) for d, day in event_days]


def control_specs(event: str, window: int, treated: str, controls: Sequence[str]) -> list[Spec]:
    """All controls, each control dropped, each control alone."""
    out = [Spec("all_controls", event, window, treated)]
    out += [Spec(f"drop_{c}", event, window, treated, (treated, *[x for x in controls if x != c])) for c in controls]
    return out + [Spec(f"single_{c}", event, window, treated, (treated, c)) for c in controls]


def gap_frame(panel: DataFrame, date: str, platform: str, first: str, second: str, outcome: str, period: str, scale: str) -> DataFrame:
    """Daily difference of two platforms on a log1p or level scale, labelled pre or post."""
    if scale not in ("log1p", "level"):
        raise ValueError(f"unknown scale: {scale}")
    value = F.log1p(outcome) if scale == "log1p" else F.col(outcome).cast("double")
    wide = panel.where(F.col(period).isin("pre", "post")).groupBy(date, period).agg(
        F.avg(F.when(F.col(platform) == first, value)).alias("first_value"), F.avg(F.when(F.col(platform) == second, value)).alias("second_value")
    )
    return wide.select(date, "first_value", "second_value", (F.col("first_value") - F.col("second_value")).alias("gap"), (F.col(period) == "post").cast("int").alias("post"))


def in_time_placebo(series: DataFrame, date: str, value: str, actual: float | Column, days: int = 7) -> DataFrame:
    """Before/after contrasts at every pseudo date with full frames, and the randomization p of the actual one."""
    pseudo = windows.sliding_contrast(series.withColumn("__s", F.lit(0)), ["__s"], date, value, days, days).drop("__s")
    own = F.lit(actual) if isinstance(actual, (int, float)) else actual
    counts = pseudo.withColumn("__own", own).agg(
        ((F.count_if(F.abs("contrast") >= F.abs("__own")) + 1) / (F.count("*") + 1)).alias("p")
    ).scalar()
    return pseudo.withColumn("randomization_p", counts)


def frequency_sensitivity(layers: dict[str, DataFrame], unit: str, period: str) -> DataFrame:
    """The same TWFE on panels of different frequency."""
    tagged = [df.select(F.lit(name).alias("layer"), unit, F.col(period).cast("string").alias("period"), "y", "treated", "post", "did") for name, df in layers.items()]
    rows = reduce(DataFrame.unionByName, tagged)
    return twfe(rows, unit, "period", ["layer"])


def run_ladder(panel: DataFrame, unit: str, period: str) -> DataFrame:
    """Estimates from a treated-only comparison up to the event study, in one table."""
    def rung(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("rung"), "estimate", "std_error", "ci95_low", "ci95_high")

    panel = settle(panel)
    effects = settle(event_study(panel, unit, period))
    average = with_interval(effects.agg(F.max("avg_post").alias("estimate"), F.max("avg_post_se").alias("std_error")))
    frames = [
        rung("L0_before_after", mean_diff(panel.where("treated = 1"), [], "y", "post")),
        rung("L1_naive_did", did(panel)),
        rung("L2_twfe", twfe(panel, unit, period)),
        rung("L3_event_study", average),
    ]
    flag = pretrend_screen(effects).select("pretrend_flag").scalar()
    worked = F.when(F.col("ci95_low") > 0, "yes").otherwise("no_or_uncertain")
    base = reduce(DataFrame.unionByName, frames).withColumn("decision", worked)
    l4 = rung("L4_pretrend_screen", average).withColumn("decision", worked).withColumn("decision", F.when(flag, "pretrend_flagged").otherwise(F.col("decision")))
    return base.unionByName(l4).withColumn("p_value", normal_p(F.abs(F.try_divide(F.col("estimate"), F.col("std_error")))))
