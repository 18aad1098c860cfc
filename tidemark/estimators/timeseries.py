"""Daily-series estimators: HAC effects, gates, aggregation contrasts and decompositions.

A series has one row per calendar day, so windows over one series are bounded by the calendar; many series are
many window partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.estimators.panel import with_interval
from tidemark.estimators.tails import normal_p
from tidemark.operators import ranking, windows
from tidemark.session import settle

HAC_LAG = 7
Z_05 = 1.959963984540054


def _hac(rows: DataFrame, keys: Sequence[str], order: str, lags: int) -> DataFrame:
    """OLS slope of __y on __x (both already free of the other regressors) with Newey-West errors.

    The slope error needs only the scalar score __x * residual: its Bartlett-weighted lag products, by row position.
    """
    rows = settle(rows)
    fit = rows.groupBy(*keys).agg(
        (F.sum(F.col("__x") * F.col("__y")) / F.nullif(F.sum(F.col("__x") * F.col("__x")), F.lit(0.0))).alias("estimate"),
        F.sum(F.col("__x") * F.col("__x")).alias("__xx"), F.count("*").alias("n_days"),
    )
    scored = rows.join(fit, list(keys)).withColumn("__s", F.col("__x") * (F.col("__y") - F.col("estimate") * F.col("__x")) / F.col("__xx"))
    products = windows.lag_products(scored, keys, order, "__s", lags)
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2.0 * F.col("bartlett"))
    variance = products.groupBy(*keys).agg(F.sum(weight * F.coalesce("product_sum", F.lit(0.0))).alias("__v"))
    out = fit.join(variance, list(keys)).select(*keys, "estimate", F.sqrt(F.greatest(F.col("__v"), F.lit(0.0))).alias("std_error"), "n_days")
    return with_interval(out)


def hac_effect(df: DataFrame, keys: Sequence[str], date: str, y: str, post: str = "post", lags: int = HAC_LAG) -> DataFrame:
    """Effect of ``post`` on ``y`` with weekday effects and Newey-West errors, per series.

    Weekday dummies and the constant are removed by subtracting weekday means from both sides.
    """
    rows = settle(df.where(F.col(y).isNotNull()).withColumn("__wd", F.weekday(date)))
    by = [*keys, "__wd"]
    means = rows.groupBy(*by).agg(F.avg(y).alias("__my"), F.avg(F.col(post).cast("double")).alias("__mx"))
    free = rows.join(means, by).withColumn("__y", F.col(y) - F.col("__my")).withColumn("__x", F.col(post) - F.col("__mx"))
    return _hac(free.select(*keys, date, "__y", "__x"), keys, date, lags)


def hac_trend(df: DataFrame, keys: Sequence[str], date: str, y: str, lags: int = HAC_LAG) -> DataFrame:
    """Slope per day of ``y`` with Newey-West errors, per series."""
    rows = df.where(F.col(y).isNotNull()).withColumn("__d", F.datediff(date, F.lit("1970-01-01").cast("date")).cast("double"))
    means = rows.groupBy(*keys).agg(F.avg(y).alias("__my"), F.avg("__d").alias("__md"))
    free = rows.join(means, list(keys)).withColumn("__y", F.col(y) - F.col("__my")).withColumn("__x", F.col("__d") - F.col("__md"))
    return _hac(free.select(*keys, date, "__y", "__x"), keys, date, lags)


def with_p(estimates: DataFrame) -> DataFrame:
    return estimates.withColumn("p_value", normal_p(F.abs(F.try_divide(F.col("estimate"), F.col("std_error")))))


def timing_gate(df: DataFrame, keys: Sequence[str], date: str, y: str, announcement: str, activation: str, post_start: str) -> DataFrame:
    """Three treatments of an announced rule change, from one frame with a sample tag.

    ``naive_announcement``   announcement counts as treatment, all days
    ``verified_activation``  post starts after the partial activation day, which is dropped
    ``anticipation_gate``    announcement interval dropped; unidentified (null) when the interval itself moved at 5%
    """
    day = lambda text: F.lit(text).cast("date")
    d = F.to_date(date)
    masks = F.array(
        F.struct(F.lit("naive_announcement").alias("m"), F.lit(True).alias("keep"), (d >= day(announcement)).alias("post")),
        F.struct(F.lit("verified_activation").alias("m"), (d != day(activation)).alias("keep"), (d >= day(post_start)).alias("post")),
        F.struct(F.lit("anticipation_gate").alias("m"), ((d < day(announcement)) | (d >= day(post_start))).alias("keep"), (d >= day(post_start)).alias("post")),
        F.struct(F.lit("gate_test").alias("m"), (d < day(activation)).alias("keep"), (d >= day(announcement)).alias("post")),
    )
    rows = df.select(*keys, date, y, F.explode(masks).alias("k")).where("k.keep").select(
        *keys, date, y, F.col("k.m").alias("method"), F.col("k.post").cast("int").alias("post")
    )
    fits = settle(hac_effect(rows, [*keys, "method"], date, y))
    gate = fits.where("method = 'gate_test'").select(*keys, F.coalesce(F.abs(F.col("estimate") / F.nullif(F.col("std_error"), F.lit(0.0))) > Z_05, F.lit(False)).alias("moved"))
    kept = fits.where("method <> 'gate_test'")
    joined = kept.join(gate, list(keys), "left") if keys else kept.withColumn("moved", gate.select("moved").scalar())
    blocked = (F.col("method") == "anticipation_gate") & F.col("moved")
    return joined.select(
        *keys, "method", F.when(~blocked, F.col("estimate")).alias("estimate"), F.when(~blocked, F.col("std_error")).alias("std_error"), "n_days",
        F.when(F.col("method") == "anticipation_gate", F.col("moved")).alias("unidentified"),
    )


PRE_DAYS, TARGET_DAYS, WEEK, BINS = 28, 7, 7, 6


def contrast_weights(day: Column, offset: Column) -> dict[str, Column]:
    """Weight of one relative day in each aggregation method, for a weekday offset 0..6.

    The window is six whole calendar weeks: four before the event week, the event week, and the next one.
    ``before`` is the number of event-week days ahead of the event.
    """
    before = F.pmod(offset + 3, F.lit(WEEK))
    start = -(before + PRE_DAYS)
    place = day - start
    inside = (place >= 0) & (place < BINS * WEEK)
    bin_ = F.floor(place / WEEK)
    daily = F.when(day.between(0, TARGET_DAYS - 1), 1.0 / TARGET_DAYS).when(day.between(-PRE_DAYS, -1), -1.0 / PRE_DAYS).otherwise(0.0)
    naive = F.when(bin_ >= 4, 1.0 / (2 * WEEK)).otherwise(-1.0 / PRE_DAYS)
    # share of target days per bin: none, then the two weeks the target straddles; they sum to one
    late, early = before / F.lit(float(WEEK)), (F.lit(WEEK) - before) / F.lit(float(WEEK))
    mean = F.lit(1.0 / BINS)
    spread = early * early + late * late - F.lit(1.0 / BINS)
    exposure = F.when(bin_ == 4, early).when(bin_ == 5, late).otherwise(0.0)
    slope = (exposure - mean) / spread / F.lit(float(WEEK))
    zero = lambda c: F.when(inside, c).otherwise(0.0)
    return {"daily": zero(daily), "naive_week": zero(naive), "exposure_week": zero(slope), "event_aligned": zero(daily)}


def treated_gap(panel: DataFrame, day: str, y: str = "y", treated: str = "treated") -> DataFrame:
    """Treated value minus the mean of the controls, per relative day."""
    return panel.groupBy(day).agg(
        (F.avg(F.when(F.col(treated) == 1, F.col(y))) - F.avg(F.when(F.col(treated) == 0, F.col(y)))).alias("gap")
    )


def aggregation_contrasts(gap: DataFrame, day: str = "rel_day", value: str = "gap", keys: Sequence[str] = ()) -> DataFrame:
    """Four contrasts x seven weekday offsets as weighted sums of one daily difference series."""
    rows = gap.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(6))))
    weights = contrast_weights(F.col(day), F.col("offset"))
    sums = rows.groupBy(*keys, "offset").agg(*[F.sum(w * F.col(value)).alias(m) for m, w in weights.items()])
    return sums.unpivot([*keys, "offset"], list(weights), "method", "estimate")


def bin_composition(gap: DataFrame, day: str = "rel_day") -> DataFrame:
    """Per offset and weekly bin: target, earlier and later days observed, and the exposure share."""
    rows = gap.select(day).distinct().withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(6))))
    before = F.pmod(F.col("offset") + 3, F.lit(WEEK))
    place = F.col(day) + before + PRE_DAYS
    target = F.col(day).between(0, TARGET_DAYS - 1)
    return rows.where((place >= 0) & (place < BINS * WEEK)).groupBy("offset", F.floor(place / WEEK).alias("bin_index")).agg(
        F.count_if(target).alias("n_target_days"), F.count_if(F.col(day) < 0).alias("n_pre_days"), F.count_if(F.col(day) >= TARGET_DAYS).alias("n_later_days"),
        (F.count_if(target) / F.lit(float(WEEK))).alias("exposure"),
    )


def decompose_panel(panel: DataFrame, unit: str, date: str, y: str = "y") -> DataFrame:
    """Per unit: mean, slope per day, spread of what unit and day means leave, and the tie to the day mean."""
    panel = settle(panel)
    day_mean = panel.groupBy(date).agg(F.avg(y).alias("__day"))
    unit_mean = panel.groupBy(unit).agg(F.avg(y).alias("__unit"))
    grand = panel.agg(F.avg(y)).scalar()
    rows = panel.join(day_mean, date).join(unit_mean, unit).withColumn("__grand", grand)
    rows = rows.withColumn("resid", F.col(y) - F.col("__day") - F.col("__unit") + F.col("__grand")).withColumn(
        "d", F.datediff(date, F.lit("1970-01-01").cast("date")).cast("double"))
    return rows.groupBy(unit).agg(
        F.count("*").alias("n"), F.first("__unit").alias("unit_mean"), (F.first("__unit") - F.first("__grand")).alias("unit_effect"),
        F.regr_slope(F.col(y), F.col("d")).alias("slope_per_day"), F.stddev_samp(y).alias("sd"), F.stddev_samp("resid").alias("resid_sd"),
        F.corr(F.col(y), F.col("__day")).alias("corr_with_day_mean"),
    )


def weekday_effects(panel: DataFrame, date: str, y: str = "y") -> DataFrame:
    """Mean day effect (day mean less grand mean) per weekday, Monday 0."""
    grand = panel.agg(F.avg(y)).scalar()
    days = panel.groupBy(date).agg(F.avg(y).alias("m")).withColumn("g", grand)
    return days.groupBy(F.weekday(date).alias("weekday")).agg(F.avg(F.col("m") - F.col("g")).alias("effect"), F.count("*").alias("n_days"))


GATE_LOW, GATE_HIGH = 0.25, 1.0


def effect_gate(spread: DataFrame, sd: str, effects: dict[str, float]) -> DataFrame:
    """Registered effects in units of the outcome spread; outside [0.25, 1] the design is blocked."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("effect_name"), F.lit(v).alias("effect")) for k, v in effects.items()])).alias("e")
    rows = spread.select("*", pairs).select(*[c for c in spread.columns], "e.effect_name", (F.col("e.effect") / F.col(sd)).alias("sd_units"))
    return rows.withColumn("below_gate", F.col("sd_units") < GATE_LOW).withColumn("above_gate", F.col("sd_units") > GATE_HIGH)


def null_sd(gap: DataFrame, day: str, value: str, before: int = PRE_DAYS, after: int = TARGET_DAYS) -> DataFrame:
    """Spread, skewness and quantiles of the sliding contrast over a pre-event series."""
    est = settle(windows.sliding_contrast(gap.withColumn("__s", F.lit(0)), ["__s"], day, value, before, after).drop("__s"))
    row = est.agg(F.count("*").alias("n_windows"), F.stddev_samp("contrast").alias("sd"), F.skewness("contrast").alias("skewness"))
    return ranking.with_quantiles(row, [], ranking.quantiles(est, [], "contrast", {"p05": 0.05, "p50": 0.5, "p95": 0.95}))
