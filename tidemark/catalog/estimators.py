"""Panel, matching and resampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import roles
from tidemark.catalog.market import POST_EVENT
from tidemark.catalog.registry import Tables, query
from tidemark.estimators import clusters, matching, panel, regression, replicates, resampling, staggered, synthetic, timeseries
from tidemark.operators import aggregates, joins, reshape
from tidemark.plans import market

EVENT = roles.PANEL_EVENT
UNITS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")

ALL_WEEKS = f"{roles.WEEKS}, p AS (SELECT * FROM weekly)"
ROUNDS = 80


def swept_sql(name: str, source: str, columns: str, keys: str = "", unit: str = "unit", period: str = "week", outs: tuple[str, ...] = ("yt", "dt"), kept: str = "") -> str:
    """A recursive table that takes unit and period means off in turn until nothing is left of either."""
    k = f"{keys}, " if keys else ""
    more = f", {kept}" if kept else ""
    by_unit = ", ".join(f"{o} - avg({o}) OVER (PARTITION BY {k}{unit}) AS {o}" for o in outs)
    by_period = ", ".join(f"{o} - avg({o}) OVER (PARTITION BY {k}{period}) AS {o}" for o in outs)
    return f"""{name}_steps AS (SELECT 0 AS step, {k}{unit}, {period}{more}, {columns} FROM {source} UNION ALL
  SELECT step, {k}{unit}, {period}{more}, {by_period} FROM (SELECT step + 1 AS step, {k}{unit}, {period}{more}, {by_unit} FROM {name}_steps WHERE step < {ROUNDS})),
{name} AS (SELECT * EXCLUDE (step) FROM {name}_steps WHERE step = {ROUNDS})"""


def ci_sql(estimate: str = "estimate", error: str = "std_error") -> str:
    return f"{estimate} - 1.96 * {error} AS ci95_low, {estimate} + 1.96 * {error} AS ci95_high"


CI = "estimate std_error ci95_low ci95_high"


def normal_p_sql(z: str) -> str:
    """Two-sided normal tail by the all-positive series of the error function; beyond 12 it is below 1e-32."""
    half = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    terms = f"SELECT sum(exp(2 * k * ln(2.0::DOUBLE) + (2 * k + 1) * ln({half}) + lgamma(k + 1.0::DOUBLE) - lgamma(2 * k + 2.0::DOUBLE) - {half} * {half})) FROM generate_series(0, 400) AS g(k)"
    return f"CASE WHEN {z} = 0 THEN 1.0 WHEN abs({z}) > 12 THEN 0.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * ({terms})) END"


def student4_p_sql(t: str) -> str:
    """Two-sided Student tail with four degrees of freedom, in closed form."""
    u = f"({t} * {t} / (4 + {t} * {t}))"
    return f"(1 - 1.5 * sqrt({u}) * (1 - {u} / 3))"


def uniform_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


def poisson_sql(u: str) -> str:
    import math

    total, steps = 0.0, []
    for k in range(resampling.POISSON_TERMS):
        total += math.exp(-1.0) / math.factorial(k)
        steps.append(f"CASE WHEN {u} >= {total!r}::DOUBLE THEN 1 ELSE 0 END")
    return "(" + " + ".join(steps) + ")"


@query("weekly_panel", f"WITH {roles.WEEKS} SELECT unit, week, volume, treated, y, post, did, rel_week, rel_day FROM weekly", "volume y")
def weekly_panel(t: Tables) -> DataFrame:
    return roles.weekly_panel(t).select("unit", "week", "volume", "treated", "y", "post", "did", "rel_week", F.col("rel_day").cast("bigint").alias("rel_day"))


@query("mean_difference", f"""WITH {roles.WEEKS}, s AS (SELECT unit, count(CASE WHEN post = 1 THEN y END) AS n1, count(CASE WHEN post = 0 THEN y END) AS n0,
  avg(CASE WHEN post = 1 THEN y END) - avg(CASE WHEN post = 0 THEN y END) AS estimate,
  sqrt(var_samp(CASE WHEN post = 1 THEN y END) / count(CASE WHEN post = 1 THEN y END) + var_samp(CASE WHEN post = 0 THEN y END) / count(CASE WHEN post = 0 THEN y END)) AS std_error
  FROM weekly GROUP BY 1) SELECT *, {ci_sql()}, {normal_p_sql('(estimate / std_error)')} AS p_value FROM s""", f"{CI} p_value")
def mean_difference(t: Tables) -> DataFrame:
    return timeseries.with_p(panel.mean_diff(roles.weekly_panel(t), ["unit"], "y", "post"))


@query("naive_did", f"""WITH {roles.WEEKS}, c AS (SELECT treated, post, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM weekly GROUP BY 1, 2),
  s AS (SELECT CAST(sum(n) AS BIGINT) AS n_rows, sum(CASE WHEN treated = post THEN m ELSE -m END) AS estimate, sqrt(sum(v / n) * sum(n) / (sum(n) - 4)) AS std_error FROM c)
  SELECT *, {ci_sql()}, {normal_p_sql('(estimate / std_error)')} AS p_value FROM s""", f"{CI} p_value")
def naive_did(t: Tables) -> DataFrame:
    return timeseries.with_p(panel.did(roles.weekly_panel(t)))


@query("ols_hc1", f"""WITH {roles.WEEKS}, c AS (SELECT treated, post, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM weekly GROUP BY 1, 2),
  s AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(CASE WHEN treated = 0 AND post = 0 THEN m END) AS m00, sum(CASE WHEN treated = 1 AND post = 0 THEN m END) AS m10,
    sum(CASE WHEN treated = 0 AND post = 1 THEN m END) AS m01, sum(CASE WHEN treated = 1 AND post = 1 THEN m END) AS m11,
    sum(CASE WHEN treated = 0 AND post = 0 THEN v / n END) AS v00, sum(CASE WHEN treated = 1 AND post = 0 THEN v / n END) AS v10,
    sum(CASE WHEN treated = 0 AND post = 1 THEN v / n END) AS v01, sum(CASE WHEN treated = 1 AND post = 1 THEN v / n END) AS v11, sum(n) / (sum(n) - 4) AS f FROM c),
  r AS (SELECT n, 'const' AS term, m00 AS estimate, sqrt(f * v00) AS std_error FROM s UNION ALL SELECT n, 'treated', m10 - m00, sqrt(f * (v10 + v00)) FROM s
    UNION ALL SELECT n, 'post', m01 - m00, sqrt(f * (v01 + v00)) FROM s UNION ALL SELECT n, 'did', m11 - m10 - m01 + m00, sqrt(f * (v00 + v10 + v01 + v11)) FROM s)
  SELECT *, {ci_sql()}, {normal_p_sql('(estimate / std_error)')} AS p_value FROM r""", f"{CI} p_value", digits=5)
def ols_hc1(t: Tables) -> DataFrame:
    return regression.ols(roles.weekly_panel(t), "y", ["treated", "post", "did"])


WITHIN = swept_sql("w", "p", "y AS yt, did::DOUBLE AS dt") + """,
b AS (SELECT sum(dt * yt) / sum(dt * dt) AS estimate, sum(dt * dt) AS dd, count(*) AS n, count(DISTINCT unit) AS u, count(DISTINCT week) AS t FROM w)"""


@query("twfe_did", f"""WITH RECURSIVE {ALL_WEEKS}, {WITHIN},
  s AS (SELECT any_value(estimate) AS estimate, sqrt(sum(dt * dt * (yt - estimate * dt) * (yt - estimate * dt)) * any_value(n) / (any_value(n) - any_value(u) - any_value(t))) / any_value(dd) AS std_error,
    any_value(n) AS n_rows, any_value(u) AS n_units, any_value(t) AS n_periods FROM w, b) SELECT *, {ci_sql()}, {normal_p_sql('(estimate / std_error)')} AS p_value FROM s""", f"{CI} p_value")
def twfe_did(t: Tables) -> DataFrame:
    return timeseries.with_p(panel.twfe(roles.weekly_panel(t), "unit", "week"))


# one region is treated, so its weeks are groups of their own beside the other regions: an effect is the gap of two such
# groups, and its weight on each row is the group's dummy freed of the weeks and of all groups but the reference
STUDY = f"""{ALL_WEEKS}, grp AS (SELECT *, CASE WHEN treated = 1 THEN 'w' || rel_week ELSE unit END AS grp FROM p),
{swept_sql("fit", "grp", "y AS e", "", "grp", "week", ("e",), "unit, rel_week")},
ks AS (SELECT DISTINCT rel_week AS k FROM p WHERE rel_week <> -1), xs AS (SELECT k, unit, week, CASE WHEN treated = 1 AND rel_week = k THEN 'w-1' ELSE grp END AS grp, CASE WHEN treated = 1 AND rel_week = k THEN 1.0::DOUBLE ELSE 0 END AS x FROM grp, ks),
{swept_sql("xw", "xs", "x", "k", "grp", "week", ("x",), "unit")},
wt AS (SELECT k, unit, week, x / sum(x * x) OVER (PARTITION BY k) AS w FROM xw),
f AS (SELECT count(*) / (count(*) - (count(DISTINCT unit) + count(DISTINCT week) - 1 + count(DISTINCT rel_week) - 1))::DOUBLE AS f FROM p),
ce AS (SELECT k AS rel_week, sum(w * y) AS coef, sqrt(any_value(f) * sum(w * w * e * e)) AS std_error FROM wt JOIN p USING (unit, week) JOIN fit USING (unit, week), f GROUP BY 1),
av AS (SELECT unit, week, avg(w) AS w FROM wt WHERE k >= 0 GROUP BY 1, 2),
a AS (SELECT sum(w * y) AS avg_post, sqrt(any_value(f) * sum(w * w * e * e)) AS avg_post_se FROM av JOIN p USING (unit, week) JOIN fit USING (unit, week), f),
study AS (SELECT rel_week, coef, std_error, avg_post, avg_post_se FROM (SELECT * FROM ce UNION ALL SELECT -1, 0, 0), a)"""


@query("event_study", f"WITH RECURSIVE {STUDY} SELECT *, {ci_sql('coef')} FROM study", "coef std_error avg_post avg_post_se ci95_low ci95_high")
def event_study(t: Tables) -> DataFrame:
    return panel.event_study(roles.weekly_panel(t), "unit", "week")


@query("pretrend_screen", f"""WITH RECURSIVE {STUDY} SELECT count(*) AS weeks_checked, count(CASE WHEN abs(coef) > 1.96 * std_error THEN 1 END) AS significant_weeks,
  max(abs(coef)) AS max_abs, avg(abs(coef)) AS mean_abs, count(CASE WHEN abs(coef) > 1.96 * std_error THEN 1 END) > 0 AS pretrend_flag FROM study WHERE rel_week < -1""", "max_abs mean_abs")
def pretrend_screen(t: Tables) -> DataFrame:
    return panel.pretrend_screen(panel.event_study(roles.weekly_panel(t), "unit", "week"))


@query("estimate_ladder", f"""WITH RECURSIVE {STUDY}, {WITHIN},
  l0 AS (SELECT avg(CASE WHEN post = 1 THEN y END) - avg(CASE WHEN post = 0 THEN y END) AS estimate,
    sqrt(var_samp(CASE WHEN post = 1 THEN y END) / count(CASE WHEN post = 1 THEN y END) + var_samp(CASE WHEN post = 0 THEN y END) / count(CASE WHEN post = 0 THEN y END)) AS std_error FROM p WHERE treated = 1),
  cc AS (SELECT treated, post, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM p GROUP BY 1, 2),
  l1 AS (SELECT sum(CASE WHEN treated = post THEN m ELSE -m END) AS estimate, sqrt(sum(v / n) * sum(n) / (sum(n) - 4)) AS std_error FROM cc),
  l2 AS (SELECT any_value(estimate) AS estimate, sqrt(sum(dt * dt * power(yt - estimate * dt, 2)) * any_value(n) / (any_value(n) - any_value(u) - any_value(t))) / any_value(dd) AS std_error FROM w, b),
  r AS (SELECT 'L0_before_after' AS rung, * FROM l0 UNION ALL SELECT 'L1_naive_did', * FROM l1 UNION ALL SELECT 'L2_twfe', * FROM l2
    UNION ALL SELECT 'L3_event_study', avg_post, avg_post_se FROM a UNION ALL SELECT 'L4_pretrend_screen', avg_post, avg_post_se FROM a),
  fl AS (SELECT count(CASE WHEN abs(coef) > 1.96 * std_error THEN 1 END) > 0 AS flag FROM study WHERE rel_week < -1)
  SELECT rung, estimate, std_error, {ci_sql()}, CASE WHEN rung = 'L4_pretrend_screen' AND flag THEN 'pretrend_flagged' WHEN estimate - 1.96 * std_error > 0 THEN 'yes' ELSE 'no_or_uncertain' END AS decision,
    {normal_p_sql('(estimate / std_error)')} AS p_value FROM r, fl""", f"{CI} p_value")
def estimate_ladder(t: Tables) -> DataFrame:
    return panel.run_ladder(roles.weekly_panel(t), "unit", "week")


@query("unit_permutation", f"""WITH RECURSIVE {ALL_WEEKS}, c AS (SELECT g.unit AS pseudo, p.unit, p.week, y, CASE WHEN p.unit = g.unit AND post = 1 THEN 1.0::DOUBLE ELSE 0 END AS did FROM p, (SELECT DISTINCT unit FROM p) g),
  {swept_sql("w", "c", "y AS yt, did AS dt", "pseudo")},
  e AS (SELECT pseudo AS pseudo_treated_unit, CASE WHEN pseudo = 'ASIA' THEN 1 ELSE 0 END AS is_actual_treated, sum(dt * yt) / sum(dt * dt) AS estimate FROM w GROUP BY 1)
  SELECT *, rank() OVER (ORDER BY abs(estimate) DESC) AS abs_rank, (SELECT avg(CASE WHEN abs(x.estimate) >= (SELECT abs(estimate) FROM e WHERE is_actual_treated = 1) - 1e-12 THEN 1.0 ELSE 0.0 END) FROM e x) AS p_two_sided FROM e""",
       "estimate p_two_sided")
def unit_permutation(t: Tables) -> DataFrame:
    return panel.permute_units(roles.weekly_panel(t), "unit", "ASIA", "week")


SHIFTS = [(d, f"1998-06-{8 + d:02d}") for d in range(-7, 8)]
SPECS = (
    panel.date_shift_specs(SHIFTS, 700, "ASIA")
    + [panel.Spec(f"window_{w}", "1998-06-08", w, "ASIA") for w in (300, 450, 600, 750, 900)]
    + panel.control_specs("1998-06-08", 900, "ASIA", [u for u in UNITS if u != "ASIA"])
    + [panel.Spec(f"placebo_{d}", day, 140, "ASIA") for d, day in ((-70, "1998-03-30"), (-56, "1998-04-13"), (-42, "1998-04-27"), (-28, "1998-05-11"))]
)
SPEC_ROWS = ", ".join(
    "('{}', DATE '{}', {}, '{}', [{}]::VARCHAR[])".format(s.spec_id, s.event, s.window, s.treated_unit, ", ".join(f"'{u}'" for u in s.units)) for s in SPECS
)


@query("sensitivity_grid", f"""WITH RECURSIVE {roles.WEEKS}, spec(spec_id, event, win, tu, us) AS (VALUES {SPEC_ROWS}),
  r AS (SELECT spec_id, unit, week, y, CASE WHEN unit = tu THEN 1 ELSE 0 END AS treated, CASE WHEN week >= event THEN 1 ELSE 0 END AS post FROM weekly, spec
    WHERE date_diff('day', event, week) BETWEEN -win AND win AND (len(us) = 0 OR list_contains(us, unit))),
  p AS (SELECT *, treated * post AS did FROM r), {swept_sql("w", "p", "y AS yt, did::DOUBLE AS dt", "spec_id")},
  b AS (SELECT spec_id, sum(dt * yt) / sum(dt * dt) AS estimate, sum(dt * dt) AS dd, count(*) AS n, count(DISTINCT unit) AS u, count(DISTINCT week) AS t FROM w GROUP BY 1),
  s AS (SELECT spec_id, any_value(estimate) AS estimate, sqrt(sum(dt * dt * power(yt - estimate * dt, 2)) * any_value(n) / (any_value(n) - any_value(u) - any_value(t))) / any_value(dd) AS std_error,
    any_value(n) AS n_rows, any_value(u) AS n_units, any_value(t) AS n_periods FROM w JOIN b USING (spec_id) GROUP BY 1) SELECT *, {ci_sql()} FROM s""", CI)
def sensitivity_grid(t: Tables) -> DataFrame:
    return panel.sensitivity_grid(roles.weekly_panel(t), "unit", "week", SPECS)


@query("wild_cluster", f"""WITH RECURSIVE {ALL_WEEKS}, {WITHIN}, g AS (SELECT unit, sum(dt * yt) / any_value(dd) AS c, row_number() OVER (ORDER BY unit) - 1 AS i FROM w, b GROUP BY 1),
  v AS (SELECT unnest(generate_series(0, 31)) AS v), d AS (SELECT v, sum(CASE WHEN (v >> i::INT) & 1 = 1 THEN c ELSE -c END) AS x FROM v, g GROUP BY 1)
  SELECT (SELECT estimate FROM b) AS estimate, 5 AS cluster_count, count(*) AS sign_assignments, avg(CASE WHEN abs(x) >= abs((SELECT estimate FROM b)) - 1e-12 THEN 1.0 ELSE 0.0 END) AS p_value,
  quantile_cont(x, 0.025) AS ci95_low, quantile_cont(x, 0.975) AS ci95_high,
  (SELECT sqrt(sum(dt * dt * (yt - estimate * dt) * (yt - estimate * dt)) * any_value(n) / any_value(n - u - t)) / any_value(dd) FROM w, b) AS std_error_hc1 FROM d""", "estimate p_value ci95_low ci95_high std_error_hc1")
def wild_cluster(t: Tables) -> DataFrame:
    return clusters.wild_cluster(roles.weekly_panel(t), "unit", "week")


@query("cluster_robust_t", f"""WITH RECURSIVE {ALL_WEEKS}, {WITHIN}, g AS (SELECT unit, sum(dt * (yt - estimate * dt)) / any_value(dd) AS score, any_value(n) AS n, any_value(u) AS u, any_value(t) AS t, any_value(estimate) AS estimate FROM w, b GROUP BY 1),
  s AS (SELECT any_value(estimate) AS estimate, sqrt(sum(score * score) * any_value(u) / (any_value(u) - 1) * (any_value(n) - 1) / (any_value(n) - any_value(u) - any_value(t))) AS std_error FROM g)
  SELECT estimate, std_error, 5 AS clusters, estimate / std_error AS t FROM s""", "estimate std_error t", digits=5)
def cluster_robust_t(t: Tables) -> DataFrame:
    return clusters.crv1(roles.weekly_panel(t), "unit", "week").drop("t_p_value", "sign_p_value")


@query("cluster_sign_enumeration", f"""WITH RECURSIVE {ALL_WEEKS}, {WITHIN}, gi AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS i FROM (SELECT DISTINCT unit FROM w)), v AS (SELECT unnest(generate_series(0, 31)) AS v),
  x AS (SELECT v, unit, week, dt, CASE WHEN (v >> i::INT) & 1 = 1 THEN yt ELSE -yt END AS sr FROM v, w JOIN gi USING (unit)), bs AS (SELECT v, sum(dt * sr) / sum(dt * dt) AS beta FROM x GROUP BY 1),
  {swept_sql("sx", "x", "sr", "v", "unit", "week", ("sr",), "dt")},
  g AS (SELECT v, unit, any_value(beta) AS beta, sum(dt * (sr - beta * dt)) AS score FROM sx JOIN bs USING (v) GROUP BY 1, 2),
  ts AS (SELECT v, any_value(beta) AS beta, sqrt(any_value(u) / (any_value(u) - 1) * (any_value(n) - 1) / (any_value(n) - any_value(u) - any_value(t)) * sum(score * score)) / any_value(dd) AS se FROM g, b GROUP BY 1),
  own AS (SELECT beta AS estimate, se AS std_error, beta / se AS t FROM ts WHERE v = 31)
  SELECT estimate, std_error, 5 AS clusters, t, (SELECT avg(CASE WHEN abs(beta / se) >= abs(t) - 1e-10 THEN 1.0 ELSE 0.0 END) FROM ts) AS sign_p_value, {student4_p_sql('t')} AS t_p_value FROM own""",
       "estimate std_error t sign_p_value t_p_value", digits=5)
def cluster_sign_enumeration(t: Tables) -> DataFrame:
    return clusters.crv1(roles.weekly_panel(t), "unit", "week")


@query("synthetic_gaps")
def synthetic_gaps(t: Tables) -> DataFrame:
    return synthetic.synthetic_gaps(roles.weekly_panel(t), "unit", "week", EVENT, "ASIA")


@query("synthetic_inputs", f"WITH RECURSIVE {ALL_WEEKS} SELECT unit, post, count(*) AS n, avg(y) AS mean FROM p GROUP BY 1, 2", "mean")
def synthetic_inputs(t: Tables) -> DataFrame:
    return roles.weekly_panel(t).groupBy("unit", "post").agg(F.count("*").alias("n"), F.avg("y").alias("mean"))


DAILY = f"""{roles.PANEL}, gap AS (SELECT day, ln(1 + avg(CASE WHEN unit = 'ASIA' THEN volume END)) - ln(1 + avg(CASE WHEN unit = 'EUROPE' THEN volume END)) AS gap,
  ln(1 + avg(CASE WHEN unit = 'ASIA' THEN volume END)) AS a, CASE WHEN day >= DATE '{EVENT}' THEN 1 ELSE 0 END AS post FROM regional GROUP BY 1)"""


def daily_gap(t: Tables) -> DataFrame:
    rows = roles.regional_days(t).withColumn("period", F.when(F.col("day") >= EVENT, "post").otherwise("pre"))
    return panel.gap_frame(rows, "day", "unit", "ASIA", "EUROPE", "volume", "period", "log1p")


@query("platform_gap", f"WITH {DAILY} SELECT day, a AS first_value, a - gap AS second_value, gap, post FROM gap WHERE a IS NOT NULL OR gap IS NOT NULL OR EXISTS (SELECT 1 FROM regional r WHERE r.day = gap.day)", "first_value second_value gap")
def platform_gap(t: Tables) -> DataFrame:
    rows = daily_gap(t)
    return rows.withColumn("second_value", F.when(F.col("gap").isNotNull(), F.col("second_value")))


def hac_sql(source: str, keys: str, x: str, y: str, fe: str) -> str:
    """Shared SQL of a Newey-West slope after sweeping out the means of ``fe``."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    join = f"USING ({keys})" if keys else "ON true"
    group = f"GROUP BY {keys}" if keys else ""
    lags = " + ".join(
        f"{1.0 if lag == 0 else 2.0 * (1.0 - lag / 8.0)} * coalesce(sum(s * lag{lag}), 0)" for lag in range(8)
    )
    cols = ", ".join(f"lag(s, {lag}) OVER ({part}ORDER BY day) AS lag{lag}" if lag else "s AS lag0" for lag in range(8))
    return f"""hx AS (SELECT {k}day, {y} - avg({y}) OVER (PARTITION BY {fe}) AS yy, {x} - avg({x}) OVER (PARTITION BY {fe}) AS xx FROM {source} WHERE {y} IS NOT NULL),
hf AS (SELECT {k}sum(xx * yy) / nullif(sum(xx * xx), 0) AS estimate, sum(xx * xx) AS q, count(*) AS n_days FROM hx {group}),
hs AS (SELECT {'hx.' + keys + ',' if keys else ''} day, xx * (yy - estimate * xx) / q AS s FROM hx JOIN hf {join}),
hl AS (SELECT *, {cols} FROM hs),
hv AS (SELECT {k}sqrt(greatest({lags}, 0)) AS std_error FROM hl {group}),
hac AS (SELECT hf.* EXCLUDE (q), std_error FROM hf JOIN hv {join})"""


@query("hac_post_effect", f"""WITH {DAILY}, {hac_sql('gap', '', 'post', 'gap', 'isodow(day)')} SELECT *, {ci_sql()}, {normal_p_sql('(estimate / std_error)')} AS p_value FROM hac""", f"{CI} p_value")
def hac_post_effect(t: Tables) -> DataFrame:
    return timeseries.with_p(timeseries.hac_effect(daily_gap(t).withColumn("k", F.lit(0)), ["k"], "day", "gap").drop("k"))


@query("hac_pretrend", f"""WITH {DAILY}, pre AS (SELECT *, date_diff('day', DATE '1970-01-01', day)::DOUBLE AS d, 1 AS one FROM gap WHERE post = 0), {hac_sql('pre', '', 'd', 'gap', 'one')} SELECT *, {ci_sql()}, {normal_p_sql('(estimate / std_error)')} AS p_value FROM hac""", f"{CI} p_value", digits=8)
def hac_pretrend(t: Tables) -> DataFrame:
    return timeseries.with_p(timeseries.hac_trend(daily_gap(t).where("post = 0").withColumn("k", F.lit(0)), ["k"], "day", "gap").drop("k"))


@query("timing_gate", f"""WITH {roles.PANEL}, r AS (SELECT unit, day, ln(1 + volume) AS y FROM regional),
  m AS (SELECT unit || '|naive_announcement' AS k, day, y, CASE WHEN day >= DATE '1998-03-01' THEN 1 ELSE 0 END AS post FROM r
    UNION ALL SELECT unit || '|verified_activation', day, y, CASE WHEN day >= DATE '1998-06-02' THEN 1 ELSE 0 END FROM r WHERE day <> DATE '1998-06-01'
    UNION ALL SELECT unit || '|anticipation_gate', day, y, CASE WHEN day >= DATE '1998-06-02' THEN 1 ELSE 0 END FROM r WHERE day < DATE '1998-03-01' OR day >= DATE '1998-06-02'
    UNION ALL SELECT unit || '|gate_test', day, y, CASE WHEN day >= DATE '1998-03-01' THEN 1 ELSE 0 END FROM r WHERE day < DATE '1998-06-01'),
  {hac_sql('m', 'k', 'post', 'y', 'k, isodow(day)')}, x AS (SELECT split_part(k, '|', 1) AS unit, split_part(k, '|', 2) AS method, * FROM hac),
  g AS (SELECT unit, coalesce(abs(estimate / nullif(std_error, 0)) > 1.959963984540054, false) AS moved FROM x WHERE method = 'gate_test')
  SELECT unit, method, CASE WHEN method = 'anticipation_gate' AND moved THEN NULL ELSE estimate END AS estimate, CASE WHEN method = 'anticipation_gate' AND moved THEN NULL ELSE std_error END AS std_error,
    n_days, CASE WHEN method = 'anticipation_gate' THEN moved END AS unidentified FROM x JOIN g USING (unit) WHERE method <> 'gate_test'""", "estimate std_error")
def timing_gate(t: Tables) -> DataFrame:
    rows = roles.regional_days(t).withColumn("y", F.log1p("volume"))
    return timeseries.timing_gate(rows, ["unit"], "day", "y", "1998-03-01", "1998-06-01", "1998-06-02")


@query("in_time_placebo", f"""WITH {DAILY}, s AS (SELECT day, a, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM gap WHERE post = 0 AND a IS NOT NULL),
  c AS (SELECT day, i, n, avg(a) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) - avg(a) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS contrast FROM s),
  k AS (SELECT day, contrast FROM c WHERE i > 7 AND i <= n - 6) SELECT day, contrast, (SELECT (1 + count(CASE WHEN abs(contrast) >= 0.05 THEN 1 END)) / (1.0 + count(*)) FROM k) AS randomization_p FROM k""", "contrast randomization_p")
def in_time_placebo(t: Tables) -> DataFrame:
    return panel.in_time_placebo(daily_gap(t).where("post = 0 AND first_value IS NOT NULL"), "day", "first_value", 0.05)


GAPDAY = f"""{roles.PANEL}, gd AS (SELECT date_diff('day', DATE '{EVENT}', day) AS rel_day, avg(CASE WHEN treated = 1 THEN ln(1 + volume) END) - avg(CASE WHEN treated = 0 THEN ln(1 + volume) END) AS gap FROM regional GROUP BY 1)"""


def relative_gap(t: Tables) -> DataFrame:
    rows = panel.event_clock(roles.regional_days(t), "day", EVENT).withColumn("y", F.log1p("volume"))
    return timeseries.treated_gap(rows, "rel_day")


@query("aggregation_contrasts", f"""WITH {GAPDAY}, o AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k), x AS (SELECT k, (k + 3) % 7 AS w, rel_day AS r, gap, rel_day + (k + 3) % 7 + 28 AS place FROM gd, o),
  y AS (SELECT *, CASE WHEN place BETWEEN 0 AND 41 THEN place // 7 END AS bin FROM x),
  v AS (SELECT *, CASE bin WHEN 4 THEN (7 - w) / 7.0 WHEN 5 THEN w / 7.0 ELSE 0 END AS ex, power((7 - w) / 7.0, 2) + power(w / 7.0, 2) - 1 / 6.0 AS sxx FROM y WHERE bin IS NOT NULL)
  SELECT k AS "offset", 'daily' AS method, sum(gap * CASE WHEN r BETWEEN 0 AND 6 THEN 1 / 7.0::DOUBLE WHEN r BETWEEN -28 AND -1 THEN -1 / 28.0::DOUBLE ELSE 0 END) AS estimate FROM v GROUP BY 1
  UNION ALL SELECT k, 'event_aligned', sum(gap * CASE WHEN r BETWEEN 0 AND 6 THEN 1 / 7.0::DOUBLE WHEN r BETWEEN -28 AND -1 THEN -1 / 28.0::DOUBLE ELSE 0 END) FROM v GROUP BY 1
  UNION ALL SELECT k, 'naive_week', sum(gap * CASE WHEN bin >= 4 THEN 1 / 14.0::DOUBLE ELSE -1 / 28.0::DOUBLE END) FROM v GROUP BY 1
  UNION ALL SELECT k, 'exposure_week', sum(gap * (ex - 1 / 6.0::DOUBLE) / sxx / 7.0::DOUBLE) FROM v GROUP BY 1""", "estimate")
def aggregation_contrasts(t: Tables) -> DataFrame:
    return timeseries.aggregation_contrasts(relative_gap(t))


@query("aggregation_bins", f"""WITH {GAPDAY}, o AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k), x AS (SELECT k, rel_day AS r, rel_day + (k + 3) % 7 + 28 AS place FROM gd, o)
  SELECT k AS "offset", place // 7 AS bin_index, count(CASE WHEN r BETWEEN 0 AND 6 THEN 1 END) AS n_target_days, count(CASE WHEN r < 0 THEN 1 END) AS n_pre_days, count(CASE WHEN r >= 7 THEN 1 END) AS n_later_days,
    count(CASE WHEN r BETWEEN 0 AND 6 THEN 1 END) / 7.0 AS exposure FROM x WHERE place BETWEEN 0 AND 41 GROUP BY 1, 2""", "exposure")
def aggregation_bins(t: Tables) -> DataFrame:
    return timeseries.bin_composition(relative_gap(t))


@query("panel_decomposition", f"""WITH RECURSIVE {ALL_WEEKS}, d AS (SELECT *, avg(y) OVER (PARTITION BY week) AS dm, avg(y) OVER (PARTITION BY unit) AS um, avg(y) OVER () AS g, date_diff('day', DATE '1970-01-01', week)::DOUBLE AS x FROM p)
  SELECT unit, count(*) AS n, any_value(um) AS unit_mean, any_value(um) - any_value(g) AS unit_effect, regr_slope(y, x) AS slope_per_day, stddev_samp(y) AS sd, stddev_samp(y - dm - um + g) AS resid_sd, corr(y, dm) AS corr_with_day_mean FROM d GROUP BY 1""",
       "unit_mean unit_effect slope_per_day sd resid_sd corr_with_day_mean", digits=8)
def panel_decomposition(t: Tables) -> DataFrame:
    return timeseries.decompose_panel(roles.weekly_panel(t), "unit", "week")


@query("weekday_effects", f"""WITH {roles.PANEL}, l AS (SELECT day, ln(1 + volume) AS y FROM regional), d AS (SELECT day, avg(y) AS m FROM l GROUP BY 1)
  SELECT isodow(day) - 1 AS weekday, avg(m - (SELECT avg(y) FROM l)) AS effect, count(*) AS n_days FROM d GROUP BY 1""", "effect")
def weekday_effects(t: Tables) -> DataFrame:
    return timeseries.weekday_effects(roles.regional_days(t).withColumn("y", F.log1p("volume")), "day").withColumn("weekday", F.col("weekday").cast("bigint"))


@query("effect_size_gate", f"""WITH RECURSIVE {ALL_WEEKS}, d AS (SELECT unit, stddev_samp(y) AS sd FROM p GROUP BY 1), e(effect_name, effect) AS (VALUES ('small', 0.05::DOUBLE), ('medium', 0.15::DOUBLE), ('large', 0.5::DOUBLE))
  SELECT unit, sd, effect_name, effect / sd AS sd_units, effect / sd < 0.25 AS below_gate, effect / sd > 1.0 AS above_gate FROM d, e""", "sd sd_units")
def effect_size_gate(t: Tables) -> DataFrame:
    spread = roles.weekly_panel(t).groupBy("unit").agg(F.stddev_samp("y").alias("sd"))
    return timeseries.effect_gate(spread, "sd", {"small": 0.05, "medium": 0.15, "large": 0.5})


@query("null_spread", f"""WITH {GAPDAY}, s AS (SELECT rel_day, gap, row_number() OVER (ORDER BY rel_day) AS i, count(*) OVER () AS n FROM gd WHERE rel_day < 0 AND gap IS NOT NULL),
  c AS (SELECT i, n, avg(gap) OVER (ORDER BY rel_day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) - avg(gap) OVER (ORDER BY rel_day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS x FROM s),
  k AS (SELECT x FROM c WHERE i > 28 AND i <= n - 6), mo AS (SELECT avg(x) AS m FROM k)
  SELECT count(*) AS n_windows, stddev_samp(x) AS sd, avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5) AS skewness, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.95) AS p95 FROM k, mo""",
       "sd skewness p05 p50 p95")
def null_spread(t: Tables) -> DataFrame:
    return timeseries.null_sd(relative_gap(t).where("rel_day < 0 AND gap IS NOT NULL"), "rel_day", "gap")


@query("block_bootstrap", f"""WITH {GAPDAY}, s AS (SELECT gap, row_number() OVER (ORDER BY rel_day) - 1 AS pos, count(*) OVER () AS n FROM gd WHERE rel_day BETWEEN -28 AND 13 AND gap IS NOT NULL),
  z AS (SELECT any_value(n) AS n FROM s), bl AS (SELECT n, draw, b, CAST(floor({uniform_sql("'block'", 'draw', 'b')} * (n - 7 + 1)) AS BIGINT) AS st
    FROM z, (SELECT unnest(generate_series(1, 200)) AS draw), (SELECT unnest(generate_series(0, 5)) AS b) WHERE b < ceil(n / 7.0)),
  ps AS (SELECT draw, b * 7 + k AS slot, (st + k) % n AS pos FROM bl, (SELECT unnest(generate_series(0, 6)) AS k) WHERE b * 7 + k < n),
  dr AS (SELECT draw, sum(gap * CASE WHEN slot BETWEEN 28 AND 34 THEN 1 / 7.0::DOUBLE WHEN slot < 28 THEN -1 / 28.0::DOUBLE ELSE 0 END) AS x FROM ps JOIN s USING (pos) GROUP BY 1)
  SELECT (SELECT sum(gap * CASE WHEN pos BETWEEN 28 AND 34 THEN 1 / 7.0::DOUBLE WHEN pos < 28 THEN -1 / 28.0::DOUBLE ELSE 0 END) FROM s) AS estimate, (SELECT n FROM z) AS n_days,
    count(*) AS draws, stddev_samp(x) AS boot_se, quantile_cont(x, 0.025) AS ci95_low, quantile_cont(x, 0.975) AS ci95_high FROM dr""", "estimate boot_se ci95_low ci95_high")
def block_bootstrap(t: Tables) -> DataFrame:
    series = relative_gap(t).where("rel_day BETWEEN -28 AND 13 AND gap IS NOT NULL")
    weight = F.when(F.col("slot").between(28, 34), 1.0 / 7).when(F.col("slot") < 28, -1.0 / 28).otherwise(0.0)
    return resampling.block_boot(series, "rel_day", "gap", weight)


# --- staggered adoption -------------------------------------------------------------------------------------------

QUARTERS = 27
STAGGERED = f"""ord AS (SELECT o_custkey AS creator, (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS q, o_orderstatus AS st FROM orders),
adopt AS (SELECT creator, min(CASE WHEN st = 'P' THEN q END) AS g FROM ord GROUP BY 1), cnt AS (SELECT creator, q, count(*) AS n FROM ord GROUP BY 1, 2),
pan AS (SELECT a.creator, d.q, ln(1 + coalesce(n, 0)) AS y, g FROM adopt a CROSS JOIN (SELECT unnest(generate_series(0, {QUARTERS - 1})) AS q) d LEFT JOIN cnt c ON c.creator = a.creator AND c.q = d.q),
pr AS (SELECT t.creator, t.g, t.q AS t, t.y - b.y AS dy, 1 AS side FROM pan t JOIN pan b ON b.creator = t.creator AND b.q = t.g - 1 WHERE t.q >= t.g
  UNION ALL SELECT t.creator, k.g, t.q, t.y - b.y, 0 FROM (SELECT DISTINCT g FROM adopt WHERE g IS NOT NULL) k JOIN pan b ON b.g IS NULL AND b.q = k.g - 1 JOIN pan t ON t.creator = b.creator AND t.q >= k.g),
cells AS (SELECT g, t, avg(CASE WHEN side = 1 THEN dy END) AS m1, avg(CASE WHEN side = 0 THEN dy END) AS m0, count(CASE WHEN side = 1 THEN 1 END) AS n1, count(CASE WHEN side = 0 THEN 1 END) AS n0,
  any_value(r.n) AS registered FROM pr JOIN (SELECT g, count(*) AS n FROM adopt WHERE g IS NOT NULL GROUP BY 1) r USING (g) GROUP BY 1, 2 HAVING count(CASE WHEN side = 1 THEN 1 END) > 0 AND count(CASE WHEN side = 0 THEN 1 END) > 0),
phi AS (SELECT creator, sum(registered / (SELECT sum(registered) FROM cells) * CASE WHEN side = 1 THEN (dy - m1) / n1 ELSE -(dy - m0) / n0 END) AS phi FROM pr JOIN cells USING (g, t) GROUP BY 1),
att AS (SELECT sum(registered * (m1 - m0)) / sum(registered) AS estimate FROM cells)"""


def adoption_panel(t: Tables) -> DataFrame:
    orders = t.orders.select(
        F.col("o_custkey").alias("creator"), ((F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate") - 1).alias("q"), F.col("o_orderstatus").alias("st")
    )
    adopted = orders.groupBy("creator").agg(F.min(F.when(F.col("st") == "P", F.col("q"))).alias("g"))
    counts = orders.groupBy("creator", "q").agg(F.count("*").alias("n"))
    grid = adopted.select("creator", "g", F.explode(F.sequence(F.lit(0), F.lit(QUARTERS - 1))).alias("q"))
    return grid.join(counts, ["creator", "q"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("y", F.log1p("n"))


@query("group_time_cells", f"WITH {STAGGERED} SELECT g, t, m1, m0, n1, n0, registered, m1 - m0 AS att FROM cells", "m1 m0 att")
def group_time_cells(t: Tables) -> DataFrame:
    return staggered.group_time_cells(adoption_panel(t), "creator", "q", "y", "g")[0]


@query("group_time_att", f"WITH {STAGGERED} SELECT (SELECT estimate FROM att) AS estimate, (SELECT count(*) FROM cells) AS n_supported, (SELECT sqrt(sum(phi * phi)) FROM phi) AS std_error", "estimate std_error")
def group_time_att(t: Tables) -> DataFrame:
    return staggered.group_time_att(adoption_panel(t), "creator", "q", "y", "g")


@query("multiplier_bootstrap", f"""WITH {STAGGERED}, d AS (SELECT draw, (SELECT estimate FROM att) + sum(CASE WHEN {uniform_sql("'sign'", 'draw', 'creator')} < 0.5 THEN -phi ELSE phi END) AS x FROM phi, (SELECT unnest(generate_series(1, 99)) AS draw) GROUP BY 1)
  SELECT count(*) AS draws, stddev_samp(x) AS boot_se, quantile_cont(x, 0.025) AS ci95_low, quantile_cont(x, 0.975) AS ci95_high FROM d""", "boot_se ci95_low ci95_high")
def multiplier_bootstrap(t: Tables) -> DataFrame:
    cells, pairs = staggered.group_time_cells(adoption_panel(t), "creator", "q", "y", "g")
    estimate = cells.agg(F.sum(F.col("registered") * F.col("att")) / F.sum("registered")).scalar()
    return resampling.multiplier_boot(staggered.influence_values(cells, pairs, "creator"), "creator", "phi", estimate, 99)


@query("twfe_clustered")
def twfe_clustered(t: Tables) -> DataFrame:
    rows = adoption_panel(t).withColumn("d", F.coalesce((F.col("q") >= F.col("g")).cast("int"), F.lit(0)))
    # quarters before the creator's first order are unobserved
    seen = t.orders.groupBy(F.col("o_custkey").alias("creator")).agg(F.min((F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate") - 1).alias("start"))
    return clusters.twfe_cluster(rows.join(seen, "creator").where("q >= start"), "creator", "q", d="d")


@query("twfe_clustered_balanced", f"""WITH {STAGGERED}, x AS (SELECT creator, q, y, CASE WHEN q >= g THEN 1 ELSE 0 END AS d FROM pan),
  w AS (SELECT creator, y - avg(y) OVER (PARTITION BY creator) - avg(y) OVER (PARTITION BY q) + avg(y) OVER () AS yt, d - avg(d) OVER (PARTITION BY creator) - avg(d) OVER (PARTITION BY q) + avg(d) OVER () AS dt, max(d) OVER (PARTITION BY creator) AS tr FROM x),
  b AS (SELECT sum(dt * yt) / sum(dt * dt) AS beta, sum(dt * dt) AS dd, count(*) AS n, sum(CASE WHEN dt < 0 AND tr = 1 THEN dt ELSE 0 END) AS neg FROM w),
  s AS (SELECT creator, sum(dt * (yt - beta * dt)) AS sc FROM w, b GROUP BY 1)
  SELECT any_value(beta) AS estimate, sqrt(count(*) / (count(*) - 1) * sum(sc * sc)) / any_value(dd) AS std_error, any_value(n) AS n_obs, count(*) AS clusters, any_value(neg) / any_value(dd) AS negative_weight_treated FROM s, b""",
       "estimate std_error negative_weight_treated")
def twfe_clustered_balanced(t: Tables) -> DataFrame:
    rows = adoption_panel(t).withColumn("d", F.coalesce((F.col("q") >= F.col("g")).cast("int"), F.lit(0)))
    return clusters.twfe_cluster(rows, "creator", "q", d="d")


@query("hurdle_profile", f"""WITH {STAGGERED}, c AS (SELECT a.creator, d.q, coalesce(n, 0) AS n FROM adopt a CROSS JOIN (SELECT unnest(generate_series(0, {QUARTERS - 1})) AS q) d LEFT JOIN cnt x ON x.creator = a.creator AND x.q = d.q),
  bc AS (SELECT creator, avg(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM c GROUP BY 1), bd AS (SELECT q, avg(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END) AS p, avg(CASE WHEN n > 0 THEN n END) AS mu FROM c GROUP BY 1)
  SELECT 'log_count' AS layer, 'sd' AS statistic, stddev_samp(ln(1 + n)) AS value FROM c UNION ALL SELECT 'log_count', 'mean', avg(ln(1 + n)) FROM c UNION ALL SELECT 'log_count', 'active_share', avg(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0 END) FROM c
  UNION ALL SELECT 'activity', 'q0', min(p) FROM bc UNION ALL SELECT 'activity', 'q25', quantile_cont(p, 0.25) FROM bc UNION ALL SELECT 'activity', 'q50', median(p) FROM bc UNION ALL SELECT 'activity', 'q75', quantile_cont(p, 0.75) FROM bc UNION ALL SELECT 'activity', 'q100', max(p) FROM bc
  UNION ALL SELECT 'activity', 'day_multiplier_min', min(p) / avg(p) FROM bd UNION ALL SELECT 'activity', 'day_multiplier_max', max(p) / avg(p) FROM bd
  UNION ALL SELECT 'count_given_active', 'mean', avg(n) FROM c WHERE n > 0 UNION ALL SELECT 'count_given_active', 'sd', stddev_samp(n) FROM c WHERE n > 0
  UNION ALL SELECT 'count_given_active', 'q0', min(n) FROM c WHERE n > 0 UNION ALL SELECT 'count_given_active', 'q50', median(n) FROM c WHERE n > 0 UNION ALL SELECT 'count_given_active', 'q90', quantile_cont(n, 0.9) FROM c WHERE n > 0
  UNION ALL SELECT 'count_given_active', 'q99', quantile_cont(n, 0.99) FROM c WHERE n > 0 UNION ALL SELECT 'count_given_active', 'q100', max(n) FROM c WHERE n > 0
  UNION ALL SELECT 'count_given_active', 'day_multiplier_min', min(mu) / avg(mu) FROM bd WHERE mu IS NOT NULL UNION ALL SELECT 'count_given_active', 'day_multiplier_max', max(mu) / avg(mu) FROM bd WHERE mu IS NOT NULL""", "value")
def hurdle_profile(t: Tables) -> DataFrame:
    return staggered.hurdle_profile(adoption_panel(t).select("creator", "q", "n"), "creator", "q")


@query("rate_quintiles", """WITH r AS (SELECT o_custkey AS c, count(*) / 2555.0::DOUBLE AS rate FROM orders GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY rate, c) AS k, count(*) OVER () AS n FROM r),
  b AS (SELECT CAST(greatest(0, ((k - 1) * 5 + n - 2) // (n - 1) - 1) AS INT) AS quintile, rate FROM i) SELECT quintile, count(*) AS creators, avg(rate) AS mean_rate, min(rate) AS min_rate, max(rate) AS max_rate FROM b GROUP BY 1""",
       "mean_rate min_rate max_rate", digits=9)
def rate_quintiles(t: Tables) -> DataFrame:
    return staggered.rate_quintiles(t.orders.select(F.col("o_custkey").alias("creator")), "creator", 2555)


# --- matched designs ----------------------------------------------------------------------------------------------

DESIGN = """big AS (SELECT o_custkey, count(*) AS n, max(CASE WHEN o_totalprice > 480000 THEN 1 ELSE 0 END) AS hit, max(CASE WHEN o_totalprice > 450000 THEN 1 ELSE 0 END) AS hit_low, max(CASE WHEN o_totalprice > 495000 THEN 1 ELSE 0 END) AS hit_high FROM orders GROUP BY 1),
idx AS (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER () AS tot FROM customer),
design AS (SELECT c_custkey AS mint, c_nationkey AS nation, c_acctbal AS bal, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS treated, CAST(greatest(0, ((r - 1) * 10 + tot - 2) // (tot - 1) - 1) AS INT) AS decile,
  coalesce(n, 0) AS n_orders, coalesce(hit, 0) AS outcome, coalesce(hit_low, 0) AS early, coalesce(hit_high, 0) AS late FROM idx LEFT JOIN big ON o_custkey = c_custkey)"""


def design(t: Tables) -> DataFrame:
    big = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), *[F.max((F.col("o_totalprice") > v).cast("int")).alias(c) for c, v in (("hit", 480000), ("hit_low", 450000), ("hit_high", 495000))])
    binned = reshape.rank_bins(t.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), "c_acctbal", 10, "c_custkey", "decile")
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0)).alias(name)
    return binned.join(big, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("c_custkey").alias("mint"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("treated"),
        "decile", zero("n", "n_orders"), zero("hit", "outcome"), zero("hit_low", "early"), zero("hit_high", "late"),
    )


CELL = ["nation", "decile"]
MATCHED = f"""{DESIGN}, cells AS (SELECT nation, decile, count(CASE WHEN treated = 1 THEN outcome END) AS treated_n, sum(CASE WHEN treated = 1 THEN outcome END)::DOUBLE AS treated_sum, count(CASE WHEN treated = 0 THEN outcome END) AS control_n,
  avg(CASE WHEN treated = 0 THEN outcome END) AS control_mean FROM design GROUP BY 1, 2 HAVING count(CASE WHEN treated = 1 THEN outcome END) > 0 AND count(CASE WHEN treated = 0 THEN outcome END) > 0)"""


@query("matched_cells", f"WITH {MATCHED} SELECT *, treated_sum / treated_n AS treated_mean, treated_sum / treated_n - control_mean AS att_cell FROM cells", "treated_sum control_mean treated_mean att_cell")
def matched_cells(t: Tables) -> DataFrame:
    return matching.matched_cells(design(t), "treated", CELL, "outcome")


def cluster_sql(source: str, order: str, numerator: str, denominator: str, salt: str, draws: int) -> str:
    return f"""cu AS (SELECT {order} AS o, {numerator} AS num, {denominator} AS den, row_number() OVER (ORDER BY {order}) - 1 AS pos, count(*) OVER () AS n FROM {source}),
cs AS (SELECT draw, CAST(floor({uniform_sql(f"'{salt}'", 'draw', 'pos')} * n) AS BIGINT) AS pos FROM cu, (SELECT unnest(generate_series(1, {draws})) AS draw)),
cd AS (SELECT draw, sum(num) / sum(den) AS x FROM cs JOIN cu USING (pos) GROUP BY 1),
cb AS (SELECT count(*) AS draws, stddev_samp(x) AS boot_se, quantile_cont(x, 0.025) AS ci95_low, quantile_cont(x, 0.975) AS ci95_high FROM cd)"""


@query("matched_att", f"""WITH {MATCHED}, dy AS (SELECT nation, sum(treated_n * (treated_sum / treated_n - control_mean)) AS diff, sum(treated_n) AS m FROM cells GROUP BY 1), {cluster_sql('dy', 'nation', 'diff', 'm', 'att', 200)},
  pt AS (SELECT CAST(sum(treated_n) AS BIGINT) AS n_treated, CAST(sum(control_n) AS BIGINT) AS n_control, sum(treated_sum) / sum(treated_n) AS treated_value, sum(treated_n * control_mean) / sum(treated_n) AS control_value FROM cells)
  SELECT n_treated, n_control, treated_value, control_value, treated_value - control_value AS effect, n_treated / (SELECT count(*) FROM design WHERE treated = 1) AS support_share, (SELECT count(*) FROM dy) AS clusters, boot_se, ci95_low, ci95_high,
    treated_value / nullif(control_value, 0) AS risk_ratio, CASE WHEN treated_value > control_value THEN treated_value / control_value + sqrt(treated_value / control_value * (treated_value / control_value - 1)) END AS e_value FROM pt, cb""",
       "treated_value control_value effect support_share boot_se ci95_low ci95_high risk_ratio e_value")
def matched_att(t: Tables) -> DataFrame:
    return matching.matched_att(design(t), "treated", CELL, "outcome", "nation")


@query("cell_match_rows", f"""WITH {DESIGN}, k AS (SELECT nation, decile, count(*) AS control_n, avg(outcome) AS control_outcome_mean, count(outcome) AS control_outcome_n FROM design WHERE treated = 0 GROUP BY 1, 2)
  SELECT mint, nation, decile, outcome, control_n, control_outcome_mean, control_outcome_n FROM design JOIN k USING (nation, decile) WHERE treated = 1""", "control_outcome_mean")
def cell_match_rows(t: Tables) -> DataFrame:
    rows = joins.cell_match(design(t), "treated", CELL, ["outcome"])
    return rows.select("mint", "nation", "decile", "outcome", "control_n", "control_outcome_mean", "control_outcome_n")


def _moments_sql(sample: str, weight: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{sample}' AS sample, '{v}' AS variable, treated, CAST({v} AS DOUBLE) AS x, {weight} AS w FROM dw" for v in ("bal", "n_orders", "decile"))


@query("covariate_balance", f"""WITH {DESIGN}, k AS (SELECT nation, decile, count(CASE WHEN treated = 1 THEN 1 END) AS t, count(CASE WHEN treated = 0 THEN 1 END) AS c FROM design GROUP BY 1, 2),
  dw AS (SELECT design.*, CASE WHEN treated = 1 THEN CASE WHEN c > 0 THEN 1.0::DOUBLE ELSE 0 END ELSE t / CAST(nullif(c, 0) AS DOUBLE) END AS mw FROM design JOIN k USING (nation, decile)),
  l AS ({_moments_sql('full', '1.0::DOUBLE')} UNION ALL {_moments_sql('matched', 'mw')}), s AS (SELECT sample, variable, treated, count(*) AS n, sum(w * x) / sum(w) AS m, sum(w * x * x) / sum(w) - power(sum(w * x) / sum(w), 2) AS v FROM l WHERE w > 0 GROUP BY 1, 2, 3)
  SELECT sample, variable, max(CASE WHEN treated = 1 THEN m END) AS treated_mean, max(CASE WHEN treated = 0 THEN m END) AS control_mean, max(CASE WHEN treated = 1 THEN n END) AS treated_n, max(CASE WHEN treated = 0 THEN n END) AS control_n,
    (max(CASE WHEN treated = 1 THEN m END) - max(CASE WHEN treated = 0 THEN m END)) / sqrt((max(CASE WHEN treated = 1 THEN v END) + max(CASE WHEN treated = 0 THEN v END)) / 2) AS smd FROM s GROUP BY 1, 2""", "treated_mean control_mean smd")
def covariate_balance(t: Tables) -> DataFrame:
    return matching.balance(design(t), "treated", CELL, ["bal", "n_orders", "decile"])


@query("timing_checks", f"""WITH {DESIGN}, l AS (SELECT nation, decile, treated, 'early' AS outcome, early AS v FROM design UNION ALL SELECT nation, decile, treated, 'late', late FROM design UNION ALL SELECT nation, decile, treated, 'n_orders', n_orders FROM design),
  c AS (SELECT nation, decile, outcome, count(CASE WHEN treated = 1 THEN v END) AS tn, sum(CASE WHEN treated = 1 THEN v END) AS ts, avg(CASE WHEN treated = 0 THEN v END) AS cm FROM l GROUP BY 1, 2, 3 HAVING count(CASE WHEN treated = 1 THEN v END) > 0 AND count(CASE WHEN treated = 0 THEN v END) > 0),
  r AS (SELECT outcome, CAST(sum(tn) AS BIGINT) AS n_treated, sum(ts) / sum(tn) AS treated_value, sum(tn * cm) / sum(tn) AS control_value FROM c GROUP BY 1), e AS (SELECT *, treated_value - control_value AS effect FROM r)
  SELECT *, (SELECT effect FROM e WHERE outcome = 'early') > greatest(0.0005, abs((SELECT effect FROM e WHERE outcome = 'late')) * 0.25) AS immediate_association FROM e""", "treated_value control_value effect")
def timing_checks(t: Tables) -> DataFrame:
    return matching.timing_checks(design(t), "treated", CELL, ["early", "late", "n_orders"], "early", "late")


@query("risk_ratios", f"""WITH {DESIGN}, r AS (SELECT nation, avg(CASE WHEN treated = 1 THEN outcome END) AS treated_rate, avg(CASE WHEN treated = 0 THEN outcome END) AS control_rate FROM design GROUP BY 1)
  SELECT nation, treated_rate, control_rate, treated_rate / nullif(control_rate, 0) AS risk_ratio, CASE WHEN treated_rate > control_rate AND control_rate > 0 THEN treated_rate / control_rate + sqrt(treated_rate / control_rate * (treated_rate / control_rate - 1)) END AS e_value FROM r""",
       "treated_rate control_rate risk_ratio e_value", digits=9)
def risk_ratios(t: Tables) -> DataFrame:
    return matching.risk_ratio_by(design(t), ["nation"], "treated", "outcome")


WILSON = """s AS (SELECT o_orderpriority AS grp, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS successes, count(*) AS n FROM orders GROUP BY 1)"""


@query("proportion_intervals", f"""WITH {WILSON} SELECT grp, successes, n, successes / n AS share,
  (successes / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((successes / n * (1 - successes / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n) AS ci95_low,
  (successes / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt((successes / n * (1 - successes / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n) AS ci95_high FROM s""", "share ci95_low ci95_high")
def proportion_intervals(t: Tables) -> DataFrame:
    return matching.proportion_by(t.orders.withColumn("grp", F.col("o_orderpriority")), ["grp"], F.col("o_orderstatus") == "F")


@query("binomial_tails", """WITH s AS (SELECT c_nationkey AS grp, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS successes, count(*) AS n FROM customer GROUP BY 1)
  SELECT grp, any_value(successes) AS successes, any_value(n) AS n, sum(exp(lgamma(n + 1.0) - lgamma(x + 1.0) - lgamma(n - x + 1.0) + x * ln(0.9::DOUBLE) + (n - x) * ln(0.1::DOUBLE))) AS p_value
  FROM (SELECT s.*, unnest(generate_series(successes, n)) AS x FROM s) GROUP BY grp""", "p_value", digits=8)
def binomial_tails(t: Tables) -> DataFrame:
    return matching.binom_tail_by(t.customer.withColumn("grp", F.col("c_nationkey")), ["grp"], F.col("c_acctbal") > 0)


SHOCKS = (("first", "1996-03-01 00:00:00", "1996-03-14 12:00:00"), ("second", "1998-10-01 06:00:00", "1998-10-20 00:00:00"), ("third", "2002-01-01 00:00:00", "2002-01-03 00:00:00"))


@query("shock_windows", f"""WITH sh(shock_id, s, e) AS (VALUES {', '.join(f"('{i}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for i, a, b in SHOCKS)}),
  x AS (SELECT shock_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS f, CASE WHEN o_orderdate BETWEEN s AND e THEN 1 ELSE 0 END AS d, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders JOIN sh ON o_orderdate BETWEEN s - INTERVAL 240 HOUR AND e + INTERVAL 240 HOUR),
  c AS (SELECT shock_id, {', '.join(f"count(CASE WHEN f = {f} AND d = {d} THEN 1 END) AS n_{a}_{b}, sum(CASE WHEN f = {f} AND d = {d} THEN y END) AS y_{a}_{b}" for f, a in ((1, 'flag'), (0, 'plain')) for d, b in ((1, 'during'), (0, 'adjacent')))} FROM x GROUP BY 1)
  SELECT shock_id, n_flag_during, n_flag_adjacent, n_plain_during, n_plain_adjacent, least(n_flag_during, n_flag_adjacent, n_plain_during, n_plain_adjacent) >= 50 AS supported,
    y_flag_during / nullif(n_flag_during, 0) AS rate_flag_during, y_flag_adjacent / nullif(n_flag_adjacent, 0) AS rate_flag_adjacent, y_plain_during / nullif(n_plain_during, 0) AS rate_plain_during, y_plain_adjacent / nullif(n_plain_adjacent, 0) AS rate_plain_adjacent,
    (y_flag_during / nullif(n_flag_during, 0) - y_flag_adjacent / nullif(n_flag_adjacent, 0)) - (y_plain_during / nullif(n_plain_during, 0) - y_plain_adjacent / nullif(n_plain_adjacent, 0)) AS did FROM c""",
       "rate_flag_during rate_flag_adjacent rate_plain_during rate_plain_adjacent did")
def shock_windows(t: Tables) -> DataFrame:
    shocks = t.spark.createDataFrame(SHOCKS, "shock_id string, s string, e string").select("shock_id", F.col("s").cast("timestamp_ntz").alias("start"), F.col("e").cast("timestamp_ntz").alias("end"))
    tokens = t.orders.select("o_orderdate", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("flag"), (F.col("o_orderstatus") == "F").cast("int").alias("hit"))
    table = matching.shock_table(tokens, "o_orderdate", "flag", "hit", shocks, 240)
    return matching.shock_support(table).join(matching.shock_did(table), "shock_id")


PAIRED = """ord AS (SELECT c_nationkey AS nation, o_orderkey AS k, o_totalprice AS price, CASE WHEN c_mktsegment = 'BUILDING' THEN 'treated' ELSE 'control' END AS side, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment = 'BUILDING' ORDER BY o_orderkey) AS seq
  FROM orders JOIN customer ON c_custkey = o_custkey),
prs AS (SELECT nation * 1000000 + seq AS pair, nation, max(CASE WHEN side = 'treated' THEN price END) AS t, max(CASE WHEN side = 'control' THEN price END) AS c FROM ord GROUP BY 1, 2),
df AS (SELECT *, t - c AS diff FROM prs WHERE t IS NOT NULL AND c IS NOT NULL)"""


def paired_orders(t: Tables) -> DataFrame:
    from tidemark.operators.ranking import global_index

    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_nationkey").alias("nation"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.when(F.col("c_mktsegment") == "BUILDING", "treated").otherwise("control").alias("side"))
    indexed = global_index(rows, "k", "k", keys=["nation", "side"], name="seq")
    return indexed.withColumn("pair", F.col("nation").cast("bigint") * 1000000 + F.col("seq"))


@query("pair_diagnostics", f"""WITH {PAIRED}, dr AS (SELECT nation, draw, sum(w * diff) / sum(w) AS x FROM (SELECT nation, draw, diff, {poisson_sql(uniform_sql("'pair'", 'draw', 'pair'))} AS w FROM df, (SELECT unnest(generate_series(1, 40)) AS draw)) GROUP BY 1, 2),
  b AS (SELECT nation, quantile_cont(x, 0.025) AS ci95_low, quantile_cont(x, 0.975) AS ci95_high FROM dr GROUP BY 1)
  SELECT nation, 'price' AS metric, count(*) AS pairs, avg(t) AS treated_mean, avg(c) AS control_mean, avg(diff) AS mean_difference, avg(CASE WHEN diff > 0 THEN 1.0 ELSE 0.0 END) AS positive_share, median(diff) AS median_difference,
    any_value(ci95_low) AS ci95_low, any_value(ci95_high) AS ci95_high FROM df JOIN b USING (nation) GROUP BY 1""", "treated_mean control_mean mean_difference positive_share median_difference ci95_low ci95_high", digits=4)
def pair_diagnostics(t: Tables) -> DataFrame:
    return matching.pair_diagnostics(paired_orders(t), "pair", "side", ["nation"], ["price"], 40)


@query("bootstrap_mean", f"""WITH dr AS (SELECT o_orderpriority AS grp, draw, sum(w * o_totalprice) / sum(w) AS x FROM (SELECT o_orderpriority, draw, o_totalprice, {poisson_sql(uniform_sql("'mean'", 'draw', 'o_orderkey'))} AS w FROM orders, (SELECT unnest(generate_series(1, 40)) AS draw)) GROUP BY 1, 2)
  SELECT grp, (SELECT count(*) FROM orders WHERE o_orderpriority = grp) AS n, (SELECT avg(o_totalprice) FROM orders WHERE o_orderpriority = grp) AS mean, count(*) AS draws, stddev_samp(x) AS boot_se, quantile_cont(x, 0.025) AS ci95_low, quantile_cont(x, 0.975) AS ci95_high FROM dr GROUP BY 1""",
       "mean boot_se ci95_low ci95_high", digits=4)
def bootstrap_mean(t: Tables) -> DataFrame:
    return resampling.boot_mean(t.orders.withColumn("grp", F.col("o_orderpriority")), ["grp"], "o_totalprice", "o_orderkey", 40)


@query("bootstrap_median", f"""WITH w AS (SELECT user_id AS grp, draw, value, {poisson_sql(uniform_sql("'median'", 'draw', 'event_id'))} AS w FROM events, (SELECT unnest(generate_series(1, 20)) AS draw)),
  e AS (SELECT grp, draw, value, unnest(generate_series(1, w)) AS c FROM w WHERE w > 0), dr AS (SELECT grp, draw, median(value) AS x FROM e GROUP BY 1, 2)
  SELECT grp, (SELECT median(value) FROM events WHERE user_id = grp) AS median, count(*) AS draws, stddev_samp(x) AS boot_se, quantile_cont(x, 0.025) AS ci95_low, quantile_cont(x, 0.975) AS ci95_high FROM dr GROUP BY 1""", "median boot_se ci95_low ci95_high")
def bootstrap_median(t: Tables) -> DataFrame:
    return resampling.boot_median(t.events.withColumn("grp", F.col("user_id")), ["grp"], "value", "event_id", 20)


@query("cluster_bootstrap", f"""WITH dy AS (SELECT date_diff('day', DATE '1970-01-01', o_orderdate) AS d, sum(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS a, count(*) AS b FROM orders GROUP BY 1), {cluster_sql('dy', 'd', 'a', 'b', 'cluster', 100)}
  SELECT (SELECT sum(a) / sum(b) FROM dy) AS estimate, (SELECT count(*) FROM dy) AS clusters, boot_se, ci95_low, ci95_high FROM cb""", "estimate boot_se ci95_low ci95_high", digits=8)
def cluster_bootstrap(t: Tables) -> DataFrame:
    days = t.orders.groupBy(F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).alias("d")).agg(F.sum((F.col("o_orderstatus") == "F").cast("double")).alias("a"), F.count("*").alias("b"))
    return resampling.cluster_boot(days, "d", "a", "b", 100)


@query("selection_audit", """WITH d AS (SELECT doc_id, n_chars, len(string_split(text, ' ')) AS words, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 0 END AS covered FROM documents),
  l AS (SELECT covered, 'n_chars' AS metric, CAST(n_chars AS DOUBLE) AS v FROM d UNION ALL SELECT covered, 'words', words FROM d UNION ALL SELECT covered, 'log_chars', ln(1 + n_chars) FROM d),
  s AS (SELECT metric, count(CASE WHEN covered = 1 THEN 1 END) AS covered_n, count(CASE WHEN covered = 0 THEN 1 END) AS uncovered_n, CASE WHEN metric = 'log_chars' THEN avg(CASE WHEN covered = 1 THEN v END) ELSE median(CASE WHEN covered = 1 THEN v END) END AS covered_value,
    CASE WHEN metric = 'log_chars' THEN avg(CASE WHEN covered = 0 THEN v END) ELSE median(CASE WHEN covered = 0 THEN v END) END AS uncovered_value, stddev_samp(v) AS sd FROM l GROUP BY 1)
  SELECT metric, covered_n, uncovered_n, covered_value, uncovered_value, covered_value - uncovered_value AS difference, (covered_value - uncovered_value) / sd AS smd, coalesce(abs((covered_value - uncovered_value) / sd) >= 0.25, false) AS material FROM s""",
       "covered_value uncovered_value difference smd")
def selection_audit(t: Tables) -> DataFrame:
    from tidemark.operators.sets import covered_flag

    docs = covered_flag(t.documents, t.labels, "doc_id").withColumn("words", F.size(F.split("text", " "))).withColumn("log_chars", F.log1p("n_chars"))
    return matching.selection_audit(docs, "covered", {"n_chars": "median", "words": "median", "log_chars": "mean"})


@query("mechanism_audit", f"""WITH a AS ({POST_EVENT}), x AS (SELECT *, active_traders > 20 AS done, date_diff('microsecond', graduated_at, first_trade_at) / 1e6 AS lag FROM a WHERE horizon_days = 30),
  s AS (SELECT count(*) AS tokens, count(CASE WHEN swap_count > 0 THEN 1 END) AS active_tokens, count(CASE WHEN done THEN 1 END) AS complete_tokens, count(CASE WHEN done AND swap_count > 0 THEN 1 END) AS complete_active, count(CASE WHEN done AND lag < 0 THEN 1 END) AS order_violations,
    avg(CASE WHEN done THEN reactivated_after_7d END) AS reactivation_rate, quantile_cont(CASE WHEN done THEN swap_count END, 0.25) AS p25_swaps, quantile_cont(CASE WHEN done THEN swap_count END, 0.5) AS median_swaps, quantile_cont(CASE WHEN done THEN swap_count END, 0.75) AS p75_swaps,
    median(CASE WHEN done THEN lag END) AS median_lag_seconds FROM x),
  r AS (SELECT *, active_tokens / tokens AS full_share, complete_active / nullif(complete_tokens, 0) AS complete_share FROM s),
  q AS (SELECT *, (full_share + 1.96 * 1.96 / (2 * tokens) - 1.96 * sqrt((full_share * (1 - full_share) + 1.96 * 1.96 / (4 * tokens)) / tokens)) / (1 + 1.96 * 1.96 / tokens) AS full_ci95_low,
    (complete_share + 1.96 * 1.96 / (2 * complete_tokens) - 1.96 * sqrt((complete_share * (1 - complete_share) + 1.96 * 1.96 / (4 * complete_tokens)) / complete_tokens)) / (1 + 1.96 * 1.96 / complete_tokens) AS complete_ci95_low FROM r)
  SELECT *, full_ci95_low > 0.9 AND complete_ci95_low > 0.9 AND order_violations = 0 AND complete_tokens >= 50 AS mechanism_pass FROM q""",
       "reactivation_rate p25_swaps median_swaps p75_swaps median_lag_seconds full_share complete_share full_ci95_low complete_ci95_low")
def mechanism_audit(t: Tables) -> DataFrame:
    rows = market.post_event_activity(roles.tokens(t), roles.trades(t)).withColumn("window_status", F.when(F.col("active_traders") > 20, "ok").otherwise("page_limit_reached_lower_bound"))
    return matching.mechanism_audit(rows, "graduated_at", 50)


@query("frequency_sensitivity", f"""WITH RECURSIVE {roles.PANEL}, m AS (SELECT unit, strftime(date_trunc('month', day), '%Y-%m-%d') AS period, 'monthly' AS layer, ln(1 + sum(volume)) AS y, max(treated) AS treated, CASE WHEN date_trunc('month', day) >= DATE '{EVENT}' THEN 1 ELSE 0 END AS post FROM regional GROUP BY ALL),
  wk AS (SELECT unit, strftime(date_trunc('week', day), '%Y-%m-%d') AS period, 'weekly' AS layer, ln(1 + sum(volume)) AS y, max(treated) AS treated, CASE WHEN date_trunc('week', day) >= DATE '{EVENT}' THEN 1 ELSE 0 END AS post FROM regional GROUP BY ALL),
  r AS (SELECT * FROM m UNION ALL SELECT * FROM wk), p AS (SELECT *, treated * post AS did FROM r), {swept_sql("w", "p", "y AS yt, did::DOUBLE AS dt", "layer", "unit", "period")},
  b AS (SELECT layer, sum(dt * yt) / sum(dt * dt) AS estimate, sum(dt * dt) AS dd, count(*) AS n, count(DISTINCT unit) AS u, count(DISTINCT period) AS t FROM w GROUP BY 1),
  s AS (SELECT layer, any_value(estimate) AS estimate, sqrt(sum(dt * dt * power(yt - estimate * dt, 2)) * any_value(n) / (any_value(n) - any_value(u) - any_value(t))) / any_value(dd) AS std_error, any_value(n) AS n_rows, any_value(u) AS n_units, any_value(t) AS n_periods FROM w JOIN b USING (layer) GROUP BY 1)
  SELECT *, {ci_sql()} FROM s""", CI)
def frequency_sensitivity(t: Tables) -> DataFrame:
    days = roles.regional_days(t)
    monthly = days.groupBy("unit", F.trunc("day", "month").alias("week")).agg(F.sum("volume").alias("volume"), F.max("treated").alias("treated")).withColumn("y", F.log1p("volume"))
    weekly = aggregates.weekly_panel(days, "unit", "day", "volume", "treated").withColumnsRenamed({"week_start": "week", "log_volume": "y"})
    layers = {name: panel.event_clock(df, "week", EVENT) for name, df in (("monthly", monthly), ("weekly", weekly))}
    return panel.frequency_sensitivity(layers, "unit", "week")


# --- replicate tables: each brand is an arm, each order a replicate ---------------------------------------------------

REPS = """rep AS (SELECT l_returnflag AS arm, l_linestatus AS method, l_orderkey * 10 + l_linenumber AS rid, round(avg(l_discount) - 0.05, 6) AS estimate, round(avg(l_discount) - 0.05 - 0.01 * avg(l_quantity) / 25, 6) AS ci_low,
  round(avg(l_discount) - 0.05 + 0.01 * avg(l_quantity) / 25, 6) AS ci_high, CASE WHEN l_returnflag = 'A' THEN 0.0::DOUBLE ELSE 0.01::DOUBLE END AS truth, round(avg(l_tax), 2) AS p FROM lineitem GROUP BY ALL)"""


def replicate_rows(t: Tables) -> DataFrame:
    base = t.lineitem.groupBy(F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("method"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rid")).agg(
        F.avg("l_discount").alias("m"), F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("x"))
    half = F.lit(0.01) * F.col("q") / 25
    est = F.col("m") - 0.05
    return base.select("arm", "method", "rid", F.round(est, 6).alias("estimate"), F.round(est - half, 6).alias("ci_low"), F.round(est + half, 6).alias("ci_high"),
                       F.when(F.col("arm") == "A", 0.0).otherwise(0.01).alias("truth"), F.round("x", 2).alias("p"))


METRICS = """SELECT arm, method, count(*) AS n_reps, any_value(truth) AS truth, avg(estimate) AS mean_estimate, avg(estimate - truth) AS bias, stddev_samp(estimate) / sqrt(count(*)) AS mcse_bias, sqrt(avg(power(estimate - truth, 2))) AS rmse,
  stddev_samp(estimate) AS sd_estimate, avg(CASE WHEN ci_low <= truth AND truth <= ci_high THEN 1.0 ELSE 0.0 END) AS coverage_95, avg(CASE WHEN truth = 0 THEN CASE WHEN ci_low > 0 THEN 1.0 ELSE 0.0 END END) AS fpr,
  avg(CASE WHEN truth <> 0 THEN CASE WHEN ci_low > 0 THEN 0.0 ELSE 1.0 END END) AS fnr, avg(CASE WHEN truth <> 0 THEN CASE WHEN sign(estimate) = sign(truth) THEN 1.0 ELSE 0.0 END END) AS sign_correctness,
  avg(CASE WHEN truth = 0 THEN CASE WHEN ci_low > 0 THEN 0.0 ELSE 1.0 END ELSE CASE WHEN ci_low > 0 THEN 1.0 ELSE 0.0 END END) AS claim_accuracy, CASE WHEN any_value(truth) <> 0 THEN avg(estimate) / any_value(truth) END AS attenuation FROM rep GROUP BY 1, 2"""


@query("replicate_metrics", f"WITH {REPS}, m AS ({METRICS}) SELECT m.*, b.rmse AS baseline_rmse, m.rmse / b.rmse AS rmse_ratio FROM m LEFT JOIN m b ON b.arm = m.arm AND b.method = 'F'",
       "truth mean_estimate bias mcse_bias rmse sd_estimate coverage_95 fpr fnr sign_correctness claim_accuracy attenuation baseline_rmse rmse_ratio")
def replicate_metrics(t: Tables) -> DataFrame:
    return replicates.with_baseline(replicates.replicate_metrics(replicate_rows(t), ["arm", "method"]), ["arm"], "method", "F")


@query("pvalue_diagnostics", f"WITH {REPS} SELECT arm, count(DISTINCT p) AS distinct_p, count(p) AS n, avg(CASE WHEN p <= 0.05 THEN 1.0 ELSE 0.0 END) AS share_le_05, quantile_cont(p, 0.05) AS p05, median(p) AS p50, quantile_cont(p, 0.95) AS p95 FROM rep GROUP BY 1",
       "share_le_05 p05 p50 p95")
def pvalue_diagnostics(t: Tables) -> DataFrame:
    return replicates.pvalue_diag(replicate_rows(t), ["arm"], "p")


@query("decision_disagreement", f"""WITH {REPS}, w AS (SELECT arm, rid, max(CASE WHEN method = 'F' THEN (ci_low > 0)::INT END) AS f, max(CASE WHEN method = 'O' THEN (ci_low > 0)::INT END) AS o FROM rep GROUP BY 1, 2)
  SELECT arm, count(*) AS replicates, avg(CASE WHEN least(f, o) <> greatest(f, o) THEN 1.0 ELSE 0.0 END) AS any_disagreement, avg(CASE WHEN o IS NULL OR f IS NULL THEN NULL WHEN o <> f THEN 1.0 ELSE 0.0 END) AS "disagree_O" FROM w GROUP BY 1""", 'any_disagreement "disagree_O"')
def decision_disagreement(t: Tables) -> DataFrame:
    return replicates.disagreement(replicate_rows(t), ["arm"], "rid", "method", ["F", "O"], "F")
