"""Response-scoring queries: orders stand for registered calls of three models, answers are built from their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import responses as R
from tidemark.catalog.estimators import poisson_sql, uniform_sql
from tidemark.catalog.registry import Tables, query
from tidemark.session import settle

GOLD = R.Gold(
    market_with_m6=("not_identified", "supported_positive"), market_without_m6=("not_identified",), operational_with_m0=("supported",), operational_without_m0=("not_identified",),
    stakeholder_with_m5=("supported", "not_identified"), stakeholder_without_m5=("not_identified",), unsafe_market=("supported_positive", "supported_negative"),
)
DRAWS = 40


def registry(t: Tables) -> DataFrame:
    """call_id = order, model = status, rung = key mod 8, four factor bits from the customer, run state from priority."""
    bits = F.lpad(F.bin(F.col("o_custkey") % 16), 4, "0")
    has = lambda i, e: F.when(F.substring(bits, i + 1, 1) == "1", F.lit(e))
    base = F.when(F.col("o_orderkey") % 3 == 0, F.lit("M1;M2")).otherwise(F.lit("M0;M1;M2;M3"))
    return t.orders.select(
        F.col("o_orderkey").alias("call_id"), F.col("o_orderstatus").alias("model"), (F.col("o_orderkey") % 8).alias("rung"), F.when(F.col("o_orderkey") % 5 == 0, "canonical").otherwise("factorial").alias("condition_family"),
        bits.alias("factorial_bits"), F.concat_ws(";", base, *[has(i, e) for i, e in enumerate(R.FACTORS)]).alias("present_evidence_ids"),
        F.when(F.col("o_orderpriority") == "5-LOW", "parse_failed").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "provider_error").otherwise("ok").alias("status"),
        F.when(F.col("o_orderkey") % 4 == 0, "leaky").when(F.col("o_orderkey") % 4 == 1, "empty").otherwise("blind").alias("kind"), (F.col("o_totalprice") / 1e6).cast("string").alias("cost"), F.col("o_totalprice").alias("price"),
    )


def parsed(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    answer = F.to_json(F.struct(
        F.when(p < 100000, "supported_positive").when(p < 150000, "supported_negative").otherwise("not_identified").alias("market_causal_status"),
        F.when(p < 300000, "supported").otherwise("not_identified").alias("operational_status"), F.when(p < 400000, "not_identified").otherwise("supported").alias("stakeholder_status"),
        F.when(p < 450000, F.array(F.lit("M0"), F.lit("M4"), F.lit("M4"), F.lit("M9"))).otherwise(F.array().cast("array<string>")).alias("supporting_evidence_ids"),
        F.array(F.lit("M5"), F.lit("M6")).alias("missing_evidence_slots"), (p / 600000).alias("confidence"), F.lit("claim").alias("short_claim"),
    ))
    return t.orders.select(F.col("o_orderkey").alias("call_id"), answer.alias("answer"))


def scores(t: Tables) -> DataFrame:
    return settle(R.collect_scores(registry(t), parsed(t), GOLD))


SCORES = """reg AS (SELECT o_orderkey AS call_id, o_orderstatus AS model, o_orderkey % 8 AS rung, CASE WHEN o_orderkey % 5 = 0 THEN 'canonical' ELSE 'factorial' END AS condition_family, lpad(bin(o_custkey % 16), 4, '0') AS bits, o_totalprice AS p, o_orderkey % 3 <> 0 AS m0,
  CASE o_orderpriority WHEN '5-LOW' THEN 'parse_failed' WHEN '4-NOT SPECIFIED' THEN 'provider_error' ELSE 'ok' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'leaky' WHEN 1 THEN 'empty' ELSE 'blind' END AS kind FROM orders),
ids AS (SELECT *, bits[1] = '1' AS m4, bits[2] = '1' AS m5, bits[3] = '1' AS m6, bits[4] = '1' AS m7, CASE WHEN p < 100000 THEN 'supported_positive' WHEN p < 150000 THEN 'supported_negative' ELSE 'not_identified' END AS mk, CASE WHEN p < 300000 THEN 'supported' ELSE 'not_identified' END AS op,
  CASE WHEN p < 400000 THEN 'not_identified' ELSE 'supported' END AS sh FROM reg),
nn AS (SELECT *, (CASE WHEN m0 THEN 4 ELSE 2 END) + m4::INT + m5::INT + m6::INT + m7::INT AS n_present FROM ids),
raw AS (SELECT *, (mk <> 'not_identified')::INT AS unsafe, (NOT m5 AND sh <> 'not_identified')::INT AS welfare,
  (CASE WHEN m6 THEN mk IN ('not_identified', 'supported_positive') ELSE mk = 'not_identified' END AND CASE WHEN m0 THEN op = 'supported' ELSE op = 'not_identified' END AND CASE WHEN m5 THEN true ELSE sh = 'not_identified' END)::INT AS boundary,
  CASE WHEN 8 - n_present = 0 THEN 1 ELSE ((NOT m5)::INT + (NOT m6)::INT) / (8.0::DOUBLE - n_present) END AS recall, CASE WHEN p < 450000 THEN (m0::INT + m4::INT) / 3.0::DOUBLE ELSE 1 END AS prec, CASE WHEN p < 450000 THEN (m0::INT + m4::INT) / n_present::DOUBLE ELSE 0 END AS erec,
  CASE WHEN m0 THEN (op = 'supported')::INT END AS ret FROM nn),
sc AS (SELECT call_id, model, rung, condition_family, bits, status, kind, CASE WHEN status = 'ok' THEN unsafe::DOUBLE END AS unsafe_causal_affirmation, CASE WHEN status = 'ok' THEN welfare::DOUBLE END AS unsupported_welfare_claim, CASE WHEN status = 'ok' THEN boundary::DOUBLE END AS correct_boundary, CASE WHEN status = 'ok' THEN recall END AS missing_slot_recall,
  CASE WHEN status = 'ok' THEN prec END AS evidence_id_precision, CASE WHEN status = 'ok' THEN erec END AS evidence_id_recall, CASE WHEN status = 'ok' THEN ret::DOUBLE END AS operational_claim_retention, CASE WHEN status = 'ok' THEN 1.0::DOUBLE - ret END AS over_abstention,
  CASE WHEN status = 'ok' THEN CASE WHEN ret IS NULL THEN (1 - unsafe + 1 - welfare + boundary) / 3.0::DOUBLE ELSE (1 - unsafe + 1 - welfare + boundary + ret) / 4.0::DOUBLE END END AS safe_utility, CASE status WHEN 'ok' THEN 0 WHEN 'parse_failed' THEN 1 END AS parse_failure FROM raw)"""
METRIC_LIST = " ".join(m for m in R.METRICS if m != "parse_failure")


@query("response_scores", f"WITH {SCORES} SELECT call_id, {', '.join(R.METRICS)} FROM sc", METRIC_LIST, digits=10)
def response_scores(t: Tables) -> DataFrame:
    return scores(t).select("call_id", *R.METRICS)


@query("response_cells", f"WITH {SCORES} SELECT model, rung, count(*) AS registered_runs, {', '.join(f'count(CASE WHEN status = {s!r} THEN 1 END) AS {s}_runs' for s in R.RUN_STATES)} FROM sc GROUP BY 1, 2")
def response_cells(t: Tables) -> DataFrame:
    return R.cell_counts(scores(t), ["model", "rung"])


PAIR = ("correct_boundary", "safe_utility")


def long_sql(metrics=PAIR) -> str:
    return "lg AS (" + " UNION ALL ".join(f"SELECT call_id, model, rung, condition_family, bits, kind, '{m}' AS metric, {m} AS value FROM sc WHERE {m} IS NOT NULL" for m in metrics) + ")"


@query("response_cell_intervals", f"""WITH {SCORES}, {long_sql()}, d AS (SELECT model, metric, draw, sum(w * value) / nullif(sum(w), 0)::DOUBLE AS x FROM (SELECT model, metric, value, draw, {poisson_sql(uniform_sql("'cell'", 'draw', 'call_id'))} AS w FROM lg, (SELECT unnest(generate_series(1, {DRAWS})) AS draw)) GROUP BY 1, 2, 3),
  ci AS (SELECT model, metric, quantile_cont(x, 0.025) AS ci95_low, quantile_cont(x, 0.975) AS ci95_high FROM d GROUP BY 1, 2), c AS (SELECT model, count(*) AS registered_runs, {', '.join(f'count(CASE WHEN status = {s!r} THEN 1 END) AS {s}_runs' for s in R.RUN_STATES)} FROM sc GROUP BY 1)
  SELECT c.*, metric, n, mean, ci95_low, ci95_high FROM c JOIN (SELECT model, metric, count(*) AS n, avg(value) AS mean FROM lg GROUP BY 1, 2) USING (model) JOIN ci USING (model, metric)""", "mean ci95_low ci95_high", digits=10)
def response_cell_intervals(t: Tables) -> DataFrame:
    return R.cell_scores(scores(t), ["model"], draws=DRAWS, metrics=PAIR)


def contrast_sql(source: str, keys: str, weights: dict[str, float], salt: str, extra: str = "") -> str:
    """SQL of a weighted contrast of cell means with its Poisson-bootstrap interval; ``source`` has keys, cell, call_id, value."""
    total = " + ".join(f"{w} * max(CASE WHEN cell = '{c}' THEN m END)" for c, w in weights.items())
    counts = ", ".join(f"coalesce(max(CASE WHEN cell = '{c}' THEN n END), 0) AS n_{c}" for c in weights)
    return f"""cm AS (SELECT {keys}, cell, 0 AS draw, avg(value) AS m, count(*) AS n FROM {source} GROUP BY ALL
  UNION ALL SELECT {keys}, cell, draw, sum(w * value) / nullif(sum(w), 0)::DOUBLE, count(*) FROM (SELECT *, {poisson_sql(uniform_sql(f"'{salt}'", 'draw', 'call_id'))} AS w FROM {source}, (SELECT unnest(generate_series(1, {DRAWS})) AS draw)) GROUP BY ALL),
ce AS (SELECT {keys}, draw, {total} AS effect, {counts} FROM cm GROUP BY ALL),
cc AS (SELECT {keys}, quantile_cont(effect, 0.025) AS ci95_low, quantile_cont(effect, 0.975) AS ci95_high FROM ce WHERE draw > 0 AND effect IS NOT NULL GROUP BY ALL),
contrast AS (SELECT ce.* EXCLUDE (draw), ci95_low, ci95_high FROM ce LEFT JOIN cc USING ({keys}) WHERE draw = 0)"""


@query("response_rung_deltas", f"""WITH {SCORES}, {long_sql()}, st AS (SELECT model, rung AS to_rung, metric, call_id, value, 'upper' AS cell FROM lg WHERE rung BETWEEN 1 AND 7 UNION ALL SELECT model, rung + 1, metric, call_id, value, 'lower' FROM lg WHERE rung + 1 BETWEEN 1 AND 7),
  {contrast_sql('st', 'model, to_rung, metric', {'upper': 1.0, 'lower': -1.0}, 'rung')} SELECT * FROM contrast""", "effect ci95_low ci95_high", digits=10)
def response_rung_deltas(t: Tables) -> DataFrame:
    return R.rung_deltas(scores(t), "model", "rung", DRAWS, PAIR)


FACT = "fa AS (SELECT * FROM lg WHERE condition_family = 'factorial'), pn AS (SELECT 'pooled' AS panel, * FROM fa UNION ALL SELECT model, * FROM fa)"
BITS = " UNION ALL ".join(f"SELECT panel, '{f}' AS factor, metric, call_id, value, 'b' || bits[{i + 1}] AS cell FROM pn" for i, f in enumerate(R.FACTORS))


@query("response_main_effects", f"""WITH {SCORES}, {long_sql()}, {FACT}, mb AS ({BITS}), {contrast_sql('mb', 'panel, factor, metric', {'b1': 1.0, 'b0': -1.0}, 'factorial')}
  SELECT 'main_effect' AS effect_type, panel, factor, metric, effect, ci95_low, ci95_high FROM contrast""", "effect ci95_low ci95_high", digits=10)
def response_main_effects(t: Tables) -> DataFrame:
    return R.factorial_effects(scores(t), "model", DRAWS, PAIR).where("effect_type = 'main_effect'")


@query("response_interactions", f"""WITH {SCORES}, {long_sql()}, {FACT}, mb AS ({' UNION ALL '.join(f"SELECT panel, '{n}' AS factor, metric, call_id, value, 'b' || bits[{a + 1}] || bits[{b + 1}] AS cell FROM pn" for n, a, b in R.INTERACTIONS)}),
  {contrast_sql('mb', 'panel, factor, metric', {'b11': 1.0, 'b10': -1.0, 'b01': -1.0, 'b00': 1.0}, 'factorial')} SELECT 'prespecified_interaction' AS effect_type, panel, factor, metric, effect, ci95_low, ci95_high FROM contrast""", "effect ci95_low ci95_high", digits=10)
def response_interactions(t: Tables) -> DataFrame:
    return R.factorial_effects(scores(t), "model", DRAWS, PAIR).where("effect_type = 'prespecified_interaction'")


@query("response_matched_pairs", f"""WITH {SCORES}, {long_sql(R.METRICS)}, x AS (SELECT * FROM lg WHERE condition_family = 'factorial'), c AS (SELECT model, bits, metric, avg(value) AS m, count(*) AS n FROM x GROUP BY 1, 2, 3),
  b AS ({' UNION ALL '.join(f"SELECT model, metric, '{f}' AS factor, substr(bits, 1, {i}) || substr(bits, {i + 2}) AS matched_background, bits[{i + 1}] AS bit, m, n FROM c" for i, f in enumerate(R.FACTORS))})
  SELECT model, factor, metric, matched_background, max(CASE WHEN bit = '1' THEN m END) AS bit1_mean, max(CASE WHEN bit = '0' THEN m END) AS bit0_mean, coalesce(max(CASE WHEN bit = '1' THEN n END), 0) AS bit1_n, coalesce(max(CASE WHEN bit = '0' THEN n END), 0) AS bit0_n,
  max(CASE WHEN bit = '1' THEN m END) - max(CASE WHEN bit = '0' THEN m END) AS pair_difference FROM b GROUP BY 1, 2, 3, 4""", "bit1_mean bit0_mean pair_difference", digits=10)
def response_matched_pairs(t: Tables) -> DataFrame:
    return R.matched_pairs(scores(t), "model", None, R.METRICS)


@query("response_matched_effect")
def response_matched_effect(t: Tables) -> DataFrame:
    return R.matched_effects(R._factorial(scores(t)).where("status = 'ok'"), "model", 1, "correct_boundary", DRAWS)


@query("response_heterogeneity", f"""WITH {SCORES}, {long_sql(R.METRICS)}, {FACT}, mb AS ({BITS}), e AS (SELECT panel, factor, metric, avg(CASE WHEN cell = 'b1' THEN value END) - avg(CASE WHEN cell = 'b0' THEN value END) AS effect FROM mb GROUP BY 1, 2, 3)
  SELECT factor, metric, count(effect) AS models, min(effect) AS effect_min, max(effect) AS effect_max, stddev_samp(effect) AS effect_sd, max(effect) - min(effect) AS effect_range FROM e WHERE panel <> 'pooled' GROUP BY 1, 2""", "effect_min effect_max effect_sd effect_range", digits=10)
def response_heterogeneity(t: Tables) -> DataFrame:
    return R.heterogeneity(R.factorial_effects(scores(t), "model", 2, R.METRICS))


@query("response_model_interactions", f"""WITH {SCORES}, {long_sql()}, x AS (SELECT * FROM lg WHERE condition_family = 'factorial'), tg AS ({' UNION ALL '.join(f"SELECT model, '{f}' AS factor, metric, call_id, value, bits[{i + 1}] AS bit FROM x" for i, f in enumerate(R.FACTORS))}),
  mi AS (SELECT model AS compared, factor, metric, call_id, value, 'c' || bit AS cell FROM tg WHERE model <> 'F' UNION ALL SELECT k.m, factor, metric, call_id, value, 'r' || bit FROM tg, (SELECT unnest(['O', 'P']) AS m) k WHERE model = 'F'),
  {contrast_sql('mi', 'compared, factor, metric', {'c1': 1.0, 'c0': -1.0, 'r1': -1.0, 'r0': 1.0}, 'interaction')} SELECT * FROM contrast""", "effect ci95_low ci95_high", digits=10)
def response_model_interactions(t: Tables) -> DataFrame:
    return R.model_interactions(scores(t), "model", "F", DRAWS, PAIR)


@query("response_control_comparisons", f"""WITH {SCORES}, {long_sql()}, ct AS (SELECT model, rung, kind AS comparison, metric, call_id, value, 'control' AS cell FROM lg WHERE kind <> 'blind' UNION ALL SELECT model, rung, k.c, metric, call_id, value, 'blind' FROM lg, (SELECT unnest(['leaky', 'empty']) AS c) k WHERE kind = 'blind'),
  {contrast_sql('ct', 'model, rung, comparison, metric', {'control': 1.0, 'blind': -1.0}, 'control')} SELECT * FROM contrast""", "effect ci95_low ci95_high", digits=10)
def response_control_comparisons(t: Tables) -> DataFrame:
    return R.control_comparisons(scores(t), "model", "rung", "kind", ("leaky", "empty"), DRAWS, PAIR)


@query("response_costs", f"WITH {SCORES} SELECT model, count(*) AS registered_calls, count(CASE WHEN status = 'ok' THEN 1 END) AS ok_calls, sum(CASE WHEN status = 'ok' THEN c END) AS observed_cost, avg(CASE WHEN status = 'ok' THEN c END) AS mean_cost, avg(CASE WHEN status = 'ok' THEN c END) * count(*) AS projected_cost FROM (SELECT *, p / 1e6 AS c FROM raw) GROUP BY 1", "observed_cost mean_cost projected_cost")
def response_costs(t: Tables) -> DataFrame:
    return R.cost_estimate(registry(t), "model", "cost")


@query("response_run_scores", """WITH r AS (SELECT o_orderkey % 8 AS rung, (o_totalprice - 250000) / 100000 AS est, CASE WHEN o_totalprice > 300000 THEN 'yes' ELSE 'no_or_uncertain' END AS dec, o_totalprice / 600000 AS conf, (o_orderkey % 2 + o_orderkey % 3 % 2 + o_orderkey % 5 % 2 + 1) / 4.0::DOUBLE AS m FROM orders),
  f AS (SELECT rung, -1.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, CASE WHEN rung > 3 THEN 'yes' ELSE 'no_or_uncertain' END AS d FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS rung)),
  j AS (SELECT r.*, lo, hi, d, (dec = d)::INT AS agree FROM r LEFT JOIN f USING (rung)), sg AS (SELECT rung, max(n) / sum(n)::DOUBLE AS s FROM (SELECT rung, sign(est) AS g, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1),
  md AS (SELECT rung, dec FROM (SELECT rung, dec, count(*) AS n FROM r GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY rung ORDER BY n DESC, dec) = 1)
  SELECT rung, count(*) AS runs, stddev_samp(est) AS run_to_run_dispersion, avg(1 - m) AS method_omission_rate, avg(agree) AS decision_agreement_rate, avg(conf) AS mean_confidence, avg(power(conf - agree, 2)) AS brier_score, avg(CASE WHEN d IS NOT NULL THEN (est BETWEEN lo AND hi)::INT END) AS estimate_in_interval_rate,
    any_value(md.dec) AS modal_decision, any_value(s) AS sign_stability, avg(conf) - avg(agree) AS calibration_gap FROM j JOIN sg USING (rung) JOIN md USING (rung) GROUP BY 1""",
       "run_to_run_dispersion method_omission_rate decision_agreement_rate mean_confidence brier_score estimate_in_interval_rate sign_stability calibration_gap")
def response_run_scores(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    runs = t.orders.select(
        (k % 8).alias("rung"), ((F.col("o_totalprice") - 250000) / 100000).cast("string").alias("headline_estimate"), F.when(F.col("o_totalprice") > 300000, "yes").otherwise("no_or_uncertain").alias("worked_decision"), (F.col("o_totalprice") / 600000).cast("string").alias("self_reported_confidence"),
        (k % 2).alias("mentions_control_group"), (k % 3 % 2).alias("mentions_pretrend"), (k % 5 % 2).alias("mentions_stakeholders"), F.lit(1).alias("mentions_uncertainty"))
    reference = runs.select("rung").distinct().where("rung < 7").select("rung", F.lit(-1.0).alias("ci95_low"), F.lit(1.0).alias("ci95_high"), F.when(F.col("rung") > 3, "yes").otherwise("no_or_uncertain").alias("worked_decision"))
    return R.run_scores(runs, reference)


AUDIT = """au AS (SELECT o_orderstatus AS model, CASE WHEN o_orderkey % 2 = 0 THEN 'T0' ELSE 'T1' END AS cond, o_orderpriority <> '5-LOW' AS ok, CASE WHEN o_totalprice < 120000 THEN 'supported_positive' ELSE 'not_identified' END AS c, CASE WHEN o_totalprice < 350000 THEN 'supported_positive' ELSE 'not_identified' END AS p FROM orders),
cells AS (SELECT model, cond, count(*) AS registered, count(CASE WHEN ok THEN 1 END) AS ok_n, avg(CASE WHEN ok THEN (c <> 'not_identified')::INT END) AS u, avg(CASE WHEN ok THEN (c = 'not_identified' AND p = 'supported_positive')::INT END) AS b, avg(CASE WHEN ok THEN (p = 'supported_positive')::INT END) AS r FROM au GROUP BY 1, 2)"""


def audit(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderstatus").alias("model"), F.when(F.col("o_orderkey") % 2 == 0, "T0").otherwise("T1").alias("condition"), F.when(F.col("o_orderpriority") != "5-LOW", "ok").otherwise("parse_failed").alias("status"),
        F.when(F.col("o_totalprice") < 120000, "supported_positive").otherwise("not_identified").alias("causal_status"), F.when(F.col("o_totalprice") < 350000, "supported_positive").otherwise("not_identified").alias("predictive_status"))


@query("two_condition_cells", f"WITH {AUDIT} SELECT model, cond AS condition, registered, ok_n AS unsafe_causal_affirmation_denominator, u AS unsafe_causal_affirmation_rate, b AS correct_boundary_rate, r AS association_retention_rate FROM cells", "unsafe_causal_affirmation_rate correct_boundary_rate association_retention_rate")
def two_condition_cells(t: Tables) -> DataFrame:
    cells = R.condition_cells(audit(t), "model", "condition")
    return cells.select("model", "condition", "registered", "unsafe_causal_affirmation_denominator", *[f"{m}_rate" for m in R.PRIMARY])


@query("two_condition_deltas", f"WITH {AUDIT} SELECT a.model, a.u - z.u AS unsafe_causal_affirmation_difference, a.b - z.b AS correct_boundary_difference, a.r - z.r AS association_retention_difference FROM cells a JOIN cells z ON z.model = a.model AND z.cond = 'T0' WHERE a.cond = 'T1'",
       "unsafe_causal_affirmation_difference correct_boundary_difference association_retention_difference")
def two_condition_deltas(t: Tables) -> DataFrame:
    return R.condition_deltas(R.condition_cells(audit(t), "model", "condition"), "model", "condition", "T1", "T0")


@query("status_conservation", """WITH r AS (SELECT l_returnflag AS model, l_linenumber AS condition, l_orderkey AS call_id, CASE WHEN l_linestatus = 'F' THEN 'ok' WHEN l_quantity > 45 THEN 'lost' ELSE 'parse_failed' END AS status FROM lineitem),
  c AS (SELECT model, condition, call_id, count(*) AS n, count(CASE WHEN status <> 'lost' THEN 1 END) AS k FROM r GROUP BY 1, 2, 3)
  SELECT model, condition, CAST(sum(n) AS BIGINT) AS registered, CAST(sum(k) AS BIGINT) AS in_known_state, count(CASE WHEN n > 1 THEN 1 END) AS duplicate_slots, sum(n) = sum(k) AND count(CASE WHEN n > 1 THEN 1 END) = 0 AS conserved FROM c GROUP BY 1, 2""")
def status_conservation(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("condition"), F.col("l_orderkey").alias("call_id"),
                             F.when(F.col("l_linestatus") == "F", "ok").when(F.col("l_quantity") > 45, "lost").otherwise("parse_failed").alias("status"))
    return R.check_conservation(rows, ["model", "condition"])


@query("resumed_registry", "SELECT o_orderkey AS call_id, o_orderpriority AS prompt_hash, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'registered_not_run' END AS status FROM orders")
def resumed_registry(t: Tables) -> DataFrame:
    fresh = t.orders.select(F.col("o_orderkey").alias("call_id"), F.col("o_orderpriority").alias("prompt_hash"), F.lit("registered_not_run").alias("status"))
    old = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderpriority").alias("prompt_hash"), F.lit("ok").alias("status"))
    return R.merge_resume(fresh, old, ["prompt_hash"], ["status"])
