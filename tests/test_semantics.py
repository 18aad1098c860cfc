"""Hand fixtures for the semantics the standard tables cannot show."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import responses
from tidemark.estimators import clusters, panel, synthetic, tails, timeseries
from tidemark.functions import base58, logs, wide
from tidemark.functions import scalars as S
from tidemark.operators import filters, joins, ranking, reshape
from tidemark.plans import cofiring, contracts, market
from tidemark.sources import readers, sinks
from tidemark.streaming import jobs

TOP = 2**256


def one(spark, kind, values):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_timestamp_dialects(spark):
    raw = ["1704067200123", "1704067200", "2024-01-01T00:00:00Z", "2024-01-01 00:00:00", "", "garbage", "2024-01-01T02:00:00+02:00", "2024"]
    df = one(spark, "string", raw)
    day = dt.datetime(2024, 1, 1)
    assert column(df, S.parse_ts(F.col("x"), "digits_ms"))[0] == day + dt.timedelta(milliseconds=123)
    assert column(df, S.parse_ts(F.col("x"), "seconds"))[1:7] == [day, day, day, None, None, day]
    assert column(df, S.parse_ts(F.col("x"), "magnitude"))[:2] == [day + dt.timedelta(milliseconds=123), day]
    assert column(df, S.parse_ts(F.col("x"), "seconds"))[0] is None
    with pytest.raises(Exception):
        df.select(S.parse_ts(F.col("x"), "strict")).collect()


def test_numbers_and_booleans(spark):
    df = one(spark, "string", ["1.9", "-1.9", "nan", "inf", "12d", "1e400", "", None, " 7 "])
    assert column(df, S.as_double(F.col("x"))) == [1.9, -1.9, None, None, None, None, None, None, 7.0]
    assert column(df, S.as_long(F.col("x"))) == [1, -1, None, None, None, None, None, None, 7]
    flags = one(spark, "string", ["true", "Y", "yes", "0", None])
    assert column(flags, S.as_bool(F.col("x"), False)) == [True, True, True, False, False]
    assert column(flags, S.as_bool(F.col("x"), None)) == [True, False, True, False, None]


def test_integer_text(spark):
    raw = ["1.0", "1e18", "", "nan", "-5", "1.25e1", "5e-1", str(TOP - 1), "-0", "abc", "007", None]
    want = ["1", "1" + "0" * 18, "0", "0", "-5", "12", "0", str(TOP - 1), "0", "abc", "7", "0"]
    assert column(one(spark, "string", raw), S.integer_text(F.col("x"))) == want


def test_wide_words_round_trip(spark):
    rng = random.Random(5)
    values = [0, 1, 2**63, 2**64 - 1, 2**255, 2**255 - 1, TOP - 1, TOP - 5, 10**26, 10**52 - 1] + [rng.randrange(TOP) for _ in range(40)]
    df = spark.createDataFrame([(str(v), f"{v:064x}") for v in values], "t string, h string")
    fixed = wide.repair_int24(df.select("t", logs.uint_text(F.col("h")).alias("u"), logs.int_text(F.col("h")).alias("s")), "t", "r").collect()
    for row, v in zip(fixed, values):
        assert row.u == str(v)
        assert row.s == str(v - TOP if v >= TOP // 2 else v)
        assert row.r == str(v - TOP + 2**24 if v > TOP // 2 else v)


def test_wide_sums_are_exact(spark):
    rng = random.Random(6)
    rows = [(k % 3, rng.choice([1, -1]) * rng.randrange(TOP)) for k in range(300)]
    df = wide.with_limbs(spark.createDataFrame([(k, str(v)) for k, v in rows], "k int, t string"), "t", "v").groupBy("k").agg(*wide.sum_limbs("v"))
    number = wide.carry(F.col("hi"), F.col("mid"), F.col("lo"))
    got = {r.k: (r.t, r.p) for r in df.select("k", wide.to_text(number).alias("t"), wide.is_positive(number).alias("p")).collect()}
    for k in range(3):
        total = sum(v for key, v in rows if key == k)
        assert got[k] == (str(total), total > 0)


def test_handles_and_base58(spark):
    raw = ["@abc/def", "t.me/xyz?x=1", "https://t.me/joinchat/AAA", "telegram.me/@foo", "https://example.com/a", ""]
    assert column(one(spark, "string", raw), S.normalize_handle(F.col("x"))) == ["abc", "xyz", None, "foo", None, None]
    df = one(spark, "string", ["0xa614f803b6fd780986a42c78ec9c7f77e6ded13c"])
    assert column(df, base58.base58_address(F.col("x"))) == ["TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t"]


def test_right_closed_bins(spark):
    got = column(one(spark, "double", [-1.0, 0.0, 20.0, 20.5, 200.0, 201.0]), S.cut(F.col("x"), [-1, 0, 20, 80, 200, math.inf], ["zero", "short", "medium", "long", "very_long"]))
    assert got == [None, "zero", "short", "medium", "long", "very_long"]


@pytest.mark.parametrize("n", [23, 50, 101])
def test_rank_bins_match_quantile_cut(spark, n):
    df = spark.createDataFrame([(float(i % 7), i) for i in range(n)], "v double, id int")
    got = {r.id: r.b for r in reshape.rank_bins(df, "v", 10, "id", "b").collect()}
    ordered = pd.DataFrame({"v": [float(i % 7) for i in range(n)], "id": range(n)}).sort_values(["v", "id"])
    want = pd.qcut(pd.Series(range(1, n + 1)), 10, labels=False)
    assert [got[i] for i in ordered["id"]] == list(want)


def test_quantiles_on_hot_key(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(500, 2.0), rng.normal(0, 1000, 700), rng.random(300) * 1e-7])
    df = spark.createDataFrame([("hot", float(v)) for v in values] + [("cold", 1.0), ("cold", None)], "k string, v double")
    got = {r.k: r for r in ranking.quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).collect()}
    assert np.allclose([got["hot"].a, got["hot"].b, got["hot"].c], np.quantile(values, [0.1, 0.5, 0.99]))
    assert got["cold"].b == 1.0


def test_running_sum_and_crossing(spark):
    rows = [("k", i, float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = [r.c for r in ranking.running_sum(df, ["k"], F.floor(F.col("t") / 17), [F.col("t")], "v", "c").orderBy("t").collect()]
    assert got == list(np.cumsum([r[2] for r in rows]))
    weights = [5.0, 5.0, 5.0, 1.0, 1.0, 1.0, 1.0, 1.0]
    share = spark.createDataFrame([("k", w) for w in weights], "k string, w double")
    # 10 of 20 is reached by the second five
    assert ranking.crossing_count(share, ["k"], "w", 0.5, "n").first().n == 2


def windows_fixture(spark, offsets):
    t0 = dt.datetime(2024, 1, 1, 12)
    tokens = spark.createDataFrame([("a", t0), ("quiet", t0)], "mint string, t0 timestamp")
    rows = [("a", None, i, f"w{i}", 1.0, t0 + o) for i, o in enumerate(offsets)]
    return tokens, spark.createDataFrame(rows, "bought string, sold string, tx int, trader string, usd double, ts timestamp")


def test_window_ends(spark):
    day = dt.timedelta(days=1)
    tokens, trades = windows_fixture(spark, [0 * day, day, 7 * day, 30 * day])
    got = {(r.mint, r.horizon_days): r for r in market.post_event_activity(tokens, trades).collect()}
    assert [got["a", h].swap_count for h in (1, 7, 30)] == [1, 2, 3]
    assert [got["quiet", h].swap_count for h in (1, 7, 30)] == [0, 0, 0] and got["quiet", 1].first_trade_at is None
    # the calendar-day rule holds for every horizon, the other one only for the widest
    assert [got["a", h].reactivated_after_7d for h in (1, 7, 30)] == [1, 1, 1]
    strict = {(r.mint, r.horizon_days): r for r in market.post_event_activity(tokens, trades, "within_horizon", "fractional_hours").collect()}
    assert [strict["a", h].reactivated_after_7d for h in (1, 7, 30)] == [0, 0, 1]
    closed = joins.range_join(trades.withColumnRenamed("bought", "mint"), tokens, "mint", "ts", "t0", "30 DAYS", closed="both")
    assert closed.count() == 4


def test_either_side_counts_once(spark):
    trades = spark.createDataFrame([("a", "a", 1), ("a", "b", 2), (None, "b", 3)], "bought string, sold string, tx int")
    tokens = spark.createDataFrame([("a",), ("b",)], "mint string")
    got = sorted((r.mint, r.tx) for r in joins.either_side_join(trades, tokens, ("bought", "sold"), "mint").collect())
    assert got == [("a", 1), ("a", 2), ("b", 2), ("b", 3)]


def test_holder_replay(spark):
    zero = market.ZERO_ADDRESS
    big = 2**255 + 12345
    rows = [("t", zero, "0xA", str(big), 10), ("t", "0xa", "0xb", "5", 11), ("t", "0xb", "0xb", "3", 12), ("t", "0xb", "0xc", "5", 13), ("t", "0xa", zero, str(big - 5), 14), ("t", zero, "0xd", "7", 999_999)]
    transfers = spark.createDataFrame(rows, "token_id string, from_address string, to_address string, amount_raw string, block_number long")
    cohort = spark.createDataFrame([("t", 10), ("none", 10)], "token_id string, launch_block long")
    got = {(r.token_id, r.horizon_days): r for r in market.holder_reconstruction(cohort, transfers, 1).collect()}
    # everything but five units burnt; they ended with 0xc
    assert got["t", 1].holder_count == 1 and got["t", 1].holder_concentration_top10 == 1.0 and got["t", 1].transfer_log_count == 5
    assert got["none", 30].holder_count == 0 and got["none", 30].holder_concentration_status == "no_transfer_logs_in_window"


def test_ledger_dedupe_and_unique(spark):
    rows = [("u", "collection_error", 9, 5), ("u", "processed_zero_rows", 0, 4), ("u", "processed_with_rows", 3, 1), ("u", "processed_with_rows", 3, 2), ("v", "weird", 1, 1)]
    df = spark.createDataFrame(rows, "k string, status string, rows int, at int")
    got = {r.k: (r.status, r["at"]) for r in filters.dedupe_ranked(df, ["k"], "status", "rows", "at").collect()}
    assert got == {"u": ("processed_with_rows", 2), "v": ("weird", 1)}
    assert filters.assert_unique(df, ["k", "at"]).count() == 5
    with pytest.raises(Exception, match="duplicate key"):
        filters.assert_unique(df, ["k"]).collect()


def sequential_match(treated, controls):
    used, out = set(), {}
    for tid, pair, _ in sorted(treated, key=lambda r: r[2]):
        pick = [c for c in sorted(controls, key=lambda r: -r[2]) if c[0] not in used and c[1] == pair] or [c for c in sorted(controls, key=lambda r: -r[2]) if c[0] not in used]
        if not pick:
            break
        used.add(pick[0][0])
        out[tid] = pick[0][0]
    return out


def test_matching_without_fallback_equals_sequential_rule(spark):
    treated = [(i, "ab"[i % 2], 100 + i) for i in range(6)]
    controls = [(50 + i, "ab"[i % 2], i) for i in range(10)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, pair string, block int")
    got = {r.id: r.control_id for r in joins.match_without_replacement(frame(treated), frame(controls), "pair", "block", "id").collect()}
    assert got == sequential_match(treated, controls)


def test_matching_reports_fallback(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id int, pair string, block int")
    treated, controls = [(1, "a", 10), (2, "a", 11), (3, "a", 12)], [(7, "a", 5), (8, "b", 6)]
    got = {r.id: (r.control_id, r.match_kind) for r in joins.match_without_replacement(frame(treated), frame(controls), "pair", "block", "id").collect()}
    assert got == {1: (7, "same_pair"), 2: (8, "fallback"), 3: (None, "unmatched")}


def toy_panel(spark, effect=0.7, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(4):
        for d in range(30):
            y = u + 0.1 * d + rng.normal(0, 0.3) + (effect if u == 0 and d >= 15 else 0)
            rows.append((f"u{u}", dt.date(2024, 1, 1) + dt.timedelta(days=d), float(y), int(u == 0)))
    return panel.event_clock(spark.createDataFrame(rows, "unit string, day date, y double, treated int"), "day", "2024-01-16"), rows


def dummy_ols(rows, columns, cluster=None):
    """Dummy regression with HC1, as an independent check."""
    n = len(rows)
    units, days = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x = np.array([[1.0] + [float(r[0] == u) for u in units[1:]] + [float(r[1] == d) for d in days[1:]] + [c(r) for c in columns] for r in rows])
    y = np.array([r[2] for r in rows])
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    cov = inv @ (x.T * e**2) @ x @ inv * n / (n - x.shape[1])
    return beta[-len(columns):], np.sqrt(np.diag(cov))[-len(columns):]


def test_twfe_equals_dummy_regression(spark):
    df, rows = toy_panel(spark)
    beta, se = dummy_ols(rows, [lambda r: float(r[3] and r[1] >= dt.date(2024, 1, 16))])
    got = panel.twfe(df, "unit", "day").first()
    assert np.allclose([got.estimate, got.std_error], [beta[0], se[0]])


def test_event_study_equals_dummy_regression(spark):
    df, rows = toy_panel(spark)
    week = lambda r: math.floor((r[1] - dt.date(2024, 1, 16)).days / 7)
    weeks = sorted({week(r) for r in rows} - {-1})
    beta, se = dummy_ols(rows, [lambda r, w=w: float(r[3] and week(r) == w) for w in weeks])
    got = {r.rel_week: r for r in panel.event_study(df, "unit", "day").collect()}
    assert got[-1].coef == 0.0 and got[-1].std_error == 0.0
    assert np.allclose([got[w].coef for w in weeks], beta)
    assert np.allclose([got[w].std_error for w in weeks], se)


def gappy_panel(spark):
    """Every unit misses some days, so that no day is complete, and one day has a single unit."""
    _, rows = toy_panel(spark)
    kept = [r for i, r in enumerate(rows) if (r[1].day * 7 + int(r[0][1]) * 11) % 4 and not (r[1].day == 9 and r[0] != "u2")]
    assert not any(sum(r[1] == d for r in kept) == 4 for d in {r[1] for r in kept})
    return panel.event_clock(spark.createDataFrame(kept, "unit string, day date, y double, treated int"), "day", "2024-01-16"), kept


def test_estimates_on_a_panel_with_gaps_equal_dummy_regressions(spark):
    df, rows = gappy_panel(spark)
    event = dt.date(2024, 1, 16)
    late = lambda r: r[1] >= event
    beta, se = dummy_ols(rows, [lambda r: float(r[3] and late(r))])
    got = panel.twfe(df, "unit", "day").first()
    assert np.allclose([got.estimate, got.std_error], [beta[0], se[0]]) and got.n_rows == len(rows)
    week = lambda r: math.floor((r[1] - event).days / 7)
    weeks = sorted({week(r) for r in rows} - {-1})
    beta, se = dummy_ols(rows, [lambda r, w=w: float(r[3] and week(r) == w) for w in weeks])
    study = {r.rel_week: r for r in panel.event_study(df, "unit", "day").collect()}
    assert np.allclose([study[w].coef for w in weeks], beta) and np.allclose([study[w].std_error for w in weeks], se)
    assert math.isclose(study[0].avg_post, np.mean([b for b, w in zip(beta, weeks) if w >= 0]))
    chosen = {r.pseudo_treated_unit: r.estimate for r in panel.permute_units(df, "unit", "u0", "day").collect()}
    for u in ("u0", "u1", "u2", "u3"):
        assert math.isclose(chosen[u], dummy_ols(rows, [lambda r, u=u: float(r[0] == u and late(r))])[0][0], rel_tol=1e-8)


def test_sign_enumeration_on_a_panel_with_gaps(spark):
    df, rows = gappy_panel(spark)
    units, days = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    fixed = np.array([[float(r[0] == u) for u in units] + [float(r[1] == d) for d in days] for r in rows])
    free = np.eye(len(rows)) - fixed @ np.linalg.pinv(fixed)
    w, y = free @ [float(r[3] and r[1] >= dt.date(2024, 1, 16)) for r in rows], free @ [r[2] for r in rows]
    member = np.array([units.index(r[0]) for r in rows])
    n, g, k = len(rows), len(units), len(units) + len(days)

    def fit(values):
        values = free @ values
        b = w @ values / (w @ w)
        scores = [(w * (values - b * w))[member == i].sum() for i in range(g)]
        return b, math.sqrt(g / (g - 1) * (n - 1) / (n - k) * sum(s * s for s in scores)) / (w @ w)

    b, se = fit(y)
    signs = [np.array([1.0 if v >> i & 1 else -1.0 for i in range(g)]) for v in range(1 << g)]
    ts = [np.divide(*fit(s[member] * y)) for s in signs]
    got = clusters.crv1(df, "unit", "day").first()
    assert np.allclose([got.estimate, got.std_error], [b, se])
    assert math.isclose(got.sign_p_value, np.mean([abs(t) >= abs(b / se) - 1e-10 for t in ts]))
    wild = clusters.wild_cluster(df, "unit", "day").first()
    assert math.isclose(wild.p_value, np.mean([abs(w @ (s[member] * y) / (w @ w)) >= abs(b) - 1e-12 for s in signs]))


def test_wild_cluster_enumerates_all_signs(spark):
    df, rows = toy_panel(spark)
    got = clusters.wild_cluster(df, "unit", "day").first()
    assert got.sign_assignments == 16 and got.p_value in {k / 16 for k in range(2, 17, 2)}
    beta, se = dummy_ols(rows, [lambda r: float(r[3] and r[1] >= dt.date(2024, 1, 16))])
    assert np.allclose([got.estimate, got.std_error_hc1], [beta[0], se[0]])
    t = clusters.crv1(df, "unit", "day").first()
    assert math.isclose(t.estimate, got.estimate) and t.sign_p_value in {k / 16 for k in range(2, 17, 2)}


def test_unbalanced_twfe_clusters(spark):
    df, rows = toy_panel(spark)
    rng = random.Random(1)
    kept = [r for r in rows if rng.random() > 0.2]
    frame = spark.createDataFrame([(r[0], (r[1] - dt.date(2024, 1, 1)).days, r[2], int(r[3] and r[1] >= dt.date(2024, 1, 16))) for r in kept], "c string, t int, y double, d int")
    beta, _ = dummy_ols(kept, [lambda r: float(r[3] and r[1] >= dt.date(2024, 1, 16))])
    got = clusters.twfe_cluster(frame, "c", "t", d="d").first()
    assert math.isclose(got.estimate, beta[0], rel_tol=1e-9) and got.clusters == 4


def test_synthetic_control_recovers_weights(spark):
    rng = np.random.default_rng(0)
    controls = rng.normal(0, 1, (60, 3))
    treated = controls @ [0.5, 0.3, 0.2] + 2.0
    treated[40:] += 1.5
    rows = [(u, dt.date(2024, 1, 1) + dt.timedelta(days=d), float(v)) for d in range(60) for u, v in zip("tabc", [treated[d], *controls[d]])]
    df = spark.createDataFrame(rows, "unit string, day date, y double")
    got = {r.treated_unit: r for r in synthetic.synthetic_gaps(df, "unit", "day", "2024-02-10", "t").collect()}
    assert math.isclose(got["t"].gap_change, 1.5, abs_tol=1e-4) and got["t"].pre_centered_rmse < 1e-4
    assert math.isclose(got["t"].p_two_sided, got["t"].abs_rank / 4)


def test_tails():
    assert math.isclose(tails.incomplete_beta(0.5, 2.0, 3.0), 0.6875, rel_tol=1e-12)
    total = sum(math.comb(40, k) * 0.9**k * 0.1 ** (40 - k) for k in range(38, 41))
    assert math.isclose(tails.incomplete_beta(0.9, 38.0, 3.0), total, rel_tol=1e-10)


def test_aggregation_weights_identity(spark):
    days = spark.createDataFrame([(d, float(d * d % 11)) for d in range(-40, 30)], "rel_day int, gap double")
    got = {(r.offset, r.method): r.estimate for r in timeseries.aggregation_contrasts(days).collect()}
    values = {d: float(d * d % 11) for d in range(-40, 30)}
    daily = np.mean([values[d] for d in range(7)]) - np.mean([values[d] for d in range(-28, 0)])
    for k in range(7):
        assert math.isclose(got[k, "event_aligned"], got[k, "daily"])
    # with the event on the first day of its week nothing is contaminated
    assert math.isclose(got[4, "daily"], daily, rel_tol=1e-9)
    assert len(got) == 28


def test_components_of_chain(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", 3) for i in range(20)] + [("x", "y", 3)], "a string, b string, weight int")
    got = {r.node: r.component for r in cofiring.components(edges).collect()}
    assert {got[f"n{i:02d}"] for i in range(21)} == {"n00"} and got["y"] == "x"


def test_contracts(spark):
    ledger = spark.createDataFrame([("a", "observed"), ("b", "not_collected"), ("c", "observed")], "k string, s string")
    table = spark.createDataFrame([("a",), ("b",)], "k string")
    assert contracts.check_iff(ledger, table, "k", "s", "x").first().violations == 2
    assert contracts.check_domain(ledger, "s", contracts.COVERAGE_STATES, "x").first().passed
    assert contracts.check_fk(ledger, table, "k", "k", "x").first().violations == 1


def test_release_is_all_or_nothing(spark, tmp_path):
    good = spark.range(3)
    bad = spark.range(3).withColumn("x", F.raise_error(F.lit("boom")))
    out = str(tmp_path / "release")
    with pytest.raises(Exception):
        sinks.write_release(spark, {"good": good, "bad": bad}, out)
    assert not list(tmp_path.iterdir())
    sinks.write_release(spark, {"good": good}, out)
    assert spark.read.parquet(f"{out}/good").count() == 3
    with pytest.raises(FileExistsError):
        sinks.write_release(spark, {"good": good}, out)


def test_import_fails_on_missing_columns(spark):
    with pytest.raises(ValueError, match="missing required"):
        readers.import_transfers(spark.createDataFrame([("a",)], "token string"))


def test_empty_ids_and_missing_m0(spark):
    gold = responses.Gold(("not_identified",), ("not_identified",), ("supported",), ("not_identified",), ("not_identified",), ("not_identified",), ("supported_positive",))
    registry = spark.createDataFrame([(1, "ok", ""), (2, "parse_failed", "M0"), (3, "provider_error", "M0")], "call_id int, status string, present_evidence_ids string")
    answer = '{"market_causal_status":"not_identified","operational_status":"not_identified","stakeholder_status":"not_identified","supporting_evidence_ids":[],"missing_evidence_slots":[],"confidence":0.5,"short_claim":"c"}'
    parsed = spark.createDataFrame([(1, answer)], "call_id int, answer string")
    got = {r.call_id: r for r in responses.collect_scores(registry, parsed, gold).collect()}
    assert got[1].evidence_id_precision == 1.0 and got[1].missing_slot_recall == 0.0 and got[1].operational_claim_retention is None
    assert got[1].safe_utility == 1.0 and got[1].parse_failure == 0
    assert got[2].parse_failure == 1 and got[2].safe_utility is None and got[3].parse_failure is None


def test_stream_resumes_without_duplicates(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    t0 = dt.datetime(2024, 1, 1)
    batch = lambda days: spark.createDataFrame([("a", t0 + dt.timedelta(days=d), 1.0) for d in days], "token string, ts timestamp, v double")
    schema = batch([0]).schema
    for days in ([0, 0, 1], [2, 3, 9]):
        batch(days).write.mode("append").parquet(source)
        jobs.run_available(jobs.stream_daily(jobs.read_stream(spark, source, schema), "token", "ts", "v"), out, mark)
    got = {r.day: r.trades for r in spark.read.parquet(out).collect()}
    assert got == {t0 + dt.timedelta(days=d): n for d, n in ((0, 2), (1, 1), (2, 1), (3, 1))}


def test_ledger_replay_is_idempotent(spark, tmp_path):
    snaps = jobs.LedgerSnapshots(str(tmp_path / "ledger"), ["k"], "status", "rows", "at")
    row = lambda *r: spark.createDataFrame([r], "k string, status string, rows int, at int")
    snaps.merge(row("u", "processed_zero_rows", 0, 1), 0)
    for _ in range(2):
        snaps.merge(row("u", "processed_with_rows", 2, 2), 1)
    assert [(r.status, r.rows) for r in snaps.latest(spark).collect()] == [("processed_with_rows", 2)]
