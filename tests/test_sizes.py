"""Inputs that larger or sparser tables bring."""

import math

from pyspark.sql import functions as F

from tidemark.catalog import market as market_queries
from tidemark.catalog.registry import Tables
from tidemark.estimators import resampling
from tidemark.functions.scalars import md5_uniform
from tidemark.operators import joins, ranking
from tidemark.plans import cofiring
from tidemark.sources import readers


def test_touch_lift_of_few_touched_mints(spark):
    outcomes = spark.createDataFrame([(i, 10.0 + i) for i in range(12)], "mint long, volume double")
    row = cofiring.touch_lift(outcomes, spark.createDataFrame([(2,)], "mint long"), "volume").collect()
    assert [(r.n_treated, r.n_control) for r in row] == [(1, 3)]
    # some of the 200 draws take the one touched mint no time at all
    assert row[0].lift_pct is not None and row[0].ci95_low <= row[0].ci95_high
    none = cofiring.touch_lift(outcomes, spark.createDataFrame([], "mint long"), "volume").collect()
    assert [tuple(r) for r in none] == [(None, 0, 0, None, None)]


def test_median_draws_of_gathered_and_spread_groups_agree(spark):
    rows = [(None if g == 3 else g, i + 1000 * g, float((i * 37 + g) % 50) - 20.0) for g, n in enumerate((1, 2, 40, 7, 300)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, id long, v double")
    shown = lambda out: {r.k: tuple(None if x is None else round(x, 9) for x in r[1:]) for r in out.collect()}
    whole = shown(resampling.boot_median(df, ["k"], "v", "id", 20))
    assert shown(resampling.boot_median(df, ["k"], "v", "id", 20, gathered=0)) == whole
    assert shown(resampling.boot_median(df, ["k"], "v", "id", 20, gathered=21 * 40)) == whole
    # rows are not multiplied by draws before the shuffle: one exchange, no generator
    plan = resampling.boot_median(df, ["k"], "v", "id", 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Repartition") == 1
    assert whole[2][0] == sorted(v for k, _, v in rows if k == 2)[19] / 2 + sorted(v for k, _, v in rows if k == 2)[20] / 2


def test_draw_sums_hash_a_call_once_and_keep_rows_single(spark):
    rows = [(i, None if i % 7 == 0 else "ab"[i % 2], None if i % 5 == 0 else i / 3, float(i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, x double, y double")
    sums = resampling.draw_sums(df, ["k"], ["x", "y"], "id", 3, "s")
    # only groups x draws are generated, after the batches are summed
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("MapInArrow") and plan.count("Generate") == 1
    long = df.unpivot(["id", "k"], ["x", "y"], "__metric", "value").where("value IS NOT NULL").crossJoin(spark.range(4).withColumnRenamed("id", "draw"))
    copies = F.when(F.col("draw") == 0, 1).otherwise(resampling.poisson_copies(md5_uniform(F.lit("s"), F.col("draw"), F.col("id"))))
    plain = long.groupBy("k", "__metric", "draw").agg(F.sum(copies * F.col("value")).alias("s"), F.sum(copies).alias("w"), F.count("*").alias("n"))
    shown = lambda out: {(r.k, r["__metric"], r.draw): (round(r.s, 8), r.w, r.n) for r in out.collect()}
    assert shown(sums) == shown(plain) and len(shown(sums)) == 24


def test_concentration_in_one_window_and_in_buckets_agree(spark):
    rows = [(g, h, float((i * 7 + g) % 9 + 1)) for g, n in enumerate((1, 3, 50, 12)) for h in (0, 7) for i in range(n)]
    df = spark.createDataFrame(rows, "mint long, h int, w double")
    run = lambda n: ranking.concentration_with_crossing(df, ["mint", "h"], "w", (1, 10), 0.5, "half", n)
    shown = lambda out: {(r.mint, r.h): (r.members, r.half, *[round(x, 12) for x in (r.total_weight, r.top1_share, r.top10_share, r.hhi)]) for r in out.collect()}
    assert shown(run(1000)) == shown(run(0)) == shown(run(12)) and len(shown(run(0))) == 8
    # all figures of a key come from one shuffle
    assert run(1000)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_holder_reconstruction_makes_text_of_clipped_rows_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(market_queries, "import_transfers", lambda rows: seen.append(rows) or readers.import_transfers(rows))
    market_queries.holder_reconstruction(Tables(spark, "/root/testdata/sf0.001")).count()
    blocks = seen[0].agg(F.min(F.col("blockNumber").cast("long")).alias("low"), F.max(F.col("blockNumber").cast("long")).alias("high")).first()
    assert blocks.high - blocks.low <= 2 * (30 * 3000 + 2000)
    out = market_queries.holder_reconstruction(Tables(spark, "/root/testdata/sf0.001"))
    # carries are resolved before the result is planned, not in each of its branches
    assert "__padded" not in out._jdf.queryExecution().optimizedPlan().toString() and "pmod" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_positions_move_one_row_a_range_and_keep_rows_without_key(spark, monkeypatch):
    rows = [(None if i % 5 == 0 else "ab"[i % 10 == 1], float("nan") if i == 7 else None if i == 9 else float(i * 13 % 40), i) for i in range(400)]
    df = spark.createDataFrame(rows, "pair string, v double, id long").repartition(7)
    seen = []
    settled = ranking.settle
    monkeypatch.setattr(ranking, "settle", lambda out: seen.append(settled(out)) or seen[-1])
    place = lambda r: (float("inf") if math.isnan(r[1]) else r[1])
    for keys in ([], ["pair"]):
        for down in (False, True):
            got = {r.id: r.n for r in ranking.global_index(df, "v", "id", keys=keys, descending=down, name="n").collect()}
            groups = {}
            for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (-place(r) if down else place(r), r[2])):
                groups.setdefault(r[0] if keys else 0, []).append(r[2])
            assert got == {i: n for ids in groups.values() for n, i in enumerate(ids, 1)}
            # rows meet one shift for each key and range, not one for each value
            assert seen[-1].count() <= len(groups) * seen[-2].select("__range").distinct().count() <= len(groups) * 8


def test_treated_rows_without_pair_fall_back(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id int, pair string, block int")
    treated, controls = [(1, None, 10), (2, "a", 11), (3, None, 12)], [(7, "a", 5), (8, None, 6)]
    got = {r.id: (r.control_id, r.match_kind) for r in joins.match_without_replacement(frame(treated), frame(controls), "pair", "block", "id").collect()}
    assert got == {1: (8, "fallback"), 2: (7, "same_pair"), 3: (None, "unmatched")}
