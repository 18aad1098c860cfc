"""Wallets that buy the same launches early, as a graph, and what their launches gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.estimators.resampling import poisson_copies
from tidemark.functions.scalars import md5_uniform, safe_rate
from tidemark.operators import ranking
from tidemark.session import settle

FIRST_BUYERS = 10


def first_buyers(buyers: DataFrame, k: int = FIRST_BUYERS) -> DataFrame:
    """The first k distinct wallets of each mint with their rank.

    ``buyers``  mint, wallet, ts, seq, sol
    """
    per_wallet = buyers.groupBy("mint", "wallet").agg(
        F.min(F.struct("ts", "seq")).alias("at"), F.sum("sol").alias("sol"), F.max("ts").alias("last_ts")
    )
    rank = F.row_number().over(Window.partitionBy("mint").orderBy("at", "wallet"))
    return per_wallet.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "mint", "wallet", "rank", F.col("at.ts").alias("ts"), "sol"
    )


def wallet_edges(first: DataFrame, min_weight: int) -> DataFrame:
    """Wallet pairs seen together in at least ``min_weight`` first-buyer queues.

    A queue holds at most ten wallets by definition, so a mint yields at most 45 pairs: no popular mint can
    produce more. Pairs are generated from the sorted queue in place and counted with a map-side combine.
    """
    queues = first.groupBy("mint").agg(F.array_sort(F.collect_set("wallet")).alias("w"))
    pairs = F.flatten(F.transform(F.col("w"), lambda a, i: F.transform(
        F.slice(F.col("w"), i + 2, F.greatest(F.lit(0), F.size("w") - i - 1)), lambda b: F.struct(a.alias("a"), b.alias("b"))
    )))
    return (
        queues.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("weight"))
        .where(F.col("weight") >= min_weight)
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components (node, component = smallest node) by label spreading with pointer jumping.

    A round takes the smallest label of the neighbours, then follows labels of labels, so long chains shrink
    geometrically. Each round is written to shared storage; one count per round decides when to stop.
    """
    both = settle(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))
    ).distinct())
    labels = settle(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("label", "near").alias("hop"), F.col("label").alias("old"))
        jump = spread.join(labels.select(F.col("node").alias("hop"), F.col("label").alias("root")), "hop", "left")
        step = settle(jump.select("node", F.least("hop", F.coalesce("root", "hop")).alias("label"), (F.least("hop", F.coalesce("root", "hop")) != F.col("old")).alias("moved")))
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def cofiring_cohorts(buyers: DataFrame, min_weight: int = 3) -> DataFrame:
    """Cohorts of co-firing wallets with the launches they hit, their ranks, spend and score.

    A launch counts for a cohort when at least two members are among its first ten buyers.
    """
    first = settle(first_buyers(buyers))
    members = components(wallet_edges(first, min_weight))
    sizes = members.groupBy("component").agg(F.count("*").alias("cohort_size"))
    seen = first.join(members.withColumnRenamed("node", "wallet"), "wallet")
    hits = seen.groupBy("component", "mint").agg(
        F.count("*").alias("n_wallets"), F.min("rank").alias("first_rank"), F.min("ts").alias("min_time"), F.max("ts").alias("max_time")
    ).where("n_wallets >= 2")
    launches = hits.groupBy("component").agg(
        F.count("*").alias("n_launches"), F.avg("first_rank").alias("avg_first_rank"), F.min("min_time").alias("first_seen"), F.max("max_time").alias("last_seen")
    )
    spend = seen.groupBy("component").agg(F.sum("sol").alias("sol_total"))
    out = sizes.join(launches, "component").join(spend, "component")
    score = F.col("n_launches") * 10 + F.lit(5) / F.greatest(F.col("avg_first_rank"), F.lit(1.0)) + F.sqrt("sol_total")
    return out.withColumn("score", score)


def size_distribution(cohorts: DataFrame) -> DataFrame:
    total = cohorts.agg(F.count("*")).scalar()
    return cohorts.groupBy("cohort_size").agg(F.count("*").alias("n_cohorts")).withColumn(
        "share_pct", F.round(F.col("n_cohorts") * 100.0 / total, 2)
    )


def weight_sensitivity(buyers: DataFrame, weights: tuple[int, ...] = (2, 3, 5)) -> DataFrame:
    """Qualifying pairs and components of size two or more per edge-weight cutoff."""
    first = first_buyers(buyers)
    edges = settle(wallet_edges(first, min(weights)))
    rows = []
    for w in weights:
        kept = edges.where(F.col("weight") >= w)
        n_components = components(kept).select("component").distinct().agg(F.count("*").alias("n_components_size_ge2"))
        rows.append(kept.agg(F.count("*").alias("n_qualifying_pairs")).select(
            F.lit(w).alias("edge_weight_cutoff"), "n_qualifying_pairs", n_components.scalar().alias("n_components_size_ge2")
        ))
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def touched_tokens(buyers: DataFrame, cohort_wallets: DataFrame) -> DataFrame:
    """Mints with at least two wallets of one cohort among the first ten buyers (columns wallet, component)."""
    first = first_buyers(buyers)
    return first.join(cohort_wallets, "wallet").groupBy("mint", "component").agg(F.count("*").alias("n")).where("n >= 2").select("mint").distinct()


def touch_lift(outcomes: DataFrame, touched: DataFrame, value: str, ratio: int = 3, draws: int = 200, salt: str = "lift") -> DataFrame:
    """Percent lift of the mean outcome of touched mints over ``ratio`` times as many hash-ordered controls, with CI.

    ``outcomes``  mint, <value>. Controls are the untouched mints with the smallest key hashes: reproducible and
    independent of partitioning. The interval resamples mints with Poisson weights, one aggregate for all draws. A draw
    that takes no mint of a side, or controls of mean zero, has no lift: it is null and no part of the interval.
    Without any touched mint the one row has null lifts and counts of zero.
    """
    outcomes, touched = settle(outcomes), settle(touched)
    treated = outcomes.join(touched, "mint", "left_semi").withColumn("side", F.lit(1))
    n = treated.agg(F.count("*")).scalar()
    pool = outcomes.join(touched, "mint", "left_anti").withColumn("__u", md5_uniform(F.lit(salt), F.col("mint"))).withColumn(
        "__tie", F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.lit("/"), F.col("mint").cast("string"))), 1, 13), 16, 10).cast("bigint")
    )
    controls = ranking.global_index(pool, "__u", "__tie", name="__place").where(F.col("__place") <= ratio * n).withColumn("side", F.lit(0))
    sample = treated.select("mint", value, "side").unionByName(controls.select("mint", value, "side"))
    drawn = sample.select(value, "side", "mint", F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw"))
    drawn = drawn.withColumn("u", md5_uniform(F.lit(salt), F.col("draw"), F.col("mint"))).withColumn(
        "w", F.when(F.col("draw") == 0, F.lit(1)).otherwise(poisson_copies(F.col("u")))
    )
    w = F.col("w")

    def mean(side: int) -> Column:
        here = F.col("side") == side
        return safe_rate(F.sum(F.when(here, w * F.col(value))), F.sum(F.when(here, w)))

    lifts = settle(drawn.groupBy("draw").agg(((safe_rate(mean(1), mean(0)) - 1) * 100).alias("lift_pct"), F.count_if(F.col("side") == 1).alias("n_treated"), F.count_if(F.col("side") == 0).alias("n_control")))
    interval = ranking.quantiles(lifts.where("draw > 0"), [], "lift_pct", {"ci95_low": 0.025, "ci95_high": 0.975})
    point = lifts.where("draw = 0").agg(
        F.max("lift_pct").alias("lift_pct"), *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("n_treated", "n_control")]
    )
    return ranking.with_quantiles(point, [], interval)
