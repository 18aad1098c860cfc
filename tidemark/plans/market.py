"""Fixed-horizon market outcomes and concentration.

Horizons nest, so a row is labelled once with the smallest horizon that contains it and every wider horizon is a
conditional sum over labels. Nothing is multiplied by the number of horizons before the last, small step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import wide
from tidemark.functions.scalars import as_double, censored_outcome, clip, period_label, safe_rate
from tidemark.operators import aggregates, filters, joins, ranking, reshape
from tidemark.operators.reshape import HORIZONS
from tidemark.session import settle

DAY = "DAYS"


def _days(n: int | str) -> Column:
    return F.expr(f"INTERVAL {n} DAYS")


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def smallest_horizon(ts: Column, start: Column, horizons: Sequence[int] = HORIZONS, closed: bool = False) -> Column:
    """Smallest horizon whose window from ``start`` contains ``ts``; null beyond the last one."""
    chain = None
    for h in horizons:
        end = start + _days(h)
        hit = ts <= end if closed else ts < end
        chain = F.when(hit, F.lit(h)) if chain is None else chain.when(hit, F.lit(h))
    return chain


def _by_horizon(make, horizons: Sequence[int] = HORIZONS) -> list[Column]:
    return [c for h in horizons for c in make(h)]


def explode_horizons(df: DataFrame, keep: Sequence[str], fields: dict[str, str], horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Turn suffixed columns ``{source}_{h}`` back into one row per horizon."""
    packs = [
        F.struct(F.lit(h).alias("horizon_days"), *[F.col(f"{src}_{h}").alias(out) for out, src in fields.items()])
        for h in horizons
    ]
    return df.select(*keep, F.explode(F.array(*packs)).alias("x")).select(*keep, "x.horizon_days", *[f"x.{o}" for o in fields])


def post_event_activity(tokens: DataFrame, trades: DataFrame, reactivation: str = "calendar_day", gap: str = "whole_hours") -> DataFrame:
    """Activity of each token in the 1, 7 and 30 days after its event.

    ``tokens``  mint, t0            ``trades``  bought, sold, tx, trader, usd, ts

    Distinct transactions and traders are both counted by one aggregation over (token, kind, id): each trade yields
    one row per kind, and a hot token is spread over its ids. Tokens without trades stay.

    ``reactivation``  ``calendar_day``: a trade on or after the day of t0+7d, same answer for all horizons;
                      ``within_horizon``: a trade in [t0+7d, t0+30d) that also lies inside the horizon.
    ``gap``           ``whole_hours`` or ``fractional_hours`` between first and last trade.
    """
    sided = joins.either_side(trades, ("bought", "sold"), "mint")
    near = joins.range_join(sided, tokens, "mint", "ts", "t0", "30 DAYS").withColumn(
        "h", smallest_horizon(F.col("ts"), F.col("t0"))
    )
    late = (
        F.date_trunc("day", F.col("ts")) >= F.date_trunc("day", F.col("t0") + _days(7))
        if reactivation == "calendar_day"
        else F.col("ts") >= F.col("t0") + _days(7)
    )
    ids = F.explode(F.array(
        F.struct(F.lit("tx").alias("kind"), F.col("tx").cast("string").alias("id")),
        F.struct(F.lit("trader").alias("kind"), F.col("trader").cast("string").alias("id")),
    )).alias("e")
    per_id = (
        near.select("mint", "h", "ts", "usd", late.cast("int").alias("late"), ids)
        .select("mint", "h", "ts", "usd", "late", "e.kind", "e.id")
        .groupBy("mint", "kind", "id")
        .agg(
            F.min("h").alias("h"),
            F.max("late").alias("late"),
            F.min("ts").alias("first"),
            *_by_horizon(lambda h: [
                F.sum(F.when((F.col("kind") == "tx") & (F.col("h") == h), F.col("usd"))).alias(f"usd_{h}"),
                F.max(F.when(F.col("h") == h, F.col("ts"))).alias(f"last_{h}"),
            ]),
        )
    )
    known = F.col("id").isNotNull()
    per_token = per_id.groupBy("mint").agg(
        F.min("first").alias("first"),
        F.max("late").alias("late"),
        *_by_horizon(lambda h: [
            F.count_if(known & (F.col("kind") == "tx") & (F.col("h") <= h)).alias(f"swaps_{h}"),
            F.count_if(known & (F.col("kind") == "trader") & (F.col("h") <= h)).alias(f"traders_{h}"),
            F.sum(f"usd_{h}").alias(f"usd_{h}"),
            F.max(f"last_{h}").alias(f"last_{h}"),
            F.min(F.when(F.col("h") <= h, F.col("first"))).alias(f"first_{h}"),
        ]),
    )
    joined = tokens.join(per_token, "mint", "left")
    filled = joined.select(
        "mint", "t0", "late",
        *_by_horizon(lambda h: [
            F.coalesce(F.col(f"swaps_{h}"), F.lit(0)).alias(f"swaps_{h}"),
            F.coalesce(F.col(f"traders_{h}"), F.lit(0)).alias(f"traders_{h}"),
            sum((F.coalesce(F.col(f"usd_{g}"), F.lit(0.0)) for g in HORIZONS if g <= h), F.lit(0.0)).alias(f"volume_{h}"),
            F.col(f"first_{h}"),
            (F.greatest(*[F.col(f"last_{g}") for g in HORIZONS if g <= h]) if h > 1 else F.col("last_1")).alias(f"latest_{h}"),
        ]),
    )
    rows = explode_horizons(filled, ["mint", "t0", "late"], {
        "swap_count": "swaps", "active_traders": "traders", "volume_usd": "volume", "first_trade_at": "first", "last_trade_at": "latest",
    })
    span = _micros(F.col("last_trade_at")) - _micros(F.col("first_trade_at"))
    hours = F.floor(span / 3_600_000_000) if gap == "whole_hours" else span / 3.6e9
    reached = (
        F.coalesce(F.col("late"), F.lit(0))
        if reactivation == "calendar_day"
        else F.coalesce((F.col("last_trade_at") >= F.col("t0") + _days(7)).cast("int"), F.lit(0))
        * (F.col("horizon_days") > 7).cast("int")
    )
    return rows.select(
        "mint", F.col("t0").alias("graduated_at"), "horizon_days", "swap_count", "active_traders", "volume_usd",
        "first_trade_at", "last_trade_at", hours.alias("inactivity_gap_hours"), reached.alias("reactivated_after_7d"),
    )


def proxy_windows(tokens: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pool-transaction proxy per token and horizon: fee payers as traders, native-coin volume, fractional hours.

    ``tokens``      mint, t0, pool_address, window_status
    ``signatures``  mint, signature, ts, failed (0/1), fee_payer, sol, parsed (0/1)

    A window keeps the status of the whole scan: with a status other than ok, zero means unknown. Every listed
    signature counts as scanned; only successful ones inside the horizon count as transactions.
    """
    scanned = signatures.join(tokens.select("mint", "t0"), "mint")
    usable = (F.col("failed") == 0) & F.col("ts").isNotNull()
    rows = scanned.withColumn("h", F.when(usable, smallest_horizon(F.col("ts"), F.col("t0"))))
    per_payer = rows.groupBy("mint", "fee_payer").agg(
        F.count("*").alias("scanned"),
        F.min("h").alias("h"),
        *_by_horizon(lambda h: [
            F.count_if(F.col("h") == h).alias(f"n_{h}"),
            F.sum(F.when(F.col("h") == h, F.col("parsed"))).alias(f"parsed_{h}"),
            F.sum(F.when(F.col("h") == h, F.col("sol"))).alias(f"sol_{h}"),
            F.min(F.when(F.col("h") <= h, F.col("ts"))).alias(f"first_{h}"),
            F.max(F.when(F.col("h") <= h, F.col("ts"))).alias(f"last_{h}"),
        ]),
        F.max(((F.col("h") == 30) & (F.col("ts") >= F.col("t0") + _days(7))).cast("int")).alias("late"),
    )
    per_token = per_payer.groupBy("mint").agg(
        F.sum("scanned").alias("signatures_scanned"),
        F.max("late").alias("late"),
        *_by_horizon(lambda h: [
            F.count_if(F.col("fee_payer").isNotNull() & (F.col("fee_payer") != "") & (F.col("h") <= h)).alias(f"traders_{h}"),
            *[F.sum(sum((F.coalesce(F.col(f"{c}_{g}"), F.lit(0)) for g in HORIZONS if g <= h), F.lit(0))).alias(f"{c}_upto_{h}") for c in ("n", "parsed")],
            F.sum(F.when(
                F.coalesce(*[F.col(f"sol_{g}") for g in HORIZONS if g <= h]).isNotNull(),
                sum((F.coalesce(F.col(f"sol_{g}"), F.lit(0.0)) for g in HORIZONS if g <= h), F.lit(0.0)),
            )).alias(f"sol_upto_{h}"),
            F.min(f"first_{h}").alias(f"first_{h}"), F.max(f"last_{h}").alias(f"last_{h}"),
        ]),
    )
    base = tokens.join(per_token, "mint", "left")
    out = explode_horizons(base, ["mint", "t0", "pool_address", "window_status", "signatures_scanned", "late"], {
        "swap_count": "n_upto", "active_traders": "traders", "volume_sol_proxy": "sol_upto",
        "first_trade_at": "first", "last_trade_at": "last", "transactions_parsed": "parsed_upto",
    })
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(
        "mint", F.col("t0").alias("graduated_at"), "horizon_days", "pool_address", zero("swap_count"), zero("active_traders"),
        "volume_sol_proxy", "first_trade_at", "last_trade_at",
        ((_micros(F.col("last_trade_at")) - _micros(F.col("first_trade_at"))) / 3.6e9).alias("inactivity_gap_hours"),
        F.when(F.col("horizon_days") == 30, F.coalesce("late", F.lit(0))).otherwise(F.lit(0)).alias("reactivated_after_7d"),
        zero("signatures_scanned"), zero("transactions_parsed"), "window_status",
    )


def early_concentration(tokens: DataFrame, buys: DataFrame, seconds: int = 60) -> DataFrame:
    """Concentration of buy volume in the first seconds of a token; tokens without buys are absent.

    ``tokens``  mint, t0      ``buys``  mint, buyer, usd, ts
    """
    near = joins.range_join(buys, tokens, "mint", "ts", "t0", f"{seconds} SECONDS")
    per_buyer = near.groupBy("mint", "buyer").agg(
        F.min("t0").alias("t0"), F.sum("usd").alias("usd"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    per_buyer = settle(per_buyer)
    shape = ranking.concentration(per_buyer, ["mint"], "usd")
    spans = per_buyer.groupBy("mint").agg(
        F.min("t0").alias("launch_or_graduated_at"), F.count("buyer").alias("early_buyers"), F.sum("usd").alias("early_buy_volume_usd"),
        F.min("first").alias("first_trade_at"), F.max("last").alias("last_early_trade_at"),
    )
    return spans.join(shape, "mint").select(
        "mint", "launch_or_graduated_at", F.lit(seconds).alias("early_window_seconds"), "early_buyers", "early_buy_volume_usd",
        *[F.col(f"top{k}_share").alias(f"top{k}_early_buyer_share") for k in (1, 5, 10)],
        F.col("hhi").alias("early_buyer_hhi"), "first_trade_at", "last_early_trade_at",
    )


def early_wallets(tokens: DataFrame, trades: DataFrame, seconds: int = 60) -> DataFrame:
    """Early-wallet concentration on either side of a trade; a wallet without dollar volume weighs its transactions.

    All tokens are kept, with zeros. Flags: top wallet at 80 percent or more, top five at 95 percent or more.
    """
    sided = joins.either_side(trades, ("bought", "sold"), "mint")
    near = joins.range_join(sided, tokens, "mint", "ts", "t0", f"{seconds} SECONDS")
    per_tx = near.groupBy("mint", "trader", "tx").agg(
        F.sum(F.coalesce("usd", F.lit(0.0))).alias("usd"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    per_wallet = per_tx.groupBy("mint", "trader").agg(
        F.count("tx").alias("trades"), F.sum("usd").alias("usd"), F.min("first").alias("first"), F.max("last").alias("last")
    ).withColumn("weight", F.when(F.col("usd") > 0, F.col("usd")).otherwise(F.col("trades").cast("double")))
    per_wallet = settle(per_wallet)
    shape = ranking.concentration(per_wallet, ["mint"], "weight")
    spans = per_wallet.groupBy("mint").agg(
        F.count("trader").alias("early_wallets"), F.sum("usd").alias("early_volume_usd"),
        F.min("first").alias("first_trade_at"), F.max("last").alias("last_early_trade_at"),
    )
    joined = tokens.join(spans.join(shape, "mint"), "mint", "left")
    zero = lambda c, out: F.coalesce(F.col(c), F.lit(0.0)).alias(out)
    return joined.select(
        "mint", F.col("t0").alias("launch_or_graduated_at"), F.lit(seconds).alias("early_window_seconds"),
        F.coalesce("early_wallets", F.lit(0)).alias("early_wallets"), zero("early_volume_usd", "early_volume_usd"),
        *[zero(f"top{k}_share", f"top{k}_early_wallet_share") for k in (1, 5, 10)], zero("hhi", "early_wallet_hhi"),
        F.coalesce((F.col("top1_share") >= 0.80).cast("int"), F.lit(0)).alias("sniper_top1_80pct"),
        F.coalesce((F.col("top5_share") >= 0.95).cast("int"), F.lit(0)).alias("sniper_top5_95pct"),
        "first_trade_at", "last_early_trade_at",
    )


def early_proxy(tokens: DataFrame, transactions: DataFrame) -> DataFrame:
    """Early fee-payer concentration with proxy weights: native coin, else token amount, else one per transaction.

    ``tokens``  mint, t0      ``transactions``  mint, ts, failed, fee_payer, sol, token_amount, role, parsed
    """
    ok = transactions.where(F.col("failed") == 0)
    weight = F.coalesce(F.col("sol"), F.col("token_amount"), F.lit(1.0))
    has_wallet = F.col("fee_payer").isNotNull() & (F.col("fee_payer") != "")
    parsed = F.col("parsed") == 1
    per_wallet = ok.groupBy("mint", "fee_payer").agg(
        F.sum(F.when(has_wallet, weight)).alias("weight"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.max(F.col("role").startswith("buyer").cast("int")).alias("buyer"),
        F.max(F.col("role").contains("holder").cast("int")).alias("holder"),
        F.count_if(parsed & (F.col("role") != "unclassified")).alias("classified"),
        F.count_if(parsed & (F.col("role") == "unclassified")).alias("unclassified"), F.sum("parsed").alias("parsed"),
    )
    per_wallet = settle(per_wallet)
    shape = ranking.concentration(per_wallet.where(has_wallet), ["mint"], "weight")
    spans = per_wallet.groupBy("mint").agg(
        F.count_if(has_wallet).alias("early_buyers"),
        F.count_if(has_wallet & (F.col("buyer") == 1)).alias("decoded_buyer_proxy_wallets"),
        F.count_if(has_wallet & (F.col("holder") == 1)).alias("decoded_holder_proxy_wallets"),
        F.sum("classified").alias("classified_early_transactions"), F.sum("unclassified").alias("unclassified_early_transactions"),
        F.sum("parsed").alias("transactions_parsed"), F.min("first").alias("first_trade_at"), F.max("last").alias("last_early_trade_at"),
    )
    joined = tokens.join(spans, "mint", "left").join(shape, "mint", "left")
    counts = ("early_buyers", "decoded_buyer_proxy_wallets", "decoded_holder_proxy_wallets",
              "classified_early_transactions", "unclassified_early_transactions", "transactions_parsed")
    positive = F.col("total_weight") > 0
    return joined.select(
        "mint", F.col("t0").alias("launch_or_graduated_at"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
        F.when(positive, F.col("total_weight")).alias("early_buy_volume_sol_proxy"),
        *[F.when(positive, F.col(f"top{k}_share")).alias(f"top{k}_early_buyer_share") for k in (1, 5, 10)],
        F.when(positive, F.col("hhi")).alias("early_buyer_hhi"), "first_trade_at", "last_early_trade_at",
    )


SNAPSHOTS = (0, 7, 30)


def holder_snapshots(tokens: DataFrame, balances: DataFrame) -> DataFrame:
    """Holder concentration at 0, 7 and 30 days from a balance log.

    ``tokens``  mint, t0      ``balances``  mint, owner, amount, ts, seq (order among equal times)

    The latest balance before each cutoff is a conditional maximum of (time, sequence, amount): one aggregation for
    all three snapshots, combined on the map side, instead of a sort per snapshot.
    """
    joined = balances.join(tokens, "mint")
    stamp = F.struct("ts", "seq", "amount")
    owners = joined.groupBy("mint", "owner").agg(
        *[F.max(F.when(F.col("ts") <= F.col("t0") + _days(h), stamp)).alias(f"b_{h}") for h in SNAPSHOTS]
    )
    long = explode_horizons(owners, ["mint", "owner"], {"b": "b"}, SNAPSHOTS).select(
        "mint", F.col("horizon_days").alias("snapshot_horizon_days"), F.col("b.amount").alias("balance")
    ).where(F.col("balance") > 0)
    keys = ["mint", "snapshot_horizon_days"]
    shape = ranking.concentration_with_crossing(settle(long), keys, "balance", (1, 10), 0.5, "nakamoto_50_count")
    return shape.select(
        *keys, F.col("members").alias("holders"), F.col("top1_share").alias("top1_holder_share"),
        F.col("top10_share").alias("top10_holder_share"), F.col("hhi").alias("holder_hhi"), "nakamoto_50_count",
    )


ZERO_ADDRESS = "0x" + "0" * 40
BLOCK_SLACK = 2000


def holder_reconstruction(
    cohort: DataFrame, transfers: DataFrame, blocks_per_day: int, horizons: Sequence[int] = HORIZONS
) -> DataFrame:
    """Holders and top-10 share at each horizon, replayed from transfers with exact 256-bit sums.

    ``cohort``     token_id, launch_block
    ``transfers``  token_id, from_address, to_address, amount_raw (integer text), block_number

    Order does not matter for balances at a cutoff, so the replay is a signed sum per (token, holder) with one set
    of limbs per horizon. The zero address is mint and burn. Only positive balances count.
    """
    bounded = joins.bounded_join(
        transfers, cohort.withColumn("__end", F.col("launch_block") + max(horizons) * blocks_per_day + BLOCK_SLACK),
        "token_id", "block_number", "launch_block", "__end",
    )
    h = None
    for n in horizons:
        inside = F.col("block_number") <= F.col("launch_block") + n * blocks_per_day + BLOCK_SLACK
        h = F.when(inside, F.lit(n)) if h is None else h.when(inside, F.lit(n))
    negated = (
        F.when(F.col("amount") == "0", F.col("amount"))
        .when(F.col("amount").startswith("-"), F.substring("amount", 2, 80))
        .otherwise(F.concat(F.lit("-"), F.col("amount")))
    )
    legs = F.explode(F.array(
        F.struct(F.lower("from_address").alias("holder"), negated.alias("text"), F.lit(1).alias("log")),
        F.struct(F.lower("to_address").alias("holder"), F.col("amount").alias("text"), F.lit(0).alias("log")),
    )).alias("leg")
    moves = (
        bounded.withColumn("amount", F.col("amount_raw"))
        .select("token_id", h.alias("h"), legs)
        .select("token_id", "h", "leg.holder", "leg.text", "leg.log")
    )
    # one row per (token, holder), the zero address included: it carries its share of the log count
    sums = settle(wide.with_limbs(moves, "text", "v").groupBy("token_id", "holder").agg(
        F.sum("log").alias("logs"), *[c for n in horizons for c in wide.sum_limbs("v", F.col("h") <= n, f"_{n}")]
    ))
    keys = ["token_id", "horizon_days"]
    # written once: the sign test and both aggregates below would each resolve the carries again
    numbers = settle(
        explode_horizons(sums.where(F.col("holder") != ZERO_ADDRESS), ["token_id"], {p: p for p in wide.LIMBS}, horizons)
        .where(F.col("hi").isNotNull())
        .select(*keys, wide.carry(F.col("hi"), F.col("mid"), F.col("lo")).alias("number"))
    )
    held = numbers.where(wide.is_positive(F.col("number")))
    value = wide.to_double(F.col("number"))
    totals = held.groupBy(*keys).agg(F.count("*").alias("holder_count"), F.sum(value).alias("supply"))
    top = filters.top_rows(held, keys, [wide.order_key(F.col("number")).desc()], 10).groupBy(*keys).agg(F.sum(value).alias("top10"))
    logs = sums.groupBy("token_id").agg(F.sum("logs").alias("transfer_log_count"))
    grid = joins.cross_dim(cohort.select("token_id"), "horizon_days", horizons)
    out = grid.join(totals, keys, "left").join(top, keys, "left").join(logs, "token_id", "left")
    return out.select(
        *keys, F.coalesce("holder_count", F.lit(0)).alias("holder_count"),
        safe_rate(F.col("top10"), F.col("supply")).alias("holder_concentration_top10"),
        F.coalesce("transfer_log_count", F.lit(0)).alias("transfer_log_count"),
        F.when(F.col("transfer_log_count") > 0, "computed_from_transfer_logs").otherwise("no_transfer_logs_in_window").alias("holder_concentration_status"),
    )


@dataclass(frozen=True)
class QuoteSpec:
    """Which paired tokens have a dollar value and how their raw amounts scale."""

    stable: str
    native: str
    decimals: tuple[tuple[str, int], ...] = ()
    default_decimals: int = 18


def normalize_amount(raw: Column, token: Column, spec: QuoteSpec) -> Column:
    """abs(raw) / 10^decimals of the paired token."""
    decimals = F.lit(spec.default_decimals)
    for name, digits in spec.decimals:
        decimals = F.when(F.lower(token) == name, digits).otherwise(decimals)
    return F.abs(as_double(raw)) / F.pow(F.lit(10.0), decimals)


def swap_horizons(
    cohort: DataFrame, swaps: DataFrame, prices: DataFrame, spec: QuoteSpec, blocks_per_day: int, horizons: Sequence[int] = HORIZONS
) -> DataFrame:
    """Trades, sides, paired and dollar volume per launch and closed horizon.

    ``cohort``  token_id, pool_id, paired_token, launch_block, launch_unix (seconds)
    ``swaps``   pool_id, sender, block_number, timestamp_unix, amount0_raw, amount1_raw (integer text)
    ``prices``  day, native_usd

    The token is currency 0 when its address sorts first: fixed-width lower-case hex compares like the number. A
    negative token delta is a buy. Early share: the ten largest senders up to and including 60 seconds.
    """
    units = cohort.withColumn("__end", F.col("launch_block") + max(horizons) * blocks_per_day + BLOCK_SLACK).withColumn(
        "pool_id", F.lower("pool_id")
    )
    logs = joins.bounded_join(swaps.withColumn("pool_id", F.lower("pool_id")), units, "pool_id", "block_number", "launch_block", "__end")
    first = F.lower("token_id") < F.lower("paired_token")
    token_delta = F.when(first, F.col("amount0_raw")).otherwise(F.col("amount1_raw"))
    paired_delta = F.when(first, F.col("amount1_raw")).otherwise(F.col("amount0_raw"))
    age = F.col("timestamp_unix") - F.col("launch_unix")
    h = None
    for n in horizons:
        h = F.when(age <= n * 86_400, F.lit(n)) if h is None else h.when(age <= n * 86_400, F.lit(n))
    rows = logs.select(
        "token_id", F.lower("sender").alias("sender"), "timestamp_unix", age.alias("age"), h.alias("h"), token_delta.alias("d"),
        normalize_amount(paired_delta, F.col("paired_token"), spec).alias("paired"),
    ).where(F.col("h").isNotNull())
    buy, sell = F.col("d").startswith("-"), ~F.col("d").startswith("-") & (F.col("d") != "0")
    per_sender = rows.groupBy("token_id", "sender").agg(
        F.min("h").alias("h"), F.min("timestamp_unix").alias("first"),
        F.sum(F.when(F.col("age") <= 60, F.col("paired"))).alias("early"),
        *_by_horizon(lambda n: [
            F.count_if(F.col("h") <= n).alias(f"n_{n}"),
            F.count_if((F.col("h") <= n) & buy).alias(f"buys_{n}"),
            F.count_if((F.col("h") <= n) & sell).alias(f"sells_{n}"),
            F.sum(F.when(F.col("h") <= n, F.col("paired"))).alias(f"paired_{n}"),
            F.max(F.when(F.col("h") <= n, F.col("timestamp_unix"))).alias(f"last_{n}"),
        ], horizons),
    )
    per_sender = settle(per_sender)
    per_token = per_sender.groupBy("token_id").agg(*_by_horizon(lambda n: [
        F.count_if(F.col("h") <= n).alias(f"traders_{n}"),
        *[F.sum(f"{c}_{n}").alias(f"{c}_{n}") for c in ("n", "buys", "sells", "paired")],
        F.min(F.when(F.col("h") <= n, F.col("first"))).alias(f"first_{n}"), F.max(f"last_{n}").alias(f"last_{n}"),
    ], horizons))
    early = ranking.concentration(per_sender.where(F.col("early").isNotNull()), ["token_id"], "early", tops=(10,)).select(
        "token_id", F.col("top10_share").alias("early_sender_top10_share_60s")
    )
    priced = cohort.withColumn("day", F.to_date(F.timestamp_seconds("launch_unix"))).join(prices, "day", "left")
    base = priced.join(per_token, "token_id", "left").join(early, "token_id", "left")
    keep = ["token_id", "paired_token", "native_usd", "early_sender_top10_share_60s"]
    out = explode_horizons(base, keep, {
        "swap_count": "n", "active_traders": "traders", "buy_count": "buys", "sell_count": "sells", "paired_volume": "paired",
        "first_trade_unix": "first", "last_trade_unix": "last",
    }, horizons)
    paired = F.lower("paired_token")
    volume = F.coalesce("paired_volume", F.lit(0.0))
    usd = F.when(paired == spec.stable, volume).when(paired == spec.native, volume * F.col("native_usd"))
    return out.select(
        "token_id", "horizon_days", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("swap_count", "active_traders", "buy_count", "sell_count")],
        volume.alias("paired_volume"), usd.alias("volume_usd"), "first_trade_unix", "last_trade_unix", "early_sender_top10_share_60s",
    )


def decoded_outcomes(swaps: DataFrame, pairs: DataFrame, status: DataFrame) -> DataFrame:
    """Outcomes per scanned (mint, horizon) window; the scan status drives the rows, so empty windows appear.

    ``swaps``   mint, horizon_days, transaction_hash, transaction_index, transaction_type, wallet_address, total_value_usd, ts
    ``pairs``   mint, pair_address, exchange_name, liquidity_usd, volume_24h_usd
    ``status``  mint, horizon_days, t0, window_status, rows_fetched
    """
    keys = ["mint", "horizon_days"]
    rows = swaps.dropDuplicates([*keys, "transaction_hash", "transaction_index"]).withColumn("kind", F.lower("transaction_type"))
    is_buy, is_sell, usd = F.col("kind") == "buy", F.col("kind") == "sell", F.col("total_value_usd")
    per_wallet = rows.groupBy(*keys, "wallet_address").agg(
        F.count("*").alias("n"), F.count_if(is_buy).alias("buys"), F.count_if(is_sell).alias("sells"), F.sum(usd).alias("usd"),
        F.sum(F.when(is_buy, usd)).alias("buy_usd"), F.sum(F.when(is_sell, usd)).alias("sell_usd"), F.max(usd).alias("top"),
        F.min("ts").alias("first"), F.max("ts").alias("last"),
    )
    named = F.col("wallet_address").isNotNull() & (F.col("wallet_address") != "")
    per_window = per_wallet.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n", "buys", "sells", "usd", "buy_usd", "sell_usd")], F.max("top").alias("top"),
        F.count_if(named).alias("traders"), F.count_if(named & (F.col("buys") > 0)).alias("buyers"),
        F.count_if(named & (F.col("sells") > 0)).alias("sellers"), F.min("first").alias("first"), F.max("last").alias("last"),
    )
    medians = ranking.quantiles(rows, keys, "total_value_usd", {"median_trade_size_usd": 0.5})
    best = joins.best_by(pairs, ["mint"], ["volume_24h_usd", "liquidity_usd"], [F.col("pair_address")])
    pair_counts = pairs.select("mint", "pair_address").distinct().groupBy("mint").agg(F.count("pair_address").alias("pair_count"))
    out = (
        status.join(per_window, keys, "left").join(medians, keys, "left").join(pair_counts, "mint", "left")
        .join(best.select("mint", F.col("pair_address").alias("top_pair_address"), F.col("volume_24h_usd").alias("top_pair_volume_24h_usd")), "mint", "left")
    )
    n = lambda c, name: F.coalesce(F.col(c), F.lit(0)).alias(name)
    both = F.col("buys") + F.col("sells")
    return out.select(
        *keys, F.col("t0").alias("graduated_at"), n("n", "decoded_trade_count"), n("buys", "decoded_buy_count"), n("sells", "decoded_sell_count"),
        F.coalesce("usd", F.lit(0.0)).alias("decoded_volume_usd"), F.coalesce("buy_usd", F.lit(0.0)).alias("decoded_buy_volume_usd"),
        F.coalesce("sell_usd", F.lit(0.0)).alias("decoded_sell_volume_usd"),
        n("traders", "decoded_active_traders"), n("buyers", "decoded_buyer_count"), n("sellers", "decoded_seller_count"),
        safe_rate(F.col("buys") - F.col("sells"), both).alias("buy_sell_imbalance"), "median_trade_size_usd",
        F.col("top").alias("max_trade_size_usd"), F.col("first").alias("first_decoded_trade_at"), F.col("last").alias("last_decoded_trade_at"),
        "window_status", "rows_fetched", n("pair_count", "pair_count"), "top_pair_address", "top_pair_volume_24h_usd",
    )


@dataclass(frozen=True)
class CohortCalendar:
    """First and last cohort day and, per outcome family, the inclusive pre and post ranges."""

    first: str
    last: str
    periods: tuple[tuple[str, tuple[str, str], tuple[str, str]], ...]


def cohort_panel(launches: DataFrame, migrations: DataFrame, platforms: Sequence[str], calendar: CohortCalendar) -> DataFrame:
    """Daily launch cohorts per platform on a full calendar, with 7 and 30 day migration rates.

    ``launches``    platform, token_id, creator_id, created_at, creation_tx
    ``migrations``  platform, token_id, migrated_at
    """
    day = F.to_date("created_at")
    in_range = launches.where(day.between(F.lit(calendar.first).cast("date"), F.lit(calendar.last).cast("date")))
    keys = ["platform", "token_id"]
    unique = filters.top_rows(in_range.where(F.col("token_id").isNotNull()), keys, [F.asc("created_at"), F.asc("creation_tx")])
    moved = migrations.groupBy(*keys).agg(F.min("migrated_at").alias("migrated_at"))
    cohorts = unique.join(moved, keys, "left").select(
        "platform", day.alias("cohort_date"), "creator_id",
        *[F.when(F.col("migrated_at").between(F.col("created_at"), F.col("created_at") + _days(h)), 1).otherwise(0).alias(f"graduated_{h}d") for h in (7, 30)],
    )
    daily = aggregates.daily_cohorts(cohorts, ["platform", "cohort_date"], "creator_id", ["graduated_7d", "graduated_30d"])
    full = reshape.densify(
        daily, "platform", platforms, "cohort_date", calendar.first, calendar.last,
        ["launches", "unique_creators", "graduated_7d", "graduated_30d"], ["graduated_7d_rate", "graduated_30d_rate"],
    )
    labels = [period_label(F.col("cohort_date"), pre, post).alias(name) for name, pre, post in calendar.periods]
    return full.select(
        "platform", "cohort_date", *labels, "launches", "unique_creators", "graduated_7d", F.col("graduated_7d_rate").alias("graduation_rate_7d"),
        "graduated_30d", F.col("graduated_30d_rate").alias("graduation_rate_30d"),
    )


@dataclass(frozen=True)
class CallSpec:
    """Program account and the 8-byte discriminators (hex) of its create and migrate calls."""

    program: str
    create: str
    migrate: str
    create_token_position: int = 1
    migrate_token_position: int = 3


def token_cohorts(calls: DataFrame, spec: CallSpec, first: str, last: str, as_of: str) -> DataFrame:
    """Creation calls with censored 7 and 30 day migration outcomes.

    ``calls``  executing_account, data (binary), success, ts, tx, signer, accounts (array of string)
    """
    low, high = F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")

    def of(kind: str, until: Column) -> DataFrame:
        return calls.where(
            (F.col("executing_account") == spec.program) & F.col("success") & (F.hex(F.substring("data", 1, 8)) == kind.upper())
            & F.col("ts").between(low, until)
        )

    creates = of(spec.create, high).select(
        F.get("accounts", F.lit(spec.create_token_position - 1)).alias("token_id"), F.col("signer").alias("creator_id"),
        F.col("ts").alias("created_at"), F.col("tx").alias("creation_tx"),
    )
    moves = of(spec.migrate, high + _days(30)).select(
        F.get("accounts", F.lit(spec.migrate_token_position - 1)).alias("token_id"), F.col("ts").alias("migrated_at"), F.col("tx").alias("migration_tx")
    )
    now = F.lit(as_of).cast("timestamp_ntz")
    return creates.join(moves, "token_id", "left").select(
        "token_id", "creator_id", "created_at", F.to_date("created_at").alias("cohort_date"), "migrated_at",
        *[censored_outcome(F.col("created_at"), F.col("migrated_at"), h, now).alias(f"graduated_{h}d") for h in (7, 30)],
        "creation_tx", "migration_tx",
    )


def lifecycle_summary(df: DataFrame) -> DataFrame:
    """One row over launches with outcomes.

    Columns used: graduated (0/1), timed_out (0/1), minutes_seen, minutes_chain, initial_cap, has_any_social (0/1),
    has_channel (0/1). Quantiles of all measures come from one counting pass.
    """
    def rate(flag: Column) -> Column:
        return F.avg(F.when(flag, F.col("graduated").cast("double")))

    row = df.agg(
        F.count("*").alias("total_tokens"), F.sum("graduated").alias("graduated_tokens"), F.sum("timed_out").alias("timeout_tokens"),
        F.avg(F.col("graduated").cast("double")).alias("graduation_rate"),
        (F.avg(F.col("timed_out").cast("double")) * 1000).alias("timeout_incidence_per_1000"),
        rate(F.col("has_any_social") == 0).alias("no_social_graduation_rate"), rate(F.col("has_any_social") == 1).alias("any_social_graduation_rate"),
        rate(F.col("has_channel") == 1).alias("channel_graduation_rate"), rate(F.col("has_channel") == 0).alias("no_channel_graduation_rate"),
    )
    done = F.col("graduated") == 1
    long = df.select(
        F.when(done, F.col("minutes_seen")).alias("minutes_seen"), F.when(done, F.col("minutes_chain")).alias("minutes_chain"), F.col("initial_cap"),
    ).select(F.explode(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in ("minutes_seen", "minutes_chain", "initial_cap")])).alias("x")).select("x.m", "x.v")
    wide_q = ranking.quantiles(long, ["m"], "v", {"p50": 0.5, "p90": 0.9}).agg(
        F.max(F.when(F.col("m") == "minutes_seen", F.col("p50"))).alias("median_minutes_to_graduation_seen"),
        F.max(F.when(F.col("m") == "minutes_chain", F.col("p50"))).alias("median_minutes_to_graduation_chain"),
        F.max(F.when(F.col("m") == "initial_cap", F.col("p50"))).alias("median_initial_cap"),
        F.max(F.when(F.col("m") == "initial_cap", F.col("p90"))).alias("p90_initial_cap"),
    )
    return ranking.with_quantiles(row, [], wide_q)


# Labels that mean a concentrated holder base or a high risk.
CONCENTRATED = ("whale_dominated", "concentrated")
HIGH_RISK = ("high", "critical")


def risk_summary(snapshots: DataFrame) -> DataFrame:
    """Latest snapshot per mint: market, bonding and concentration rates and the risk difference between groups.

    ``snapshots``  mint, snapshot_at, volume_24h, liquidity, bonding_progress, holder_concentration, top10_holder_pct, risk_level
    """
    latest = filters.latest_per_key(snapshots, ["mint"], "snapshot_at")
    top10 = clip(F.col("top10_holder_pct"), 0.0, 100.0)
    heavy = F.coalesce(F.col("holder_concentration").isin(*CONCENTRATED), F.lit(False)) | F.coalesce(top10 >= 80, F.lit(False))
    risky = F.coalesce(F.col("risk_level").isin(*HIGH_RISK), F.lit(False)).cast("double")
    yes = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    row = latest.select("*", heavy.alias("heavy"), risky.alias("risky"), top10.alias("top10")).agg(
        F.count("*").alias("rows"),
        yes((F.col("volume_24h") > 0) & (F.col("liquidity") > 0)).alias("active_market_rate"),
        yes(F.col("bonding_progress") >= 100).alias("completed_bonding_rate"),
        yes(F.col("heavy")).alias("high_concentration_rate"), F.avg("risky").alias("high_or_critical_risk_rate"),
        (F.avg(F.when(F.col("heavy"), F.col("risky"))) - F.avg(F.when(~F.col("heavy"), F.col("risky")))).alias("risk_rate_difference"),
        F.count_if(F.col("top10_holder_pct") > 100).alias("invalid_top10_gt100_rows"),
    )
    names = {"volume_24h": "v", "liquidity": "l", "top10": "t"}
    long = latest.withColumn("top10", top10).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in names])).alias("x")).select("x.m", "x.v")
    q = ranking.quantiles(long, ["m"], "v", {"p50": 0.5, "p90": 0.9}).agg(
        F.max(F.when(F.col("m") == "volume_24h", F.col("p50"))).alias("median_volume_24h"),
        F.max(F.when(F.col("m") == "liquidity", F.col("p50"))).alias("median_liquidity"),
        F.max(F.when(F.col("m") == "top10", F.col("p50"))).alias("median_top10_holder_pct"),
        F.max(F.when(F.col("m") == "top10", F.col("p90"))).alias("p90_top10_holder_pct"),
    )
    return ranking.with_quantiles(row, [], q)


def compare_by_flag(df: DataFrame, horizon: str, metrics: Sequence[str], flag: str) -> DataFrame:
    """Count, mean and median per horizon and metric for flag 1 and 0, with the difference of medians."""
    stats = aggregates.agg_stats(df, [horizon, flag], metrics)
    pick = lambda value, column: F.max(F.when(F.col(flag) == value, F.col(column)))
    wide_ = stats.groupBy(horizon, "metric").agg(
        pick(1, "n").alias("n_treated"), pick(0, "n").alias("n_control"), pick(1, "mean").alias("treated_mean"), pick(0, "mean").alias("control_mean"),
        pick(1, "median").alias("treated_median"), pick(0, "median").alias("control_median"),
    )
    return wide_.where(F.col("treated_median").isNotNull() & F.col("control_median").isNotNull()).withColumn(
        "effect", F.col("treated_median") - F.col("control_median")
    )
