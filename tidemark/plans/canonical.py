"""Builders of the canonical tables: raw string logs in, typed tables with coverage states out.

Each builder returns a dict of frames that follow ``sources.schemas``; ``sinks.write_release`` publishes them together.
Joins that feed several tables are settled once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import as_bool, as_double, as_long, blank_to_null, event_id, launch_id, parse_ts, token_id
from tidemark.operators import filters, joins, sets
from tidemark.session import settle
from tidemark.sources import schemas
from tidemark.sources.sinks import typed


@dataclass(frozen=True)
class Release:
    """Identity of a release; leads every canonical row."""

    version: str
    chain: str
    platform: str


def _stamped(df: DataFrame, release: Release, schema) -> DataFrame:
    return typed(
        df.withColumn("dataset_version", F.lit(release.version)).withColumn("chain_id", F.lit(release.chain)).withColumn("platform_id", F.lit(release.platform)),
        schema,
    )


# --- single-chain tables from launch and outcome exports -------------------------------------------------------------


def build_baseline(launches: DataFrame, outcomes: DataFrame, release: Release, order: str = "ordinal") -> tuple[dict[str, DataFrame], DataFrame]:
    """(tokens, launches, lifecycle_events) and the counters of everything dropped.

    First launch per mint; a graduation beats a timeout, then the first outcome; a graduation needs positive minutes.
    """
    minutes = as_double(F.col("minutes_to_outcome"))
    graduated = F.col("outcome") == "GRADUATED"
    kept, reasons = filters.filter_with_reasons(outcomes, {
        "malformed_outcome": ~F.coalesce(F.col("outcome").isin("GRADUATED", "TIMEOUT"), F.lit(False)),
        "nonpositive_graduation_time": graduated & (minutes.isNull() | (minutes <= 0)),
        "missing_mint": F.col("mint").isNull() | (F.col("mint") == ""),
    })
    best = filters.dedupe_priority(kept, ["mint"], graduated.cast("int"), [F.asc(order)]).drop(order)
    first = filters.dedupe_first(launches, ["mint"], [F.asc(order)]).drop(order)
    joined = settle(first.join(best, "mint"))
    flags = {c: as_bool(F.col(c), False) for c in ("has_twitter", "has_website", "has_telegram")}
    created = parse_ts(F.col("created_timestamp"), "digits_ms")
    base = joined.withColumn("token_id", token_id(release.chain, F.col("mint"), False)).withColumn("created", created)
    tables = {
        "tokens": base.withColumn("created_at", F.col("created")),
        "launches": base.select(
            "token_id", "mint", F.col("created").alias("launch_at"), parse_ts(F.col("seenAt"), "digits_ms").alias("observed_at"),
            as_double(F.col("initial_market_cap_sol")).alias("initial_market_cap_sol"), as_long(F.col("description_length")).alias("description_length"),
            *[v.alias(k) for k, v in flags.items()], sum((v.cast("int") for v in flags.values()), F.lit(0)).alias("social_count"),
            F.lit("launch_record").alias("source_record_type"),
        ),
        "lifecycle_events": base.select(
            "token_id", "mint", F.lower("outcome").alias("event_type"), parse_ts(F.col("graduated_at"), "digits_ms").alias("event_at"),
            as_double(F.col("minutes_to_outcome")).alias("minutes_from_launch_observed"), as_double(F.col("minutes_to_outcome_chain")).alias("minutes_from_launch_chain"),
            as_double(F.col("final_market_cap_sol")).alias("final_market_cap_sol"), as_double(F.col("detection_lag_min")).alias("detection_lag_minutes"),
            F.lit("terminal_outcome").alias("source_record_type"),
        ),
    }
    return {n: _stamped(df, release, schemas.SINGLE_CHAIN[n]) for n, df in tables.items()}, reasons


def _typed_columns(df: DataFrame, schema, renames: dict[str, str], mode: str = "digits_ms") -> DataFrame:
    """Parse every column of a string export by its target type; blanks become null."""
    present = set(df.columns)
    out = []
    for f in schema.fields:
        source = renames.get(f.name, f.name)
        if source not in present:
            continue
        raw = F.col(source)
        kind = f.dataType.typeName()
        value = {
            "timestamp": lambda c: parse_ts(c, mode), "double": as_double, "boolean": lambda c: as_bool(c, False),
            "short": lambda c: as_long(c).cast("smallint"), "byte": lambda c: as_long(c).cast("tinyint"), "long": as_long,
        }.get(kind, blank_to_null)(raw)
        out.append(value.alias(f.name))
    return df.select(*out)


def _with_token(df: DataFrame, release: Release) -> DataFrame:
    return df.withColumn("token_id", token_id(release.chain, F.col("mint"), False))


def build_metadata(rows: DataFrame, release: Release) -> DataFrame:
    schema = schemas.SINGLE_CHAIN["token_metadata"]
    renames = {"metadata_complete": "complete", "ath_market_cap_usd": "ath_market_cap", "current_market_cap_usd": "usd_market_cap", "total_supply_raw": "total_supply"}
    return _stamped(_with_token(_typed_columns(rows, schema, renames), release), release, schema)


def build_pool_windows(rows: DataFrame, release: Release) -> DataFrame:
    schema = schemas.SINGLE_CHAIN["pool_windows"]
    renames = {"transaction_proxy_count": "swap_count", "window_status": "signature_window_status"}
    out = _with_token(_typed_columns(rows, schema, renames), release).withColumn("metric_semantics", F.lit("pool transaction proxy; not decoded swaps"))
    return _stamped(out, release, schema)


def build_swaps(rows: DataFrame, release: Release) -> DataFrame:
    schema = schemas.SINGLE_CHAIN["decoded_swaps"]
    return _stamped(_with_token(_typed_columns(rows, schema, {}), release), release, schema)


def build_horizons(rows: DataFrame, release: Release, status: str = "source_window_status", swaps: str = "source_swaps_fetched", pages: str = "source_pages_fetched") -> DataFrame:
    schema = schemas.SINGLE_CHAIN["token_horizons"]
    renames = {"window_status": status, "swaps_fetched": swaps, "pages_fetched": pages}
    out = _with_token(_typed_columns(rows, schema, renames), release)
    out = out.withColumn("window_status", F.coalesce("window_status", F.lit(""))).withColumn("is_complete_window", F.col("window_status") == "ok")
    return _stamped(out, release, schema)


def coverage_single_chain(events: DataFrame, metadata: DataFrame, windows: DataFrame, swaps: DataFrame, horizons: DataFrame, release: Release) -> DataFrame:
    """One row per graduated token; complete only with three windows that are all complete."""
    graduated = events.where("event_type = 'graduated'").groupBy("mint").agg(F.max("event_at").alias("graduated_at"))
    meta = metadata.groupBy("mint").agg(F.max(F.coalesce(F.col("pool_address").isNotNull() & (F.col("pool_address") != ""), F.lit(False))).alias("has_pool"))
    pools = windows.groupBy("mint").agg(F.count("*").alias("pool_rows"))
    traded = swaps.select("mint").distinct().withColumn("has_swaps", F.lit(True))
    decoded = horizons.groupBy("mint").agg(F.count("*").alias("rows"), F.count_if("is_complete_window").alias("complete"))
    joined = graduated.join(meta, "mint", "left").join(pools, "mint", "left").join(traded, "mint", "left").join(decoded, "mint", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    # Coverage labels.
    status = (
        F.when(n("rows") == 0, "no_decoded_swap_data")
        .when((n("rows") == 3) & (n("complete") == 3), "decoded_complete_1_7_30d")
        .otherwise("decoded_lower_bound_page_capped")
    )
    out = _with_token(joined, release).select(
        "token_id", "mint", "graduated_at", F.col("has_pool").isNotNull().alias("metadata_available"), F.coalesce("has_pool", F.lit(False)).alias("pool_address_available"),
        n("pool_rows").alias("rpc_windows_available"), n("rows").alias("decoded_windows_available"), F.coalesce("has_swaps", F.lit(False)).alias("decoded_swaps_available"),
        n("complete").alias("decoded_windows_complete"), status.alias("coverage_status"),
    )
    return _stamped(out, release, schemas.SINGLE_CHAIN["coverage_ledger"])


# --- cross-chain tables -----------------------------------------------------------------------------------------------

ZERO_ADDRESS = "0x" + "0" * 40


@dataclass(frozen=True)
class Origins:
    """Names of the sources that observations are credited to."""

    launch: str
    lifecycle: str
    metadata: str = ""
    pool_history: str = ""
    pool_mapping: str = ""


def state(observed: Column, applicable: Column, missing: str = "not_collected") -> Column:
    """Three-state coverage: observed, else not applicable, else the stated kind of missing."""
    return F.when(observed, "observed").when(~applicable, "not_applicable").otherwise(missing)


def ledger_row(df: DataFrame, states: dict[str, Column], complete: Column, metadata: Column, trading: str, limitation: str) -> DataFrame:
    """Coverage ledger columns from the joined facts of a token."""
    return df.select(
        "token_id", F.lit(True).alias("launch_available"), metadata.alias("metadata_available"), F.lit(False).alias("state_snapshot_available"),
        F.lit(False).alias("decoded_swaps_available"), F.lit("observed").alias("creator_status"), F.lit("observed").alias("protocol_config_status"),
        *[v.alias(f"{k}_status") for k, v in states.items()], F.lit(trading).alias("decoded_swaps_status"), F.lit(trading).alias("holder_data_status"),
        F.lit(trading).alias("trading_data_status"), F.when(complete, "canonical_core_complete").otherwise("canonical_core_partial").alias("coverage_status"),
        F.lit(limitation).alias("limitation"),
    )


def _event(df: DataFrame, kind: Column | str, tx: str, log: str, at: str, block: str, source: Column | str, prefix: bool = True) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    source = F.lit(source) if isinstance(source, str) else source
    return df.select(
        event_id(F.col("token_id"), F.concat(F.lit("lifecycle:"), kind) if prefix else F.lit("liquidity"), F.col(tx), F.col(log)).alias("lifecycle_event_id"),
        "token_id", F.col("pool_id"), kind.alias("event_type"), F.col(at).alias("event_at"), F.col(block).alias("block_number"), F.col(tx).alias("transaction_hash"),
        F.col(log).cast("bigint").alias("log_index"), F.lit("observed").alias("observation_status"), source.alias("source_id"),
    )


def last_record(df: DataFrame, key: str, packed: str = "") -> DataFrame:
    """One record per key: the last in file order when the frame has an ``ordinal``, else the largest one.

    A maximum of structs combines on the map side and does not depend on row order.
    """
    fields = [c for c in df.columns if c not in (key, "ordinal")]
    record = F.struct(*fields)
    last = F.max_by(record, F.col("ordinal")) if "ordinal" in df.columns else F.max(record)
    out = df.groupBy(key).agg(last.alias(packed or "__r"))
    return out if packed else out.select(key, "__r.*")


@dataclass(frozen=True)
class DirectSpec:
    """A launchpad whose launches go straight to a pool."""

    release: Release
    origins: Origins
    factory: str
    pool_manager: str
    limitation: str = ""


def build_direct(launches: DataFrame, pool_events: DataFrame, spec: DirectSpec) -> dict[str, DataFrame]:
    """Launches with pools and liquidity; first launch per token in chain order.

    ``launches``     string columns of created events: token_id, block_number, log_index, transaction_hash, block_timestamp_utc, ...
    ``pool_events``  pool_id, event_type (pool_initialized | initial_liquidity_modified), block_timestamp_unix, transaction_hash,
                     log_index, block_number, currency0, currency1, fee, tick_spacing, hooks, sqrt_price_x96, initial_tick,
                     pool_manager, sender, tick_lower, tick_upper, liquidity_delta, salt
    """
    chain = spec.release.chain
    order = [F.coalesce(as_long(F.col("block_number")), F.lit(0)).asc(), F.coalesce(as_long(F.col("log_index")), F.lit(0)).asc()]
    first = filters.dedupe_first(launches.withColumn("address", F.lower("token_id")), ["address"], order)
    first = first.withColumn("token_id", token_id(chain, F.col("address"), True)).withColumn("created_at", parse_ts(F.col("block_timestamp_utc"), "seconds")).withColumn(
        "pool_key", F.lower("pool_id")
    )
    first = settle(first)
    opened = filters.top_rows(pool_events.where("event_type = 'pool_initialized'"), ["pool_id"], [as_long(F.col("block_number")).desc(), as_long(F.col("log_index")).desc(), F.desc("transaction_hash")])
    opened = opened.select(
        F.col("pool_id").alias("pool_key"), F.lit(True).alias("opened"), parse_ts(F.col("block_timestamp_unix"), "seconds").alias("init_at"), F.col("transaction_hash").alias("init_tx"),
        as_long(F.col("log_index")).alias("init_log"), as_long(F.col("block_number")).alias("init_block"), F.col("pool_manager").alias("init_manager"), "currency0", "currency1",
        as_long(F.col("fee")).alias("fee_hundredths_bip"), as_long(F.col("tick_spacing")).alias("tick_spacing"), "hooks", "sqrt_price_x96", as_long(F.col("initial_tick")).alias("initial_tick"),
    )
    positive = ~F.col("liquidity_delta").startswith("-") & ~F.col("liquidity_delta").rlike(r"^0*$")
    moved = pool_events.where("event_type = 'initial_liquidity_modified'").select(
        F.col("pool_id").alias("pool_key"), parse_ts(F.col("block_timestamp_unix"), "seconds").alias("event_at"), F.col("transaction_hash").alias("liq_tx"),
        as_long(F.col("log_index")).alias("liq_log"), as_long(F.col("block_number")).alias("liq_block"), "sender", as_long(F.col("tick_lower")).alias("tick_lower"),
        as_long(F.col("tick_upper")).alias("tick_upper"), F.col("liquidity_delta").alias("liquidity_delta_raw"), "salt", positive.alias("positive"),
    )
    facts = moved.groupBy("pool_key").agg(F.count("*").alias("moves"), F.count_if("positive").alias("adds"))
    pooled = settle(first.join(opened, "pool_key", "left").join(facts, "pool_key", "left").withColumn("opened", F.coalesce("opened", F.lit(False))))
    liquidity = first.select("pool_key", "token_id").join(moved, "pool_key").withColumn("pool_id", F.col("pool_key"))
    o = spec.origins
    blank = blank_to_null
    block, log = as_long(F.col("block_number")), as_long(F.col("log_index"))
    opened_col = F.col("opened")
    events = sets.union_panel([
        _event(first.withColumn("pool_id", F.col("pool_key")).withColumn("block_number", block), "token_created", "transaction_hash", "log_index", "created_at", "block_number", o.launch),
        _event(pooled.where("opened").withColumn("pool_id", F.col("pool_key")), "pool_initialized", "init_tx", "init_log", "init_at", "init_block", o.lifecycle),
        _event(liquidity, F.when(F.col("positive"), "initial_liquidity_added").otherwise("liquidity_position_poked"), "liq_tx", "liq_log", "event_at", "liq_block", o.lifecycle, prefix=False),
    ])
    adds = F.coalesce(F.col("adds"), F.lit(0)) > 0
    always = F.lit(True)
    tables = {
        "tokens": first.select("token_id", "address", blank(F.col("token_admin")).alias("creator"), "created_at", blank(F.col("extensions_supply_raw")).alias("total_supply_raw"),
                               F.lit(o.launch).alias("source_id"), blank(F.col("event_id")).alias("source_record_id")),
        "launches": first.select(
            launch_id(F.col("token_id"), F.lower("transaction_hash"), F.col("log_index")).alias("launch_id"), "token_id", F.col("created_at").alias("launch_at"), block.alias("block_number"),
            "transaction_hash", log.alias("log_index"), F.lit(spec.factory).alias("factory_or_manager"), blank(F.col("pool_id")).alias("pool_id"), blank(F.col("paired_token")).alias("paired_token"),
            blank(F.col("version_class")).alias("protocol_version"), F.lit("created").alias("launch_status"), F.lit(o.launch).alias("source_id"), F.lit("authoritative_window").alias("coverage_role")),
        "protocol_config": first.select(
            "token_id", blank(F.col("token_admin")).alias("creator"), blank(F.col("msg_sender")).alias("message_sender"), as_long(F.col("starting_tick")).alias("starting_tick"),
            *[blank(F.col(c)).alias(c) for c in ("pool_hook", "pool_hook_label", "locker", "mev_module", "mev_module_label", "extensions_supply_raw")],
            blank(F.col("version_class")).alias("protocol_version"), F.lit(spec.factory).alias("manager_address"),
            *[F.lit("observed").alias(c) for c in ("version_status", "module_status", "observation_status")], F.lit(o.launch).alias("source_id")),
        "pools": pooled.select(
            "token_id", F.col("pool_key").alias("pool_id"), F.coalesce("init_manager", F.lit(spec.pool_manager)).alias("pool_manager"), "currency0", "currency1", "fee_hundredths_bip",
            "tick_spacing", "hooks", "sqrt_price_x96", "initial_tick", F.col("init_at").alias("initialized_at"), F.col("init_tx").alias("initialization_transaction_hash"),
            F.col("init_log").alias("initialization_log_index"), F.lit("observed").alias("mapping_status"),
            F.when(opened_col, "observed").otherwise("processed_zero_rows").alias("initialization_status"), F.when(opened_col, o.lifecycle).otherwise(o.launch).alias("source_id")),
        "liquidity_initializations": liquidity.where("positive").select(
            event_id(F.col("token_id"), "liquidity", F.col("liq_tx"), F.col("liq_log")).alias("liquidity_event_id"), "token_id", "pool_id", "event_at", F.col("liq_block").alias("block_number"),
            F.col("liq_tx").alias("transaction_hash"), F.col("liq_log").alias("log_index"), "sender", "tick_lower", "tick_upper", "liquidity_delta_raw", "salt",
            F.lit("observed").alias("observation_status"), F.lit(o.lifecycle).alias("source_id")),
        "lifecycle_events": events,
        "coverage_ledger": ledger_row(pooled, {
            "pool_mapping": F.lit("observed"), "pool_initialization": state(opened_col, always, "processed_zero_rows"), "liquidity_initialization": state(adds, always, "processed_zero_rows"),
            "graduation": F.lit("not_applicable"), "migration": F.lit("not_applicable"),
        }, opened_col & (F.coalesce(F.col("moves"), F.lit(0)) > 0), F.lit(False), "not_collected_by_policy", spec.limitation),
    }
    return {n: _stamped(df, spec.release, schemas.CROSS_CHAIN[n]) for n, df in tables.items()}


@dataclass(frozen=True)
class GraduatingSpec:
    """A launchpad whose tokens move to a pool when they graduate; one spec per release."""

    release: Release
    origins: Origins
    wrapped_native: str = ""
    manager: str = ""
    paired: str = ""
    liquidity_event: str = "LiquidityAdded"
    fallback_type: str = "liquidity_added"
    limitation: str = ""
    extra: dict[str, str] = field(default_factory=dict)


def build_graduating(launches: DataFrame, lifecycle: DataFrame, metadata: DataFrame, existing_pools: DataFrame, pool_history: DataFrame, spec: GraduatingSpec) -> dict[str, DataFrame]:
    """Launches that may later add liquidity or stop trading, with the pool found in up to three sources.

    Pool address: lifecycle record, else the existing mapping. Pool creation: the lifecycle record's own log, else the
    pool history. A zero-address quote is the wrapped native coin. A stopped trade keeps its literal name.
    """
    chain, o = spec.release.chain, spec.origins
    by_token = lambda df: df.withColumn("__address", F.lower("token_address")).drop("token_address")
    life = last_record(by_token(lifecycle), "__address")
    life = life.select("__address", F.lit(True).alias("has_life"), *[F.col(c).alias(f"life_{c}") for c in life.columns if c != "__address"])
    mapped = last_record(by_token(existing_pools.where("mapping_status = 'observed' AND pool_address <> ''")), "__address")
    mapped = mapped.select("__address", F.lit(True).alias("has_map"), *[F.col(c).alias(f"map_{c}") for c in mapped.columns if c != "__address"])
    hist = last_record(by_token(pool_history.where("initialization_status = 'observed' AND pool_address_matches_lifecycle")), "__address")
    hist = hist.select("__address", F.lit(True).alias("has_hist"), *[F.col(c).alias(f"hist_{c}") for c in hist.columns if c != "__address"])
    api = last_record(by_token(metadata), "__address")
    api = api.select("__address", F.lit(True).alias("has_api"), F.col("img").alias("image_url"), F.col("tag").alias("category"))
    base = launches.withColumn("__address", F.lower("token_address")).withColumn("token_id", token_id(chain, F.col("token_address"), True))
    for right in (life, mapped, hist, api):
        base = base.join(right, "__address", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    quote = F.when(F.lower("life_quote_address") == ZERO_ADDRESS, F.lit(spec.wrapped_native)).otherwise(F.col("life_quote_address"))
    own_log = F.col("life_pair_created_log_index").isNotNull()
    base = (
        base.withColumn("created_at", parse_ts(F.col("launch_time_unix"), "seconds"))
        .withColumn("pool_id", F.coalesce(blank_to_null(F.col("life_pool_address")), F.col("map_pool_address")))
        .withColumn("quote", F.when(has("has_life"), F.coalesce(blank_to_null(F.col("map_normalized_quote_address")), quote)))
        .withColumn("life_at", parse_ts(F.col("life_block_timestamp_unix"), "seconds"))
        .withColumn("added", F.coalesce(F.col("life_event_name") == spec.liquidity_event, F.lit(False)))
        .withColumn("pair_created", has("has_life") & (own_log | has("has_hist")))
        .withColumn("init_at", F.when(own_log, F.col("life_at")).otherwise(parse_ts(F.col("hist_creation_block_timestamp_unix"), "seconds")))
        .withColumn("init_tx", F.when(own_log, F.col("life_transaction_hash")).otherwise(F.col("hist_creation_transaction_hash")))
        .withColumn("init_log", as_long(F.when(own_log, F.col("life_pair_created_log_index")).otherwise(F.col("hist_creation_log_index"))))
        .withColumn("init_block", as_long(F.when(own_log, F.col("life_block_number")).otherwise(F.col("hist_creation_block_number"))))
        .withColumn("init_source", F.when(own_log, o.lifecycle).otherwise(o.pool_history))
        .withColumn("life_block", as_long(F.col("life_block_number")))
        .withColumn("block_number", as_long(F.col("block_number")))
    )
    # amounts without a mint log follow the pool's currency order
    no_mint = F.col("life_amount0_raw").isNull() & has("has_map")
    token_first = F.col("__address") == F.col("map_currency0")
    base = (
        base.withColumn("amount0_raw", F.when(no_mint, F.when(token_first, F.col("life_offers_raw")).otherwise(F.col("life_funds_raw"))).otherwise(F.col("life_amount0_raw")))
        .withColumn("amount1_raw", F.when(no_mint, F.when(token_first, F.col("life_funds_raw")).otherwise(F.col("life_offers_raw"))).otherwise(F.col("life_amount1_raw")))
        .withColumn("liq_log", F.when(no_mint, F.col("life_log_index")).otherwise(F.col("life_liquidity_mint_log_index")))
        .withColumn("liq_type", F.when(no_mint, F.lit(spec.fallback_type)).otherwise(F.concat(F.coalesce("life_amm_version", F.lit("v2")), F.lit("_mint"))))
    )
    facts = settle(base)
    alive, pooled = has("has_life"), F.col("pool_id").isNotNull()
    in_pool = facts.where(alive & pooled)
    liquid = in_pool.where("added")
    applicable, mapped_col = alive, pooled
    liquid_col = alive & F.col("added") & pooled
    tables = {
        "tokens": facts.select("token_id", F.col("__address").alias("address"), "symbol", "name", "creator", "created_at", "total_supply_raw", F.lit(o.launch).alias("source_id"), F.col("request_id").alias("source_record_id")),
        "launches": facts.select(
            launch_id(F.col("token_id"), F.col("transaction_hash"), F.col("log_index")).alias("launch_id"), "token_id", F.col("created_at").alias("launch_at"), "block_number", "transaction_hash",
            as_long(F.col("log_index")).alias("log_index"), F.col("manager_address").alias("factory_or_manager"), "pool_id", F.col("pool_id").alias("pool_address"), F.col("quote").alias("paired_token"),
            F.col("manager_version").alias("protocol_version"), F.lit("created").alias("launch_status"), F.lit(o.launch).alias("source_id"), F.lit("canonical_core").alias("coverage_role")),
        "protocol_config": facts.select(
            "token_id", "creator", F.col("total_supply_raw").alias("extensions_supply_raw"), F.col("manager_version").alias("protocol_version"), "manager_address", "request_id", "launch_fee_raw",
            F.lit("observed").alias("version_status"), F.lit("not_applicable").alias("module_status"), F.lit("observed").alias("observation_status"), F.lit(o.launch).alias("source_id")),
        "pools": in_pool.select(
            "token_id", "pool_id", F.col("pool_id").alias("pool_address"), *[F.coalesce(blank_to_null(F.col(f"life_{c}")), F.col(f"map_{c}")).alias(c) for c in ("currency0", "currency1")],
            as_long(F.coalesce(F.col("life_fee_hundredths_bip"), F.col("hist_fee"))).alias("fee_hundredths_bip"), as_long(F.coalesce(F.col("life_tick_spacing"), F.col("hist_tick_spacing"))).alias("tick_spacing"),
            *[F.when(F.col("pair_created"), F.col(c)).alias(n) for c, n in (("init_at", "initialized_at"), ("init_tx", "initialization_transaction_hash"), ("init_log", "initialization_log_index"))],
            F.lit("observed").alias("mapping_status"), F.when(F.col("pair_created"), "observed").otherwise("not_collected").alias("initialization_status"),
            F.when(F.col("pair_created"), F.col("init_source")).when(blank_to_null(F.col("life_pool_address")).isNotNull(), o.lifecycle).otherwise(o.pool_mapping).alias("source_id")),
        "liquidity_initializations": liquid.select(
            event_id(F.col("token_id"), "liquidity", F.col("life_transaction_hash"), F.col("liq_log")).alias("liquidity_event_id"), "token_id", "pool_id", F.col("life_at").alias("event_at"),
            F.col("life_block").alias("block_number"), F.col("life_transaction_hash").alias("transaction_hash"), as_long(F.col("liq_log")).alias("log_index"), F.col("life_liquidity_sender").alias("sender"),
            "amount0_raw", "amount1_raw", F.col("liq_type").alias("initialization_type"), F.lit("observed").alias("observation_status"), F.lit(o.lifecycle).alias("source_id")),
        "lifecycle_events": sets.union_panel([
            _event(facts, "token_created", "transaction_hash", "log_index", "created_at", "block_number", o.launch),
            _event(facts.where(alive), F.when(F.col("added"), "liquidity_added").otherwise("trade_stopped"), "life_transaction_hash", "life_log_index", "life_at", "life_block", o.lifecycle),
            _event(in_pool.where("pair_created"), "pool_initialized", "init_tx", "init_log", "init_at", "init_block", F.col("init_source")),
            _event(liquid, "initial_liquidity_added", "life_transaction_hash", "liq_log", "life_at", "life_block", o.lifecycle),
        ]),
        "token_metadata": facts.where("has_api").select("token_id", "image_url", "category", F.lit(o.metadata).alias("source_id")),
        "coverage_ledger": ledger_row(facts, {
            "pool_mapping": state(mapped_col, applicable), "pool_initialization": state(F.col("pair_created"), applicable), "liquidity_initialization": state(liquid_col, applicable),
            "graduation": state(F.col("added"), applicable), "migration": state(mapped_col, applicable),
        }, ~applicable | (mapped_col & F.col("pair_created") & liquid_col), has("has_api"), "not_collected", spec.limitation),
    }
    return {n: _stamped(df, spec.release, schemas.CROSS_CHAIN[n]) for n, df in tables.items()}


def build_proxied(creates: DataFrame, launched: DataFrame, upgrades: DataFrame, metadata: DataFrame, spec: GraduatingSpec) -> dict[str, DataFrame]:
    """Launches behind an upgradable proxy: the implementation in force is looked up by block; times are milliseconds.

    Addresses keep their case; only the metadata lookup compares lower-cased.
    """
    chain, o = spec.release.chain, spec.origins
    typed_creates = creates.withColumn("block_number", as_long(F.col("block_number"))).withColumn("created_at", parse_ts(F.col("block_timestamp"), "millis"))
    history = upgrades.select(as_long(F.col("block_number")).alias("at"), "old_implementation", "new_implementation")
    versioned = joins.asof_lookup(typed_creates, history, "block_number", "at", "old_implementation", "new_implementation", "implementation")
    life = last_record(launched, "token_address", "l").withColumn("has_life", F.lit(True))
    api = last_record(metadata.withColumn("__lower", F.lower("contractAddress")), "__lower", "m").withColumn("has_api", F.lit(True))
    facts = versioned.join(life, "token_address", "left").withColumn("__lower", F.lower("token_address")).join(api, "__lower", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    facts = settle(
        facts.withColumn("token_id", token_id(chain, F.col("token_address"), False)).withColumn("pool_id", F.col("l.pool_address"))
        .withColumn("life_at", parse_ts(F.col("l.block_timestamp"), "millis")).withColumn("life_block", as_long(F.col("l.block_number"))).withColumn("life_tx", F.col("l.transaction_id"))
        .withColumn("life_log", as_long(F.col("l.event_index"))).withColumn("pair_log", as_long(F.col("l.pair_created_event_index"))).withColumn("mint_log", as_long(F.col("l.liquidity_mint_event_index")))
    )
    alive, pooled, minted = has("has_life"), F.col("pool_id").isNotNull(), F.col("l.amount0_raw").isNotNull()
    in_pool, liquid = facts.where(alive & pooled), facts.where(alive & pooled & minted)
    liquid_col = alive & minted
    tables = {
        "tokens": facts.select("token_id", F.col("token_address").alias("address"), F.col("m.symbol").alias("symbol"), F.col("m.name").alias("name"), "creator", "created_at",
                               as_long(F.col("m.decimals")).alias("decimals"), F.col("m.totalSupply").cast("string").alias("total_supply_raw"), F.lit(o.launch).alias("source_id"), F.col("token_index").cast("string").alias("source_record_id")),
        "launches": facts.select(
            launch_id(F.col("token_id"), F.col("transaction_id"), F.col("event_index")).alias("launch_id"), "token_id", F.col("created_at").alias("launch_at"), "block_number", F.col("transaction_id").alias("transaction_hash"),
            as_long(F.col("event_index")).alias("log_index"), F.lit(spec.manager).alias("factory_or_manager"), "pool_id", F.col("pool_id").alias("pool_address"), F.lit(spec.paired).alias("paired_token"),
            F.col("implementation").alias("protocol_version"), F.when(alive, "launched").otherwise("created").alias("launch_status"), F.lit(o.launch).alias("source_id"), F.lit("canonical_core").alias("coverage_role")),
        "protocol_config": facts.select(
            "token_id", "creator", F.col("implementation").alias("protocol_version"), F.lit(spec.manager).alias("manager_address"), F.col("implementation").alias("implementation_address"), as_long(F.col("token_index")).alias("token_index"),
            F.lit("observed").alias("version_status"), F.lit("not_applicable").alias("module_status"), F.lit("observed").alias("observation_status"), F.lit(o.launch).alias("source_id")),
        "pools": in_pool.select(
            "token_id", "pool_id", F.col("pool_id").alias("pool_address"), F.col("l.currency0").alias("currency0"), F.col("l.currency1").alias("currency1"), F.col("life_at").alias("initialized_at"),
            F.col("life_tx").alias("initialization_transaction_hash"), F.col("pair_log").alias("initialization_log_index"), F.lit("observed").alias("mapping_status"), F.lit("observed").alias("initialization_status"), F.lit(o.launch).alias("source_id")),
        "liquidity_initializations": liquid.select(
            event_id(F.col("token_id"), "liquidity", F.col("life_tx"), F.col("mint_log")).alias("liquidity_event_id"), "token_id", "pool_id", F.col("life_at").alias("event_at"), F.col("life_block").alias("block_number"),
            F.col("life_tx").alias("transaction_hash"), F.col("mint_log").alias("log_index"), F.col("l.amount0_raw").alias("amount0_raw"), F.col("l.amount1_raw").alias("amount1_raw"),
            F.lit(spec.fallback_type).alias("initialization_type"), F.lit("observed").alias("observation_status"), F.lit(o.launch).alias("source_id")),
        "lifecycle_events": sets.union_panel([
            _event(facts, "token_created", "transaction_id", "event_index", "created_at", "block_number", o.launch),
            _event(facts.where(alive), "token_launched", "life_tx", "life_log", "life_at", "life_block", o.launch),
            _event(in_pool, "pool_initialized", "life_tx", "pair_log", "life_at", "life_block", o.launch),
            _event(liquid, "initial_liquidity_added", "life_tx", "mint_log", "life_at", "life_block", o.launch),
        ]),
        "token_metadata": facts.where("has_api").select("token_id", F.col("m.description").alias("description"), F.col("m.logoUrl").alias("image_url"), F.col("m.websiteUrl").alias("website_url"),
                                                        F.col("m.twitterUrl").alias("twitter_url"), F.col("m.telegramUrl").alias("telegram_url"), F.col("m.tokenFlag").alias("category"), F.lit(o.metadata).alias("source_id")),
        "coverage_ledger": ledger_row(facts, {
            "pool_mapping": state(pooled, alive), "pool_initialization": state(pooled, alive), "liquidity_initialization": state(liquid_col, alive),
            "graduation": F.when(alive, "observed").otherwise("not_applicable"), "migration": state(pooled, alive),
        }, ~alive | (pooled & liquid_col), has("has_api"), "not_collected", spec.limitation),
    }
    return {n: _stamped(df, spec.release, schemas.CROSS_CHAIN[n]) for n, df in tables.items()}


# --- event registry and panels ---------------------------------------------------------------------------------------


def build_event_tables(events: DataFrame, evidence: DataFrame, version: str) -> dict[str, DataFrame]:
    """Typed registry and evidence; bad timestamps fail."""
    strict = lambda c: parse_ts(F.col(c), "strict").alias(c)
    def convert(df: DataFrame, times: Sequence[str], schema) -> DataFrame:
        return typed(df.select(*[strict(c) if c in times else F.col(c) for c in df.columns if c != "dataset_version"]).withColumn("dataset_version", F.lit(version)), schema)
    return {
        "event_registry": convert(events, ("announcement_at", "activation_at", "anticipation_start_at"), schemas.EVENTS),
        "event_evidence": convert(evidence, ("observed_at",), schemas.EVIDENCE),
    }


def primary_evidence(events: DataFrame, evidence: DataFrame, order: str = "ordinal") -> DataFrame:
    """Each event with its first activation-boundary evidence, else its first evidence."""
    rank = F.struct((F.col("evidence_role") != "activation_boundary").cast("int").alias("r"), F.col(order).alias("o"))
    chosen = evidence.groupBy("event_id").agg(F.min_by(F.struct("evidence_id", "evidence_detail", "transaction_hash", "next_block_verification"), rank).alias("e"))
    return events.join(chosen, "event_id").select(
        "event_id", "event_type", "eligibility_status", F.col("e.evidence_id").alias("evidence_id"), F.col("e.evidence_detail").alias("activation_evidence"),
        F.coalesce(F.col("e.transaction_hash"), F.lit("")).alias("activation_transaction_hash"), F.col("e.next_block_verification").alias("next_block_verification"),
        F.date_format("activation_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("activation_timestamp_utc"),
    )


def metrics_panel(sources: dict[str, DataFrame]) -> DataFrame:
    """Sources of unlike shape stacked on one schema; ``unit_type`` names the kind of row, absent measures are null."""
    return sets.union_panel([df.withColumn("unit_type", F.lit(kind)) for kind, df in sources.items()])


def covariate_panel(sources: dict[str, DataFrame], tokens: DataFrame, validated: DataFrame, key: str) -> DataFrame:
    """Context covariates plus token covariates for the validated tokens only."""
    kept = joins.join_semi(tokens, validated, [key])
    frames = [df.withColumn("covariate_family", F.lit(name)) for name, df in sources.items()]
    return sets.union_panel([*frames, kept.withColumn("covariate_family", F.lit("token_social_metadata"))])


def corrected_panel(panel: DataFrame, parent: DataFrame, unit: str, date: str, value: str, target: str, boundary: str, structural: tuple[str, str]) -> DataFrame:
    """Panel with one unit's coverage repaired: missing before a boundary, replaced by the parent series from it on.

    Originals are kept. ``structural`` names a unit and the day before which its zeros are real. A missing parent day
    fails the query: nothing is filled.
    """
    day = lambda text: F.lit(text).cast("date")
    joined = panel.join(parent.select(F.col(date), F.col(value).alias("__parent")), date, "left")
    is_target = F.col(unit) == target
    before, after = is_target & (F.col(date) < day(boundary)), is_target & (F.col(date) >= day(boundary))
    replaced = F.when(F.col("__parent").isNull(), F.raise_error(F.lit("parent series misses a day after the boundary"))).otherwise(F.col("__parent"))
    status = (
        F.when(before, "missing_coverage_gap").when(after, "observed_corrected")
        .when((F.col(unit) == structural[0]) & (F.col(date) < day(structural[1])), "observed_structural_zero").otherwise("observed")
    )
    return joined.select(
        unit, date, F.col(value).alias("value_original"), F.when(after, replaced).when(~before, F.col(value)).alias("value_corrected"), status.alias("coverage_status")
    ).withColumn("log_value_corrected", F.log1p("value_corrected"))
