"""Canonical-table, contract and panel queries: the standard tables encoded as raw string logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import roles
from tidemark.catalog.market import POST_EVENT
from tidemark.catalog.registry import Tables, query
from tidemark.operators import aggregates, reshape
from tidemark.plans import canonical, contracts, market
from tidemark.session import settle

RELEASE = canonical.Release("v1", "sol:main", "launchpad")


def text(c: Column) -> Column:
    return c.cast("string")


# --- single-chain builders -------------------------------------------------------------------------------------------


def raw_launches(t: Tables) -> DataFrame:
    ms = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1000
    pr = F.col("o_orderpriority")
    return t.orders.select(
        text(F.col("o_custkey")).alias("mint"), F.concat(F.lit("S"), "o_custkey").alias("symbol"), F.lit("token").alias("name"), text(ms).alias("created_timestamp"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("seenAt"), F.when(pr == "1-URGENT", "true").otherwise("no").alias("has_twitter"),
        F.when(pr < "3", "1").otherwise("").alias("has_website"), F.when(pr == "5-LOW", " YES ").alias("has_telegram"), text(F.col("o_totalprice")).alias("initial_market_cap_sol"),
        F.when(F.col("o_orderstatus") == "P", "nan").otherwise("12.7").alias("description_length"), F.col("o_orderkey").alias("ordinal"),
    )


def raw_outcomes(t: Tables) -> DataFrame:
    st = F.col("o_orderstatus")
    return t.orders.select(
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "").otherwise(text(F.col("o_custkey"))).alias("mint"), F.when(st == "F", "GRADUATED").when(st == "O", "TIMEOUT").otherwise("UNKNOWN").alias("outcome"),
        F.when(st == "F", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("").alias("graduated_at"), text(F.floor(F.col("o_totalprice") / 1000) - 100).alias("minutes_to_outcome"),
        F.lit("").alias("minutes_to_outcome_chain"), text(F.col("o_totalprice")).alias("final_market_cap_sol"), F.lit("0.5").alias("detection_lag_min"), F.col("o_orderkey").alias("ordinal"),
    )


OUT = """oc AS (SELECT CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS mint, o_orderstatus AS st, floor(o_totalprice / 1000) - 100 AS minutes, o_orderdate, o_totalprice, o_orderkey,
  CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'malformed_outcome' WHEN o_orderstatus = 'F' AND floor(o_totalprice / 1000) - 100 <= 0 THEN 'nonpositive_graduation_time' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'missing_mint' END AS reason FROM orders),
best AS (SELECT * FROM oc WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY mint ORDER BY (st = 'F')::INT DESC, o_orderkey) = 1),
lau AS (SELECT CAST(o_custkey AS VARCHAR) AS mint, o_orderdate AS created, o_totalprice AS cap, o_orderpriority AS pr, o_orderstatus AS st FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)"""
STAMP = "'v1' AS dataset_version, 'sol:main' AS chain_id, 'launchpad' AS platform_id, 'sol:main/token:' || l.mint AS token_id, l.mint"


@query("baseline_launches", f"""WITH {OUT} SELECT {STAMP}, created AS launch_at, created AS observed_at, cap AS initial_market_cap_sol, CASE WHEN l.st <> 'P' THEN 12 END::BIGINT AS description_length,
  pr = '1-URGENT' AS has_twitter, pr < '3' AS has_website, pr = '5-LOW' AS has_telegram, ((pr = '1-URGENT')::INT + (pr < '3')::INT + (pr = '5-LOW')::INT)::TINYINT AS social_count, 'launch_record' AS source_record_type FROM lau l JOIN best b ON b.mint = l.mint""", "initial_market_cap_sol")
def baseline_launches(t: Tables) -> DataFrame:
    return canonical.build_baseline(raw_launches(t), raw_outcomes(t), RELEASE)[0]["launches"]


@query("baseline_lifecycle", f"""WITH {OUT} SELECT {STAMP}, CASE WHEN b.st = 'F' THEN 'graduated' ELSE 'timeout' END AS event_type, CASE WHEN b.st = 'F' THEN o_orderdate END AS event_at, CAST(minutes AS DOUBLE) AS minutes_from_launch_observed,
  NULL::DOUBLE AS minutes_from_launch_chain, o_totalprice AS final_market_cap_sol, 0.5::DOUBLE AS detection_lag_minutes, 'terminal_outcome' AS source_record_type FROM lau l JOIN best b ON b.mint = l.mint""", "minutes_from_launch_observed final_market_cap_sol detection_lag_minutes minutes_from_launch_chain")
def baseline_lifecycle(t: Tables) -> DataFrame:
    return canonical.build_baseline(raw_launches(t), raw_outcomes(t), RELEASE)[0]["lifecycle_events"]


@query("baseline_tokens", f"WITH {OUT} SELECT {STAMP}, 'S' || l.mint AS symbol, 'token' AS name, created AS created_at, NULL::VARCHAR AS token_program, NULL::VARCHAR AS creator FROM lau l JOIN best b ON b.mint = l.mint")
def baseline_tokens(t: Tables) -> DataFrame:
    return canonical.build_baseline(raw_launches(t), raw_outcomes(t), RELEASE)[0]["tokens"]


@query("baseline_counters", f"WITH {OUT} SELECT count(*) AS raw_rows, count(CASE WHEN reason IS NULL THEN 1 END) AS kept_rows, count(CASE WHEN reason = 'malformed_outcome' THEN 1 END) AS malformed_outcome, count(CASE WHEN reason = 'nonpositive_graduation_time' THEN 1 END) AS nonpositive_graduation_time, count(CASE WHEN reason = 'missing_mint' THEN 1 END) AS missing_mint FROM oc")
def baseline_counters(t: Tables) -> DataFrame:
    return canonical.build_baseline(raw_launches(t), raw_outcomes(t), RELEASE)[1]


def raw_windows(t: Tables) -> DataFrame:
    rows = market.post_event_activity(roles.tokens(t), roles.trades(t))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return rows.select(
        text(F.col("mint")).alias("mint"), iso("graduated_at").alias("graduated_at"), text(F.col("horizon_days")).alias("horizon_days"), F.lit("").alias("pool_address"), F.concat(text(F.col("swap_count")), F.lit(".0")).alias("swap_count"),
        text(F.col("active_traders")).alias("active_traders"), F.lit("NaN").alias("volume_usd"), iso("first_trade_at").alias("first_trade_at"), iso("last_trade_at").alias("last_trade_at"), F.lit("1e3").alias("signatures_scanned"),
        F.lit("").alias("transactions_parsed"), F.when(F.col("active_traders") > 10, "ok").otherwise("page_limit_reached_lower_bound").alias("signature_window_status"), F.lit("computed").alias("validation_status"),
    )


@query("pool_window_table", f"""WITH a AS ({POST_EVENT}) SELECT 'v1' AS dataset_version, 'sol:main' AS chain_id, 'launchpad' AS platform_id, 'sol:main/token:' || mint AS token_id, CAST(mint AS VARCHAR) AS mint, graduated_at, horizon_days::SMALLINT AS horizon_days, NULL::VARCHAR AS pool_address,
  swap_count AS transaction_proxy_count, active_traders, NULL::DOUBLE AS volume_usd, first_trade_at, last_trade_at, 1000::BIGINT AS signatures_scanned, NULL::BIGINT AS transactions_parsed, CASE WHEN active_traders > 10 THEN 'ok' ELSE 'page_limit_reached_lower_bound' END AS window_status,
  'computed' AS validation_status, 'pool transaction proxy; not decoded swaps' AS metric_semantics FROM a""")
def pool_window_table(t: Tables) -> DataFrame:
    return canonical.build_pool_windows(raw_windows(t), RELEASE)


@query("metadata_table", """SELECT 'v1' AS dataset_version, 'sol:main' AS chain_id, 'launchpad' AS platform_id, 'sol:main/token:' || c_custkey AS token_id, CAST(c_custkey AS VARCHAR) AS mint, 'ok' AS metadata_status, c_mktsegment = 'BUILDING' AS metadata_complete, c_name AS creator, NULL::VARCHAR AS bonding_curve,
  NULL::VARCHAR AS associated_bonding_curve, CASE WHEN c_nationkey > 5 THEN 'pool' || c_nationkey END AS pool_address, NULL::VARCHAR AS token_program, NULL::VARCHAR AS protocol, TIMESTAMP '2024-01-01' AS last_trade_at, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS ath_market_cap_usd,
  NULL::TIMESTAMP AS ath_market_cap_at, c_acctbal AS current_market_cap_usd, 1e9::DOUBLE AS total_supply_raw FROM customer""", "ath_market_cap_usd current_market_cap_usd total_supply_raw")
def metadata_table(t: Tables) -> DataFrame:
    rows = t.customer.select(
        text(F.col("c_custkey")).alias("mint"), F.lit("ok").alias("metadata_status"), F.when(F.col("c_mktsegment") == "BUILDING", "True").otherwise("False").alias("complete"), F.col("c_name").alias("creator"), F.lit("").alias("bonding_curve"),
        F.when(F.col("c_nationkey") > 5, F.concat(F.lit("pool"), "c_nationkey")).otherwise("").alias("pool_address"), F.lit("1704067200000").alias("last_trade_at"), F.when(F.col("c_acctbal") > 0, text(F.col("c_acctbal"))).otherwise("inf").alias("ath_market_cap"),
        F.lit("garbage").alias("ath_market_cap_at"), text(F.col("c_acctbal")).alias("usd_market_cap"), F.lit("1e9").alias("total_supply"))
    return canonical.build_metadata(rows, RELEASE)


@query("decoded_swap_table", """SELECT 'v1' AS dataset_version, 'sol:main' AS chain_id, 'launchpad' AS platform_id, 'sol:main/token:' || user_id AS token_id, CAST(user_id AS VARCHAR) AS mint, TIMESTAMP '2024-01-01' AS graduated_at, 30::SMALLINT AS horizon_days, 'tx' || event_id AS transaction_hash, 0::BIGINT AS transaction_index, event_type AS transaction_type,
  date_trunc('second', ts) AS block_timestamp, event_id AS block_number, NULL::VARCHAR AS wallet_address, NULL::VARCHAR AS pair_address, NULL::VARCHAR AS exchange_name, NULL::VARCHAR AS bought_token_address, NULL::DOUBLE AS bought_amount, NULL::DOUBLE AS bought_usd_amount, NULL::VARCHAR AS sold_token_address, NULL::DOUBLE AS sold_amount,
  NULL::DOUBLE AS sold_usd_amount, value AS total_value_usd, 'api' AS source FROM events""", "total_value_usd")
def decoded_swap_table(t: Tables) -> DataFrame:
    rows = t.events.select(
        text(F.col("user_id")).alias("mint"), F.lit("2024-01-01").alias("graduated_at"), F.lit("30").alias("horizon_days"), F.concat(F.lit("tx"), "event_id").alias("transaction_hash"), F.lit("0").alias("transaction_index"), F.col("event_type").alias("transaction_type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("block_timestamp"), text(F.col("event_id")).alias("block_number"), F.lit("").alias("wallet_address"), text(F.col("value")).alias("total_value_usd"), F.lit("api").alias("source"))
    return canonical.build_swaps(rows, RELEASE)


def raw_horizons(t: Tables) -> DataFrame:
    rows = market.post_event_activity(roles.tokens(t), roles.trades(t))
    return rows.select(
        text(F.col("mint")).alias("mint"), F.date_format("graduated_at", "yyyy-MM-dd HH:mm:ss").alias("graduated_at"), text(F.col("horizon_days")).alias("horizon_days"), text(F.col("swap_count")).alias("decoded_trade_count"),
        F.when(F.col("active_traders") > F.col("horizon_days"), "ok").otherwise("page_limit_reached_lower_bound").alias("source_window_status"))


@query("coverage_by_token", f"""WITH {OUT}, grad AS (SELECT l.mint, o_orderdate AS graduated_at FROM lau l JOIN best b ON b.mint = l.mint WHERE b.st = 'F'), a AS ({POST_EVENT}),
  h AS (SELECT CAST(mint AS VARCHAR) AS mint, count(*) AS n, count(CASE WHEN active_traders > horizon_days THEN 1 END) AS c FROM a GROUP BY 1), w AS (SELECT CAST(mint AS VARCHAR) AS mint, count(*) AS n FROM a GROUP BY 1)
  SELECT 'v1' AS dataset_version, 'sol:main' AS chain_id, 'launchpad' AS platform_id, 'sol:main/token:' || g.mint AS token_id, g.mint, g.graduated_at, m.c_custkey IS NOT NULL AS metadata_available, coalesce(m.c_nationkey > 5, false) AS pool_address_available, coalesce(w.n, 0)::TINYINT AS rpc_windows_available,
  coalesce(h.n, 0)::TINYINT AS decoded_windows_available, e.u IS NOT NULL AS decoded_swaps_available, coalesce(h.c, 0)::TINYINT AS decoded_windows_complete, CASE WHEN h.n IS NULL THEN 'no_decoded_swap_data' WHEN h.n = 3 AND h.c = 3 THEN 'decoded_complete_1_7_30d' ELSE 'decoded_lower_bound_page_capped' END AS coverage_status
  FROM grad g LEFT JOIN customer m ON CAST(m.c_custkey AS VARCHAR) = g.mint AND m.c_acctbal > 0 LEFT JOIN w ON w.mint = g.mint LEFT JOIN h ON h.mint = g.mint LEFT JOIN (SELECT DISTINCT CAST(user_id AS VARCHAR) AS u FROM events) e ON e.u = g.mint""")
def coverage_by_token(t: Tables) -> DataFrame:
    events = canonical.build_baseline(raw_launches(t), raw_outcomes(t), RELEASE)[0]["lifecycle_events"]
    metadata = t.customer.where("c_acctbal > 0").select(text(F.col("c_custkey")).alias("mint"), F.when(F.col("c_nationkey") > 5, "pool").alias("pool_address"))
    swaps = t.events.select(text(F.col("user_id")).alias("mint"))
    return canonical.coverage_single_chain(events, metadata, canonical.build_pool_windows(raw_windows(t), RELEASE), swaps, canonical.build_horizons(raw_horizons(t), RELEASE), RELEASE)


# --- cross-chain builders --------------------------------------------------------------------------------------------

DIRECT = canonical.DirectSpec(canonical.Release("v1", "evm:8", "direct"), canonical.Origins("created_logs", "pool_logs"), "0xfactory", "0xmanager", "scan window only")
ADDRESS = roles.hex_address_sql("o_custkey")
POOL = roles.hex_address_sql("o_orderkey")


def direct_tables(t: Tables) -> dict[str, DataFrame]:
    """Orders as launches (token = customer, pool = order), line items as pool events."""
    blank = F.lit("")
    launches = t.orders.select(
        F.upper(roles.hex_address(F.col("o_custkey"))).alias("token_id"), text(F.col("o_orderkey")).alias("block_number"), F.lit("3").alias("log_index"), F.concat(F.lit("TX"), "o_orderkey").alias("transaction_hash"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("block_timestamp_utc"), roles.hex_address(F.col("o_orderkey")).alias("pool_id"), F.col("o_orderpriority").alias("token_admin"), F.lit("1e18").alias("extensions_supply_raw"),
        blank.alias("event_id"), F.lit("0xpair").alias("paired_token"), F.lit("newer").alias("version_class"), *[blank.alias(c) for c in ("msg_sender", "starting_tick", "pool_hook", "pool_hook_label", "locker", "mev_module", "mev_module_label")],
    )
    log = F.col("l_linenumber") + F.col("l_suppkey") * 10
    unix = text(F.unix_seconds(F.col("l_shipdate").cast("timestamp")))
    items = t.lineitem
    opened, moved = items.where("l_returnflag = 'A'"), items.where("l_returnflag <> 'A'")
    base = [roles.hex_address(F.col("l_orderkey")).alias("pool_id"), unix.alias("block_timestamp_unix"), F.concat(F.lit("ltx"), "l_orderkey", F.lit("-"), "l_partkey", F.lit("-"), "l_suppkey").alias("transaction_hash"), text(log).alias("log_index"), text(F.col("l_orderkey")).alias("block_number")]
    null = F.lit(None).cast("string")
    events = opened.select(*base, F.lit("pool_initialized").alias("event_type"), F.lit("0xm2").alias("pool_manager"), F.lit("0xa").alias("currency0"), F.lit("0xb").alias("currency1"), F.lit("3000").alias("fee"), F.lit("60").alias("tick_spacing"), F.lit("0xh").alias("hooks"),
                           F.lit("79228162514264337593543950336").alias("sqrt_price_x96"), text(-F.col("l_partkey")).alias("initial_tick"), *[null.alias(c) for c in ("sender", "tick_lower", "tick_upper", "liquidity_delta", "salt")])
    events = events.unionByName(moved.select(*base, F.lit("initial_liquidity_modified").alias("event_type"), *[null.alias(c) for c in ("pool_manager", "currency0", "currency1", "fee", "tick_spacing", "hooks", "sqrt_price_x96", "initial_tick")],
                                             F.lit("0xs").alias("sender"), F.lit("-60").alias("tick_lower"), F.lit("60").alias("tick_upper"), F.when(F.col("l_returnflag") == "N", F.concat(text(F.col("l_quantity").cast("bigint")), F.lit("0" * 20))).otherwise("0").alias("liquidity_delta"), F.lit("0x0").alias("salt")))
    return canonical.build_direct(launches, events, DIRECT)


DIRECT_SQL = f"""f AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority, 'evm:8/token:' || {ADDRESS} AS token, {POOL} AS pool FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
op AS (SELECT l_orderkey, l_shipdate, 'ltx' || l_orderkey || '-' || l_partkey || '-' || l_suppkey AS tx, l_linenumber + l_suppkey * 10 AS log, l_partkey FROM lineitem WHERE l_returnflag = 'A' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber + l_suppkey * 10 DESC, tx DESC) = 1),
mv AS (SELECT l_orderkey, l_shipdate, 'ltx' || l_orderkey || '-' || l_partkey || '-' || l_suppkey AS tx, l_linenumber + l_suppkey * 10 AS log, l_returnflag = 'N' AS pos, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_returnflag <> 'A'),
mc AS (SELECT l_orderkey, count(*) AS n, count(CASE WHEN pos THEN 1 END) AS p FROM mv GROUP BY 1)"""


@query("direct_lifecycle_events", f"""WITH {DIRECT_SQL}, e AS (SELECT token, pool, token || '/lifecycle:token_created:TX' || o_orderkey || ':3' AS id, 'token_created' AS k, o_orderdate AS ev, o_orderkey AS blk, 'TX' || o_orderkey AS tx, 3::BIGINT AS log, 'created_logs' AS src FROM f
  UNION ALL SELECT token, pool, token || '/lifecycle:pool_initialized:' || tx || ':' || log, 'pool_initialized', l_shipdate, l_orderkey, tx, log, 'pool_logs' FROM f JOIN op ON l_orderkey = o_orderkey
  UNION ALL SELECT token, pool, token || '/liquidity:' || tx || ':' || log, CASE WHEN pos THEN 'initial_liquidity_added' ELSE 'liquidity_position_poked' END, l_shipdate, l_orderkey, tx, log, 'pool_logs' FROM f JOIN mv ON l_orderkey = o_orderkey)
  SELECT 'v1' AS dataset_version, 'evm:8' AS chain_id, 'direct' AS platform_id, id AS lifecycle_event_id, token AS token_id, pool AS pool_id, k AS event_type, ev AS event_at, blk AS block_number, tx AS transaction_hash, log AS log_index, 'observed' AS observation_status, src AS source_id FROM e""")
def direct_lifecycle_events(t: Tables) -> DataFrame:
    return direct_tables(t)["lifecycle_events"]


@query("direct_pools", f"""WITH {DIRECT_SQL} SELECT 'v1' AS dataset_version, 'evm:8' AS chain_id, 'direct' AS platform_id, token AS token_id, pool AS pool_id, NULL::VARCHAR AS pool_address, CASE WHEN op.tx IS NULL THEN '0xmanager' ELSE '0xm2' END AS pool_manager, CASE WHEN op.tx IS NOT NULL THEN '0xa' END AS currency0, CASE WHEN op.tx IS NOT NULL THEN '0xb' END AS currency1,
  CASE WHEN op.tx IS NOT NULL THEN 3000 END::BIGINT AS fee_hundredths_bip, CASE WHEN op.tx IS NOT NULL THEN 60 END::BIGINT AS tick_spacing, CASE WHEN op.tx IS NOT NULL THEN '0xh' END AS hooks, CASE WHEN op.tx IS NOT NULL THEN '79228162514264337593543950336' END AS sqrt_price_x96, -l_partkey AS initial_tick, l_shipdate AS initialized_at,
  op.tx AS initialization_transaction_hash, op.log AS initialization_log_index, 'observed' AS mapping_status, CASE WHEN op.tx IS NULL THEN 'processed_zero_rows' ELSE 'observed' END AS initialization_status, CASE WHEN op.tx IS NULL THEN 'created_logs' ELSE 'pool_logs' END AS source_id FROM f LEFT JOIN op ON l_orderkey = o_orderkey""")
def direct_pools(t: Tables) -> DataFrame:
    return direct_tables(t)["pools"]


@query("direct_liquidity", f"""WITH {DIRECT_SQL} SELECT 'v1' AS dataset_version, 'evm:8' AS chain_id, 'direct' AS platform_id, token || '/liquidity:' || tx || ':' || log AS liquidity_event_id, token AS token_id, pool AS pool_id, l_shipdate AS event_at, l_orderkey AS block_number, tx AS transaction_hash, log AS log_index, '0xs' AS sender,
  -60::BIGINT AS tick_lower, 60::BIGINT AS tick_upper, q || repeat('0', 20) AS liquidity_delta_raw, NULL::VARCHAR AS amount0_raw, NULL::VARCHAR AS amount1_raw, NULL::VARCHAR AS initialization_type, '0x0' AS salt, 'observed' AS observation_status, 'pool_logs' AS source_id FROM f JOIN mv ON l_orderkey = o_orderkey WHERE pos""")
def direct_liquidity(t: Tables) -> DataFrame:
    return direct_tables(t)["liquidity_initializations"]


LEDGER_SUMMARY = f"""WITH {DIRECT_SQL}, l AS (SELECT op.tx IS NOT NULL AS opened, coalesce(n, 0) AS n, coalesce(p, 0) AS p FROM f LEFT JOIN op ON op.l_orderkey = o_orderkey LEFT JOIN mc ON mc.l_orderkey = o_orderkey)"""


@query("direct_coverage_summary", f"""{LEDGER_SUMMARY} SELECT count(*) AS launch_universe, count(*) AS creator_observed, count(*) AS protocol_config_observed, count(*) AS pool_mapping_observed, 0 AS pool_mapping_not_collected, 0 AS pool_mapping_not_applicable, count(CASE WHEN opened THEN 1 END) AS pool_initialization_observed,
  count(CASE WHEN p > 0 THEN 1 END) AS liquidity_initialization_observed, 0 AS graduation_observed, 0 AS graduation_not_collected, count(*) AS graduation_not_applicable, 0 AS migration_observed, 0 AS migration_not_collected, count(*) AS migration_not_applicable, count(*) AS decoded_swaps_not_collected FROM l""")
def direct_coverage_summary(t: Tables) -> DataFrame:
    return aggregates.coverage_summary(direct_tables(t)["coverage_ledger"])


@query("direct_coverage_status", f"{LEDGER_SUMMARY} SELECT CASE WHEN opened AND n > 0 THEN 'canonical_core_complete' ELSE 'canonical_core_partial' END AS coverage_status, CASE WHEN p > 0 THEN 'observed' ELSE 'processed_zero_rows' END AS liquidity_initialization_status, count(*) AS n FROM l GROUP BY 1, 2")
def direct_coverage_status(t: Tables) -> DataFrame:
    return direct_tables(t)["coverage_ledger"].groupBy("coverage_status", "liquidity_initialization_status").agg(F.count("*").alias("n"))


GRADUATING = canonical.GraduatingSpec(canonical.Release("v1", "evm:56", "graduating"), canonical.Origins("create_logs", "receipts", "search", "pool_history", "pair_snapshot"), wrapped_native="0xwrapped", limitation="core only")


def graduating_tables(t: Tables) -> dict[str, DataFrame]:
    """Orders as launches; the order's lifecycle comes from its customer segment; mappings and history cover subsets."""
    addr = roles.hex_address(F.col("o_orderkey"))
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    launches = t.orders.select(
        F.upper(addr).alias("token_address"), text(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("launch_time_unix"), F.concat(F.lit("S"), "o_custkey").alias("symbol"), F.lit("n").alias("name"), text(F.col("o_custkey")).alias("creator"),
        F.lit("1000").alias("total_supply_raw"), text(F.col("o_orderkey")).alias("request_id"), F.concat(F.lit("tx"), "o_orderkey").alias("transaction_hash"), F.lit("1").alias("log_index"), text(F.col("o_orderkey")).alias("block_number"), F.lit("0xm").alias("manager_address"),
        F.lit("v2").alias("manager_version"), F.lit("5").alias("launch_fee_raw"))
    lifecycle = t.orders.where("o_orderstatus <> 'P'").select(
        addr.alias("token_address"), F.when(st == "F", "LiquidityAdded").otherwise("TradeStop").alias("event_name"), F.when(pr == "1-URGENT", F.concat(F.lit("pool"), "o_orderkey")).alias("pool_address"), F.when(pr == "2-HIGH", canonical.ZERO_ADDRESS).otherwise("0xquote").alias("quote_address"),
        text(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 60).alias("block_timestamp_unix"), F.concat(F.lit("ltx"), "o_orderkey").alias("transaction_hash"), F.lit("9").alias("log_index"), text(F.col("o_orderkey") + 10).alias("block_number"),
        F.when((pr == "1-URGENT") & (st == "F"), "4").alias("pair_created_log_index"), F.lit("").alias("currency0"), F.lit("").alias("currency1"), F.lit(None).cast("string").alias("fee_hundredths_bip"), F.lit(None).cast("string").alias("tick_spacing"),
        F.when(pr == "1-URGENT", "11").alias("amount0_raw"), F.when(pr == "1-URGENT", "22").alias("amount1_raw"), F.when(pr == "1-URGENT", "7").alias("liquidity_mint_log_index"), F.lit("0xsend").alias("liquidity_sender"), F.lit("v2").alias("amm_version"),
        F.lit("100").alias("offers_raw"), F.lit("200").alias("funds_raw"))
    existing = t.orders.where("o_orderpriority = '2-HIGH'").select(
        addr.alias("token_address"), F.lit("observed").alias("mapping_status"), F.concat(F.lit("map"), "o_orderkey").alias("pool_address"), F.lit(None).cast("string").alias("normalized_quote_address"), F.when(F.col("o_custkey") % 2 == 0, addr).otherwise("0x0").alias("currency0"), F.lit("0xother").alias("currency1"))
    history = t.orders.where("o_orderpriority = '2-HIGH' AND o_totalprice > 200000").select(
        addr.alias("token_address"), F.lit("observed").alias("initialization_status"), F.lit(True).alias("pool_address_matches_lifecycle"), text(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 30).alias("creation_block_timestamp_unix"),
        F.concat(F.lit("htx"), "o_orderkey").alias("creation_transaction_hash"), F.lit("2").alias("creation_log_index"), text(F.col("o_orderkey") + 5).alias("creation_block_number"), F.lit("2500").alias("fee"), F.lit("50").alias("tick_spacing"))
    metadata = t.orders.where("o_totalprice > 300000").select(addr.alias("token_address"), F.lit("img").alias("img"), F.col("o_orderpriority").alias("tag"))
    return canonical.build_graduating(launches, lifecycle, metadata, existing, history, GRADUATING)


GRAD_SQL = f"""g AS (SELECT *, 'evm:56/token:' || {POOL} AS token, o_orderstatus <> 'P' AS alive, o_orderstatus = 'F' AS added, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P' THEN 'pool' || o_orderkey WHEN o_orderpriority = '2-HIGH' THEN 'map' || o_orderkey END AS pool,
  o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AS own, o_orderpriority = '2-HIGH' AND o_totalprice > 200000 AS hist FROM orders),
gg AS (SELECT *, alive AND (own OR hist) AS pair, CASE WHEN own THEN o_orderdate + INTERVAL 60 SECOND WHEN hist THEN o_orderdate + INTERVAL 30 SECOND END AS init_at, CASE WHEN own THEN 'ltx' || o_orderkey WHEN hist THEN 'htx' || o_orderkey END AS init_tx, CASE WHEN own THEN 4 WHEN hist THEN 2 END AS init_log,
  CASE WHEN own THEN o_orderkey + 10 WHEN hist THEN o_orderkey + 5 END AS init_block FROM g)"""


@query("graduating_coverage", f"""WITH {GRAD_SQL}, s AS (SELECT CASE WHEN pool IS NOT NULL THEN 'observed' WHEN NOT alive THEN 'not_applicable' ELSE 'not_collected' END AS pool_mapping_status, CASE WHEN pair THEN 'observed' WHEN NOT alive THEN 'not_applicable' ELSE 'not_collected' END AS pool_initialization_status,
  CASE WHEN alive AND added AND pool IS NOT NULL THEN 'observed' WHEN NOT alive THEN 'not_applicable' ELSE 'not_collected' END AS liquidity_initialization_status, CASE WHEN added THEN 'observed' WHEN NOT alive THEN 'not_applicable' ELSE 'not_collected' END AS graduation_status,
  o_totalprice > 300000 AS metadata_available, CASE WHEN NOT alive OR (pool IS NOT NULL AND pair AND added) THEN 'canonical_core_complete' ELSE 'canonical_core_partial' END AS coverage_status FROM gg)
  SELECT *, count(*) AS n FROM s GROUP BY ALL""")
def graduating_coverage(t: Tables) -> DataFrame:
    keys = ["pool_mapping_status", "pool_initialization_status", "liquidity_initialization_status", "graduation_status", "metadata_available", "coverage_status"]
    return graduating_tables(t)["coverage_ledger"].groupBy(*keys).agg(F.count("*").alias("n"))


@query("graduating_lifecycle", f"""WITH {GRAD_SQL}, e AS (SELECT token, pool, 'token_created' AS k, o_orderdate AS ev, o_orderkey AS blk, 'tx' || o_orderkey AS tx, 1 AS log, 'create_logs' AS src FROM gg
  UNION ALL SELECT token, pool, CASE WHEN added THEN 'liquidity_added' ELSE 'trade_stopped' END, o_orderdate + INTERVAL 60 SECOND, o_orderkey + 10, 'ltx' || o_orderkey, 9, 'receipts' FROM gg WHERE alive
  UNION ALL SELECT token, pool, 'pool_initialized', init_at, init_block, init_tx, init_log, CASE WHEN own THEN 'receipts' ELSE 'pool_history' END FROM gg WHERE alive AND pool IS NOT NULL AND pair
  UNION ALL SELECT token, pool, 'initial_liquidity_added', o_orderdate + INTERVAL 60 SECOND, o_orderkey + 10, 'ltx' || o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 7 ELSE 9 END, 'receipts' FROM gg WHERE alive AND pool IS NOT NULL AND added)
  SELECT 'v1' AS dataset_version, 'evm:56' AS chain_id, 'graduating' AS platform_id, token || '/lifecycle:' || k || ':' || tx || ':' || log AS lifecycle_event_id, token AS token_id, pool AS pool_id, k AS event_type, ev AS event_at, blk AS block_number, tx AS transaction_hash, log::BIGINT AS log_index, 'observed' AS observation_status, src AS source_id FROM e""")
def graduating_lifecycle(t: Tables) -> DataFrame:
    return graduating_tables(t)["lifecycle_events"]


@query("graduating_liquidity", f"""WITH {GRAD_SQL} SELECT token AS token_id, pool AS pool_id, CASE WHEN o_orderpriority = '1-URGENT' THEN '11' WHEN o_custkey % 2 = 0 THEN '100' ELSE '200' END AS amount0_raw, CASE WHEN o_orderpriority = '1-URGENT' THEN '22' WHEN o_custkey % 2 = 0 THEN '200' ELSE '100' END AS amount1_raw,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'v2_mint' ELSE 'liquidity_added' END AS initialization_type FROM gg WHERE alive AND pool IS NOT NULL AND added""")
def graduating_liquidity(t: Tables) -> DataFrame:
    return graduating_tables(t)["liquidity_initializations"].select("token_id", "pool_id", "amount0_raw", "amount1_raw", "initialization_type")


@query("graduating_launches", f"""WITH {GRAD_SQL} SELECT token || '/launch:tx' || o_orderkey || ':1' AS launch_id, token AS token_id, o_orderdate AS launch_at, pool AS pool_address, CASE WHEN NOT alive THEN NULL WHEN o_orderpriority = '2-HIGH' THEN '0xwrapped' ELSE '0xquote' END AS paired_token, 'canonical_core' AS coverage_role FROM gg""")
def graduating_launches(t: Tables) -> DataFrame:
    return graduating_tables(t)["launches"].select("launch_id", "token_id", "launch_at", "pool_address", "paired_token", "coverage_role")


PROXIED = canonical.GraduatingSpec(canonical.Release("v1", "tron:main", "proxied"), canonical.Origins("contract_events", "contract_events", "token_list"), manager="TManager", paired="NATIVE", fallback_type="v2_mint", limitation="core only")


def proxied_tables(t: Tables) -> dict[str, DataFrame]:
    addr = F.concat(F.lit("T"), F.lpad(F.col("o_orderkey").cast("string"), 33, "a"))
    ms = text(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1000)
    creates = t.orders.select(addr.alias("token_address"), ms.alias("block_timestamp"), text(F.col("o_orderkey")).alias("block_number"), F.concat(F.lit("ctx"), "o_orderkey").alias("transaction_id"), F.lit("0").alias("event_index"), text(F.col("o_custkey")).alias("creator"), text(F.col("o_orderkey")).alias("token_index"))
    launched = t.orders.where("o_orderstatus = 'F'").select(
        addr.alias("token_address"), ms.alias("block_timestamp"), text(F.col("o_orderkey") + 1).alias("block_number"), F.concat(F.lit("ltx"), "o_orderkey").alias("transaction_id"), F.lit("2").alias("event_index"), F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("TP"), "o_orderkey")).alias("pool_address"),
        F.lit("c0").alias("currency0"), F.lit("c1").alias("currency1"), F.lit("3").alias("pair_created_event_index"), F.lit("4").alias("liquidity_mint_event_index"), F.when(F.col("o_orderpriority") < "4", "11").alias("amount0_raw"), F.when(F.col("o_orderpriority") < "4", "22").alias("amount1_raw"))
    upgrades = t.orders.where("o_totalprice > 499000").select(text(F.col("o_orderkey")).alias("block_number"), F.concat(F.lit("old"), "o_orderkey").alias("old_implementation"), F.concat(F.lit("new"), "o_orderkey").alias("new_implementation"))
    metadata = t.orders.where("o_totalprice > 250000").select(F.upper(addr).alias("contractAddress"), F.lit("SYM").alias("symbol"), F.lit("nm").alias("name"), F.lit("18").alias("decimals"), F.lit("1e9").alias("totalSupply"), *[F.lit(None).cast("string").alias(c) for c in ("description", "logoUrl", "websiteUrl", "twitterUrl", "telegramUrl", "tokenFlag")])
    return canonical.build_proxied(creates, launched, upgrades, metadata, PROXIED)


PROX_SQL = """h AS (SELECT o_orderkey AS blk, 'new' || o_orderkey AS nw, 'old' || o_orderkey AS od FROM orders WHERE o_totalprice > 499000),
x AS (SELECT *, 'tron:main/token:T' || lpad(CAST(o_orderkey AS VARCHAR), 33, 'a') AS token, o_orderstatus = 'F' AS alive, CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' THEN 'TP' || o_orderkey END AS pool, o_orderpriority < '4' AS minted FROM orders)"""


@query("proxied_launches", f"""WITH {PROX_SQL} SELECT token AS token_id, token || '/launch:ctx' || o_orderkey || ':0' AS launch_id, o_orderdate AS launch_at, o_orderkey AS block_number, pool AS pool_address, coalesce((SELECT arg_max(nw, blk) FROM h WHERE blk <= o_orderkey), (SELECT arg_min(od, blk) FROM h)) AS protocol_version,
  CASE WHEN alive THEN 'launched' ELSE 'created' END AS launch_status FROM x""")
def proxied_launches(t: Tables) -> DataFrame:
    return proxied_tables(t)["launches"].select("token_id", "launch_id", "launch_at", "block_number", "pool_address", "protocol_version", "launch_status")


@query("proxied_lifecycle", f"""WITH {PROX_SQL}, e AS (SELECT token, pool, 'token_created' AS k, o_orderdate AS ev, o_orderkey AS blk, 'ctx' || o_orderkey AS tx, 0 AS log FROM x UNION ALL SELECT token, pool, 'token_launched', o_orderdate, o_orderkey + 1, 'ltx' || o_orderkey, 2 FROM x WHERE alive
  UNION ALL SELECT token, pool, 'pool_initialized', o_orderdate, o_orderkey + 1, 'ltx' || o_orderkey, 3 FROM x WHERE pool IS NOT NULL UNION ALL SELECT token, pool, 'initial_liquidity_added', o_orderdate, o_orderkey + 1, 'ltx' || o_orderkey, 4 FROM x WHERE pool IS NOT NULL AND minted)
  SELECT token || '/lifecycle:' || k || ':' || tx || ':' || log AS lifecycle_event_id, token AS token_id, pool AS pool_id, k AS event_type, ev AS event_at, blk AS block_number, log::BIGINT AS log_index FROM e""")
def proxied_lifecycle(t: Tables) -> DataFrame:
    return proxied_tables(t)["lifecycle_events"].select("lifecycle_event_id", "token_id", "pool_id", "event_type", "event_at", "block_number", "log_index")


@query("proxied_coverage", f"""WITH {PROX_SQL}, s AS (SELECT o_totalprice > 250000 AS metadata_available, CASE WHEN pool IS NOT NULL THEN 'observed' WHEN NOT alive THEN 'not_applicable' ELSE 'not_collected' END AS pool_mapping_status, CASE WHEN alive AND minted THEN 'observed' WHEN NOT alive THEN 'not_applicable' ELSE 'not_collected' END AS liquidity_initialization_status,
  CASE WHEN alive THEN 'observed' ELSE 'not_applicable' END AS graduation_status, CASE WHEN NOT alive OR (pool IS NOT NULL AND minted) THEN 'canonical_core_complete' ELSE 'canonical_core_partial' END AS coverage_status FROM x) SELECT *, count(*) AS n FROM s GROUP BY ALL""")
def proxied_coverage(t: Tables) -> DataFrame:
    return proxied_tables(t)["coverage_ledger"].groupBy("metadata_available", "pool_mapping_status", "liquidity_initialization_status", "graduation_status", "coverage_status").agg(F.count("*").alias("n"))


# --- registry tables and panels ---------------------------------------------------------------------------------------


def registry_rows(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as registered rule changes, line items as their evidence, suppliers as sources."""
    st = F.col("o_orderstatus")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    events = t.orders.select(
        F.concat(F.lit("e"), "o_orderkey").alias("event_id"), F.lit("rule").alias("event_type"), F.col("o_orderpriority").alias("platform_id"), F.lit("c").alias("chain_id"), F.col("o_orderpriority").alias("rule_family"), F.lit("x").alias("rule_change"),
        F.when(st != "O", iso).otherwise("").alias("activation_at"), F.lit(None).cast("string").alias("announcement_at"), F.lit("").alias("anticipation_start_at"), F.lit("s").alias("comparison_unit_status"),
        F.when(st == "F", "accepted").when(st == "O", "rejected").otherwise("conditional").alias("eligibility_status"), F.when(F.col("o_custkey") % 7 != 0, "reason").alias("rejection_reason"), F.lit("h").alias("hypothesis_tags"), F.lit("b").alias("claim_boundary"), F.lit("v").alias("evidence_status"))
    line = F.concat(F.lit("v"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"), "l_partkey", F.lit("-"), "l_suppkey")
    evidence = t.lineitem.select(
        line.alias("evidence_id"), F.concat(F.lit("e"), "l_orderkey").alias("event_id"), F.when(F.col("l_returnflag") == "A", "activation_boundary").otherwise("context").alias("evidence_role"), F.when(F.col("l_linestatus") == "F", "accepted").otherwise("conditional").alias("supports_eligibility"),
        F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.concat(F.lit("d"), "l_partkey").alias("evidence_detail"), F.concat(F.lit("tx"), "l_orderkey").alias("transaction_hash"), F.lit("nb").alias("next_block_verification"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("observed_at"),
        (F.col("l_linenumber") * 10000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ordinal"))
    return events, evidence, t.supplier.where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("source_id"))


@query("primary_evidence", """WITH v AS (SELECT l_orderkey, 'v' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag <> 'A')::INT, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey) AS r FROM lineitem)
  SELECT 'e' || o_orderkey AS event_id, 'rule' AS event_type, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' ELSE 'conditional' END AS eligibility_status, id AS evidence_id, 'd' || l_partkey AS activation_evidence, 'tx' || o_orderkey AS activation_transaction_hash, 'nb' AS next_block_verification,
  CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS activation_timestamp_utc FROM orders JOIN v ON l_orderkey = o_orderkey AND r = 1""")
def primary_evidence(t: Tables) -> DataFrame:
    events, evidence, _ = registry_rows(t)
    tables = canonical.build_event_tables(events, evidence, "v1")
    return canonical.primary_evidence(tables["event_registry"], evidence)


GATE = """ev AS (SELECT 'e' || o_orderkey AS id, o_orderkey AS k, o_orderstatus AS st, o_custkey FROM orders), vi AS (SELECT 'v' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_orderkey AS k, l_suppkey, l_returnflag = 'A' AND l_linestatus = 'F' AS boundary FROM lineitem)"""


@query("evidence_gate", f"""WITH {GATE}, r AS (SELECT 'rejected_without_reason' AS rule, id FROM ev WHERE st = 'O' AND o_custkey % 7 = 0 UNION ALL SELECT 'accepted_without_boundary_evidence', id FROM ev WHERE st = 'F' AND k NOT IN (SELECT k FROM vi WHERE boundary)
  UNION ALL SELECT 'no_evidence', id FROM ev WHERE k NOT IN (SELECT k FROM vi) UNION ALL SELECT 'unregistered_source', id FROM vi WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) UNION ALL SELECT 'duplicate_evidence', id FROM vi GROUP BY id HAVING count(*) > 1)
  SELECT rule, count(*) AS violations, min(id) AS first_subject FROM r GROUP BY 1""")
def evidence_gate(t: Tables) -> DataFrame:
    events, evidence, sources = registry_rows(t)
    tables = canonical.build_event_tables(events, evidence, "v1")
    rows = contracts.event_gate_violations(tables["event_registry"], tables["event_evidence"], sources)
    return rows.groupBy("rule").agg(F.count("*").alias("violations"), F.min("subject_id").alias("first_subject"))


@query("staggered_gate", "WITH a AS (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 490000) SELECT count(*) AS accepted_events, count(DISTINCT o_orderpriority) AS platforms, (SELECT max(n) FROM (SELECT count(*) AS n FROM a GROUP BY o_custkey)) AS largest_family, count(DISTINCT o_orderpriority) >= 3 AND (SELECT max(n) FROM (SELECT count(*) AS n FROM a GROUP BY o_custkey)) >= 3 AS gate_passes FROM a")
def staggered_gate(t: Tables) -> DataFrame:
    return contracts.staggered_gate(t.orders, "o_orderpriority", "o_custkey", (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 490000))


@query("metrics_panel", f"""WITH {roles.PANEL}, a AS ({POST_EVENT}) SELECT 'platform_day' AS unit_type, unit AS unit_id, NULL::INT AS horizon_days, volume AS volume_usd, NULL::BIGINT AS swap_count, NULL::DOUBLE AS graduation_rate FROM regional
  UNION ALL SELECT 'token_horizon', mint || ':' || horizon_days || 'd', horizon_days, volume_usd, swap_count, NULL FROM a UNION ALL SELECT 'token_launch_day_cohort', 'day:' || CAST(o_orderdate AS DATE), NULL, NULL, NULL, avg((o_orderstatus = 'F')::INT) FROM orders GROUP BY 2""", "volume_usd graduation_rate", digits=4)
def metrics_panel(t: Tables) -> DataFrame:
    activity = market.post_event_activity(roles.tokens(t), roles.trades(t))
    cohort = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("graduation_rate"))
    return canonical.metrics_panel({
        "platform_day": roles.regional_days(t).select(F.col("unit").alias("unit_id"), F.col("volume").alias("volume_usd")),
        "token_horizon": activity.select(F.concat("mint", F.lit(":"), "horizon_days", F.lit("d")).alias("unit_id"), "horizon_days", "volume_usd", "swap_count"),
        "token_launch_day_cohort": cohort.select(F.concat(F.lit("day:"), "d").alias("unit_id"), "graduation_rate"),
    }).select("unit_type", "unit_id", "horizon_days", "volume_usd", "swap_count", "graduation_rate")


@query("covariate_panel", """SELECT 'community_sentiment' AS covariate_family, 'lang:' || lang AS unit_id, avg(n_chars) AS score, NULL::BIGINT AS doc_id, NULL::BIGINT AS n_chars FROM documents GROUP BY 2
  UNION ALL SELECT 'token_social_metadata', NULL, NULL, doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""", "score")
def covariate_panel(t: Tables) -> DataFrame:
    sentiment = t.documents.groupBy(F.concat(F.lit("lang:"), "lang").alias("unit_id")).agg(F.avg("n_chars").alias("score"))
    return canonical.covariate_panel({"community_sentiment": sentiment}, t.documents.select("doc_id", "n_chars"), t.labels, "doc_id").select("covariate_family", "unit_id", "score", "doc_id", "n_chars")


@query("corrected_panel", f"""WITH {roles.PANEL}, p AS (SELECT day, sum(volume) AS v FROM regional GROUP BY 1) SELECT unit, r.day, volume AS value_original, CASE WHEN unit = 'ASIA' AND r.day < DATE '1997-01-01' THEN NULL WHEN unit = 'ASIA' THEN v ELSE volume END AS value_corrected,
  CASE WHEN unit = 'ASIA' AND r.day < DATE '1997-01-01' THEN 'missing_coverage_gap' WHEN unit = 'ASIA' THEN 'observed_corrected' WHEN unit = 'EUROPE' AND r.day < DATE '1996-01-01' THEN 'observed_structural_zero' ELSE 'observed' END AS coverage_status,
  ln(1 + CASE WHEN unit = 'ASIA' AND r.day < DATE '1997-01-01' THEN NULL WHEN unit = 'ASIA' THEN v ELSE volume END) AS log_value_corrected FROM regional r JOIN p USING (day)""", "value_original value_corrected log_value_corrected", digits=4)
def corrected_panel(t: Tables) -> DataFrame:
    panel = settle(roles.regional_days(t))
    parent = panel.groupBy("day").agg(F.sum("volume").alias("volume"))
    return canonical.corrected_panel(panel, parent, "unit", "day", "volume", "ASIA", "1997-01-01", ("EUROPE", "1996-01-01"))


# --- contracts -------------------------------------------------------------------------------------------------------


@query("schema_contract", "SELECT 'documents' AS subject, 'doc_id' AS column_name, true AS present, true AS type_ok, 0 AS nulls, true AS schema_ok UNION ALL SELECT 'documents', 'text', true, true, 0, true UNION ALL SELECT 'documents', 'quality', false, false, 0, false UNION ALL SELECT 'documents', 'n_chars', true, false, 0, false")
def schema_contract(t: Tables) -> DataFrame:
    from pyspark.sql import types as T

    wanted = T.StructType([T.StructField("doc_id", T.LongType(), False), T.StructField("text", T.StringType(), False), T.StructField("quality", T.IntegerType()), T.StructField("n_chars", T.IntegerType())])
    return contracts.check_schema(t.documents, wanted, "documents")


@query("integrity_summary", """WITH c AS (SELECT 'unique' AS check_name, 'orders(o_orderkey)' AS subject, 0 AS violations UNION ALL SELECT 'unique', 'lineitem(l_orderkey, l_linenumber)', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
  UNION ALL SELECT 'foreign_key', 'orders.o_custkey', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'foreign_key', 'documents.doc_id', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
  UNION ALL SELECT 'domain', 'orders.o_orderstatus', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) UNION ALL SELECT 'observed_iff_row', 'documents.label_status', (SELECT count(*) FROM documents WHERE (lang = 'en') <> (doc_id IN (SELECT doc_id FROM labels)))
  UNION ALL SELECT 'exactly_once', 'orders in first_ship', (SELECT count(*) FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_shipdate) AS s FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON l_orderkey = o_orderkey WHERE n IS DISTINCT FROM 1 OR s IS DISTINCT FROM o_orderdate)
  UNION ALL SELECT 'same_set', 'documents/labels.doc_id', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) + (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)))
  SELECT *, violations = 0 AS passed, (SELECT bool_and(violations = 0) FROM c) AS release_accepted FROM c""")
def integrity_summary(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.when(F.col("lang") == "en", "observed").otherwise("not_collected").alias("label_status"))
    ships = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return contracts.integrity_summary([settle(c) for c in (
        contracts.check_unique(t.orders, ["o_orderkey"], "orders"), contracts.check_unique(t.lineitem, ["l_orderkey", "l_linenumber"], "lineitem"),
        contracts.check_fk(t.orders, t.customer, "o_custkey", "c_custkey", "orders"), contracts.check_fk(t.documents, t.labels, "doc_id", "doc_id", "documents"),
        contracts.check_domain(t.orders, "o_orderstatus", ("F", "O"), "orders"), contracts.check_iff(docs, t.labels, "doc_id", "label_status", "documents"),
        contracts.check_match(t.orders.select("o_orderkey", "o_orderdate"), ships, ["o_orderkey"], [("o_orderdate", "l_shipdate")], "orders in first_ship"),
        contracts.check_same_set(t.documents, t.labels, "doc_id", "documents/labels"),
    )])


@query("panel_balance", f"""WITH {roles.PANEL} SELECT unit, count(*) AS rows, count(*) AS days, 0 AS duplicates, date_diff('day', DATE '1995-01-01', DATE '2001-08-01') + 1 - count(CASE WHEN day BETWEEN DATE '1995-01-01' AND DATE '2001-08-01' THEN 1 END) AS missing_days, min(day) AS first_day, max(day) AS last_day,
  date_diff('day', DATE '1995-01-01', DATE '2001-08-01') + 1 - count(CASE WHEN day BETWEEN DATE '1995-01-01' AND DATE '2001-08-01' THEN 1 END) = 0 AS balanced FROM regional GROUP BY 1""")
def panel_balance(t: Tables) -> DataFrame:
    return contracts.check_panel(roles.regional_days(t), "unit", "day", "1995-01-01", "2001-08-01")


@query("window_coverage", f"""WITH {roles.PANEL}, w(window_name, a, b) AS (VALUES ('event', DATE '1998-04-01', DATE '1998-07-31'), ('calibration', DATE '1997-01-01', DATE '1997-12-31')) SELECT unit, window_name, count(CASE WHEN day BETWEEN a AND b THEN 1 END) AS observed_days,
  max(date_diff('day', a, b) + 1) - count(CASE WHEN day BETWEEN a AND b THEN 1 END) AS missing_days, count(CASE WHEN day BETWEEN a AND b AND volume = 0 THEN 1 END) AS zero_days FROM regional, w GROUP BY 1, 2""")
def window_coverage(t: Tables) -> DataFrame:
    return contracts.window_audit(roles.regional_days(t), "unit", "day", "volume", {"event": ("1998-04-01", "1998-07-31"), "calibration": ("1997-01-01", "1997-12-31")})


@query("import_coverage", f"""WITH {roles.HORIZONS}, m AS (SELECT o_custkey AS unit, min(o_orderkey) AS lo FROM orders GROUP BY 1), g AS (SELECT unit, horizon_days, lo, lo + horizon_days * 100 + 2000 AS hi FROM m CROSS JOIN horizons),
  c AS (SELECT g.unit, g.horizon_days, count(o_orderkey) AS observed_rows FROM g LEFT JOIN orders ON o_custkey = unit AND o_orderkey BETWEEN lo AND hi GROUP BY 1, 2)
  SELECT horizon_days, count(*) AS units, count(CASE WHEN observed_rows > 0 THEN 1 END) AS units_with_rows, CAST(sum(observed_rows) AS BIGINT) AS rows, avg((observed_rows > 0)::INT) AS share_with_rows FROM c GROUP BY 1""", "share_with_rows")
def import_coverage(t: Tables) -> DataFrame:
    manifest = t.orders.groupBy(F.col("o_custkey").alias("unit")).agg(F.min("o_orderkey").alias("lo"))
    grid = reshape.expected_grid(manifest, "lo", 100)
    rows = t.orders.select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("block"))
    return contracts.coverage_share(contracts.import_coverage(grid, rows, "unit", "block", "lo", "cutoff_block"))


@query("rebuild_check", """WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2), r AS (SELECT l_suppkey, sum(n * m) / sum(n) AS rebuilt FROM c GROUP BY 1),
  p AS (SELECT l_suppkey, avg(l_quantity) + CASE WHEN l_suppkey % 17 = 0 THEN l_suppkey / 64.0::DOUBLE ELSE 0 END AS reported FROM lineitem WHERE l_suppkey % 13 <> 0 GROUP BY 1), g AS (SELECT abs(rebuilt - reported) AS gap FROM r FULL JOIN p USING (l_suppkey))
  SELECT count(*) AS groups, max(gap) AS largest_gap, count(CASE WHEN gap IS NULL OR gap > 1e-9 THEN 1 END) AS violations, count(CASE WHEN gap IS NULL OR gap > 1e-9 THEN 1 END) = 0 AS passed FROM g""", "largest_gap")
def rebuild_check(t: Tables) -> DataFrame:
    # some suppliers' reports are off and some are missing: both are violations
    cells = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m"))
    off = F.when(F.col("l_suppkey") % 17 == 0, F.col("l_suppkey") / 64.0).otherwise(0.0)
    reported = t.lineitem.where("l_suppkey % 13 <> 0").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("reported")).withColumn("reported", F.col("reported") + off)
    return contracts.check_rebuild(cells, reported, ["l_suppkey"], "n", "m", "reported")


@query("sample_status", f"""WITH a AS ({POST_EVENT}), x AS (SELECT *, active_traders > 30 AS ok FROM a WHERE horizon_days = 30) SELECT count(*) AS tokens, count(CASE WHEN swap_count > 0 THEN 1 END) AS tokens_with_swaps, CAST(sum(swap_count) AS BIGINT) AS swap_rows, count(CASE WHEN ok THEN 1 END) AS complete_tokens, avg(ok::INT) AS complete_share,
  count(CASE WHEN NOT ok THEN 1 END) AS truncated_tokens, count(CASE WHEN NOT ok AND swap_count = 0 THEN 1 END) AS truncated_zero_tokens, avg(CASE WHEN ok THEN (swap_count > 0)::INT END) AS complete_active_share, median(CASE WHEN ok THEN swap_count END) AS median_complete_swaps,
  count(CASE WHEN swap_count > 0 THEN 1 END) >= 50 AND sum(swap_count) >= 500 AS credible FROM x""", "complete_share complete_active_share median_complete_swaps")
def sample_status(t: Tables) -> DataFrame:
    rows = market.post_event_activity(roles.tokens(t), roles.trades(t)).withColumn("window_status", F.when(F.col("active_traders") > 30, "ok").otherwise("page_limit_reached_lower_bound"))
    return contracts.sample_status(rows)


@query("sample_funnel", "SELECT 0 AS step, 'all' AS stage, count(*) AS n FROM orders UNION ALL SELECT 1, 'finished', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, 'large', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 UNION ALL SELECT 3, 'urgent', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 AND o_orderpriority = '1-URGENT'")
def sample_funnel(t: Tables) -> DataFrame:
    return contracts.sample_flow(t.orders, {"finished": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 200000, "urgent": F.col("o_orderpriority") == "1-URGENT"})
