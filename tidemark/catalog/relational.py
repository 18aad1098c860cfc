"""Source, scalar, filter, join, aggregate, window, set and reshape queries."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog import roles
from tidemark.catalog.registry import Tables, query
from tidemark.functions import logs, nested, wide
from tidemark.functions import scalars as S
from tidemark.operators import aggregates, filters, joins, ranking, reshape, sets, windows
from tidemark.session import settle, shared_folder
from tidemark.sources import readers, sinks

# --- sources and sinks -----------------------------------------------------------------------------------------------


def exported(t: Tables, name: str) -> str:
    return shared_folder(t.spark, name)


@query("csv_round_trip", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS price FROM orders", "price")
def csv_round_trip(t: Tables) -> DataFrame:
    path = exported(t, "csv")
    sinks.write_csv(t.orders.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("string").alias("price"), "o_orderpriority"), path, ["o_orderkey", "o_orderstatus", "price", "o_orderpriority"])
    rows = readers.read_csv(t.spark, path, ["o_orderkey", "o_orderstatus", "price", "o_orderpriority"], keep=["o_orderkey", "o_orderstatus", "price"], spread=8)
    return rows.withColumn("price", S.as_double(F.col("price")))


@query("jsonl_round_trip", "SELECT event_id, user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", "value")
def jsonl_round_trip(t: Tables) -> DataFrame:
    path = exported(t, "jsonl")
    sinks.write_jsonl(t.events.select("event_id", "user_id", "value", "props"), path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])
    return readers.read_jsonl(t.spark, path, schema, spread=8).select("event_id", "user_id", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49", "l_quantity")
def pruned_scan(t: Tables) -> DataFrame:
    return readers.read_table(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_quantity"]).where("l_quantity > 49")


@query("registry_documents", "SELECT n_nationkey AS ordinal, n_name AS event_id, n_regionkey AS region FROM nation")
def registry_documents(t: Tables) -> DataFrame:
    path = exported(t, "registry")
    rows = t.nation.agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))), lambda r: F.struct(r["n_name"].alias("event_id"), r["n_regionkey"].alias("region"))).alias("events"))
    rows.select(F.lit("v1").alias("schema_version"), "events").write.json(path)
    record = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("region", T.IntegerType())])
    return readers.read_registry(t.spark, path, "events", "v1", record)


@query("chart_documents", "SELECT r_name AS unit, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS value FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2", "value", digits=4)
def chart_documents(t: Tables) -> DataFrame:
    # a chart holds one point per calendar day
    points = F.array(F.unix_seconds(F.col("day").cast("timestamp")).cast("double"), F.col("volume"))
    charts = roles.regional_days(t).groupBy("unit").agg(F.collect_list(points).alias("totalDataChart"))
    path = exported(t, "charts")
    charts.write.json(path)
    schema = T.StructType([T.StructField("unit", T.StringType()), *readers.CHART.fields])
    return readers.explode_chart(readers.read_jsonl(t.spark, path, schema), ["unit"])


@query("chart_child_sets", """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS children FROM orders GROUP BY 1)
  SELECT children, min(day) AS from_day, max(day) AS to_day FROM d GROUP BY 1""")
def chart_child_sets(t: Tables) -> DataFrame:
    per = t.orders.groupBy(F.to_date("o_orderdate").alias("day"), "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    maps = per.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "v"))).alias("children_map"))
    return readers.child_sets(maps, [], "day", "children_map")


@query("aliased_import", f"""SELECT {roles.hex_address_sql('l_partkey')} AS pool_id, {roles.hex_address_sql('l_suppkey')} AS sender, l_orderkey AS block_number, epoch(l_shipdate)::BIGINT AS timestamp_unix,
  strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc, 'tx-' || l_orderkey AS transaction_hash, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS amount0_raw, '-' || CAST(l_quantity AS BIGINT) || '000' AS amount1_raw FROM lineitem""")
def aliased_import(t: Tables) -> DataFrame:
    return readers.import_swaps(t.lineitem.select(
        F.upper(roles.hex_address(F.col("l_partkey"))).alias("poolId"), roles.hex_address(F.col("l_suppkey")).alias("trader"), F.col("l_orderkey").cast("string").alias("blockNumber"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("block_time"), F.concat(F.lit("tx-"), "l_orderkey").alias("tx_hash"), F.col("l_quantity").cast("string").alias("amount0"),
        F.concat(F.lit("-"), F.col("l_quantity").cast("bigint").cast("string"), F.lit("e3")).alias("amount1Raw"),
    ))


@query("staged_release", "SELECT 'customers' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'empty', 0")
def staged_release(t: Tables) -> DataFrame:
    path = exported(t, "release")
    sinks.write_release(t.spark, {"customers": t.customer, "orders": t.orders.select("o_orderkey", "o_custkey"), "empty": t.orders.select("o_orderkey").where("o_orderkey < -1")}, path)
    parts = [readers.read_table(t.spark, f"{path}/{n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in ("customers", "orders", "empty")]
    return sets.union_panel(parts)


@query("aligned_append", """SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderstatus AS status, o_orderpriority AS note FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, o_orderstatus, NULL FROM orders WHERE o_orderstatus <> 'F'""")
def aligned_append(t: Tables) -> DataFrame:
    old = t.orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("extra"))
    new = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("note"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return sinks.append_aligned(old, new, ["id", "status", "note"])


@query("manifest_check", "SELECT 'orders' AS table_name, count(*) AS rows, count(*) AS now_rows, true AS matches FROM orders UNION ALL SELECT 'customer', count(*), count(*), true FROM customer UNION ALL SELECT 'part', count(*), count(*) - (SELECT count(*) FROM part WHERE p_size = 1), false FROM part")
def manifest_check(t: Tables) -> DataFrame:
    recorded = settle(sinks.fingerprint({"orders": t.orders, "customer": t.customer, "part": t.part}))
    now = {"orders": t.orders.repartition(5, "o_custkey"), "customer": t.customer.orderBy(F.desc("c_acctbal")), "part": t.part.where("p_size <> 1")}
    return sinks.check_manifest(now, recorded)


@query("table_profile", """SELECT 'rows' AS fact, '' AS name, CAST(count(*) AS VARCHAR) AS value FROM events UNION ALL SELECT 'unique_ids', 'user_id', CAST(count(DISTINCT user_id) AS VARCHAR) FROM events
  UNION ALL SELECT 'min', 'event_id', CAST(min(event_id) AS VARCHAR) FROM events UNION ALL SELECT 'max', 'event_id', CAST(max(event_id) AS VARCHAR) FROM events
  UNION ALL SELECT 'category', 'event_type=' || event_type, CAST(count(*) AS VARCHAR) FROM events GROUP BY event_type""")
def table_profile(t: Tables) -> DataFrame:
    return sinks.profile(t.events, "user_id", ["event_id"], ["event_type"])


# --- scalars ---------------------------------------------------------------------------------------------------------


@query("timestamp_dialects", """SELECT o_orderkey, o_orderdate AS from_millis, o_orderdate AS from_seconds, o_orderdate AS from_magnitude, o_orderdate AS from_iso, o_orderdate AS from_naive,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS from_mixed FROM orders""")
def timestamp_dialects(t: Tables) -> DataFrame:
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = lambda c: c.cast("string")
    return t.orders.select(
        "o_orderkey", S.parse_ts(text(seconds * 1000), "digits_ms").alias("from_millis"), S.parse_ts(text(seconds), "seconds").alias("from_seconds"),
        S.parse_ts(text(F.when(seconds % 2 == 0, seconds * 1000).otherwise(seconds * 1000)), "magnitude").alias("from_magnitude"),
        S.parse_ts(F.concat(iso, F.lit("Z")), "seconds").alias("from_iso"), S.parse_ts(iso, "digits_ms").alias("from_naive"),
        S.parse_ts(F.when(F.col("o_orderstatus") == "F", iso).when(F.col("o_orderstatus") == "O", "").otherwise("garbage"), "seconds").alias("from_mixed"),
    )


@query("number_dialects", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS finite, CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(trunc(c_acctbal) AS BIGINT) END AS whole,
  c_mktsegment IN ('BUILDING', 'MACHINERY') AS strict_flag, CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE c_mktsegment IN ('MACHINERY') END AS loose_flag,
  CAST(c_custkey AS VARCHAR) || '000000000000000000' AS scaled, CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_mktsegment END AS segment, ln(1 + abs(c_acctbal)) AS logged,
  c_acctbal / nullif(c_nationkey, 0) AS ratio, least(5000, greatest(0, c_acctbal)) AS clipped, c_acctbal < 0 OR c_acctbal > 5000 AS was_outside FROM customer""", "finite logged ratio clipped")
def number_dialects(t: Tables) -> DataFrame:
    text = F.when(F.col("c_acctbal") < 0, F.when(F.col("c_custkey") % 2 == 0, "NaN").otherwise("n/a")).otherwise(F.col("c_acctbal").cast("string"))
    seg = F.col("c_mktsegment")
    strict = F.when(seg == "BUILDING", " Y ").when(seg == "MACHINERY", "TRUE").when(seg == "FURNITURE", F.lit(None)).otherwise("no")
    loose = F.when(seg == "BUILDING", "y").when(seg == "MACHINERY", "Yes").when(seg == "FURNITURE", F.lit(None)).otherwise("0")
    return t.customer.select(
        "c_custkey", S.as_double(text).alias("finite"), S.as_long(text).alias("whole"), S.as_bool(strict, False).alias("strict_flag"), S.as_bool(loose, None).alias("loose_flag"),
        S.integer_text(F.concat(F.col("c_custkey").cast("string"), F.lit("e18"))).alias("scaled_raw"), S.blank_to_null(F.when(seg == "FURNITURE", "").otherwise(seg)).alias("segment"),
        S.log1p_amount(F.abs("c_acctbal")).alias("logged"), S.safe_rate(F.col("c_acctbal"), F.col("c_nationkey")).alias("ratio"), S.clip(F.col("c_acctbal"), 0.0, 5000.0).alias("clipped"),
        S.outside(F.col("c_acctbal"), 0.0, 5000.0).alias("was_outside"),
    ).withColumn("scaled", F.when(F.col("c_custkey") == 0, F.lit("0000000000000000000")).otherwise(F.col("scaled_raw"))).drop("scaled_raw")


@query("canonical_ids", f"""SELECT l_orderkey, l_linenumber, l_partkey, 'evm:1/token:' || {roles.hex_address_sql('l_partkey')} AS token_id, 'evm:1/token:' || {roles.hex_address_sql('l_partkey')} || '/launch:tx' || l_orderkey || ':' || l_linenumber AS launch_id,
  'sol:1/token:Ab' || l_partkey AS cased_id FROM lineitem""")
def canonical_ids(t: Tables) -> DataFrame:
    token = S.token_id("evm:1", F.upper(roles.hex_address(F.col("l_partkey"))), True)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", token.alias("token_id"), S.launch_id(token, F.concat(F.lit("tx"), "l_orderkey"), F.col("l_linenumber")).alias("launch_id"),
                             S.token_id("sol:1", F.concat(F.lit("Ab"), "l_partkey"), False).alias("cased_id"))


SIGNATURE = "0x" + "ab" * 32
WORDS = "lpad(lower(hex({})), 64, '0')"


def raw_logs(t: Tables) -> DataFrame:
    """Line items encoded as event logs: topics carry addresses, data carries unsigned, signed, address and string words."""
    word = lambda c: F.lpad(F.lower(F.hex(c)), 64, "0")
    negative = F.concat(F.lit("f" * 48), F.lpad(F.lower(F.hex(-F.col("l_quantity").cast("bigint"))), 16, "0"))
    name = F.concat(F.lit("Tokén "), F.col("l_returnflag"))
    hexed = F.lower(F.hex(F.encode(name, "UTF-8")))
    padded = F.rpad(hexed, 64, "0")
    data = F.concat(
        F.lit("0x"), word(F.col("l_orderkey")), negative, word(F.col("l_suppkey")), word(F.lit(160)), word(F.col("l_linenumber")),
        word(F.length(hexed) / 2), padded,
    )
    return t.lineitem.select(
        F.lit(SIGNATURE).alias("topic0"), F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("l_partkey")), 64, "0")).alias("topic1"), data.alias("data"),
        F.concat(F.lit("tx"), "l_orderkey").alias("transaction_hash"), F.col("l_linenumber").alias("log_index"), F.col("l_shipdate").alias("block_time"),
    )


DECODE = logs.LogSpec(SIGNATURE, {"token": (1, "address")}, {"supply": (0, "uint"), "delta": (1, "int"), "sender": (2, "address"), "name": (3, "string"), "tick": (4, "int24")})


@query("decoded_logs", f"""SELECT 'tx' || l_orderkey AS transaction_hash, l_linenumber AS log_index, {roles.hex_address_sql('l_partkey')} AS token, CAST(l_orderkey AS VARCHAR) AS supply,
  CAST(-CAST(l_quantity AS BIGINT) AS VARCHAR) AS delta, {roles.hex_address_sql('l_suppkey')} AS sender, 'Tokén ' || l_returnflag AS name, l_linenumber AS tick FROM lineitem""")
def decoded_logs(t: Tables) -> DataFrame:
    return logs.decode_logs(raw_logs(t), DECODE, ("transaction_hash", "log_index"))


@query("receipt_join", f"""WITH p AS (SELECT l_orderkey AS tx, l_partkey AS tok, min(l_linenumber) AS line FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), m AS (SELECT l_orderkey AS tx, l_partkey AS pool, min(l_linenumber) + 100 AS line FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
  u AS (SELECT tx, min(pool) AS pool, min(line) AS line FROM (SELECT l_orderkey AS tx, l_partkey AS pool, l_linenumber + 100 AS line FROM lineitem WHERE l_returnflag <> 'N') GROUP BY 1 HAVING count(*) = 1),
  k AS (SELECT DISTINCT l_orderkey AS tx, l_partkey AS tok FROM lineitem)
  SELECT {roles.hex_address_sql('k.tok')} AS token, k.tx AS transaction_hash, CASE WHEN p.tx IS NOT NULL THEN 'pool-' || k.tok WHEN u.tx IS NOT NULL THEN 'pool-' || u.pool END AS pool_address, p.line AS pool_log_index,
    CASE WHEN p.tx IS NOT NULL THEN m.line ELSE u.line END AS mint_log_index, CASE WHEN p.tx IS NOT NULL THEN 'v2' END AS amm_version
  FROM k LEFT JOIN p ON p.tx = k.tx AND p.tok = k.tok LEFT JOIN m ON m.tx = k.tx AND m.pool = k.tok LEFT JOIN u ON u.tx = k.tx""")
def receipt_join(t: Tables) -> DataFrame:
    life = t.lineitem.select(roles.hex_address(F.col("l_partkey")).alias("token"), F.col("l_orderkey").alias("transaction_hash")).distinct()
    pool, side = F.concat(F.lit("pool-"), "l_partkey").alias("pool_address"), roles.hex_address(F.col("l_partkey")).alias("currency0")
    common = [F.lit("0x1").alias("currency1"), F.col("l_quantity").cast("string").alias("amount0_raw"), F.lit("1").alias("amount1_raw")]
    made = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("transaction_hash"), F.col("l_linenumber").alias("log_index"), F.lit("pair_created").alias("event"), pool, side, *common)
    minted = t.lineitem.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("transaction_hash"), (F.col("l_linenumber") + 100).alias("log_index"), F.lit("mint").alias("event"), pool, side, *common)
    return logs.attach_receipt(life, made.unionByName(minted)).select("token", "transaction_hash", "pool_address", "pool_log_index", "mint_log_index", "amm_version")


@query("int24_repair", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(16777216 - 1 - o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS tick FROM orders""")
def int24_repair(t: Tables) -> DataFrame:
    # F rows hold 2^256 - 1 - custkey as unsigned text
    top = wide.to_text(wide.from_hex_word(F.concat(F.lit("f" * 48), F.lpad(F.lower(F.hex(-F.col("o_custkey") - 1)), 16, "0"))))
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", top).otherwise(F.col("o_custkey").cast("string")).alias("raw"))
    return wide.repair_int24(rows, "raw", "tick").select("o_orderkey", "tick")


@query("handle_links", """WITH h AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'c' || o_custkey WHEN '2-HIGH' THEN 'c' || o_custkey WHEN '3-MEDIUM' THEN NULL WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'c' || o_custkey END AS handle FROM orders)
  SELECT o_orderkey, handle, CASE WHEN handle IS NOT NULL THEN count(*) OVER (PARTITION BY handle) END AS tokens_per_handle FROM h""")
def handle_links(t: Tables) -> DataFrame:
    c = F.concat(F.lit("c"), "o_custkey")
    p = F.col("o_orderpriority")
    raw = F.when(p == "1-URGENT", F.concat(F.lit(" @"), c, F.lit("/x"))).when(p == "2-HIGH", F.concat(F.lit("https://T.me/"), c, F.lit("?start=1"))).when(
        p == "3-MEDIUM", F.concat(F.lit("t.me/joinchat/"), c)).when(p == "4-NOT SPECIFIED", F.concat(F.lit("https://example.com/"), c)).otherwise(F.concat(F.lit("telegram.me/@"), c))
    return aggregates.link_counts(t.orders.select("o_orderkey", S.normalize_handle(raw).alias("handle")), "handle").select("o_orderkey", "handle", "tokens_per_handle")


@query("version_classes", "SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') OR p_type = 'ECONOMY' THEN 'newer' WHEN p_brand IN ('Brand#3') OR p_type = 'STANDARD' THEN 'older' ELSE 'other_or_unknown' END AS version_class FROM part")
def version_classes(t: Tables) -> DataFrame:
    classes = {"newer": ("brand#1", "brand#2", "economy"), "older": ("brand#3", "standard")}
    return t.part.select("p_partkey", S.classify_version([F.col("p_brand"), F.col("p_type")], classes).alias("version_class"))


@query("flattened_swaps", """SELECT event_id, 'tx' || event_id AS transaction_hash, CASE WHEN event_type = 'purchase' THEN 'buy' ELSE 'sell' END AS transaction_type, 'm' || user_id AS bought_token_address, value AS bought_amount, value * 2 AS bought_usd_amount,
  'USDC' AS sold_token_symbol, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS total_value_usd FROM events""", "bought_amount bought_usd_amount total_value_usd")
def flattened_swaps(t: Tables) -> DataFrame:
    item = F.to_json(F.struct(
        F.concat(F.lit("tx"), "event_id").alias("transactionHash"), F.when(F.col("event_type") == "purchase", "buy").otherwise("sell").alias("transactionType"),
        F.struct(F.lit("").alias("address"), F.concat(F.lit("m"), "user_id").alias("tokenAddress"), F.lit("n/a").alias("amount"), F.col("value").cast("string").alias("amountFormatted"), (F.col("value") * 2).alias("valueUsd")).alias("bought"),
        F.struct(F.lit("USDC").alias("tokenSymbol")).alias("sold"), F.when(F.col("event_type") == "error", "NaN").otherwise(F.col("value").cast("string")).alias("totalValueUsd"),
    ))
    flat = nested.flatten_swaps(t.events.select("event_id", item.alias("item")), "item", ["event_id"])
    return flat.select("event_id", "transaction_hash", "transaction_type", "bought_token_address", "bought_amount", "bought_usd_amount", "sold_token_symbol", "total_value_usd")


@query("transaction_features", """WITH x AS (SELECT event_id, user_id, value, event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
  SELECT event_id, 'w' || user_id AS fee_payer, value + 1 AS volume_sol_proxy, k AS token_amount_proxy, -value AS fee_payer_sol_delta, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN -k ELSE k END AS fee_payer_token_delta,
    CASE WHEN event_type = 'view' THEN 'unclassified' WHEN event_type = 'click' THEN CASE WHEN k = 0 THEN 'no_fee_payer_token_position' ELSE 'seller_proxy' END ELSE CASE WHEN k = 0 THEN 'holder_no_delta_proxy' ELSE 'buyer_holder_proxy' END END AS decoded_wallet_role FROM x""",
       "volume_sol_proxy token_amount_proxy fee_payer_sol_delta fee_payer_token_delta")
def transaction_features(t: Tables) -> DataFrame:
    k = roles.trader().cast("double")
    wallet, token = F.concat(F.lit("w"), "user_id"), F.concat(F.lit("m"), "user_id")
    ui = lambda v: F.struct(v.cast("string").alias("uiAmountString"))
    held = lambda v: F.struct(F.lit(1).alias("accountIndex"), token.alias("mint"), F.lit("").alias("owner"), ui(v).alias("uiTokenAmount"))
    info = lambda m, v: F.struct(F.struct(F.struct(m.alias("mint"), ui(v).alias("tokenAmount")).alias("info")).alias("parsed"))
    kind = F.col("event_type")
    absent = F.array(held(k)).cast("array<struct<accountIndex:int,mint:string,owner:string,uiTokenAmount:struct<uiAmountString:string>>>")
    none = F.filter(absent, lambda _: F.lit(False))
    meta = F.struct(
        F.array(F.lit(1.0), F.col("value") * 1e9).alias("preBalances"), F.array(F.lit(1.0), F.lit(0.0)).alias("postBalances"),
        F.when(kind == "click", absent).otherwise(none).alias("preTokenBalances"),
        F.when(kind == "view", none).when(kind == "click", F.array(held(F.lit(0.0)))).otherwise(F.array(held(F.when(k == 0, F.lit(0.0)).otherwise(k)))).alias("postTokenBalances"),
        F.array(F.struct(F.array(info(F.lit(nested.NATIVE_MINT), -F.col("value") - 1), info(F.lit(nested.NATIVE_MINT), F.lit(0.5)), info(token, k)).alias("instructions"))).alias("innerInstructions"),
    )
    keys = F.array(F.struct(F.lit("pool").alias("pubkey"), F.lit(False).alias("signer")), F.struct(wallet.alias("pubkey"), F.lit(True).alias("signer")))
    raw = t.events.select("event_id", token.alias("mint"), kind.alias("kind"), F.to_json(F.struct(F.struct(meta.alias("meta"), F.struct(F.struct(keys.alias("accountKeys")).alias("message")).alias("transaction")).alias("result"))).alias("text"))
    rows = nested.tx_features(raw.withColumn("tx", F.from_json("text", nested.TRANSACTION)), "tx", "mint", ["event_id", "kind"])
    role = F.when((F.col("decoded_wallet_role") == "no_fee_payer_token_position") & (F.col("kind") != "click"), "holder_no_delta_proxy").otherwise(F.col("decoded_wallet_role"))
    return rows.select("event_id", "fee_payer", "volume_sol_proxy", "token_amount_proxy", "fee_payer_sol_delta", "fee_payer_token_delta", role.alias("decoded_wallet_role"))


@query("labels_and_clocks", f"""SELECT o_orderkey, CASE WHEN o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' THEN 'pre' WHEN o_orderdate::DATE BETWEEN DATE '1997-01-01' AND DATE '1997-06-30' THEN 'post' END AS period,
  date_diff('day', DATE '{roles.PANEL_EVENT}', o_orderdate::DATE)::INT AS rel_day, greatest(-12, least(12, CAST(floor(date_diff('day', DATE '{roles.PANEL_EVENT}', o_orderdate::DATE) / 7.0) AS INT))) AS rel_week, date_trunc('week', o_orderdate)::DATE AS week_start,
  CASE WHEN o_totalprice <= 0 THEN 'zero' WHEN o_totalprice <= 100000 THEN 'short' WHEN o_totalprice <= 300000 THEN 'medium' ELSE 'long' END AS size_bin,
  CASE o_orderstatus WHEN 'F' THEN 'api_error' WHEN 'O' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'empty' ELSE 'ok' END ELSE CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'ok' ELSE 'page_limit_reached_lower_bound' END END AS scan_status FROM orders""")
def labels_and_clocks(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    rel = S.rel_day(day, roles.PANEL_EVENT)
    base = F.when(F.col("o_orderstatus") == "F", "api_error").when(F.col("o_orderpriority") == "1-URGENT", "empty").otherwise("fetched")
    return t.orders.select(
        "o_orderkey", S.period_label(day, ("1996-01-01", "1996-06-30"), ("1997-01-01", "1997-06-30")).alias("period"), rel.alias("rel_day"), S.rel_week(rel).alias("rel_week"), S.week_start(F.col("o_orderdate")).alias("week_start"),
        S.cut(F.col("o_totalprice"), [-1.0, 0.0, 100000.0, 300000.0, float("inf")], ["zero", "short", "medium", "long"]).alias("size_bin"),
        S.window_status(base, F.col("o_orderstatus") == "P", F.col("o_orderdate"), F.lit("1998-01-01").cast("timestamp_ntz")).alias("scan_status"),
    )


@query("time_flags", f"WITH {roles.LAUNCHES} SELECT mint, (graduated = 1 AND minutes <= 5)::INT AS within_5m, (graduated = 1 AND minutes <= 15)::INT AS within_15m, (graduated = 1 AND minutes <= 60)::INT AS within_60m, (graduated = 1 AND minutes > 60)::INT AS after_60m FROM launches WHERE minutes IS NOT NULL")
def time_flags(t: Tables) -> DataFrame:
    rows = roles.launches(t).where("minutes IS NOT NULL").withColumn("m", F.when(F.col("graduated") == 1, F.col("minutes")))
    return rows.select("mint", *[c.alias(n) for n, c in S.time_flags(F.col("m"), (5, 15, 60)).items()])


# --- filters ---------------------------------------------------------------------------------------------------------

REASONS = f"""{roles.LAUNCHES}, r AS (SELECT *, CASE WHEN priority = '5-LOW' THEN 'malformed' WHEN graduated = 1 AND (minutes IS NULL OR minutes <= 0) THEN 'nonpositive_time' WHEN cap < 1000 THEN 'tiny' END AS reason FROM launches)"""


def rules() -> dict:
    return {"malformed": F.col("priority") == "5-LOW", "nonpositive_time": (F.col("graduated") == 1) & (F.col("minutes").isNull() | (F.col("minutes") <= 0)), "tiny": F.col("cap") < 1000}


@query("filter_counters", f"WITH {REASONS} SELECT count(*) AS raw_rows, count(CASE WHEN reason IS NULL THEN 1 END) AS kept_rows, count(CASE WHEN reason = 'malformed' THEN 1 END) AS malformed, count(CASE WHEN reason = 'nonpositive_time' THEN 1 END) AS nonpositive_time, count(CASE WHEN reason = 'tiny' THEN 1 END) AS tiny FROM r")
def filter_counters(t: Tables) -> DataFrame:
    return filters.filter_with_reasons(roles.launches(t), rules())[1]


@query("filter_kept", f"WITH {REASONS} SELECT mint, cap FROM r WHERE reason IS NULL", "cap")
def filter_kept(t: Tables) -> DataFrame:
    return filters.filter_with_reasons(roles.launches(t), rules())[0].select("mint", "cap")


@query("dedupe_first", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def dedupe_first(t: Tables) -> DataFrame:
    return filters.dedupe_first(t.orders, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("dedupe_priority", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F')::INT DESC, o_orderkey) = 1")
def dedupe_priority(t: Tables) -> DataFrame:
    return filters.dedupe_priority(t.orders, ["o_custkey"], (F.col("o_orderstatus") == "F").cast("int"), [F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("dedupe_last_collect", "SELECT 'c' || o_custkey AS address, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS source_list_types FROM orders GROUP BY o_custkey", "o_totalprice")
def dedupe_last_collect(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "C").otherwise("c"), "o_custkey").alias("raw"))
    return filters.dedupe_last_collect(rows, F.lower("raw"), "o_orderkey", "o_orderstatus", "source_list_types", "address").drop("raw")


@query("latest_per_key", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(t: Tables) -> DataFrame:
    return filters.latest_per_key(t.events, ["user_id"], "ts", [F.desc("event_id")]).select("user_id", "event_id", "event_type")


LEDGER = """led AS (SELECT l_suppkey AS unit_id, l_returnflag AS coverage_type, CASE l_linestatus WHEN 'F' THEN 'processed_with_rows' ELSE CASE WHEN l_linenumber > 3 THEN 'processed_zero_rows' ELSE 'collection_error' END END AS status, l_linenumber AS rows, l_orderkey * 10 + l_linenumber AS seen_at FROM lineitem)"""


def ledger(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_suppkey").alias("unit_id"), F.col("l_returnflag").alias("coverage_type"),
        F.when(F.col("l_linestatus") == "F", "processed_with_rows").when(F.col("l_linenumber") > 3, "processed_zero_rows").otherwise("collection_error").alias("status"),
        F.col("l_linenumber").alias("rows"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen_at"))


BEST_LEDGER = f"""WITH {LEDGER} SELECT unit_id, coverage_type, status, rows, seen_at FROM led QUALIFY row_number() OVER (PARTITION BY unit_id, coverage_type ORDER BY CASE status WHEN 'processed_with_rows' THEN 2 WHEN 'processed_zero_rows' THEN 1 ELSE 0 END DESC, rows DESC, seen_at DESC) = 1"""


@query("dedupe_ranked_ledger", BEST_LEDGER)
def dedupe_ranked_ledger(t: Tables) -> DataFrame:
    return filters.dedupe_ranked(ledger(t), ["unit_id", "coverage_type"], "status", "rows", "seen_at")


@query("distinct_on_keys", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def distinct_on_keys(t: Tables) -> DataFrame:
    return filters.distinct_on(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("unique_or_fail", "SELECT o_orderkey, o_custkey FROM orders")
def unique_or_fail(t: Tables) -> DataFrame:
    return filters.assert_unique(t.orders, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("bounded_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey BETWEEN 1000 AND 9000")
def bounded_rows(t: Tables) -> DataFrame:
    return filters.filter_bounds(t.lineitem, "l_orderkey", 1000, 9000).select("l_orderkey", "l_linenumber", "l_partkey")


@query("pending_work", f"WITH {LEDGER} SELECT s_suppkey AS unit_id FROM supplier WHERE s_suppkey NOT IN (SELECT unit_id FROM led WHERE status LIKE 'processed_%' AND rows >= 7 AND coverage_type = 'R')")
def pending_work(t: Tables) -> DataFrame:
    done = ledger(t).where("rows >= 7 AND coverage_type = 'R'")
    return filters.pending(t.supplier.select(F.col("s_suppkey").alias("unit_id")), done, ["unit_id"], "status")


@query("sample_evenly_spaced", """WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders),
  p AS (SELECT DISTINCT CAST(round_even(k * ((SELECT any_value(n) FROM i) - 1) / 99.0, 0) AS BIGINT) AS pos FROM (SELECT unnest(generate_series(0, 99)) AS k)) SELECT o_orderkey FROM i JOIN p USING (pos)""")
def sample_evenly_spaced(t: Tables) -> DataFrame:
    return filters.sample_positions(t.orders.select("o_orderkey", "o_totalprice"), 100, "even", "o_totalprice", "o_orderkey").select("o_orderkey")


@query("sample_latest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50", "o_totalprice")
def sample_latest(t: Tables) -> DataFrame:
    return filters.sample_positions(t.orders.select("o_orderkey", "o_totalprice"), 50, "latest", "o_totalprice", "o_orderkey")


@query("sample_top_activity", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 25")
def sample_top_activity(t: Tables) -> DataFrame:
    return filters.sample_positions(t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")), 25, "top", "n", "o_custkey")


@query("relative_window", f"WITH {roles.PANEL} SELECT unit, day, volume FROM regional WHERE date_diff('day', DATE '{roles.PANEL_EVENT}', day) BETWEEN -60 AND 60", "volume", digits=4)
def relative_window(t: Tables) -> DataFrame:
    from tidemark.estimators.panel import event_clock, in_window

    return in_window(event_clock(roles.regional_days(t), "day", roles.PANEL_EVENT), 60).select("unit", "day", "volume")


@query("eligible_metadata", f"SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN {roles.hex_address_sql('o_custkey')} ELSE {roles.hex_address_sql('o_orderkey')} END AS early_address FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")
def eligible_metadata(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error").alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", roles.hex_address(F.col("o_custkey"))).otherwise("short").alias("curve"),
        F.when(F.col("o_orderpriority") != "5-LOW", roles.hex_address(F.col("o_orderkey"))).alias("associated"))
    return filters.eligible(rows, "status", "curve", "associated", "early_address").select("o_orderkey", "early_address")


# --- joins -----------------------------------------------------------------------------------------------------------


@query("join_inner_counted", "SELECT (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS matched, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unmatched")
def join_inner_counted(t: Tables) -> DataFrame:
    matched, unmatched = joins.join_inner(t.documents.select("doc_id"), t.labels, ["doc_id"])
    return matched.agg(F.count("*").alias("matched")).withColumn("unmatched", unmatched.scalar())


@query("left_lookup_status", "SELECT d.doc_id, quality, CASE WHEN l.doc_id IS NOT NULL THEN 'observed' ELSE 'not_collected' END AS label_status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def left_lookup_status(t: Tables) -> DataFrame:
    return joins.left_lookup(t.documents.select("doc_id"), t.labels.select("doc_id", "quality"), ["doc_id"], "label_status", "observed", "not_collected")


@query("validated_join", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def validated_join(t: Tables) -> DataFrame:
    right = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.join_validated(t.orders, right, ["o_custkey"], "inner", "m:1", ["c_mktsegment"]).select("o_orderkey", "c_mktsegment")


@query("semi_and_anti", "SELECT doc_id, 'semi' AS kind FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'anti' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def semi_and_anti(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id")
    return joins.join_semi(docs, t.labels, ["doc_id"]).withColumn("kind", F.lit("semi")).unionByName(joins.join_anti(docs, t.labels, ["doc_id"]).withColumn("kind", F.lit("anti")))


@query("token_horizon_grid", f"WITH {roles.TOKENS}, {roles.HORIZONS} SELECT mint, horizon_days FROM tokens CROSS JOIN horizons")
def token_horizon_grid(t: Tables) -> DataFrame:
    return joins.cross_dim(roles.tokens(t).select("mint"), "horizon_days", reshape.HORIZONS)


@query("time_range_join", f"WITH {roles.TOKENS} SELECT event_id, mint FROM events JOIN tokens ON mint = user_id AND ts >= t0 AND ts <= t0 + INTERVAL 7 DAY")
def time_range_join(t: Tables) -> DataFrame:
    events = t.events.select("event_id", F.col("user_id").alias("mint"), "ts")
    tokens = roles.tokens(t)
    return joins.range_join(joins.prefilter_range(events, tokens, "ts", "t0", "7 DAYS"), tokens, "mint", "ts", "t0", "7 DAYS", closed="both").select("event_id", "mint")


@query("either_side_join", "SELECT p_partkey AS mint, count(*) AS trades, sum(l_quantity) AS quantity FROM part JOIN lineitem ON l_partkey = p_partkey OR l_suppkey = p_partkey GROUP BY 1", "quantity")
def either_side_join(t: Tables) -> DataFrame:
    trades = t.lineitem.select(F.col("l_partkey").alias("bought"), F.col("l_suppkey").alias("sold"), "l_quantity")
    hits = joins.either_side_join(trades, t.part.select(F.col("p_partkey").alias("mint")), ("bought", "sold"), "mint")
    return hits.groupBy("mint").agg(F.count("*").alias("trades"), F.sum("l_quantity").alias("quantity"))


@query("block_bound_join", "WITH u AS (SELECT o_custkey AS unit, min(o_orderkey) AS lo, min(o_orderkey) + 3000 AS hi FROM orders GROUP BY 1) SELECT o_orderkey, unit FROM orders JOIN u ON unit = o_custkey AND o_orderkey BETWEEN lo AND hi")
def block_bound_join(t: Tables) -> DataFrame:
    logs_ = t.orders.select("o_orderkey", F.col("o_custkey").alias("unit"))
    units = logs_.groupBy("unit").agg(F.min("o_orderkey").alias("lo"), (F.min("o_orderkey") + 3000).alias("hi"))
    return joins.bounded_join(logs_, units, "unit", "o_orderkey", "lo", "hi").select("o_orderkey", "unit")


@query("asof_implementation", """WITH h AS (SELECT o_orderkey AS blk, 'impl-' || o_orderkey AS new, 'before-' || o_orderkey AS old FROM orders WHERE o_totalprice > 498000)
  SELECT l_orderkey, l_linenumber, l_partkey, coalesce((SELECT arg_max(new, blk) FROM h WHERE blk <= l_orderkey), (SELECT arg_min(old, blk) FROM h)) AS implementation FROM lineitem""")
def asof_implementation(t: Tables) -> DataFrame:
    history = t.orders.where("o_totalprice > 498000").select(F.col("o_orderkey").alias("at"), F.concat(F.lit("impl-"), "o_orderkey").alias("new"), F.concat(F.lit("before-"), "o_orderkey").alias("old"))
    return joins.asof_lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), history, "l_orderkey", "at", "old", "new", "implementation", blocks_per_bucket=1000)


@query("latest_before_cutoff", f"""WITH {roles.TOKENS} SELECT mint, trader, event_id FROM (SELECT mint, CAST(json_extract_string(props, '$.k') AS BIGINT) AS trader, event_id, ts FROM events JOIN tokens ON mint = user_id AND ts <= t0 + INTERVAL 7 DAY)
  QUALIFY row_number() OVER (PARTITION BY mint, trader ORDER BY ts DESC, event_id DESC) = 1""")
def latest_before_cutoff(t: Tables) -> DataFrame:
    rows = roles.trades(t).select(F.col("bought").alias("mint"), "trader", F.col("tx").alias("event_id"), "ts").join(roles.tokens(t), "mint").withColumn("cut", F.col("t0") + F.expr("INTERVAL 7 DAYS"))
    return joins.latest_before(rows, ["mint", "trader"], "ts", "cut", [F.desc("event_id")]).select("mint", "trader", "event_id")


@query("coalesced_sources", """WITH a AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' GROUP BY 1)
  SELECT c_custkey AS k, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'lifecycle' WHEN b.v IS NOT NULL THEN 'mapping' END AS v_source FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey""")
def coalesced_sources(t: Tables) -> DataFrame:
    source = lambda st, pr: t.orders.where((F.col("o_orderstatus") == st) & (F.col("o_orderpriority") == pr)).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return joins.coalesce_join(t.customer.select(F.col("c_custkey").alias("k")), {"lifecycle": source("P", "1-URGENT"), "mapping": source("O", "2-HIGH")}, ["k"], "v")


PAIRING = """x AS (SELECT o_orderkey AS block, o_orderkey AS id, o_orderpriority AS pair, o_orderstatus AS st FROM orders),
era AS (SELECT max(block) // 2 AS last FROM x), tr AS (SELECT * FROM x WHERE st = 'P' AND block > (SELECT last FROM era)), co AS (SELECT * FROM x WHERE st = 'F' AND block <= (SELECT last FROM era)),
tn AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY block) AS n FROM tr), cn AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY block DESC) AS n FROM co),
m AS (SELECT tn.id, tn.block, tn.pair, cn.id AS control_id, cn.block AS control_block FROM tn LEFT JOIN cn ON cn.pair = tn.pair AND cn.n = tn.n),
l2 AS (SELECT id, block, pair, row_number() OVER (ORDER BY block) AS n FROM m WHERE control_id IS NULL), f2 AS (SELECT id, block, row_number() OVER (ORDER BY block DESC) AS n FROM co WHERE id NOT IN (SELECT control_id FROM m WHERE control_id IS NOT NULL))"""


@query("matched_without_replacement", f"""WITH {PAIRING} SELECT id, block, pair, control_id, control_block, 'same_pair' AS match_kind, abs(control_block - block) AS match_distance_blocks FROM m WHERE control_id IS NOT NULL
  UNION ALL SELECT l2.id, l2.block, l2.pair, f2.id, f2.block, CASE WHEN f2.id IS NULL THEN 'unmatched' ELSE 'fallback' END, abs(f2.block - l2.block) FROM l2 LEFT JOIN f2 ON f2.n = l2.n""")
def matched_without_replacement(t: Tables) -> DataFrame:
    x = t.orders.select(F.col("o_orderkey").alias("block"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("pair"), F.col("o_orderstatus").alias("st"))
    # the older half of the blocks is the control era, whatever the size of the table
    last = x.agg(F.expr("max(block) div 2")).scalar()
    return joins.match_without_replacement(x.where((F.col("st") == "P") & (F.col("block") > last)).drop("st"), x.where((F.col("st") == "F") & (F.col("block") <= last)).drop("st"), "pair", "block", "id")


@query("nearest_cohort", """WITH s AS (SELECT min(o_orderkey) AS b FROM orders WHERE o_totalprice > 400000)
  (SELECT o_orderkey, 'pre' AS cohort_side FROM orders WHERE o_totalprice <= 400000 AND o_orderkey < (SELECT b FROM s) ORDER BY o_orderkey DESC LIMIT 40) UNION ALL (SELECT o_orderkey, 'post' FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey LIMIT 40)""")
def nearest_cohort(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 400000, "newer").otherwise("older").alias("version"), F.col("o_orderkey").alias("tie"))
    return joins.nearest_cohort(rows, "version", "newer", "older", "o_orderkey", "tie", 40).select("o_orderkey", "cohort_side")


@query("metadata_enrich", "SELECT o_orderkey, o_custkey, o_orderstatus AS status, c_mktsegment AS status_metadata, c_acctbal FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0", "c_acctbal")
def metadata_enrich(t: Tables) -> DataFrame:
    meta = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("status"), "c_acctbal")
    return joins.enrich(t.orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status")), meta, ["o_custkey"])


@query("filled_from_older", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN o_orderpriority = '5-LOW' THEN CASE WHEN o_orderstatus = 'P' THEN 'not_requested' END ELSE 'old-' || o_custkey END AS holder_status FROM orders")
def filled_from_older(t: Tables) -> DataFrame:
    new = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).when(F.col("o_orderstatus") == "P", "not_requested").alias("holder_status"))
    old = t.orders.where("o_orderpriority <> '5-LOW'").select("o_orderkey", F.concat(F.lit("old-"), "o_custkey").alias("holder_status"))
    return joins.fill_from(new, old, ["o_orderkey"], ["holder_status"], ["not_requested"])


@query("best_related_row", "SELECT l_partkey, l_orderkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_quantity DESC, l_orderkey) = 1", "l_extendedprice")
def best_related_row(t: Tables) -> DataFrame:
    return joins.best_by(t.lineitem, ["l_partkey"], ["l_extendedprice", "l_quantity"], [F.asc("l_orderkey")]).select("l_partkey", "l_orderkey", "l_extendedprice")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("grouped_statistics", """WITH l AS (SELECT event_type, 'value' AS metric, value AS v FROM events UNION ALL SELECT event_type, 'k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events)
  SELECT event_type, metric, count(v) AS n, sum(v) AS total, avg(v) AS mean, quantile_cont(v, 0.25) AS p25, median(v) AS median, quantile_cont(v, 0.9) AS p90 FROM l GROUP BY 1, 2""", "total mean p25 median p90")
def grouped_statistics(t: Tables) -> DataFrame:
    return aggregates.agg_stats(t.events.withColumn("k", roles.trader()), ["event_type"], ["value", "k"], {"p25": 0.25, "median": 0.5, "p90": 0.9})


@query("exact_quantiles", "SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.75) AS p75, quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1, 2", "p25 p75 p90 p99", digits=4)
def exact_quantiles(t: Tables) -> DataFrame:
    return ranking.quantiles(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p25": 0.25, "p75": 0.75, "p90": 0.9, "p99": 0.99})


@query("distinct_counts", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_l_suppkey, count(DISTINCT l_partkey) AS n_l_partkey, count(DISTINCT l_orderkey) AS n_l_orderkey FROM lineitem GROUP BY 1")
def distinct_counts(t: Tables) -> DataFrame:
    return aggregates.n_unique(t.lineitem, ["l_returnflag"], ["l_suppkey", "l_partkey", "l_orderkey"])


@query("conditional_aggregates", """SELECT o_custkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS done_n, bool_or(o_orderstatus = 'F') AS done_any, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS done_sum,
  count(CASE WHEN o_totalprice > 400000 THEN 1 END) AS large_n, bool_or(o_totalprice > 400000) AS large_any, sum(CASE WHEN o_totalprice > 400000 THEN o_totalprice END) AS large_sum FROM orders GROUP BY 1""", "done_sum large_sum", digits=4)
def conditional_aggregates(t: Tables) -> DataFrame:
    return aggregates.agg_if(t.orders, ["o_custkey"], {"done": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 400000}, F.col("o_totalprice"))


@query("group_rates", "SELECT o_orderpriority, count(*) AS n, CAST(sum((o_orderstatus = 'F')::INT) AS BIGINT) AS hits, avg((o_orderstatus = 'F')::INT) AS rate FROM orders GROUP BY 1", "rate")
def group_rates(t: Tables) -> DataFrame:
    return aggregates.rate_by(t.orders, ["o_orderpriority"], F.col("o_orderstatus") == "F")


@query("rate_difference", "SELECT avg(CASE WHEN o_totalprice > 250000 THEN (o_orderstatus = 'F')::INT END) AS rate_in, avg(CASE WHEN o_totalprice <= 250000 THEN (o_orderstatus = 'F')::INT END) AS rate_out, avg(CASE WHEN o_totalprice > 250000 THEN (o_orderstatus = 'F')::INT END) - avg(CASE WHEN o_totalprice <= 250000 THEN (o_orderstatus = 'F')::INT END) AS rate_difference FROM orders", "rate_in rate_out rate_difference")
def rate_difference(t: Tables) -> DataFrame:
    return aggregates.rate_difference(t.orders, F.col("o_totalprice") > 250000, F.col("o_orderstatus") == "F")


@query("weighted_moments", "SELECT l_returnflag, count(*) AS n, sum(l_quantity * l_discount) / sum(l_quantity) AS weighted_mean, sum(l_quantity * l_discount * l_discount) / sum(l_quantity) - power(sum(l_quantity * l_discount) / sum(l_quantity), 2) AS weighted_var FROM lineitem WHERE l_quantity > 0 GROUP BY 1", "weighted_mean weighted_var", digits=9)
def weighted_moments(t: Tables) -> DataFrame:
    return aggregates.weighted_moments(t.lineitem, ["l_returnflag"], "l_discount", "l_quantity")


@query("pooled_deviation", "SELECT l_returnflag, sqrt((var_samp(CASE WHEN l_linestatus = 'F' THEN l_quantity END) + var_samp(CASE WHEN l_linestatus = 'O' THEN l_quantity END)) / 2) AS pooled_sd, stddev_samp(l_quantity) AS union_sd FROM lineitem GROUP BY 1", "pooled_sd union_sd")
def pooled_deviation(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("g", (F.col("l_linestatus") == "F").cast("int"))
    union = aggregates.pooled_sd(rows, ["l_returnflag"], "l_quantity", "g", "union").withColumnRenamed("pooled_sd", "union_sd")
    return aggregates.pooled_sd(rows, ["l_returnflag"], "l_quantity", "g").join(union, "l_returnflag")


@query("modal_label", "WITH c AS (SELECT o_custkey, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, label AS mode, n AS mode_n, (SELECT sum(n)::BIGINT FROM c d WHERE d.o_custkey = c.o_custkey) AS n FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, label) = 1")
def modal_label(t: Tables) -> DataFrame:
    return aggregates.mode_of(t.orders, ["o_custkey"], "o_orderpriority")


@query("value_shares", "SELECT o_orderstatus, count(*) AS n, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1", "share")
def value_shares(t: Tables) -> DataFrame:
    return aggregates.value_counts(t.orders, "o_orderstatus")


@query("daily_cohort_rollup", "SELECT o_orderpriority AS platform, CAST(o_orderdate AS DATE) AS day, count(*) AS launches, count(DISTINCT o_custkey) AS unique_creators, CAST(sum((o_orderstatus = 'F')::INT) AS BIGINT) AS graduated, avg((o_orderstatus = 'F')::INT) AS graduated_rate FROM orders GROUP BY 1, 2", "graduated_rate")
def daily_cohort_rollup(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("platform"), F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("creator"), (F.col("o_orderstatus") == "F").cast("int").alias("graduated"))
    return aggregates.daily_cohorts(rows, ["platform", "day"], "creator", ["graduated"])


@query("first_and_last", "SELECT user_id, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
def first_and_last(t: Tables) -> DataFrame:
    return aggregates.first_last(t.events, ["user_id"], "ts")


@query("entity_coverage", "SELECT count(DISTINCT doc_id) AS observed_entities, count(*) AS observed_rows, count(DISTINCT doc_id) * 100.0 / 1000 AS percent_of_target, min(doc_id) AS first_at, max(doc_id) AS last_at FROM labels", "percent_of_target")
def entity_coverage(t: Tables) -> DataFrame:
    return aggregates.coverage_record(t.labels.withColumn("at", F.col("doc_id")), "doc_id", "at", 1000)


@query("channel_days", """SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS message_count, sum(value) AS view_sum, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS forward_sum, CAST(sum((event_type = 'click')::INT) AS BIGINT) AS reply_sum, count(DISTINCT hour(ts)) AS active_hours, median(value) AS view_median
  FROM events GROUP BY 1, 2""", "view_sum view_median")
def channel_days(t: Tables) -> DataFrame:
    rows = t.events.withColumn("forwards", roles.trader()).withColumn("replies", (F.col("event_type") == "click").cast("int"))
    return aggregates.channel_day(rows, "user_id", "ts", "value", "forwards", "replies")


# --- windows, order, sets --------------------------------------------------------------------------------------------


@query("ranked_rows", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def ranked_rows(t: Tables) -> DataFrame:
    order = [F.desc("o_totalprice"), F.desc("o_orderdate"), F.asc("o_orderkey")]
    return windows.rank_rows(t.orders, ["o_custkey"], order, 3).select("o_custkey", "o_orderkey", "rank")


@query("partition_share", "SELECT o_orderkey, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS share FROM orders", "share", digits=9)
def partition_share(t: Tables) -> DataFrame:
    return windows.share_of(t.orders, ["o_custkey"], "o_totalprice").select("o_orderkey", "share")


@query("running_balance", """WITH d AS (SELECT l_suppkey, l_shipdate, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
  SELECT l_suppkey, l_shipdate, q, sum(q) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance FROM d""", "q balance")
def running_balance(t: Tables) -> DataFrame:
    daily = t.lineitem.groupBy("l_suppkey", "l_shipdate").agg(F.sum("l_quantity").alias("q"))
    return ranking.running_sum(daily, ["l_suppkey"], F.trunc("l_shipdate", "month"), [F.asc("l_shipdate")], "q", "balance")


@query("absolute_rank", "SELECT c_custkey, rank() OVER (ORDER BY abs(c_acctbal) DESC) AS abs_rank FROM customer")
def absolute_rank(t: Tables) -> DataFrame:
    return windows.abs_rank(t.customer, "c_acctbal").select("c_custkey", "abs_rank")


@query("group_mean_broadcast", "SELECT o_orderkey, avg(o_totalprice) OVER (PARTITION BY o_custkey) AS group_mean FROM orders", "group_mean", digits=7)
def group_mean_broadcast(t: Tables) -> DataFrame:
    return windows.group_mean(t.orders, ["o_custkey"], "o_totalprice", "group_mean").select("o_orderkey", "group_mean")


LAGS = ", ".join(f"lag(v, {i}) OVER (PARTITION BY unit ORDER BY day) AS v{i}" for i in range(1, 4))


@query("lagged_products", f"""WITH {roles.PANEL}, s AS (SELECT unit, day, volume / 1000000 AS v FROM regional), l AS (SELECT unit, v, {LAGS} FROM s)
  {' UNION ALL '.join(f"SELECT unit, {i} AS lag, sum(v * {'v' if i == 0 else f'v{i}'}) AS product_sum, count({'v' if i == 0 else f'v{i}'}) AS pairs, {1 - i / 4} AS bartlett FROM l GROUP BY 1" for i in range(4))}""", "product_sum bartlett", digits=4)
def lagged_products(t: Tables) -> DataFrame:
    return windows.lag_products(roles.regional_days(t).withColumn("v", F.col("volume") / 1000000), ["unit"], "day", "v", 3)


@query("sliding_contrast", f"""WITH {roles.PANEL}, c AS (SELECT unit, day, avg(volume) OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) - avg(volume) OVER (PARTITION BY unit ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS contrast,
  row_number() OVER (PARTITION BY unit ORDER BY day) AS i, count(*) OVER (PARTITION BY unit) AS n FROM regional) SELECT unit, day, contrast FROM c WHERE i > 28 AND i <= n - 6""", "contrast", digits=4)
def sliding_contrast(t: Tables) -> DataFrame:
    return windows.sliding_contrast(roles.regional_days(t), ["unit"], "day", "volume", 28, 7)


@query("adoption_counts", "WITH a AS (SELECT o_custkey, min(o_orderdate) AS adopted_at FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT a.o_custkey, adopted_at, (SELECT count(*) FROM orders o WHERE o.o_custkey = a.o_custkey AND o_orderstatus = 'F' AND o_orderdate < adopted_at) AS pre_count FROM a")
def adoption_counts(t: Tables) -> DataFrame:
    return windows.pre_counts(t.orders, "o_custkey", "o_orderdate", F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P")


@query("topk_sums", "SELECT l_partkey, sum(l_extendedprice) AS top10_sum FROM (SELECT l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC) <= 10) GROUP BY 1", "top10_sum", digits=4)
def topk_sums(t: Tables) -> DataFrame:
    return windows.topk_sum(t.lineitem, ["l_partkey"], "l_extendedprice", 10, "top10_sum")


@query("chain_order_head", "(SELECT 'head' AS part, l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20) UNION ALL (SELECT 'tail', l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 20)")
def chain_order_head(t: Tables) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    pick = lambda df, name: df.select(F.lit(name).alias("part"), "l_orderkey", "l_linenumber", "l_partkey")
    return pick(windows.head_n(t.lineitem, order, 20), "head").unionByName(pick(windows.tail_n(t.lineitem, order, 20), "tail"))


@query("chain_sorted_rows", "SELECT o_orderkey, o_custkey FROM orders")
def chain_sorted_rows(t: Tables) -> DataFrame:
    return windows.sort_events(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")


@query("stacked_panel", f"WITH {roles.PANEL} SELECT unit, day, volume, NULL::BIGINT AS n FROM regional UNION ALL SELECT 'events', CAST(ts AS DATE), NULL, count(*) FROM events GROUP BY 2", "volume", digits=4)
def stacked_panel(t: Tables) -> DataFrame:
    counts = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).withColumn("unit", F.lit("events"))
    return sets.union_panel([roles.regional_days(t).select("unit", "day", "volume"), counts])


@query("overlap_audit", """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem), n AS (SELECT count(*) AS c FROM a JOIN b USING (k))
  SELECT (SELECT count(*) FROM a) AS size_a, (SELECT count(*) FROM b) AS size_b, c AS size_both, c / (SELECT count(*) FROM b) AS share_of_b FROM n""", "share_of_b")
def overlap_audit(t: Tables) -> DataFrame:
    nested_side = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.struct(F.col("l_suppkey").alias("k"))).alias("hits"))
    return sets.overlap(t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")), sets.explode_nested_key(nested_side, "hits", "k", "k"), "k")


@query("missing_keys", "SELECT doc_id, 'a' AS only_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'b' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def missing_keys(t: Tables) -> DataFrame:
    return sets.missing_keys(t.documents, t.labels, "doc_id")


@query("covered_split", "SELECT covered, count(*) AS n, avg(n_chars) AS mean_chars FROM (SELECT n_chars, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 0 END AS covered FROM documents) GROUP BY 1", "mean_chars")
def covered_split(t: Tables) -> DataFrame:
    return sets.covered_flag(t.documents.select("doc_id", "n_chars"), t.labels, "doc_id").groupBy("covered").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars"))


# --- reshape ---------------------------------------------------------------------------------------------------------


@query("pivoted_sides", "SELECT l_suppkey, avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS \"A\", avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS \"N\", avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS \"R\" FROM lineitem GROUP BY 1", '"A" "N" "R"')
def pivoted_sides(t: Tables) -> DataFrame:
    return reshape.pivot_wide(t.lineitem, ["l_suppkey"], "l_returnflag", ["A", "N", "R"], "l_quantity")


@query("creator_day_grid", """WITH x AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders), e AS (SELECT max(day) AS high FROM x), c AS (SELECT o_custkey, day, count(*) AS n FROM x, e WHERE day > high - 31 GROUP BY 1, 2), k AS (SELECT DISTINCT o_custkey FROM c), d AS (SELECT high - CAST(unnest(range(31)) AS INT) AS day FROM e)
  SELECT k.o_custkey, d.day, coalesce(n, 0) AS n FROM k CROSS JOIN d LEFT JOIN c ON c.o_custkey = k.o_custkey AND c.day = d.day""")
def creator_day_grid(t: Tables) -> DataFrame:
    # the window is the last 31 days of the table
    high = t.orders.agg(F.max(F.to_date("o_orderdate"))).first()[0]
    low = high - datetime.timedelta(days=30)
    month = t.orders.withColumn("day", F.to_date("o_orderdate")).where(F.col("day") >= F.lit(low))
    return reshape.dense_counts(month.select("o_custkey", "day"), "o_custkey", "day", str(low), str(high))


@query("expected_grid", f"WITH {roles.HORIZONS} SELECT o_custkey, launch, horizon_days, launch + horizon_days * 43200 + 2000 AS cutoff_block FROM (SELECT o_custkey, min(o_orderkey) AS launch FROM orders GROUP BY 1) CROSS JOIN horizons")
def expected_grid(t: Tables) -> DataFrame:
    manifest = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("launch"))
    return reshape.expected_grid(manifest, "launch", 43_200)


@query("rank_quantile_bins", """WITH x AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal >= 0) SELECT c_custkey, CAST(greatest(0, ((r - 1) * 10 + n - 2) // (n - 1) - 1) AS INT) AS decile
  FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS r, count(*) OVER () AS n FROM x) UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_acctbal < 0""")
def rank_quantile_bins(t: Tables) -> DataFrame:
    valued = t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("value"))
    return reshape.rank_bins(valued, "value", 10, "c_custkey", "decile").select("c_custkey", "decile")


@query("global_positions", "SELECT l.event_id, row_number() OVER (ORDER BY value, event_id) AS row_index FROM events l")
def global_positions(t: Tables) -> DataFrame:
    return ranking.global_index(t.events.select("event_id", "value"), "value", "event_id").select("event_id", "row_index")


@query("censored_outcomes", f"""WITH {roles.LAUNCHES} SELECT mint, CASE WHEN created_at > TIMESTAMP '2001-06-01' - INTERVAL 7 DAY THEN NULL ELSE coalesce(ship <= created_at + INTERVAL 7 DAY, false) END AS within_7d,
  CASE WHEN created_at > TIMESTAMP '2001-06-01' - INTERVAL 30 DAY THEN NULL ELSE coalesce(ship <= created_at + INTERVAL 30 DAY, false) END AS within_30d FROM launches""")
def censored_outcomes(t: Tables) -> DataFrame:
    now = F.lit("2001-06-01").cast("timestamp_ntz")
    return roles.launches(t).select("mint", *[S.censored_outcome(F.col("created_at"), F.col("ship"), h, now).alias(f"within_{h}d") for h in (7, 30)])
