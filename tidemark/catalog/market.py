"""Market outcome queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.catalog import roles
from tidemark.catalog.registry import Tables, query
from tidemark.session import settle
from tidemark.functions import scalars
from tidemark.operators import joins, reshape
from tidemark.plans import cofiring, market
from tidemark.sources.readers import import_swaps, import_transfers

BASE = f"{roles.TOKENS}, {roles.TRADES}, {roles.HORIZONS}"
NEAR = f"{BASE}, near AS (SELECT mint, t0, trades.* FROM tokens JOIN trades ON bought = mint AND ts >= t0 AND ts < t0 + INTERVAL 30 DAY)"

POST_EVENT = f"""
WITH {NEAR},
by_horizon AS (
  SELECT k.mint, k.t0, h.horizon_days, count(DISTINCT n.tx) AS swap_count, count(DISTINCT n.trader) AS active_traders,
    coalesce(sum(n.usd), 0) AS volume_usd, min(n.ts) AS first_trade_at, max(n.ts) AS last_trade_at
  FROM tokens k CROSS JOIN horizons h LEFT JOIN near n ON n.mint = k.mint AND n.ts < k.t0 + to_days(h.horizon_days)
  GROUP BY ALL),
late AS (SELECT mint, max(CASE WHEN date_trunc('day', ts) >= date_trunc('day', t0 + INTERVAL 7 DAY) THEN 1 ELSE 0 END) AS hit FROM near GROUP BY 1)
SELECT b.mint, b.t0 AS graduated_at, b.horizon_days, swap_count, active_traders, volume_usd, first_trade_at, last_trade_at,
  date_sub('hour', first_trade_at, last_trade_at) AS inactivity_gap_hours, coalesce(l.hit, 0) AS reactivated_after_7d
FROM by_horizon b LEFT JOIN late l ON l.mint = b.mint"""


@query("post_event_activity", POST_EVENT, "volume_usd")
def post_event_activity(t: Tables) -> DataFrame:
    return market.post_event_activity(roles.tokens(t), roles.trades(t))


@query("post_event_activity_either_side", f"""
WITH part_tokens AS (SELECT p_partkey AS mint, TIMESTAMP '1997-01-01' + to_days(p_size) AS t0 FROM part), {roles.HORIZONS},
near AS (SELECT mint, t0, l_orderkey AS tx, l_linenumber AS trader, l_extendedprice AS usd, l_shipdate AS ts
  FROM part_tokens JOIN lineitem ON (l_partkey = mint OR l_suppkey = mint) AND l_shipdate >= t0 AND l_shipdate < t0 + INTERVAL 30 DAY),
by_horizon AS (SELECT k.mint, k.t0, h.horizon_days, count(DISTINCT n.tx) AS swap_count, count(DISTINCT n.trader) AS active_traders,
    coalesce(sum(n.usd), 0) AS volume_usd, min(n.ts) AS first_trade_at, max(n.ts) AS last_trade_at
  FROM part_tokens k CROSS JOIN horizons h LEFT JOIN near n ON n.mint = k.mint AND n.ts < k.t0 + to_days(h.horizon_days) GROUP BY ALL)
SELECT mint, t0 AS graduated_at, horizon_days, swap_count, active_traders, volume_usd, first_trade_at, last_trade_at,
  date_diff('microsecond', first_trade_at, last_trade_at) / 3600000000.0 AS inactivity_gap_hours,
  CASE WHEN horizon_days = 30 AND last_trade_at >= t0 + INTERVAL 7 DAY THEN 1 ELSE 0 END AS reactivated_after_7d
FROM by_horizon""", "volume_usd inactivity_gap_hours", digits=4)
def post_event_either_side(t: Tables) -> DataFrame:
    tokens = t.part.select(F.col("p_partkey").alias("mint"), (F.lit("1997-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("p_size"))).alias("t0"))
    trades = t.lineitem.select(
        F.col("l_partkey").alias("bought"), F.col("l_suppkey").alias("sold"), F.col("l_orderkey").alias("tx"),
        F.col("l_linenumber").alias("trader"), F.col("l_extendedprice").alias("usd"), F.col("l_shipdate").alias("ts"),
    )
    return market.post_event_activity(tokens, trades, reactivation="within_horizon", gap="fractional_hours")


@query("proxy_windows", f"""
WITH {BASE},
sigs AS (SELECT mint, t0, tx, ts, event_type = 'error' AS failed, trader, CASE WHEN event_type = 'purchase' THEN usd END AS sol,
  CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS parsed FROM tokens JOIN trades ON bought = mint),
inside AS (SELECT k.mint, k.t0, h.horizon_days, s.tx, s.ts, s.trader, s.sol, s.parsed
  FROM tokens k CROSS JOIN horizons h LEFT JOIN sigs s ON s.mint = k.mint AND NOT s.failed AND s.ts < k.t0 + to_days(h.horizon_days)),
scanned AS (SELECT mint, count(*) AS n FROM sigs GROUP BY 1)
SELECT i.mint, i.t0 AS graduated_at, i.horizon_days, 'pool-' || i.mint AS pool_address, count(tx) AS swap_count, count(DISTINCT trader) AS active_traders,
  sum(sol) AS volume_sol_proxy, min(ts) AS first_trade_at, max(ts) AS last_trade_at,
  date_diff('microsecond', min(ts), max(ts)) / 3600000000.0 AS inactivity_gap_hours,
  CASE WHEN i.horizon_days = 30 THEN coalesce(max(CASE WHEN ts >= i.t0 + INTERVAL 7 DAY THEN 1 ELSE 0 END), 0) ELSE 0 END AS reactivated_after_7d,
  coalesce(max(n), 0) AS signatures_scanned, CAST(coalesce(sum(parsed), 0) AS BIGINT) AS transactions_parsed,
  CASE WHEN i.t0 < TIMESTAMP '2024-01-03' THEN 'ok' ELSE 'page_limit_reached_lower_bound' END AS window_status
FROM inside i LEFT JOIN scanned c ON c.mint = i.mint GROUP BY i.mint, i.t0, i.horizon_days""", "volume_sol_proxy inactivity_gap_hours", digits=4)
def proxy_windows(t: Tables) -> DataFrame:
    tokens = roles.tokens(t).select(
        "mint", "t0", F.concat(F.lit("pool-"), F.col("mint")).alias("pool_address"),
        F.when(F.col("t0") < F.lit("2024-01-03").cast("timestamp_ntz"), "ok").otherwise("page_limit_reached_lower_bound").alias("window_status"),
    )
    signatures = roles.trades(t).select(
        F.col("bought").alias("mint"), F.col("tx").alias("signature"), "ts", (F.col("event_type") == "error").cast("int").alias("failed"),
        F.col("trader").cast("string").alias("fee_payer"), F.when(F.col("event_type") == "purchase", F.col("usd")).alias("sol"),
        (F.col("event_type") != "view").cast("int").alias("parsed"),
    )
    return market.proxy_windows(tokens, signatures)


EARLY = 86_400
EARLY_CORE = """ranked AS (SELECT *, w / nullif(sum(w) OVER (PARTITION BY mint), 0) AS share,
  row_number() OVER (PARTITION BY mint ORDER BY w DESC) AS rk FROM early)"""
TOPS = ", ".join(f"sum(CASE WHEN rk <= {k} THEN share ELSE 0 END) AS top{k}_early_{{}}_share" for k in (1, 5, 10))


@query("early_concentration", f"""
WITH {NEAR}, early AS (SELECT mint, min(t0) AS t0, trader AS buyer, sum(usd) AS w, min(ts) AS first, max(ts) AS last FROM near
  WHERE ts < t0 + INTERVAL {EARLY} SECOND GROUP BY mint, trader), {EARLY_CORE}
SELECT mint, min(t0) AS launch_or_graduated_at, {EARLY} AS early_window_seconds, count(DISTINCT buyer) AS early_buyers, sum(w) AS early_buy_volume_usd,
  {TOPS.format('buyer', 'buyer', 'buyer')}, sum(power(share, 2)) AS early_buyer_hhi, min(first) AS first_trade_at, max(last) AS last_early_trade_at
FROM ranked GROUP BY mint""", "early_buy_volume_usd top1_early_buyer_share top5_early_buyer_share top10_early_buyer_share early_buyer_hhi")
def early_concentration(t: Tables) -> DataFrame:
    buys = roles.trades(t).select(F.col("bought").alias("mint"), F.col("trader").alias("buyer"), "usd", "ts")
    return market.early_concentration(roles.tokens(t), buys, EARLY)


@query("early_wallets", f"""
WITH {BASE}, early AS (SELECT mint, trader, count(DISTINCT tx) AS n, sum(usd) AS usd, min(ts) AS first, max(ts) AS last,
    CASE WHEN sum(usd) > 0 THEN sum(usd) ELSE CAST(count(DISTINCT tx) AS DOUBLE) END AS w
  FROM (SELECT k.mint, x.tx, x.trader, x.ts, CASE WHEN x.event_type IN ('purchase', 'click') THEN x.usd ELSE 0 END AS usd
    FROM tokens k JOIN trades x ON bought = mint AND ts >= t0 AND ts < t0 + INTERVAL {EARLY} SECOND WHERE x.event_type <> 'signup') GROUP BY 1, 2),
{EARLY_CORE},
g AS (SELECT mint, count(DISTINCT trader) AS n, sum(usd) AS usd, {TOPS.format('wallet', 'wallet', 'wallet')}, sum(power(share, 2)) AS hhi,
  min(first) AS first, max(last) AS last FROM ranked GROUP BY mint)
SELECT k.mint, k.t0 AS launch_or_graduated_at, {EARLY} AS early_window_seconds, coalesce(g.n, 0) AS early_wallets, coalesce(g.usd, 0) AS early_volume_usd,
  coalesce(top1_early_wallet_share, 0) AS top1_early_wallet_share, coalesce(top5_early_wallet_share, 0) AS top5_early_wallet_share,
  coalesce(top10_early_wallet_share, 0) AS top10_early_wallet_share, coalesce(hhi, 0) AS early_wallet_hhi,
  CASE WHEN top1_early_wallet_share >= 0.80 THEN 1 ELSE 0 END AS sniper_top1_80pct, CASE WHEN top5_early_wallet_share >= 0.95 THEN 1 ELSE 0 END AS sniper_top5_95pct,
  g.first AS first_trade_at, g.last AS last_early_trade_at
FROM tokens k LEFT JOIN g ON g.mint = k.mint""", "early_volume_usd top1_early_wallet_share top5_early_wallet_share top10_early_wallet_share early_wallet_hhi")
def early_wallets(t: Tables) -> DataFrame:
    trades = roles.trades(t).where("event_type <> 'signup'").withColumn(
        "usd", F.when(F.col("event_type").isin("purchase", "click"), F.col("usd"))
    )
    return market.early_wallets(roles.tokens(t), trades, EARLY)


@query("early_proxy", f"""
WITH {NEAR}, tx AS (SELECT mint, t0, ts, trader, CASE WHEN event_type = 'purchase' THEN usd END AS sol, CASE WHEN event_type = 'click' THEN usd / 2 END AS tok,
    CASE event_type WHEN 'purchase' THEN 'buyer_holder_proxy' WHEN 'click' THEN 'seller_proxy' WHEN 'view' THEN 'holder_no_delta_proxy' ELSE 'unclassified' END AS role
  FROM near WHERE ts < t0 + INTERVAL {EARLY} SECOND AND event_type <> 'error'),
early AS (SELECT mint, trader, sum(coalesce(sol, tok, 1.0)) AS w FROM tx GROUP BY 1, 2), {EARLY_CORE},
c AS (SELECT mint, count(*) AS n, sum(w) AS total, {TOPS.format('buyer', 'buyer', 'buyer')}, sum(share * share) AS hhi FROM ranked GROUP BY 1),
r AS (SELECT mint, count(DISTINCT CASE WHEN role LIKE 'buyer%' THEN trader END) AS buyers, count(DISTINCT CASE WHEN role LIKE '%holder%' THEN trader END) AS holders,
  count(CASE WHEN role <> 'unclassified' THEN 1 END) AS yes, count(CASE WHEN role = 'unclassified' THEN 1 END) AS no, count(*) AS parsed, min(ts) AS first, max(ts) AS last FROM tx GROUP BY 1)
SELECT k.mint, k.t0 AS launch_or_graduated_at, coalesce(n, 0) AS early_buyers, coalesce(buyers, 0) AS decoded_buyer_proxy_wallets,
  coalesce(holders, 0) AS decoded_holder_proxy_wallets, coalesce(yes, 0) AS classified_early_transactions, coalesce(no, 0) AS unclassified_early_transactions,
  coalesce(parsed, 0) AS transactions_parsed, total AS early_buy_volume_sol_proxy, top1_early_buyer_share, top5_early_buyer_share, top10_early_buyer_share,
  hhi AS early_buyer_hhi, first AS first_trade_at, last AS last_early_trade_at
FROM tokens k LEFT JOIN c ON c.mint = k.mint LEFT JOIN r ON r.mint = k.mint""",
       "early_buy_volume_sol_proxy top1_early_buyer_share top5_early_buyer_share top10_early_buyer_share early_buyer_hhi")
def early_proxy(t: Tables) -> DataFrame:
    tokens = roles.tokens(t)
    kind = F.col("event_type")
    rows = joins.range_join(roles.trades(t).withColumnRenamed("bought", "mint"), tokens, "mint", "ts", "t0", f"{EARLY} SECONDS").select(
        "mint", "ts", (kind == "error").cast("int").alias("failed"), F.col("trader").cast("string").alias("fee_payer"),
        F.when(kind == "purchase", F.col("usd")).alias("sol"), F.when(kind == "click", F.col("usd") / 2).alias("token_amount"),
        scalars.trade_role(
            F.when(kind == "purchase", 1.0).when(kind == "click", -1.0).when(kind == "view", 0.0),
            F.when(kind == "click", 0.0).otherwise(1.0),
        ).alias("role"), F.lit(1).alias("parsed"),
    )
    return market.early_proxy(tokens, rows)


@query("holder_snapshots", """
WITH k AS (SELECT p_partkey AS mint, TIMESTAMP '1998-01-01' + to_days(p_size) AS t0 FROM part),
daily AS (SELECT l_partkey AS mint, o_custkey AS owner, l_shipdate AS ts, sum(l_quantity) AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
bal AS (SELECT mint, owner, ts, sum(q) OVER (PARTITION BY mint, owner ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS amount FROM daily),
h AS (SELECT unnest([0, 7, 30]) AS snapshot_horizon_days),
latest AS (SELECT k.mint, h.snapshot_horizon_days, owner, arg_max(amount, ts) AS b FROM k CROSS JOIN h JOIN bal ON bal.mint = k.mint AND ts <= t0 + to_days(snapshot_horizon_days) GROUP BY 1, 2, 3),
shares AS (SELECT *, b / sum(b) OVER (PARTITION BY mint, snapshot_horizon_days) AS share FROM latest WHERE b > 0),
ranked AS (SELECT *, row_number() OVER w AS rk, sum(b) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(b) OVER (PARTITION BY mint, snapshot_horizon_days) AS cum
  FROM shares WINDOW w AS (PARTITION BY mint, snapshot_horizon_days ORDER BY b DESC, owner))
SELECT mint, snapshot_horizon_days, count(DISTINCT owner) AS holders, sum(CASE WHEN rk <= 1 THEN share ELSE 0 END) AS top1_holder_share,
  sum(CASE WHEN rk <= 10 THEN share ELSE 0 END) AS top10_holder_share, sum(power(share, 2)) AS holder_hhi, min(CASE WHEN cum >= 0.5 THEN rk END) AS nakamoto_50_count
FROM ranked GROUP BY 1, 2""", "top1_holder_share top10_holder_share holder_hhi", digits=11)
def holder_snapshots(t: Tables) -> DataFrame:
    tokens = t.part.select(F.col("p_partkey").alias("mint"), (F.lit("1998-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("p_size"))).alias("t0"))
    daily = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(
        F.col("l_partkey").alias("mint"), F.col("o_custkey").alias("owner"), F.col("l_shipdate").alias("ts")
    ).agg(F.sum("l_quantity").alias("q"))
    # a pair holds one row per shipping date, so its window is short
    upto = Window.partitionBy("mint", "owner").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    balances = daily.withColumn("amount", F.sum("q").over(upto)).withColumn("seq", F.lit(0))
    return market.holder_snapshots(tokens, balances)


BRAND = "CAST(replace(p_brand, 'Brand#', '') AS BIGINT)"
LEGS = f"""legs AS (SELECT {BRAND} AS brand, {roles.hex_address_sql('l_suppkey')} AS from_address, {roles.hex_address_sql('o_custkey * 1000')} AS to_address,
  CAST(l_quantity AS HUGEINT) * 1000000000000000000 AS amount, date_diff('day', DATE '1995-01-01', l_shipdate) * 300 AS block
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
cohort AS (SELECT brand, min(block) AS launch FROM legs GROUP BY 1)"""


def brand_key():
    return F.regexp_replace("p_brand", "^Brand#", "").cast("bigint")


def shipments(t: Tables) -> DataFrame:
    """Line items with brand and buyer; 300 blocks per day."""
    return t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(
        t.part.select("p_partkey", brand_key().alias("brand")), F.col("p_partkey") == F.col("l_partkey")
    ).withColumn("block", F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("bigint") * 300)


@query("holder_reconstruction", f"""
WITH {LEGS}, {roles.HORIZONS}, bounded AS (SELECT g.*, launch FROM legs g JOIN cohort c USING (brand) WHERE block BETWEEN launch AND launch + 30 * 3000 + 2000),
moves AS (SELECT brand, from_address AS holder, -amount AS v, block, launch FROM bounded UNION ALL SELECT brand, to_address, amount, block, launch FROM bounded),
held AS (SELECT brand, horizon_days, holder, sum(v) AS b FROM moves JOIN horizons ON block <= launch + horizon_days * 3000 + 2000
  WHERE holder <> '0x' || repeat('0', 40) GROUP BY 1, 2, 3 HAVING sum(v) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY brand, horizon_days ORDER BY b DESC) AS rk FROM held),
g AS (SELECT brand, horizon_days, count(*) AS n, sum(CASE WHEN rk <= 10 THEN b END) AS top, sum(b) AS total FROM ranked GROUP BY 1, 2),
logs AS (SELECT brand, count(*) AS n FROM bounded GROUP BY 1)
SELECT {roles.hex_address_sql('c.brand')} AS token_id, h.horizon_days, coalesce(g.n, 0) AS holder_count, CAST(g.top AS DOUBLE) / CAST(g.total AS DOUBLE) AS holder_concentration_top10,
  coalesce(l.n, 0) AS transfer_log_count, CASE WHEN l.n > 0 THEN 'computed_from_transfer_logs' ELSE 'no_transfer_logs_in_window' END AS holder_concentration_status
FROM cohort c CROSS JOIN horizons h LEFT JOIN g ON g.brand = c.brand AND g.horizon_days = h.horizon_days LEFT JOIN logs l ON l.brand = c.brand""",
       "holder_concentration_top10")
def holder_reconstruction(t: Tables) -> DataFrame:
    # clipped to the widest window while the columns are numbers: most shipments never become text
    narrow = settle(shipments(t).select("brand", "l_suppkey", "o_custkey", "l_quantity", "block"))
    ends = narrow.groupBy("brand").agg((F.min("block") + max(reshape.HORIZONS) * 3000 + market.BLOCK_SLACK).alias("__end"))
    inside = settle(narrow.join(ends, "brand").where(F.col("block") <= F.col("__end")).drop("__end"))
    rows = inside.select(
        roles.hex_address(F.col("brand")).alias("contract_address"), roles.hex_address(F.col("l_suppkey")).alias("from"),
        roles.hex_address(F.col("o_custkey") * 1000).alias("to"), F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit("e18")).alias("value"),
        F.col("block").cast("string").alias("blockNumber"),
    )
    transfers = import_transfers(rows)
    cohort = settle(transfers.groupBy("token_id").agg(F.min("block_number").alias("launch_block")))
    return market.holder_reconstruction(cohort, transfers, 3000)


STABLE, NATIVE = "0x" + "0" * 38 + "0c", "0x" + "0" * 38 + "0d"


@query("swap_horizons", f"""
WITH s AS (SELECT {BRAND} AS brand, l_suppkey AS sender, l_shipdate AS ts, epoch(l_shipdate)::BIGINT AS u,
    CASE l_returnflag WHEN 'R' THEN -1 WHEN 'A' THEN 1 ELSE 0 END * CAST(l_quantity AS BIGINT) AS d,
    CAST(l_quantity AS BIGINT) * 7000000 / CASE WHEN {BRAND} % 3 = 0 THEN 1e6 ELSE 1e18 END AS paired
  FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT brand, min(u) AS launch FROM s GROUP BY 1), {roles.HORIZONS},
price AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) / 1000 AS native_usd FROM orders GROUP BY 1),
x AS (SELECT c.brand, launch, horizon_days, s.* EXCLUDE (brand) FROM c CROSS JOIN horizons LEFT JOIN s ON s.brand = c.brand AND u <= launch + horizon_days * 86400),
e AS (SELECT brand, sender, sum(paired) AS w FROM s JOIN c USING (brand) WHERE u <= launch + 60 GROUP BY 1, 2),
er AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY w DESC) AS rk FROM e),
es AS (SELECT brand, sum(CASE WHEN rk <= 10 THEN w END) / sum(w) AS share FROM er GROUP BY 1)
SELECT {roles.hex_address_sql('x.brand')} AS token_id, horizon_days, count(u) AS swap_count, count(DISTINCT sender) AS active_traders,
  count(CASE WHEN d < 0 THEN 1 END) AS buy_count, count(CASE WHEN d > 0 THEN 1 END) AS sell_count, coalesce(sum(paired), 0) AS paired_volume,
  CASE WHEN x.brand % 3 = 0 THEN coalesce(sum(paired), 0) WHEN x.brand % 3 = 1 THEN coalesce(sum(paired), 0) * max(native_usd) END AS volume_usd,
  min(u) AS first_trade_unix, max(u) AS last_trade_unix, max(es.share) AS early_sender_top10_share_60s
FROM x LEFT JOIN es ON es.brand = x.brand LEFT JOIN price ON price.day = CAST(make_timestamp(launch * 1000000) AS DATE) GROUP BY x.brand, horizon_days""",
       "paired_volume volume_usd early_sender_top10_share_60s")
def swap_horizons(t: Tables) -> DataFrame:
    b = t.lineitem.join(t.part.select("p_partkey", brand_key().alias("brand")), F.col("p_partkey") == F.col("l_partkey")).withColumn(
        "u", F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    ).withColumn("block", F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("bigint") * 3000)
    token = roles.hex_address(F.col("brand"))
    paired = F.when(F.col("brand") % 3 == 0, STABLE).when(F.col("brand") % 3 == 1, NATIVE).otherwise("0x" + "0" * 38 + "0e")
    side = F.when(F.col("l_returnflag") == "R", -1).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    token_amount = (side * F.col("l_quantity").cast("bigint")).cast("string")
    paired_amount = F.concat((-F.col("l_quantity").cast("bigint") * 7).cast("string"), F.lit("e6"))
    first = token < paired
    b = settle(b)
    swaps = import_swaps(b.select(
        token.alias("poolId"), roles.hex_address(F.col("l_suppkey")).alias("trader"), F.col("block").cast("string").alias("block"),
        F.col("u").cast("string").alias("timestamp"),
        F.when(first, token_amount).otherwise(paired_amount).alias("amount0"), F.when(first, paired_amount).otherwise(token_amount).alias("amount1"),
    ))
    cohort = b.groupBy(token.alias("token_id"), token.alias("pool_id"), paired.alias("paired_token")).agg(
        F.min("block").alias("launch_block"), F.min("u").alias("launch_unix")
    )
    prices = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg((F.avg("o_totalprice") / 1000).alias("native_usd"))
    return market.swap_horizons(cohort, swaps, prices, market.QuoteSpec(STABLE, NATIVE, ((STABLE, 6),)), 3000)


@query("decoded_outcomes", f"""
WITH {NEAR}, sw AS (SELECT mint, horizon_days, tx, CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'click' THEN 'sell' ELSE 'other' END AS kind,
    CASE WHEN event_type = 'view' THEN '' ELSE CAST(trader AS VARCHAR) END AS w, usd, ts
  FROM near JOIN horizons ON ts < t0 + to_days(horizon_days)),
st AS (SELECT mint, t0, horizon_days FROM tokens CROSS JOIN horizons),
p AS (SELECT user_id AS mint, event_type AS pair, sum(value) AS vol FROM events GROUP BY 1, 2),
pc AS (SELECT mint, count(DISTINCT pair) AS n, arg_max(pair, vol) AS top, max(vol) AS v FROM p GROUP BY 1)
SELECT st.mint, st.horizon_days, st.t0 AS graduated_at, count(tx) AS decoded_trade_count, count(CASE WHEN kind = 'buy' THEN 1 END) AS decoded_buy_count,
  count(CASE WHEN kind = 'sell' THEN 1 END) AS decoded_sell_count, coalesce(sum(usd), 0) AS decoded_volume_usd,
  coalesce(sum(CASE WHEN kind = 'buy' THEN usd END), 0) AS decoded_buy_volume_usd, coalesce(sum(CASE WHEN kind = 'sell' THEN usd END), 0) AS decoded_sell_volume_usd,
  count(DISTINCT nullif(w, '')) AS decoded_active_traders, count(DISTINCT CASE WHEN kind = 'buy' THEN nullif(w, '') END) AS decoded_buyer_count,
  count(DISTINCT CASE WHEN kind = 'sell' THEN nullif(w, '') END) AS decoded_seller_count,
  (count(CASE WHEN kind = 'buy' THEN 1 END) - count(CASE WHEN kind = 'sell' THEN 1 END)) / CAST(nullif(count(CASE WHEN kind IN ('buy', 'sell') THEN 1 END), 0) AS DOUBLE) AS buy_sell_imbalance,
  median(usd) AS median_trade_size_usd, max(usd) AS max_trade_size_usd, min(ts) AS first_decoded_trade_at, max(ts) AS last_decoded_trade_at,
  'ok' AS window_status, 100 AS rows_fetched, coalesce(max(pc.n), 0) AS pair_count, max(pc.top) AS top_pair_address, max(pc.v) AS top_pair_volume_24h_usd
FROM st LEFT JOIN sw ON sw.mint = st.mint AND sw.horizon_days = st.horizon_days LEFT JOIN pc ON pc.mint = st.mint GROUP BY st.mint, st.horizon_days, st.t0""",
       "decoded_volume_usd decoded_buy_volume_usd decoded_sell_volume_usd buy_sell_imbalance median_trade_size_usd max_trade_size_usd top_pair_volume_24h_usd")
def decoded_outcomes(t: Tables) -> DataFrame:
    tokens = roles.tokens(t)
    near = joins.range_join(roles.trades(t).withColumnRenamed("bought", "mint"), tokens, "mint", "ts", "t0", "30 DAYS")
    kind = F.col("event_type")
    swaps = joins.cross_dim(near, "horizon_days", market.HORIZONS).where(F.col("ts") < F.col("t0") + F.make_dt_interval(F.col("horizon_days"))).select(
        "mint", "horizon_days", F.col("tx").alias("transaction_hash"), F.lit(0).alias("transaction_index"),
        F.when(kind == "purchase", "BUY").when(kind == "click", "Sell").otherwise("other").alias("transaction_type"),
        F.when(kind == "view", "").otherwise(F.col("trader").cast("string")).alias("wallet_address"), F.col("usd").alias("total_value_usd"), "ts",
    )
    pairs = t.events.groupBy(F.col("user_id").alias("mint"), F.col("event_type").alias("pair_address")).agg(F.sum("value").alias("volume_24h_usd")).withColumn(
        "liquidity_usd", F.lit(1.0)).withColumn("exchange_name", F.lit("x"))
    status = joins.cross_dim(tokens, "horizon_days", market.HORIZONS).withColumn("window_status", F.lit("ok")).withColumn("rows_fetched", F.lit(100))
    return market.decoded_outcomes(swaps, pairs, status)


CALENDAR = market.CohortCalendar("1996-01-01", "1996-12-31", (
    ("gross_period", ("1996-03-01", "1996-03-31"), ("1996-05-01", "1996-05-31")),
    ("quality_7d_period", ("1996-02-20", "1996-03-20"), ("1996-05-01", "1996-05-31")),
    ("quality_30d_period", ("1996-01-01", "1996-01-31"), ("1996-05-01", "1996-05-31")),
))


def _period_sql(name, pre, post):
    return f"CASE WHEN d BETWEEN DATE '{pre[0]}' AND DATE '{pre[1]}' THEN 'pre' WHEN d BETWEEN DATE '{post[0]}' AND DATE '{post[1]}' THEN 'post' END AS {name}"


@query("cohort_panel", f"""
WITH l AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'alpha' ELSE 'beta' END AS platform, o_custkey AS token, o_orderpriority AS creator, o_orderdate AS born, o_orderkey AS tx
  FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'),
u AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY platform, token ORDER BY born, tx) = 1),
m AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'alpha' ELSE 'beta' END AS platform, o_custkey AS token, min(l_shipdate) AS moved FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2),
c AS (SELECT u.*, CASE WHEN moved BETWEEN born AND born + INTERVAL 7 DAY THEN 1 ELSE 0 END AS g7, CASE WHEN moved BETWEEN born AND born + INTERVAL 30 DAY THEN 1 ELSE 0 END AS g30
  FROM u LEFT JOIN m ON m.platform = u.platform AND m.token = u.token),
daily AS (SELECT platform, CAST(born AS DATE) AS d, count(*) AS n, count(DISTINCT creator) AS k, sum(g7) AS g7, avg(g7) AS r7, sum(g30) AS g30, avg(g30) AS r30 FROM c GROUP BY 1, 2),
spine AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1996-12-31', INTERVAL 1 DAY)) AS DATE) AS d)
SELECT p.platform, d AS cohort_date, {', '.join(_period_sql(*p) for p in CALENDAR.periods)}, coalesce(n, 0) AS launches, coalesce(k, 0) AS unique_creators,
  CAST(coalesce(g7, 0) AS BIGINT) AS graduated_7d, r7 AS graduation_rate_7d, CAST(coalesce(g30, 0) AS BIGINT) AS graduated_30d, r30 AS graduation_rate_30d
FROM (SELECT s.d, q.platform, n, k, g7, r7, g30, r30 FROM spine s CROSS JOIN (VALUES ('alpha'), ('beta')) q(platform) LEFT JOIN daily x ON x.d = s.d AND x.platform = q.platform) p""",
       "graduation_rate_7d graduation_rate_30d")
def cohort_panel(t: Tables) -> DataFrame:
    platform = F.when(F.col("o_orderstatus") == "F", "alpha").otherwise("beta").alias("platform")
    launches = t.orders.select(platform, F.col("o_custkey").alias("token_id"), F.col("o_orderpriority").alias("creator_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("creation_tx"))
    moves = t.orders.join(t.lineitem.where(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")), F.col("l_orderkey") == F.col("o_orderkey")).select(
        platform, F.col("o_custkey").alias("token_id"), F.col("l_shipdate").alias("migrated_at"))
    return market.cohort_panel(launches, moves, ("alpha", "beta"), CALENDAR)


CALLS = market.CallSpec("launch-program", "181ec828051c0777", "9beae792ec9ea21e")


@query("token_cohorts", f"""
WITH {roles.FIRST_SHIP}, c AS (SELECT o_orderkey AS token, o_custkey AS creator, o_orderdate AS born FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31'),
m AS (SELECT l_orderkey AS token, ship FROM first_ship WHERE ship BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31' + INTERVAL 30 DAY)
SELECT 't' || c.token AS token_id, 'c' || creator AS creator_id, born AS created_at, CAST(born AS DATE) AS cohort_date, ship AS migrated_at,
  CASE WHEN born > TIMESTAMP '2000-12-15' - INTERVAL 7 DAY THEN NULL ELSE coalesce(ship <= born + INTERVAL 7 DAY, false) END AS graduated_7d,
  CASE WHEN born > TIMESTAMP '2000-12-15' - INTERVAL 30 DAY THEN NULL ELSE coalesce(ship <= born + INTERVAL 30 DAY, false) END AS graduated_30d,
  'create-' || c.token AS creation_tx, 'migrate-' || m.token AS migration_tx
FROM c LEFT JOIN m ON m.token = c.token""")
def token_cohorts(t: Tables) -> DataFrame:
    token = F.concat(F.lit("t"), F.col("key"))
    creates = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("who"), F.col("o_orderdate").alias("ts"), F.lit("create").alias("kind"))
    moves = t.lineitem.groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_shipdate").alias("ts")).select("key", F.lit(0).alias("who"), "ts", F.lit("migrate").alias("kind"))
    other = F.lit("x")
    calls = creates.unionByName(moves).select(
        F.lit(CALLS.program).alias("executing_account"),
        F.unhex(F.concat(F.when(F.col("kind") == "create", CALLS.create).otherwise(CALLS.migrate), F.lpad(F.hex("key"), 16, "0"))).alias("data"),
        F.lit(True).alias("success"), "ts", F.concat("kind", F.lit("-"), "key").alias("tx"), F.concat(F.lit("c"), "who").alias("signer"),
        F.when(F.col("kind") == "create", F.array(token)).otherwise(F.array(other, other, token)).alias("accounts"),
    )
    return market.token_cohorts(calls, CALLS, "1996-01-01", "2000-12-31", "2000-12-15")


@query("lifecycle_summary", f"""
WITH {roles.LAUNCHES}, x AS (SELECT *, CASE WHEN priority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 1 ELSE 0 END AS social, CASE WHEN priority = '1-URGENT' THEN 1 ELSE 0 END AS chan FROM launches)
SELECT count(*) AS total_tokens, CAST(sum(graduated) AS BIGINT) AS graduated_tokens, CAST(sum(timed_out) AS BIGINT) AS timeout_tokens, avg(graduated) AS graduation_rate,
  avg(timed_out) * 1000 AS timeout_incidence_per_1000, avg(CASE WHEN social = 0 THEN graduated END) AS no_social_graduation_rate,
  avg(CASE WHEN social = 1 THEN graduated END) AS any_social_graduation_rate, avg(CASE WHEN chan = 1 THEN graduated END) AS channel_graduation_rate,
  avg(CASE WHEN chan = 0 THEN graduated END) AS no_channel_graduation_rate, median(CASE WHEN graduated = 1 THEN minutes END) AS median_minutes_to_graduation_seen,
  median(CASE WHEN graduated = 1 THEN minutes + 1 END) AS median_minutes_to_graduation_chain, median(cap) AS median_initial_cap, quantile_cont(cap, 0.9) AS p90_initial_cap FROM x""",
       "graduation_rate timeout_incidence_per_1000 no_social_graduation_rate any_social_graduation_rate channel_graduation_rate no_channel_graduation_rate "
       "median_minutes_to_graduation_seen median_minutes_to_graduation_chain median_initial_cap p90_initial_cap")
def lifecycle_summary(t: Tables) -> DataFrame:
    df = roles.launches(t).select(
        "graduated", "timed_out", F.col("minutes").alias("minutes_seen"), (F.col("minutes") + 1).alias("minutes_chain"), F.col("cap").alias("initial_cap"),
        F.col("priority").isin("1-URGENT", "2-HIGH", "3-MEDIUM").cast("int").alias("has_any_social"), (F.col("priority") == "1-URGENT").cast("int").alias("has_channel"),
    )
    return market.lifecycle_summary(df)


@query("risk_summary", """
WITH last AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1),
x AS (SELECT value, value - 100 AS liq, CAST(json_extract_string(props, '$.k') AS INT) * 2 AS prog, value / 4 AS raw, least(100, greatest(0, value / 4)) AS top10,
  event_type IN ('click') OR least(100, greatest(0, value / 4)) >= 80 AS heavy, CASE WHEN event_type IN ('purchase', 'click') THEN 1.0::DOUBLE ELSE 0.0 END AS risky FROM last)
SELECT count(*) AS rows, avg(CASE WHEN value > 0 AND liq > 0 THEN 1.0 ELSE 0.0 END) AS active_market_rate, avg(CASE WHEN prog >= 100 THEN 1.0 ELSE 0.0 END) AS completed_bonding_rate,
  avg(CASE WHEN heavy THEN 1.0 ELSE 0.0 END) AS high_concentration_rate, avg(risky) AS high_or_critical_risk_rate,
  avg(CASE WHEN heavy THEN risky END) - avg(CASE WHEN NOT heavy THEN risky END) AS risk_rate_difference, count(CASE WHEN raw > 100 THEN 1 END) AS invalid_top10_gt100_rows,
  median(value) AS median_volume_24h, median(liq) AS median_liquidity, median(top10) AS median_top10_holder_pct, quantile_cont(top10, 0.9) AS p90_top10_holder_pct FROM x""",
       "active_market_rate completed_bonding_rate high_concentration_rate high_or_critical_risk_rate risk_rate_difference median_volume_24h median_liquidity median_top10_holder_pct p90_top10_holder_pct")
def risk_summary(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return market.risk_summary(t.events.select(
        F.col("user_id").alias("mint"), F.col("ts").alias("snapshot_at"), F.col("value").alias("volume_24h"), (F.col("value") - 100).alias("liquidity"),
        (roles.trader() * 2).alias("bonding_progress"), F.when(kind == "click", "whale_dominated").otherwise("spread").alias("holder_concentration"),
        (F.col("value") / 4).alias("top10_holder_pct"), F.when(kind == "purchase", "high").when(kind == "click", "critical").otherwise("low").alias("risk_level"),
    ))


@query("compare_by_flag", f"""
WITH a AS ({POST_EVENT}), f AS (SELECT *, CASE WHEN graduated_at < TIMESTAMP '2024-01-02 12:00:00' THEN 1 ELSE 0 END AS flag FROM a),
l AS (SELECT horizon_days, flag, 'swap_count' AS metric, CAST(swap_count AS DOUBLE) AS v FROM f UNION ALL SELECT horizon_days, flag, 'active_traders', active_traders FROM f
  UNION ALL SELECT horizon_days, flag, 'volume_usd', volume_usd FROM f)
SELECT horizon_days, metric, count(CASE WHEN flag = 1 THEN v END) AS n_treated, count(CASE WHEN flag = 0 THEN v END) AS n_control,
  avg(CASE WHEN flag = 1 THEN v END) AS treated_mean, avg(CASE WHEN flag = 0 THEN v END) AS control_mean,
  median(CASE WHEN flag = 1 THEN v END) AS treated_median, median(CASE WHEN flag = 0 THEN v END) AS control_median,
  median(CASE WHEN flag = 1 THEN v END) - median(CASE WHEN flag = 0 THEN v END) AS effect FROM l GROUP BY 1, 2""",
       "treated_mean control_mean treated_median control_median effect")
def compare_by_flag(t: Tables) -> DataFrame:
    rows = market.post_event_activity(roles.tokens(t), roles.trades(t)).withColumn(
        "flag", F.when(F.col("graduated_at") < F.lit("2024-01-02 12:00:00").cast("timestamp_ntz"), 1).otherwise(0))
    return market.compare_by_flag(rows, "horizon_days", ["swap_count", "active_traders", "volume_usd"], "flag")


@query("horizon_widening", f"""
WITH a AS ({POST_EVENT})
SELECT mint, max(graduated_at) AS graduated_at, {', '.join(f"max(CASE WHEN horizon_days = {h} THEN swap_count END) AS swap_count_{h}d, max(CASE WHEN horizon_days = {h} THEN active_traders END) AS active_traders_{h}d, max(CASE WHEN horizon_days = {h} THEN (swap_count > 0)::INT END) AS active_{h}d, max(CASE WHEN horizon_days = {h} THEN (active_traders > {h})::INT END) AS complete_{h}d" for h in (1, 7, 30))},
  max(CASE WHEN horizon_days = 30 THEN first_trade_at END) AS first_trade_at_30d,
  date_diff('microsecond', max(graduated_at), max(CASE WHEN horizon_days = 30 THEN first_trade_at END)) / 1e6 AS first_trade_lag_seconds_30d, 0 AS temporal_order_violation_30d,
  min((active_traders > horizon_days)::INT) AS complete_all_horizons, ln(1 + max(CASE WHEN horizon_days = 30 THEN swap_count END)) AS log1p_swap_count_30d,
  ln(1 + max(CASE WHEN horizon_days = 30 THEN swap_count END)) - ln(1 + max(CASE WHEN horizon_days = 1 THEN swap_count END)) AS log1p_growth_1d_to_30d
FROM a GROUP BY mint""", "first_trade_lag_seconds_30d log1p_swap_count_30d log1p_growth_1d_to_30d")
def horizon_widening(t: Tables) -> DataFrame:
    rows = market.post_event_activity(roles.tokens(t), roles.trades(t)).withColumn(
        "window_status", F.when(F.col("active_traders") > F.col("horizon_days"), "ok").otherwise("page_limit_reached_lower_bound"))
    return reshape.widen_horizons(rows, "mint", "graduated_at")


BUYERS = """buys AS (SELECT l_partkey AS mint, o_custkey AS wallet, min(struct_pack(ts := l_shipdate, seq := l_orderkey)) AS first_at, sum(l_extendedprice) AS sol
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
fb AS (SELECT mint, wallet, first_at.ts AS ts, sol, row_number() OVER (PARTITION BY mint ORDER BY first_at, wallet) AS rank FROM buys QUALIFY rank <= 10),
edges AS (SELECT x.wallet AS a, y.wallet AS b, count(*) AS weight FROM fb x JOIN fb y ON x.mint = y.mint AND x.wallet < y.wallet GROUP BY 1, 2)"""


def buyers(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("l_partkey").alias("mint"), F.col("o_custkey").alias("wallet"), F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("seq"), F.col("l_extendedprice").alias("sol"))


@query("cofiring_edges", f"WITH {BUYERS} SELECT a, b, weight FROM edges WHERE weight >= 3")
def cofiring_edges(t: Tables) -> DataFrame:
    return cofiring.wallet_edges(cofiring.first_buyers(buyers(t)), 3)


COMPONENTS = f"""{BUYERS}, e AS (SELECT a, b FROM edges WHERE weight >= 3 UNION SELECT b, a FROM edges WHERE weight >= 3),
reach(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.other),
members AS (SELECT node AS wallet, min(other) AS component FROM reach GROUP BY 1)"""
COHORTS = f"""{COMPONENTS}, seen AS (SELECT fb.*, component FROM fb JOIN members USING (wallet)),
hits AS (SELECT component, mint, min(rank) AS r, min(ts) AS lo, max(ts) AS hi FROM seen GROUP BY 1, 2 HAVING count(*) >= 2),
l AS (SELECT component, count(*) AS n, avg(r) AS r, min(lo) AS lo, max(hi) AS hi FROM hits GROUP BY 1),
cohorts AS (SELECT s.component, s.cohort_size, l.n AS n_launches, l.r AS avg_first_rank, l.lo AS first_seen, l.hi AS last_seen, p.sol AS sol_total,
  l.n * 10 + 5 / greatest(l.r, 1.0) + sqrt(p.sol) AS score
  FROM (SELECT component, count(*) AS cohort_size FROM members GROUP BY 1) s JOIN l USING (component) JOIN (SELECT component, sum(sol) AS sol FROM seen GROUP BY 1) p USING (component))"""


@query("cofiring_cohorts", f"WITH RECURSIVE {COHORTS} SELECT * FROM cohorts", "avg_first_rank sol_total score", digits=4)
def cofiring_cohorts(t: Tables) -> DataFrame:
    return cofiring.cofiring_cohorts(buyers(t))


@query("cofiring_size_distribution", f"WITH RECURSIVE {COHORTS} SELECT cohort_size, count(*) AS n_cohorts, round(count(*) * 100.0 / (SELECT count(*) FROM cohorts), 2) AS share_pct FROM cohorts GROUP BY 1", "share_pct")
def cofiring_size_distribution(t: Tables) -> DataFrame:
    return cofiring.size_distribution(cofiring.cofiring_cohorts(buyers(t)))


@query("cofiring_weight_sensitivity", f"""WITH RECURSIVE {BUYERS}, cut AS (SELECT unnest([2, 3, 5]) AS w),
e AS (SELECT w, a, b FROM edges JOIN cut ON weight >= w UNION SELECT w, b, a FROM edges JOIN cut ON weight >= w),
label(w, node, comp, step) AS (SELECT w, a, least(a, min(b)), 0 FROM e GROUP BY w, a
  UNION ALL SELECT l.w, l.node, least(min(l.comp), min(m.comp)), l.step + 1 FROM label l JOIN e ON e.w = l.w AND e.a = l.node JOIN label m ON m.w = e.w AND m.node = e.b WHERE l.step < 40 GROUP BY l.w, l.node, l.step),
done AS (SELECT w, count(DISTINCT comp) AS n FROM label WHERE step = 40 GROUP BY 1)
SELECT cut.w AS edge_weight_cutoff, (SELECT count(*) FROM edges WHERE weight >= cut.w) AS n_qualifying_pairs, coalesce(done.n, 0) AS n_components_size_ge2 FROM cut LEFT JOIN done ON done.w = cut.w""")
def cofiring_weight_sensitivity(t: Tables) -> DataFrame:
    return cofiring.weight_sensitivity(buyers(t))


@query("cofiring_touch_lift")
def cofiring_touch_lift(t: Tables) -> DataFrame:
    frame = buyers(t)
    members = cofiring.components(cofiring.wallet_edges(cofiring.first_buyers(frame), 3)).withColumnRenamed("node", "wallet")
    volume = t.lineitem.groupBy(F.col("l_partkey").alias("mint")).agg(F.sum("l_quantity").alias("volume"))
    return cofiring.touch_lift(volume, cofiring.touched_tokens(frame, members), "volume")
