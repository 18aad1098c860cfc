"""The standard tables in the roles the operators expect, as frames and as the matching SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.registry import Tables

# --- launches and trades from the event stream -------------------------------------------------------------------

TOKENS = "tokens AS (SELECT user_id AS mint, min(ts) AS t0 FROM events WHERE event_type = 'signup' GROUP BY 1)"
TRADES = """trades AS (SELECT event_id AS tx, ts, user_id AS bought, CAST(NULL AS BIGINT) AS sold,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS trader, value AS usd, event_type FROM events)"""
HORIZONS = "horizons AS (SELECT unnest([1, 7, 30]) AS horizon_days)"


def tokens(t: Tables) -> DataFrame:
    """A user is a token; its first signup is the event."""
    return t.events.where("event_type = 'signup'").groupBy(F.col("user_id").alias("mint")).agg(F.min("ts").alias("t0"))


def trader() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def trades(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("tx"), "ts", F.col("user_id").alias("bought"), F.lit(None).cast("bigint").alias("sold"),
        trader().alias("trader"), F.col("value").alias("usd"), "event_type",
    )


# --- orders as launches -------------------------------------------------------------------------------------------

FIRST_SHIP = "first_ship AS (SELECT l_orderkey, min(l_shipdate) AS ship FROM lineitem GROUP BY 1)"
LAUNCHES = f"""{FIRST_SHIP}, launches AS (SELECT o_orderkey AS mint, o_custkey AS creator, o_orderdate AS created_at, ship,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS graduated, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS timed_out,
  date_diff('day', o_orderdate, ship) AS minutes, o_totalprice AS cap, o_orderpriority AS priority
  FROM orders LEFT JOIN first_ship ON l_orderkey = o_orderkey)"""


def launches(t: Tables) -> DataFrame:
    """An order is a launch; status F is graduation; minutes are the days to the first shipment."""
    first = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship"))
    done = F.col("o_orderstatus") == "F"
    return t.orders.join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.col("o_orderkey").alias("mint"), F.col("o_custkey").alias("creator"), F.col("o_orderdate").alias("created_at"), "ship",
        F.when(done, 1).otherwise(0).alias("graduated"), F.when(done, 0).otherwise(1).alias("timed_out"),
        F.datediff("ship", "o_orderdate").cast("bigint").alias("minutes"), F.col("o_totalprice").alias("cap"), F.col("o_orderpriority").alias("priority"),
    )


# --- regions as a market panel ------------------------------------------------------------------------------------

PANEL_EVENT = "1998-06-01"
PANEL = f"""regional AS (SELECT r_name AS unit, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS volume,
    CASE WHEN r_name = 'ASIA' THEN 1 ELSE 0 END AS treated
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  GROUP BY ALL)"""


def regional_days(t: Tables) -> DataFrame:
    """Order value per region and day; one region is treated."""
    geo = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    daily = t.orders.join(geo.select("c_custkey", "r_name"), F.col("c_custkey") == F.col("o_custkey")).groupBy(
        F.col("r_name").alias("unit"), F.to_date("o_orderdate").alias("day")
    ).agg(F.sum("o_totalprice").alias("volume"))
    return daily.withColumn("treated", F.when(F.col("unit") == "ASIA", 1).otherwise(0))


WEEKS = f"""{PANEL}, weeks AS (SELECT unit, date_trunc('week', day)::DATE AS week, sum(volume) AS volume, max(treated) AS treated
  FROM regional GROUP BY 1, 2),
weekly AS (SELECT unit, week, volume, treated, ln(1 + volume) AS y, CASE WHEN week >= DATE '{PANEL_EVENT}' THEN 1 ELSE 0 END AS post,
  treated * CASE WHEN week >= DATE '{PANEL_EVENT}' THEN 1 ELSE 0 END AS did,
  greatest(-12, least(12, CAST(floor(date_diff('day', DATE '{PANEL_EVENT}', week) / 7.0) AS INT))) AS rel_week,
  date_diff('day', DATE '{PANEL_EVENT}', week) AS rel_day FROM weeks)"""


def weekly_panel(t: Tables) -> DataFrame:
    from tidemark.estimators.panel import event_clock
    from tidemark.operators.aggregates import weekly_panel as roll

    weeks = roll(regional_days(t), "unit", "day", "volume", "treated").withColumnRenamed("week_start", "week")
    return event_clock(weeks, "week", PANEL_EVENT).withColumnRenamed("log_volume", "y")


# --- hex identities -----------------------------------------------------------------------------------------------


def hex_address(col: Column) -> Column:
    """A 20-byte address made from a key."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(col.cast("bigint"))), 40, "0"))


def hex_address_sql(expr: str) -> str:
    return f"('0x' || lpad(lower(hex(CAST({expr} AS BIGINT))), 40, '0'))"


def whole_text(col: Column, zeros: int = 0) -> Column:
    """Integer text of a whole double, scaled by a power of ten."""
    return F.concat(col.cast("bigint").cast("string"), F.lit("0" * zeros))
