"""Streaming queries: each runs its stream over the whole table to completion and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import relational, roles
from tidemark.catalog.registry import Tables, query
from tidemark.session import shared_folder
from tidemark.streaming import jobs


def event_stream(t: Tables) -> DataFrame:
    return jobs.read_stream(t.spark, t.folder, t.events.schema, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_daily_counts", """WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events) SELECT user_id, CAST(ts AS DATE)::TIMESTAMP AS day, count(*) AS trades, sum(value) AS volume FROM events GROUP BY user_id, CAST(ts AS DATE)
  HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT mark FROM m)""", "volume")
def stream_daily_counts(t: Tables) -> DataFrame:
    out, mark = shared_folder(t.spark, "daily"), shared_folder(t.spark, "daily-mark")
    jobs.run_available(jobs.stream_daily(event_stream(t), "user_id", "ts", "value"), out, mark)
    return t.spark.read.parquet(out)


@query("stream_decoded_logs", f"""SELECT DISTINCT 'tx' || o_orderkey AS transaction_hash, 1 AS log_index, {roles.hex_address_sql('o_custkey')} AS token, CAST(o_orderkey AS VARCHAR) AS supply FROM orders""")
def stream_decoded_logs(t: Tables) -> DataFrame:
    # every order is one log, written twice: as two files of the same folder
    word = lambda c: F.lpad(F.lower(F.hex(c)), 64, "0")
    raw = t.orders.select(
        F.lit(relational.SIGNATURE).alias("topic0"), F.concat(F.lit("0x"), word(F.col("o_custkey"))).alias("topic1"), F.concat(F.lit("0x"), word(F.col("o_orderkey"))).alias("data"),
        F.concat(F.lit("tx"), "o_orderkey").alias("transaction_hash"), F.lit(1).alias("log_index"), F.col("o_orderdate").cast("timestamp").alias("block_time"))
    folder = shared_folder(t.spark, "raw-logs")
    for _ in range(2):
        raw.write.mode("append").parquet(folder)
    spec = relational.logs.LogSpec(relational.SIGNATURE, {"token": (1, "address")}, {"supply": (0, "uint")})
    stream = jobs.stream_decode(jobs.read_stream(t.spark, folder, raw.schema), spec, "block_time", ("transaction_hash", "log_index"), "3000 days")
    out, mark = shared_folder(t.spark, "decoded"), shared_folder(t.spark, "decoded-mark")
    jobs.run_available(stream, out, mark)
    return t.spark.read.parquet(out).select("transaction_hash", "log_index", "token", "supply")


@query("stream_ledger", relational.BEST_LEDGER)
def stream_ledger(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "ledger-updates")
    updates = relational.ledger(t)
    snapshots = jobs.LedgerSnapshots(shared_folder(t.spark, "ledger"), ["unit_id", "coverage_type"], "status", "rows", "seen_at")
    mark = shared_folder(t.spark, "ledger-mark")
    for flag in ("A", "N", "R"):  # every delivery is picked up by a restarted stream as a batch of its own
        updates.where(F.col("coverage_type") == flag).write.mode("append").parquet(folder)
        jobs.stream_ledger(jobs.read_stream(t.spark, folder, updates.schema), snapshots, mark)
    return snapshots.latest(t.spark)
