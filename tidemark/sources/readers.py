"""Scans: delimited text, JSON lines, Parquet, registry documents, charts and aliased imports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import as_long, integer_text, parse_ts


def text_schema(columns: Sequence[str]) -> T.StructType:
    """All strings: raw logs are typed later, by expressions that cannot fail the scan."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], keep: Sequence[str] | None = None, spread: int = 0) -> DataFrame:
    """Header CSV, plain or compressed. A gzip file is one split: ``spread`` redistributes its rows after the scan."""
    df = spark.read.schema(text_schema(columns)).csv(path, header=True, mode="PERMISSIVE", multiLine=False, escape='"', enforceSchema=False)
    df = df.select(*keep) if keep else df
    return df.repartition(spread) if spread else df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, spread: int = 0) -> DataFrame:
    """JSON lines, plain or compressed; blank lines are skipped by the source."""
    df = spark.read.schema(schema).json(path)
    return df.repartition(spread) if spread else df


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_registry(spark: SparkSession, path: str, key: str, version: str, record: T.StructType) -> DataFrame:
    """Records of a JSON document that must carry the expected ``schema_version``; a mismatch fails the query."""
    schema = T.StructType([T.StructField("schema_version", T.StringType()), T.StructField(key, T.ArrayType(record))])
    documents = spark.read.schema(schema).json(path, multiLine=True)
    matches = F.col("schema_version").eqNullSafe(F.lit(version))
    checked = documents.withColumn(
        "records", F.when(matches, F.col(key)).otherwise(F.raise_error(F.lit(f"unsupported schema version, expected {version}")))
    )
    return checked.select(F.posexplode("records").alias("ordinal", "r")).select("ordinal", "r.*")


CHART = T.StructType([
    T.StructField("totalDataChart", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("totalDataChartBreakdown", T.StringType()),
])


def explode_chart(documents: DataFrame, keep: Sequence[str] = (), points: str = "totalDataChart") -> DataFrame:
    """``[[epoch_seconds, value], ...]`` to one row per UTC day and value."""
    point = documents.select(*keep, F.explode(points).alias("p"))
    day = F.to_date(F.timestamp_seconds(F.get("p", F.lit(0))))
    return point.select(*keep, day.alias("day"), F.get("p", F.lit(1)).alias("value"))


def child_sets(breakdown: DataFrame, keep: Sequence[str], day: str, children: str) -> DataFrame:
    """First and last day of every distinct set of child series; ``children`` maps child name to value."""
    named = breakdown.withColumn("children", F.array_join(F.array_sort(F.map_keys(children)), ","))
    return named.groupBy(*keep, "children").agg(F.min(day).alias("from_day"), F.max(day).alias("to_day"))


# Accepted names of each canonical column, first one present wins.
SWAP_ALIASES = {
    "pool_id": ("poolId", "pool", "pool_address"),
    "sender": ("trader", "caller", "tx_from", "origin"),
    "block_number": ("block", "blockNumber"),
    "timestamp_unix": ("block_timestamp_unix", "timestamp", "blockTimeUnix"),
    "timestamp_utc": ("block_timestamp_utc", "block_time", "blockTime"),
    "transaction_hash": ("tx_hash", "transactionHash", "hash"),
    "amount0_raw": ("amount0", "amount0Raw", "amount_0_raw"),
    "amount1_raw": ("amount1", "amount1Raw", "amount_1_raw"),
}
TRANSFER_ALIASES = {
    "token_id": ("token", "contract_address", "address", "currency"),
    "from_address": ("from", "fromAddress", "sender"),
    "to_address": ("to", "toAddress", "recipient"),
    "block_number": ("block", "blockNumber"),
    "log_index": ("logIndex", "event_index"),
    "transaction_hash": ("tx_hash", "transactionHash", "hash"),
    "amount_raw": ("amount", "value", "amountRaw"),
}
SWAP_REQUIRED = ("pool_id", "sender", "block_number", "timestamp_unix", "timestamp_utc", "amount0_raw", "amount1_raw")
TRANSFER_REQUIRED = ("token_id", "from_address", "to_address", "block_number", "amount_raw")


def canonicalize(df: DataFrame, aliases: Mapping[str, Sequence[str]], required: Sequence[str], derived: Mapping[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Rename aliases, derive a missing twin column from a present one, and fail on missing required columns.

    Works on the schema alone, so a bad import fails before any data is read.
    """
    for name, options in aliases.items():
        if name not in df.columns:
            found = next((o for o in options if o in df.columns), None)
            if found:
                df = df.withColumnRenamed(found, name)
    for name, (source, value) in (derived or {}).items():
        if name not in df.columns and source in df.columns:
            df = df.withColumn(name, value)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"import is missing required columns: {missing}")
    return df


def import_swaps(df: DataFrame) -> DataFrame:
    """Swap import in canonical form: lower-case ids, exact integer text, rows without block or time dropped."""
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    df = canonicalize(df, SWAP_ALIASES, SWAP_REQUIRED, {
        "timestamp_unix": ("timestamp_utc", F.unix_seconds(parse_ts(F.col("timestamp_utc"), "seconds"))),
        "timestamp_utc": ("timestamp_unix", F.date_format(F.timestamp_seconds(as_long(F.col("timestamp_unix"))), iso)),
    })
    tx = F.col("transaction_hash") if "transaction_hash" in df.columns else F.lit("")
    kinds = dict(df.dtypes)
    whole = lambda c: as_long(F.col(c)) if kinds[c] == "string" else F.col(c).cast("bigint")
    return df.select(
        F.lower("pool_id").alias("pool_id"), F.lower("sender").alias("sender"), whole("block_number").alias("block_number"),
        whole("timestamp_unix").alias("timestamp_unix"), "timestamp_utc", tx.alias("transaction_hash"),
        integer_text(F.col("amount0_raw")).alias("amount0_raw"), integer_text(F.col("amount1_raw")).alias("amount1_raw"),
    ).where(F.col("pool_id").isNotNull() & F.col("block_number").isNotNull() & F.col("timestamp_unix").isNotNull())


def import_transfers(df: DataFrame) -> DataFrame:
    """Transfer import in canonical form; a missing log index is zero."""
    df = canonicalize(df, TRANSFER_ALIASES, TRANSFER_REQUIRED)
    log_index = F.coalesce(as_long(F.col("log_index")), F.lit(0)) if "log_index" in df.columns else F.lit(0)
    tx = F.col("transaction_hash") if "transaction_hash" in df.columns else F.lit("")
    return df.select(
        F.lower("token_id").alias("token_id"), F.lower("from_address").alias("from_address"), F.lower("to_address").alias("to_address"),
        as_long(F.col("block_number")).alias("block_number"), log_index.cast("bigint").alias("log_index"), tx.alias("transaction_hash"),
        integer_text(F.col("amount_raw")).alias("amount_raw"),
    ).where(F.col("token_id").isNotNull() & F.col("block_number").isNotNull())
