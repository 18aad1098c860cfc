"""Event-log decoding on hex text: fixed 32-byte words, addresses, dynamic strings, indexed topics."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import wide

WORD = 64


def body(data: Column) -> Column:
    return F.lower(F.regexp_replace(data, r"^0[xX]", ""))


def word(data: Column, index: int) -> Column:
    """The k-th 32-byte word of a hex body."""
    return F.substring(data, index * WORD + 1, WORD)


def address(hex_word: Column) -> Column:
    return F.concat(F.lit("0x"), F.substring(hex_word, 25, 40))


def small_uint(hex_word: Column) -> Column:
    """A word known to fit 63 bits (offsets, lengths, block numbers, times)."""
    return F.conv(F.substring(hex_word, 49, 16), 16, 10).cast("bigint")


def uint_text(hex_word: Column) -> Column:
    """Unsigned 256-bit word as decimal text; words that fit 64 bits, the common case, need no limbs."""
    small = hex_word.startswith("0" * 48)
    return F.when(small, F.conv(F.substring(hex_word, 49, 16), 16, 10)).otherwise(wide.to_text(wide.from_hex_word(hex_word)))


def int_text(hex_word: Column) -> Column:
    """Two's complement 256-bit word as decimal text, with the same short cut."""
    low = F.substring(hex_word, 49, 16)
    positive = hex_word.startswith("0" * 48) & (F.substring(low, 1, 1) < "8")
    negative = hex_word.startswith("f" * 48) & (F.substring(low, 1, 1) >= "8")
    return F.when(positive | negative, F.conv(low, 16, -10)).otherwise(wide.to_text(wide.from_hex_word(hex_word, signed=True)))


def dynamic_string(data: Column, index: int) -> Column:
    """Head word k holds the byte offset of a length-prefixed UTF-8 string."""
    start = small_uint(word(data, index)) * 2
    length = small_uint(F.substring(data, (start + 1).cast("int"), F.lit(WORD)))
    content = F.substring(data, (start + WORD + 1).cast("int"), (length * 2).cast("int"))
    return F.decode(F.unhex(content), "UTF-8")


READERS = {
    "address": address,
    "uint": uint_text,
    "int": int_text,
    "int24": wide.signed_int24,
    "bytes32": lambda w: F.concat(F.lit("0x"), w),
    "small": small_uint,
}


@dataclass(frozen=True)
class LogSpec:
    """Layout of one event: its signature topic and the typed places of its fields."""

    signature: str
    topics: Mapping[str, tuple[int, str]] = field(default_factory=dict)
    words: Mapping[str, tuple[int, str]] = field(default_factory=dict)


def decode_logs(logs: DataFrame, spec: LogSpec, keep: tuple[str, ...]) -> DataFrame:
    """Rows of one event type, decoded with projections only: the filter on the signature reaches the scan."""
    data = body(F.col("data"))
    out = [F.col(name) for name in keep]
    for name, (place, kind) in spec.topics.items():
        out.append(READERS[kind](body(F.col(f"topic{place}"))).alias(name))
    for name, (place, kind) in spec.words.items():
        value = dynamic_string(data, place) if kind == "string" else READERS[kind](word(data, place))
        out.append(value.alias(name))
    return logs.where(F.col("topic0") == spec.signature).select(*out)


def attach_receipt(lifecycle: DataFrame, logs: DataFrame) -> DataFrame:
    """Pool creation and first liquidity of a token, found among the logs of its own transaction.

    ``lifecycle``  token, transaction_hash
    ``logs``       transaction_hash, log_index, event (pair_created | pool_created | mint), currency0, currency1,
                   pool_address, amount0_raw, amount1_raw

    A created pool counts when it names the token. A mint counts when it belongs to that pool; without a created
    pool it counts only when the transaction has exactly one mint.
    """
    created = logs.where(F.col("event").isin("pair_created", "pool_created")).select(
        "transaction_hash",
        F.explode(F.array_distinct(F.array("currency0", "currency1"))).alias("token"),
        F.struct(
            F.col("log_index").alias("pool_log_index"),
            "pool_address",
            "currency0",
            "currency1",
            F.when(F.col("event") == "pool_created", "v3").otherwise("v2").alias("amm_version"),
        ).alias("pool"),
    )
    pool = created.groupBy("transaction_hash", "token").agg(F.min("pool").alias("pool"))
    mints = logs.where(F.col("event") == "mint")
    mint = F.struct(F.col("log_index").alias("mint_log_index"), "pool_address", "amount0_raw", "amount1_raw")
    by_pool = mints.groupBy("transaction_hash", "pool_address").agg(F.min(mint).alias("pool_mint"))
    unique = (
        mints.groupBy("transaction_hash")
        .agg(F.count("*").alias("n_mints"), F.min(mint).alias("only_mint"))
        .where("n_mints = 1")
    )
    joined = (
        lifecycle.join(pool, ["transaction_hash", "token"], "left")
        .withColumn("pool_address", F.col("pool.pool_address"))
        .join(by_pool, ["transaction_hash", "pool_address"], "left")
        .join(unique, "transaction_hash", "left")
    )
    chosen = F.when(F.col("pool").isNotNull(), F.col("pool_mint")).otherwise(F.col("only_mint"))
    return joined.withColumn("chosen", chosen).select(
        "token",
        "transaction_hash",
        F.coalesce("pool_address", F.col("chosen.pool_address")).alias("pool_address"),
        F.col("pool.pool_log_index").alias("pool_log_index"),
        F.col("pool.currency0").alias("currency0"),
        F.col("pool.currency1").alias("currency1"),
        F.col("pool.amm_version").alias("amm_version"),
        F.col("chosen.mint_log_index").alias("mint_log_index"),
        F.col("chosen.amount0_raw").alias("amount0_raw"),
        F.col("chosen.amount1_raw").alias("amount1_raw"),
    )
