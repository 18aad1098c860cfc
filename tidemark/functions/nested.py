"""Projections of nested exports: paged swap and pair items, parsed transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import as_double, as_long, trade_role

# Field names that carry an address, a symbol, an amount and a dollar amount, first usable one wins.
ADDRESS_FIELDS = ("address", "tokenAddress", "mint", "contractAddress")
SYMBOL_FIELDS = ("symbol", "tokenSymbol")
AMOUNT_FIELDS = ("amount", "amountFormatted", "tokenAmount", "value")
USD_FIELDS = ("usdAmount", "amountUsd", "amountUSD", "valueUsd", "totalValueUsd")
NATIVE_MINT = "So11111111111111111111111111111111111111112"
LAMPORTS = 1_000_000_000.0


def _json(part: str, field: str) -> Column:
    return F.get_json_object(part, f"$.{field}")


def _first_text(part: str, fields: Sequence[str]) -> Column:
    return F.coalesce(*[F.nullif(_json(part, f), F.lit("")) for f in fields], F.lit(""))


def _first_number(part: str, fields: Sequence[str]) -> Column:
    return F.coalesce(*[as_double(_json(part, f)) for f in fields])


def flatten_swaps(items: DataFrame, item: str, keep: Sequence[str]) -> DataFrame:
    """Swap items (JSON text) to flat typed columns; either side may use any of the known field names."""
    sides = items.select(*keep, item, *[F.get_json_object(item, f"$.{s}").alias(f"__{s}") for s in ("bought", "sold", "baseToken", "quoteToken")])
    text = lambda f: F.coalesce(_json(item, f), F.lit(""))
    return sides.select(
        *keep, text("transactionHash").alias("transaction_hash"), as_long(_json(item, "transactionIndex")).alias("transaction_index"),
        text("transactionType").alias("transaction_type"), text("blockTimestamp").alias("block_timestamp"), as_long(_json(item, "blockNumber")).alias("block_number"),
        text("walletAddress").alias("wallet_address"), text("pairAddress").alias("pair_address"), text("exchangeName").alias("exchange_name"),
        _first_text("__baseToken", ADDRESS_FIELDS).alias("base_token_address"), _first_text("__quoteToken", ADDRESS_FIELDS).alias("quote_token_address"),
        _first_text("__bought", ADDRESS_FIELDS).alias("bought_token_address"), _first_text("__bought", SYMBOL_FIELDS).alias("bought_token_symbol"),
        _first_number("__bought", AMOUNT_FIELDS).alias("bought_amount"), _first_number("__bought", USD_FIELDS).alias("bought_usd_amount"),
        _first_text("__sold", ADDRESS_FIELDS).alias("sold_token_address"), _first_text("__sold", SYMBOL_FIELDS).alias("sold_token_symbol"),
        _first_number("__sold", AMOUNT_FIELDS).alias("sold_amount"), _first_number("__sold", USD_FIELDS).alias("sold_usd_amount"),
        as_double(_json(item, "totalValueUsd")).alias("total_value_usd"),
    )


def flatten_pairs(items: DataFrame, item: str, keep: Sequence[str]) -> DataFrame:
    """Pair items (JSON text) to flat columns."""
    text = lambda f: F.coalesce(_json(item, f), F.lit(""))
    return items.select(
        *keep, text("pairAddress").alias("pair_address"), text("exchangeName").alias("exchange_name"), as_double(_json(item, "usdPrice")).alias("usd_price"),
        as_double(_json(item, "liquidityUsd")).alias("liquidity_usd"),
        as_double(F.coalesce(_json(item, "volume24hrUsd"), _json(item, "volume24hUsd"))).alias("volume_24h_usd"), text("pairCreatedAt").alias("pair_created_at"),
    )


AMOUNT = "struct<uiAmountString: string, uiAmount: double>"
BALANCE = f"struct<accountIndex: int, mint: string, owner: string, uiTokenAmount: {AMOUNT}>"
TRANSACTION = (
    "struct<result: struct<"
    "meta: struct<preBalances: array<double>, postBalances: array<double>, "
    f"preTokenBalances: array<{BALANCE}>, postTokenBalances: array<{BALANCE}>, "
    f"innerInstructions: array<struct<instructions: array<struct<parsed: struct<info: struct<mint: string, tokenAmount: {AMOUNT}>>>>>>>, "
    "transaction: struct<message: struct<accountKeys: array<struct<pubkey: string, signer: boolean>>>>>>"
)


def _ui(amount: Column) -> Column:
    return F.coalesce(as_double(amount["uiAmountString"]), amount["uiAmount"], F.lit(0.0))


def tx_features(transactions: DataFrame, tx: str, mint: str, keep: Sequence[str]) -> DataFrame:
    """Fee payer, largest transfers and the payer's balance changes of parsed transactions, with higher-order functions.

    ``tx`` is a column of type ``TRANSACTION`` (``from_json`` of the raw text); ``mint`` the token of interest.
    """
    base = transactions.select(*keep, F.col(mint).alias("__mint"), F.col(f"{tx}.result.meta").alias("__meta"), F.col(f"{tx}.result.transaction.message.accountKeys").alias("__keys"))
    base = base.withColumn("fee_payer", F.get(F.filter("__keys", lambda k: k["signer"]), F.lit(0))["pubkey"])
    infos = F.flatten(F.transform("__meta.innerInstructions", lambda g: F.transform(g["instructions"], lambda i: i["parsed"]["info"])))
    base = base.withColumn("__infos", infos).withColumn("__at", F.array_position(F.transform("__keys", lambda k: k["pubkey"]), F.col("fee_payer")).cast("int") - 1)

    def largest(token: Column) -> Column:
        return F.array_max(F.transform(F.filter("__infos", lambda i: i["mint"] == token), lambda i: F.abs(_ui(i["tokenAmount"]))))

    def owned(field: str) -> Column:
        owner = lambda b: F.coalesce(F.nullif(b["owner"], F.lit("")), F.get("__keys", b["accountIndex"])["pubkey"])
        return F.filter(F.col(f"__meta.{field}"), lambda b: (b["mint"] == F.col("__mint")) & (owner(b) == F.col("fee_payer")))

    total = lambda name: F.aggregate(name, F.lit(0.0), lambda acc, b: acc + _ui(b["uiTokenAmount"]))
    base = base.withColumn("__pre", owned("preTokenBalances")).withColumn("__post", owned("postTokenBalances"))
    seen = (F.coalesce(F.size("__pre"), F.lit(0)) + F.coalesce(F.size("__post"), F.lit(0))) > 0
    balance = lambda name: F.coalesce(total(name), F.lit(0.0))
    sol = (F.get("__meta.postBalances", F.col("__at")) - F.get("__meta.preBalances", F.col("__at"))) / LAMPORTS
    out = base.select(
        *keep, "fee_payer", largest(F.lit(NATIVE_MINT)).alias("volume_sol_proxy"), largest(F.col("__mint")).alias("token_amount_proxy"),
        F.when(F.col("__at") >= 0, sol).alias("fee_payer_sol_delta"),
        F.when(seen, balance("__post") - balance("__pre")).alias("fee_payer_token_delta"), F.when(seen, balance("__post")).alias("fee_payer_post_balance"),
    )
    return out.withColumn("decoded_wallet_role", trade_role(F.col("fee_payer_token_delta"), F.col("fee_payer_post_balance")))
