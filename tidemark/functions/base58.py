"""Checksummed base58 of hex addresses: big-integer division has no JVM expression, so it runs on Arrow batches."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The base58 alphabet and the one-byte network prefix.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
PREFIX = "41"


def encode(address: str) -> str:
    body = bytes.fromhex(PREFIX + address.lower().removeprefix("0x")[-40:])
    body += hashlib.sha256(hashlib.sha256(body).digest()).digest()[:4]
    number, text = int.from_bytes(body, "big"), ""
    while number:
        number, digit = divmod(number, 58)
        text = ALPHABET[digit] + text
    return ALPHABET[0] * (len(body) - len(body.lstrip(b"\0"))) + text


@F.pandas_udf(StringType())
def base58_address(address: pd.Series) -> pd.Series:
    """Base58 form of a 20-byte hex address."""
    return address.map(encode, na_action="ignore")
