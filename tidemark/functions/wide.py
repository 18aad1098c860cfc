"""Exact arithmetic on 256-bit amounts.

Amounts are kept as decimal text. ``decimal(38,0)`` holds 10^38 while a uint256 reaches 1.2e77, so a value is
split in three limbs of 26 digits. A limb cast to ``decimal(28,0)`` sums in ``decimal(38,0)``: exact for 10^12
rows per group, with ordinary partial aggregation. Carries are resolved once, after the sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import let

LIMB_DIGITS = 26
BASE = "1" + "0" * LIMB_DIGITS
SUMMAND = "decimal(28,0)"
LIMB = "decimal(38,0)"
LIMBS = ("hi", "mid", "lo")


def _dec(text: str) -> Column:
    return F.lit(text).cast(LIMB)


def with_limbs(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add signed decimal text as a struct of three signed limbs (hi, mid, lo).

    The padded digits are a column of their own, so the text is parsed once and not once per limb.
    """
    sign = F.when(F.col(text).startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    padded = F.lpad(F.regexp_replace(F.col(text), r"^[+-]", ""), 3 * LIMB_DIGITS, "0")

    def part(index: int) -> Column:
        digits = F.substring("__padded", index * LIMB_DIGITS + 1, LIMB_DIGITS)
        return (digits.try_cast(f"decimal({LIMB_DIGITS},0)") * F.col("__sign")).cast(SUMMAND)

    return (
        df.withColumn("__padded", padded)
        .withColumn("__sign", sign)
        .withColumn(name, F.struct(part(0).alias("hi"), part(1).alias("mid"), part(2).alias("lo")))
        .drop("__padded", "__sign")
    )


def sum_limbs(value: str, when: Column | None = None, suffix: str = "") -> list[Column]:
    """Aggregates to place in ``agg``: columns ``hi``, ``mid``, ``lo``, over the rows that meet a condition."""
    def pick(name: str) -> Column:
        limb = F.col(f"{value}.{name}")
        return limb if when is None else F.when(when, limb)
    return [F.sum(pick(name)).cast(LIMB).alias(name + suffix) for name in LIMBS]


def carry(hi: Column, mid: Column, lo: Column) -> Column:
    """Canonical form: mid and low in [0, 10^26); the sign of the number is the sign of the high limb."""
    base = _dec(BASE)

    def resolve(low: str, high: str):
        """Move the overflow of one limb to the next."""
        def step(v: Column) -> Column:
            rest = F.pmod(v[low], base).cast(LIMB)
            moved = {low: rest, high: (v[high] + ((v[low] - rest) / base).cast("decimal(20,0)")).cast(LIMB)}
            return F.struct(*[moved.get(n, v[n]).alias(n) for n in LIMBS])
        return step

    number = F.struct(hi.cast(LIMB).alias("hi"), mid.cast(LIMB).alias("mid"), lo.cast(LIMB).alias("lo"))
    return let(let(number, resolve("lo", "mid")), resolve("mid", "hi"))


def is_positive(number: Column) -> Column:
    return (number["hi"] > 0) | ((number["hi"] == 0) & ((number["mid"] > 0) | (number["lo"] > 0)))


def is_negative(number: Column) -> Column:
    return number["hi"] < 0


def to_double(number: Column) -> Column:
    """For shares only; the sign test stays exact."""
    return (
        number["hi"].cast("double") * 1e52
        + number["mid"].cast("double") * 1e26
        + number["lo"].cast("double")
    )


def to_text(number: Column) -> Column:
    """Exact decimal text of a canonical number."""
    def digits(value: Column) -> Column:
        joined = F.concat(
            value["hi"].cast("string"),
            F.lpad(value["mid"].cast("string"), LIMB_DIGITS, "0"),
            F.lpad(value["lo"].cast("string"), LIMB_DIGITS, "0"),
        )
        return F.regexp_replace(joined, r"^0+(?=\d)", "")

    def negative(value: Column) -> Column:
        return F.concat(F.lit("-"), let(carry(-value["hi"], -value["mid"], -value["lo"]), digits))

    return let(number, lambda v: F.when(is_negative(v), negative(v)).otherwise(digits(v)))


def order_key(number: Column) -> Column:
    """Sorts like the number itself: struct comparison goes high to low."""
    return F.struct(number["hi"], number["mid"], number["lo"])


def from_hex_word(word: Column, signed: bool = False) -> Column:
    """A 64-digit hex word as a canonical number, built from eight 32-bit pieces."""
    base = 10**LIMB_DIGITS
    pieces = let(word, lambda w: F.array(*[F.conv(F.substring(w, 8 * i + 1, 8), 16, 10).cast("decimal(10,0)") for i in range(8)]))

    def limb(p: Column, level: int) -> Column:
        total = _dec("0")
        for i in range(8):
            factor = 2 ** (32 * (7 - i)) // base**level % base
            if factor:
                total = (total + F.get(p, F.lit(i)) * F.lit(str(factor)).cast(f"decimal({LIMB_DIGITS},0)")).cast(LIMB)
        if signed:
            modulus = _dec(str(2**256 // base**level % base))
            total = (total - F.when(F.get(p, F.lit(0)) >= 2**31, modulus).otherwise(_dec("0"))).cast(LIMB)
        return total

    return let(pieces, lambda p: carry(limb(p, 2), limb(p, 1), limb(p, 0)))


def signed_int24(word: Column) -> Column:
    """The low 24 bits as a signed integer: enough for ticks, whatever the sign extension of the word."""
    low = F.conv(F.substring(word, 59, 6), 16, 10).cast("int")
    return F.when(low >= 2**23, low - 2**24).otherwise(low)


def repair_int24(df: DataFrame, text: str, name: str) -> DataFrame:
    """Ticks exported as unsigned 256-bit text: above 2^255 means a negative value that was extended to 256 bits.

    The repaired value is v - 2^256 + 2^24; other values keep their text.
    """
    base = 10**LIMB_DIGITS

    def split(n: int) -> list[Column]:
        return [_dec(str(n // base**level % base)) for level in (2, 1, 0)]

    half = F.struct(*[c.alias(n) for c, n in zip(split(2**255), LIMBS)])
    parts = with_limbs(df, text, "__v")
    value = F.struct(*[F.col(f"__v.{n}").cast(LIMB).alias(n) for n in LIMBS])
    shifted = carry(*[(F.col(f"__v.{n}") - c).cast(LIMB) for n, c in zip(LIMBS, split(2**256 - 2**24))])
    return (
        parts.withColumn("__fixed", shifted)
        .withColumn(name, F.when(value > half, to_text(F.col("__fixed"))).otherwise(F.col(text)))
        .drop("__v", "__fixed")
    )
