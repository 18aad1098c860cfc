"""Typed parsing, canonical ids and small projections.

Raw logs arrive as strings. Every parser here turns bad input into null with ``try_*`` expressions, because a
plain cast fails the whole job under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text forms the raw exports use.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
ISO_TEXT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"
TRUE_WORDS_WIDE = ("true", "1", "yes", "y")
TRUE_WORDS_NARROW = ("true", "1", "yes")
BLANK_NUMBER_WORDS = ("", "nan", "none", "<na>")
ADDRESS_MIN_LENGTH = 32
MILLIS_THRESHOLD = 1e10
LAST_MICROS = 253402300800e6  # end of year 9999


def blank_to_null(col: Column) -> Column:
    """Empty string becomes null; anything else is kept as it is."""
    return F.nullif(col, F.lit(""))


def as_double(col: Column) -> Column:
    """Finite double, or null for text, NaN and infinities."""
    text = col.cast("string")
    number = F.when(text.rlike(NUMERIC_TEXT), F.trim(text).try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def nan_to_null(col: Column) -> Column:
    """For columns that are double already: missing is null, never NaN."""
    return F.when(~F.isnan(col), col)


def as_long(col: Column) -> Column:
    """Integer through double, truncated toward zero."""
    return as_double(col).try_cast("bigint")


def as_bool(col: Column, null_as: bool | None) -> Column:
    """Two dialects: ``null_as=False`` also accepts ``y`` and trims; ``null_as=None`` keeps null."""
    if null_as is None:
        return F.lower(col.cast("string")).isin(*TRUE_WORDS_NARROW)
    known = F.lower(F.trim(col.cast("string"))).isin(*TRUE_WORDS_WIDE)
    return F.coalesce(known, F.lit(null_as))


def _iso(text: Column) -> Column:
    return F.when(text.rlike(ISO_TEXT), F.try_to_timestamp(text))


def parse_ts(col: Column, mode: str) -> Column:
    """Timestamp text to UTC timestamp. The unit is never guessed: the caller names the dialect.

    ``digits_ms``   all-digit text is epoch milliseconds
    ``seconds``     any number is epoch seconds
    ``millis``      any number is epoch milliseconds
    ``magnitude``   a number above 1e10 is milliseconds, else seconds
    ``strict``      ISO only; bad text fails the query
    """
    text = F.trim(col.cast("string"))
    if mode == "strict":
        return F.when(text != "", F.to_timestamp(text))
    if mode == "digits_ms":
        return F.when(text.rlike(r"^\d+$"), F.timestamp_millis(text.try_cast("bigint"))).otherwise(_iso(text))
    number = as_double(text)
    if mode == "seconds":
        micros = number * 1e6
    elif mode == "millis":
        micros = number * 1e3
    elif mode == "magnitude":
        micros = number * F.when(number > MILLIS_THRESHOLD, 1e3).otherwise(1e6)
    else:
        raise ValueError(f"unknown timestamp dialect: {mode}")
    in_range = F.abs(micros) < LAST_MICROS
    return F.when(in_range, F.timestamp_micros(F.round(micros).try_cast("bigint"))).when(number.isNull(), _iso(text))


def token_id(chain: Column | str, address: Column, fold_case: bool) -> Column:
    """``{chain}/token:{address}``; hex addresses fold case, base58 addresses must not."""
    chain = F.lit(chain) if isinstance(chain, str) else chain
    return F.concat(chain, F.lit("/token:"), F.lower(address) if fold_case else address)


def launch_id(token: Column, tx: Column, log_index: Column) -> Column:
    return F.concat(token, F.lit("/launch:"), tx, F.lit(":"), log_index.cast("string"))


def event_id(token: Column, kind: Column | str, tx: Column, log_index: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(token, F.lit("/"), kind, F.lit(":"), tx, F.lit(":"), log_index.cast("string"))


def let(value: Column, body) -> Column:
    """Bind an expression to a name, so that a long body refers to it without repeating it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Forms of an exported integer.
PLAIN_INTEGER = r"^(0|-?[1-9]\d*)$"
EXPONENT_NUMBER = r"^([+-]?)(\d+)(?:\.(\d*))?[eE]([+-]?\d+)$"


def integer_text(col: Column) -> Column:
    """Exact integer text from ``1.0``, ``1e18``, blanks and signs, without passing through a double.

    Integers in canonical form, the common case, pass after one match.
    """
    return let(F.trim(F.coalesce(col.cast("string"), F.lit(""))), lambda t: F.when(t.rlike(PLAIN_INTEGER), t).otherwise(_odd_integer(t)))


def _odd_integer(text: Column) -> Column:
    whole = F.regexp_extract(text, EXPONENT_NUMBER, 2)
    digits = F.concat(whole, F.regexp_extract(text, EXPONENT_NUMBER, 3))
    width = F.length(whole) + F.regexp_extract(text, EXPONENT_NUMBER, 4).try_cast("int")
    moved = F.when(width > 0, F.rpad(digits, width, F.lit("0"))).otherwise(F.lit("0"))
    plain = F.regexp_replace(text, r"\.0$", "")
    is_exponent = text.rlike(EXPONENT_NUMBER)
    magnitude = F.when(is_exponent, moved).otherwise(F.regexp_replace(plain, r"^[+-]", ""))
    stripped = F.regexp_replace(magnitude, r"^0+(?=\d)", "")
    signed = F.when((stripped != "0") & text.startswith("-"), F.concat(F.lit("-"), stripped)).otherwise(stripped)
    return (
        F.when(F.lower(text).isin(*BLANK_NUMBER_WORDS), F.lit("0"))
        .when(is_exponent | plain.rlike(r"^-?\d+$"), signed)
        .otherwise(text)
    )


def safe_rate(numerator: Column, denominator: Column) -> Column:
    """A ratio whose zero or missing denominator is missing, never zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def log1p_amount(col: Column) -> Column:
    return F.log1p(col)


def clip(col: Column, low: float, high: float) -> Column:
    """Null stays null; ``greatest`` alone would replace it by the bound."""
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))


def outside(col: Column, low: float, high: float) -> Column:
    """The flag that must be taken before clipping."""
    return F.coalesce((col < low) | (col > high), F.lit(False))


def normalize_handle(col: Column) -> Column:
    """A channel handle from ``@name`` or from a public channel link, else null."""
    text = F.trim(col)
    # Link hosts that carry a handle, and first path parts that are not handles.
    hosts = ("t.me", "telegram.me", "telegram.dog", "www.t.me")
    reserved = ("joinchat", "share", "addstickers", "proxy")
    mention = F.regexp_extract(text, r"^@([^/?]*)", 1)
    link = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text))
    host = F.lower(F.regexp_extract(link, r"^[^:]+://([^/?#]*)", 1))
    first_part = F.regexp_extract(link, r"^[^:]+://[^/?#]*/+([^/?#]+)", 1)
    from_link = F.when(host.isin(*hosts) & ~first_part.isin(*reserved), F.regexp_replace(first_part, r"^[@+]+", ""))
    return blank_to_null(F.when(text.startswith("@"), mention).otherwise(from_link))


def classify_version(columns: list[Column], classes: dict[str, tuple[str, ...]], default: str = "other_or_unknown") -> Column:
    """First class, in order, that any of the columns is a member of; otherwise the default label."""
    label = None
    for name, members in classes.items():
        hit = F.lit(False)
        for column in columns:
            hit = hit | F.coalesce(F.lower(column).isin(*members), F.lit(False))
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise(default)


def trade_role(delta: Column, post_balance: Column) -> Column:
    """Six labels from the sign of the payer's token delta and the balance afterwards."""
    # The role labels.
    holds = F.coalesce(post_balance > 0, F.lit(False))
    return (
        F.when(delta.isNull() | F.isnan(delta), "unclassified")
        .when((delta > 0) & holds, "buyer_holder_proxy")
        .when(delta > 0, "buyer_proxy")
        .when((delta < 0) & holds, "seller_holder_proxy")
        .when(delta < 0, "seller_proxy")
        .when(holds, "holder_no_delta_proxy")
        .otherwise("no_fee_payer_token_position")
    )


def period_label(date: Column, pre: tuple[str, str], post: tuple[str, str]) -> Column:
    """Inclusive calendar ranges; a day outside both has a null label."""
    def inside(span: tuple[str, str]) -> Column:
        return date.between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date"))
    return F.when(inside(pre), "pre").when(inside(post), "post")


def rel_day(date: Column, event: str) -> Column:
    return F.datediff(date, F.lit(event).cast("date"))


def rel_week(day: Column, limit: int = 12) -> Column:
    week = F.floor(day / 7)
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), week)).cast("int")


def week_start(date: Column) -> Column:
    """Monday of the week, as a date."""
    return F.date_trunc("week", date).cast("date")


def window_status(base_status: Column, has_cursor: Column, last_ts: Column, horizon_end: Column) -> Column:
    """Status of one horizon of a paged scan: a cut-off scan is a lower bound, never a zero."""
    # The status labels.
    return (
        F.when(base_status.isin("quota_or_access_stop", "api_error"), base_status)
        .when(~has_cursor, F.when(base_status == "empty", "empty").otherwise("ok"))
        .when(last_ts >= horizon_end, "ok")
        .otherwise("page_limit_reached_lower_bound")
    )


def cut(col: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins ``(edges[i], edges[i+1]]``; outside all bins is null."""
    out = None
    for low, high, label in zip(edges[:-1], edges[1:], labels):
        hit = col > low if high == float("inf") else (col > low) & (col <= high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def time_flags(minutes: Column, limits: tuple[int, ...]) -> dict[str, Column]:
    """``within_{n}m`` for each limit and ``after_{max}m`` for the remainder of the completed ones."""
    known = minutes.isNotNull()
    flags = {f"within_{n}m": F.when(known & (minutes <= n), 1).otherwise(0) for n in limits}
    flags[f"after_{max(limits)}m"] = F.when(known & (minutes > max(limits)), 1).otherwise(0)
    return flags


def censored_outcome(start: Column, event: Column, horizon_days: int, as_of: Column) -> Column:
    """Null while the horizon has not elapsed, else whether the event came within it."""
    span = F.expr(f"INTERVAL {int(horizon_days)} DAYS")
    return F.when(start > as_of - span, F.lit(None).cast("boolean")).otherwise(
        F.coalesce(event <= start + span, F.lit(False))
    )


def md5_uniform(*parts: Column) -> Column:
    """Reproducible uniform in [0, 1) from a key: 32 bits of md5, the same in any SQL engine."""
    key = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def md5_sign(*parts: Column) -> Column:
    """Rademacher sign with the same reproducibility."""
    return F.when(md5_uniform(*parts) < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))
