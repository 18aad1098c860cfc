"""URL filters whose lists change over time (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_S = 30 * 86_400


def url_host(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; empty if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("."))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def url_patterns(url: Column) -> Column:
    """All patterns that can cover ``url``: every domain suffix, the host, every path prefix and the exact address.

    domain:b.c covers b.c and all hosts below it, prefix:host/x covers /x and everything below it, url: is the address
    without fragment.
    """
    host, path = url_host(url), url_path(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    domains = F.when(F.size(labels) > 0, F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    prefixes = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/"))))
    exact = F.array(F.concat(F.lit("host:"), host), F.concat(F.lit("url:"), F.regexp_replace(url, "#.*$", "")))
    none = F.array().cast("array<string>")
    return F.when(host == "", none).otherwise(F.array_distinct(F.concat(F.coalesce(domains, none), F.coalesce(prefixes, none), exact)))


def _bucket(at: Column) -> Column:
    return F.floor(F.unix_timestamp(at) / BUCKET_S).cast("long")


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Intervals [valid_from, valid_to) of dated list entries (list, effect, pattern, action add / remove, at).

    Each entry holds until the next one of the same list and pattern; of several at one instant a removal wins, else
    one addition stays. The next instant is found inside a 30-day bucket first and across buckets from one row per
    bucket, so a pattern that holds a third of all entries is never one window group.
    """
    keys = ["list", "effect", "pattern"]
    known = entries.withColumn("effect", F.coalesce("effect", F.lit("block"))).where("pattern is not null and at is not null and list is not null")
    steps = known.groupBy(*keys, "at").agg(F.max(F.col("action") == "remove").alias("removed"))
    steps = steps.withColumn("bucket", _bucket(F.col("at")))
    firsts = steps.groupBy(*keys, "bucket").agg(F.min("at").alias("first"))
    firsts = firsts.withColumn("next_first", F.lead("first").over(Window.partitionBy(*keys).orderBy("bucket"))).drop("first")
    inside = F.lead("at").over(Window.partitionBy(*keys, "bucket").orderBy("at"))
    ends = steps.withColumn("inside", inside).join(firsts, [*keys, "bucket"]).withColumn("valid_to", F.coalesce("inside", "next_first"))
    return ends.where("not removed").select(*keys, F.col("at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, page_id: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """The verdict on every capture by the list entries active at its fetch time.

    ``captures``  page_id, url, fetched_at; ``entries``  list, effect (block or allow), pattern (see url_patterns),
    action (add or remove), at. Returns page_id, url, fetched_at, n_active, verdict (block, allow or none) and the deciding
    entry: list, pattern, valid_from, valid_to. The longest pattern decides; of equal ones a block, then the smallest list.

    An as-of join by equal (pattern, 30-day bucket): intervals are laid on the buckets that captures reach, so a host
    with a third of the captures is spread over time and no pair outside a bucket is formed.

    Captures with a null or unparsable url, or no fetch time, get the verdict none. Rows equal in id, url and time are
    one capture. Entries without list, pattern or time are void. Other columns are not read.
    """
    rows = captures.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(fetched).alias("fetched_at")).distinct()
    lookups = rows.where("url is not null and fetched_at is not null").select(
        "page_id", "url", "fetched_at", _bucket(F.col("fetched_at")).alias("bucket"), F.explode(url_patterns(F.col("url"))).alias("pattern")
    )
    reach = rows.agg(F.min(_bucket(F.col("fetched_at"))).alias("low"), F.max(_bucket(F.col("fetched_at"))).alias("high")).first()
    low, high = (F.lit(reach[0]).cast("long"), F.lit(reach[1]).cast("long")) if reach[0] is not None else (F.lit(0), F.lit(0))
    spans = validity_intervals(entries)
    begin, end = F.greatest(_bucket(F.col("valid_from")), low), F.least(F.coalesce(_bucket(F.col("valid_to")), high), high)
    spans = spans.where(begin <= end).withColumn("bucket", F.explode(F.sequence(begin, end)))
    met = lookups.join(spans, ["pattern", "bucket"]).where("fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)")
    entry = F.struct("effect", "list", "pattern", "valid_from", "valid_to")
    rank = F.struct(-F.char_length("pattern"), F.col("effect") != "block", F.col("list"), F.col("pattern"), F.col("valid_from"))
    found = met.groupBy("page_id", "url", "fetched_at").agg(F.count("*").alias("n_active"), F.min_by(entry, rank).alias("entry"))
    same = ["page_id", "url", "fetched_at"]
    found = found.select(*[F.col(c).alias(f"__{c}") for c in same], "n_active", "entry")
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same]
    out = rows.join(found, on[0] & on[1] & on[2], "left")
    verdict = F.coalesce("entry.effect", F.lit("none")).alias("verdict")
    return out.select(*same, F.coalesce("n_active", F.lit(0)).alias("n_active"), verdict, "entry.list", "entry.pattern", "entry.valid_from", "entry.valid_to")
