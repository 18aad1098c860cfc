"""Data contracts: keys, references, domains, coverage states, gates and funnels.

Every check is a one-row frame (check, subject, violations, passed), so a release report is a union. Missingness is
data: an absent row has a stated state and is never read as zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import safe_rate
from tidemark.operators import filters, ranking

# Coverage states and eligibility labels.
COVERAGE_STATES = ("observed", "processed_zero_rows", "not_collected", "not_applicable", "not_collected_by_policy")
ELIGIBILITY = ("accepted", "conditional", "rejected")


def _result(df: DataFrame, check: str, subject: str, violations: Column) -> DataFrame:
    return df.agg(F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations")).select(
        F.lit(check).alias("check_name"), F.lit(subject).alias("subject"), "violations", (F.col("violations") == 0).alias("passed")
    )


def check_schema(df: DataFrame, schema: T.StructType, subject: str) -> DataFrame:
    """Per required column: present, right type, and nulls where none are allowed. One pass counts all nulls."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    strict = [f.name for f in schema.fields if not f.nullable and f.name in kinds]
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in strict]) if strict else df.agg(F.lit(0).alias("__none"))
    facts = [
        F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.name in kinds).alias("present"), F.lit(kinds.get(f.name) == f.dataType).alias("type_ok"),
            (F.col(f.name) if f.name in strict else F.lit(0)).cast("bigint").alias("nulls"),
        ) for f in schema.fields
    ]
    rows = nulls.select(F.explode(F.array(*facts)).alias("f")).select(F.lit(subject).alias("subject"), "f.*")
    return rows.withColumn("schema_ok", F.col("present") & F.col("type_ok") & (F.col("nulls") == 0))


def check_unique(df: DataFrame, keys: Sequence[str], subject: str) -> DataFrame:
    repeats = filters.duplicated(df, keys)
    return _result(repeats, "unique", f"{subject}({', '.join(keys)})", F.count("*"))


def check_fk(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, subject: str) -> DataFrame:
    """Child keys without a parent; a null optional key refers to nothing and is skipped."""
    keys = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("__k")).agg(F.count("*").alias("n"))
    orphans = keys.join(parent.select(F.col(parent_key).alias("__k")), "__k", "left_anti")
    return _result(orphans, "foreign_key", f"{subject}.{child_key}", F.sum("n"))


def check_domain(df: DataFrame, column: str, allowed: Sequence[str], subject: str) -> DataFrame:
    outside = F.col(column).isNotNull() & ~F.col(column).isin(*allowed)
    return _result(df, "domain", f"{subject}.{column}", F.count_if(outside))


def check_iff(ledger: DataFrame, table: DataFrame, key: str, state: str, subject: str, observed: str = "observed") -> DataFrame:
    """The ledger says observed exactly when the table has the key."""
    marks = table.select(key).distinct().withColumn("__has", F.lit(True))
    joined = ledger.join(marks, key, "left")
    mismatch = (F.col(state) == observed) != F.coalesce(F.col("__has"), F.lit(False))
    return _result(joined, "observed_iff_row", f"{subject}.{state}", F.count_if(mismatch))


def check_match(targets: DataFrame, table: DataFrame, on: Sequence[str], equal: Sequence[tuple[str, str]], subject: str) -> DataFrame:
    """Every target matches exactly one table row on the keys and agrees on the paired columns."""
    right = table.groupBy(*on).agg(F.count("*").alias("__n"), *[F.min(r).alias(f"__{r}") for _, r in equal])
    joined = targets.join(right, list(on), "left")
    bad = F.coalesce(F.col("__n"), F.lit(0)) != 1
    for left, r in equal:
        bad = bad | ~F.col(left).eqNullSafe(F.col(f"__{r}"))
    return _result(joined, "exactly_once", subject, F.count_if(bad))


def check_same_set(a: DataFrame, b: DataFrame, key: str, subject: str) -> DataFrame:
    sides = a.select(F.col(key).alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(F.col(key).alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    per_key = sides.groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return _result(per_key, "same_set", f"{subject}.{key}", F.count_if(F.col("a") != F.col("b")))


def event_gate_violations(events: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """(rule, subject_id) rows for every broken rule of an event registry with its evidence."""
    status = F.col("eligibility_status")
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    support = evidence.groupBy("event_id").agg(
        F.count("*").alias("__evidence"),
        F.max(((F.col("supports_eligibility") == "accepted") & (F.col("evidence_role") == "activation_boundary")).cast("int")).alias("__boundary"),
    )
    joined = events.join(support, "event_id", "left")
    none = F.coalesce(F.col("__evidence"), F.lit(0)) == 0

    def rule(df: DataFrame, name: str, bad: Column, subject: str) -> DataFrame:
        return df.where(F.coalesce(bad, F.lit(False))).select(F.lit(name).alias("rule"), F.col(subject).cast("string").alias("subject_id"))

    known = evidence.join(sources.select("source_id").distinct().withColumn("__known", F.lit(True)), "source_id", "left")
    orphan = evidence.join(events.select("event_id"), "event_id", "left_anti")
    parts = [
        rule(joined, "invalid_eligibility", ~status.isin(*ELIGIBILITY), "event_id"),
        rule(joined, "rejected_without_reason", (status == "rejected") & blank("rejection_reason"), "event_id"),
        rule(joined, "accepted_without_activation", (status == "accepted") & F.col("activation_at").isNull(), "event_id"),
        rule(joined, "accepted_without_boundary_evidence", (status == "accepted") & (F.coalesce("__boundary", F.lit(0)) == 0), "event_id"),
        rule(joined, "no_evidence", none, "event_id"),
        rule(known, "invalid_evidence_eligibility", ~F.col("supports_eligibility").isin(*ELIGIBILITY), "evidence_id"),
        rule(known, "unregistered_source", F.col("__known").isNull(), "evidence_id"),
        rule(orphan, "orphan_evidence", F.lit(True), "evidence_id"),
        rule(filters.duplicated(events, ["event_id"]), "duplicate_event", F.lit(True), "event_id"),
        rule(filters.duplicated(evidence, ["evidence_id"]), "duplicate_evidence", F.lit(True), "evidence_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def staggered_gate(events: DataFrame, platform: str, family: str, accepted: Column) -> DataFrame:
    """A staggered design needs three platforms and some family with three accepted events."""
    kept = events.where(accepted)
    families = kept.groupBy(family).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest_family"))
    return kept.agg(F.count("*").alias("accepted_events"), F.count_distinct(platform).alias("platforms")).withColumn("largest_family", families.scalar()).withColumn(
        "gate_passes", (F.col("platforms") >= 3) & (F.col("largest_family") >= 3)
    )


def integrity_summary(checks: Sequence[DataFrame]) -> DataFrame:
    """All check results with the verdict of the whole release on every row."""
    rows = reduce(DataFrame.unionByName, checks)
    verdict = rows.agg(F.bool_and("passed")).scalar()
    return rows.withColumn("release_accepted", verdict)


def check_panel(panel: DataFrame, unit: str, date: str, low: str, high: str) -> DataFrame:
    """Shape of a unit x day panel against a full calendar: one row per unit plus its duplicates and gaps."""
    per_day = panel.groupBy(unit, date).agg(F.count("*").alias("n"))
    days = F.datediff(F.lit(high).cast("date"), F.lit(low).cast("date")) + 1
    inside = F.col(date).between(F.lit(low).cast("date"), F.lit(high).cast("date"))
    out = per_day.groupBy(unit).agg(
        F.sum("n").alias("rows"), F.count("*").alias("days"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("duplicates"),
        (F.max(days) - F.count_if(inside)).alias("missing_days"), F.min(date).alias("first_day"), F.max(date).alias("last_day"),
    )
    return out.withColumn("balanced", (F.col("duplicates") == 0) & (F.col("missing_days") == 0))


def window_audit(series: DataFrame, unit: str, date: str, value: str, windows: dict[str, tuple[str, str]]) -> DataFrame:
    """Missing and zero days of each unit in each named window."""
    spans = F.explode(F.array(*[F.struct(F.lit(n).alias("w"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, (a, b) in windows.items()])).alias("s")
    per_day = series.groupBy(unit, date).agg(F.max(value).alias("v"))
    rows = per_day.select(unit, date, "v", spans).select(unit, "v", "s.w", "s.a", "s.b", F.col(date).between(F.col("s.a"), F.col("s.b")).alias("inside"))
    total = F.max(F.datediff("b", "a") + 1)
    return rows.groupBy(unit, F.col("w").alias("window_name")).agg(
        F.count_if("inside").alias("observed_days"), (total - F.count_if("inside")).alias("missing_days"), F.count_if(F.col("inside") & (F.col("v") == 0)).alias("zero_days")
    )


def import_coverage(grid: DataFrame, rows: DataFrame, unit: str, block: str, low: str, high: str) -> DataFrame:
    """Rows observed per expected unit and horizon, with the processed status; an expected unit never disappears.

    ``grid`` has the unit, ``horizon_days`` and its block bounds; ``rows`` has the unit and block.
    """
    keys = [unit, "horizon_days"]
    seen = rows.select(unit, block).join(grid.select(*keys, low, high), unit).where(F.col(block).between(F.col(low), F.col(high))).groupBy(*keys).agg(F.count("*").alias("observed_rows"))
    out = grid.join(seen, keys, "left").withColumn("observed_rows", F.coalesce("observed_rows", F.lit(0)))
    return out.withColumn("coverage_status", F.when(F.col("observed_rows") > 0, "processed_with_rows").otherwise("processed_zero_rows"))


def coverage_share(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("horizon_days").agg(
        F.count("*").alias("units"), F.count_if(F.col("coverage_status") == "processed_with_rows").alias("units_with_rows"), F.sum("observed_rows").alias("rows"),
        F.avg((F.col("coverage_status") == "processed_with_rows").cast("double")).alias("share_with_rows"),
    )


def check_rebuild(cells: DataFrame, reported: DataFrame, keys: Sequence[str], weight: str, value: str, reported_value: str, tolerance: float = 1e-9) -> DataFrame:
    """Aggregate rebuilt from weighted cells against the reported one."""
    rebuilt = cells.groupBy(*keys).agg(safe_rate(F.sum(F.col(weight) * F.col(value)), F.sum(weight)).alias("rebuilt"))
    gap = rebuilt.join(reported, list(keys), "full").withColumn("gap", F.abs(F.col("rebuilt") - F.col(reported_value)))
    bad = F.col("gap").isNull() | (F.col("gap") > tolerance)
    return gap.agg(F.count("*").alias("groups"), F.max("gap").alias("largest_gap"), F.count_if(bad).alias("violations")).withColumn("passed", F.col("violations") == 0)


def sample_status(windows: DataFrame, tokens_needed: int = 50, swaps_needed: int = 500) -> DataFrame:
    """Credibility of a collected sample at 30 days: complete and truncated shares, truncated zeros counted apart."""
    late = windows.where("horizon_days = 30")
    ok = F.coalesce(F.col("window_status") == "ok", F.lit(False))
    row = late.agg(
        F.count("*").alias("tokens"), F.count_if(F.col("swap_count") > 0).alias("tokens_with_swaps"), F.coalesce(F.sum("swap_count"), F.lit(0)).alias("swap_rows"),
        F.count_if(ok).alias("complete_tokens"), F.avg(ok.cast("double")).alias("complete_share"), F.count_if(~ok).alias("truncated_tokens"),
        F.count_if(~ok & (F.col("swap_count") == 0)).alias("truncated_zero_tokens"), F.avg(F.when(ok, (F.col("swap_count") > 0).cast("double"))).alias("complete_active_share"),
    )
    row = ranking.with_quantiles(row, [], ranking.quantiles(late.withColumn("v", F.when(ok, F.col("swap_count"))), [], "v", {"median_complete_swaps": 0.5}))
    credible = (F.col("tokens_with_swaps") >= tokens_needed) & (F.col("swap_rows") >= swaps_needed)
    return row.withColumn("credible", credible)


def sample_flow(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows left after each eligibility rule, in order: flags first, then one aggregate."""
    passed, counts = F.lit(True), [F.struct(F.lit(0).alias("step"), F.lit("all").alias("stage"), F.count("*").alias("n"))]
    for i, (name, rule) in enumerate(stages.items(), start=1):
        passed = passed & F.coalesce(rule, F.lit(False))
        counts.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.count_if(passed).alias("n")))
    return df.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
