"""Unit and period effects swept out of panels with gaps, exactly and without a design matrix."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import settle

#: levels of the smaller side: the system that is solved has this many rows at most for each key
MOST_LEVELS = 2000


def cells_of(df: DataFrame, unit: str, period: str, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per key, unit and period: rows ``__n`` and sums ``__s_<column>``, settled."""
    sums = [F.sum(F.col(c).cast("double")).alias(f"__s_{c}") for c in columns]
    return settle(df.groupBy(*keys, unit, period).agg(F.count("*").alias("__n"), *sums))


def meetings(cells: DataFrame, level: str, other: str, keys: Sequence[str], where=None) -> DataFrame:
    """(keys, a, b, v): sum over ``other`` of n_a n_b / n, how often two levels meet; at most levels squared rows a key."""
    met = cells if where is None else cells.where(where)
    totals = met.groupBy(*keys, other).agg(F.sum("__n").alias("__total"))
    left = met.join(totals, [*keys, other]).select(*keys, other, F.col(level).alias("a"), (F.col("__n") / F.col("__total")).alias("__share"))
    right = met.select(*keys, other, F.col(level).alias("b"), "__n")
    return left.join(right, [*keys, other]).groupBy(*keys, "a", "b").agg(F.sum(F.col("__share") * F.col("__n")).alias("v"))


def _checked(cells: DataFrame, unit: str, period: str) -> tuple[str, str]:
    """The side with fewer levels, whose system is solved, and the other one, which is swept out by its means."""
    n = cells.agg(F.count_distinct(unit), F.count_distinct(period)).first()
    level, other = (unit, period) if n[0] <= n[1] else (period, unit)
    if min(n) > MOST_LEVELS:
        raise ValueError(f"the smaller side has {min(n)} levels, more than {MOST_LEVELS}")
    return level, other


def level_effects(cells: DataFrame, level: str, other: str, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, level, __a_<column>): the effects of the smaller side once the other side's means are out.

    Normal equations of the levels alone: counts on the diagonal less how often levels meet. Only they leave Spark,
    levels squared numbers a key. Parts of a panel that never meet get least-norm effects, which leave residuals as
    they are.
    """
    names = [f"__s_{c}" for c in columns]
    totals = cells.groupBy(*keys, other).agg(F.sum("__n").alias("__total"), *[F.sum(s).alias(f"__t{s}") for s in names])
    joined = cells.join(totals, [*keys, other])
    right = joined.groupBy(*keys, level).agg(
        F.sum("__n").cast("double").alias("__n"), *[F.sum(F.col(s) - F.col("__n") * F.col(f"__t{s}") / F.col("__total")).alias(s) for s in names]
    ).toArrow().to_pylist()
    pairs = meetings(cells, level, other, keys).toArrow().to_pylist()
    by_key: dict[tuple, list[dict]] = {}
    for row in right:
        by_key.setdefault(tuple(row[k] for k in keys), []).append(row)
    met: dict[tuple, list[dict]] = {}
    for row in pairs:
        met.setdefault(tuple(row[k] for k in keys), []).append(row)
    out = []
    for key, rows in by_key.items():
        place = {r[level]: i for i, r in enumerate(rows)}
        a = np.diag([r["__n"] for r in rows])
        for r in met[key]:
            a[place[r["a"]], place[r["b"]]] -= r["v"]
        b = np.array([[r[s] for s in names] for r in rows])
        for r, x in zip(rows, np.linalg.lstsq(a, b, rcond=1e-11)[0].tolist()):
            out.append((*key, r[level], *x))
    schema = T.StructType([*[cells.schema[c] for c in (*keys, level)], *[T.StructField(f"__a_{c}", T.DoubleType()) for c in columns]])
    return cells.sparkSession.createDataFrame(out, schema)


def two_way_residuals(df: DataFrame, unit: str, period: str, columns: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with residuals of several columns after unit and period effects, for each key on its own.

    The panel may have gaps and repeated cells: on a balanced one the residual is the value less unit and period mean
    plus grand mean, otherwise the effects of the side with fewer levels solve a small system first (no iteration, the
    rows are read twice). Columns hold no nulls; keys, units and periods neither.
    """
    names, marks = list(columns), [f"__m_{c}" for c in columns]
    cells = cells_of(df, unit, period, names, keys)
    level, other = _checked(cells, unit, period)
    effects = level_effects(cells, level, other, names, keys)
    left = cells.join(effects, [*keys, level]).groupBy(*keys, other).agg(
        *[((F.sum(f"__s_{c}") - F.sum(F.col("__n") * F.col(f"__a_{c}"))) / F.sum("__n")).alias(m) for c, m in zip(names, marks)]
    )
    joined = df.join(effects, [*keys, level]).join(left, [*keys, other])
    for c, out in columns.items():
        joined = joined.withColumn(out, F.col(c) - F.col(f"__a_{c}") - F.col(f"__m_{c}"))
    return joined.drop(*marks, *[f"__a_{c}" for c in names])


def square(rows: pa.Table, names: Sequence, value: str = "v", a: str = "a", b: str = "b") -> np.ndarray:
    """A matrix over ``names`` from (a, b, value) rows."""
    place, out = {n: i for i, n in enumerate(names)}, np.zeros((len(names), len(names)))
    for r in rows.to_pylist():
        out[place[r[a]], place[r[b]]] += r[value]
    return out
