"""Writers: staged multi-table releases, text exports, aligned appends, fingerprints and profiles."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a table schema: absent columns become typed nulls, so an empty table keeps its shape."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def write_release(spark: SparkSession, tables: Mapping[str, DataFrame], out: str, schemas: Mapping[str, T.StructType] | None = None) -> None:
    """Write all tables to a staging folder, then publish them with one rename. A failure publishes nothing."""
    staging = f"{out}.staging-{uuid.uuid4().hex}"
    fs, final = _file_system(spark, out)
    _, staged = _file_system(spark, staging)
    if fs.exists(final):
        raise FileExistsError(f"release already exists: {out}")
    try:
        for name, df in tables.items():
            df = typed(df, schemas[name]) if schemas and name in schemas else df
            df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{staging}/{name}")
        if not fs.rename(staged, final):
            raise OSError(f"could not publish {out}")
    except BaseException:
        fs.delete(staged, True)
        raise


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """UTF-8 with a header; null and NaN become the empty string."""
    kinds = dict(df.dtypes)
    shown = [F.nanvl(F.col(c), F.lit(None)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    df.select(*shown).write.csv(path, header=True, nullValue="", emptyValue="", encoding="UTF-8")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path, compression="gzip")


def align(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly the target columns, in order; columns the batch lacks are null."""
    present = set(df.columns)
    return df.select(*[F.col(c) if c in present else F.lit(None).alias(c) for c in columns])


def append_aligned(existing: DataFrame, batch: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table after an append whose header may have changed."""
    return align(existing, columns).unionByName(align(batch, columns))


def fingerprint(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns and an order-insensitive content digest per table: a sum of row hashes, so layout is irrelevant."""
    def one(name: str, df: DataFrame) -> DataFrame:
        digest = F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(20,0)"))
        return df.agg(F.count("*").alias("rows"), F.coalesce(digest, F.lit(0)).cast("string").alias("digest")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).alias("columns"), "digest"
        )
    return reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])


def check_manifest(tables: Mapping[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """Each table compared with its recorded fingerprint; a table on one side only does not match."""
    now = fingerprint(tables).select("table_name", *[F.col(c).alias(f"now_{c}") for c in ("rows", "columns", "digest")])
    same = F.lit(True)
    for c in ("rows", "columns", "digest"):
        same = same & F.col(c).cast("string").eqNullSafe(F.col(f"now_{c}").cast("string"))
    return manifest.join(now, "table_name", "full").select("table_name", "rows", "now_rows", same.alias("matches"))


def profile(df: DataFrame, id_column: str, time_columns: Sequence[str], category_columns: Sequence[str]) -> DataFrame:
    """Long profile: rows, unique ids, span of each time column, count of each category.

    Ids are counted from a distinct pre-aggregation; categories share one grouped pass.
    """
    per_id = df.groupBy(id_column).agg(
        F.count("*").alias("n"), *[f(c).alias(f"{t}_{c}") for c in time_columns for t, f in (("min", F.min), ("max", F.max))]
    )
    known = F.col(id_column).isNotNull() & (F.col(id_column).cast("string") != "")
    head = per_id.agg(
        F.sum("n").alias("rows"), F.count_if(known).alias("ids"),
        *[f(f"{t}_{c}").cast("string").alias(f"{t}_{c}") for c in time_columns for t, f in (("min", F.min), ("max", F.max))],
    )
    facts = [F.struct(F.lit("rows").alias("fact"), F.lit("").alias("name"), F.col("rows").cast("string").alias("value")),
             F.struct(F.lit("unique_ids").alias("fact"), F.lit(id_column).alias("name"), F.col("ids").cast("string").alias("value"))]
    for c in time_columns:
        facts += [F.struct(F.lit(f"{t}").alias("fact"), F.lit(c).alias("name"), F.col(f"{t}_{c}").alias("value")) for t in ("min", "max")]
    spans = head.select(F.explode(F.array(*facts)).alias("f")).select("f.*")
    labels = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")) for c in category_columns]))
    counts = df.select(labels.alias("x")).groupBy("x.c", "x.v").agg(F.count("*").cast("string").alias("value")).select(
        F.lit("category").alias("fact"), F.concat_ws("=", "c", "v").alias("name"), "value"
    )
    return spans.unionByName(counts)
