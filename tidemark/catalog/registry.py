"""Registration of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import pin_utc
from tidemark.sources.readers import read_table

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """Lazy access to the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return read_table(self.spark, f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def _presentable(df: DataFrame, digits: int, exact: Sequence[str]) -> DataFrame:
    """Doubles rounded (the last digit of a sum depends on its order), instants as plain UTC timestamps."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)) and field.name not in exact:
            column = F.round(column.cast("double"), digits) + F.lit(0.0)
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        out.append(column.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register a query. ``doubles`` names the result columns that both sides round to ``digits``."""
    columns = doubles.split()

    def register(build: Callable[[Tables], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"duplicate query name: {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _presentable(build(Tables(pin_utc(spark), folder)), digits, ())

        text = sql
        if sql and columns:
            rounded = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in columns)
            text = f"SELECT * REPLACE ({rounded}) FROM (\n{sql.strip()}\n)"
        ENTRIES[name] = Entry(run, text)
        return build

    return register
