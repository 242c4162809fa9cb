"""Files as sources and sinks: CSV and parquet of listings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prumo.functions.cast import safe_float, safe_int
from prumo.schema import LISTING_SCHEMA

#: Texts that a CSV of listings uses for a missing value (fixed values).
CSV_NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType = LISTING_SCHEMA, columns: Iterable[str] | None = None, one_line: bool = False) -> DataFrame:
    """A CSV of listings: quoted line breaks, doubled quotes, declared types; what can't be read as its type is null.

    one_line: no field holds a line break, so that a large file is split among the tasks; else a file is one task.

    The fields are read as text, so that one bad number costs a cell and not a row; columns prunes the scan.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(texts).csv(path, header=True, multiLine=not one_line, quote='"', escape='"', encoding="UTF-8")
    wanted = [f for f in schema if columns is None or f.name in set(columns)]

    def typed(f: T.StructField):
        c = F.when(~F.col(f.name).isin(*CSV_NULLS), F.col(f.name))
        if isinstance(f.dataType, T.DoubleType):
            return safe_float(c).alias(f.name)
        if isinstance(f.dataType, T.IntegerType):
            return safe_int(c).alias(f.name)
        return c.try_cast(f.dataType).alias(f.name)

    return raw.select(*(typed(f) for f in wanted))


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """A folder of CSV parts, each with its header; replaced or added to."""
    df.write.mode("append" if append else "overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, encoding="UTF-8")


def scan_parquet(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A parquet table, all columns or some; the scan reads only those."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, *partition: str, append: bool = False) -> None:
    """A parquet table, replaced or added to."""
    w = df.write.mode("append" if append else "overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def from_records(spark: SparkSession, records: Iterable[Mapping[str, Any]], schema: T.StructType = LISTING_SCHEMA) -> DataFrame:
    """A frame of parsed records held in memory; fields they lack are null."""
    rows = [tuple(r.get(n) for n in schema.names) for r in records]
    return spark.createDataFrame(rows, schema)
