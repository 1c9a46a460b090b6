"""Typed parquet and JSON sinks, and the matching reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from coocatlas.operators.quality import conform


def write_typed(df: DataFrame, target: T.StructType, path: str, mode: str = "errorifexists") -> None:
    """Write parquet in a declared schema; a missing column fails before anything is written."""
    conform(df, target).write.mode(mode).parquet(path)


def read_typed(spark: SparkSession, path: str, target: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Read parquet written with a declared schema, only the named columns if given."""
    df = spark.read.schema(target).parquet(path)
    return df if columns is None else df.select(*columns)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write one JSON object per row; null fields are left out, as search documents need."""
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Write a one-row description next to an export, stamped with the time of writing."""
    write_json(manifest.selectExpr("*", "current_timestamp() AS created_at").coalesce(1), path, "overwrite")
