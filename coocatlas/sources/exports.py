"""Committed exports: typed data, then a list of its files, then one row that names both.

An export writes its data and file list into new folders and only then replaces the commit
row, so a reader sees the last export whose every step ended, whatever attempt was lost on
the way. The file list holds the rows of each file, counted from the written files; reading
back compares it with what is there and fails on a missing, changed or foreign file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coocatlas.operators.quality import conform

COMMIT = "folder STRING, kind STRING, columns ARRAY<STRING>, ddl STRING, files BIGINT, `rows` BIGINT, bytes BIGINT"
FILES = "file STRING, bytes BIGINT, `rows` BIGINT"


def _load(spark: SparkSession, path: str, kind: str, ddl: str) -> DataFrame:
    if kind == "text":
        return spark.read.text(path)
    return spark.read.format(kind).schema(ddl).load(path)


def _listed(data: DataFrame, folder: str) -> DataFrame:
    """(file, bytes, rows) of the files that hold the rows of ``data``."""
    file = F.expr(f"split_part(_metadata.file_path, '/{folder}/', 2)")
    return data.select(file.alias("file"), F.col("_metadata.file_size").alias("bytes")).groupBy("file", "bytes").agg(F.count("*").alias("rows"))


def write_export(
    df: DataFrame, path: str, target: T.StructType | None = None, kind: str = "parquet", partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """Write and commit ``df`` in a declared schema (its own by default); the commit row is returned.

    ``kind`` is parquet, json (null fields are left out) or text (one string column).
    """
    spark, folder = df.sparkSession, f"data-{uuid.uuid4().hex}"
    typed = df if target is None else conform(df, target)
    ddl = typed.schema.toDDL()
    writer = typed.write.option("ignoreNullFields", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(f"{path}/{folder}")
    listed = f"{path}/files-{folder}"
    _listed(_load(spark, f"{path}/{folder}", kind, ddl), folder).write.parquet(listed)
    commit = spark.read.schema(FILES).parquet(listed).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    columns = F.array(*[F.lit(c) for c in typed.columns]).cast("array<string>").alias("columns")
    row = commit.select(F.lit(folder).alias("folder"), F.lit(kind).alias("kind"), columns, F.lit(ddl).alias("ddl"), "files", "rows", "bytes",
                        F.current_timestamp().alias("created_at"))
    row.coalesce(1).write.mode("overwrite").json(f"{path}/commit")
    return read_commit(spark, path)


def read_commit(spark: SparkSession, path: str) -> DataFrame:
    """The commit row of an export."""
    return spark.read.schema(COMMIT).json(f"{path}/commit")


def read_export(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The committed rows; with ``verify``, an error if the files do not hold what was committed."""
    commit = read_commit(spark, path).first()
    if commit is None:
        raise ValueError(f"no committed export in {path}")
    data = _load(spark, f"{path}/{commit['folder']}", commit["kind"], commit["ddl"])
    if verify:
        there = _listed(data, commit["folder"]).toDF("file", "found_bytes", "found_rows")
        wanted = spark.read.schema(FILES).parquet(f"{path}/files-{commit['folder']}")
        same = F.col("bytes").eqNullSafe(F.col("found_bytes")) & F.col("rows").eqNullSafe(F.col("found_rows"))
        wrong = [r["file"] for r in wanted.join(there, "file", "full").where(~same).orderBy("file").limit(5).collect()]
        if wrong:
            raise ValueError(f"export {path} differs from its file list: {', '.join(wrong)}")
    return data
