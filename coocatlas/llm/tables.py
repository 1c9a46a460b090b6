"""Reading, staging and row helpers the operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coocatlas.sources.staging import shared_dir

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` written once to the folder all executors share and read back.

    The written table cuts the lineage, survives lost executors, and is what later
    steps read instead of computing ``frame`` again.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/coocatlas-llm/{label}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def free_name(stem: str, taken: Iterable[str]) -> str:
    """``stem``, or ``stem`` with underscores, so that it clashes with no name in ``taken`` (case ignored)."""
    used = {name.lower() for name in taken}
    while stem.lower() in used:
        stem += "_"
    return stem


def narrow(frame: DataFrame, *columns: str) -> DataFrame:
    """Only ``columns``, picked by exact name so that extra columns never clash."""
    return frame.select(*[F.col(f"`{c}`") for c in columns])


def single_threaded() -> None:
    """Keep the native libraries of a task on the task's own core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
