"""Shared staging folder: written tables that cut lineage and survive lost executors."""

from __future__ import annotations

import copy
import hashlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_WRITERS: dict[str, int | str] = {"open": 0, "before": "false"}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for local sessions that set none."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="coocatlas-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Each write inside removes its shuffle files when it ends, not when the driver next collects garbage.

    The session's own setting comes back with the last of the writers that run side by side.
    """
    with _LOCK:
        if not _WRITERS["open"]:
            _WRITERS["before"] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _WRITERS["open"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITERS["open"] -= 1
            if not _WRITERS["open"]:
                spark.conf.set(CLEANUP, _WRITERS["before"])


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that no table has yet."""
    return f"{shared_dir(spark).rstrip('/')}/coocatlas/{spark.sparkContext.applicationId}/written/{uuid.uuid4().hex}"


def written(*parts: DataFrame, path: str | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The rows written once to the shared folder as a table and read back; later steps read only the columns they use.

    Several parts are written one after the other, each one's shuffle files gone before the next.
    """
    spark = parts[0].sparkSession
    path = path or fresh_path(spark)
    for part in parts:
        with shuffles_dropped(spark):
            part.write.mode("append").partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Drop a table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Staging:
    """Parquet tables of one build, written on first use and read back afterwards."""

    def __init__(self, spark: SparkSession, label: str, fresh: bool = False):
        self.spark = spark
        app = spark.sparkContext.applicationId
        name = hashlib.sha1(label.encode()).hexdigest()[:12] + (f"-{uuid.uuid4().hex[:8]}" if fresh else "")
        self.root = f"{shared_dir(spark).rstrip('/')}/coocatlas/{app}/{name}"

    def under(self, *parts: str) -> Staging:
        """The same staging, apart for each value of ``parts``, such as the settings of a build."""
        other = copy.copy(self)
        other.root = f"{self.root}/{hashlib.sha1(chr(0).join(parts).encode()).hexdigest()[:12]}"
        return other

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def written(self, name: str) -> bool:
        """Whether this application has finished writing stage ``name``."""
        jvm = self.spark.sparkContext._jvm
        marker = jvm.org.apache.hadoop.fs.Path(self.path(name) + "/_SUCCESS")
        return marker.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Read stage ``name``, building and writing it first if this application has not yet."""
        if not self.written(name):
            frame = build()
            with shuffles_dropped(self.spark):
                frame.write.mode("overwrite").parquet(self.path(name))
            return self.spark.read.schema(frame.schema).parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def together(self, builds: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
        """Stage several tables that do not depend on each other, their jobs running side by side."""
        with ThreadPoolExecutor(max_workers=max(1, len(builds))) as pool:
            started = {name: pool.submit(self.table, name, build) for name, build in builds.items()}
            return {name: future.result() for name, future in started.items()}
