"""Dense ids, dictionaries, exact selections and seeded orders, without a global sort in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coocatlas.functions.hashing import uniform
from coocatlas.sources.staging import written

# Above this many rows a selection is ranked across partitions instead of merged in one task.
MERGED_LIMIT = 10_000


def per_key(df: DataFrame) -> DataFrame:
    """A table with one row per key, marked for a join with another such table: they are merged.

    Both grow with the keys, so neither is sent whole through the driver to all tasks. Spark
    would send it up to a size that it takes from the compressed files, of which there are many.
    """
    return df.hint("merge")


def dense_index(df: DataFrame, *order: Column | str, name: str = "idx", start: int = 0) -> DataFrame:
    """Number rows start, start+1, ... in the given order, which must have no ties.

    Rows are range-partitioned and sorted once and written, so that the
    numbering inside each partition is fixed; the only thing that reaches the driver
    is one row count per partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = written(ranged.withColumn("_local", F.monotonically_increasing_id()))
    partition = F.shiftright("_local", 33).cast("int")
    counts = {r["p"]: r["n"] for r in local.groupBy(partition.alias("p")).agg(F.count("*").alias("n")).collect()}
    sizes = [counts.get(p, 0) for p in range(max(counts, default=0) + 1)]
    offsets = F.lit(list(accumulate(sizes[:-1], initial=start))).cast("array<bigint>")
    within = F.col("_local").bitwiseAND(F.lit((1 << 33) - 1))
    return local.withColumn(name, F.element_at(offsets, partition + 1) + within).drop("_local")


def dictionary(df: DataFrame, column: str, name: str, start: int = 1) -> DataFrame:
    """(value, id) for the distinct non-empty values in code-point order."""
    values = df.where(F.col(column).isNotNull() & (F.col(column) != "")).select(column).distinct()
    return dense_index(values, column, name=name, start=start).withColumn(name, F.col(name).cast("int"))


def take_first(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows in an order without ties."""
    if n <= MERGED_LIMIT:
        return df.orderBy(*order).limit(n)
    return dense_index(df, *order, name="_rank").where(F.col("_rank") < n).drop("_rank")


def exact_sample(df: DataFrame, key: str, n: int, seed: int, portable: bool = False) -> DataFrame:
    """Exactly min(n, rows) rows without replacement, the same ones however the data are laid out.

    Only (draw, key) pairs are ordered; the rows themselves come back by a semi join.
    """
    drawn = df.select(key, uniform(seed, key, portable=portable).alias("_draw"))
    chosen = take_first(drawn, n, "_draw", key).select(key)
    return df.join(chosen, key, "left_semi")


def split_off(df: DataFrame, key: str, n: int, seed: int, portable: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sample of n rows, and the rest."""
    sample = exact_sample(df, key, n, seed, portable)
    return sample, df.join(sample.select(key), key, "left_anti")


def split_chunks(chunks: DataFrame, valid_fraction: float, seed: int, portable: bool = False) -> DataFrame:
    """Mark whole chunks as held out: max(1, floor(n * fraction)) of them, none for fraction 0."""
    ids = chunks.select("chunk_id").distinct()
    if valid_fraction <= 0:
        return ids.withColumn("is_valid", F.lit(False))
    ranked = dense_index(
        ids.withColumn("_draw", uniform(seed, "chunk_id", portable=portable)), "_draw", "chunk_id", name="_rank"
    )
    total = ranked.agg(F.count("*").alias("_n"))
    held_out = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(valid_fraction)))
    return ranked.crossJoin(F.broadcast(total)).select(
        "chunk_id", (F.col("_rank") >= F.col("_n") - held_out).alias("is_valid")
    )


def seeded_shuffle(df: DataFrame, seed: int, epoch: int, *keys: str) -> DataFrame:
    """Rows in a reproducible pseudo-random order inside evenly filled partitions."""
    draw = uniform(seed, F.lit(epoch), *keys)
    return df.withColumn("_draw", draw).repartitionByRange("_draw").sortWithinPartitions("_draw").drop("_draw")
