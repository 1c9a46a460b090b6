"""Numbering and running sums inside groups of any size, without a group ever meeting in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from coocatlas.llm.tables import staged

#: Rows of one group that a window handles at once.
CHUNK = 4096
#: A key with more rows may be hot, and at most so many keys are.
HOT, HOT_KEYS = 512, 100_000


def numbered(frame: DataFrame, groups: Sequence[str], *order: str, name: str = "nth") -> DataFrame:
    """``frame`` with ``name``: 0, 1, ... inside each group in the given order; nulls come first.

    Rows are range-partitioned on the group, the order and last on a row number, so that
    neither a hot group nor many equal rows share a task. Each partition numbers its rows
    and the result is written, which fixes the numbering. Only a group that fills the first
    row of a partition can have begun before it: there are at most as many of these as
    partitions, and what they are shifted by is broadcast. ``groups`` must not hold nulls.
    """
    tie, part = "_tie", "_part"
    keys = [*groups, *order, tie]
    ranged = frame.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = ranged.drop(tie)
    schema = StructType([*ranged.schema, StructField(name, LongType()), StructField(part, IntegerType()),
                         StructField("_top", IntegerType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, seen, top = TaskContext.get().partitionId(), None, 0, 1
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(g) for g in groups]
            new = np.zeros(batch.num_rows, bool)
            for column in columns:
                new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            at = np.arange(batch.num_rows)
            nth = at - np.maximum.accumulate(np.where(new, at, 0))
            if last == [c[0].as_py() for c in columns]:
                nth[:int(new.argmax()) if new.any() else None] += seen
            last, seen = [c[-1].as_py() for c in columns], int(nth[-1]) + 1
            tops = np.zeros(batch.num_rows, np.int32)
            tops[0], top = top, 0
            added = [pa.array(nth, pa.int64()), pa.array(np.full(batch.num_rows, here, np.int32)), pa.array(tops)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    rows = staged(ranged.mapInArrow(number, schema), "numbered")
    open_groups = rows.where("_top = 1").select(*groups).distinct()
    counts = rows.join(F.broadcast(open_groups), list(groups)).groupBy(*groups, part).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*groups, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    joined = rows.join(F.broadcast(shifts.where("_shift > 0")), [*groups, part], "left")
    return joined.withColumn(name, F.col(name) + F.coalesce("_shift", F.lit(0))).select(*frame.columns, name)


def running(frame: DataFrame, group: str, nth: str, values: dict[str, Column]) -> DataFrame:
    """``frame`` with, per name in ``values``, the sum of that value over rows 0 to ``nth`` of the group.

    Windows cover CHUNK rows; the sums of earlier chunks, one row per chunk, are added.
    """
    raw = {name: f"_v_{name}" for name in values}
    rows = frame.withColumns({raw[name]: value for name, value in values.items()}).withColumn(
        "_chunk", F.floor(F.col(nth) / CHUNK))
    within = Window.partitionBy(group, "_chunk").orderBy(nth).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({name: F.sum(raw[name]).over(within) for name in values})
    last = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    long = frame.where(F.col(nth) % CHUNK == 0).where(F.col(nth) > 0).select(group).distinct()
    totals = rows.join(long, group, "left_semi").groupBy(group, "_chunk").agg(
        *[F.sum(raw[name]).alias(f"_t_{name}") for name in values])
    earlier = totals.select(
        group, "_chunk", *[F.coalesce(F.sum(f"_t_{name}").over(last), F.lit(0)).alias(f"_e_{name}") for name in values])
    rows = rows.join(earlier, [group, "_chunk"], "left")
    rows = rows.withColumns({name: F.col(name) + F.coalesce(f"_e_{name}", F.lit(0)) for name in values})
    return rows.drop("_chunk", *raw.values(), *[f"_e_{name}" for name in values])


def lookup(frame: DataFrame, keys: Sequence[str], table: DataFrame, how: str = "inner") -> DataFrame:
    """``frame`` with the columns of ``table``, which has at most one row per key; any key may hold most of ``frame``.

    Keys that hold more than HOT rows, and more than one in HOT_KEYS of all rows, are counted
    first: there are fewer than HOT_KEYS of them. Their rows of ``table`` are broadcast; all
    other rows meet theirs by a shuffle in which no key is large. ``frame`` is read three times.
    Keys must not be null.
    """
    mark = "_hot"
    counts = frame.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).head()[0] or 0
    hot = counts.where(F.col("_n") > max(HOT, total // HOT_KEYS)).drop("_n").withColumn(mark, F.lit(True))
    if hot.isEmpty():
        return frame.join(table, list(keys), how)
    marked = frame.join(F.broadcast(hot), list(keys), "left")
    warm = marked.where(F.col(mark).isNotNull()).drop(mark)
    cold = marked.where(F.col(mark).isNull()).drop(mark)
    few = table.join(F.broadcast(hot.drop(mark)), list(keys), "left_semi")
    return warm.join(F.broadcast(few), list(keys), how).unionByName(cold.join(table, list(keys), how))
