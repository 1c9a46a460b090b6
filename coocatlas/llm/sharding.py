"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Documents with equal texts form one group that is never split. A partial partition is a
tuple of shard loads; differencing repeatedly takes the two tuples with the largest spread
and adds them in opposite order. The groups are hashed into bounded buckets, each bucket is
differenced in its own task to one tuple, and the tuples of the buckets are differenced
again, bucket of buckets by bucket of buckets, until one is left. No task sees more than
``BUCKET`` groups or tuples.

Defined results: a null text is an empty one; repeated rows are equal texts and share a
shard; a group larger than an even share fills a shard mostly alone and the others stay
near equal; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coocatlas.llm.tables import staged

#: Bytes a document costs besides its text, most groups and most tuples a task differences.
OVERHEAD = 16
BUCKET = 20_000
FAN_IN = 256


def difference(loads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine rows of ``loads`` (tuples x shards) into one tuple by largest differencing.

    Returns the final loads in ascending order and, for each row and column, the final place
    of that load. Ties are broken by row number, so the result depends on the rows alone.
    """
    n, k = loads.shape
    order = np.argsort(loads, axis=1, kind="stable")
    tuples = {i: loads[i][order[i]] for i in range(n)}
    heap = [(-int(t[-1] - t[0]), i) for i, t in tuples.items()]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        joined = tuples.pop(a) + tuples.pop(b)[::-1]
        place = np.argsort(joined, kind="stable")
        new = n + len(made)
        made.append((a, b, place))
        tuples[new] = joined[place]
        heapq.heappush(heap, (-int(tuples[new][-1] - tuples[new][0]), new))
    root = heap[0][1]
    places: dict[int, np.ndarray] = {root: np.arange(k)}
    for step in range(len(made) - 1, -1, -1):
        a, b, place = made[step]
        rank = np.empty(k, np.int64)
        rank[place] = np.arange(k)
        to = places.pop(n + step)[rank]
        places[a], places[b] = to, to[::-1]
    slots = np.empty((n, k), np.int64)
    for i in range(n):
        slots[i, order[i]] = places[i]
    return tuples[root], slots


def _leaf(shards: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", "h1", "h2"], ignore_index=True)
        loads = np.zeros((len(group), shards), np.int64)
        loads[:, -1] = group["bytes"]
        total, slots = difference(loads)
        rows = pd.DataFrame({"node": group["node"], "h1": group["h1"], "h2": group["h2"], "slot": slots[:, -1], "load": -1})
        sums = pd.DataFrame({"node": group["node"][0], "h1": 0, "h2": 0, "slot": np.arange(shards), "load": total})
        return pd.concat([rows, sums], ignore_index=True)

    return run


def _inner(shards: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["node", "slot"], ignore_index=True)
        nodes = group["node"].to_numpy()[::shards]
        total, slots = difference(group["load"].to_numpy().reshape(-1, shards))
        rows = group[["parent", "node", "slot"]].assign(up=slots.ravel(), load=-1)
        sums = pd.DataFrame({"parent": group["parent"][0], "node": -1, "slot": np.arange(shards), "up": -1, "load": total})
        assert len(nodes) * shards == len(group)
        return pd.concat([rows, sums], ignore_index=True)

    return run


def balance(groups: DataFrame, shards: int) -> DataFrame:
    """Shard of each group. ``groups``: h1, h2 (the key), bytes. Returns h1, h2, shard."""
    n = groups.count()
    buckets = max(1, -(-n // BUCKET))
    keyed = groups.withColumn("node", F.pmod(F.xxhash64("h1", "h2"), F.lit(buckets)))
    leaves = staged(
        keyed.groupBy("node").applyInPandas(_leaf(shards), "node long, h1 long, h2 long, slot long, load long"), "leaves")
    placed = leaves.where("load = -1").select("h1", "h2", "node", "slot")
    level = leaves.where("load >= 0").select("node", "slot", "load")
    while buckets > 1:
        buckets = -(-buckets // FAN_IN)
        grouped = level.withColumn("parent", F.floor(F.col("node") / FAN_IN)).groupBy("parent")
        above = staged(
            grouped.applyInPandas(_inner(shards), "parent long, node long, slot long, up long, load long"), "inner")
        moves = above.where("load = -1").select("node", "slot", "parent", "up")
        placed = placed.join(moves, ["node", "slot"]).select(
            "h1", "h2", F.col("parent").alias("node"), F.col("up").alias("slot"))
        level = above.where("load >= 0").select(F.col("parent").alias("node"), "slot", "load")
    return placed.select("h1", "h2", F.col("slot").alias("shard"))


def shard_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row; slots count from 0 in each shard."""
    text = F.coalesce("text", F.lit(""))
    sized = staged(documents.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), F.reverse(text)).alias("h2"),
    ), "sized")
    groups = staged(sized.groupBy("h1", "h2").agg(F.sum("size").alias("bytes")), "groups")
    shard_of = staged(balance(groups, shards), "shards")
    rows = sized.join(shard_of, ["h1", "h2"]).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"))
    return _with_slots(staged(rows, "placed"))


def _with_slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0: places inside small blocks plus the counts of earlier blocks.

    A block is a shard's rows with one hash of doc_id, so no window holds a whole shard.
    """
    spread = max(1, rows.count() // 100_000)
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(spread)))
    sizes = blocks.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn(
        "first", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).drop("n")
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    numbered = blocks.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(before, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).cast("bigint").alias("slot"))
