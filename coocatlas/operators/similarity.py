"""Nearest neighbours by inner product: exact, inverted lists, and recall between the two.

Vectors travel as Arrow batches and are scored as matrix blocks. No pair of rows is
ever materialised: a block of queries meets a block of base vectors inside one task
and only the k best per query leave it.

An index is two tables: the lists, written partitioned by list so that a search reads only
the lists it visits, and beside them one row per list with its centroid, size, radius and
the longest and shortest vector in it. A base of unequal lengths is cut both by direction
and by length: a list then holds one band of lengths of one direction.

Scores are rounded to nine decimals before they are ordered. The last bits of a dot
product depend on how rows are blocked; after rounding, equal scores are ordered by id
and the result no longer depends on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coocatlas.functions.vectors import l2_normalize, norm
from coocatlas.operators.ids import exact_sample, split_off
from coocatlas.sources.staging import checkpoint

SCORE_DIGITS = 9
NEIGHBOURS = "query_id BIGINT, neighbor_id BIGINT, score DOUBLE"
CELLS = "list_id INT, centroid ARRAY<DOUBLE>, n DOUBLE, radius DOUBLE, longest DOUBLE, shortest DOUBLE"
SEED = 666
# Most lists of an index, and bands of length each direction is cut into if lengths differ.
MOST_LISTS = 16384
BANDS = 8
# A side of at most this many bytes of vectors is sent whole to every task.
BROADCAST_BYTES = 64 << 20
# Rows per side in one scored block, scores held at a time while scoring it, and queries whose results leave together.
BLOCK_ROWS = 20_000
BLOCK_CELLS = 1 << 20
QUERY_ROWS = 1024
# Rows per batch when a query is copied to the lists it visits.
COPY_ROWS = 10_000


def _stored(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Arrow list column as a two-dimensional array of its own precision, without a Python object per value."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The same in double precision."""
    return _stored(column).astype(np.float64, copy=False)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _best(qid: np.ndarray, q: np.ndarray, bid: np.ndarray, b: np.ndarray, k: int) -> pa.Table:
    """The k best base rows per query within one block, by rounded score and then id.

    Rounded score and position in id order are packed into one integer per cell, so a
    partial selection is enough and still breaks ties exactly.
    """
    by_id = np.argsort(bid, kind="stable")
    bid, b = bid[by_id], b[by_id]
    take = min(k, len(bid))
    step = max(1, BLOCK_CELLS // len(bid))
    ids, scores = [], []
    for start in range(0, len(qid), step):
        scaled = np.rint((q[start : start + step] @ b.T) * 10.0**SCORE_DIGITS).astype(np.int64)
        rank_key = -scaled * len(bid) + np.arange(len(bid))
        if take < len(bid):
            rank_key = np.partition(rank_key, take - 1, axis=1)[:, :take]
        rank_key.sort(axis=1)
        position = np.mod(rank_key, len(bid))
        ids.append(bid[position].ravel())
        scores.append(((position - rank_key) // len(bid)).ravel() / 10.0**SCORE_DIGITS)
    return pa.table(
        {
            "query_id": pa.array(np.repeat(qid, take), pa.int64()),
            "neighbor_id": pa.array(np.concatenate(ids), pa.int64()),
            "score": pa.array(np.concatenate(scores), pa.float64()),
        }
    )


def _tile_best(qid: np.ndarray, q: np.ndarray, bid: np.ndarray, b: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The same for a side of any length: QUERY_ROWS queries at a time, the base in tiles of BLOCK_ROWS.

    What a task holds beside the two sides, each in its own precision, depends on k only,
    not on the number of rows.
    """
    for start in range(0, len(qid), QUERY_ROWS):
        some, vectors, kept = qid[start : start + QUERY_ROWS], q[start : start + QUERY_ROWS].astype(np.float64), None
        for first in range(0, len(bid), BLOCK_ROWS):
            tile = b[first : first + BLOCK_ROWS].astype(np.float64)
            found = _best(some, vectors, bid[first : first + BLOCK_ROWS], tile, k)
            ids, scores = (found[name].to_numpy().reshape(len(some), -1) for name in ("neighbor_id", "score"))
            if kept is not None:
                ids, scores = np.hstack([kept[0], ids]), np.hstack([kept[1], scores])
                order = np.lexsort((ids, -scores))[:, :k]
                ids, scores = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)
            kept = ids, scores
        if kept is not None:
            values = [np.repeat(some, kept[0].shape[1]), kept[0].ravel(), kept[1].ravel()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[0], pa.int64()), pa.array(values[1], pa.int64()), pa.array(values[2], pa.float64())],
                names=["query_id", "neighbor_id", "score"])


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a score matrix of ``width`` columns stays small."""
    step = max(1, BLOCK_CELLS // max(width, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _copies(batch: pa.RecordBatch, rows: np.ndarray, lists: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(list_id, id, v) for the given rows of a batch, a row once per list, in small batches."""
    for start in range(0, len(rows), COPY_ROWS):
        part = pa.array(rows[start : start + COPY_ROWS])
        yield pa.RecordBatch.from_arrays(
            [pa.array(lists[start : start + COPY_ROWS], pa.int32()), batch["id"].take(part), batch["v"].take(part)],
            names=["list_id", "id", "v"],
        )


def merge_best(candidates: DataFrame, k: int) -> DataFrame:
    """k best of the per-block results, ranked from 1."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("neighbor_id"))
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _keyed(df: DataFrame, key: str) -> DataFrame:
    """(id, v); single-precision vectors stay so, everything else becomes double."""
    kind = df.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    return df.select(F.col(key).cast("bigint").alias("id"), vector.alias("v"))


def _with_list(vectors: DataFrame, extra: str = "") -> str:
    """Schema of ``vectors`` (id, v) behind a list number."""
    return f"list_id INT, {extra}id BIGINT, v {vectors.schema['v'].dataType.simpleString()}"


def _small_side(df: DataFrame, limit_bytes: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The whole side as arrays if its counted size fits the limit, otherwise None."""
    first = df.select(F.size("v").alias("d")).first()
    # the count alone needs no vectors; all vectors of a table have one length
    if first is not None and 8 * first["d"] * df.count() > limit_bytes:
        return None
    table = df.toArrow()
    return _ids(table["id"]), _stored(table["v"])


def exact_neighbours(
    queries: DataFrame, base: DataFrame, k: int, query_key: str, base_key: str, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(query_id, neighbor_id, score, rank): the exact k best base rows per query.

    If one side is small it is sent to the tasks that stream the other. If neither is,
    the base is cut into inverted lists, and lists of unequal lengths into bands, and each
    query visits the lists that could still hold one of its k best, which is exact without
    scoring every list. Every way ranks by the inner product of the vectors as given.
    """
    q, b = _keyed(queries, query_key), _keyed(base, base_key)
    spark = q.sparkSession
    small = _small_side(b, broadcast_bytes)
    if small is not None:
        held = spark.sparkContext.broadcast(small)

        def over_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bid, bv = held.value
            for batch in batches:
                if batch.num_rows and len(bid):
                    yield from _tile_best(_ids(batch["id"]), _stored(batch["v"]), bid, bv, k)

        return merge_best(q.mapInArrow(over_queries, NEIGHBOURS), k)
    small = _small_side(q, broadcast_bytes)
    if small is not None:
        held = spark.sparkContext.broadcast(small)

        def over_base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, qv = held.value
            for batch in batches:
                if batch.num_rows:
                    yield from _tile_best(qid, qv, _ids(batch["id"]), _stored(batch["v"]), k)

        return merge_best(b.mapInArrow(over_base, NEIGHBOURS), k)
    n = base.count()
    bands = 1 if _unit(b) else BANDS
    nlist = max(1, list_count_for(n) // bands)
    centroids = train_centroids(base, base_key, n, nlist, SEED, iterations=10)
    return search_exact(build_index(base, base_key, centroids, bands), queries, k, query_key)


def _unit(vectors: DataFrame) -> bool:
    """Whether all vectors have unit length, as float values can have it."""
    squared = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return vectors.agg(F.max(F.abs(squared - 1))).first()[0] < 1e-5


@dataclass(frozen=True)
class Index:
    """Inverted lists.

    ``lists`` has (list_id, id, v). Centroids (unit rows), sizes, radii (largest angle to the
    centroid) and the longest and shortest vector have one entry per list, at most 16384.
    """

    lists: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    longest: np.ndarray
    shortest: np.ndarray

    def bound(self, queries: np.ndarray) -> np.ndarray:
        """Per query and list, a value that no inner product with a vector of the list exceeds."""
        length = np.linalg.norm(queries, axis=1, keepdims=True)
        near = np.clip(queries @ self.centroids.T / np.maximum(length, 1e-300), -1.0, 1.0)
        cosine = np.cos(np.clip(np.arccos(near) - self.radii - 1e-7, 0.0, np.pi))
        return length * cosine * np.where(cosine > 0, self.longest, self.shortest)


def list_count_for(n: int) -> int:
    """Number of inverted lists for n vectors."""
    return int(min(max(4 * np.sqrt(n), 256), 16384))


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Scores as integers, so that equal ones are equal however a block was computed."""
    return np.rint(scores * 10.0**SCORE_DIGITS).astype(np.int64)


def train_centroids(vectors: DataFrame, key: str, n: int, nlist: int, seed: int, iterations: int) -> np.ndarray:
    """Unit centroids from a fixed-size sample; never more lists than sampled vectors.

    A vector of zeros has no direction and takes no part.
    """
    sample = exact_sample(l2_normalize(vectors), key, min(n, 64 * nlist), seed).select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    ).where(F.exists("embedding", lambda x: x != 0))
    found = sample.count()
    if not found:
        return np.ones((1, len(vectors.first()["embedding"])))
    model = KMeans(
        k=min(nlist, found), distanceMeasure="cosine", initMode="random", seed=seed, maxIter=iterations
    ).fit(sample)
    return np.array(model.clusterCenters(), dtype=np.float64)


def sampled_centroids(vectors: DataFrame, key: str, nlist: int, seed: int, portable: bool = False) -> np.ndarray:
    """``nlist`` of the vectors themselves, by a seeded draw and in key order: lists without any training."""
    sample = exact_sample(vectors, key, nlist, seed, portable).select(F.col(key).alias("id"), "embedding").toArrow()
    order = np.argsort(_ids(sample["id"]), kind="stable")
    return _matrix(sample["embedding"])[order]


def assign_lists(vectors: DataFrame, centroids: np.ndarray, bands: int = 1, longest: float = 1.0) -> DataFrame:
    """(list_id, angle, length, id, v): each (id, v) row with its nearest centroid and band. No shuffle.

    List c * bands + b holds the vectors nearest to centroid c whose length lies between
    2 ** (-(b + 1) / 2) and 2 ** (-b / 2) of the longest; the last band takes all shorter ones.
    """
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(held.value)):
            v = _matrix(batch["v"])
            length = np.linalg.norm(v, axis=1)
            scores = v @ held.value.T
            best = _rounded(scores).argmax(axis=1)
            cosine = scores[np.arange(len(best)), best] / np.maximum(length, 1e-300)
            band = np.floor(2 * np.log2(longest / np.maximum(length, 1e-300)))
            lists = best * bands + np.clip(band, 0, bands - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists, pa.int32()), pa.array(np.arccos(np.clip(cosine, -1.0, 1.0))), pa.array(length), batch["id"], batch["v"]],
                names=["list_id", "angle", "length", "id", "v"],
            )

    return vectors.mapInArrow(nearest, _with_list(vectors, "angle DOUBLE, length DOUBLE, "))


def _written(frame: DataFrame, path: str, stats: list) -> DataFrame:
    """The lists in one folder per list; the blocks of a large list are dealt to several tasks and files."""
    spark = frame.sparkSession
    blocks = spark.createDataFrame([(r["list_id"], -(-r["n"] // BLOCK_ROWS)) for r in stats], "list_id INT, blocks INT")
    dealt = frame.join(F.broadcast(blocks), "list_id").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    dealt.repartition("list_id", "block").drop("blocks", "block").write.mode("overwrite").partitionBy("list_id").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def build_index(
    vectors: DataFrame, key: str, centroids: np.ndarray, bands: int = 1, path: str | None = None
) -> Index:
    """Assign every vector to a list of the given centroids and write the lists.

    The lists are written (under ``path``, or as a checkpoint) because every search reads
    them; per-list statistics are the only part that reaches the driver.
    """
    keyed = _keyed(vectors, key)
    if bands * len(centroids) > MOST_LISTS:
        raise ValueError(f"at most {MOST_LISTS} lists")
    centroids = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-300)
    top = keyed.agg(F.max(norm(F.col("v")))).first()[0] if bands > 1 else 1.0
    if top is None:
        raise ValueError("cannot index an empty table")
    assigned = checkpoint(assign_lists(keyed, centroids, bands, top))
    stats = assigned.groupBy("list_id").agg(
        F.count("*").alias("n"), F.max("angle").alias("r"), F.max("length").alias("high"), F.min("length").alias("low")).collect()
    if not stats:
        raise ValueError("cannot index an empty table")
    cells = np.zeros((4, bands * len(centroids)))
    for row in stats:
        cells[:, row["list_id"]] = row["n"], row["r"], row["high"], row["low"]
    lists = assigned.select("list_id", "id", "v")
    centroids = np.repeat(centroids, bands, axis=0)
    if path is not None:
        lists = _written(lists, f"{path}/lists", stats)
        rows = [(i, centroid.tolist(), *map(float, cell)) for i, (centroid, cell) in enumerate(zip(centroids, cells.T, strict=True))]
        # written last: an index is complete once this table is
        lists.sparkSession.createDataFrame(rows, CELLS).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return Index(lists, centroids, cells[0].astype(np.int64), *cells[1:])


def empty_index(like: DataFrame, key: str) -> Index:
    """Index without any list, in which every search finds nothing; ``like`` gives the vectors' length."""
    keyed, first = _keyed(like, key), like.select("embedding").first()
    none = np.zeros(0)
    lists = keyed.limit(0).select(F.lit(0).alias("list_id"), "id", "v")
    return Index(lists, np.zeros((0, len(first["embedding"]) if first else 1)), none.astype(np.int64), none, none, none)


def open_index(spark: SparkSession, path: str) -> Index:
    """A written index; only its one row per list is read here."""
    cells = spark.read.parquet(f"{path}/cells").toArrow().sort_by("list_id")
    lists = spark.read.parquet(f"{path}/lists").select("list_id", "id", "v")
    values = [cells[name].to_numpy() for name in ("n", "radius", "longest", "shortest")]
    return Index(lists, _matrix(cells["centroid"]), values[0].astype(np.int64), *values[1:])


def train_index(
    vectors: DataFrame, key: str, nlist: int | None = None, seed: int = SEED, iterations: int = 10, path: str | None = None
) -> Index:
    """Index of the unit vectors, its centroids trained on a sample."""
    n = vectors.count()
    if n == 0:
        raise ValueError("cannot index an empty table")
    centroids = train_centroids(vectors, key, n, nlist or list_count_for(n), seed, iterations)
    return build_index(l2_normalize(vectors), key, centroids, path=path)


def _visit(index: Index, probes: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Local best of every (query, list) visit in ``probes`` (list_id, id, v).

    A list larger than a block is split by id, and so are the queries visiting it, so
    that a list holding a large share of all vectors is spread over many tasks.
    """
    spark = probes.sparkSession
    visits = visit_counts(probes)
    plan = [
        (int(i), int(-(-index.sizes[i] // block_rows)), int(-(-visits.get(int(i), 0) // block_rows)))
        for i in range(len(index.sizes))
        if index.sizes[i] and visits.get(int(i), 0)
    ]
    if not plan:
        return spark.createDataFrame([], NEIGHBOURS)
    blocks = F.broadcast(spark.createDataFrame(plan, "list_id INT, base_blocks INT, query_blocks INT"))
    own = F.pmod(F.xxhash64("id"), F.col("own_blocks")).cast("int")

    def cut(df: DataFrame, mine: str, other: str) -> DataFrame:
        """Place a row in its own block and copy it to every block of the other side."""
        return (
            df.join(blocks, "list_id")
            .withColumn("own_blocks", F.col(mine))
            .withColumn(f"{mine}_id", own)
            .withColumn(f"{other}_id", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .select("list_id", "base_blocks_id", "query_blocks_id", "id", "v")
        )

    keys = ["list_id", "base_blocks_id", "query_blocks_id"]

    def score(q: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("neighbor_id", pa.int64()), ("score", pa.float64())])
        if not (q.num_rows and b.num_rows):
            return schema.empty_table()
        return pa.Table.from_batches(list(_tile_best(_ids(q["id"]), _stored(q["v"]), _ids(b["id"]), _stored(b["v"]), k)), schema)

    asked = cut(probes, "query_blocks", "base_blocks").groupBy(*keys)
    # a condition on the lists' own column, so that the other lists' files are not read
    kept = index.lists.where(F.col("list_id").isin([i for i, _, _ in plan]))
    held = cut(kept, "base_blocks", "query_blocks").groupBy(*keys)
    return asked.cogroup(held).applyInArrow(score, NEIGHBOURS)


def visit_counts(probes: DataFrame) -> dict[int, int]:
    """Visits per list; one row per list reaches the driver."""
    return {r["list_id"]: r["n"] for r in probes.groupBy("list_id").agg(F.count("*").alias("n")).collect()}


def probe(index: Index, queries: DataFrame, nprobe: int) -> DataFrame:
    """(list_id, id, v): each (id, v) query with its ``nprobe`` nearest lists. No shuffle."""
    held = queries.sparkSession.sparkContext.broadcast(index.centroids)
    count = min(nprobe, len(index.centroids))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(held.value)):
            scores = _rounded(_matrix(batch["v"]) @ held.value.T)
            lists = np.argsort(-scores, axis=1, kind="stable")[:, :count]
            yield from _copies(batch, np.repeat(np.arange(batch.num_rows), count), lists.ravel())

    return queries.mapInArrow(nearest, _with_list(queries))


def search(index: Index, queries: DataFrame, k: int, query_key: str, nprobe: int = 1) -> DataFrame:
    """Approximate k best per query, from the ``nprobe`` lists nearest to it."""
    probes = probe(index, _keyed(l2_normalize(queries), query_key), nprobe)
    return merge_best(_visit(index, probes, k), k)


def _first(bound: np.ndarray, sizes: np.ndarray, k: int, nprobe: int) -> np.ndarray:
    """Per query, the most promising lists: at least ``nprobe``, and enough of them to hold 2 k vectors."""
    order = np.argsort(-np.where(sizes > 0, bound, -np.inf), axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    taken = (before < 2 * k) | (np.arange(bound.shape[1]) < nprobe)
    out = np.zeros(bound.shape, bool)
    np.put_along_axis(out, order, taken, axis=1)
    return out & (sizes > 0)


def first_visits(index: Index, asked: DataFrame, k: int, nprobe: int) -> DataFrame:
    """(list_id, id, v): the lists that set each query's floor."""
    held = asked.sparkSession.sparkContext.broadcast(replace(index, lists=None))

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = held.value
        for batch in _slices(batches, len(cells.sizes)):
            taken = _first(cells.bound(_matrix(batch["v"])), cells.sizes, k, nprobe)
            yield from _copies(batch, *np.nonzero(taken))

    return asked.mapInArrow(promising, _with_list(asked))


def open_visits(index: Index, asked: DataFrame, first: DataFrame, k: int, nprobe: int) -> DataFrame:
    """(list_id, id, v): the other lists that may hold one of a query's k best, by the floor its first visits set."""
    floors = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("found"))
    known = asked.join(floors, F.col("id") == F.col("query_id"), "left").select(
        "id", "v", F.when(F.col("found") >= k, F.col("floor")).alias("floor")
    )
    held = asked.sparkSession.sparkContext.broadcast(replace(index, lists=None))

    def remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = held.value
        for batch in _slices(batches, len(cells.sizes)):
            bound = cells.bound(_matrix(batch["v"]))
            floor = batch["floor"].to_numpy(zero_copy_only=False).astype(np.float64)
            floor = np.where(np.isnan(floor), -np.inf, floor)[:, None]
            slack = 1e-6 * np.maximum(np.abs(bound), 1.0)
            open_ = (bound >= floor - slack) & (cells.sizes > 0) & ~_first(bound, cells.sizes, k, nprobe)
            yield from _copies(batch, *np.nonzero(open_))

    return known.mapInArrow(remaining, _with_list(asked))


def search_exact(index: Index, queries: DataFrame, k: int, query_key: str, nprobe: int = 4) -> DataFrame:
    """Exact k best per query, visiting only lists that may hold one of them.

    The k-th score from the most promising lists is a floor. Another list can beat it only if
    its longest vector, turned towards the query as far as the list's radius allows, does;
    all such lists are visited.
    """
    asked = _keyed(queries, query_key)
    first = checkpoint(merge_best(_visit(index, first_visits(index, asked, k, nprobe), k), k))
    more = open_visits(index, asked, first, k, nprobe)
    return merge_best(first.drop("rank").unionByName(_visit(index, more, k)), k)


def recall(found: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row: first-hit agreement, overlap at 10 and 100, and the share of unfilled places."""
    both = truth.select("query_id", "neighbor_id", F.col("rank").alias("true_rank")).join(
        found.select("query_id", "neighbor_id", "rank"), ["query_id", "neighbor_id"]
    )

    def within(n: int):
        return F.count_if((F.col("rank") <= n) & (F.col("true_rank") <= n))

    hits = both.agg(within(1).alias("h1"), within(10).alias("h10"), within(100).alias("h100"))
    filled = found.agg(F.count("*").alias("filled"))
    total = queries.agg(F.count("*").cast("double").alias("nq"))
    joined = hits.crossJoin(filled).crossJoin(total)
    return joined.select(
        (F.col("h1") / F.col("nq")).alias("r1"),
        (F.col("h10") / (F.col("nq") * min(k, 10))).alias("r10"),
        (F.col("h100") / (F.col("nq") * min(k, 100))).alias("r100"),
        (1 - F.col("filled") / (F.col("nq") * k)).alias("missing"),
    )


def recall_by_nprobe(
    vectors: DataFrame, key: str, n_query: int, k: int, nprobes: tuple[int, ...] = (1, 4, 16, 64, 256), seed: int = SEED,
    nlist: int | None = None, trained: bool = True, portable: bool = False,
) -> DataFrame:
    """Recall of the inverted lists against exact search, one row per nprobe."""
    unit = l2_normalize(vectors)
    queries, base = split_off(unit, key, n_query, seed, portable)
    truth = checkpoint(exact_neighbours(queries, base, k, key, key))
    if trained:
        index = train_index(base, key, nlist, seed)
    else:
        index = build_index(base, key, sampled_centroids(base, key, nlist or list_count_for(base.count()), seed, portable))
    rows = [
        recall(search(index, queries, k, key, n), truth, queries, k).select(F.lit(n).alias("nprobe"), "*") for n in nprobes
    ]
    return reduce(DataFrame.unionByName, rows)
