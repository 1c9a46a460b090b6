"""Near-duplicate groups by HyperMinHash.

1. Every document's distinct 5-word shingles are hashed. A digest of the set joins exact
   copies into one class, so only classes go on.
2. A class keeps one register per bucket (one hash function each): the leading-zero count
   and the top mantissa bits of the smallest hash, 16 bits in all.
3. Rows of registers are banded. With 3 registers in each of 32 bands, a pair at similarity
   0.75 shares no band with probability 2.5e-8.
4. Shingles held by one candidate class only bound the overlap of any pair from above. The
   bound is exact and removes the pairs that a shared passage alone brings together.
5. Each bucket's members are first paired with its most central one (a star). A second
   round pairs only members that are still in different components and that exact bounds
   on their common shingles allow, so a group of n near copies costs about n pairs and no
   link between different components is lost.
6. Pairs pass a collision-corrected similarity estimate 5 deviations below the threshold,
   and are then confirmed on their full shingle sets.
7. Components are found by label propagation with pointer jumping over staged tables.

Defined results: null, empty and blank texts have no shingles and stay alone; a text of
fewer than five words is one shingle; repeated rows are copies; null doc_ids take part but
never name a component that has another id; an empty table gives no rows; extra columns
are ignored by ``components`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from coocatlas.llm.ordering import lookup
from coocatlas.llm.tables import free_name, staged
from coocatlas.llm.words import mix, slices, windows, words

SHINGLE = 5
#: Linked where LINK[0] * intersection >= LINK[1] * union.
LINK = (100, 75)
BANDS, ROWS = 32, 3
REGISTERS = BANDS * ROWS
MANTISSA = 11
#: A shingle that at most so many open members hold is rare (see _across).
RARE = 64

_MULTIPLIERS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_SHIFTS = mix(np.arange(1001, REGISTERS + 1001, dtype=np.uint64)).astype(np.uint32)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Document number and hash of every distinct shingle, ordered by both; and the number of texts."""
    found = words(texts)
    first, hashes = windows(found, SHINGLE)
    doc = found.doc[first]
    bounds = found.bounds
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            more = counts[short] > k
            at = np.minimum(bounds[short] + k, len(found.hash) - 1)
            total += np.where(more, mix(found.hash[at] + np.uint64(k + 1)), np.uint64(0))
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, mix(total + counts[short].astype(np.uint64))])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new], found.n_docs


def registers(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Compressed registers (sets x REGISTERS) of the sets that begin at ``begins``."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begins), REGISTERS), np.uint16)
    for k in range(REGISTERS):
        least = np.minimum.reduceat(low * _MULTIPLIERS[k] + _SHIFTS[k], begins)
        out[:, k] = compress(least)
    return out


def compress(values: np.ndarray) -> np.ndarray:
    """Leading-zero count (5 bits) over the mantissa's top bits (11), read off the float's own exponent and mantissa."""
    bits = (values.astype(np.float64) + 1.0).view(np.uint64)
    exponent = np.minimum((bits >> np.uint64(52)) - np.uint64(1023), np.uint64(31))
    mantissa = (bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return (((np.uint64(31) - exponent) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Similarity from equal registers, less those equal by chance.

    Two independent minima of sets of n and m meet in one cell with probability about
    0.72 * 2**-MANTISSA * n * m / (n + m)**2: a cell is about that fraction of its value wide.
    """
    equal = (a == b).mean(axis=1)
    n, m = size_a.astype(float), size_b.astype(float)
    chance = 0.72 * 2.0 ** -MANTISSA * n * m / (n + m) ** 2
    return (equal - chance) / (1 - chance)


def _floor() -> float:
    threshold = LINK[1] / LINK[0]
    return threshold - 5 * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def digests(doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set size and two 64-bit digests of each document's set."""
    size = np.bincount(doc, minlength=n_docs)
    out = []
    for salt in (0x51ED270B, 0x2545F491):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(salt)))])
        ends = np.cumsum(size)
        out.append((sums[ends] - sums[ends - size]).view(np.int64))
    return size, out[0], out[1]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        doc, hashes, n_docs = shingle_sets(batch.column("text"))
        size, d1, d2 = digests(doc, hashes, n_docs)
        full = np.flatnonzero(size)
        packed = [None] * n_docs
        if len(full):
            table = registers(hashes, (np.cumsum(size) - size)[full])
            for d, row in zip(full.tolist(), table, strict=True):
                packed[d] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size), pa.array(d1), pa.array(d2), pa.array(packed, pa.binary())],
            names=["doc_id", "n", "d1", "d2", "registers"])


def sketch(documents: DataFrame) -> DataFrame:
    """doc_id, n (set size), d1 and d2 (digest of the set), registers (null for an empty set)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        _sketch, f"doc_id {kind}, n long, d1 long, d2 long, registers binary")


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        table = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
        key = np.zeros(table.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(ROWS):
            key = mix(key + table[:, :, r].astype(np.uint64))
        cid = np.repeat(batch.column("cid").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(cid)], names=["key", "cid"])


def _own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the wanted digest (another text may carry the same doc_id)."""
    for batch in slices(batches, "text"):
        _, d1, d2 = digests(*shingle_sets(batch.column("text")))
        same = (d1 == batch.column("d1").to_numpy()) & (d2 == batch.column("d2").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("text")], names=["cid", "text"]).filter(pa.array(same))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        doc, hashes, _ = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(batch.column("cid").to_numpy()[doc]), pa.array(hashes.view(np.int64))], names=["cid", "shingle"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
        good = estimate(a, b, batch.column("na").to_numpy(), batch.column("nb").to_numpy()) >= _floor()
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: OrderedDict[int, np.ndarray] = OrderedDict()

    def of(cid: int, text: str) -> np.ndarray:
        if cid not in held:
            if len(held) >= 64:
                held.popitem(last=False)
            held[cid] = shingle_sets(pa.array([text], pa.large_string()))[1]
        return held[cid]

    for batch in slices(batches, "tb"):
        good = []
        for a, b, ta, tb in zip(*(batch.column(c) for c in ("a", "b", "ta", "tb")), strict=True):
            x, y = of(a.as_py(), ta.as_py()), of(b.as_py(), tb.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(LINK[0] * both >= LINK[1] * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _possible(na: Column, ra: Column, nb: Column, rb: Column) -> Column:
    """False where not even all shared shingles (size less own ones) would link the two."""
    most = F.least(na - ra, nb - rb)
    return LINK[0] * most >= LINK[1] * (na + nb - most)


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, label: str) -> DataFrame:
    """The pairs (a, b) that are linked, estimated first and confirmed on full sets."""
    side = classes.select("cid", "n", "registers")
    # the centre of a large star is in all its pairs
    joined = lookup(staged(lookup(pairs, ["a"], side.toDF("a", "na", "ra")), f"{label}-left"), ["b"], side.toDF("b", "nb", "rb"))
    likely = staged(joined.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimated, "a long, b long"), f"{label}-likely")
    texted = likely.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
    return staged(texted.select("a", "b", "ta", "tb").mapInArrow(_confirmed, "a long, b long"), f"{label}-links")


def connected(links: DataFrame) -> DataFrame:
    """node, label (smallest node it reaches) for every node of ``links`` (a, b)."""
    edges = staged(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = staged(edges.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        # a node may have most edges and a label most nodes
        around = lookup(edges, ["b"], labels.toDF("b", "near")).groupBy("a").agg(F.min("near").alias("near"))
        nearer = labels.join(around.toDF("node", "near"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        nearer = staged(nearer, "nearer")
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = staged(lookup(nearer, ["label"], jump).select("node", "old", F.least("label", "further").alias("label")), "moved")
        labels = moved.select("node", "label")
        if not moved.where("label <> old").limit(1).count():
            return labels


def _across(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of bucket members in different components that could be linked; members: key, cid, n, label.

    A shingle is rare if at most RARE of the members hold it. A pair that shares no rare
    shingle has at most its other shingles in common, and only pairs for which these suffice
    come from the buckets. A pair that shares s rare shingles is met on each of them, by
    lists of at most RARE members, and at most s more are in common. Both bounds are exact.
    """
    nodes = members.select("cid", "n", "label").distinct()
    held = staged(texts.join(nodes.select("cid"), "cid").mapInArrow(_shingles, "cid long, shingle long"), "held")
    few = held.groupBy("shingle").agg(F.count("*").alias("k")).where(F.col("k") <= RARE)
    rare = staged(held.join(few, "shingle"), "rare")
    own = rare.groupBy("cid").agg(F.count("*").alias("q"))
    sized = nodes.join(own, "cid", "left").select("cid", "n", F.coalesce("q", F.lit(0)).alias("q"), "label")
    sized = staged(sized, "sized")

    placed = members.select("key", "cid").join(sized, "cid").where(LINK[0] * (F.col("n") - F.col("q")) >= LINK[1] * F.col("n"))
    left, right = (placed.toDF(*(f"{c}_{side}" if c != "key" else c for c in placed.columns)) for side in "ab")
    apart = F.col("label_a") < F.col("label_b")
    ordered = F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")
    common = left.join(right, "key").where(
        apart & _possible(F.col("n_a"), F.col("q_a"), F.col("n_b"), F.col("q_b"))).select(*ordered)

    listed = rare.where("k > 1").select("shingle", "cid").join(sized, "cid")
    left, right = (listed.toDF(*(f"{c}_{side}" if c != "shingle" else c for c in listed.columns)) for side in "ab")
    met = left.join(right, "shingle").where(apart).groupBy(
        *ordered, F.least(F.col("n_a") - F.col("q_a"), F.col("n_b") - F.col("q_b")).alias("rest"),
        (F.col("n_a") + F.col("n_b")).alias("both")).agg(F.count("*").alias("s"))
    most = F.col("rest") + F.col("s")
    return common.union(met.where(LINK[0] * most >= LINK[1] * (F.col("both") - most)).select("a", "b")).distinct()


def _class_components(classes: DataFrame, documents: DataFrame) -> DataFrame:
    """cid, label for the classes linked with another class."""
    bands = staged(classes.select("cid", "registers").mapInArrow(_band, "key long, cid long"), "bands")
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = staged(bands.join(shared, "key").select("key", "cid"), "members")
    candidates = members.select("cid").distinct().join(classes.select("cid", "rep", "d1", "d2"), "cid")
    own = documents.select(F.col("doc_id").alias("rep"), "text")
    found = own.join(candidates.withColumnRenamed("rep", "wanted"), F.col("rep").eqNullSafe(F.col("wanted")))
    texts = found.select("cid", "text", "d1", "d2").mapInArrow(_own_text, "cid long, text string")
    texts = staged(texts.dropDuplicates(["cid"]), "texts")
    single = texts.mapInArrow(_shingles, "cid long, shingle long").groupBy("shingle").agg(
        F.count("*").alias("k"), F.min("cid").alias("cid")).where("k = 1")
    alone = single.groupBy("cid").agg(F.count("*").alias("r"))
    sizes = classes.select("cid", "n").join(alone, "cid", "left").select("cid", "n", F.coalesce("r", F.lit(0)).alias("r"))
    able = sizes.where(LINK[0] * (F.col("n") - F.col("r")) >= LINK[1] * F.col("n"))
    members = staged(members.join(able, "cid"), "able")

    centre = members.groupBy("key").agg(
        F.min(F.struct(F.col("r") / F.col("n"), "cid", "n", "r")).alias("c"), F.count("*").alias("size")).where("size > 1")
    near = members.join(centre, "key").where((F.col("cid") != F.col("c.cid")) & _possible(
        F.col("n"), F.col("r"), F.col("c.n"), F.col("c.r")))
    stars = staged(near.select(
        F.least("cid", "c.cid").alias("a"), F.greatest("cid", "c.cid").alias("b")).distinct(), "stars")
    first = _links(stars, classes, texts, "star")
    labels = connected(first)

    placed = members.join(labels.toDF("cid", "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    placed = staged(placed, "labelled")
    open_ = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    rest = staged(placed.join(open_, "key").select("key", "cid", "n", "label"), "open")
    pairs = _across(rest, texts)
    pairs = staged(pairs.join(stars, ["a", "b"], "left_anti"), "across")
    second = _links(pairs, classes, texts, "across")
    return connected(first.union(second))


def classified(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketches of all documents, and per class of equal sets: d1, d2 and its component's label and smallest doc_id."""
    sketches = staged(sketch(documents), "sketches")
    classes = sketches.where("n > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    labels = _class_components(classes, documents)
    labelled = classes.join(labels.toDF("cid", "label"), "cid", "left").select(
        "d1", "d2", "rep", F.coalesce("label", "cid").alias("label"))
    labelled = staged(labelled, "labelled-classes")
    least = labelled.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "d1", "d2")).alias("least"))
    return sketches, staged(lookup(labelled, ["label"], least).select("d1", "d2", "label", "least"), "components")


def components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) for every row of ``documents`` (doc_id, text)."""
    sketches, classes = classified(documents)
    slim = sketches.select("doc_id", "n", "d1", "d2")
    joined = lookup(slim, ["d1", "d2"], classes.select("d1", "d2", "least"), "left")
    reached = F.when(F.col("n") > 0, F.col("least.rep")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), reached.alias("component_id"))


def _tag(batches: Iterator[pa.RecordBatch], names: tuple[str, str, str], text: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text):
        values = digests(*shingle_sets(batch.column(text)))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *map(pa.array, values)], names=[*batch.schema.names, *names])


def deduplicate(documents: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns; empty texts stay."""
    _, classes = classified(documents)
    names: list[str] = []
    for stem in ("n", "d1", "d2", "keep_d1", "keep_d2", "keep", "nth"):
        names.append(free_name(f"_{stem}", [*documents.columns, *names]))
    n, d1, d2, keep_d1, keep_d2, keep, nth = names
    schema = T.StructType([*documents.schema.fields, *(T.StructField(x, T.LongType()) for x in (n, d1, d2))])
    tagged = documents.mapInArrow(lambda batches: _tag(batches, (n, d1, d2), "text"), schema)
    # empty sets share one digest: give each a key of its own, so that they spread
    tagged = tagged.withColumn(d1, F.when(F.col(n) > 0, F.col(d1)).otherwise(F.monotonically_increasing_id()))
    kept = classes.select(
        F.col("least.d1").alias(keep_d1), F.col("least.d2").alias(keep_d2), F.col("least.rep").alias(keep)).distinct()
    # doc_id is a join key too, so a large group of copies is dealt to many tasks
    same = (F.col(d1) == F.col(keep_d1)) & (F.col(d2) == F.col(keep_d2)) & F.col("doc_id").eqNullSafe(F.col(keep))
    chosen = tagged.join(kept, same, "left").where((F.col(n) == 0) | F.col(keep_d1).isNotNull())
    first = Window.partitionBy(d1, d2).orderBy("text")
    chosen = chosen.withColumn(nth, F.row_number().over(first)).where((F.col(nth) == 1) | (F.col(n) == 0))
    return chosen.select(*[F.col(f"`{c}`") for c in documents.columns])
