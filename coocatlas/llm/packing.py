"""Packing along a space-filling curve.

Documents are tokenised once and staged as ids. The hashed bag of a document's ids is
projected to a few dimensions, each cut to a grid, and the grid cell's place on a Hilbert
curve is the sort key; equal keys follow a hash of doc_id and then a row number. The keys
alone, without the ids, are sorted first: running sums of tokens along the curve give the
keys at which the curve is cut into stretches of equal tokens, so neither copies nor long
documents gather in one task. Every task then fills sequences with the neighbouring documents
of one stretch end to end, cutting at the sequence length, and pads only its last one.

Defined results: a null or empty text is just the end id; texts of any length are cut over
as many sequences as they need; repeated rows are packed each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coocatlas.llm.bpe import BatchEncoder
from coocatlas.llm.tables import staged
from coocatlas.llm.words import slices

SEQUENCE = 1024
END_ID = 0
DIMENSIONS, BITS = 4, 10
#: Tokens a packing task should get, and most tasks: with more tokens, each gets more.
TASK_TOKENS = 8 << 20
MOST_TASKS = 100_000


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer grid cells (rows x dimensions)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the rotations of each level, from the coarsest
        low = bit - 1
        for d in range(dims):
            high = (x[d] & bit) != 0
            swapped = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(high, low, swapped)
            x[d] ^= swapped
        bit >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


def _directions(vocabulary: int) -> np.ndarray:
    """A fixed random direction per id; rarer ids (higher in the merge order) weigh more."""
    drawn = np.random.default_rng(20240229).standard_normal((vocabulary, DIMENSIONS))
    return (drawn * np.log1p(np.arange(vocabulary))[:, None]).astype(np.float32)


def curve_keys(ids: np.ndarray, counts: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Hilbert key of each document from its ids; a document of no ids is at the origin."""
    sums = np.zeros((len(counts), directions.shape[1]))
    full = np.flatnonzero(counts)
    if len(full):
        begins = (np.cumsum(counts) - counts)[full]
        sums[full] = np.add.reduceat(directions[ids], begins, axis=0, dtype=np.float64)
    norm = np.sqrt((sums ** 2).sum(axis=1, keepdims=True))
    unit = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
    cells = np.clip(((unit + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert_key(cells, BITS)


def _encode(tokenizer: str, ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BatchEncoder(tokenizer, ranks, pattern)
        width = np.dtype("<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        directions = _directions(encoder.tokenizer.get_vocab_size())
        row = TaskContext.get().partitionId() << 36
        for batch in slices(batches, "text"):
            ids, counts = encoder.encode(batch.column("text"))
            keys = curve_keys(ids, counts, directions)
            ends = np.cumsum(counts)
            closed = np.insert(ids, ends, END_ID).astype(width)
            offsets = np.concatenate([[0], (ends + np.arange(1, len(ends) + 1)) * width.itemsize]).astype(np.int64)
            packed = pa.Array.from_buffers(
                pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(closed.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), packed.cast(pa.binary()), pa.array(counts + 1), pa.array(keys),
                 pa.array(np.full(len(counts), width.itemsize, np.int32)), pa.array(row + np.arange(len(counts)))],
                names=["doc_id", "ids", "doc_tokens", "key", "width", "row"])
            row += len(counts)

    return run


def encode(documents: DataFrame, tokenizer: str, ranks: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (binary, little-endian, ``width`` bytes each, end id last), doc_tokens, key, row (a number of its own)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        _encode(tokenizer, ranks, pattern), f"doc_id {kind}, ids binary, doc_tokens long, key long, width int, row long")


def _fill(sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, position = TaskContext.get().partitionId() << 36, 0
        for batch in slices(batches, "ids"):
            counts = batch.column("doc_tokens").to_numpy()
            width = int(batch.column("width")[0].as_py())
            raw = batch.column("ids")
            ids = np.frombuffer(b"".join(raw.to_pylist()), f"<u{width}").astype("<u4")
            begin = position + np.cumsum(counts) - counts
            end = begin + counts
            pieces = (end - 1) // sequence - begin // sequence + 1
            doc = np.repeat(np.arange(len(counts)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            place = begin[doc] // sequence + nth
            left, right = np.maximum(begin[doc], place * sequence), np.minimum(end[doc], (place + 1) * sequence)
            offsets = np.concatenate([[0], np.cumsum(right - left)]).astype(np.int64) * 4
            cut = pa.Array.from_buffers(
                pa.large_binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])
            position += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(left - begin[doc]), pa.array(right - left),
                 cut.cast(pa.binary()), pa.array(counts[doc]), pa.array(base + place), pa.array(left - place * sequence)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


CURVE = ["key", "tie", "row"]


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of the rows before each one in its partition."""
    here, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        counts = batch.column("doc_tokens").to_numpy()
        before = total + np.cumsum(counts) - counts
        total += int(counts.sum())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(before, pa.int64()), pa.array(np.full(len(counts), here, np.int32))],
            names=[*batch.schema.names, "before", "part"])


def cuts(encoded: DataFrame, task_tokens: int = TASK_TOKENS) -> list[tuple[int, int, int]]:
    """Places on the curve, ascending, at which stretches of about ``task_tokens`` tokens begin; at most MOST_TASKS.

    One number per sorted partition and one place per stretch reach the driver.
    """
    keys = encoded.select(*CURVE, "doc_tokens").repartitionByRange(*CURVE).sortWithinPartitions(*CURVE)
    schema = "key long, tie long, row long, doc_tokens long, before long, part int"
    summed = staged(keys.mapInArrow(_before, schema), "curve")
    totals = dict(summed.groupBy("part").agg(F.sum("doc_tokens")).collect())
    if not totals:
        return []
    sizes = [totals.get(part, 0) for part in range(max(totals) + 1)]
    size = max(task_tokens, -(-sum(sizes) // MOST_TASKS))
    shift = F.element_at(F.lit(list(accumulate(sizes[:-1], initial=0))).cast("array<bigint>"), F.col("part") + 1)
    stretch = F.floor((F.col("before") + shift) / size)
    first = summed.groupBy(stretch.alias("stretch")).agg(F.min(F.struct(*CURVE)).alias("at")).select("stretch", "at.*").collect()
    return sorted((r["key"], r["tie"], r["row"]) for r in first if r["stretch"] > 0)


def _stretch(places: list[tuple[int, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in CURVE), strict=True)
            task = pa.array([bisect_right(places, row) for row in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, task], names=[*batch.schema.names, "task"])

    return run


def pack(documents: DataFrame, tokenizer: str, ranks: str, sequence: int = SEQUENCE, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset."""
    encoded = staged(encode(documents, tokenizer, ranks), "encoded").withColumn("tie", F.xxhash64("doc_id"))
    places = cuts(encoded, task_tokens)
    schema = T.StructType([*encoded.schema, T.StructField("task", T.IntegerType())])
    placed = encoded.mapInArrow(_stretch(places), schema).repartitionById(len(places) + 1, "task").sortWithinPartitions(*CURVE)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return placed.select("doc_id", "ids", "doc_tokens", "width").mapInArrow(
        _fill(sequence),
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
