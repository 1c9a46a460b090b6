"""Benchmark decontamination with suffix arrays of the training text.

The documents are cut into shards of a few megabytes, each handled by one task step. A
shard's words become integer symbols, a separator of its own follows every document, and
the suffixes are sorted by prefix doubling. Every benchmark suffix is then found by binary
search, all of them at once. The matching range of the array gives the locations, and each
is extended word by word to its longest verbatim match.

A shard holds whole documents, so results need no shuffle, and a passage that a third of
all documents share is just as many short ranges. The benchmark is sent to the tasks in
blocks of at most ``BLOCK_BYTES``; more blocks mean more passes over the documents.

Defined results: null and blank texts and items have no words and match nothing; an item
shorter than the window matches as a whole; matches never cross documents; items with equal
ids count once and a null id counts as "null"; repeated documents are judged each; with an
empty benchmark nothing matches; a clashing column name gets an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coocatlas.llm.tables import free_name
from coocatlas.llm.words import PUNCTUATION, Words, slices, words

WINDOW = 13
#: Most benchmark bytes sent to the tasks at once.
BLOCK_BYTES = 16 << 20

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest", T.LongType()),
    T.StructField("longest_start", T.LongType()),
    T.StructField("longest_item", T.StringType()),
    T.StructField("spans", T.ArrayType(SPAN)),
])


@dataclass
class Suffixes:
    """Benchmark suffixes: all words of all items, and where each searched suffix begins and ends."""

    hash: np.ndarray
    begin: np.ndarray
    stop: np.ndarray
    item: np.ndarray
    names: list[str]


def suffixes_of(names: list[str], texts: list[str | None], window: int) -> Suffixes:
    found = words(pa.array(texts, pa.string()), PUNCTUATION)
    bounds = found.bounds
    begin, stop, item = [], [], []
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b > a:
            starts = np.arange(a, max(a + 1, b - window + 1))
            begin.append(starts)
            stop.append(np.full(len(starts), b))
            item.append(np.full(len(starts), i))
    none = [np.zeros(0, np.int64)]
    return Suffixes(found.hash, *(np.concatenate(x or none) for x in (begin, stop, item)), names)


@dataclass
class SuffixArray:
    """Symbols of a shard, the suffix order by their first words, and the known word hashes."""

    symbols: np.ndarray
    order: np.ndarray
    known: np.ndarray
    doc: np.ndarray


def suffix_array(found: Words, depth: int) -> SuffixArray:
    """Suffixes sorted by at least ``depth`` words; separators are larger than words and all distinct."""
    known, ranks = np.unique(found.hash, return_inverse=True)
    n_docs, n = found.n_docs, len(found.hash)
    symbols = np.empty(n + n_docs, np.int64)
    symbols[np.arange(n) + found.doc] = ranks + 1
    symbols[found.bounds[1:] + np.arange(n_docs)] = len(known) + 1 + np.arange(n_docs)
    doc = np.empty(n + n_docs, np.int64)
    doc[np.arange(n) + found.doc] = found.doc
    doc[found.bounds[1:] + np.arange(n_docs)] = np.arange(n_docs)
    rank, step = symbols, 1
    while step < depth:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        distinct, rank = np.unique(rank * (rank.max() + 1) + after, return_inverse=True)
        rank = rank + 1
        step *= 2
        if len(distinct) == len(rank):
            break
    return SuffixArray(symbols, np.argsort(rank, kind="stable"), known, doc)


def find(array: SuffixArray, wanted: Suffixes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences of the first ``window`` words of each suffix.

    Returns place, suffix number, words that must match, and words of the longest match.
    """
    at = np.searchsorted(array.known, wanted.hash)
    at = np.minimum(at, max(0, len(array.known) - 1))
    pattern = np.where(array.known[at] == wanted.hash, at + 1, 0) if len(array.known) else np.zeros(len(wanted.hash), np.int64)
    size = np.minimum(wanted.stop - wanted.begin, window)
    missing = np.concatenate([[0], np.cumsum(pattern == 0)])
    asked = np.flatnonzero(missing[wanted.begin + size] == missing[wanted.begin])
    size, begin = size[asked], wanted.begin[asked]
    low = _bound(array, pattern, begin, size, after=False)
    high = _bound(array, pattern, begin, size, after=True)
    count = high - low
    which = np.repeat(np.arange(len(asked)), count)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    place = array.order[low[which] + nth]
    length = size[which].copy()
    stop, begin = wanted.stop[asked][which], begin[which]
    open_ = np.arange(len(which))
    while len(open_):
        open_ = open_[begin[open_] + length[open_] < stop[open_]]
        open_ = open_[pattern[begin[open_] + length[open_]] == array.symbols[place[open_] + length[open_]]]
        length[open_] += 1
    return place, asked[which], size[which], length


def _bound(array: SuffixArray, pattern: np.ndarray, begin: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
    """First place in the order whose suffix is not below (or, ``after``, is above) each pattern."""
    low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(array.order))
    while (live := np.flatnonzero(low < high)).size:
        middle = (low[live] + high[live]) // 2
        side = _compare(array, pattern, begin[live], size[live], array.order[middle])
        right = side <= 0 if after else side < 0
        low[live] = np.where(right, middle + 1, low[live])
        high[live] = np.where(right, high[live], middle)
    return low


def _compare(array, pattern, begin, size, place) -> np.ndarray:
    """-1, 0 or 1 as the suffix at ``place`` is below, begins with, or is above the pattern."""
    result = np.zeros(len(begin), np.int8)
    open_, last = np.arange(len(begin)), len(array.symbols) - 1
    for k in range(int(size.max(initial=0))):
        open_ = open_[size[open_] > k]
        here = place[open_] + k
        have = np.where(here <= last, array.symbols[np.minimum(here, last)], 0)
        want = pattern[begin[open_] + k]
        result[open_] = np.sign(have - want)
        open_ = open_[have == want]
    return result


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of runs of hit symbols within one document."""
    padded = np.concatenate([[False], hit, [False]])
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    return edge[::2], edge[1::2]


def _results(found: Words, wanted: Suffixes, window: int, before: pa.StructArray | None) -> pa.StructArray:
    n_docs = found.n_docs
    bounds = found.bounds
    n_words = np.diff(bounds)
    first = bounds[:-1] + np.arange(n_docs)  # symbol place of each document's first word
    hit = np.zeros(len(found.hash) + n_docs + 1, np.int64)
    items: list[list[str]] = [[] for _ in range(n_docs)]
    longest, longest_at, longest_item = np.zeros(n_docs, np.int64), np.full(n_docs, -1), [None] * n_docs
    if before is not None:
        for d, old in enumerate(before.to_pylist()):
            items[d] = old["items"]
            longest[d], longest_at[d], longest_item[d] = old["longest"], old["longest_start"], old["longest_item"]
            for span in old["spans"]:
                hit[first[d] + span["start"]] += 1
                hit[first[d] + span["end"]] -= 1
    if len(found.hash) and len(wanted.begin):
        array = suffix_array(found, window)
        place, suffix, size, length = find(array, wanted, window)
        np.add.at(hit, place, 1)
        np.add.at(hit, place + size, -1)
        doc = array.doc[place]
        for d, i in np.unique(np.stack([doc, wanted.item[suffix]], axis=1), axis=0).tolist():
            items[d].append(wanted.names[i])
        for k in np.lexsort((place, -length, doc)):
            d = doc[k]
            if length[k] > longest[d]:
                longest[d], longest_at[d] = length[k], place[k] - first[d]
                longest_item[d] = wanted.names[wanted.item[suffix[k]]]
    covered = np.cumsum(hit)[:-1] > 0
    start, end = _runs(covered)
    owner = np.searchsorted(first, start, side="right") - 1
    total = np.concatenate([[0], np.cumsum(covered)])
    n_hit = total[first + n_words] - total[first]
    per_doc = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_docs))]).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(start - first[owner]), pa.array(end - first[owner])], names=["start", "end"])
    return pa.StructArray.from_arrays(
        [pa.array(n_words), pa.array(n_hit), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
         pa.array(longest), pa.array(longest_at), pa.array(longest_item, pa.string()),
         pa.ListArray.from_arrays(pa.array(per_doc), spans)],
        names=FOUND.names)


def _search(wanted: Suffixes, text: str, into: str, window: int, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = words(batch.column(text), PUNCTUATION)
            result = _results(found, wanted, window, None if first else batch.column(into))
            names = [name for name in batch.schema.names if name != into]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), result], names=[*names, into])

    return run


def search(documents: DataFrame, benchmark: DataFrame, into: str = "found", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``documents`` with all their columns and a struct ``into`` (see FOUND) of what the benchmark matches.

    ``benchmark``: item_id, text. Spans and starts count the document's words from 0.
    """
    sized = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    schema = T.StructType([*documents.schema.fields, T.StructField(into, FOUND)])
    out = documents
    for k in range(blocks):
        # one block is at most about BLOCK_BYTES: blocks are cut by hash, items are short
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        wanted = suffixes_of([r.item_id for r in rows], [r.text for r in rows], window)
        out = out.mapInArrow(_search(wanted, text, into, window, first=k == 0), schema)
    return out


def contaminated(found: str = "found"):
    """True where hits are at least a twentieth of the words."""
    cell = F.col(f"`{found}`")
    return (cell["n_hit"] > 0) & (20 * cell["n_hit"] >= cell["n_words"])


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with their own columns, that are not contaminated."""
    name = free_name("found", documents.columns)
    return search(documents, benchmark, name).where(~contaminated(name)).drop(name)
