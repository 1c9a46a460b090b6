"""Language identification by words first, with backoff to shorter and shorter character n-grams.

A text is lower-cased and cut into words, runs of letters and their marks. A word that the
model knows votes with its log frequency in every language. An unseen word falls back to its
character n-grams, ends marked, of length 5; where the model knows none of these, of length
4, and so on to single characters: the mean of the known ones' log frequencies is the word's
vote. A word of which not even a character is known does not vote.

Training counts cover all labelled rows: tasks count their words, the counts are combined,
and the n-grams are counted over the combined words. What has to reach every task is the
model, and its size is bounded by ENTRIES (word, language) and as many (n-gram, language)
counts: beyond that, the rarest are left out by one count threshold, so rare words become
unseen words, which is what the backoff is for. Ties at the threshold stay together.

Defined results: a null text, one without a letter, and any text where nothing was learned
are ``und`` with score 0; equal languages are told apart by name; labels may be any non-null
value; null keys and repeated rows are kept as they are; an empty table gives an empty one;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coocatlas.llm.tables import free_name, narrow, staged
from coocatlas.llm.words import mix, slices, words

UNKNOWN = "und"
#: Longest n-gram an unseen word is scored by.
LONGEST = 5
#: Most (word, language) and most (n-gram, language) counts a model holds.
ENTRIES = 400_000
#: Added to each count.
SMOOTHING = 0.5
#: Distinct words a task counts before it hands them on.
FLUSH = 200_000
#: Numbers in a batch's matrix of votes.
CELLS = 2_000_000
#: Words beyond this many add no more confidence to the score.
EVIDENCE = 8.0

_NOT_LETTERS = r"[^\pL\pM]+"
_SEED = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xBF58476D1CE4E5B9)


def normalised(texts: pa.Array) -> pa.Array:
    """Lower-cased texts with one space for every run of other characters than letters and marks."""
    return pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), _NOT_LETTERS, " ")


def grams(found: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every n-gram of the words, each word standing between two end marks."""
    points = np.frombuffer("".join(f" {w} " for w in found).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in found], np.int64)
    owner = np.repeat(np.arange(len(found)), lengths)
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(size, _SEED * n & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(n):
        total = (total ^ mix(points[k:k + size] + np.uint64(1))) * _STEP
    inside = owner[:size] == owner[n - 1:]
    if n == 1:
        inside &= points != ord(" ")
    return owner[:size][inside], mix(total[inside])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, lang, n) of one task, handed on whenever many distinct words have gathered."""
    held: dict[tuple[str, str], int] = {}

    def flush() -> pa.RecordBatch:
        keys = list(held)
        out = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(held.values()), pa.int64())],
            names=["word", "lang", "n"])
        held.clear()
        return out

    for batch in slices(batches, "text"):
        labels = batch.column("lang").cast(pa.string()).dictionary_encode()
        found = words(normalised(batch.column("text")))
        if not len(found.hash):
            continue
        lang = labels.indices.to_numpy(zero_copy_only=False).astype(np.uint64)[found.doc]
        _, first, number = np.unique(mix(found.hash + lang), return_index=True, return_counts=True)
        data, names = found.data.tobytes(), labels.dictionary.to_pylist()
        for i, n in zip(first.tolist(), number.tolist(), strict=True):
            key = (data[found.start[i]:found.end[i]].decode("utf-8", "replace"), names[int(lang[i])])
            held[key] = held.get(key, 0) + n
        if len(held) > FLUSH:
            yield flush()
    if held:
        yield flush()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, gram, lang, n) of each batch of counted words."""
    for batch in batches:
        found, number = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        labels = batch.column("lang").dictionary_encode()
        lang, names = labels.indices.to_numpy(zero_copy_only=False), labels.dictionary
        for n in range(1, LONGEST + 1):
            owner, gram = grams(found, n)
            if not len(gram):
                continue
            order = np.lexsort((lang[owner], gram))
            g, c, w = gram[order], lang[owner][order], number[owner][order]
            starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(starts), n, np.int32)), pa.array(g[starts].view(np.int64)),
                pa.DictionaryArray.from_arrays(pa.array(c[starts].astype(np.int32)), names).cast(pa.string()),
                pa.array(np.add.reduceat(w, starts))], names=["size", "gram", "lang", "n"])


def _floor(counts: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` rows reach; counts above 64 are told apart by their six leading bits."""
    shift = F.greatest(F.lit(0), F.length(F.bin("n")) - 6)
    level = F.call_function("shiftleft", F.call_function("shiftright", F.col("n"), shift), shift)
    seen, least = 0, 1 << 62
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        seen += row["count"]
        if seen > most:
            break
        least = row["level"]
    return least


@dataclass
class Table:
    """Log frequencies of hashed keys, by language: sorted keys, and per key a run of (language, gain over unseen)."""

    keys: np.ndarray
    bounds: np.ndarray
    lang: np.ndarray
    gain: np.ndarray

    @staticmethod
    def of(key: np.ndarray, lang: np.ndarray, gain: np.ndarray) -> Table:
        order = np.lexsort((lang, key))
        key, lang, gain = key[order], lang[order], gain[order]
        keys, first = np.unique(key, return_index=True)
        return Table(keys, np.r_[first, len(key)].astype(np.int64), lang.astype(np.int32), gain.astype(np.float32))

    def find(self, key: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def entries(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For known places: which of them, language and gain of each of their entries."""
        begin, number = self.bounds[places], self.bounds[places + 1] - self.bounds[places]
        which = np.repeat(np.arange(len(places)), number)
        at = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(begin, number)
        return which, self.lang[at], self.gain[at]


@dataclass
class Model:
    """Languages, their log priors, and per kind of key the log frequency of an unseen one and the table."""

    names: list[str]
    prior: np.ndarray
    unseen: list[np.ndarray]
    tables: list[Table]

    def votes(self, found: list[str], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log frequency per (distinct word, language), and whether the word votes at all."""
        out = np.zeros((len(found), len(self.names)))
        voting = np.zeros(len(found), bool)
        place = self.tables[0].find(hashes)
        known = np.flatnonzero(place >= 0)
        out[known] = self.unseen[0]
        which, lang, gain = self.tables[0].entries(place[known])
        out[known[which], lang] += gain
        voting[known] = True
        for n in range(LONGEST, 0, -1):
            left = np.flatnonzero(~voting)
            if not len(left):
                break
            owner, gram = grams([found[i] for i in left], n)
            place = self.tables[n].find(gram)
            owner, place = owner[place >= 0], place[place >= 0]
            number = np.bincount(owner, minlength=len(left)).astype(float)
            some = number > 0
            out[left[some]] = self.unseen[n]
            which, lang, gain = self.tables[n].entries(place)
            np.add.at(out, (left[owner[which]], lang), gain / number[owner[which]])
            voting[left[some]] = True
        return out, voting


def learn(documents: DataFrame, entries: int = ENTRIES) -> Model:
    """Counts over all rows of (text, lang) with a label, and the bounded model made of them."""
    labelled = documents.where("lang is not null").withColumn("lang", F.col("lang").cast("string"))
    raw = labelled.select("text", "lang").mapInArrow(_count_words, "word string, lang string, n long")
    counted = staged(raw.groupBy("word", "lang").agg(F.sum("n").alias("n")), "language-words")
    parts = counted.mapInArrow(_count_grams, "size int, gram long, lang string, n long")
    pieces = staged(parts.groupBy("size", "gram", "lang").agg(F.sum("n").alias("n")), "language-grams")
    priors = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(priors, key=lambda name: name.encode())
    code = {name: i for i, name in enumerate(names)}
    total = sum(priors.values())
    prior = np.log(np.array([priors[name] / total for name in names])) if names else np.zeros(0)

    def made(counts: DataFrame, key: Column) -> tuple[np.ndarray, Table]:
        sums = {r["lang"]: (r["n"], r["v"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
        kinds = float(sum(v for _, v in sums.values())) + 1
        size = np.log(np.array([sums.get(name, (0, 0))[0] + SMOOTHING * kinds for name in names]))
        kept = counts.where(F.col("n") >= _floor(counts, entries)).select(key.alias("k"), "lang", "n").toArrow()
        lang = np.array([code[name] for name in kept.column("lang").to_pylist()], np.int64)
        n = kept.column("n").to_numpy().astype(float)
        hashes = kept.column("k")
        if pa.types.is_string(hashes.type):
            joined = pa.chunked_array([hashes]) if isinstance(hashes, pa.Array) else hashes
            hashes = words(pa.concat_arrays(joined.chunks)).hash if len(joined) else np.zeros(0, np.uint64)
        else:
            hashes = hashes.to_numpy().astype(np.int64).view(np.uint64)
        return np.log(SMOOTHING) - size, Table.of(hashes, lang, np.log(n + SMOOTHING) - np.log(SMOOTHING))

    found = [made(counted, F.col("word"))]
    found += [made(pieces.where(F.col("size") == n), F.col("gram")) for n in range(1, LONGEST + 1)]
    return Model(names, prior, [unseen for unseen, _ in found], [table for _, table in found])


def _score(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Best language of each text (-1: no voting word) and the share of its softmax."""
    best, share = np.full(len(texts), -1), np.zeros(len(texts))
    width = len(model.names)
    found = words(normalised(texts))
    if not width or not len(found.hash):
        return best, share
    hashes, first, kind = np.unique(found.hash, return_index=True, return_inverse=True)
    data = found.data.tobytes()
    step = max(1, CELLS // width)
    total, number = np.zeros((len(texts), width)), np.zeros(len(texts))
    for begin in range(0, len(hashes), step):
        some = slice(begin, begin + step)
        spelled = [data[found.start[i]:found.end[i]].decode("utf-8", "replace") for i in first[some].tolist()]
        votes, voting = model.votes(spelled, hashes[some])
        mine = np.flatnonzero((kind >= begin) & (kind < begin + step))
        mine = mine[voting[kind[mine] - begin]]
        pair, times = np.unique(found.doc[mine].astype(np.int64) * len(hashes) + kind[mine], return_counts=True)
        doc, word = pair // len(hashes), pair % len(hashes) - begin
        number += np.bincount(doc, times, len(texts))
        for begin_pair in range(0, len(pair), step):
            part = slice(begin_pair, begin_pair + step)
            np.add.at(total, doc[part], votes[word[part]] * times[part, None])
    heard = number > 0
    total[heard] += model.prior
    best[heard] = total[heard].argmax(axis=1)
    scale = np.minimum(number, EVIDENCE) / np.maximum(number, 1)
    weights = np.exp((total - total.max(axis=1, keepdims=True)) * scale[:, None])
    share[heard] = (weights.max(axis=1) / weights.sum(axis=1))[heard]
    return best, share


def predict(documents: DataFrame, model: Model, text: str = "text", languages: str = "lang_pred", score: str = "score") -> DataFrame:
    """``documents`` with the predicted language and its share of the votes' softmax."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    letters = free_name("_letters", [*documents.columns, languages, score])
    marked = documents.withColumn(letters, F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)))
    schema = StructType([f for f in marked.schema if f.name != letters]).add(languages, "string").add(score, "double")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        room = max(1, CELLS // max(1, len(model.names)))
        names = np.array([*model.names, UNKNOWN], object)
        for whole in slices(batches, text):
            for begin in range(0, whole.num_rows, room):
                batch = whole.slice(begin, room)
                best, share = _score(model, batch.column(text))
                silent = ~batch.column(letters).to_numpy(zero_copy_only=False).astype(bool)
                best[silent], share[silent] = -1, 0.0
                kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != letters]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(names[best], pa.string()), pa.array(share, pa.float64())], names=schema.names)

    return marked.mapInArrow(label, schema)


def identify(documents: DataFrame, held_out: Column, key: str = "doc_id") -> DataFrame:
    """Key, ``held_out``, ``lang_pred`` and ``score`` of every document, learned from the others."""
    kept = narrow(documents, key, "text", "lang").withColumn("held_out", held_out)
    model = learn(kept.where("not held_out").select("text", "lang"))
    return predict(kept.select(f"`{key}`", "text", "held_out"), model).select(f"`{key}`", "held_out", "lang_pred", "score")
