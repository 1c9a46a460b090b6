"""Hashed maximum-entropy language model with a class-factored softmax.

A token's probability is that of its class given the history, times that of the token in
its class. Frequent words are classes of their own; the others are classed by spelling
shape. Class scores are sums of hashed feature weights: the last word, the last two, the
word before the last (a skip), and the last three classes. Inside a class, tokens have
additively smoothed relative frequencies and one slot stands for all unseen tokens, so the
probabilities of all tokens sum to one.

The corpus is encoded once into blocks of a few megabytes with a vocabulary of their own
and staged. Token counts are combined over all blocks. Training makes one pass over all
training documents in rounds: in each, tasks start from the shared weights, take AdaGrad
steps on their blocks, and the weights are averaged by tokens, block of rows by block of
rows. Only the weight table (``ROWS`` x ``CLASSES``, fixed) ever reaches the driver. Counts
return to the blocks by a join, so the vocabulary may grow without bound.

Defined results: a null or empty text is the end token alone; repeated rows count and are
scored each; a null doc_id falls into fold 0; with no training documents every class is
equally likely; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coocatlas.llm.tables import staged
from coocatlas.llm.words import mix, slices, words

FOLDS = 10
HEADS, SHAPES = 15, 16
CLASSES = HEADS + 1 + SHAPES
END_CLASS = HEADS
ROWS = 1 << 14
FEATURES = 4
CHUNK = 256
ADDED = 0.1
ROUNDS = ((1, 2, 3), (4, 5, 6), (7, 8, 9))
MINIBATCH, RATE = 4096, 0.3
# Text bytes whose words are found at once, and tokens scored at once: they bound a task's memory, not its result.
WORD_BYTES = 1 << 20
SCORED = 1 << 16
END = np.uint64(0)

BLOCK = "block long, docs array<{kind}>, folds array<int>, sizes array<long>, ids binary, vocab binary, shapes binary, train binary"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 32
    for number, batch in enumerate(slices(batches, "text")):
        hashes, shape, doc, n_docs = _words(batch)
        n = len(hashes)
        vocab, first, which, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        # frequent tokens get small ids, which compress well
        order = np.argsort(-often, kind="stable")
        vocab, first, which = vocab[order], first[order], np.argsort(order)[which]
        ids = np.zeros(n + n_docs, "<u4")  # 0 is the end token
        ids[np.arange(n) + doc] = which + 1
        sizes = np.bincount(doc, minlength=n_docs) + 1
        folds = batch.column("fold").to_numpy()
        train = np.bincount(ids[np.repeat(folds != 0, sizes)], minlength=len(vocab) + 1).astype("<u4")
        shapes = np.concatenate([[0], shape[first]]).astype(np.uint8)
        one = lambda values, kind=None: pa.array([values], kind)
        docs = batch.column("doc_id")
        docs = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
        yield pa.RecordBatch.from_arrays(
            [one(base + number), docs, one(folds.tolist(), pa.list_(pa.int32())), one(sizes.tolist(), pa.list_(pa.int64())),
             one(_deflated(ids)), one(np.concatenate([[END], vocab]).astype("<u8").tobytes()), one(shapes.tobytes()),
             one(train.tobytes())],
            names=["block", "docs", "folds", "sizes", "ids", "vocab", "shapes", "train"])


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hash, spelling shape and document of each word, and the number of documents; texts are taken a part at a time."""
    hashes, shapes, docs, n_docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], 0
    for part in slices(iter([batch.select(["text"])]), "text", WORD_BYTES):
        found = words(part.column("text"))
        hashes.append(found.hash)
        shapes.append(_shape(found.data, found.start, found.end).astype(np.uint8))
        docs.append(found.doc + n_docs)
        n_docs += found.n_docs
    return np.concatenate(hashes), np.concatenate(shapes), np.concatenate(docs), n_docs


def _deflated(ids: np.ndarray) -> bytes:
    """Token ids, compressed byte plane by byte plane."""
    return pa.compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _inflated(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _shape(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spelling shape of each word: kind of its last byte (4) by length band or non-ASCII content (4)."""
    if not len(start):
        return np.zeros(0, np.int64)
    last = data[end - 1]
    letter = ((last >= 0x61) & (last <= 0x7A)) | (last >= 0x80)
    kind = np.select([letter, last == ord("."), last == ord(",")], [0, 1, 2], 3)
    wide = np.concatenate([[0], np.cumsum(data >= 0x80)])
    length = end - start
    band = np.where(wide[end] > wide[start], 3, np.where(length > 9, 2, np.where(length > 5, 1, 0)))
    return kind * 4 + band


def encode(documents: DataFrame) -> DataFrame:
    """Blocks of documents as local token ids with the block's vocabulary and training counts."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    fold = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")
    return documents.select("doc_id", "text", fold.alias("fold")).mapInArrow(_encode, BLOCK.format(kind=kind))


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
    """Block by block, as Arrow and as Python values, so that a task holds the values of one block only."""
    for batch in batches:
        for at in range(batch.num_rows):
            one = batch.slice(at, 1)
            yield one, one.to_pylist()[0]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, row in _single(batches):
        token = np.frombuffer(row["vocab"], "<u8").view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(token), row["block"])), pa.array(np.arange(len(token), dtype=np.int32)), pa.array(token),
             pa.array(np.frombuffer(row["shapes"], np.uint8).astype(np.int32)),
             pa.array(np.frombuffer(row["train"], "<u4").astype(np.int64))],
            names=["block", "at", "token", "shape", "n"])


def _packed(group: pd.DataFrame) -> pd.DataFrame:
    counts = np.zeros(int(group["at"].max()) + 1, "<i8")
    counts[group["at"].to_numpy()] = group["c"].to_numpy()
    return pd.DataFrame({"block": [group["block"].iloc[0]], "counts": [counts.tobytes()]})


@dataclass
class Vocabulary:
    """Totals the probabilities need: the head words, and tokens and types of each class."""

    heads: np.ndarray
    tokens: np.ndarray
    types: np.ndarray

    @property
    def n(self) -> int:
        return int(self.tokens.sum())

    @property
    def v(self) -> int:
        return int(self.types.sum())

    def classes(self, vocab: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """Class of each vocabulary entry; entry 0 is the end token."""
        out = HEADS + 1 + shapes.astype(np.int64)
        if len(self.heads):
            order = np.argsort(self.heads)
            at = np.minimum(np.searchsorted(self.heads[order], vocab), len(order) - 1)
            known = self.heads[order][at] == vocab
            out[known] = order[at[known]]
        out[0] = END_CLASS
        return out

    def log_in_class(self, cls: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Natural log of the probability of a token in its class, from its training count."""
        whole = (self.tokens + ADDED * (self.types + 1))[cls]
        return np.where(cls <= END_CLASS, 0.0, np.log((counts + ADDED) / whole))

    def priors(self) -> np.ndarray:
        return np.log((self.tokens + 1.0) / (self.tokens.sum() + CLASSES)).astype(np.float32)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From counts (token, shape, c): the HEADS commonest words, and totals per class (at most CLASSES rows)."""
    word = F.col("token") != int(END)
    top = counts.where(word).orderBy(F.desc("c"), "token").limit(HEADS).collect()
    rows = counts.groupBy(word.alias("word"), "shape").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, row in enumerate(top):
        tokens[k], types[k] = row.c, 1
    for row in rows:
        k = HEADS + 1 + row["shape"] if row.word else END_CLASS
        tokens[k] += row.c
        types[k] += row.v
    for row in top:
        tokens[HEADS + 1 + row["shape"]] -= row.c
        types[HEADS + 1 + row["shape"]] -= 1
    return Vocabulary(np.array([r.token for r in top], np.int64).view(np.uint64), tokens, types)


def features(ids: np.ndarray, sizes: np.ndarray, vocab: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Weight rows (tokens x FEATURES) of each token's history within its document."""
    ends = np.cumsum(sizes)
    inside = np.arange(len(ids)) - np.repeat(ends - sizes, sizes)

    def back(values: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(values), np.uint64(0x5A5A5A5A), np.uint64)
        out[k:] = values[:-k] if k < len(values) else values[:0]
        out[inside < k] = np.uint64(0x5A5A5A5A)
        return out

    token, kind = vocab[ids], cls[ids].astype(np.uint64)
    one, two = back(token, 1), back(token, 2)
    classes = back(kind, 1) + back(kind, 2) * np.uint64(1 << 12) + back(kind, 3) * np.uint64(1 << 24)
    keys = (one, one * np.uint64(0x9E3779B97F4A7C15) + mix(two), two + np.uint64(0xABCDEF12345), classes)
    salts = mix(np.arange(1, FEATURES + 1, dtype=np.uint64))
    salted = [mix(key + salt) % np.uint64(ROWS) for key, salt in zip(keys, salts, strict=True)]
    return np.stack(salted, axis=1).astype(np.int32)


def _scores(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores (classes x tokens, at most 0) for each row of features; the last weight row is the bias."""
    scores = np.take(weights, rows[:, 0], axis=0, mode="clip")
    scores += weights[-1]
    for k in range(1, rows.shape[1]):
        scores += np.take(weights, rows[:, k], axis=0, mode="clip")
    # class by class, so that the reductions over classes run along the tokens
    scores = np.ascontiguousarray(scores.T)
    scores -= scores.max(axis=0)
    return scores


def log_class(weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each token's class ``target`` for its row of features."""
    scores = _scores(weights, rows)
    own = scores[target, np.arange(len(target))]
    return own - np.log(np.exp(scores, out=scores).sum(axis=0))


def step(weights: np.ndarray, seen: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
    """One AdaGrad step on a minibatch, in place; ``seen`` holds squared gradients per weight row."""
    by_class = _scores(weights, rows)
    np.exp(by_class, out=by_class)
    by_class /= by_class.sum(axis=0)
    by_class[target, np.arange(len(target))] -= 1
    gradient = np.ascontiguousarray(by_class.T)
    for k in range(rows.shape[1]):
        # ROWS fit 16 bits, which are sorted by counting
        column = rows[:, k].astype(np.uint16)
        order = np.argsort(column, kind="stable")
        ordered = column[order]
        begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sums = np.add.reduceat(np.take(gradient, order, axis=0, mode="clip"), begins, axis=0)
        at = ordered[begins]
        squares = seen[at] + np.einsum("ij,ij->i", sums, sums) / np.float32(CLASSES)
        seen[at] = squares
        sums *= (RATE / np.sqrt(squares))[:, None]
        weights[at] -= sums
    total = by_class.sum(axis=1)
    seen[-1] += (total ** 2).mean()
    weights[-1] -= RATE * 0.1 / np.sqrt(seen[-1]) * total


def _block(row: dict) -> tuple[np.ndarray, ...]:
    sizes = np.array(row["sizes"], np.int64)
    return (_inflated(row["ids"], int(sizes.sum())), sizes, np.array(row["folds"], np.int64),
            np.frombuffer(row["vocab"], "<u8").astype(np.uint64), np.frombuffer(row["shapes"], np.uint8))


def _train(shared, words_: Vocabulary, folds: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        weights, seen, used = start.copy(), np.full(ROWS + 1, 1.0, np.float32), 0
        for _, row in _single(batches):
            ids, sizes, fold, vocab, shapes = _block(row)
            cls, wanted = words_.classes(vocab, shapes), np.isin(fold, folds)
            ids, sizes = ids[np.repeat(wanted, sizes)], sizes[wanted]
            rows, target = features(ids, sizes, vocab, cls), cls[ids]
            for begin in range(0, len(ids), MINIBATCH):
                part = slice(begin, begin + MINIBATCH)
                step(weights, seen, rows[part], target[part])
            used += len(ids)
        if used:
            moved = (weights - start).astype("<f2")
            pieces = [moved[k:k + CHUNK].tobytes() for k in range(0, len(moved), CHUNK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(pieces)), pa.int32()), pa.array([TaskContext.get().partitionId() // 8] * len(pieces), pa.int32()),
                 pa.array([used] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())],
                names=["piece", "salt", "used", "moved"])

    return run


def _averaged(group: pd.DataFrame) -> pd.DataFrame:
    """Mean of the moves of one piece, weighted by the tokens each was made with."""
    total, used = np.zeros(len(group["moved"].iloc[0]) // 2), group["used"].sum()
    for part, tokens in zip(group["moved"], group["used"], strict=True):
        total += np.frombuffer(part, "<f2").astype(np.float64) * (tokens / used)
    return pd.DataFrame({"piece": [group["piece"].iloc[0]], "salt": [0], "used": [used], "moved": [total.astype("<f2").tobytes()]})


def train(blocks: DataFrame, words_: Vocabulary) -> np.ndarray:
    """Weights after one pass over all training documents in ROUNDS of parallel steps and averaging."""
    weights = np.zeros((ROWS + 1, CLASSES), np.float32)
    weights[-1] = words_.priors()
    schema = "piece int, salt int, used long, moved binary"
    context = blocks.sparkSession.sparkContext
    for folds in ROUNDS:
        shared = context.broadcast(weights)
        parts = blocks.select("ids", "sizes", "folds", "vocab", "shapes").mapInArrow(_train(shared, words_, folds), schema)
        # eight tasks at a time first, so that no group grows with the corpus as fast as its tasks do
        eighths = parts.groupBy("piece", "salt").applyInPandas(_averaged, schema)
        rows = eighths.groupBy("piece").applyInPandas(_averaged, schema).collect()
        for row in rows:
            moved = np.frombuffer(row.moved, "<f2").astype(np.float32).reshape(-1, CLASSES)
            weights[row.piece * CHUNK:row.piece * CHUNK + len(moved)] += moved
        weights = weights.copy()
        shared.unpersist()
    return weights


def _class_scores(shared, words_: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for one, row in _single(batches):
            ids, sizes, _, vocab, shapes = _block(row)
            cls, ends, logs = words_.classes(vocab, shapes), np.cumsum(sizes), np.zeros(len(sizes))
            # whole documents, about SCORED tokens at a time
            first = 0
            while first < len(sizes):
                begin = ends[first] - sizes[first]
                last = max(first + 1, int(np.searchsorted(ends, begin + SCORED, side="right")))
                part, lengths = ids[begin:ends[last - 1]], sizes[first:last]
                rows, target, of_token = features(part, lengths, vocab, cls), cls[part], np.zeros(len(part))
                for at in range(0, len(part), MINIBATCH):
                    some = slice(at, at + MINIBATCH)
                    of_token[some] = log_class(weights, rows[some], target[some])
                logs[first:last] = np.add.reduceat(of_token, np.cumsum(lengths) - lengths)
                first = last
            kept = [one.column(c) for c in ("block", "docs", "folds", "sizes", "ids")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([cls.astype(np.uint8).tobytes()], pa.binary()), pa.array([logs.tolist()], pa.list_(pa.float64()))],
                names=["block", "docs", "folds", "sizes", "ids", "classes", "logs"])

    return run


def _score(words_: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, row in _single(batches):
            sizes, fold = np.array(row["sizes"], np.int64), np.array(row["folds"], np.int64)
            ids, cls = _inflated(row["ids"], int(sizes.sum())), np.frombuffer(row["classes"], np.uint8)
            counts, some = np.zeros(len(cls), np.int64), np.frombuffer(row["counts"] or b"", "<i8")
            counts[:len(some)] = some
            base = np.log10((counts + ADDED) / (words_.n + ADDED * (words_.v + 1)))
            begins = np.cumsum(sizes) - sizes
            logs = np.array(row["logs"]) + np.add.reduceat(words_.log_in_class(cls, counts)[ids], begins)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["docs"], one.schema.field("docs").type.value_type), pa.array(fold == 0), pa.array(sizes),
                 pa.array(np.add.reduceat((counts > 0)[ids].astype(np.int64), begins)),
                 pa.array(np.full(len(sizes), words_.n)),
                 pa.array(np.add.reduceat(base[ids], begins)), pa.array(logs / np.log(10))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(documents: DataFrame) -> DataFrame:
    """Train on the documents outside fold 0 and score all of ``documents`` (doc_id, text)."""
    blocks = staged(encode(documents), "lm-blocks")
    entries = blocks.select("block", "vocab", "shapes", "train").mapInArrow(
        _entries, "block long, at int, token long, shape int, n long")
    counts = staged(
        entries.where("n > 0").groupBy("token").agg(F.first("shape").alias("shape"), F.sum("n").alias("c")), "lm-counts")
    words_ = vocabulary(counts)
    weights = train(blocks, words_)
    # entries without a count in training are left out and read as 0
    known = entries.select("block", "at", "token").join(counts.select("token", "c"), "token")
    packed = known.select("block", "at", "c").groupBy("block").applyInPandas(_packed, "block long, counts binary")
    shared = documents.sparkSession.sparkContext.broadcast(weights)
    kind = documents.schema["doc_id"].dataType.simpleString()
    classed = blocks.select("block", "docs", "folds", "sizes", "ids", "vocab", "shapes").mapInArrow(
        _class_scores(shared, words_),
        f"block long, docs array<{kind}>, folds array<int>, sizes array<long>, ids binary, classes binary, logs array<double>")
    return classed.join(packed, "block", "left").drop("block").mapInArrow(
        _score(words_),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
