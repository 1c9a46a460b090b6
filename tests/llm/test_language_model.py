"""Counts and base scores against brute force; the model on held-out text."""

import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
from llm_cases import WORD, empty_frame, lower, odd_frame, vocabulary

from coocatlas.llm import maxent_lm


def test_scores(spark):
    """Every word is followed by one of few others, which the model must learn and the base cannot."""
    draw, words = random.Random(7), vocabulary(7, 60)
    after = {w: [draw.choice(words) for _ in range(2)] for w in words}
    rows = []
    for i in range(400):
        w = [draw.choice(words)]
        for _ in range(draw.randint(20, 120)):
            w.append(draw.choice(after[w[-1]]))
        rows.append((i, " ".join(w)))
    found = maxent_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in rows}
    training = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for i in training for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(rows)
    for r in found:
        assert (r.held_out, r.n_tokens, r.train_tokens) == (r.doc_id not in training, len(tokens[r.doc_id]), n)
        assert r.n_known == sum(counts[w] > 0 for w in tokens[r.doc_id])
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[r.doc_id])
        assert math.isclose(base, r.base_score, rel_tol=1e-9)
    held = [r for r in found if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark):
    frame = odd_frame(spark)
    found = maxent_lm.score(frame).collect()
    assert len(found) == frame.count() and all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert [r.n_tokens for r in found if r.doc_id == 0] == [1]


def test_empty_table(spark):
    assert maxent_lm.score(empty_frame(spark)).collect() == []


def test_memory_of_a_task_is_that_of_one_block(monkeypatch):
    """Words are found a part at a time, and blocks of one batch are opened one by one."""
    draw, words = random.Random(3), vocabulary(3, 300)
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 900))) for _ in range(60)] + [None, ""]
    batch = pa.record_batch({"doc_id": pa.array(range(62)), "text": pa.array(texts), "fold": pa.array([k % 10 for k in range(62)], pa.int32())})
    monkeypatch.setattr(maxent_lm.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    sizes = []
    found = maxent_lm.words
    monkeypatch.setattr(maxent_lm, "words", lambda part: sizes.append(part.nbytes) or found(part))
    whole = [b.to_pydict() for b in maxent_lm._encode(iter([batch]))]
    monkeypatch.setattr(maxent_lm, "WORD_BYTES", 20_000)
    sizes.clear()
    parted = [b.to_pydict() for b in maxent_lm._encode(iter([batch]))]
    assert parted == whole and len(sizes) > 5 and max(sizes) < 30_000
    blocks = pa.Table.from_batches(list(maxent_lm._encode(iter([batch.slice(k, 1) for k in range(62)])))).combine_chunks().to_batches()
    assert [len(b) for b in blocks] == [62]
    assert all(one.num_rows == 1 for one, _ in maxent_lm._single(iter(blocks)))
