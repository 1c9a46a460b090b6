"""Round trip of packed sequences; balance of shards."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_cases import empty_frame, odd_frame, sentence, vocabulary
from tokenizers import Tokenizer

from coocatlas.llm import packing, sharding

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_stretches_hold_equal_tokens(spark):
    """Copies, equal ids and one long document: no task gets much more than its share, none of them loses a piece."""
    draw, words = random.Random(5), vocabulary(2)
    same, long = sentence(draw, words, 120), sentence(draw, words, 3000)
    rows = [(7, same)] * 150 + [(None, same)] * 150 + [(9, long)] + [(i, sentence(draw, words, draw.randint(0, 200))) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    pieces = packing.pack(frame, *PATHS, task_tokens=5000).collect()
    held, most = Counter(), max(p.doc_tokens for p in pieces)
    for p in pieces:
        held[p.sequence_id >> 36] += p.length
    total = sum(held.values())
    assert total == sum(p.doc_tokens for p in pieces if p.start == 0) and len(held) >= total // (5000 + most)
    assert all(n <= 5000 + most for n in held.values())


def test_keys_follow_the_curve(spark):
    """Every cell of a grid has a place of its own, next places are next cells, and packing keeps the order of keys."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.indices((1 << bits,) * dims).reshape(dims, -1).T
        keys = packing.hilbert_key(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
    draw = random.Random(6)
    rows = [(i, sentence(draw, vocabulary(draw.randint(1, 4)), draw.randint(1, 80))) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keys = {r.doc_id: r.key for r in packing.encode(frame, *PATHS).collect()}
    order = [p.doc_id for p in sorted(packing.pack(frame, *PATHS, task_tokens=2000).collect(), key=lambda p: (p.sequence_id, p.offset))]
    assert [keys[d] for d in order] == sorted(keys[d] for d in order)


@pytest.mark.parametrize("odd", [True, False])
def test_pieces_join_to_the_documents(spark, odd):
    draw, words = random.Random(2), vocabulary(2)
    if odd:
        frame = odd_frame(spark)
    else:
        rows = [(i, sentence(draw, words, draw.randint(0, 900)) + draw.choice(["", "  \n", "don't", " 12345", "\u00a0é"])) for i in range(200)]
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tokenizer = Tokenizer.from_file(PATHS[0])
    want = Counter()
    for r in frame.select("doc_id", "text").collect():
        want[(r.doc_id, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]))] += 1
    pieces = packing.pack(frame, *PATHS).collect()
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length
        by_sequence[p.sequence_id].append(p)
        by_document[p.doc_id].append((p.start, p.doc_tokens, tuple(ids.tolist())))
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sum(p.length for p in pieces) == total
    assert len(by_sequence) <= -(-total // 1024) + 8
    single = [k for k, n in Counter(d for d, _ in want.elements()).items() if n == 1]
    for doc, ids in want:
        if doc in single:
            joined = [x for _, _, part in sorted(by_document[doc]) for x in part]
            assert tuple(joined) == ids and {n for _, n, _ in by_document[doc]} == {len(ids)}


def test_shards_are_level_and_keep_copies_together(spark):
    draw, words = random.Random(2), vocabulary(2)
    texts = [sentence(draw, words, draw.randint(1, 300)) for _ in range(500)]
    rows = [(i, draw.choice(texts) if i % 3 else texts[i % 500]) for i in range(1500)] + [(None, None), (1500, "")]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shards=8).collect()
    assert len(found) == len(rows)
    loads, of_text, slots, by_id = Counter(), defaultdict(set), defaultdict(list), dict(rows)
    for r in found:
        text = by_id[r.doc_id]
        raw = (text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        loads[r.shard] += r.size
        of_text[text or ""].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in of_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(loads) <= set(range(8)) and max(loads.values()) - min(loads.values()) <= 64


def test_odd_rows_and_empty_tables(spark):
    assert sharding.shard_documents(odd_frame(spark), 3).count() == odd_frame(spark).count()
    assert sharding.shard_documents(empty_frame(spark), 3).count() == 0
    assert packing.pack(empty_frame(spark), *PATHS).count() == 0
