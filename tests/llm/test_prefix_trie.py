"""The trie against one built from whole rebuilt texts."""

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from coocatlas.llm import ordering, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, digest(t[1], t[2])))
    members = defaultdict(list)
    for conv, turns in own.items():
        h, base = crc32(str(conv).encode()) % 6, conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        seq = tuple(t[1:] for t in [*own.get(base, [])[:h], *turns[h:]])
        for depth in range(len(seq) + 1):
            members[seq[:depth]].append((conv, len(seq)))
    kids = defaultdict(list)
    for seq in members:
        if seq:
            kids[seq[:-1]].append(seq)
    name = {seq: min(conv for conv, _ in found) for seq, found in members.items()}
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        leaves[seq] = sum(leaves[k] for k in kids[seq]) or 1
        saved[seq] = sum(saved[k] for k in kids[seq]) + (len(members[seq]) - 1) * (len(seq[-1][1]) if seq else 0)
    return sorted((
        name[seq], len(seq), name[seq[:-1]] if seq else None, len(found), len(kids[seq]), leaves[seq], saved[seq],
        sha256(",".join(str(c) for c, n in sorted(found) if n == len(seq)).encode()).hexdigest()) for seq, found in members.items())


def trie(frame):
    conv = F.col("conv_id")
    return prefix_trie.build(frame, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6)


def found(frame):
    return sorted(tuple(r)[:8] for r in trie(frame).collect())


def some_rows(seed, convs, longest, texts):
    draw = random.Random(seed)
    return [(c, t, draw.choice(["user", "assistant", None]), draw.choice(texts))
            for c in convs for t in range(draw.randint(1, longest))]


@pytest.mark.parametrize("seed,texts", [(1, ["a", "bb", "é\U0001f600"]), (2, ["", None, "x"]), (3, [str(i) for i in range(50)])])
def test_against_whole_texts(spark, seed, texts):
    rows = some_rows(seed, [*range(0, 60), *range(-130, -90), *range(205, 260)], 9, texts)
    random.Random(seed).shuffle(rows)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_chunks(spark, monkeypatch):
    """Long conversations, many children and many equal ends, each over several chunks."""
    monkeypatch.setattr(ordering, "CHUNK", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    rows = [(100, t, "user", f"t{t % 7}") for t in range(50)] + [(150, t, "user", f"t{t % 7}") for t in range(41)]
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(7)] + [(c, 0, "user", str(c)) for c in range(300, 340)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == plain(rows)


def test_odd_rows(spark):
    rows = [(5, None, None, None), (5, 1, "user", "a"), (5, 1, "user", "a"), (5, 1, "b", "a"), (None, 1, "user", "z"), (6, None, "", ""),
            (6, 1, "user", "a"), (0, 3, "user", "x" * 30_000), (0, 3, "user", "y"), (7, 0, "user", " \n")]
    frame = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA + ", depth int, nth string, f0 int, chunk int")
    assert found(frame) == plain(rows)
    assert trie(frame.limit(0)).count() == 0
    assert trie(frame.where("conv_id is null")).count() == 0


def test_references_lead_to_the_last_turn(spark):
    rows = some_rows(4, range(0, 40), 6, ["a", "bb", "ccc"])
    own = defaultdict(list)
    for conv, _, role, text in rows:
        own[conv].append((role or "", text or ""))
    for r in trie(spark.createDataFrame(rows, SCHEMA)).where("depth > 0").collect():
        h, base = crc32(str(r.conv_id).encode()) % 6, 0
        assert own[r.ref_conv][r.ref_turn] == [*own[base][:h], *own[r.conv_id][h:]][r.depth - 1]


def test_a_collision_starts_over(spark, monkeypatch):
    rows = some_rows(5, range(30), 5, ["a", "b"])
    tried, bases = [], prefix_trie._bases

    def weak_first(attempt):
        tried.append(attempt)
        return [0, 0, 0] if attempt == 0 else bases(attempt)

    monkeypatch.setattr(prefix_trie, "_bases", weak_first)
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows) and tried == [0, 1]
