"""The manifest against a plain hash tree."""

import random
from hashlib import sha256
from zlib import crc32

import pytest
from llm_cases import empty_frame, odd_documents
from pyspark.sql import functions as F

from coocatlas.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row, one tree at a time."""
    def tree(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i:i + 2])) for i in range(0, len(levels[-1]), 2)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            run = [level[j] for j in (i - i % 2, i - i % 2 + 1) if j < len(level)]
            yield i % 2, run[:i % 2] + run[i % 2 + 1:]
            i //= 2

    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = {v: sorted((r for r in rows if r[2] == v), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for v in langs}
    trees = {v: tree([leaf_of(r) for r in groups[v]]) for v in langs}
    crown = tree([trees[v][-1][0] for v in langs])
    out = []
    for k, v in enumerate(langs):
        for i, r in enumerate(groups[v]):
            steps = [*path(trees[v], i), *path(crown, k)]
            bad = r[0] is not None and crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            digest = leaf_of((*r[:3], r[3] + 1, r[4])) if bad else leaf_of(r)
            for place, siblings in steps:
                digest = h("".join(siblings) + digest if place else digest + "".join(siblings))
            root = crown[-1][0]
            out.append((r[0], leaf_of(r), trees[v][-1][0], root, h("".join(s for _, run in steps for s in run)), digest, digest == root))
    return sorted(out, key=repr)


def audited(frame, **how):
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.manifest(frame, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, where, **how)
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("n,langs,bits", [(1, 1, 10), (2, 1, 1), (37, 3, 2), (700, 9, 2), (3500, 2, 10)])
def test_against_a_plain_tree(spark, n, langs, bits):
    draw = random.Random(n)
    rows = [(i * 3 - 50, f"s{i % 4}", draw.choice([None, "", "en", "é", "zh", "a", "b", "c", "d"][:langs]),
             draw.choice([None, 5, 2**63 - 1]), draw.choice([None, "", "é中\U0001f600", "x" * i])) for i in range(n)]
    frame = spark.createDataFrame(draw.sample(rows, n), SCHEMA).repartition(5)
    assert audited(frame, bits=bits) == plain(rows)


def test_ties_repeats_nulls_and_extra_columns(spark):
    rows = [(None, "s", "en", 1, "a")] * 3 + [(7, "s", "en", 1, "b")] * 9 + [(7, "s", "en", 2, "c"), (8, None, None, None, None)]
    frame = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA + ", seq string, idx string, block int")
    assert audited(frame, bits=1) == plain(rows)
    odd = spark.createDataFrame(odd_documents(), "doc_id long, text string, lang string, n_chars long, source string, found string, m string, failures string, key string")
    assert audited(odd, bits=2) == plain([(r[0], r[4], r[2], r[3], r[1]) for r in odd_documents()])


def test_empty(spark):
    frame = empty_frame(spark).withColumns({"source": F.lit("s"), "n_chars": F.lit(1)})
    assert merkle.manifest(frame).count() == 0


def test_any_key_group_and_fields(spark):
    frame = spark.createDataFrame([("p", 1, 2.5), ("q", 1, 3.5), ("r", 2, None)], "id string, part int, value double")
    found = {r.id: r for r in merkle.manifest(frame, key="id", group="part", fields=("id", "value")).collect()}
    assert found["p"].subroot == found["q"].subroot != found["r"].subroot and all(r.verified for r in found.values())
    assert found["r"].leaf == h("1:r-")
