"""Numbering, running sums and lookups with hot groups, against plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from coocatlas.llm import ordering


def skewed(draw, n):
    """(g, h, o, v): a third of the rows in one group, many with equal order."""
    return [(draw.choice([7, 7, *range(40)]), draw.choice("ab"), draw.choice([None, *range(30)]), draw.randint(0, 9)) for _ in range(n)]


SCHEMA = "g long, h string, o int, v int"


@pytest.mark.parametrize("n", [0, 1, 50, 3000])
def test_numbered(spark, n):
    rows = skewed(random.Random(n), n)
    found = defaultdict(list)
    for r in ordering.numbered(spark.createDataFrame(rows, SCHEMA).repartition(6), ["g", "h"], "o").collect():
        found[r.g, r.h].append((r.nth, -1 if r.o is None else r.o))
    expected = defaultdict(list)
    for g, h, o, _ in rows:
        expected[g, h].append(-1 if o is None else o)
    assert {k: [o for _, o in sorted(v)] for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    assert all(sorted(i for i, _ in v) == list(range(len(v))) for v in found.values())


def test_running(spark, monkeypatch):
    monkeypatch.setattr(ordering, "CHUNK", 8)
    sizes = {1: 100, 2: 3, 3: 8, 4: 9, 5: 17}
    rows = [(g, i, (g * i) % 5 - 2) for g, n in sizes.items() for i in range(n)]
    found = ordering.running(spark.createDataFrame(rows, "g long, i long, v int").repartition(5), "g", "i", {"s": F.col("v"), "n": F.lit(1)})
    for r in found.collect():
        assert (r.s, r.n) == (sum((r.g * k) % 5 - 2 for k in range(r.i + 1)), r.i + 1)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [1, 20, 10**6])
def test_lookup(spark, monkeypatch, how, hot):
    monkeypatch.setattr(ordering, "HOT", hot)
    rows = skewed(random.Random(3), 400)
    table = [(g, h, f"{g}{h}") for g in range(5, 60) for h in "ab" if (g, h) != (9, "a")]
    found = ordering.lookup(spark.createDataFrame(rows, SCHEMA).repartition(3), ["g", "h"], spark.createDataFrame(table, "g long, h string, t string"), how)
    names = {(g, h): t for g, h, t in table}
    expected = [(*r, names.get(r[:2])) for r in rows if how == "left" or r[:2] in names]
    assert sorted(map(repr, map(tuple, found.select("g", "h", "o", "v", "t").collect()))) == sorted(map(repr, expected))
