"""HyperMinHash groups against brute force."""

import random
from itertools import combinations

import pytest
from llm_cases import WORD, empty_frame, lower, odd_frame, sentence, vocabulary

from coocatlas.llm import hyperminhash


def shingles(text):
    w = WORD.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(draw, words, text, n):
    w = text.split()
    for _ in range(n):
        at = draw.randrange(len(w))
        change = draw.choice("rid")
        if change == "r":
            w[at] = draw.choice(words)
        elif change == "i":
            w.insert(at, draw.choice(words))
        else:
            del w[at]
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    """Groups whose members lie on both sides of the threshold, around a shared common passage."""
    draw, words = random.Random(seed), vocabulary(seed)
    passage = sentence(draw, words, 40)
    texts = []
    for _ in range(6):
        origin = sentence(draw, words, 120)
        texts += [origin] * 3 + [edited(draw, words, origin, draw.randint(1, 7)) for _ in range(25)]
    texts += [passage + " " + sentence(draw, words, 60) for _ in range(20)] + ["few words", "Few Words", "", None, "a b c d"]
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    found = hyperminhash.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows)


def test_odd_rows(spark):
    frame = odd_frame(spark)
    found = hyperminhash.components(frame).collect()
    assert len(found) == frame.count()
    assert {r.component_id for r in found if r.doc_id in (5, 6, 7)} == {5}
    kept = hyperminhash.deduplicate(frame)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(5) == 1 and 6 not in ids and 7 not in ids and {0, 1, 2, 3, 4, 8} <= set(ids)


def test_empty_table(spark):
    assert hyperminhash.components(empty_frame(spark)).collect() == []
    assert hyperminhash.deduplicate(empty_frame(spark)).collect() == []
