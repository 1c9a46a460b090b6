"""Suffix search against brute force over windows."""

import random
import re

from llm_cases import empty_frame, lower, odd_frame, sentence, vocabulary

from coocatlas.llm import suffix_search

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items):
    w, hit, found = WORDS.findall(lower(text)), set(), []
    for name, item in items:
        v = WORDS.findall(lower(item))
        size = min(13, len(v))
        windows = {tuple(v[i:i + size]) for i in range(len(v) - size + 1)} if v else set()
        at = [i for i in range(len(w) - size + 1) if tuple(w[i:i + size]) in windows] if v else []
        if at:
            found.append(name)
            hit.update(j for i in at for j in range(i, i + size))
    return len(w), len(hit), sorted(found)


def tables(spark):
    draw, words = random.Random(3), vocabulary(3)
    items = [(f"q{i}", sentence(draw, words, draw.choice([3, 12, 13, 14, 40]))) for i in range(30)]
    items += [("none", None), ("blank", " .,"), ("case", items[2][1].upper().replace(" ", ", "))]
    texts = [None, "", items[3][1]]
    for _ in range(120):
        parts = [sentence(draw, words, draw.randint(5, 60))]
        if draw.random() < 0.6:
            v = draw.choice(items[:30])[1].split()
            cut = draw.randint(0, len(v) - 1)
            parts += [" ".join(v[cut:]) if draw.random() < 0.5 else " ".join(v), sentence(draw, words, 4)]
        texts.append("\n".join(parts))
    rows = list(enumerate(texts))
    return rows, items, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(
        items, "item_id string, text string")


def test_search_equals_brute_force(spark):
    rows, items, documents, benchmark = tables(spark)
    found = {r.doc_id: r.found for r in suffix_search.search(documents, benchmark).collect()}
    for i, text in rows:
        assert (found[i].n_words, found[i].n_hit, sorted(found[i]["items"])) == brute(text, items), i


def test_clean_keeps_the_rest(spark):
    rows, items, documents, benchmark = tables(spark)
    kept = {r.doc_id for r in suffix_search.clean(documents, benchmark).collect()}
    counts = {i: brute(t, items) for i, t in rows}
    assert kept == {i for i, (n, hit, _) in counts.items() if not (hit and 20 * hit >= n)}


def test_odd_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    some = spark.createDataFrame([(None, "one two"), ("x", None)], "item_id string, text string")
    frame = odd_frame(spark)
    kept = suffix_search.clean(frame, none)
    assert kept.columns == frame.columns and kept.count() == frame.count()
    assert suffix_search.clean(frame, some).count() == frame.count() - 1
    assert suffix_search.clean(empty_frame(spark), some).count() == 0
