"""Small tables with nulls, blanks, ties, repeats and clashing names, and plain helpers."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "doc_id long, text string, lang string, n long, d1 string, found string, m string, failures string, key string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def vocabulary(seed=1, size=400):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghiklmnoprstuw") for _ in range(draw.randint(2, 9))) for _ in range(size)]


def sentence(draw, words, n):
    return " ".join(draw.choice(words) for _ in range(n))


def odd_documents():
    draw, words = random.Random(5), vocabulary()
    long = sentence(draw, words, 30_000)
    same = sentence(draw, words, 80)
    texts = [None, "", " \n\t ", "one", "One two", same, same, same.upper(), long, "é 中文 \U0001f600 ok", "a\nb\na\n\n", None]
    ids = [*range(len(texts) - 1), None]
    rows = [(i, t) for i, t in zip(ids, texts, strict=True)] + [(5, same)]
    return [(i, t, "en", 1, "x", "y", None, "z", "k") for i, t in rows]


def odd_frame(spark):
    return spark.createDataFrame(odd_documents(), EXTRA).repartition(3)


def empty_frame(spark):
    return spark.createDataFrame([], EXTRA)
