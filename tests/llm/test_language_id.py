"""Language votes against a plain version, held-out accuracy, and odd rows."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from llm_cases import empty_frame, odd_frame
from pyspark.sql import functions as F

from coocatlas.llm import language_id
from coocatlas.llm.tables import read

SF_DIR = "/root/testdata/sf0.01"


def spelled(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def plain(train, texts):
    """Prediction and score of each text, by dictionaries."""
    counts = defaultdict(Counter)
    for text, lang in train:
        for word in spelled(text):
            counts[0][word, lang] += 1
            for n in range(1, 6):
                marked = f" {word} "
                for i in range(len(marked) - n + 1):
                    if n > 1 or marked[i] != " ":
                        counts[n][marked[i:i + n], lang] += 1
    labels = Counter(lang for _, lang in train)
    names, a = sorted(labels), language_id.SMOOTHING
    size = {(n, lang): sum(c for (_, at), c in counts[n].items() if at == lang) + a * (len(counts[n]) + 1)
            for n in range(6) for lang in names}

    def log(n, key):
        return [math.log((counts[n][key, lang] + a) / size[n, lang]) for lang in names]

    def vote(word):
        if any((word, lang) in counts[0] for lang in names):
            return log(0, word)
        for n in range(5, 0, -1):
            marked = f" {word} "
            known = [g for i in range(len(marked) - n + 1) if any(((g := marked[i:i + n]), lang) in counts[n] for lang in names)]
            if known:
                return [sum(v) / len(known) for v in zip(*[log(n, g) for g in known], strict=True)]
        return None

    out = []
    for text in texts:
        votes = [v for v in map(vote, spelled(text)) if v]
        if not votes:
            out.append(("und", 0.0))
            continue
        total = [sum(v) + math.log(labels[lang] / len(train)) for v, lang in zip(zip(*votes, strict=True), names, strict=True)]
        best = max(range(len(names)), key=lambda i: total[i])
        scale = min(len(votes), language_id.EVIDENCE) / len(votes)
        weights = [math.exp((t - total[best]) * scale) for t in total]
        out.append((names[best], 1 / sum(weights)))
    return out


def prose(draw, letters, n):
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 6))) for _ in range(n))


def test_against_dictionaries(spark):
    draw = random.Random(9)
    kinds = {"a": "abcdefée", "b": "cdefghi", "é": "éüßghiab", "": "жзийab"}
    train = [(prose(draw, letters, draw.randint(1, 30)), lang) for lang, letters in kinds.items() for _ in range(30)]
    texts = [prose(draw, "abcdefghié", draw.randint(1, 12)) for _ in range(200)]
    texts += [prose(draw, "жзий", 5), "xyz", "漢字", "É. Ü! 12_a3", "12 !!", "", None, "x" * 20_000 + " abc", "A" * 3]
    model = language_id.learn(spark.createDataFrame(train, "text string, lang string").repartition(4))
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    found = {r.i: (r.lang_pred, r.score) for r in language_id.predict(frame, model).collect()}
    for i, (lang, score) in enumerate(plain(train, texts)):
        assert found[i][0] == lang, texts[i]
        assert found[i][1] == pytest.approx(score, abs=1e-4)


def test_a_bounded_model_keeps_the_commonest(spark):
    rows = [("the " * 50 + "of " * 30 + prose(random.Random(i), "abcdefgh", 5), "en") for i in range(40)]
    rows += [("der " * 50 + "von " * 30 + prose(random.Random(i), "rstuvwxy", 5), "de") for i in range(40)]
    model = language_id.learn(spark.createDataFrame(rows, "text string, lang string"), entries=8)
    assert 4 <= len(model.tables[0].keys) <= 8 and all(len(t.lang) <= 8 for t in model.tables)
    frame = spark.createDataFrame([("the of",), ("der von",)], "text string")
    assert [r.lang_pred for r in language_id.predict(frame, model).collect()] == ["en", "de"]


def test_odd_rows(spark):
    never, frame = F.lit(False), odd_frame(spark)
    found = language_id.identify(frame, never).collect()
    assert len(found) == frame.count() and {r.lang_pred for r in found} == {"en", "und"}
    assert all(0 <= r.score <= 1 and (r.score == 0) == (r.lang_pred == "und") for r in found)
    assert {r.lang_pred for r in found if r.doc_id in (0, 1, 2)} == {"und"}
    assert language_id.identify(empty_frame(spark), never).count() == 0
    unlabelled = language_id.identify(frame.withColumn("lang", F.lit(None).cast("string")), never).collect()
    assert len(unlabelled) == frame.count() and {r.lang_pred for r in unlabelled} == {"und"}
    clash = frame.withColumnRenamed("n", "score").withColumnRenamed("found", "lang_pred").withColumnRenamed("m", "held_out")
    assert language_id.identify(clash, never).count() == frame.count()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables absent")
def test_held_out_accuracy(spark):
    docs = read(spark, SF_DIR, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = language_id.identify(docs, fold).where("held_out").join(docs, "doc_id")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("lang")).head()
    assert n > 200 and right >= 0.98 * n
