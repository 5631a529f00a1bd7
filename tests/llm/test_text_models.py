import math
import random
import zlib

import numpy as np
import pytest
from made_texts import prose
from pyspark.sql import functions as F

from turnwise.llm import quality_model, toxicity


def test_fit_learns_a_pair_of_words_that_are_neutral_alone():
    rng = random.Random(1)
    docs, y = [], []
    for i in range(1600):
        a, b = i % 2, (i // 2) % 2
        docs.append(toxicity.term_buckets(" ".join(prose(rng, 12, 300) + ["insult"] * a + ["group"] * b)))
        y.append(int(a == b))
    model = toxicity.fit(docs[:800], np.array(y[:800]))
    right = sum((model.score(d) >= 0.5) == k for d, k in zip(docs[800:], y[800:]))
    assert right >= 0.98 * 800


def plain_margin(model, text):
    """The machine's score by loops over pairs of terms."""
    place = {int(b): i for i, b in enumerate(model.bucket)}
    at = [place[int(b)] for b in toxicity.term_buckets(text) if int(b) in place]
    pairs = sum(float(np.dot(model.factors[i].astype(float), model.factors[j].astype(float)))
                for n, i in enumerate(at) for j in at[n + 1:])
    return model.bias + sum(float(model.weight[i]) for i in at) + pairs


def plain_quality(model, text):
    """The averaged margin feature by feature."""
    data = (text or "").encode()
    words = data.split()
    found = []
    for w in words:
        found.append((zlib.crc32(w), 1))
    for a, b in zip(words, words[1:]):
        found.append(((zlib.crc32(a) * 31 + zlib.crc32(b)) % 2 ** 32, 2))
        if a == b:
            found.append((0, 5))
    for n, kind in ((3, 3), (4, 4)):
        found += [(int.from_bytes(data[i:i + n], "big"), kind) for i in range(len(data) - n + 1)]
    total = 0.0
    for value, kind in found:
        mixed = ((value ^ (kind * 0x9E3779B9 % 2 ** 32)) * 2654435761) % 2 ** 32
        total += float(model.effect[(mixed ^ (mixed >> 15)) % quality_model.BUCKETS])
    return model.bias + (total / len(found) if found else 0.0)


def test_scores_match_plain_loops(spark):
    docs, labels = labelled(spark, 9, 120)
    docs = docs.union(spark.createDataFrame([(900, None), (901, ""), (902, "one one one"), (903, "é")], docs.schema))
    fm, sub = toxicity.train_toxicity(docs, labels), quality_model.train_quality(docs, labels)
    held = fm.load()
    rows = docs.select("text", toxicity.toxicity_score(F.col("text"), fm).alias("t"),
                       quality_model.quality_score(F.col("text"), sub).alias("q")).collect()
    assert len(rows) == 124
    for r in rows:
        assert r["t"] == pytest.approx(1 / (1 + math.exp(-plain_margin(held, r["text"]))), abs=1e-5)
        assert r["q"] == pytest.approx(1 / (1 + math.exp(-plain_quality(sub, r["text"]))), abs=1e-5)


def labelled(spark, seed=3, n=500):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.2)
        words = prose(rng, rng.randrange(20, 120))
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["grumbler", "blockhead", "nitwit"]))
        junk = int(rng.random() < 0.3)
        text = " ".join(w.upper() + "!!" if junk else w for w in words)
        docs.append((i, text))
        labels.append((i, 1 - junk, toxic))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    fm = toxicity.train_toxicity(docs, labels)
    scored = docs.join(labels, "doc_id").select(
        "doc_id", "toxic", "quality", toxicity.toxicity_score(F.col("text"), fm).alias("t"),
        quality_model.quality_score(F.col("text"), quality_model.train_quality(docs, labels)).alias("q"),
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("out5"),
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("out4")).collect()
    out5, out4 = [r for r in scored if r["out5"]], [r for r in scored if r["out4"]]
    assert len(out5) > 50 and len(out4) > 50
    assert np.mean([(r["t"] >= 0.5) == bool(r["toxic"]) for r in out5]) >= 0.97
    assert np.mean([(r["q"] >= 0.7) == bool(r["quality"]) for r in out4]) >= 0.97


def test_held_out_labels_are_never_read(spark):
    docs, labels = labelled(spark)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    turned = labels.withColumn("toxic", F.when(fold % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))) \
        .withColumn("quality", F.when(fold % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = toxicity.train_toxicity(docs, labels), toxicity.train_toxicity(docs, turned)
    a, b = a.load(), b.load()
    assert a.bias == b.bias and np.array_equal(a.weight, b.weight) and np.array_equal(a.factors, b.factors)
    a, b = quality_model.train_quality(docs, labels), quality_model.train_quality(docs, turned)
    assert a.bias == b.bias and np.array_equal(a.effect, b.effect)


def test_edges(spark, documents, no_documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    fm, sub = toxicity.train_toxicity(documents, labels), quality_model.train_quality(documents, labels)
    rows = documents.select(toxicity.toxicity_score(F.col("text"), fm).alias("t"),
                            quality_model.quality_score(F.col("text"), sub).alias("q")).collect()
    assert len(rows) == documents.count()
    assert all(0 <= r["t"] < 1e-6 and r["q"] == 0.5 for r in rows)
    assert no_documents.select(toxicity.toxicity_score(F.col("text"), fm)).count() == 0
