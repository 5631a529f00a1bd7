"""Quality classifier: supervised subword embeddings.

A text's features are its words, pairs of neighbouring words (pairs of equal words count once more, together) and runs
of three and four bytes, each hashed to a bucket with a learned vector. The vectors are averaged over the document and a softmax layer turns the average into class
probabilities; everything is trained together by stochastic gradient descent in numpy.

Learning uses a bounded sample: ``max_labelled`` labelled documents (an even choice by digest of the id) of at most
``max_chars`` characters each, never those of the held-out fold. The model is fitted inside one task. As the output is
linear in the average before the softmax, scoring needs one number per bucket: its vector's effect on the margin.

Defined results: a null or empty text has no feature and gets the output bias's score; without labels every score is
0.5; repeated rows are scored one by one; an empty table gives no rows; other columns are never inputs.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import fold_of, table
from turnwise.llm.registry import query
from turnwise.llm.rules import labelled_sample

BUCKETS = 1 << 17
_MIX = np.uint32(2654435761)


def _bucket(values: np.ndarray, kind: int) -> np.ndarray:
    """Bucket of 32-bit values; every kind of feature has its own scatter."""
    mixed = (values ^ np.uint32(kind * 0x9E3779B9 & 0xFFFFFFFF)) * _MIX
    return ((mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    """Buckets of all features of a text, repeats included."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    hashed = np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words))
    pairs = hashed[:-1] * np.uint32(31) + hashed[1:]
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    three = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:] if len(raw) > 2 else raw[:0]
    four = three[:-1] << np.uint32(8) | raw[3:] if len(raw) > 3 else raw[:0]
    doubled = np.zeros(int((hashed[:-1] == hashed[1:]).sum()), np.uint32)  # a word said twice in a row, whichever word
    return np.concatenate([_bucket(hashed, 1), _bucket(pairs, 2), _bucket(three, 3), _bucket(four, 4),
                           _bucket(doubled, 5)])


@dataclass
class SubwordModel:
    """effect: what a feature in a bucket adds to the margin of label 1, before averaging; bias: the margin of no text."""

    effect: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        mean = float(self.effect[found].mean()) if len(found) else 0.0
        return float(1 / (1 + np.exp(-np.clip(mean + self.bias, -30, 30))))


def fit(texts: list[str | None], y: np.ndarray, size: int = 12, epochs: int = 8, rate: float = 0.6,
        seed: int = 3) -> SubwordModel:
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / size, 1 / size, (BUCKETS, size)).astype(np.float32)
    output, bias = np.zeros((2, size), np.float32), np.zeros(2, np.float32)
    known = np.zeros(BUCKETS, bool)
    held = []
    for t in texts:
        ids, counts = np.unique(features(t), return_counts=True)
        known[ids] = True
        held.append((ids.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    steps, done = max(1, epochs * len(held)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(held)):
            ids, share = held[i]
            mean = share @ vectors[ids]
            margin = output @ mean + bias
            p = np.exp(margin - margin.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = p @ output
            output -= step * np.outer(p, mean)
            bias -= step * np.float32(0.1) * p
            vectors[ids] -= step * np.outer(share, back) * np.float32(8)
            done += 1
    vectors[~known] = 0  # never seen: says nothing
    return SubwordModel((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for batch in batches:
        texts += batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
    model = fit(texts, np.array(labels, np.int64))
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.effect.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["effect", "bias"])


def train_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 4_000, max_chars: int = 100_000,
                  fold: tuple[int, int] = (4, 2)) -> SubwordModel:
    """Fit on labelled documents outside the fold crc32(doc_id) mod ``fold[0]`` = ``fold[1]``."""
    usable = labels.select("doc_id", "quality").filter(fold_of(F.col("doc_id"), fold[0]) != fold[1])
    sample = F.broadcast(labelled_sample(usable, "quality", max_labelled, "quality"))
    rows = docs.select("doc_id", "text").join(sample, "doc_id") \
        .filter(F.length(F.coalesce("text", F.lit(""))) <= max_chars)
    held = rows.repartition(1).sortWithinPartitions("doc_id", "text").select("text", "label") \
        .mapInArrow(_fit_batches, "effect binary, bias double").first()
    if held is None:  # nothing was labelled
        return fit([], np.zeros(0, np.int64))
    return SubwordModel(np.frombuffer(held["effect"], np.float32), held["bias"])


def quality_score(text: Column, model: SubwordModel) -> Column:
    """Probability of quality label 1."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(features(t)) for t in texts], dtype="float64")

    return score(text)


@query("op4_subword_quality")
def op4_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"),
                       quality_score(F.col("text"), model).alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
