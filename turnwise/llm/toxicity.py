"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words, the first five letters of longer words, and marks for words and
prefixes that occur twice or more. Each hashes to one of 2^18 buckets. The machine's score is a bias, a weight per term
and the inner product of the factors of every pair of terms, so an insult together with a group it is aimed at can count
for more than the two apart, which additive weights can't say.

Learning uses a bounded sample: ``max_labelled`` labelled documents (an even choice by digest of the id) of at most
``max_chars`` characters each, never those of the held-out fold. Every term of the sample is fitted, also those that say
nothing alone, as pairs of them may: first the terms tied to a class by themselves, then all together, where the others
take steps shortened by the number of a text's terms, so long texts aren't learned by heart. The model is fitted inside
one task, which writes it (2^18 terms at most, 10 MB) to the folder all executors share; scoring tasks read it there, so
it never passes through the driver. Scoring covers every row.

Defined results: a null or empty text has no term and gets the bias's score; without labels of both classes every score
is the share of label 1 (0 without labels); repeated rows are scored one by one; an empty table gives no rows; other
columns pass through untouched and are never inputs.
"""
from __future__ import annotations

import io
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import fold_of, opened, table
from turnwise.llm.registry import query
from turnwise.llm.rules import labelled_sample
from turnwise.session import scratch_dir

BUCKETS = 1 << 18
PREFIX = 5
_WORD = re.compile(r"[^\W_]+")


def term_buckets(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text's terms."""
    counts = Counter(_WORD.findall((text or "").lower()))
    prefixes: Counter[str] = Counter()
    for word, n in counts.items():
        if len(word) > PREFIX:
            prefixes[word[:PREFIX]] += n
    terms = [w for w in counts]
    terms += [w + "+" for w, n in counts.items() if n > 1]
    terms += [p + "*" for p in prefixes]
    terms += [p + "*+" for p, n in prefixes.items() if n > 1]
    mask = BUCKETS - 1
    return np.unique(np.fromiter((zlib.crc32(t.encode()) & mask for t in terms), np.int32, len(terms)))


@dataclass
class FactorizationMachine:
    """bias, and by term: bucket (ascending), weight, factors."""

    bias: float
    bucket: np.ndarray
    weight: np.ndarray
    factors: np.ndarray

    def score(self, buckets: np.ndarray) -> float:
        at = np.searchsorted(self.bucket, buckets)
        at[at == len(self.bucket)] = 0
        at = at[self.bucket[at] == buckets] if len(self.bucket) else at[:0]
        return float(1 / (1 + np.exp(-np.clip(self.margin(at), -30, 30))))

    def margin(self, at: np.ndarray) -> float:
        v = self.factors[at]
        total = v.sum(0)
        return self.bias + self.weight[at].sum() + 0.5 * float((total * total - (v * v).sum(0)).sum())


def _chosen_terms(docs: list[np.ndarray], y: np.ndarray, min_docs: int, min_z: float) -> np.ndarray:
    """Buckets in at least ``min_docs`` documents whose share differs between the classes by ``min_z`` deviations."""
    seen = [np.bincount(np.concatenate([d for d, k in zip(docs, y) if k == c] or [np.zeros(0, np.int32)]),
                        minlength=BUCKETS) for c in (0, 1)]
    n = [max(1, int((y == c).sum())) for c in (0, 1)]
    share = (seen[0] + seen[1]) / (n[0] + n[1])
    spread = np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1])) + 1e-12
    z = (seen[1] / n[1] - seen[0] / n[0]) / spread
    return np.flatnonzero((seen[0] + seen[1] >= min_docs) & (np.abs(z) >= min_z)).astype(np.int32)


def fit(docs: list[np.ndarray], y: np.ndarray, rank: int = 8, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4,
        min_docs: int = 5, min_z: float = 4.0, seed: int = 7, full_steps: int = 5) -> FactorizationMachine:
    """Stochastic gradient descent with per-parameter steps on the logistic loss; rarer labels weigh more.

    ``epochs`` over the terms that are tied to a class alone, then as many over all terms of ``docs``. In these the other
    terms take ``full_steps / terms of the document`` of a step, the whole one where that is more.
    """
    ones = int(y.sum())
    if ones in (0, len(y)):
        share = np.clip(ones / max(1, len(y)), 1e-9, 1 - 1e-9)
        none = np.zeros(0, np.int32)
        return FactorizationMachine(float(np.log(share / (1 - share))), none, np.zeros(0), np.zeros((0, rank)))
    bucket = np.unique(np.concatenate(docs)).astype(np.int32)
    alone = np.isin(bucket, _chosen_terms(docs, y, min_docs, min_z))
    rows = [np.searchsorted(bucket, d) for d in docs]
    rng = np.random.default_rng(seed)
    bias, past_bias = 0.0, 1.0
    held = np.hstack([np.zeros((len(bucket), 1)), rng.normal(0, 0.01, (len(bucket), rank))])  # weight, factors
    past = np.ones_like(held)
    class_weight = (1.0, min(4.0, (len(y) - ones) / ones))
    for every_term in (False, True):
        used = rows if every_term else [at[alone[at]] for at in rows]
        for _ in range(epochs):
            for i in rng.permutation(len(used)):
                at, label = used[i], int(y[i])
                own = held.take(at, 0)
                total = own.sum(0)
                margin = bias + total[0] + 0.5 * (total[1:] @ total[1:] - np.vdot(own[:, 1:], own[:, 1:]))
                pull = (1 / (1 + np.exp(-min(30.0, max(-30.0, margin)))) - label) * class_weight[label]
                past_bias += pull * pull
                bias -= rate * pull / np.sqrt(past_bias)
                if len(at):
                    rates = np.where(alone.take(at), rate, rate * min(1.0, full_steps / len(at)))
                    step = total - own
                    step[:, 0] = 1.0
                    step *= pull
                    step += decay * own
                    seen = past.take(at, 0)
                    seen += step * step
                    past[at] = seen
                    step *= rates[:, None]
                    step /= np.sqrt(seen)
                    held[at] = own - step
    return FactorizationMachine(float(bias), bucket, held[:, 0].copy(), held[:, 1:].copy())


@dataclass(frozen=True)
class StoredMachine:
    """A fitted machine in the shared folder."""

    path: str

    def load(self) -> FactorizationMachine:
        fs, local = opened(self.path)
        with fs.open_input_file(local) as source, np.load(io.BytesIO(source.read())) as held:
            return FactorizationMachine(float(held["bias"]), held["bucket"], held["weight"], held["factors"])


def _fit_into(folder: str):
    """Fit on (text, label) and write the machine, under a name of its own for each attempt; the name is what returns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, labels = [], []
        for batch in batches:
            docs += [term_buckets(t) for t in batch.column(0).to_pylist()]
            labels += batch.column(1).to_pylist()
        fm = fit(docs, np.array(labels, np.int64))
        out = io.BytesIO()
        np.savez(out, bias=fm.bias, bucket=fm.bucket, weight=fm.weight.astype(np.float32),
                 factors=fm.factors.astype(np.float32))
        path = f"{folder}/{uuid.uuid4().hex}.npz"
        fs, local = opened(folder)
        fs.create_dir(local, recursive=True)
        with fs.open_output_stream(opened(path)[1], compression=None) as target:
            target.write(out.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["model"])

    return run


def train_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 8_000, max_chars: int = 200_000,
                   held_out_of: int = 5) -> FactorizationMachine | StoredMachine:
    """Fit on labelled documents outside the fold crc32(doc_id) mod ``held_out_of`` = 0."""
    usable = labels.select("doc_id", "toxic").filter(fold_of(F.col("doc_id"), held_out_of) != 0)
    sample = F.broadcast(labelled_sample(usable, "toxic", max_labelled, "toxicity"))
    rows = docs.select("doc_id", "text").join(sample, "doc_id") \
        .filter(F.length(F.coalesce("text", F.lit(""))) <= max_chars)
    written = rows.repartition(1).sortWithinPartitions("doc_id", "text").select("text", "label") \
        .mapInArrow(_fit_into(f"{scratch_dir(docs.sparkSession)}/models"), "model string").first()
    return fit([], np.zeros(0, np.int64)) if written is None else StoredMachine(written["model"])  # none: no labels


def toxicity_score(text: Column, model: FactorizationMachine | StoredMachine) -> Column:
    """Probability that the text is toxic. A task reads a stored machine once."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fm = model.load() if isinstance(model, StoredMachine) else model
        for texts in batches:
            yield pd.Series([fm.score(term_buckets(t)) for t in texts], dtype="float64")

    return score(text)


@query("op10_fm_toxicity")
def op10_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"),
                       toxicity_score(F.col("text"), model).alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
