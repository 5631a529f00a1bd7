"""A training corpus in five stages: toxicity, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a DataFrame; it is
written as Parquet to the shared folder and read back as the next stage's ``docs``, so a lost executor costs at most the
running stage. All but the last return the columns of ``docs``. Nulls, empty tables, repeated rows and further columns
are handled as the operators' docstrings say.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import prepare, stored, table
from turnwise.llm.curriculum import mixed
from turnwise.llm.decontamination import without_items
from turnwise.llm.ngram_join import one_of_each
from turnwise.llm.shards import training_shards
from turnwise.llm.toxicity import toxicity_score, train_toxicity

TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches ``TOXIC_FROM`` go."""
    prepare(spark)
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity_score(F.col("text"), model) < TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at similarity 0.8, the one with the smallest id stays."""
    prepare(spark)
    return one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80 % of a benchmark item's shingles go."""
    prepare(spark)
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for each pass over its source that takes it, in order of training time."""
    prepare(spark)
    return mixed(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each row: doc_id, source, size, text_crc32, law, shard, slot, grown_shard, fraction, nth, time.

    Every shard holds the mix in its own proportions and is read in order of training time."""
    prepare(spark)
    return training_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: Learned scores have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
