"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded digest within their source and ranked; the fractional rank (rank - 1/2) / n spreads each
source evenly over 0 to 1. All rows are then ordered by fractional rank and cut into shards whose row counts differ by
one at most, so every shard holds the sources in the corpus's own proportions.

Ranks never gather a source in one task: a source is cut into 4,096 ranges of its order key and the corpus into 4,096
ranges of fractional rank; each range is ranked by itself and shifted by the row counts of the ranges before it.

Defined results: a null text has no bytes; null is a source of its own; repeated rows each get a slot of their own
(which of two equal rows gets which is no difference); an empty table gives no rows; other columns are ignored, whatever
their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.common import order_bucket, order_key, stored, stratum, table, word_count
from turnwise.llm.curriculum import training_times
from turnwise.llm.registry import query

RANGES = 4096


def _slim(docs: DataFrame, row_overhead: int, *extra: Column) -> DataFrame:
    return docs.select(
        "doc_id", "source",
        (F.octet_length(F.coalesce("text", F.lit(""))) + row_overhead).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        stratum(F.col("source")).alias("_stratum"), *extra)


def stratified_shards(docs: DataFrame, shards: int = 24, seed: str = "shards", row_overhead: int = 8) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, law, shard, slot, grown_shard, fraction."""
    return _placed(_slim(docs, row_overhead).withColumn("_key", order_key(F.col("doc_id"), seed)), shards)


def training_shards(mix: DataFrame, shards: int = 24, seed: str = "shards", mix_seed: str = "mix",
                    row_overhead: int = 8) -> DataFrame:
    """``stratified_shards`` of a mix that repeats documents, where every shard is read in order of training time.

    The passes over a document have order keys of their own, so they lie in shards and slots independent of each other.
    Slots follow ``time`` within a shard, which is a column more.
    """
    rows = _slim(mix, row_overhead, word_count(F.col("text")).alias("_words"))
    again = Window.partitionBy("doc_id", "source", "text_crc32").orderBy("size")
    slim = rows.withColumn("nth", F.row_number().over(again)).withColumn("_key", order_key(F.col("doc_id"), mix_seed)) \
        .withColumn("_bucket", order_bucket(F.col("_key")))
    timed = stored(training_times(stored(slim)).drop("_bucket", "_words", "_key").withColumn(
        "_key", order_key(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "nth"), seed)))
    placed = stored(_placed(timed, shards).withColumn("_range", F.floor(F.col("time") * RANGES).cast("int")))
    along = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    cuts = placed.groupBy("shard", "_range").agg(F.count("*").alias("_n")) \
        .withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
    in_range = Window.partitionBy("shard", "_range").orderBy("time", "slot")
    return placed.withColumn("_rank", F.row_number().over(in_range)).join(cuts, ["shard", "_range"]) \
        .withColumn("slot", (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_rank", "_before", "_range")


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """The place of each row (doc_id, source, size, text_crc32, _stratum, _key and any of time and nth)."""
    kept = [c for c in ("nth", "time") if c in rows.columns]
    slim = stored(rows.withColumn("_bucket", order_bucket(F.col("_key"))))
    in_source = Window.partitionBy("_stratum").orderBy("_bucket")
    starts = (slim.groupBy("_stratum", "_bucket").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.coalesce(
                  F.sum("_n").over(in_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("_total", F.sum("_n").over(Window.partitionBy("_stratum")))
              .drop("_n"))
    in_bucket = Window.partitionBy("_stratum", "_bucket").orderBy("_key", "doc_id", "text_crc32", "size")
    ranked = stored(
        slim.withColumn("_rank", F.row_number().over(in_bucket))
        .join(starts, ["_stratum", "_bucket"])
        .withColumn("fraction", (F.col("_before") + F.col("_rank") - 0.5) / F.col("_total"))
        .withColumn("_range", F.floor(F.col("fraction") * RANGES).cast("int"))
        .select("doc_id", "source", "size", "text_crc32", "_stratum", "_key", "fraction", "_range", *kept))
    # One row per range of fractional rank, 4,096 at most.
    along = Window.orderBy("_range")
    cuts = (ranked.groupBy("_range").agg(F.count("*").alias("_n"))
            .withColumn("_before", F.coalesce(
                F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("_all", F.sum("_n").over(Window.partitionBy()))
            .drop("_n"))
    in_range = Window.partitionBy("_range").orderBy("fraction", "_stratum", "_key", "doc_id", "text_crc32", "size")
    place = ranked.withColumn("_rank", F.row_number().over(in_range)).join(cuts, "_range") \
        .withColumn("_place", F.col("_before") + F.col("_rank") - 1) \
        .withColumn("shard", F.expr(f"int(_place * {shards} div _all)"))
    return place.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"_place - (shard * _all + {shards - 1}) div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "fraction", *kept)


@query("op5_stratified_shards")
def op5_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source")
