"""Benchmark decontamination by size-partitioned MinHash containment search.

An item's sketch is its smallest shingle digests under one hash function. A document that holds at least 80 % of an
item's n shingles misses at most n - ceil(0.8 n) of them, so it holds one of any floor(0.2 n) + 1. Items are partitioned
by size (powers of two) and every item of a partition is searched by floor(0.2 u) + 1 sketch values, u being the
partition's largest size: no document that qualifies can be missed, however long it is. Documents whose shingle digests
meet a sketch value are then verified by exact containment, on the words themselves.

Words are runs without ASCII white space, A-Z lower-cased; shingles are five words, or an item's whole sequence if that
is shorter. Only sketches and found pairs are joined to documents; they are broadcast when counted small, and joined by
shuffle otherwise.

Defined results: null or wordless items are in no document, null or wordless documents hold no item; equal rows give one
row; repeated items are found each; empty tables give no rows; other columns are ignored, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import let, lower_ascii, stored, table, whole_row, words_of
from turnwise.llm.registry import query

WIDTH = 5
#: Rows up to which sketches (8-byte digest, item) or found pairs are broadcast.
BROADCAST_ROWS = 200_000


#: The same in bytes, where rows hold texts.
BROADCAST_BYTES = 32 << 20


def _small(df: DataFrame, texts: str | None = None) -> DataFrame:
    """``df`` broadcast if few rows, and few bytes in its array of ``texts``, were counted."""
    held = F.lit(0) if texts is None else F.aggregate(texts, F.lit(0).cast("long"), lambda a, s: a + F.octet_length(s) + 16)
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(held), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def _runs(values: Column, width: Column | int, build) -> Column:
    """``build`` of every run of ``width`` neighbouring values."""
    last = F.size(values) - F.lit(width) + 1 if isinstance(width, int) else F.size(values) - width + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: build(F.slice(values, i, width)))) \
        .otherwise(F.array().cast("array<long>") if isinstance(width, int) else F.array().cast("array<string>"))


def _word_hashes(text: Column) -> Column:
    return F.transform(words_of(lower_ascii(text)), lambda w: F.xxhash64(w))


def item_sketches(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, width, n, shingles) and (digest, width, item): what to verify and what to search by."""
    listed = (items.select("item_id", "text").distinct().withColumn("_words", words_of(lower_ascii(F.col("text"))))
              .filter(F.size("_words") > 0)
              .withColumn("width", F.least(F.lit(WIDTH), F.size("_words")))
              .withColumn("item", F.md5(F.concat_ws(":", F.col("item_id").cast("string"), "text").cast("binary")))
              .withColumn("shingles", let(F.col("_words"), lambda ws: F.array_distinct(
                  _runs(ws, F.col("width"), lambda r: F.array_join(r, " "))))))
    known = stored(listed.select("item", "item_id", "width", F.size("shingles").alias("n"), "shingles"))
    hashed = known.select(
        "item", "width", "n", F.array_sort(F.transform("shingles", lambda s: F.xxhash64(
            F.transform(F.split(s, " "), lambda w: F.xxhash64(w))))).alias("digests"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n")))).cast("int")
    keys = hashed.select("width", "item", F.explode(F.slice("digests", F.lit(1), F.floor(upper / 5).cast("int") + 1))
                         .alias("digest"))
    return known, stored(keys)


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_found, containment) of every item that a document holds to 80 % or more."""
    docs = docs.select("doc_id", "text")
    known, keys = item_sketches(items)
    widths = sorted(r["width"] for r in keys.select("width").distinct().collect())  # at most 1 to WIDTH
    if not widths:
        widths = [WIDTH]
    # Runs of another width have other digests, so the width needs no column here.
    digests = let(_word_hashes(F.col("text")),
                  lambda hs: F.concat(*[_runs(hs, w, lambda r: F.xxhash64(r)) for w in widths]))
    spread = docs.select("doc_id", F.explode(digests).alias("digest"))
    found = stored(spread.join(_small(keys.select("digest", "item")), "digest").select("doc_id", "item").distinct())
    flat = F.concat(F.lit(" "), F.array_join(words_of(lower_ascii(F.col("text"))), " "), F.lit(" "))
    held = let(flat, lambda t: F.size(F.filter("shingles", lambda s: F.contains(t, F.concat(F.lit(" "), s, F.lit(" "))))))
    where = found.withColumnRenamed("doc_id", "_found_in")
    hits = docs.join(_small(where), F.col("doc_id").eqNullSafe(F.col("_found_in"))).join(_small(known, "shingles"), "item")
    return (hits.select("doc_id", "item_id", F.col("n").cast("long").alias("n_item_shingles"),
                        held.cast("long").alias("n_found"))
            .filter("5 * n_found >= 4 * n_item_shingles").distinct()
            .withColumn("containment", F.col("n_found") / F.col("n_item_shingles")))


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item; rows without doc_id stay unless a row without doc_id holds one."""
    found = stored(contained_items(docs, items).select(F.col("doc_id").alias("found_in")).distinct())
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("id"))
    return rows.join(_small(found), F.col("id").eqNullSafe(F.col("found_in")), "left_anti").select("row.*")


_SQL = """
WITH i AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
s AS (
  SELECT item_id, list_distinct([array_to_string(w[k:k + least(5, len(w)) - 1], ' ')
         FOR k IN range(1, len(w) - least(5, len(w)) + 2)]) AS g FROM i WHERE len(w) > 0),
d AS (
  SELECT DISTINCT doc_id, ' ' || array_to_string(regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' ') || ' ' AS t
  FROM documents),
h AS (
  SELECT doc_id, item_id, len(g)::BIGINT AS n_item_shingles,
         len([x FOR x IN g IF contains(t, ' ' || x || ' ')])::BIGINT AS n_found FROM d, s)
SELECT DISTINCT doc_id, item_id, n_item_shingles, n_found, n_found / n_item_shingles AS containment
FROM h WHERE 5 * n_found >= 4 * n_item_shingles
"""


@query("op7_benchmark_containment", _SQL)
def op7_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
