"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a budget of words (see ``source_targets``). Its documents, shuffled by a seeded digest, lie one after
another along the source's own words; a second pass over them continues where the first ends. A source's weight over
training time is a straight line from ``start`` to ``end``; its integral, scaled to the budget, is the words demanded
up to a time. Inverting that integral at a document's offset gives the time at which training reaches it, and
documents are range-sorted by that time.

Prefix sums never gather a source in one task: a source is cut into 4,096 ranges of its order key, each range is summed
by itself and shifted by the words of the ranges before it. Only one row per source and range meets in a window.

Defined results: a null or empty text has size 0 and is taken 0 words; null is a source of its own, ordered last; equal
rows are taken one by one; an empty table gives no rows; other columns are kept by ``mixed`` and never read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.common import order_bucket, order_key, stored, stratum, table, whole_row, word_count
from turnwise.llm.registry import query

#: Weights of the sources in code point order, repeating, and for each its share of training time at start and end.
WEIGHTS = (3.0, 1.0, 2.0)
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))


def _by_turn(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
                   schedules: tuple[tuple[float, float], ...] = SCHEDULES) -> DataFrame:
    """Budgets per source from (_stratum, source, source_size), one row per source.

    Every source gets ``level * weight`` words but at most ``most`` times its own, where the level is such that all
    together get ``share`` times all words: the fixed point of sharing the excess again by weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = (sizes.withColumn("_rank", F.row_number().over(by_name) - 1)
              .withColumn("weight", _by_turn(weights, F.col("_rank")))
              .withColumn("start", _by_turn(tuple(s for s, _ in schedules), F.col("_rank")))
              .withColumn("end", _by_turn(tuple(e for _, e in schedules), F.col("_rank")))
              .withColumn("_cap", F.lit(most) * F.col("source_size")))
    fill = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    every = Window.partitionBy()
    levels = (ranked
              .withColumn("_below", F.coalesce(
                  F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
              .withColumn("_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("_level", (share * F.sum("source_size").over(every) - F.col("_below")) / F.col("_left"))
              .withColumn("_level", F.when(F.col("_cap") >= F.col("_level") * F.col("weight"), F.col("_level"))))
    # The first source that isn't filled up sets the level, the largest of those left; without one all are full.
    return levels.withColumn("_level", F.max("_level").over(every)) \
        .withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap")))) \
        .select("_stratum", "source_size", "target", "weight", "start", "end")


def _time_of(words: Column, target: Column, start: Column, end: Column) -> Column:
    """When ``words`` of ``target`` have been demanded: the root of start*t + (end-start)*t^2/2 = share * (start+end)/2."""
    need = words / target * (start + end) / 2
    return 2 * need / (start + F.sqrt(F.greatest(start * start + 2 * (end - start) * need, F.lit(0.0))))


def _planned(docs: DataFrame, seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5,
               most: int = 2, schedules: tuple[tuple[float, float], ...] = SCHEDULES,
               keep: Column | None = None) -> DataFrame:
    """One row per document, in no order: doc_id, source, size, source_size, target, taken (words over all passes), first_time and last_time (training time
    at which its first and its last pass begin; null if it is never taken), times (of all passes), passes (takes of at
    least half its words), and ``keep`` as column _doc.
    """
    slim = stored(docs.select(
        "doc_id", "source", (F.lit(None).cast("int") if keep is None else keep).alias("_doc"),
        word_count(F.col("text")).alias("size"),
        stratum(F.col("source")).alias("_stratum"), order_key(F.col("doc_id"), seed).alias("_key"),
    ).withColumn("_bucket", order_bucket(F.col("_key"))))
    per_range = slim.groupBy("_stratum", "source", "_bucket").agg(F.sum("size").alias("_words"))
    in_source = Window.partitionBy("_stratum").orderBy("_bucket")
    starts = (per_range.withColumn("_before", F.coalesce(
        F.sum("_words").over(in_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("_stratum", "_bucket", "_before"))
    targets = source_targets(per_range.groupBy("_stratum", "source").agg(F.sum("_words").alias("source_size")),
                             weights, share, float(most), schedules)
    in_bucket = Window.partitionBy("_stratum", "_bucket").orderBy("_key", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    laid = (slim.withColumn("_own", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
            .join(starts.join(targets, "_stratum"), ["_stratum", "_bucket"])
            .withColumn("_offset", F.col("_before") + F.col("_own"))
            .withColumn("_budget", F.floor("target").cast("long")))
    takes = F.transform(
        F.sequence(F.lit(0), F.lit(most - 1)),
        lambda k: F.least(F.col("size"), F.greatest(
            F.lit(0), F.col("_budget") - F.col("_offset") - k * F.col("source_size"))).cast("long"))
    timed = (laid.withColumn("_takes", takes)
             .withColumn("taken", F.aggregate("_takes", F.lit(0).cast("long"), lambda a, x: a + x))
             .withColumn("passes", F.size(F.filter("_takes", lambda x: (x > 0) & (2 * x >= F.col("size")))))
             .withColumn("times", F.transform(
                 F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.get("_takes", k) > 0),
                 lambda k: _time_of(F.col("_offset") + k * F.col("source_size"), F.col("target"),
                                    F.col("start"), F.col("end"))))
             .withColumn("first_time", F.get("times", F.lit(0)))
             .withColumn("last_time", F.get("times", F.size("times") - 1)))
    kept = [] if keep is None else ["_doc"]
    return timed.select("doc_id", "source", "size", "source_size", "target", "taken", "passes",
                        "first_time", "last_time", "times", *kept)


def training_times(rows: DataFrame, schedules: tuple[tuple[float, float], ...] = SCHEDULES) -> DataFrame:
    """The training time of each row of a mix, from the rows (_stratum, source, nth, _bucket, _key, _words, ...) alone.

    ``mixed`` takes a source's documents in the order of their keys, a whole pass before the next one; ``nth`` is the
    pass. What lies before a row, inverted through the source's schedule, is the time at which training reaches it.
    """
    per_range = rows.groupBy("_stratum", "source", "nth", "_bucket").agg(F.sum("_words").alias("_in_range"))
    along = Window.partitionBy("_stratum").orderBy("nth", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sources = per_range.groupBy("_stratum", "source").agg(F.sum("_in_range").alias("_all")).withColumn(
        "_rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)  # one row per source
    starts = per_range.withColumn("_before", F.coalesce(F.sum("_in_range").over(along), F.lit(0))).join(
        sources.select("_stratum", "_all", _by_turn(tuple(s for s, _ in schedules), F.col("_rank")).alias("_start"),
                       _by_turn(tuple(e for _, e in schedules), F.col("_rank")).alias("_end")), "_stratum")
    in_range = Window.partitionBy("_stratum", "nth", "_bucket").orderBy("_key", "doc_id", "_words", "text_crc32")
    own = F.coalesce(F.sum("_words").over(in_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = rows.withColumn("_own", own).join(starts.drop("_in_range", "source"), ["_stratum", "nth", "_bucket"])
    time = _time_of(F.col("_before") + F.col("_own"), F.greatest("_all", F.lit(1)), F.col("_start"), F.col("_end"))
    return laid.withColumn("time", time).drop("_own", "_before", "_all", "_start", "_end")


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The plan of ``docs``, see ``_planned``, range-sorted by the time at which training first reaches a document."""
    order = [F.col("first_time").asc_nulls_last(), F.col("doc_id")]
    return _planned(docs, **options).repartitionByRange(*order).sortWithinPartitions(*order)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document once for each pass that takes at least half its words, in order of training time.

    Documents without words carry none and leave. All columns of ``docs`` stay; ``docs`` may hold any others.
    """
    plan = _planned(docs, keep=whole_row(docs), **options)  # whole documents are range-sorted once, below
    copies = plan.select("_doc", F.explode(F.slice("times", 1, F.col("passes"))).alias("_time"))
    return copies.repartitionByRange("_time", "_doc.doc_id").sortWithinPartitions("_time", "_doc.doc_id") \
        .select("_doc.*")


_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             CASE r % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS a,
             CASE r % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS b FROM s),
v AS (
  SELECT a.source, a.source_size, a.weight, a.a, a.b, 2.0::DOUBLE * a.source_size AS cap,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM w)
          - coalesce(sum(2.0::DOUBLE * a.source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(a.weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w a WINDOW o AS (ORDER BY 2.0::DOUBLE * a.source_size / a.weight, a.r)),
t AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT max(level) FROM v WHERE cap >= level * weight) * weight, cap)) AS target, a, b FROM v),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.a, t.b, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (least(size, greatest(0, budget - off)) + least(size, greatest(0, budget - off - source_size)))::BIGINT AS taken,
       CASE WHEN size > 0 AND off < budget THEN 2 * need / (a + sqrt(greatest(a * a + 2 * (b - a) * need, 0.0))) END
         AS first_time,
       CASE WHEN size > 0 AND off + source_size < budget
            THEN 2 * again / (a + sqrt(greatest(a * a + 2 * (b - a) * again, 0.0)))
            WHEN size > 0 AND off < budget THEN 2 * need / (a + sqrt(greatest(a * a + 2 * (b - a) * need, 0.0))) END
         AS last_time
FROM (SELECT *, off / target * (a + b) / 2 AS need, (off + source_size) / target * (a + b) / 2 AS again FROM o)
"""


@query("op8_curriculum_mix", _SQL)
def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "first_time", "last_time")
