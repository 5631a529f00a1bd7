"""Projections of the given tables onto the engine's inputs.

Each binding is a deterministic projection, so the same rows can be written in
SQL for a cross-check (``turnwise.plans.sql``).
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.scalars import course_level, days_to_instruction, phase_at, position_bucket
from turnwise.session import checked_broadcast
from turnwise.sources.calendar import calendar_for

CALENDAR = calendar_for("2268")
DAY = dt.date(2024, 1, 15)
NOW = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
COHORT_START_US = 1_773_964_800_000_000  # 2026-03-20 00:00 UTC
HALF_HOUR_US = 1_800_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when they come in fewer pieces than there are cores (one small file);
    a table of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def us(column: str, name: str | None = None):
    """A timestamp as microseconds, so both engines compare integers."""
    return F.unix_micros(column).alias(name or column)


def _counts() -> dict:
    n = F.col("event_id")
    return {
        "enrolled_count": (F.lit(95) + n % 7).cast("int"),
        "enroll_capacity": (F.lit(100) - F.when(n % 11 == 0, 2).otherwise(0)).cast("int"),
        "waitlist_count": F.greatest(F.lit(0), (n * 5) % 9 - 3).cast("int"),
        "waitlist_capacity": F.lit(20),
        "reserved_count": F.when(n % 5 == 0, n % 4).cast("int"),
        "open_reserved": F.when(n % 5 == 0, n % 3).cast("int"),
        "status": F.lit("O"),
        "section_status": F.when(n % 397 == 0, "GONE"),
    }


def panel_from_events(spark: SparkSession, sf_dir: str, term: Column | None = None) -> DataFrame:
    """One observation of a section (the user) per event, of one term or of those that ``term`` says."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("section_id"), F.col("ts").cast("timestamp").alias("run_started_at"),
        *[c.alias(k) for k, c in _counts().items()],
        (F.col("event_type") != "error").alias("observed"),
        F.lit("site").alias("source"), F.lit("full").alias("scope"), F.lit("delta").alias("kind"),
        (F.lit("2268") if term is None else term).alias("term_id"),
    )


def identity_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min("ts").cast("timestamp").alias("first_seen"), F.max("ts").cast("timestamp").alias("last_seen"))
    return _named(users).select("section_id", "course_key", "subject", "catalog_number", "component", "first_seen", "last_seen")


def _named(df: DataFrame) -> DataFrame:
    number = (F.col("user_id") % 60 * 5).cast("string")
    subject = F.concat(F.lit("S"), (F.col("user_id") % 7).cast("string"))
    return df.withColumns({
        "section_id": F.col("user_id").cast("string"), "subject": subject, "catalog_number": number,
        "course_key": F.concat_ws(" ", subject, number), "class_number": F.lit("001"),
        "section_number": (F.col("user_id") % 3).cast("string"), "component": F.lit("LEC"),
        "is_primary": F.lit(True), "session_id": F.lit("1"),
    })


def _run_keys(df: DataFrame) -> DataFrame:
    """The half-hour run an event falls in: number, time, kind, scope, source."""
    n = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(HALF_HOUR_US)).cast("long")
    df = df.withColumn("run_no", n)
    return df.withColumns({
        "run_started_at": F.timestamp_micros(F.col("run_no") * HALF_HOUR_US),
        "kind": F.when(F.col("run_no") % 48 == 0, "baseline").otherwise("delta"),
        "scope": F.when(F.col("run_no") % 3 == 1, "priority").otherwise("full"),
        "run_source": F.when(F.col("run_no") % 50 == 7, "feed").otherwise("site"),
    })


def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section's last good event within a run, as a snapshot row."""
    good = _run_keys(table(spark, sf_dir, "events")).where(F.col("event_type") != "error")
    rows = good.groupBy("user_id", "run_no", "run_started_at", "kind", "scope", "run_source").agg(
        F.max_by("event_id", "ts").alias("event_id"))
    rows = _named(rows).withColumns({
        **_counts(), "fetched_at": F.col("run_started_at"), "term_id": F.lit("2268"), "source": F.lit("site"),
        "date": F.to_date("run_started_at")})
    from turnwise.schema import SNAPSHOT

    return rows.select(*SNAPSHOT.fieldNames(), "run_started_at", "kind", "scope", "run_no", "date")


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the number of sections read and missed."""
    e = _run_keys(table(spark, sf_dir, "events"))
    per_user = e.groupBy("user_id", "run_no", "run_started_at", "kind", "scope", "run_source").agg(
        F.max((F.col("event_type") != "error").cast("int")).alias("read"))
    n = F.col("run_no")
    return per_user.groupBy("run_no", "run_started_at", "kind", "scope", F.col("run_source").alias("source")).agg(
        F.sum("read").cast("int").alias("n_observed"), F.sum(1 - F.col("read")).cast("int").alias("n_missing")
    ).withColumns({
        "term_id": F.lit("2268"), "n_written": F.col("n_observed"), "shard": (n % 12).cast("string"),
        "complete": (F.col("scope") == "full") & (n % 5 != 0),
        "lists": (F.col("scope") == "priority") & (n % 2 == 0),
    })


def run_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids a run declares as read or reports as missed, one row each."""
    e = _run_keys(table(spark, sf_dir, "events"))
    per_user = e.groupBy("user_id", "run_no", "run_started_at", "kind", "scope").agg(
        F.max(F.col("event_type") != "error").alias("read"))
    lists = (F.col("scope") == "priority") & (F.col("run_no") % 2 == 0)
    rows = per_user.select(F.lit("2268").alias("term_id"), F.col("user_id").cast("string").alias("section_id"),
                           "run_started_at", "kind",
                           (lists & F.col("read")).alias("declared"), (~F.col("read")).alias("missing"))
    return rows.where(F.col("declared") | F.col("missing"))


def attempted_on(spark: SparkSession, sf_dir: str, day: dt.date) -> DataFrame:
    """Ids a run of the day tried to read: its universe."""
    e = table(spark, sf_dir, "events").where(F.to_date("ts") == F.lit(day))
    return e.select(F.col("user_id").cast("string").alias("section_id")).distinct()


def history_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a section (the customer): shipments with a length from the quantity,
    reversed when it is short."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = line.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    a = F.unix_micros(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 3_600_000_000
    b = a + ((F.col("l_quantity") - 5) * 86_400_000_000).cast("long")
    return rows.select(
        F.col("o_custkey").cast("string").alias("section_id"), F.lit("2268").alias("term_id"), row_id().alias("ordinal"),
        F.timestamp_micros(F.least(a, b)).alias("start"), F.timestamp_micros(F.greatest(a, b)).alias("end"),
        F.lit("O").alias("status"), (F.lit(90) + F.col("l_quantity") % 15).cast("int").alias("enrolled_count"),
        F.lit(100).alias("enroll_capacity"), (F.col("l_partkey") % 6).cast("int").alias("waitlist_count"),
        F.lit(20).alias("waitlist_capacity"), F.lit(None).cast("int").alias("reserved_count"),
        F.lit(None).cast("int").alias("open_reserved"), F.lit("history").alias("source"))


def row_id():
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * F.lit(2**20) + cents % F.lit(2**20)


# Queue place by line number.
PLACES = (1, 3, 7, 12, 18, 30, 50)


def cohort_from_lineitem(spark: SparkSession, sf_dir: str, dealt_out: bool = False) -> DataFrame:
    """Joiners: a line is a joiner, its part the section, brand and part group the course."""
    line = table(spark, sf_dir, "lineitem")
    if dealt_out:
        line = spread(line)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = line.join(checked_broadcast(part), "l_partkey")  # a row per section
    place = F.element_at(F.array(*[F.lit(p) for p in PLACES]), F.col("l_linenumber"))
    join_us = F.lit(COHORT_START_US) + (F.col("l_orderkey") % 200) * 86_400_000_000 + F.col("l_linenumber") * 3_600_000_000
    number = (F.col("l_partkey") % 16 * 20).cast("string")
    days = F.col("l_quantity") + F.col("l_linenumber") * F.lit(0.01)
    rows = rows.select(
        row_id().alias("row_id"), F.col("l_partkey").cast("string").alias("section_id"),
        F.timestamp_micros(join_us).alias("join_time"), place.alias("position"),
        F.col("l_discount").alias("wl_ratio"), days.alias("duration_days"), (days * 1440.0).alias("duration_min"),
        (F.col("l_returnflag") != "N").cast("int").alias("event"),
        (days + (F.col("l_partkey") % 30)).alias("follow_up_days"),
        F.concat_ws(" ", "p_brand", number).alias("course_key"), F.col("p_brand").alias("subject"),
        number.alias("catalog_number"), F.lit("LEC").alias("component"), F.col("p_brand").alias("dept_group"),
        (F.col("l_linestatus") == "F").alias("reserved"), F.lit("central").alias("scenario"),
        (place + 2).alias("waitlist0"), F.lit(100).alias("capacity0"), "l_linestatus")
    return rows.withColumns({
        "position_bucket": position_bucket(F.col("position")), "log_position": F.log(F.col("position").cast("double")),
        "level": course_level(F.col("catalog_number")), "phase": phase_at(F.col("join_time"), CALENDAR),
        "days_to_instruction": days_to_instruction(F.col("join_time"), CALENDAR)})


