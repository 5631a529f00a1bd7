"""Run-length histories to observation panels, crossings and dark time."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators.flows import interval_flows
from turnwise.operators.ranks import quantiles
from turnwise.operators.scans import Scan, Splits, plan_splits, scan
from turnwise.session import materialize

WIDE_MIN = 180.0
_COUNTS = ("enrolled_count", "enroll_capacity", "waitlist_count", "waitlist_capacity",
           "reserved_count", "open_reserved")


def _with_previous_end(segments: DataFrame, splits: Splits | None) -> DataFrame:
    """Add ``_seen``: the latest end among the section's earlier segments."""
    splits = splits or plan_splits(segments, ["section_id"], "start")
    return scan(segments, ["section_id"], ["start", "end", "ordinal"],
                [Scan("_seen", F.col("end"), "max", inclusive=False)], splits)


def history_panel(segments: DataFrame, splits: Splits | None = None) -> DataFrame:
    """Observed rows at each segment's start and end.

    A time at or before one already written is skipped, so a start counts only
    after every earlier end, and an end only when it is also after its start.
    """
    rows = _with_previous_end(segments, splits)
    fresh = lambda c: F.col("_seen").isNull() | (F.col(c) > F.col("_seen"))
    at = F.array_compact(F.array(
        F.when(fresh("start"), F.col("start")),
        F.when(fresh("end") & (F.col("end") > F.col("start")), F.col("end")),
    ))
    return rows.select(
        "section_id", F.explode(at).alias("run_started_at"), *_COUNTS, "status",
        F.lit(None).cast("string").alias("section_status"), F.lit(True).alias("observed"),
        "source", F.lit("full").alias("scope"), F.lit("history").alias("kind"), "term_id",
    )


def crossings(segments: DataFrame, wide_min: float = WIDE_MIN, splits: Splits | None = None) -> DataFrame:
    """Unobserved stretches between a segment and all segments before it."""
    rows = _with_previous_end(segments, splits).where(F.col("start") > F.col("_seen"))
    minutes = (F.unix_micros("start") - F.unix_micros("_seen")) / F.lit(60_000_000.0)
    return rows.select("section_id", F.col("_seen").alias("t0"), F.col("start").alias("t1"),
                       minutes.alias("minutes"), (minutes > wide_min).alias("wide"))


def history_identity(payloads: DataFrame, panel: DataFrame) -> DataFrame:
    """Section attributes with the first and last observed time."""
    seen = panel.groupBy("section_id").agg(F.min("run_started_at").alias("first_seen"),
                                           F.max("run_started_at").alias("last_seen"))
    who = payloads.select(F.col("enrollment.sectionId").cast("string").alias("section_id"), "section.*")
    return who.join(seen, "section_id")


def history_flows(panel: DataFrame, crossing_rows: DataFrame, splits: Splits | None = None) -> DataFrame:
    """Flows whose start is the start of a wide crossing are censored; long
    intervals inside a segment are observed stillness and are not."""
    return censor_crossings(interval_flows(panel, splits=splits), crossing_rows)


def censor_crossings(flows: DataFrame, crossing_rows: DataFrame) -> DataFrame:
    wide = crossing_rows.where("wide").select("section_id", "t0").distinct().withColumn("_wide", F.lit(True))
    joined = flows.join(wide, ["section_id", "t0"], "left")
    return joined.withColumn("censored", F.coalesce("censored", F.lit(False)) | F.coalesce("_wide", F.lit(False))) \
        .select(*flows.columns)


def _by_day(rows: DataFrame, start: str, stop: str) -> DataFrame:
    """Per UTC day (``date``) the ``seconds`` of [start, stop] inside it, and ``n``, the rows with any.

    A row gives its seconds on its first and last day and opens and closes the days that it touches; the days between
    follow from running sums over days, so no row is copied to its days.
    """
    last = F.to_date(F.timestamp_micros(F.unix_micros(stop) - 1))  # an end at midnight touches no new day
    rows = rows.where(F.col(stop) > F.col(start)).select(
        start, stop, F.to_date(start).alias("_a"), last.alias("_z"))
    seconds = lambda a, z: (F.unix_micros(z) - F.unix_micros(a)) / F.lit(1_000_000.0)
    midnight = lambda c, more: F.date_add(c, more).cast("timestamp")
    one = F.col("_a") == F.col("_z")
    mark = lambda date, sec, full, own: F.struct(
        date.alias("date"), sec.alias("sec"), F.lit(full).alias("full"), F.lit(own).alias("own"))
    none = F.lit(0.0)
    first = mark(F.col("_a"), F.when(one, seconds(F.col(start), F.col(stop))).otherwise(seconds(F.col(start), midnight("_a", 1))), 0, 1)
    close = mark(F.date_add("_z", 1), none, 0, -1)
    opened = mark(F.date_add("_a", 1), none, 1, 0)
    final = mark(F.col("_z"), seconds(midnight("_z", 0), F.col(stop)), -1, 0)
    each = rows.select(F.inline(F.when(one, F.array(first, close)).otherwise(F.array(first, opened, final, close))))
    daily = each.groupBy("date").agg(F.sum("sec").alias("sec"), F.sum("full").alias("full"), F.sum("own").alias("own"))
    span = daily.agg(F.min("date").alias("_from"), F.max("date").alias("_to")).where("_from IS NOT NULL")
    days = span.select(F.explode(F.sequence("_from", "_to")).alias("date")).join(daily, "date", "left")
    # one row per day of the whole history
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return days.select(
        "date", (F.coalesce("sec", F.lit(0.0)) + F.sum(zero("full")).over(upto) * F.lit(86_400.0)).alias("seconds"),
        F.sum(zero("own")).over(upto).alias("n")).where("seconds > 0")


def _dark_sections(wide: DataFrame) -> DataFrame:
    """Per day the sections with a second in one of their stretches: a section's days are cut so that none comes twice."""
    rows = wide.where(F.col("section_id").isNotNull() & (F.col("t1") > F.col("t0"))).select(
        "section_id", F.to_date("t0").alias("_a"), F.to_date(F.timestamp_micros(F.unix_micros("t1") - 1)).alias("_z"))
    rows = scan(rows, ["section_id"], ["_a", "_z"], [Scan("_upto", F.col("_z"), "max", inclusive=False)],
                plan_splits(rows, ["section_id"], "_a"))
    rows = rows.select(F.greatest(F.col("_a"), F.date_add("_upto", 1)).alias("_a"), "_z").where("_a <= _z")
    return _by_day(rows.select(F.col("_a").cast("timestamp").alias("t0"), F.date_add("_z", 1).cast("timestamp").alias("t1")), "t0", "t1")


def dark_time(crossing_rows: DataFrame, identity: DataFrame) -> DataFrame:
    """Per UTC day: sections covered, sections dark, share of covered time in wide crossings."""
    covered = _by_day(identity.select("first_seen", "last_seen"), "first_seen", "last_seen").select(
        "date", F.col("seconds").alias("_covered"), F.col("n").alias("sections_covered"))
    wide = materialize(crossing_rows.where("wide").select("section_id", "t0", "t1"))  # read for its time and its sections
    dark = _by_day(wide, "t0", "t1").select("date", F.col("seconds").alias("_dark"))
    sections = _dark_sections(wide).select("date", F.col("n").alias("sections_dark"))
    span = identity.agg(
        F.to_date(F.min("first_seen")).alias("a"),
        # a history that ends exactly at midnight adds no day
        F.greatest(F.to_date(F.min("first_seen")),
                   F.to_date(F.max("last_seen") - F.expr("INTERVAL 1 MICROSECOND"))).alias("b"),
    )
    days = span.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("date"))
    share = F.when(F.coalesce("_covered", F.lit(0.0)) > 0, F.coalesce("_dark", F.lit(0.0)) / F.col("_covered"))
    return days.join(covered, "date", "left").join(dark, "date", "left").join(sections, "date", "left").select(
        "date", F.coalesce("sections_covered", F.lit(0)).alias("sections_covered"),
        F.coalesce("sections_dark", F.lit(0)).alias("sections_dark"),
        F.round(F.coalesce(share, F.lit(0.0)), 4).alias("share_time_in_gap"),
    )


def darkest_days(report: DataFrame, n: int = 10) -> DataFrame:
    return report.orderBy(F.desc("share_time_in_gap"), F.asc("date")).limit(n)


def crossing_quantiles(crossing_rows: DataFrame, at: Sequence[float] = (0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """Exact quantiles of the crossing length and the share above 45 minutes, from the counts of each length."""
    lengths = materialize(crossing_rows.groupBy("minutes", "wide").agg(F.count(F.lit(1)).alias("_m")))
    over = F.sum(F.when(F.col("minutes") > 45, F.col("_m")).otherwise(0))
    totals = lengths.agg(
        F.coalesce(F.sum("_m"), F.lit(0)).alias("crossings"),
        F.coalesce(F.sum(F.when(F.col("wide"), F.col("_m"))), F.lit(0)).alias("crossings_wide"),
        F.round(over / F.sum("_m"), 4).alias("share_over_45")).withColumn("_one", F.lit(1))
    read = quantiles(lengths, [], "minutes", at, "_m", "_q").withColumn("_one", F.lit(1))
    return totals.join(read, "_one", "left").select(
        "crossings", "crossings_wide", *[F.round(F.col("_q")[i], 1).alias(f"q{int(a * 100)}") for i, a in enumerate(at)],
        "share_over_45")
