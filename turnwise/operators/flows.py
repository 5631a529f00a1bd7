"""Interval flows between consecutive observed counts, and their summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.rules import classify, is_full, minutes_between
from turnwise.operators.ranks import quantiles
from turnwise.operators.scans import Scan, Splits, plan_splits, scan
from turnwise.schema import CORE_COUNTS, FLOW_COLUMNS, FLOW_NAMES, TOMBSTONE
from turnwise.session import materialize


def observed_series(panel: DataFrame) -> DataFrame:
    """Observed rows with complete counts, cut at each section's first tombstone in its term."""
    gone = panel.where(F.col("section_status") == TOMBSTONE)
    term = F.col("term_id") if "term_id" in panel.columns else F.lit(None).cast("string")
    first_gone = gone.groupBy(F.col("section_id").alias("_gone_id"), term.alias("_gone_term")).agg(
        F.min("run_started_at").alias("_gone_at"))
    same = (F.col("section_id") == F.col("_gone_id")) & term.eqNullSafe(F.col("_gone_term"))
    return (
        panel.where(F.coalesce(F.col("observed"), F.lit(False)))
        .dropna(subset=list(CORE_COUNTS))
        .join(first_gone, same, "left")
        .where(F.col("_gone_at").isNull() | (F.col("run_started_at") < F.col("_gone_at")))
        .drop("_gone_at", "_gone_id", "_gone_term")
    )


def overlaps(t0: Column, t1: Column, term: Column, outage: Column | dict[str, Column]) -> Column:
    """Whether [t0, t1] is affected by an outage (start, end, kind, term_id), a struct or a mapping of columns.

    A row without a term applies to every term. An open ``outage`` lasts for
    ever; other kinds without an end are moments; with an end it is [start, end).
    """
    start, end = outage["start"], outage["end"]
    same_term = term.isNull() | outage["term_id"].isNull() | (term == outage["term_id"])
    moment = end.isNull() & (outage["kind"] != "outage")
    span = (t1 >= start) & (end.isNull() | (t0 < end))
    return same_term & F.when(moment, (t0 <= start) & (start <= t1)).otherwise(span)


INLINE_OUTAGES = 1_000


def attach_outages(intervals: DataFrame, outages: DataFrame, inline_limit: int = INLINE_OUTAGES) -> DataFrame:
    """Add ``_outage``: whether any logged outage touches [t0, t1].

    A log of at most ``inline_limit`` rows (the usual, hand-kept case) travels as
    one array next to the intervals and moves nothing. A longer one is cut into
    the UTC days it covers and matched by day.
    """
    listed = F.struct("start", "end", "kind", "term_id")
    if outages.count() <= inline_limit:
        log = outages.agg(F.collect_list(listed).alias("_log")).withColumn("_one", F.lit(1))
        rows = intervals.withColumn("_one", F.lit(1)).join(F.broadcast(log), "_one").drop("_one")  # one row
        hit = F.exists("_log", lambda o: overlaps(F.col("t0"), F.col("t1"), F.col("term_id"), o))
        return rows.withColumn("_outage", F.coalesce(hit, F.lit(False))).drop("_log")
    last = intervals.agg(F.max("t1").alias("_last")).withColumn("_one", F.lit(1))
    stop = F.when(F.col("_end").isNull() & (F.col("_kind") != "outage"), F.col("_start")).otherwise(
        F.greatest(F.coalesce("_end", "_last"), F.col("_start")))  # an open end is closed at the last t1
    spans = outages.select(*[F.col(c).alias(f"_{c.split('_')[0]}") for c in ("start", "end", "kind", "term_id")],
                           F.lit(1).alias("_one")).join(F.broadcast(last), "_one")
    spans = spans.select("_start", "_end", "_kind", "_term", F.explode(
        F.sequence(F.to_date("_start"), F.to_date(stop))).alias("_day"))
    pairs = intervals.select("section_id", "t0", "t1", "term_id", F.explode(
        F.sequence(F.to_date("t0"), F.to_date("t1"))).alias("_day"))
    span = {"start": F.col("_start"), "end": F.col("_end"), "kind": F.col("_kind"), "term_id": F.col("_term")}
    hit = (
        pairs.join(spans, "_day")
        .where(overlaps(F.col("t0"), F.col("t1"), F.col("term_id"), span))
        .select(F.col("section_id").alias("_s"), F.col("t0").alias("_t"), F.col("term_id").alias("_of"))
        .distinct().withColumn("_outage", F.lit(True))
    )
    same = (F.col("section_id") == F.col("_s")) & (F.col("t0") == F.col("_t")) & F.col("term_id").eqNullSafe(F.col("_of"))
    return intervals.join(hit, same, "left").drop("_s", "_t", "_of").withColumn("_outage", F.coalesce("_outage", F.lit(False)))


def interval_flows(
    panel: DataFrame,
    *,
    outages: DataFrame | None = None,
    max_interval_min: float | None = None,
    splits: Splits | None = None,
) -> DataFrame:
    """One row per section of a term and pair of its consecutive observed runs."""
    if "term_id" not in panel.columns:
        panel = panel.withColumn("term_id", F.lit(None).cast("string"))
    series = observed_series(panel)
    if splits is None:
        splits = plan_splits(panel, ["term_id", "section_id"], "run_started_at")
    following = F.struct("run_started_at", *CORE_COUNTS)
    pairs = scan(series, ["term_id", "section_id"], ["run_started_at"], [Scan("_next", following, "next")], splits)
    pairs = pairs.where(F.col("_next").isNotNull())
    return flows_of_pairs(pairs, outages=outages, max_interval_min=max_interval_min)


def flows_of_pairs(pairs: DataFrame, *, outages: DataFrame | None = None,
                   max_interval_min: float | None = None, inline_limit: int = INLINE_OUTAGES) -> DataFrame:
    """Flows of rows that carry the next observation in the struct ``_next``, with their term as last column."""
    change = lambda c: F.col(f"_next.{c}").cast("long") - F.col(c).cast("long")
    rows = pairs.select(
        "section_id", "term_id",
        F.col("run_started_at").alias("t0"), F.col("_next.run_started_at").alias("t1"),
        minutes_between(F.col("run_started_at"), F.col("_next.run_started_at")).alias("interval_min"),
        change("enrolled_count").alias("d_enrolled"), change("waitlist_count").alias("d_waitlist"),
        change("enroll_capacity").alias("d_capacity"), change("waitlist_capacity").alias("d_wl_capacity"),
        F.col("enrolled_count").cast("long").alias("enrolled0"),
        F.col("enroll_capacity").cast("long").alias("capacity0"),
        F.col("waitlist_count").cast("long").alias("waitlist0"),
        F.col("reserved_count").cast("long").alias("reserved0"),
        F.col("open_reserved").cast("long").alias("open_reserved0"),
        is_full(F.col("enrolled_count"), F.col("enroll_capacity"), F.col("open_reserved")).alias("full0"),
    )
    parts = classify(F.col("d_enrolled"), F.col("d_waitlist"), F.col("d_capacity"), F.col("waitlist0"),
                     F.col("full0"), F.col("open_reserved0"))
    rows = rows.withColumns(parts).withColumn("expansion", F.col("d_capacity") > 0)
    if outages is not None:
        rows = attach_outages(rows, outages, inline_limit)
    else:
        rows = rows.withColumn("_outage", F.lit(False))
    too_long = F.lit(False) if max_interval_min is None else F.col("interval_min") > F.lit(float(max_interval_min))
    return rows.withColumn("censored", F.col("_outage") | too_long).select(*FLOW_COLUMNS, "term_id")


def flow_summary(flows: DataFrame) -> DataFrame:
    """One row of totals; the median length is read by rank from the counts of each length."""
    empty_as = lambda c, v: F.coalesce(c, F.lit(v))
    flows = materialize(flows.select("section_id", "ambiguous", "censored", "interval_min", *FLOW_NAMES))
    median = quantiles(flows, [], "interval_min", [0.5], name="_q").select(F.lit(1).alias("_one"), "_q")
    totals = flows.agg(
        F.count_distinct("section_id").alias("sections"),
        F.count(F.lit(1)).alias("intervals"),
        empty_as(F.round(F.avg(F.col("ambiguous").cast("int")), 4), 0.0).alias("share_ambiguous"),
        empty_as(F.round(F.avg(F.col("censored").cast("int")), 4), 0.0).alias("share_censored"),
        *[empty_as(F.sum(c), 0).cast("long").alias(c) for c in FLOW_NAMES],
    ).withColumn("_one", F.lit(1))
    return totals.join(median, "_one", "left").select(
        "sections", "intervals", "share_ambiguous", "share_censored",
        empty_as(F.round(F.col("_q")[0], 1), 0.0).alias("median_interval_min"), *FLOW_NAMES)


def daily_flows(flows: DataFrame) -> DataFrame:
    """Totals per UTC day of the interval's end."""
    return flows.groupBy(F.to_date("t1").alias("date")).agg(
        F.sum("admits").alias("admits"), F.sum("wl_joins").alias("joins"), F.sum("wl_drops").alias("drops"),
        F.count(F.lit(1)).alias("intervals"),
        F.round(F.avg(F.col("censored").cast("int")), 3).alias("share_censored"),
    )


def exit_tally(flows: DataFrame) -> DataFrame:
    """Admitted, dropped, and still waiting at each section's last interval."""
    per_section = flows.groupBy("section_id").agg(
        F.sum("admits").alias("admits"), F.sum("wl_drops").alias("wl_drops"),
        F.max_by(F.col("waitlist0") + F.col("d_waitlist"), "t1").alias("waiting"),
    )
    return per_section.agg(
        F.sum("admits").alias("admitted"), F.sum("wl_drops").alias("dropped"),
        F.sum(F.greatest("waiting", F.lit(0))).alias("still_waiting"),
    )


def cumulative_flows(flows: DataFrame, splits: Splits | None = None) -> DataFrame:
    """The flows with running totals per section."""
    splits = splits or plan_splits(flows, ["section_id"], "t0")
    return scan(flows, ["section_id"], ["t0"],
                [Scan(f"cum_{c}", F.col(c), "sum") for c in FLOW_NAMES], splits)
