"""Data quality: cadence, missing shares, panel profile, jumps, two-source check."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.operators.ranks import quantiles
from turnwise.operators.scans import Scan, plan_splits, scan
from turnwise.operators.store import missing_count
from turnwise.schema import CORE_COUNTS, NUMERIC_COUNTS, TOMBSTONE
from turnwise.session import materialize

GAP_TARGET_MIN = 45.0
DRIFT_SEATS = 10
COMPARED = ("enrolled_count", "waitlist_count", "enroll_capacity", "waitlist_capacity")


def _gap_minutes(previous: Column, current: Column) -> Column:
    return (F.unix_micros(current) - F.unix_micros(previous)) / F.lit(60_000_000.0)


def recent_runs(runs: DataFrame, now: dt.datetime, since_hours: float) -> DataFrame:
    at = F.lit(now).cast("timestamp")
    from_ = F.lit(now - dt.timedelta(hours=since_hours)).cast("timestamp")
    return runs.where((F.col("run_started_at") >= from_) & (F.col("run_started_at") <= at))


def cadence_report(runs: DataFrame, now: dt.datetime, since_hours: float = 24.0) -> DataFrame:
    """Gap statistics over all runs (scope ``all``) and over each scope's own runs.

    A scope's gaps run between runs of that scope, so every run is counted once
    under ``all`` and once under its scope before the lag is taken.
    """
    rows = recent_runs(runs, now, since_hours).select(
        "term_id", "run_started_at", F.explode(F.array(F.lit("all"), F.col("scope"))).alias("scope"))
    rows = rows.withColumn("_at", F.struct("run_started_at"))
    keys = ["term_id", "scope"]
    rows = scan(rows, keys, ["run_started_at"], [Scan("_before", F.col("_at"), "prev")],
                plan_splits(rows, keys, "run_started_at"))
    gap = _gap_minutes(F.col("_before.run_started_at"), F.col("run_started_at"))
    rows = materialize(rows.select(*keys, "run_started_at", gap.alias("_gap")))
    p95 = quantiles(rows, keys, "_gap", [0.95], name="_q")
    report = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.round(F.max("_gap"), 3).alias("largest_gap_min"),
        F.round(F.avg((F.col("_gap") <= GAP_TARGET_MIN).cast("int")), 4).alias("share_gaps_le_45min"),
        F.min("run_started_at").alias("first"), F.max("run_started_at").alias("last"),
        F.round(_gap_minutes(F.max("run_started_at"), F.lit(now).cast("timestamp")), 3).alias("minutes_since_last"),
    )
    return report.join(p95, keys, "left").select(
        *keys, "n_runs", "largest_gap_min", F.round(F.col("_q")[0], 3).alias("p95_gap_min"), "share_gaps_le_45min",
        "first", "last", "minutes_since_last")


def run_counts(runs: DataFrame) -> DataFrame:
    """Number of runs by kind and by scope, as ``what, value, n_runs``."""
    pair = lambda c: F.struct(F.lit(c).alias("what"), F.col(c).alias("value"))
    return runs.select(F.explode(F.array(pair("kind"), pair("scope"))).alias("p")).select("p.*") \
        .groupBy("what", "value").agg(F.count(F.lit(1)).alias("n_runs"))


def missing_share(runs: DataFrame) -> DataFrame:
    """Median and largest per-run missing share; runs with nothing in scope are skipped."""
    missing = missing_count(runs)
    share = F.try_divide(missing, F.col("n_observed") + missing)
    shares = materialize(runs.select("term_id", share.alias("_s")).groupBy("term_id", "_s").agg(F.count(F.lit(1)).alias("_m")))
    most = shares.groupBy("term_id").agg(F.round(F.max("_s"), 4).alias("max_missing_share"))
    return most.join(quantiles(shares, ["term_id"], "_s", [0.5], "_m", "_q"), "term_id", "left").select(
        "term_id", F.round(F.col("_q")[0], 4).alias("median_missing_share"), "max_missing_share")


def breaches(report: DataFrame, shares: DataFrame, *, gap_min: float | None = None,
             runs_lt: int | None = None, missing_share_gt: float | None = None) -> DataFrame:
    """One row per breached threshold of a term's overall report: the figure's name, its value and the limit."""
    rows = report.where(F.col("scope") == "all").join(shares, "term_id", "left")
    found = []
    for name, limit, over in (("largest_gap_min", gap_min, True), ("n_runs", runs_lt, False),
                              ("median_missing_share", missing_share_gt, True)):
        if limit is not None:
            value = F.col(name).cast("double")
            found.append(F.when(value > limit if over else value < limit, F.struct(
                F.lit(name).alias("breach"), value.alias("value"), F.lit(float(limit)).alias("limit"))))
    return rows.select("term_id", F.inline(F.array_compact(F.array(*found))))


# ---------------------------------------------------------------------- panel profile


def _observed(panel: DataFrame) -> DataFrame:
    return panel.where(F.coalesce("observed", F.lit(False)))


def panel_profile(panel: DataFrame) -> DataFrame:
    """Runs, sections, rows, observed share and null rates among observed rows."""
    seen = F.coalesce("observed", F.lit(False))
    return panel.agg(
        F.count_distinct("run_started_at").alias("runs"), F.count_distinct("section_id").alias("sections"),
        F.count(F.lit(1)).alias("rows"), F.avg(seen.cast("int")).alias("observed_share"),
        F.min("run_started_at").alias("first_run"), F.max("run_started_at").alias("last_run"),
        *[F.avg(F.when(seen, F.col(c).isNull().cast("int"))).alias(f"null_{c}") for c in NUMERIC_COUNTS],
    )


def run_gap_summary(panel: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles and max of the gaps between consecutive runs."""
    runs = panel.select("run_started_at").distinct().withColumn("_all", F.lit(1))
    runs = runs.withColumn("_at", F.struct("run_started_at"))
    gaps = scan(runs, ["_all"], ["run_started_at"], [Scan("_before", F.col("_at"), "prev")],
                plan_splits(runs, ["_all"], "run_started_at"))
    gap = _gap_minutes(F.col("_before.run_started_at"), F.col("run_started_at"))
    gaps = materialize(gaps.select(gap.alias("_gap")))
    totals = gaps.agg(
        F.count("_gap").alias("count"), F.avg("_gap").alias("mean"), F.stddev_samp("_gap").alias("std"),
        F.min("_gap").alias("min"), F.max("_gap").alias("max")).withColumn("_one", F.lit(1))
    quarters = quantiles(gaps, [], "_gap", [0.25, 0.5, 0.75], name="_q").withColumn("_one", F.lit(1))
    return totals.join(quarters, "_one", "left").select(
        "count", "mean", "std", "min", *[F.col("_q")[i].alias(c) for i, c in enumerate(("p25", "p50", "p75"))], "max")


# Upper bound and label of each histogram bin.
OBSERVATION_BINS = ((1, "1"), (2, "2"), (5, "3-5"), (10, "6-10"), (48, "11-48"), (96, "49-96"), (None, "97+"))


def observation_histogram(panel: DataFrame) -> DataFrame:
    """Sections by number of observations; empty bins are kept."""
    per_section = _observed(panel).groupBy("section_id").agg(F.count(F.lit(1)).alias("_n"))
    label = None
    for top, name in OBSERVATION_BINS:
        if top is None:
            label = label.otherwise(name)
        else:
            label = F.when(F.col("_n") <= top, name) if label is None else label.when(F.col("_n") <= top, name)
    counts = per_section.groupBy(label.alias("observations")).agg(F.count(F.lit(1)).alias("_sections"))
    bins = panel.sparkSession.createDataFrame(
        [(i, name) for i, (_, name) in enumerate(OBSERVATION_BINS)], "ordinal int, observations string")
    return bins.join(counts, "observations", "left").select(
        "ordinal", "observations", F.coalesce("_sections", F.lit(0)).alias("sections"))


def impossible_states(panel: DataFrame) -> DataFrame:
    """Rows and sections per kind of impossible state (unknown comparisons count as false)."""
    e, c, w, wc = (F.col(x) for x in CORE_COUNTS)
    waiting_open = (w > 0) & (e < c)
    checks = {
        "enrolled_over_capacity": e > c,
        "queue_over_capacity": w > wc,
        "negative": (e < 0) | (c < 0) | (w < 0) | (wc < 0),
        "queue_beside_seats": waiting_open & F.col("open_reserved").isNull(),
        "queue_beside_free_seats": (w > 0) & (e < c - F.coalesce("open_reserved", F.lit(0))),
    }
    flags = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(v, F.lit(False)).alias("hit"))
                      for k, v in checks.items()])
    rows = _observed(panel).select("section_id", F.explode(flags).alias("f")).select("section_id", "f.*")
    return rows.groupBy("kind").agg(
        F.count_if("hit").alias("rows"),
        F.count_distinct(F.when(F.col("hit"), F.col("section_id"))).alias("sections"))


def vanished(panel: DataFrame) -> DataFrame:
    """Sections with a tombstone, and those observed alive again after it."""
    gone = panel.where(F.col("section_status") == TOMBSTONE).groupBy("section_id").agg(
        F.min("run_started_at").alias("_gone_at"))
    later = _observed(panel).join(gone, "section_id").where(
        (F.col("run_started_at") > F.col("_gone_at")) & (F.coalesce("section_status", F.lit("")) != TOMBSTONE))
    back = later.select("section_id").distinct().withColumn("_back", F.lit(1))
    return gone.join(back, "section_id", "left").agg(
        F.count(F.lit(1)).alias("vanished"), F.count("_back").alias("reappeared"))


def top_jumps(panel: DataFrame, n: int = 15) -> DataFrame:
    """Largest single-step changes of enrolment, queue and capacity."""
    names = ("enrolled_count", "waitlist_count", "enroll_capacity")
    rows = _observed(panel).select("section_id", "run_started_at", F.struct(*names).alias("_now"))
    rows = scan(rows, ["section_id"], ["run_started_at"], [Scan("_before", F.col("_now"), "prev")],
                plan_splits(panel, ["section_id"], "run_started_at"))
    steps = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"),
                               F.col(f"_before.{c}").alias("from"), F.col(f"_now.{c}").alias("to"))
                      for i, c in enumerate(names)])
    changes = rows.select("section_id", "run_started_at", F.inline(steps)).withColumn(
        "abs_change", F.abs(F.col("to") - F.col("from")))
    return changes.where("abs_change > 0").orderBy(
        F.desc("abs_change"), "ordinal", "section_id", "run_started_at").limit(n).drop("ordinal")


# ------------------------------------------------------------------- two-source check


def cross_check(ours: DataFrame, theirs: DataFrame, key: str = "section_id") -> DataFrame:
    """Verdict per id over four counts: agree, drift (at most 10 seats), disagree, error."""
    left = ours.select(key, *[F.col(c).alias(f"_a_{c}") for c in COMPARED])
    right = theirs.select(key, *[F.col(c).alias(f"_b_{c}") for c in COMPARED])
    diffs = [F.abs(F.col(f"_a_{c}").cast("long") - F.col(f"_b_{c}").cast("long")) for c in COMPARED]
    known = F.lit(True)
    for d in diffs:
        known = known & d.isNotNull()
    worst = F.when(known, F.greatest(*diffs))
    verdict = F.when(worst.isNull(), "error").when(worst == 0, "agree").when(worst <= DRIFT_SEATS, "drift") \
        .otherwise("disagree")
    return left.join(right, key, "full_outer").select(key, worst.alias("max_diff"), verdict.alias("verdict"))


def verdict_counts(checked: DataFrame) -> DataFrame:
    hits = {v: F.count_if(F.col("verdict") == v).alias(v) for v in ("agree", "drift", "disagree", "error")}
    return checked.agg(*hits.values(), F.count_if(F.col("verdict") != "error").alias("comparable"))
