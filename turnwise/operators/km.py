"""Kaplan-Meier curves, medians, log-rank tests and curve reading.

Rows are reduced to one line per (group, time) before any ordering, so a group
holding most of the cohort is combined map-side and what gets ordered is its
distinct times.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.special import chi2_1_p
from turnwise.operators.scans import Scan, Splits, plan_splits, scan, step_lookup

TIME, EVENT = "duration_days", "event"


def event_table(cohort: DataFrame, by: Sequence[str], time: str = TIME, event: Column | str = EVENT) -> DataFrame:
    """Rows ``n`` and events ``d`` per group and time ``t``."""
    event = F.col(event) if isinstance(event, str) else event
    return cohort.groupBy(*by, F.col(time).alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(event.cast("long")).alias("d"))


def curves(events: DataFrame, by: Sequence[str], splits: Splits | None = None) -> DataFrame:
    """Add ``at_risk`` and ``survival`` to an event table."""
    by = list(by)
    splits = splits or plan_splits(events, by, "t")
    rows = scan(events, by, ["t"], [Scan("at_risk", F.col("n"), "sum", reverse=True)], splits)
    factor = F.lit(1.0) - F.col("d") / F.col("at_risk")
    return scan(rows, by, ["t"], [Scan("survival", factor, "product")], splits)


def kaplan_meier(cohort: DataFrame, by: Sequence[str], *, min_rows: int = 1) -> DataFrame:
    """Curve points per group with at least ``min_rows`` rows."""
    by = list(by)
    points = curves(event_table(cohort, by), by)
    if min_rows > 1:
        sizes = cohort.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        keep = sizes.where(F.col("_n") >= min_rows)
        points = points.join(keep.drop("_n"), by, "left_semi")
    return points


def medians(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """First event time with clearing share one half or more; null when never reached."""
    hit = (F.col("d") > 0) & (F.lit(1.0) - F.col("survival") >= 0.5)
    return points.groupBy(*by).agg(
        F.min(F.when(hit, F.col("t"))).alias("median_days"),
        F.sum("n").alias("n"), F.sum("d").alias("events"), F.max("t").alias("reach_days"))


def shares_at(points: DataFrame, by: Sequence[str], at_days: Sequence[float]) -> DataFrame:
    """Clearing share per group at fixed days: the last step at or before each day.

    Survival never rises, so the last step is the smallest value up to the day
    and one aggregation reads every day.
    """
    reads = [
        (F.lit(1.0) - F.coalesce(F.min(F.when(F.col("t") <= float(d), F.col("survival"))), F.lit(1.0)))
        .alias(f"p_clear_by_{int(d)}d") for d in at_days
    ]
    return points.groupBy(*by).agg(*reads)


def km_table(cohort: DataFrame, by: Sequence[str], *, at_days: Sequence[float] = (1, 3, 7, 14, 30),
             min_rows: int = 10) -> DataFrame:
    """Size, events, median and clearing shares per group."""
    by = list(by)
    points = kaplan_meier(cohort, by)
    table = medians(points, by).drop("reach_days").where(F.col("n") >= min_rows)
    return table.join(shares_at(points, by, at_days), by)


def logrank(cohort: DataFrame, by: str) -> DataFrame:
    """Pairwise log-rank statistics between the groups of one column.

    Groups are joined in pairs by name on their time grids, not by rows: each
    pair sees the times at which either group has an event.
    """
    events = event_table(cohort.where(F.col(by).isNotNull()), [by])
    sizes = events.groupBy(by).agg(F.sum("n").alias("size")).where("size >= 2")
    left = sizes.select(F.col(by).alias("a"), F.col("size").alias("n_a"))
    right = sizes.select(F.col(by).alias("b"), F.col("size").alias("n_b"))
    pairs = left.join(right, F.col("a") < F.col("b"))  # group names, one row each
    sides = pairs.select("a", "b", F.explode(F.array(
        F.struct(F.col("a").alias(by), F.lit(0).alias("side")),
        F.struct(F.col("b").alias(by), F.lit(1).alias("side")))).alias("s")).select("a", "b", "s.*")
    joined = sides.join(events, by)
    one = F.col("side") == 0
    times = joined.groupBy("a", "b", "t").agg(
        F.sum(F.when(one, F.col("n")).otherwise(0)).alias("na"), F.sum("n").alias("nt"),
        F.sum(F.when(one, F.col("d")).otherwise(0)).alias("da"), F.sum("d").alias("dt"))
    risk = scan(times, ["a", "b"], ["t"], [
        Scan("ra", F.col("na"), "sum", reverse=True), Scan("rt", F.col("nt"), "sum", reverse=True),
    ], plan_splits(times, ["a", "b"], "t"))
    ra, rt, d = (F.col(c).cast("double") for c in ("ra", "rt", "dt"))
    expected = d * ra / rt
    variance = F.when(rt > 1, d * (ra / rt) * (F.lit(1.0) - ra / rt) * (rt - d) / (rt - F.lit(1.0))).otherwise(0.0)
    sums = risk.groupBy("a", "b").agg(F.sum(F.col("da") - expected).alias("_u"), F.sum(variance).alias("_v"))
    count = pairs.agg(F.count(F.lit(1)).alias("comparisons")).withColumn("_one", F.lit(1))
    out = pairs.join(sums, ["a", "b"]).withColumn("statistic", F.try_divide(F.col("_u") * F.col("_u"), F.col("_v")))
    return out.withColumn("_one", F.lit(1)).join(F.broadcast(count), "_one").select(
        F.lit(by).alias("by"), "a", "b", "n_a", "n_b", "statistic",
        chi2_1_p("statistic").alias("p"), "comparisons")


def headline_median(cohort: DataFrame, *, by: Sequence[str] = ("scenario",), position: int = 10,
                    level: str = "lower", phase: str = "phase1", min_rows: int = 10) -> DataFrame:
    """Median days for one cut of joiners, per scenario: the sensitivity table."""
    by = list(by)
    cut = cohort.where((F.col("position") == position) & (F.col("level") == level) & (F.col("phase") == phase))
    found = medians(curves(event_table(cut, by), by), by).where(F.col("n") >= min_rows)
    totals = cohort.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return totals.join(found.select(*by, "median_days"), by, "left")


def cleared_by_instruction(cohort: DataFrame) -> DataFrame:
    """Share cleared before the first day of instruction, per position bucket."""
    limit = F.greatest(F.col("days_to_instruction"), F.lit(0.0))
    hit = (F.col("event") == 1) & (F.col("duration_days") <= limit)
    return cohort.groupBy("position_bucket").agg(F.avg(hit.cast("int")).alias("share_cleared"))


def read_survival(queries: DataFrame, points: DataFrame, by: Sequence[str], at: str, name: str,
                  *, left: bool = False) -> DataFrame:
    """Survival at each query time (just before it when ``left``), 1 before the first step."""
    return step_lookup(queries, points, by, at, "t", "survival", name, left=left)
