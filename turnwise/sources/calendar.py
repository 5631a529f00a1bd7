"""Enrolment calendars per term (fixed values)."""
from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Calendar:
    term_id: str
    name: str
    phase1_start: dt.date
    phase1_end: dt.date
    phase2_start: dt.date
    phase2_end: dt.date
    adjustment_start: dt.date
    instruction_start: dt.date
    last_auto_waitlist: dt.date
    add_drop_deadline: dt.date


def _term(term_id: str, name: str, *days: str) -> Calendar:
    return Calendar(term_id, name, *[dt.date.fromisoformat(d) for d in days])


# Phase 1 start and end, phase 2 start and end, adjustment start,
# instruction start, last automatic waiting-list run, add/drop deadline.
CALENDARS = {
    c.term_id: c
    for c in (
        _term("2262", "Spring 2026", "2025-10-27", "2025-11-16", "2025-11-24", "2026-01-11",
              "2026-01-12", "2026-01-20", "2026-02-06", "2026-02-11"),
        _term("2268", "Fall 2026", "2026-04-13", "2026-06-12", "2026-07-20", "2026-08-16",
              "2026-08-17", "2026-08-26", "2026-09-11", "2026-09-16"),
        _term("2272", "Spring 2027", "2026-10-26", "2026-11-15", "2026-11-23", "2027-01-10",
              "2027-01-11", "2027-01-19", "2027-02-05", "2027-02-10"),
    )
}


def calendar_for(term_id: str) -> Calendar:
    if str(term_id) not in CALENDARS:
        raise KeyError(f"no calendar for term {term_id!r}")
    return CALENDARS[str(term_id)]


def calendar_table(spark: SparkSession) -> DataFrame:
    """The calendars as a small dimension."""
    rows = [asdict(c) for c in CALENDARS.values()]
    order = list(Calendar.__dataclass_fields__)
    schema = ", ".join(f"{c} {'string' if c in ('term_id', 'name') else 'date'}" for c in order)
    return spark.createDataFrame([tuple(r[c] for c in order) for r in rows], schema)


def key_dates(spark: SparkSession, calendar: Calendar, today: dt.datetime) -> DataFrame:
    """The dates a reader counts down to, with days left (past once a full day ago)."""
    from pyspark.sql import functions as F

    from turnwise.functions.rules import days_between

    # Keys and labels.
    labels = [
        ("phase1_start", "Phase 1 opens"), ("phase2_start", "Phase 2 opens"),
        ("adjustment_start", "Adjustment period"), ("instruction_start", "First day of class"),
        ("last_auto_waitlist", "Last automatic waitlist run"), ("add_drop_deadline", "Add/drop deadline"),
    ]
    rows = [(i, key, label, getattr(calendar, key)) for i, (key, label) in enumerate(labels)]
    out = spark.createDataFrame(rows, "ordinal int, key string, label string, day date")
    now = F.lit(today.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    left = days_between(now, F.col("day").cast("timestamp"))
    return out.withColumn("days_left", left).withColumn("past", left < -1)
