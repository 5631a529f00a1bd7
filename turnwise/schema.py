"""Pinned schemas and shared constants."""
from __future__ import annotations

from pyspark.sql import types as T


# The columns of a snapshot row, in order.
SNAPSHOT = (
    T.StructType()
    .add("fetched_at", "timestamp", False).add("term_id", "string", False).add("section_id", "string", False)
    .add("course_key", "string", False).add("subject", "string", False).add("catalog_number", "string", False)
    .add("class_number", "string", False).add("section_number", "string", False).add("component", "string", False)
    .add("is_primary", "boolean").add("session_id", "string", False).add("enrolled_count", "integer", False)
    .add("enroll_capacity", "integer", False).add("waitlist_count", "integer", False)
    .add("waitlist_capacity", "integer", False).add("reserved_count", "integer").add("open_reserved", "integer")
    .add("status", "string", False).add("section_status", "string").add("source", "string", False)
)

# A change in any of these makes a section worth writing again.
COUNT_FIELDS = (
    "enrolled_count", "enroll_capacity", "waitlist_count", "waitlist_capacity",
    "reserved_count", "open_reserved", "status", "section_status",
)
CORE_COUNTS = COUNT_FIELDS[:4]
NUMERIC_COUNTS = COUNT_FIELDS[:6]
# The attributes of a section.
IDENTITY_FIELDS = (
    "course_key", "subject", "catalog_number", "class_number", "section_number",
    "component", "is_primary", "session_id",
)
TOMBSTONE = "GONE"

# The columns of the run table, in order.
RUNS = (
    T.StructType()
    .add("run_started_at", "timestamp", False).add("term_id", "string", False)
    .add("source", "string", False).add("kind", "string", False).add("scope", "string", False)
    .add("shard", "string").add("priority_sha", "string")
    .add("missing_ids", T.ArrayType(T.StringType())).add("n_observed", "integer", False)
    .add("n_written", "integer", False).add("observed_ids", T.ArrayType(T.StringType()))
    .add("complete", "boolean")
)

FLOW_NAMES = ("admits", "wl_joins", "wl_drops", "enr_joins", "enr_drops")
FLOW_COLUMNS = (
    "section_id", "t0", "t1", "interval_min", "d_enrolled", "d_waitlist", "d_capacity",
    "d_wl_capacity", "enrolled0", "capacity0", "waitlist0", "reserved0", "open_reserved0",
    "full0", *FLOW_NAMES, "expansion", "ambiguous", "censored", "rule",
)
SCENARIOS = ("optimistic", "central", "pessimistic")

# Bucket bounds, joiner positions, curve days, horizons and category orders.
BUCKETS = ((1, 5, "1-5"), (6, 15, "6-15"), (16, 40, "16-40"), (41, 10**9, "41+"))
BUCKET_ORDER = ("1-5", "6-15", "16-40", "41+")
LEVEL_ORDER = ("lower", "upper", "grad")
PHASE_ORDER = ("before", "phase1", "between", "phase2", "adjustment", "instruction", "after")
POSITIONS = (1, 2, 3, 5, 7, 10, 15, 20, 30, 40, 60, 100)
CURVE_DAYS = (
    0.5, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 18, 21, 24, 28, 32, 36, 42, 49, 56, 63,
    70, 77, 84, 98, 112, 126, 140, 154, 168, 182,
)
HORIZONS = (7.0, 14.0, 28.0)
SELF_STUDY = (
    "IND", "GRP", "FLD", "TUT", "INT", "SLF", "PRA", "REC", "SES", "CLN", "WOR", "REA",
    "WBD", "VOL", "DEM",
)
