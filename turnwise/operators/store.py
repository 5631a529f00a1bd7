"""Baseline-plus-delta snapshots: state, deltas, tombstones, panel rebuild, gates."""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators.scans import Scan, chunk_rows, plan_splits, scan
from turnwise.schema import COUNT_FIELDS, IDENTITY_FIELDS, SNAPSHOT, TOMBSTONE
from turnwise.session import checked_broadcast

LOOKBACK_DAYS = 7
RUN_KEYS = ("run_started_at", "kind")  # a baseline sorts before a delta of the same time


def term_keys(df: DataFrame) -> list[str]:
    """What names a section: its id within its term; an id alone where the rows have no term."""
    return [c for c in ("term_id", "section_id") if c in df.columns]


def snapshot_fields(df: DataFrame) -> list[str]:
    return [f.name for f in SNAPSHOT.fields if f.name in df.columns]


# ------------------------------------------------------------------ validation


def validate_snapshots(rows: DataFrame, sources: Sequence[str], run_key: str = "fetched_at") -> DataFrame:
    """Violations of the snapshot contract as ``rule, field, violations``.

    Column names and types are checked from metadata; nulls, unknown sources
    and ids repeated within a run in one aggregation each.
    """
    spark = rows.sparkSession
    have = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    found = []
    for f in SNAPSHOT.fields:
        if f.name not in have:
            found.append(("missing_column", f.name, 1))
        elif have[f.name] != f.dataType.simpleString():
            found.append(("wrong_type", f.name, 1))
    found += [("extra_column", c, 1) for c in have if c not in SNAPSHOT.fieldNames() and c != run_key]
    required = [f.name for f in SNAPSHOT.fields if not f.nullable and f.name in have]
    known = F.col("source").isin(*sources)
    counts = rows.agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in required],
        F.count_if(~known).alias("_source"),
    )
    checks = [F.struct(F.lit("null_value").alias("rule"), F.lit(c).alias("field"), F.col(c).alias("violations"))
              for c in required]
    checks.append(F.struct(F.lit("unknown_source").alias("rule"), F.lit("source").alias("field"),
                           F.col("_source").alias("violations")))
    valued = counts.select(F.inline(F.array(*checks)))
    repeated = rows.groupBy(run_key, "term_id", "section_id").count().where("count > 1")
    repeated = repeated.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit("duplicate_id").alias("rule"), F.lit("section_id").alias("field"), "violations")
    out = valued.unionByName(repeated)
    if found:
        out = out.unionByName(spark.createDataFrame(found, "rule string, field string, violations long"))
    return out.where(F.col("violations") > 0)


# ---------------------------------------------------------------- state and delta


def state_as_of(rows: DataFrame, as_of: dt.date, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Latest row of every id over the window's files (partition-pruned on ``date``)."""
    if lookback_days < 0:
        raise ValueError(f"lookback_days must be >= 0, got {lookback_days}")
    first = as_of - dt.timedelta(days=lookback_days)
    window = rows.where((F.col("date") >= F.lit(first)) & (F.col("date") <= F.lit(as_of)))
    fields = snapshot_fields(rows)
    latest = window.groupBy("term_id", "section_id").agg(
        F.max_by(F.struct(*[c for c in fields if c not in ("term_id", "section_id")]),
                 F.struct(*RUN_KEYS)).alias("_row"))
    return latest.select("term_id", "section_id", "_row.*").select(*fields)


def latest_baseline(runs: DataFrame, term_id: str, day: dt.date) -> DataFrame:
    """The day's latest baseline run of the term (no row when there is none)."""
    today = runs.where((F.col("term_id") == term_id) & (F.to_date("run_started_at") == F.lit(day))
                       & (F.col("kind") == "baseline"))
    return today.groupBy("term_id").agg(
        F.max_by(F.struct("source", "scope", "n_observed"), "run_started_at").alias("_r"),
        F.max("run_started_at").alias("run_started_at"),
    ).select("term_id", "run_started_at", "_r.*")


def latest_state(rows: DataFrame, runs: DataFrame, term_id: str, day: dt.date, *,
                 seed_from_previous_days: bool = True, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """State a delta compares with: empty unless the day already has a baseline."""
    state = state_as_of(rows.where(F.col("term_id") == term_id), day,
                        lookback_days if seed_from_previous_days else 0)
    return state.join(latest_baseline(runs, term_id, day).select("term_id"), "term_id", "left_semi") \
        .select(*state.columns)


def changed_rows(previous: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed rows that are new or differ in any count field (null-safe)."""
    before = previous.select(F.col("section_id").alias("_id"), *[F.col(c).alias(f"_p_{c}") for c in COUNT_FIELDS])
    same = F.lit(True)
    for c in COUNT_FIELDS:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    joined = observed.join(before, observed["section_id"] == before["_id"], "left")
    return joined.where(F.col("_id").isNull() | ~same).select(*observed.columns)


def tombstones(previous: DataFrame, observed: DataFrame, universe: DataFrame | None,
               fetched_at: dt.datetime, source: str) -> DataFrame:
    """Rows marking ids that vanished: known before, from the same source, neither
    observed nor in the universe, not already marked. No universe, no tombstones."""
    if universe is None:
        return previous.limit(0)
    alive = previous.where((F.coalesce("section_status", F.lit("")) != TOMBSTONE) & (F.col("source") == source))
    gone = alive.join(observed.select("section_id"), "section_id", "left_anti")
    gone = gone.join(universe.select("section_id"), "section_id", "left_anti")
    return gone.withColumns({
        "fetched_at": F.lit(fetched_at).cast("timestamp"),
        "section_status": F.lit(TOMBSTONE), "source": F.lit(source),
    }).select(*previous.columns)


def compute_delta(previous: DataFrame, observed: DataFrame, universe: DataFrame | None,
                  fetched_at: dt.datetime, source: str) -> DataFrame:
    return changed_rows(previous, observed).unionByName(
        tombstones(previous, observed, universe, fetched_at, source))


def baseline_with_tombstones(previous: DataFrame, observed: DataFrame, universe: DataFrame | None,
                             fetched_at: dt.datetime, source: str) -> DataFrame:
    return observed.unionByName(tombstones(previous, observed, universe, fetched_at, source))


def section_identity(rows: DataFrame) -> DataFrame:
    """Latest non-null attributes of each term's section and when it was first and last seen."""
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("fetched_at"))).alias(c)
              for c in IDENTITY_FIELDS if c in rows.columns]
    return rows.groupBy(*term_keys(rows)).agg(
        *latest, F.min("fetched_at").alias("first_seen"), F.max("fetched_at").alias("last_seen"))


# -------------------------------------------------------------------- panel rebuild


def run_marks(runs: DataFrame) -> DataFrame:
    """The id lists of the run table as rows: ``term_id, run_started_at, kind, section_id, declared, missing``."""
    part = lambda c, declared: runs.select(
        "term_id", *RUN_KEYS, F.explode(c).alias("section_id"), F.lit(declared).alias("declared"), F.lit(not declared).alias("missing"))
    return part("observed_ids", True).unionByName(part("missing_ids", False))


def missing_count(runs: DataFrame) -> Column:
    return F.col("n_missing") if "n_missing" in runs.columns else F.size(
        F.coalesce("missing_ids", F.array().cast("array<string>")))


def rebuild_panel(rows: DataFrame, runs: DataFrame, marks: DataFrame | None = None,
                  start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Every (section, run) of a term from the section's first appearance on, values carried forward.

    Terms never mix: a section that exists in two terms is two sections, and a run reads its own term only.
    ``rows`` are snapshot rows with ``run_started_at`` and ``kind``; ``runs`` is
    the run table; ``marks`` its id lists as rows (taken from its arrays when
    absent, with ``lists`` telling which runs declare their ids). Rows before
    ``start`` feed the carried state but are not returned, so the date filter
    stays above the window.
    """
    if marks is None:
        marks = run_marks(runs)
    if "lists" not in runs.columns:
        runs = runs.withColumn("lists", F.col("observed_ids").isNotNull())
    if end is not None:
        rows = rows.where(F.to_date("run_started_at") <= F.lit(end))
        runs = runs.where(F.to_date("run_started_at") <= F.lit(end))
    values = F.struct(*COUNT_FIELDS)
    ids = ["term_id", "section_id"]
    held = rows.select(*ids, *RUN_KEYS, values.alias("_held"))
    grid = run_grid(held, runs)
    splits = None
    if runs.count() > chunk_rows(runs):  # a section has at most one row per run
        splits = plan_splits(grid, ids, "run_started_at")
    joined = grid.join(held, [*ids, *RUN_KEYS], "left")
    full = scan(joined, ids, list(RUN_KEYS), [Scan("_state", F.col("_held"), "last")], splits)
    if start is not None:
        full = full.where(F.to_date("run_started_at") >= F.lit(start))
    keys = [*ids, *RUN_KEYS]
    marked = marks.groupBy(*keys).agg(F.max("declared").alias("_declared"), F.max("missing").alias("_missing"))
    full = full.join(marked, keys, "left")
    return full.select(
        "section_id", "run_started_at", "_state.*", observed_flag().alias("observed"),
        "source", "scope", "kind", "term_id",
    )


def run_grid(held: DataFrame, runs: DataFrame) -> DataFrame:
    """A term's runs at or after each of its sections' first row, matched day by day.

    The grid is the result's own size. The runs travel to the sections when their number was checked to be small, so
    the sections of a day need not meet in one task.
    """
    first = held.groupBy("term_id", "section_id").agg(F.min(F.struct(*RUN_KEYS)).alias("_first"))
    last = runs.agg(F.max(F.to_date("run_started_at")).alias("_last")).withColumn("_one", F.lit(1))
    days = first.withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one").select(
        "term_id", "section_id", "_first",
        F.explode(F.sequence(F.to_date("_first.run_started_at"), F.col("_last"))).alias("_day"))
    listed = runs.select(*RUN_KEYS, "source", "scope", "term_id", F.col("lists").alias("_lists"),
                         F.to_date("run_started_at").alias("_day"))
    return days.join(checked_broadcast(listed), ["term_id", "_day"]).where(F.struct(*RUN_KEYS) >= F.col("_first")).drop("_day", "_first")


def observed_flag() -> Column:
    """((declared, or in a priority file, or a full sweep) and not missing) or gone."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    seen = (
        F.when(F.col("_lists"), yes("_declared"))
        .when(F.col("scope") == "priority", F.col("_held").isNotNull())
        .otherwise(F.lit(True))
    )
    gone = F.coalesce(F.col("_state.section_status") == TOMBSTONE, F.lit(False))
    return (seen & ~yes("_missing")) | gone


def with_identity(panel: DataFrame, identity: DataFrame) -> DataFrame:
    return panel.join(identity.drop("first_seen", "last_seen"),
                      [c for c in term_keys(panel) if c in identity.columns], "left")


# ------------------------------------------------------------------------ run gates


def run_gates(runs: DataFrame, max_missing_share: float = 0.5) -> DataFrame:
    """Per run: missing share, whether it may be written, whether it may tombstone."""
    missing = missing_count(runs)
    total = F.col("n_observed") + missing
    share = F.when(total > 0, missing / total).otherwise(F.lit(0.0))
    return runs.withColumns({
        "missing_share": F.round(share, 4),
        "accepted": share <= F.lit(max_missing_share),
        "may_tombstone": (F.col("scope") == "full") & F.coalesce("complete", F.lit(False)),
    })


def run_kinds(runs: DataFrame) -> DataFrame:
    """What each run should be: a baseline for the first run of a term's UTC day, else a delta."""
    first = runs.groupBy("term_id", F.to_date("run_started_at").alias("date")).agg(
        F.min("run_started_at").alias("_first"))
    keyed = runs.withColumn("date", F.to_date("run_started_at"))
    return keyed.join(first, ["term_id", "date"]).select(
        "term_id", "date", "run_started_at",
        F.when(F.col("run_started_at") == F.col("_first"), "baseline").otherwise("delta").alias("decided"))


def source_mismatches(runs: DataFrame) -> DataFrame:
    """Deltas whose day's latest baseline before them came from another source; later baselines don't count.

    A term's day holds as many runs as were started on it, so the window stays small.
    """
    dated = runs.withColumn("date", F.to_date("run_started_at"))
    before = Window.partitionBy("term_id", "date").orderBy(*RUN_KEYS).rowsBetween(Window.unboundedPreceding, 0)
    base = F.last(F.when(F.col("kind") == "baseline", F.col("source")), ignorenulls=True).over(before)
    return dated.withColumn("baseline_source", base).where(
        (F.col("kind") == "delta") & (F.col("source") != F.col("baseline_source"))).select(
        "term_id", "date", "run_started_at", "source", "baseline_source")


def effective_term(rows: DataFrame, derived: str) -> DataFrame:
    """The single observed term wins; mixed values fall back to the derived one."""
    return rows.agg(
        F.when(F.count_distinct("term_id") == 1, F.min("term_id")).otherwise(F.lit(derived)).alias("term_id"))


def last_run_status(runs: DataFrame) -> DataFrame:
    missing = missing_count(runs)
    row = F.struct("run_started_at", "source", "kind", "scope", "shard", "n_observed", "n_written",
                   missing.alias("n_missing"),
                   F.round(F.coalesce(F.try_divide(missing, F.col("n_observed") + missing), F.lit(0.0)), 4)
                   .alias("missing_share"), "complete")
    return runs.groupBy("term_id").agg(F.max_by(row, "run_started_at").alias("_r")).select("term_id", "_r.*")


# ------------------------------------------------------------------------ live view


def live_view(state: DataFrame, only_active: bool = True) -> DataFrame:
    """Every section of a course with at least one full or waiting section.

    A section counts as gone when either status column says so.
    """
    from turnwise.functions.scalars import is_active

    here = state.where((F.col("status") != TOMBSTONE) & (F.coalesce("section_status", F.lit("")) != TOMBSTONE))
    if only_active:
        busy = here.where(is_active(F.col("enrolled_count"), F.col("enroll_capacity"), F.col("waitlist_count")))
        here = here.join(busy.select("course_key").distinct(), "course_key", "left_semi")
    return here.select(
        "section_id", "course_key", "subject", "catalog_number", "component", "section_number",
        F.col("enrolled_count").alias("enrolled"), F.col("enroll_capacity").alias("capacity"),
        F.col("waitlist_count").alias("waitlist"), "waitlist_capacity", "reserved_count", "open_reserved",
        "status", F.col("fetched_at").alias("observed_at"),
    )


def live_board(live: DataFrame, now: Column, stale_min: float = 360.0) -> DataFrame:
    """Seats open, a status word and the age of each row of the live view."""
    from turnwise.functions.scalars import board_status, seats_open

    age = F.greatest(F.lit(0), F.round((F.unix_micros(now) - F.unix_micros("observed_at")) / 60_000_000.0))
    status = board_status(F.col("enrolled"), F.col("capacity"), F.col("waitlist"), F.col("open_reserved"))
    return live.withColumns({
        "seats_open": F.when(status != "not read", seats_open(F.col("capacity"), F.col("enrolled"))),
        "board_status": status, "age_min": age.cast("long"), "stale": age >= stale_min,
    })
