"""Virtual joiners: thinning, the queue walk, follow-up and covariates.

A joiner's place falls as intervals pass. The optimistic case moves it up by
every admit and drop, the pessimistic case by admits alone; the central case
counts each drop as ahead with chance (k - 1) / (w - 1), which no running total
expresses. So the walk is a fold over the intervals in which something happens,
done for all joiners of many sections at once: each step advances every joiner
that is still waiting by its next interval.

Sections are spread over groups by hash. A hot section is cut into time ranges
first; joiners still waiting at the end of a range continue in the next one,
all ranges at the same time, until none is left.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.rules import days_between
from turnwise.functions.scalars import (
    course_level, days_to_instruction, joinable, phase_at, position_bucket, waitlist_ratio,
)
from turnwise.operators.scans import CHUNK, Scan, Splits, chunk_rows, plan_splits, scan, with_chunk
from turnwise.schema import POSITIONS, SCENARIOS
from turnwise.session import lookup_side, materialize

GROUP = "_group"
_EVENTS = ("section_id", CHUNK, "t0_us", "t1_us", "admits", "wl_drops", "waitlist0", "censored")
_WALKS_ON = ("section_id", "t0", "t1", "admits", "wl_drops", "waitlist0", "full0", "enrolled0", "capacity0", "reserved0", "censored")
_PAYLOAD = ("capacity0", "reserved", "follow_us")
_STATE = "section_id string, _chunk int, join_us long, position int, scenario string, k double, " \
         "waitlist0 long, capacity0 long, reserved boolean, follow_us long"
_WALKED = _STATE + ", end_us long, event int, open boolean"


def _groups(df: DataFrame, splits: Splits) -> int:
    """Groups to walk in: enough for all cores, and so many that one holds about a quarter of a chunk's rows."""
    return max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")),
               -(-4 * splits.rows // chunk_rows(df)))


def _with_group(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn(GROUP, F.pmod(F.xxhash64("section_id", CHUNK), F.lit(n)))


def _blocks(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frame: block number of each row and one-past-the-end row of each block."""
    if len(frame) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sid, chunk = frame["section_id"].to_numpy(), frame[CHUNK].to_numpy()
    new = np.ones(len(frame), bool)
    new[1:] = (sid[1:] != sid[:-1]) | (chunk[1:] != chunk[:-1])
    block = np.cumsum(new) - 1
    ends = np.append(np.flatnonzero(new)[1:], len(frame))
    return block, ends


def keep_spaced(block: np.ndarray, ends: np.ndarray, t_us: np.ndarray, gap_us: int,
                last_us: np.ndarray | None = None) -> np.ndarray:
    """Greedy thinning of every block at once: keep the first time, then each time
    at least ``gap_us`` after the last kept one (``last_us``: kept before the block)."""
    kept = np.zeros(len(t_us), bool)
    if len(t_us) == 0:
        return kept
    starts = np.append(0, ends[:-1])
    # Times as ranks among the distinct ones: block x rank stays below the square of the rows, whatever the years.
    times, rank = np.unique(t_us, return_inverse=True)
    span = len(times) + 1
    key = block * span + rank
    current, live = starts.copy(), np.arange(len(ends))
    if last_us is not None:
        known = ~np.isnan(last_us)
        wanted = np.where(known, np.where(known, last_us, 0).astype(np.int64) + gap_us, times[0])
        current = np.searchsorted(key, live * span + np.searchsorted(times, wanted))
    ok = current < ends[live]
    current, live = current[ok], live[ok]
    while len(live):
        kept[current] = True
        current = np.searchsorted(key, live * span + np.searchsorted(times, t_us[current] + gap_us))
        ok = current < ends[live]
        current, live = current[ok], live[ok]
    return kept


def walk(events: dict[str, np.ndarray], cursor: np.ndarray, stop: np.ndarray, k: np.ndarray,
         scenario: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Advance joiners through their intervals ``cursor .. stop-1``.

    Returns the place reached, the end time, the event flag and whether the
    joiner is still waiting when its intervals run out.
    """
    n = len(cursor)
    k, cursor = k.astype(float), cursor.copy()
    end, event, waiting = np.zeros(n, np.int64), np.zeros(n, np.int32), np.ones(n, bool)
    clear_at = 0.5 if scenario == "central" else 0.0
    live = np.flatnonzero(cursor < stop)
    while len(live):
        row = cursor[live]
        cut = events["censored"][row]
        if cut.any():
            gone = live[cut]
            end[gone], waiting[gone] = events["t0_us"][row[cut]], False
            live, row = live[~cut], row[~cut]
        admits, drops = events["admits"][row], events["wl_drops"][row]
        place = k[live]
        if scenario == "optimistic":
            step = admits + drops
        elif scenario == "pessimistic":
            step = admits
        else:
            others = events["waitlist0"][row] - 1.0
            share = np.where(others > 0, (place - 1.0) / np.where(others > 0, others, 1.0), 0.0)
            step = admits + drops * np.clip(share, 0.0, 1.0)
        place = place - step
        k[live] = place
        done = place <= clear_at
        if done.any():
            out = live[done]
            end[out], event[out], waiting[out] = events["t1_us"][row[done]], 1, False
        live = live[~done]
        cursor[live] += 1
        live = live[cursor[live] < stop[live]]
    return k, end, event, waiting


def _event_arrays(frame: pd.DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    censored = frame["censored"].to_numpy(bool)
    admits, drops = frame["admits"].to_numpy(np.int64), frame["wl_drops"].to_numpy(np.int64)
    rows = np.flatnonzero((admits > 0) | (drops > 0) | censored)
    arrays = {"censored": censored[rows], "admits": admits[rows], "wl_drops": drops[rows]}
    for name in ("t0_us", "t1_us", "waitlist0"):
        arrays[name] = frame[name].to_numpy(np.int64)[rows]
    return rows, arrays


def _walk_first(positions: Sequence[int], scenarios: Sequence[str], gap_us: int | None):
    places = np.asarray(sorted(positions), np.int64)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["section_id", CHUNK, "t0_us"], kind="stable", ignore_index=True)
        block, ends = _blocks(frame)
        if gap_us is not None:
            kept = keep_spaced(block, ends, frame["t0_us"].to_numpy(np.int64), gap_us)
        else:
            kept = frame["kept"].to_numpy(bool)
        joins = np.flatnonzero(kept & frame["joinable"].to_numpy(bool))
        at = np.repeat(joins, len(places))
        place = np.tile(places, len(joins))
        real = frame["waitlist0"].to_numpy(np.int64)[at] >= place - 1
        at, place = at[real], place[real]
        rows, events = _event_arrays(frame)
        cursor, stop = np.searchsorted(rows, at), np.searchsorted(rows, ends[block[at]])
        base = frame.iloc[at][["section_id", CHUNK, "t0_us", "waitlist0", *_PAYLOAD]]
        base = base.rename(columns={"t0_us": "join_us"}).reset_index(drop=True)
        base["position"] = place.astype(np.int32)
        pieces = []
        for scenario in scenarios:
            k, end, event, waiting = walk(events, cursor, stop, place, scenario)
            pieces.append(base.assign(scenario=scenario, k=k, end_us=end, event=event, open=waiting))
        return pd.concat(pieces, ignore_index=True)

    return run


def _walk_on(events_frame: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    frame = events_frame.sort_values(["section_id", CHUNK, "t0_us"], kind="stable", ignore_index=True)
    state = state.reset_index(drop=True)
    rows, events = _event_arrays(frame)
    block, ends = _blocks(frame)
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    where = {key: i for i, key in enumerate(zip(frame["section_id"].to_numpy()[starts],
                                                frame[CHUNK].to_numpy()[starts]))} if len(ends) else {}
    mine = np.array([where.get(key, -1) for key in zip(state["section_id"], state[CHUNK])], np.int64)
    lo = np.where(mine >= 0, np.searchsorted(rows, starts[mine]) if len(ends) else 0, 0)
    hi = np.where(mine >= 0, np.searchsorted(rows, ends[mine]) if len(ends) else 0, 0)
    pieces = []
    for scenario in state["scenario"].unique():
        pick = (state["scenario"] == scenario).to_numpy()
        k, end, event, waiting = walk(events, lo[pick], hi[pick], state["k"].to_numpy(float)[pick], scenario)
        pieces.append(state[pick].assign(k=k, end_us=end, event=event, open=waiting))
    names = [c.split()[0] for c in _WALKED.split(", ")]
    return pd.concat(pieces, ignore_index=True)[names] if pieces else pd.DataFrame(columns=names)


def thin_joins(flows: DataFrame, every_min: float = 240, splits: Splits | None = None) -> DataFrame:
    """Add ``kept``: the greedy thinning of each section's interval starts.

    The rule depends on the last kept time alone, so a range of a hot section is
    a function of it: see ``_thin_by_ranges``.
    """
    if splits is None:
        flows = materialize(flows)  # counted, thinned and joined
        splits = plan_splits(flows, ["section_id"], "t0")
    gap_us = int(round(every_min * 60_000_000))
    rows = with_chunk(flows.select("section_id", "t0"), splits)
    rows = rows.withColumn("t0_us", F.unix_micros("t0")).drop("t0")
    schema = "section_id string, t0_us long"
    n = _groups(flows, splits)

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["section_id", CHUNK, "t0_us"], ignore_index=True)
        block, ends = _blocks(frame)
        kept = keep_spaced(block, ends, frame["t0_us"].to_numpy(np.int64), gap_us)
        return frame.loc[kept, ["section_id", "t0_us"]]

    if not splits.hot:
        kept = _with_group(rows, n).groupBy(GROUP).applyInPandas(first, schema)
    else:
        kept = _thin_by_ranges(rows, gap_us, n)
    kept = kept.select("section_id", F.timestamp_micros("t0_us").alias("t0"), F.lit(True).alias("kept"))
    return flows.join(kept, ["section_id", "t0"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def exit_map(t_us: np.ndarray, gap_us: int) -> tuple[np.ndarray, np.ndarray]:
    """What a range of sorted times does to the last kept time, as a step function.

    An entry of at most ``bounds[i]`` (and above the bound before) leaves as ``exits[i]``; one above all bounds keeps
    nothing here and leaves as it came. Entries lie before the range, so only times within one gap of its start, and the
    next one, can be the first kept, and chains from there soon meet: the function has few steps.
    """
    n = len(t_us)
    starts = min(n, np.searchsorted(t_us, t_us[0] + gap_us) + 1)
    after = np.searchsorted(t_us, t_us + gap_us)
    last = np.where(after < n, after, np.arange(n))
    while (last != last[last]).any():  # twice as many kept times are followed in each round
        last = last[last]
    bounds, exits = t_us[:starts] - gap_us, t_us[last[:starts]]
    step = np.append(exits[1:] != exits[:-1], True)
    return bounds[step], exits[step]


def _thin_by_ranges(rows: DataFrame, gap_us: int, n: int) -> DataFrame:
    """Each range of a hot section as a function of the last kept time before it, all at once; the functions of a section
    composed in order, one small row a range; then every range thinned from the entry it has, again all at once."""
    rows = _with_group(materialize(rows), n)

    def maps(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["section_id", CHUNK, "t0_us"], ignore_index=True)
        block, ends = _blocks(frame)
        starts, t = np.append(0, ends[:-1]), frame["t0_us"].to_numpy(np.int64)
        steps = [exit_map(t[a:b], gap_us) for a, b in zip(starts, ends)]
        return pd.DataFrame({"section_id": frame["section_id"].to_numpy()[starts], CHUNK: frame[CHUNK].to_numpy()[starts],
                             "bounds": [b for b, _ in steps], "exits": [e for _, e in steps]})

    def entries(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(CHUNK, ignore_index=True)
        last, out = None, []
        for bounds, exits in zip(frame["bounds"], frame["exits"]):
            out.append(last)
            at = 0 if last is None else int(np.searchsorted(bounds, last))
            last = int(exits[at]) if at < len(bounds) else last
        return frame[["section_id", CHUNK]].assign(last_us=pd.array(out, dtype="Int64"))

    def thin(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0:
            return left[["section_id", "t0_us"]]
        frame = left.sort_values(["section_id", CHUNK, "t0_us"], ignore_index=True)
        block, ends = _blocks(frame)
        own = frame.iloc[np.append(0, ends[:-1])][["section_id", CHUNK]].merge(right, on=["section_id", CHUNK], how="left")
        # microseconds stay exact in a double for dates before the year 2255
        kept = keep_spaced(block, ends, frame["t0_us"].to_numpy(np.int64), gap_us, own["last_us"].to_numpy(float, na_value=np.nan))
        return frame.loc[kept, ["section_id", "t0_us"]]

    steps = rows.groupBy(GROUP).applyInPandas(maps, f"section_id string, {CHUNK} int, bounds array<long>, exits array<long>")
    known = steps.groupBy("section_id").applyInPandas(entries, f"section_id string, {CHUNK} int, last_us long")
    return rows.groupBy(GROUP).cogroup(_with_group(known, n).groupBy(GROUP)).applyInPandas(thin, "section_id string, t0_us long")


def walk_positions(
    flows: DataFrame,
    *,
    scenarios: Sequence[str] = ("central",),
    positions: Sequence[int] = POSITIONS,
    join_every_min: float | None = 240,
    only_joinable: bool = True,
    splits: Splits | None = None,
) -> DataFrame:
    """One row per joiner and scenario of one term's flows: join time, place, duration and event.

    ``join_every_min`` None starts a joiner at every interval.
    """
    for name in scenarios:
        if name not in SCENARIOS:
            raise ValueError(f"unknown scenario {name!r}; expected one of {SCENARIOS}")
    if splits is None:
        flows = materialize(flows.select(*_WALKS_ON))  # counted, then walked
        splits = plan_splits(flows, ["section_id"], "t0")
    n = _groups(flows, splits)
    can_join = joinable(F.col("waitlist0"), F.col("full0"), F.col("enrolled0"), F.col("capacity0"))
    gap_us = None if join_every_min is None else int(round(join_every_min * 60_000_000))
    if join_every_min is None:
        flows = flows.withColumn("kept", F.lit(True))
    elif splits.hot:
        flows, gap_us = thin_joins(flows, join_every_min, splits), None
    else:
        flows = flows.withColumn("kept", F.lit(True))
    rows = with_chunk(flows, splits).select(
        "section_id", CHUNK, "t0", F.unix_micros("t0").alias("t0_us"), F.unix_micros("t1").alias("t1_us"),
        "admits", "wl_drops", "waitlist0", F.coalesce("censored", F.lit(False)).alias("censored"),
        F.coalesce("capacity0", F.lit(0)).alias("capacity0"),
        (F.coalesce("reserved0", F.lit(0)) > 0).alias("reserved"),
        (can_join if only_joinable else F.lit(True)).alias("joinable"), "kept",
    )
    rows = follow_up(rows, splits, n)
    if splits.hot:
        rows = materialize(rows)
    walked = rows.groupBy(GROUP).applyInPandas(_walk_first(positions, scenarios, gap_us), _WALKED)
    if splits.hot:
        walked = _continue(rows, walked, n)
    end = F.when(F.col("open"), F.col("follow_us")).otherwise(F.col("end_us"))
    return walked.select(
        "section_id", F.timestamp_micros("join_us").alias("join_time"), "position", "scenario",
        "waitlist0", "capacity0", "reserved", "event",
        ((end - F.col("join_us")) / F.lit(60_000_000.0)).alias("duration_min"),
        ((F.col("follow_us") - F.col("join_us")) / F.lit(86_400_000_000.0)).alias("follow_up_days"),
    )


def follow_up(rows: DataFrame, splits: Splits, n_groups: int) -> DataFrame:
    """Add ``follow_us``: start of the first censored interval at or after the row,
    else the end of the section's data. Windows share the walk's grouping, so
    this adds no shuffle of its own."""
    rows = _with_group(rows, n_groups)
    keys = ["section_id"] if splits.hot else [GROUP, "section_id"]
    cut = F.when(F.col("censored"), F.col("t0_us"))
    rows = scan(rows, keys, ["t0", "t0_us"], [
        Scan("_cut", cut, "min", reverse=True), Scan("_end", F.col("t1_us"), "max", reverse=True),
    ], Splits(("section_id",), "t0", splits.bounds, splits.chunks) if splits.hot else None)
    return rows.withColumn("follow_us", F.coalesce("_cut", "_end")).drop("_cut", "_end", "t0")


def censoring_horizon(flows: DataFrame, joins: DataFrame, splits: Splits | None = None) -> DataFrame:
    """Minutes from each (``section_id, join_time``) to the end of what is observed for a joiner who didn't clear.

    That is the end of the last interval before the first censored one at or after the join, or the censored interval's
    start if it comes first; null when no interval starts at or after the join.
    """
    keys = ["section_id"]
    splits = splits or plan_splits(flows, keys, "t0")
    rows = flows.select("section_id", "t0", "t1", F.coalesce("censored", F.lit(False)).alias("censored"))
    rows = scan(rows, keys, ["t0"], [Scan("_before", F.struct("t1"), "prev")], splits)
    cut = F.when(F.col("censored"), F.struct("t0", F.coalesce("_before.t1", "t0").alias("end")))
    rows = scan(rows, keys, ["t0"], [Scan("_cut", cut, "last", reverse=True),
                                     Scan("_end", F.col("t1"), "max", reverse=True)], splits)
    horizon = F.when(F.col("censored"), F.col("t0")).otherwise(F.coalesce("_cut.end", "_end"))
    merged = rows.select("section_id", F.col("t0").alias("at"), F.lit(1).alias("_side"), horizon.alias("_horizon")).unionByName(
        joins.select("section_id", F.col("join_time").alias("at"), F.lit(0).alias("_side"),
                     F.lit(None).cast("timestamp").alias("_horizon")))
    # the next interval at or after the join tells the horizon
    ahead = scan(merged, keys, ["at", "_side"], [Scan("_next", F.col("_horizon"), "last", reverse=True)],
                 Splits(("section_id",), "at", splits.bounds, splits.chunks) if splits.hot else None)
    minutes = (F.unix_micros("_next") - F.unix_micros("at")) / F.lit(60_000_000.0)
    return ahead.where("_side = 0").select("section_id", F.col("at").alias("join_time"),
                                           F.greatest(minutes, F.when(minutes.isNotNull(), F.lit(0.0))).alias("horizon_min"))


def _continue(rows: DataFrame, walked: DataFrame, n: int) -> DataFrame:
    """Carry joiners that outlived their range into the next one until none waits. A round moves all of them at once and
    reads the events of the ranges that some joiner has come to, no others."""
    last = rows.groupBy("section_id").agg(F.max(CHUNK).alias("_last"))
    done: list[DataFrame] = []
    events = rows.select(GROUP, *_EVENTS)
    while True:
        walked = materialize(walked.join(last, "section_id").withColumn(
            "_more", F.col("open") & (F.col(CHUNK) < F.col("_last"))).drop("_last"))
        done.append(walked.where(~F.col("_more")).drop("_more"))
        waiting = walked.where("_more").select(
            *[(F.col(CHUNK) + 1).alias(CHUNK) if c == CHUNK else F.col(c) for c in
              (p.split()[0] for p in _STATE.split(", "))])
        if waiting.isEmpty():
            break
        reached = lookup_side(waiting.select("section_id", CHUNK).distinct())
        ahead = events.join(reached, ["section_id", CHUNK], "left_semi")
        walked = ahead.groupBy(GROUP).cogroup(_with_group(waiting, n).groupBy(GROUP)).applyInPandas(
            lambda left, right: _walk_on(left, right), _WALKED)
    out = done[0]
    for piece in done[1:]:
        out = out.unionByName(piece)
    return out


def virtual_waitlisters(flows: DataFrame, *, positions: Sequence[int] = (1, 3, 5, 10, 20, 40),
                        scenario: str = "central") -> DataFrame:
    """A joiner at every interval start; the duration is null when censored."""
    walked = walk_positions(flows, scenarios=(scenario,), positions=positions, join_every_min=None,
                            only_joinable=False)
    return walked.select(
        "section_id", "join_time", "position", "waitlist0",
        F.when(F.col("event") == 1, F.col("duration_min")).alias("duration_min"), "event", "scenario",
    )


def build_cohort(
    flows: DataFrame,
    identity: DataFrame,
    calendar,
    *,
    scenarios: Sequence[str] = ("central",),
    positions: Sequence[int] = POSITIONS,
    join_every_min: float = 240,
    min_sections_per_group: int = 30,
    splits: Splits | None = None,
) -> DataFrame:
    """Joiners with the covariates known at the moment of joining."""
    walked = walk_positions(flows, scenarios=scenarios, positions=positions,
                            join_every_min=join_every_min, splits=splits)
    who = identity.select("section_id", "course_key", "subject", "catalog_number", "component")
    rows = walked.where(F.col("duration_min") > 0).join(who, "section_id", "left")
    rows = rows.select(
        "section_id", "join_time", "position",
        position_bucket(F.col("position")).alias("position_bucket"),
        F.log(F.col("position").cast("double")).alias("log_position"),
        F.col("waitlist0").cast("int").alias("waitlist0"), F.col("capacity0").cast("int").alias("capacity0"),
        waitlist_ratio(F.col("waitlist0"), F.col("capacity0")).alias("wl_ratio"),
        "duration_min", (F.col("duration_min") / 1440.0).alias("duration_days"), "event", "follow_up_days",
        "course_key", "subject", "catalog_number", "component",
        course_level(F.col("catalog_number")).alias("level"), F.col("subject").alias("dept_group"),
        phase_at(F.col("join_time"), calendar).alias("phase"),
        days_to_instruction(F.col("join_time"), calendar).alias("days_to_instruction"),
        "reserved", "scenario",
    )
    # the walk is the expensive part: written once, then read for the group sizes and the result
    return pool_small_groups(materialize(rows), min_sections_per_group)


def pool_small_groups(cohort: DataFrame, min_sections: int = 30, other: str = "OTHER") -> DataFrame:
    """Departments with fewer distinct sections (per scenario) become ``other``."""
    sizes = cohort.where(F.col("dept_group").isNotNull()).groupBy("scenario", "dept_group").agg(
        F.count_distinct("section_id").alias("_sections"))
    small = sizes.where(F.col("_sections") < min_sections).select("scenario", "dept_group", F.lit(other).alias("_pool"))
    out = cohort.join(lookup_side(small), ["scenario", "dept_group"], "left")
    return out.withColumn("dept_group", F.coalesce("_pool", "dept_group")).select(*cohort.columns)
