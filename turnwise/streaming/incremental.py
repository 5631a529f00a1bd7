"""Incremental forms of the capture step on Structured Streaming.

State is one small row per section (its last counts) or per term (its last
run). By default results come at once, and rows at or before the state's time are
late and ignored. With ``wait`` a section's rows are held in its state, in order, until
the watermark has passed them: a row that comes late, but within the watermark, is
placed where it belongs, and results are the batch form's, later by the watermark.
"""
from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnwise.operators.flows import flows_of_pairs
from turnwise.operators.store import live_view, run_kinds
from turnwise.schema import CORE_COUNTS, COUNT_FIELDS, TOMBSTONE

_OBSERVED = ("run_us long, enrolled_count int, enroll_capacity int, waitlist_count int, waitlist_capacity int, "
             "reserved_count int, open_reserved int")
_OBS_NAMES = [c.split()[0] for c in _OBSERVED.split(", ")]
_ROW = ("run_us long, enrolled_count int, enroll_capacity int, waitlist_count int, waitlist_capacity int, "
        "reserved_count int, open_reserved int, status string, section_status string")
_ROW_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _sorted(frames: Iterator[pd.DataFrame], last_us: int | None) -> pd.DataFrame | None:
    """A key's new rows in order, without those at or before the state's time; None if nothing is left."""
    frames = [f for f in frames if len(f)]
    if not frames:
        return None
    frame = pd.concat(frames, ignore_index=True).sort_values("run_us", kind="stable", ignore_index=True)
    if last_us is not None:
        frame = frame[frame["run_us"] > last_us].reset_index(drop=True)
    return frame if len(frame) else None


def _state_of(frame: pd.DataFrame, names: list[str]) -> tuple:
    """The last row as plain integers and texts."""
    values = [frame[c].iloc[-1] for c in names]  # by column: a row of a frame would turn its integers into floats
    return tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in values)


def _after(frame: pd.DataFrame, state: tuple | None, names: list[str]) -> pd.DataFrame:
    """The rows with the state's row, if there is one, before them."""
    if state is None:
        return frame[names]
    before = pd.DataFrame([state], columns=names).astype(object)
    return pd.concat([before, frame[names].astype(object)], ignore_index=True)


def _plain(frame: pd.DataFrame) -> list[list]:
    """Rows as plain values, fit for JSON."""
    plain = lambda v: None if pd.isna(v) else v if isinstance(v, str) else bool(v) if isinstance(v, (bool, np.bool_)) else int(v)
    return [[plain(v) for v in row] for row in frame.astype(object).itertuples(index=False)]


def _in_order(step: Callable, names: list[str], columns: list[str], key_names: list[str]):
    """``step`` on a key's rows once the watermark has passed them. ``names`` (run_us first) are what a row holds; the rows
    that wait, those of one watermark's length, are kept with the step's state, and an event-time timer wakes the key."""
    def run(key, frames, state: GroupState):
        held, rows = json.loads(state.get[0]) if state.exists else (None, [])
        if not state.hasTimedOut:
            for frame in frames:
                rows += _plain(frame[names])
        mark_ms = state.getCurrentWatermarkMs()
        since = None if held is None else held[0]
        ready = sorted((r for r in rows if r[0] <= mark_ms * 1000 and (since is None or r[0] > since)), key=lambda r: r[0])
        rows = [r for r in rows if r[0] > mark_ms * 1000]
        out = pd.DataFrame([], columns=columns)
        if ready:
            held, out = step(None if held is None else tuple(held), pd.DataFrame(ready, columns=names))
        state.update((json.dumps([held, rows]),))
        if rows:
            state.setTimeoutTimestamp(max(min(r[0] for r in rows) // 1000 + 1, mark_ms + 1))
        yield out.assign(**dict(zip(key_names, key)))[columns].astype(object)

    return run


def delta_step(state: tuple | None, frame: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """New state and the rows whose counts differ from the row before them (null-safe)."""
    rows = _after(frame, state, _ROW_NAMES)
    counts = rows[_ROW_NAMES[1:]].astype(object)
    was = counts.shift()
    same = ((counts == was) | (counts.isna() & was.isna())).all(axis=1).to_numpy(dtype=bool, copy=True)
    same[0] = state is not None  # the state's own row was sent before; a first row is new
    return _state_of(rows, _ROW_NAMES), rows[~same]


def delta_stream(rows: DataFrame, watermark: str = "2 hours", wait: bool = False) -> DataFrame:
    """Rows whose counts differ from the section's previous row (null-safe); ``wait`` for the watermark, or at once."""
    def step(key, frames, state: GroupState):
        last = tuple(state.get) if state.exists else None
        frame = _sorted(frames, last[0] if last else None)
        if frame is None:
            yield pd.DataFrame([], columns=["section_id", *_ROW_NAMES])
            return
        after, out = delta_step(last, frame)
        state.update(after)
        yield out.assign(section_id=key[0])[["section_id", *_ROW_NAMES]]

    keyed = rows.withWatermark("run_started_at", watermark).select(
        "section_id", "run_started_at", F.unix_micros("run_started_at").alias("run_us"), *COUNT_FIELDS)
    schema = f"section_id string, {_ROW}"
    if wait:
        step = _in_order(delta_step, _ROW_NAMES, ["section_id", *_ROW_NAMES], ["section_id"])
        out = keyed.groupBy("section_id").applyInPandasWithState(
            step, schema, "held string", "append", GroupStateTimeout.EventTimeTimeout)
    else:
        out = keyed.drop("run_started_at").groupBy("section_id").applyInPandasWithState(
            step, schema, _ROW, "append", GroupStateTimeout.NoTimeout)
    return out.select("section_id", F.timestamp_micros("run_us").alias("run_started_at"), *COUNT_FIELDS)


_NEXT = [f"next_{c}" for c in _OBS_NAMES[:5]]


def flow_rows(state: tuple | None, rows: list) -> tuple[tuple, list[tuple]]:
    """New state and the pairs of consecutive observed rows; nothing follows a section's first tombstone.

    ``rows`` are a section's new rows in order: the observed values, whether it was ``seen``, whether it is ``gone``. The
    state is the last observed row and whether the section is gone.
    """
    if state is not None and state[-1]:
        return state, []
    n = len(_OBS_NAMES)
    end = next((r[0] for r in rows if r[-1]), None)
    kept = [] if state is None or state[0] is None else [tuple(state[:-1])]
    kept += [tuple(r[:n]) for r in rows if r[-2] and (end is None or r[0] < end)]
    last = kept[-1] if kept else (None,) * n
    return (*last, end is not None), [(*a, *b[:len(_NEXT)]) for a, b in zip(kept, kept[1:])]


def flow_step(state: tuple | None, frame: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """``flow_rows`` of a frame, which also has ``seen`` and ``gone``."""
    after, pairs = flow_rows(state, _plain(frame[[*_OBS_NAMES, "seen", "gone"]]))
    return after, pd.DataFrame(pairs, columns=[*_OBS_NAMES, *_NEXT], dtype=object)


def flow_stream(panel: DataFrame, watermark: str = "2 hours", max_interval_min: float | None = None,
                outages: DataFrame | None = None, wait: bool = False) -> DataFrame:
    """Interval flows as observations arrive, cut at the first tombstone like the batch form; ``wait`` for the watermark,
    or at once.

    The state holds a section's last observed counts; the pairs it emits are classified by the same column rules as
    the batch form. ``outages`` is the log as a batch table; it travels whole with each batch.
    """
    schema = f"section_id string, term_id string, {_OBSERVED}, " + ", ".join(
        f"{n} {'long' if n == 'next_run_us' else 'int'}" for n in _NEXT)
    empty = pd.DataFrame([], columns=["section_id", "term_id", *_OBS_NAMES, *_NEXT])

    def step(key, frames, state: GroupState):
        last = tuple(state.get) if state.exists else None
        frame = _sorted(frames, last[0] if last else None)
        if frame is None:
            yield empty
            return
        after, pairs = flow_step(last, frame)
        state.update(after)
        yield pairs.assign(section_id=key[0], term_id=key[1])[list(empty.columns)]

    gone = F.coalesce(F.col("section_status") == TOMBSTONE, F.lit(False))
    seen = F.coalesce("observed", F.lit(False))
    for c in CORE_COUNTS:
        seen = seen & F.col(c).isNotNull()
    keyed = panel.where(seen | gone).withWatermark("run_started_at", watermark).select(
        "section_id", "term_id", "run_started_at", F.unix_micros("run_started_at").alias("run_us"), *_OBS_NAMES[1:],
        seen.alias("seen"), gone.alias("gone"))
    if wait:
        step = _in_order(flow_step, [*_OBS_NAMES, "seen", "gone"], list(empty.columns), ["section_id", "term_id"])
        pairs = keyed.groupBy("section_id", "term_id").applyInPandasWithState(
            step, schema, "held string", "append", GroupStateTimeout.EventTimeTimeout)
    else:
        pairs = keyed.drop("run_started_at").groupBy("section_id", "term_id").applyInPandasWithState(
            step, schema, f"{_OBSERVED}, gone boolean", "append", GroupStateTimeout.NoTimeout)
    pairs = pairs.withColumn("run_started_at", F.timestamp_micros("run_us")).withColumn("_next", F.struct(
        F.timestamp_micros("next_run_us").alias("run_started_at"),
        *[F.col(f"next_{c}").alias(c) for c in _OBS_NAMES[1:5]]))
    return flows_of_pairs(pairs, max_interval_min=max_interval_min, outages=outages, inline_limit=2**31)


def gap_alerts(runs: DataFrame, limit_min: float = 90.0, watermark: str = "0 seconds") -> DataFrame:
    """One row per gap longer than ``limit_min`` between a term's runs, and one when
    event time has moved past the limit without a run (the term is silent)."""
    limit_us = int(limit_min * 60_000_000)
    schema = "term_id string, from_us long, to_us long, silent boolean"

    def step(key, frames, state: GroupState):
        out = []
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            out.append((key[0], last, None, True))
            state.update((last,))
        else:
            frame = _sorted(frames, last)
            if frame is not None:
                at = frame["run_us"].to_numpy("int64")
                before = np.append(at[0] if last is None else last, at[:-1])
                late = at - before > limit_us
                out += [(key[0], int(a), int(b), False) for a, b in zip(before[late], at[late])]
                last = int(at[-1])
            if last is not None:
                state.update((last,))
                state.setTimeoutTimestamp(max((last + limit_us) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["term_id", "from_us", "to_us", "silent"]).astype({"to_us": "Int64"})

    keyed = runs.withWatermark("run_started_at", watermark).select(
        "term_id", "run_started_at", F.unix_micros("run_started_at").alias("run_us"))
    out = keyed.groupBy("term_id").applyInPandasWithState(
        step, schema, "run_us long", "append", GroupStateTimeout.EventTimeTimeout)
    gap = (F.col("to_us") - F.col("from_us")) / F.lit(60_000_000.0)
    return out.select("term_id", F.timestamp_micros("from_us").alias("last_run"),
                      F.timestamp_micros("to_us").alias("next_run"), gap.alias("gap_min"), "silent")


def _swap(spark, fresh: str, published: str) -> None:
    """Put the finished folder in the published one's place by renames; a crash between them leaves the old one beside it."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    new, old, here = path(fresh), path(f"{published}.old"), path(published)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(here):
        fs.rename(here, old)
    fs.rename(new, here)
    fs.delete(old, True)


def write_live(state_stream: DataFrame, out_dir: str, checkpoint: str, read_state):
    """Refresh the live view after every batch: ``read_state()`` gives the current
    section state as a batch table, which replaces the published one."""
    def publish(_batch: DataFrame, _epoch: int) -> None:
        view = live_view(read_state())
        view.write.mode("overwrite").parquet(f"{out_dir}.next")
        _swap(view.sparkSession, f"{out_dir}.next", out_dir)

    return state_stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)


def decide_kinds(new: DataFrame, written: DataFrame) -> DataFrame:
    """``new`` with ``date`` and ``decided``: a day that has a baseline already gets deltas only, also for a run that
    arrives late and started earlier; else the day's first new run is its baseline. Runs written before are left out."""
    keys = ["term_id", "run_started_at"]
    fresh = new.join(written.select(*keys), keys, "left_anti")
    has = written.where(F.col("decided") == "baseline").select("term_id", F.to_date("run_started_at").alias("date"),
                                                               F.lit(True).alias("_has")).distinct()
    kinds = run_kinds(fresh.select(*keys))
    return fresh.join(kinds, keys).join(has, ["term_id", "date"], "left").withColumn(
        "decided", F.when(F.col("_has"), "delta").otherwise(F.col("decided"))).drop("_has")


def write_runs(run_stream: DataFrame, out_dir: str, checkpoint: str, read_written):
    """Append each arriving run with all its columns, tagged as the day's baseline or a delta given the runs already
    written (``read_written()``: ``term_id, run_started_at, decided``)."""
    def decide(batch: DataFrame, _epoch: int) -> None:
        decide_kinds(batch, read_written()).write.mode("append").parquet(out_dir)

    return run_stream.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint)
