"""Resampling sections with replacement, n of n, by counters instead of generator states.

The sections of a group are numbered 0 to n - 1 in a seeded order. Pick j of draw b is a fixed 32-bit word, taken from the
MD5 of (seed, j, b // 4), modulo n: any task and any engine can repeat it, in any order. Groups share the words, as paired
comparisons should; each takes them modulo its own size.

Picks are not moved. The rows that are resampled are written once, in the order of their groups, and a task takes a slice of
the draws: it makes their words, counts the picks of each section of a group and reads the group's rows past those counts.
What a task holds is bounded by the slice, and what is stored are the rows, however many draws there are. ``drawn`` gives
the counts of all draws as rows, an array per section.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.scalars import seeded_order
from turnwise.operators.scans import Scan, plan_splits, scan
from turnwise.session import checked_broadcast, materialize, open_file_system, stored

N_BOOT = 200
#: Picks made at once, and sections counted at once.
BLOCK = 20_000
#: Words that a task holds for its slice of the draws, and numbers that it works out at once (few enough to stay near).
HELD_WORDS, HELD_NUMBERS = 32_000_000, 500_000
#: (row, draw) pairs of a task where draws can be told apart so far, and rows of the groups that tasks read together; a group counts as ``_GROUP_ROWS`` besides.
TASK_PAIRS, SHELF_ROWS, _GROUP_ROWS = 200_000_000, 50_000_000, 20_000
_WORDS = 4  # of 32 bits in one digest
_SHIFTS = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5(seed: int, picks: np.ndarray, q: int) -> np.ndarray:
    """The four words of the MD5 of (seed, pick, q), one row each; the picks have equally many digits."""
    head, places, tail = b"%d:" % seed, len(b"%d" % picks[0]), b":%d" % q
    size = len(head) + places + len(tail)
    if size > 55:  # more than one block
        raw = b"".join(hashlib.md5(b"%d:%d:%d" % (seed, j, q)).digest() for j in picks.tolist())
        return np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, _WORDS).T
    plain = (head + bytes(places) + tail + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little")
    message = [int(w) for w in np.frombuffer(plain, "<u4")]
    for k in range(places):
        at = len(head) + k
        digit = (picks // 10 ** (places - 1 - k) % 10 + 48).astype(np.uint32)
        message[at // 4] = (digit << (8 * (at % 4))) + message[at // 4]
    a, b, c, d = (np.full(len(picks), w, np.uint32) for w in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += message[g] if isinstance(message[g], np.ndarray) else message[g] + _SINES[i] & 0xFFFFFFFF
        if isinstance(message[g], np.ndarray):
            f += _SINES[i]
        a, d, c = d, c, b
        b = b + (f << _SHIFTS[i] | f >> 32 - _SHIFTS[i])
    return np.stack([w + start for w, start in zip((a, b, c, d), _START)]).byteswap()


def _words_of(seed: int, first: int, last: int, draws: range) -> np.ndarray:
    """The words of picks ``first`` to ``last`` - 1 (columns) in the ``draws`` (rows), 32 bits each."""
    out = np.empty((len(draws), last - first), np.uint32)
    for low in range(first, last, 8192):
        top = min(low + 8192, last)
        cuts = [low, *[10**k for k in range(1, 20) if low < 10**k < top], top]
        for x, y in zip(cuts, cuts[1:]):
            picks = np.arange(x, y, dtype=np.int64)
            for q in range(draws.start // _WORDS, -(-draws.stop // _WORDS)):
                own = range(max(draws.start, q * _WORDS), min(draws.stop, (q + 1) * _WORDS))
                out[own.start - draws.start:own.stop - draws.start, x - first:y - first] = \
                    _md5(seed, picks, q)[own.start - q * _WORDS:own.stop - q * _WORDS]
    return out


def words(seed: int, first: int, last: int, n_boot: int = N_BOOT) -> np.ndarray:
    """The words of picks ``first`` to ``last`` - 1 (rows) in every draw (columns)."""
    return np.ascontiguousarray(_words_of(seed, first, last, range(n_boot)).T).astype(np.int64)


def picks(n: int, seed: int, n_boot: int = N_BOOT) -> np.ndarray:
    """How often each of ``n`` sections (rows) is picked in every draw (columns)."""
    codes = words(seed, 0, n, n_boot) % n * n_boot + np.arange(n_boot)
    return np.bincount(codes.ravel(), minlength=n * n_boot).reshape(n, n_boot)


def _dealt(seed: int, n_boot: int, block: int):
    """Of rows (group, n, first) the picks from ``first`` on, one row per block of sections they fall on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (-1, np.zeros((0, n_boot), np.int64))
        for batch in batches:
            for group, n, first in zip(*(c.to_pylist() for c in batch.columns)):
                rows = min(block, n - first)
                if held[0] != first or len(held[1]) < rows:
                    held = (first, words(seed, first, first + rows, n_boot))
                number = held[1][:rows] % n
                home, codes = number // block, number % block * n_boot + np.arange(n_boot)
                for h in np.unique(home) if n > block else (0,):
                    mine = codes[home == h] if n > block else codes.ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([group]), pa.array([int(h)]), pa.array([min(block, n - int(h) * block)]),
                         pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), pa.array(mine.astype(np.int32)))],
                        names=["group", "home", "size", "codes"])

    return run


def _counted(n_boot: int, block: int):
    """Of rows (group, home, size, codes) in order: one row per section, how often it was picked in each draw."""
    def rows_of(group: int, home: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(counts), 2_000):
            part = counts[at:at + 2_000].astype(np.int16)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), group)), pa.array(np.arange(at, at + len(part)) + home * block),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, n_boot, dtype=np.int32)),
                                          pa.array(part.ravel()))], names=["group", "number", "picks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts = None, None
        for batch in batches:
            codes = batch.column(3)
            for i, (group, home, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if (group, home) != key:
                    if key is not None:
                        yield from rows_of(*key, counts)
                    key, counts = (group, home), np.zeros((size, n_boot), np.int64)
                counts += np.bincount(codes[i].values.to_numpy(), minlength=size * n_boot).reshape(size, n_boot)
        if key is not None:
            yield from rows_of(*key, counts)

    return run


def number_sections(rows: DataFrame, by: Sequence[str], seed: int) -> DataFrame:
    """``number`` (0-based, in a seeded order) and the group's ``sections``."""
    by = list(by)
    keyed = materialize(rows.select(*by, "section_id").distinct().withColumn("_h", seeded_order(seed, F.col("section_id"))))
    sizes = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("sections"))
    numbered = scan(keyed, by, ["_h", "section_id"], [Scan("_j", F.lit(1), "sum")], plan_splits(keyed, by, "_h"))
    return numbered.join(sizes, by).select(*by, "section_id", (F.col("_j") - 1).cast("long").alias("number"), "sections")


def drawn(rows: DataFrame, by: Sequence[str], *, n_boot: int = N_BOOT, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """``by``, section_id, number and ``picks``, the section's counts by draw, of groups with two sections or more."""
    by = list(by)
    numbered = materialize(number_sections(rows, by, seed).where("sections >= 2"))
    # written before use, so the numbers of the groups stay what they are
    groups = materialize(numbered.groupBy(*by).agg(F.max("sections").alias("n"))
                         .withColumn("group", F.monotonically_increasing_id()))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = groups.select("group", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long")))
                          .alias("first"))
    # picks from the same place on make use of the same words, so the largest group of a place goes first
    dealt = asked.repartition(tasks, F.xxhash64("group", "first")).sortWithinPartitions("first", F.desc("n")) \
        .mapInArrow(_dealt(seed, n_boot, block), "group long, home long, size long, codes array<int>")
    counted = dealt.repartition(tasks, F.xxhash64("group", "home")).sortWithinPartitions("group", "home") \
        .mapInArrow(_counted(n_boot, block), "group long, number long, picks array<short>")
    named = numbered.join(groups.drop("n"), by)
    return materialize(named.join(_large(counted), ["group", "number"]).select(*by, "section_id", "number", "picks"))


def _large(rows: DataFrame) -> DataFrame:
    """A side of a join that has a row per section, hence no broadcast: Spark takes what grew out of a few rows per group,
    or was packed well on disk, for small, and would send the picks of all sections through the driver."""
    return rows.hint("merge")


@dataclass(frozen=True)
class _Laid:
    """Rows of groups with two sections or more, written in order; ``group`` and ``number`` stand for ``by`` and section_id.

    ``groups`` has ``by``, group, n (sections), shelf and ``rows``: tasks read the groups of one shelf together."""

    path: str
    groups: DataFrame


def _laid_out(rows: DataFrame, by: Sequence[str], seed: int, order: Sequence[str | Column], columns: Sequence[str | Column],
              sections: DataFrame | None = None) -> _Laid:
    """Write ``columns`` of the ``rows``, which have ``by`` and section_id, in the ``order`` within each group.

    ``sections``, where it is at hand, has each group's sections once."""
    by = list(by)
    sizes = materialize(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).withColumns(
        {"_all": F.lit(1), "_less": -F.col("rows"), "_id": F.monotonically_increasing_id()}))
    placed = scan(sizes, ["_all"], ["_less", "_id"], [
        Scan("group", F.lit(1), "sum"), Scan("_upto", F.col("rows") + _GROUP_ROWS, "sum", inclusive=False)],
        plan_splits(sizes, ["_all"], "_less"))
    placed = materialize(placed.select(
        *by, F.col("group").cast("long"), "rows", F.floor(F.coalesce("_upto", F.lit(0)) / F.lit(SHELF_ROWS)).alias("shelf")))
    # section ids move with a number instead of the names of their group
    names = checked_broadcast(placed.select(*by, "group"))
    coded = rows.join(names, by).drop(*by)
    numbered = materialize(number_sections(coded if sections is None else sections.join(names, by), ["group"], seed).where("sections >= 2"))
    named = coded.join(_large(numbered.drop("sections")), ["group", "section_id"])
    # written before they are ordered: the join's shuffle is gone by then, and finding the ranges does not join again
    named = materialize(named.select("group", F.col("number").cast("int").alias("number"), *columns))
    path = stored(named.orderBy("group", *order), **{"parquet.block.size": str(4 * 2**20)})
    groups = numbered.groupBy("group").agg(F.max("sections").alias("n"))
    return _Laid(path, materialize(placed.join(groups, "group")))


def _read(path: str, first: int, last: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Rows of the groups ``first`` to ``last`` in the order they were written in, at most ``rows`` at once."""
    import pyarrow.compute as pc
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, root = open_file_system(path)
    names = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("part-")]
    for name in sorted(names, key=lambda x: (int(x.rsplit("/", 1)[-1].split("-")[1]), x)):
        with fs.open_input_file(name) as source:
            file = pq.ParquetFile(source)
            at = file.schema_arrow.get_field_index("group")
            for i in range(file.num_row_groups):
                spread = file.metadata.row_group(i).column(at).statistics
                if spread is not None and spread.has_min_max and (spread.max < first or spread.min > last):
                    continue
                table = file.read_row_group(i)
                group = table.column("group")
                table = table.filter(pc.and_(pc.greater_equal(group, first), pc.less_equal(group, last))).combine_chunks()
                yield from table.to_batches(max_chunksize=rows)


def _counts_of(words: np.ndarray, n: int) -> list[np.ndarray]:
    """How often each of ``n`` sections is picked, per draw (row) of the words of as many picks or more."""
    out = []
    for own in words:
        picked = own[:n] % np.uint32(n)
        counts = np.empty(n, np.int16)
        for low in range(0, n, HELD_WORDS):
            top = min(low + HELD_WORDS, n)
            some = picked if n <= HELD_WORDS else picked[(picked >= low) & (picked < top)] - np.uint32(low)
            counts[low:top] = np.bincount(some, minlength=top - low)
        out.append(counts)
    return out


def _resampled(laid: _Laid, side: DataFrame, fold: Callable[[list[np.ndarray], Iterator[dict[str, np.ndarray]], dict], pa.RecordBatch],
               schema: str, *, n_boot: int, seed: int) -> DataFrame:
    """``fold(counts, rows, side)`` of every group in ``side`` (group and what else it needs) and slice of the draws.

    ``counts`` has, per draw of the slice, how often each section is picked; ``rows`` are the group's rows as batches of
    columns by name. It returns rows of ``schema``, to which ``group`` is added. A task takes one slice of the draws for
    the groups of one shelf, whose words it makes once.
    """
    shelves = laid.groups.groupBy("shelf").agg(*[f(c).alias(f"{k}_{c}") for k, f, c in (
        ("min", F.min, "group"), ("max", F.max, "group"), ("max", F.max, "n"), ("sum", F.sum, "n"), ("sum", F.sum, "rows"))]).orderBy("shelf").collect()
    units = []
    for s in shelves:  # one row per 50 million rows
        pairs = s["sum_rows"] + 4 * s["sum_n"] + 14 * s["max_n"]  # counting a pick and making a word take longer
        wide = max(1, min(n_boot, HELD_WORDS // s["max_n"], max(_WORDS, TASK_PAIRS // pairs)))
        wide -= wide % _WORDS if wide > _WORDS else 0
        units += [(len(units) + k, s["shelf"], s["min_group"], s["max_group"], s["max_n"], b, min(b + wide, n_boot))
                  for k, b in enumerate(range(0, n_boot, wide))]
    spark = laid.groups.sparkSession
    # a shelf's groups are read where they are needed, like its rows
    sides = stored(laid.groups.select("group", "shelf", "n").join(side, "group").orderBy("group"))
    path, held = laid.path, HELD_NUMBERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in (u for batch in batches for u in batch.to_pylist()):
            first, last = unit["first"], unit["last"]
            asked = {r["group"]: r for part in _read(sides, first, last, held) for r in part.to_pylist()}
            word = _words_of(seed, 0, unit["n"], range(unit["low"], unit["top"]))
            for group, rows in _by_group(_read(path, first, last, max(1, held // len(word)))):
                if group not in asked:
                    continue
                found = fold(_counts_of(word, asked[group]["n"]), rows, asked[group])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(found.num_rows, group)), *found.columns], ["group", *found.schema.names])

    at = spark.createDataFrame(units, "unit long, shelf long, first long, last long, n long, low int, top int")
    tasks = spark.range(0, max(1, len(units)), 1, max(1, len(units))).withColumnRenamed("id", "unit")  # a task each
    return tasks.join(F.broadcast(at), "unit").mapInArrow(run, f"group long, {schema}")


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict[str, np.ndarray]]]]:
    """Of batches in the order of their groups, each group and an iterator over its rows, to be read before the next."""
    def pieces() -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        for batch in batches:
            columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
            group = columns.pop("group")
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for x, y in zip(cuts, cuts[1:]):
                if y > x:
                    yield int(group[x]), {name: values[x:y] for name, values in columns.items()}

    left = pieces()
    ahead = next(left, None)

    def own(group: int) -> Iterator[dict[str, np.ndarray]]:
        nonlocal ahead
        while ahead is not None and ahead[0] == group:
            yield ahead[1]
            ahead = next(left, None)

    while ahead is not None:
        group = ahead[0]
        rows = own(group)
        yield group, rows
        for _ in rows:  # what was not read
            pass


def bootstrap_gain(scored: DataFrame, by: Sequence[str], base: str, model: str, *, n_boot: int = N_BOOT,
                   seed: int = 0) -> DataFrame:
    """95 % interval of ``brier(base) - brier(model)`` over section resamples.

    Rows shrink to sums per section first; a section adds them to every draw as often as it was picked there, map-side.
    """
    by = list(by)
    # a row without an answer or one of the predictions counts in neither sum
    known = (F.col("w") > 0) & F.col("y").isNotNull() & F.col(base).isNotNull() & F.col(model).isNotNull()
    sq = lambda p: F.sum(F.when(known, F.col("w") * (F.col("y") - F.col(p)) * (F.col("y") - F.col(p))).otherwise(0.0))
    sums = materialize(scored.groupBy(*by, "section_id").agg(
        sq(base).alias("_sb"), sq(model).alias("_sm"), F.sum(F.when(known, F.col("w")).otherwise(0.0)).alias("_sw")))
    names = ["_sb", "_sm", "_sw"]
    laid = _laid_out(sums, by, seed, ["number"], names)

    def fold(counts: list[np.ndarray], rows: Iterator[dict[str, np.ndarray]], side: dict) -> pa.RecordBatch:
        total = np.zeros((len(counts), len(names)))
        for part in rows:
            values = np.column_stack([part[c] for c in names])
            odd = ~np.isfinite(values).all(axis=1)
            for b, times in enumerate(counts):
                own = times.take(part["number"]).astype(float)
                total[b] += np.where(odd, 0.0, own) @ np.where(odd[:, None], 0.0, values)
                hit = odd & (own > 0)  # nought times such a number would not be nought
                if hit.any():
                    total[b] += (own[hit, None] * values[hit]).sum(axis=0)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in total.T], names)

    draws = _resampled(laid, laid.groups.select("group"), fold, "_sb double, _sm double, _sw double", n_boot=n_boot, seed=seed)
    draws = draws.join(checked_broadcast(laid.groups.select("group", *by)), "group")
    gain = F.try_divide(F.col("_sb") - F.col("_sm"), F.col("_sw"))
    band = F.percentile("_g", [0.025, 0.975])  # of n_boot values
    return draws.select(*by, gain.alias("_g")).groupBy(*by).agg(
        band[0].alias("gain_ci_low"), band[1].alias("gain_ci_high"))


def section_counts(cohort: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows ``n`` and events ``d`` per group, section and time ``t``: what curves and bands need."""
    return cohort.groupBy(*by, "section_id", F.col("duration_days").alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("event").alias("d"))


class _Curve:
    """Per draw, the product of survival factors up to each of ``days``, of rows that come by falling time."""

    def __init__(self, counts: list[np.ndarray], days: np.ndarray):
        self.counts, self.days = counts, days
        self.risk = np.zeros((len(counts), 1))
        self.between = np.ones((len(days), len(counts)))  # of the times after the day before, up to this one
        self.held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # sums of the last time, which may go on

    def add(self, number: np.ndarray, t: np.ndarray, n: np.ndarray, d: np.ndarray) -> None:
        edges = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) & ~(np.isnan(t[1:]) & np.isnan(t[:-1]))))
        t = t[edges]
        at_t, gone = np.empty((len(self.counts), len(t))), np.empty((len(self.counts), len(t)))
        for b, times in enumerate(self.counts):
            weight = times.take(number)
            at_t[b], gone[b] = np.add.reduceat(weight * n, edges), np.add.reduceat(weight * d, edges)
        if self.held is not None:
            if self.held[0][0] == t[0] or (np.isnan(self.held[0][0]) and np.isnan(t[0])):
                at_t[:, 0] += self.held[1][:, 0]
                gone[:, 0] += self.held[2][:, 0]
            else:
                self.take(*self.held)
        self.take(t[:-1], at_t[:, :-1], gone[:, :-1])
        self.held = t[-1:], at_t[:, -1:], gone[:, -1:]

    def take(self, t: np.ndarray, at_t: np.ndarray, gone: np.ndarray) -> None:
        if len(t) == 0:
            return
        risk = np.cumsum(np.concatenate([self.risk, at_t], axis=1), axis=1)[:, 1:]
        self.risk = risk[:, -1:].copy()
        factor = np.where(risk > 0, 1.0 - gone / np.where(risk > 0, risk, 1.0), 1.0)
        place = np.searchsorted(self.days, t)  # the first day at or after the time
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        for k, part in zip(place[starts], np.multiply.reduceat(factor, starts, axis=1).T):
            if k < len(self.days):
                self.between[k] *= part

    def survival(self) -> np.ndarray:
        if self.held is not None:
            self.take(*self.held)
            self.held = None
        return np.cumprod(self.between, axis=0)


def curve_bands(counts: DataFrame, by: Sequence[str], grid: DataFrame, *, n_boot: int = N_BOOT,
                seed: int = 0, sections: DataFrame | None = None) -> DataFrame:
    """2.5 and 97.5 percentiles of the clearing curve at each grid ``day``.

    ``counts`` comes from ``section_counts`` (written, since it is read three
    times); ``grid`` has ``by`` and ``day``, ``sections`` (if given) each section of ``counts`` once. The rows are written by falling time within their groups. A task reads a
    group's rows in that order for a slice of the draws, keeping the numbers at risk and the product of the factors, so a
    group of any size passes through bounded memory, in as many tasks as there are slices.
    Groups with one section have no band.
    """
    by = list(by)
    # a row without a time is at risk at all times
    t = F.coalesce(F.col("t").cast("double"), F.lit(float("nan"))).alias("t")
    laid = _laid_out(counts, by, seed, [F.desc("t"), "number"], [t, F.col("n").cast("double"), F.col("d").cast("double")], sections)
    wanted = grid.groupBy(*by).agg(F.array_sort(F.collect_set("day")).alias("days"))
    names = laid.groups.select("group", *by)

    def fold(counts: list[np.ndarray], rows: Iterator[dict[str, np.ndarray]], side: dict) -> pa.RecordBatch:
        curve = _Curve(counts, np.asarray(side["days"], float))
        for part in rows:
            curve.add(part["number"], part["t"], part["n"], part["d"])
        survival = np.ascontiguousarray(curve.survival())
        offsets = np.arange(0, survival.size + 1, len(counts), dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(curve.days), pa.ListArray.from_arrays(  # a curve past unknown events is unknown
                pa.array(offsets), pa.array(survival.ravel(), mask=np.isnan(survival.ravel())))], ["day", "s"])

    side = names.join(wanted, by).select("group", "days")
    partial = _resampled(laid, side, fold, "day double, s array<double>", n_boot=n_boot, seed=seed)
    each = partial.select("group", "day", F.explode("s").alias("_s"))
    band = F.percentile(F.lit(1.0) - F.col("_s"), [0.025, 0.975])  # of n_boot values
    bands = each.groupBy("group", "day").agg(band[0].alias("low"), band[1].alias("high"))
    return bands.join(checked_broadcast(names), "group").select(*by, "day", "low", "high")
