"""Ordered scans that survive a key holding a large share of the rows.

A plain window puts all rows of a key in one task. ``plan_splits`` looks for
keys with more rows than a task should sort and cuts those keys (only those)
into value ranges of the ordering column. ``scan`` then works per (key, range)
and carries one summary row per range to the ranges after it. Without such a
key the plan is the ordinary window, so the usual case pays nothing.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.session import lookup_side, materialize

CHUNK_ROWS_CONF = "spark.turnwise.chunkRows"
DEFAULT_CHUNK_ROWS = 2_000_000
CHUNK = "_chunk"


@dataclass(frozen=True)
class Splits:
    """Cut points per hot key; ``bounds`` is None when no key is hot. ``rows`` is the number of rows counted for them."""

    keys: tuple[str, ...]
    order: str
    bounds: DataFrame | None = None
    chunks: int = 1
    rows: int = 0

    @property
    def hot(self) -> bool:
        return self.bounds is not None


@dataclass(frozen=True)
class Scan:
    """One running value: ``op`` is sum, product, max, min, last, prev or next."""

    name: str
    value: Column
    op: str
    inclusive: bool = True
    reverse: bool = False


def chunk_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(CHUNK_ROWS_CONF, str(DEFAULT_CHUNK_ROWS)))


def plan_splits(df: DataFrame, keys: Sequence[str], order: str, most: int | None = None) -> Splits:
    """Find hot keys of ``df`` and cut each into ranges of ``order``, of ``most`` rows where that is less than usual.

    One narrow count job. The cut points are approximate quantiles of the hot keys
    alone: rows / chunk size values per key, and as many keys at most.
    """
    keys = tuple(keys)
    target = chunk_rows(df) if most is None else min(most, chunk_rows(df))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    found = counts.agg(F.max("_rows").alias("most"), F.sum("_rows").alias("all")).first()
    most, total = found["most"] or 0, found["all"] or 0
    if most <= target:
        return Splits(keys, order, rows=total)
    chunks = math.ceil(most / target)
    hot = counts.where(F.col("_rows") > F.lit(target)).select(*[F.col(k).alias(f"_h_{k}") for k in keys])
    fractions = [i / chunks for i in range(1, chunks)]
    narrow = df.select(*keys, order)
    bounds = (
        narrow.join(hot, _null_safe(keys), "left_semi")
        .groupBy(*keys)
        .agg(F.array_sort(F.array_distinct(
            F.percentile_approx(order, fractions, max(10_000, 20 * chunks)))).alias("_bounds"))
    )
    return Splits(keys, order, materialize(bounds), chunks, total)


def _null_safe(keys: Sequence[str], prefix: str = "_h_") -> Column:
    out = F.lit(True)
    for key in keys:
        out = out & F.col(key).eqNullSafe(F.col(f"{prefix}{key}"))
    return out


def with_chunk(df: DataFrame, splits: Splits) -> DataFrame:
    """Add the range number of each row (0 for rows of ordinary keys)."""
    if not splits.hot:
        return df.withColumn(CHUNK, F.lit(0))
    bounds = splits.bounds.select(*[F.col(k).alias(f"_h_{k}") for k in splits.keys], "_bounds")
    # binary search: the number of cut points at or below the row's value
    steps = [2**i for i in reversed(range(splits.chunks.bit_length()))]
    position = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda low, step: F.when(
            (low + step <= F.size("_bounds"))
            & (F.try_element_at("_bounds", low + step) <= F.col(splits.order)),
            low + step,
        ).otherwise(low),
    )
    joined = df.join(bounds, _null_safe(splits.keys), "left")
    chunk = F.when(F.col("_bounds").isNull() | F.col(splits.order).isNull(), F.lit(0)).otherwise(position)
    return joined.withColumn(CHUNK, chunk).drop("_bounds", *[f"_h_{k}" for k in splits.keys])


_AGG = {
    "sum": F.sum,
    "product": F.product,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _running(spec: Scan, keys: list[str], order: list[Column]) -> Column:
    sort = [c.desc() for c in order] if spec.reverse else [c.asc() for c in order]
    window = Window.partitionBy(*keys).orderBy(*sort)
    if spec.op == "prev":
        return F.lag(spec.value).over(window)
    if spec.op == "next":
        return F.lead(spec.value).over(window)
    end = Window.currentRow if spec.inclusive else -1
    return _AGG[spec.op](spec.value).over(window.rowsBetween(Window.unboundedPreceding, end))


def _merge(op: str, within: Column, carried: Column) -> Column:
    if op in ("last", "prev", "next"):
        return F.coalesce(within, carried)
    if op == "max":
        return F.greatest(within, carried)
    if op == "min":
        return F.least(within, carried)
    if op == "sum":
        return F.when(within.isNull(), carried).when(carried.isNull(), within).otherwise(within + carried)
    return F.when(within.isNull(), carried).when(carried.isNull(), within).otherwise(within * carried)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Sequence[Scan],
    splits: Splits | None = None,
) -> DataFrame:
    """Add the running values of ``specs`` per ``keys`` in ``order``.

    ``prev``/``next`` values must not be null themselves (wrap them in a
    struct). ``splits`` must be cut on ``order[0]``.
    """
    keys = list(keys)
    order_cols = [F.col(c) for c in order]
    if splits is None or not splits.hot:
        return df.select("*", *[_running(s, keys, order_cols).alias(s.name) for s in specs])
    rows = with_chunk(df, splits)
    inner = [*keys, CHUNK]
    within = rows.select("*", *[_running(s, inner, order_cols).alias(f"_w_{s.name}") for s in specs])

    sort_key = F.struct(*order_cols)
    totals = []
    for s in specs:
        if s.op == "next":
            value = F.min_by(s.value, sort_key)
        elif s.op == "prev":
            value = F.max_by(s.value, sort_key)
        elif s.op == "last":
            pick = F.min_by if s.reverse else F.max_by
            value = pick(F.struct(s.value.alias("v")), F.when(s.value.isNotNull(), sort_key))["v"]
        else:
            value = _AGG[s.op](s.value)
        totals.append(value.alias(f"_t_{s.name}"))
    per_chunk = rows.groupBy(*inner).agg(*totals)
    carried = []
    for s in specs:
        chunk_order = F.col(CHUNK).desc() if s.reverse else F.col(CHUNK).asc()
        window = Window.partitionBy(*keys).orderBy(chunk_order)
        total = F.col(f"_t_{s.name}")
        if s.op == "prev":
            value = F.lag(total).over(window)
        elif s.op == "next":
            value = F.lead(total).over(window)
        else:
            value = _AGG[s.op](total).over(window.rowsBetween(Window.unboundedPreceding, -1))
        carried.append(value.alias(f"_c_{s.name}"))
    carry = per_chunk.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(CHUNK).alias(f"_k_{CHUNK}"), *carried
    )
    joined = within.join(carry, _null_safe(inner, "_k_"), "left")
    out = [F.col(c) for c in df.columns]
    out += [_merge(s.op, F.col(f"_w_{s.name}"), F.col(f"_c_{s.name}")).alias(s.name) for s in specs]
    return joined.select(*out)


def read_steps(
    points: DataFrame, steps: DataFrame, keys: Sequence[str], step_at: str, value: str, *, left: bool = False
) -> DataFrame:
    """Step value at each distinct (``keys``, ``at``) of ``points`` (just before it when ``left``).

    The points are merged into the ordered steps and the last value carried
    forward, so neither side is broadcast. Null before the first step.
    """
    keys = list(keys)
    step_side, point_side = 1, 0 if left else 2
    # written once: finding the points may be costly and they are read twice
    points = materialize(points.select(*keys, F.col("at").cast("double").alias("at")).distinct())
    merged = points.select(
        *keys, "at", F.lit(point_side).alias("_side"), F.lit(None).cast("double").alias("_v"),
    ).unionByName(steps.select(
        *keys, F.col(step_at).cast("double").alias("at"), F.lit(step_side).alias("_side"),
        F.col(value).cast("double").alias("_v")))
    splits = plan_splits(merged, keys, "at")
    carried = scan(merged, keys, ["at", "_side"], [Scan("value", F.col("_v"), "last")], splits)
    return carried.where(F.col("_side") == point_side).select(*keys, "at", "value")


def step_lookup(
    queries: DataFrame, steps: DataFrame, keys: Sequence[str], at: str, step_at: str, value: str, name: str,
    *, left: bool = False, default: float = 1.0,
) -> DataFrame:
    """Add the step function's value at each row's time; equal times are read once."""
    keys = list(keys)
    points = queries.select(*keys, F.col(at).cast("double").alias("at"))
    read = read_steps(points, steps, keys, step_at, value, left=left).select(
        *[F.col(k).alias(f"_q_{k}") for k in keys], F.col("at").alias("_q_at"), F.col("value").alias("_q_value"))
    on = _null_safe(keys, "_q_") & F.col(at).cast("double").eqNullSafe(F.col("_q_at"))
    out = queries.join(lookup_side(read), on, "left").withColumn(name, F.coalesce("_q_value", F.lit(default)))
    return out.drop("_q_value", "_q_at", *[f"_q_{k}" for k in keys])
