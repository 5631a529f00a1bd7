"""Exact quantiles of large groups by rank selection.

Rows are reduced to one line per distinct value map-side, the running count over the ordered values says which ranks a
value covers, and the two values at the ranks around each quantile are read off. Ordering is the library's scan, so a
group with any number of distinct values is cut into ranges; no task holds a group's values.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators.scans import Scan, plan_splits, scan
from turnwise.session import materialize


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], weight: str | None = None,
              name: str = "quantiles") -> DataFrame:
    """Interpolated quantiles ``at`` of ``value`` per ``keys`` as an array column ``name``.

    ``weight`` counts how often a row stands for its value. Null and undefined values are left out; a group without any
    value has no row, so join the result on the left. Without ``keys`` there is one row, if there is any value.
    """
    keys = list(keys)
    by = keys or ["_every"]
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if not keys:
        known = known.withColumn("_every", F.lit(1))
    times = F.lit(1) if weight is None else F.col(weight)
    counts = materialize(known.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.sum(times).alias("_m"))
                         .where("_m > 0"))
    upto = scan(counts, by, ["_v"], [Scan("_upto", F.col("_m"), "sum")], plan_splits(counts, by, "_v"))
    sizes = counts.groupBy(*by).agg(F.sum("_m").alias("_all"))
    ranked = upto.join(sizes.select(*[F.col(k).alias(f"_k_{k}") for k in by], "_all"),
                       [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by])

    def covers(rank):
        return (F.col("_upto") - F.col("_m") <= rank) & (rank < F.col("_upto"))

    places = [(F.col("_all") - 1) * F.lit(float(p)) for p in at]
    ends = [(F.floor(place), F.ceil(place)) for place in places]
    wanted = F.lit(False)
    for low, high in ends:
        wanted = wanted | covers(low) | covers(high)
    picked = ranked.where(wanted).groupBy(*by).agg(
        F.max("_all").alias("_all"),
        *[F.max(F.when(covers(rank), F.col("_v"))).alias(f"_{side}{i}")
          for i, pair in enumerate(ends) for side, rank in zip(("low", "high"), pair)])
    values = []
    for i, (place, (low, high)) in enumerate(zip(places, ends)):
        a, z = F.col(f"_low{i}"), F.col(f"_high{i}")
        values.append(F.when(a == z, a).otherwise((high - place) * a + (place - low) * z))
    return picked.select(*keys, F.array(*values).alias(name))
