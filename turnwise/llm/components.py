"""Connected components of an edge table, by star contraction on DataFrames."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import stored


#: Edges that one task finishes by itself: two 8-byte nodes each, and as much again for its table of roots.
SMALL_EDGES = 1_000_000
#: Edges whose forest a task works out at once.
BATCH_EDGES = 200_000


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Of some edges, one for every node that is not its component's smallest: to that smallest node."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    one, two = place[:len(a)], place[len(a):]
    while True:  # hang both ends' roots to the smaller one, then halve all paths; the smallest node wins in the end
        x, y = root[one], root[two]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    hung = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[hung]), pa.array(nodes[root[hung]])], names=["a", "b"])


def _forests(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            rows += batch.num_rows
            if rows >= most:
                yield _forest(*(np.concatenate(c) for c in zip(*held)))
                held, rows = [], 0
        if rows:
            yield _forest(*(np.concatenate(c) for c in zip(*held)))

    return run


def _sum_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b), a and b being longs; the component is its smallest node.

    Every task first reduces its edges to a forest of stars, so what moves has no more edges than nodes. If few edges are
    left by then, counted, one task reduces them once more and all is done.

    Otherwise large-star and small-star steps in turn (Kiveris and others, 2014): each hangs neighbours to the smallest
    one seen, until every edge leads to the component's smallest node. A hub's neighbours are joined, never collected, so
    a hub with any number of edges is split like any skewed join.
    """
    nodes = "a long, b long"
    edges = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null")
                   .mapInArrow(_forests(BATCH_EDGES), nodes))
    before = _sum_of(edges)
    if before[0] <= SMALL_EDGES:
        edges = stored(edges.coalesce(1).mapInArrow(_forests(SMALL_EDGES + 1), nodes))
    else:
        edges = _contracted(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), before)
    hung = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return hung.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _contracted(edges: DataFrame, before: tuple) -> DataFrame:
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
            .alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        edges = stored(small)
        after = _sum_of(edges)
        if after == before:
            return edges
        before = after
