import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions.scalars import course_level, position_bucket
from turnwise.operators import cohort as co
from turnwise.schema import SCENARIOS
from turnwise.sources.calendar import calendar_for

START = dt.datetime(2026, 4, 20)
SCHEMA = ("section_id string, t0 timestamp, t1 timestamp, admits long, wl_drops long, waitlist0 long, capacity0 long, "
          "enrolled0 long, reserved0 long, full0 boolean, censored boolean")


def flows(spark, rows, section="1", minutes=30):
    """rows: (admits, drops, waitlist0[, censored])"""
    out = []
    for i, r in enumerate(rows):
        a = START + dt.timedelta(minutes=minutes * i)
        out.append((section, a, a + dt.timedelta(minutes=minutes), r[0], r[1], r[2], 100, 100, 0, True, len(r) > 3 and r[3]))
    return spark.createDataFrame(out, SCHEMA)


def walked(spark, rows, position, scenario="central"):
    out = co.walk_positions(flows(spark, rows), scenarios=(scenario,), positions=(position,))
    return out.orderBy("join_time").first()


def test_three_scenarios(spark):
    rows = [(1, 2, 8), (1, 2, 5), (1, 0, 2), (1, 0, 1)]
    got = [walked(spark, rows, 4, s) for s in SCENARIOS]
    assert [(r["duration_min"], r["event"]) for r in got] == [(60.0, 1), (90.0, 1), (120.0, 1)]


def test_front_of_queue_and_censoring(spark):
    for s in SCENARIOS:
        assert walked(spark, [(0, 0, 5), (1, 0, 5), (3, 0, 4)], 1, s)["duration_min"] == 60.0
    cut = walked(spark, [(0, 0, 5), (0, 0, 5, True), (3, 0, 5)], 2)
    assert (cut["event"], cut["duration_min"]) == (0, 30.0)


def test_follow_up(spark):
    out = co.walk_positions(flows(spark, [(1, 0, 3), (0, 0, 2), (0, 0, 2, True), (0, 0, 2)]), positions=(1, 2))
    rows = out.where(F.col("join_time") == F.lit(START)).orderBy("position").collect()
    assert [(r["event"], r["duration_min"], round(r["follow_up_days"] * 1440, 6)) for r in rows] == [(1, 30.0, 60.0), (0, 60.0, 60.0)]


def test_thinning():
    minutes = np.array([0, 30, 60, 240, 270, 500]) * 60_000_000
    kept = co.keep_spaced(np.zeros(6, int), np.array([6]), minutes, 240 * 60_000_000)
    assert list(np.flatnonzero(kept)) == [0, 3, 5]


def test_thinning_matches_a_plain_loop():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 40, 25)
    block = np.repeat(np.arange(25), sizes)
    times = np.concatenate([np.sort(rng.choice(10_000, n, replace=False)) for n in sizes])
    got = co.keep_spaced(block, np.cumsum(sizes), times, 700)
    want = []
    for b in range(25):
        last = None
        for t in times[block == b]:
            keep = last is None or t - last >= 700
            last = t if keep else last
            want.append(keep)
    assert list(got) == want


def plain_walk(rows, start, k, scenario):
    """One joiner, one interval at a time."""
    k = float(k)
    for i in range(start, len(rows)):
        admits, drops, w = rows[i][:3]
        if len(rows[i]) > 3 and rows[i][3]:
            return 30.0 * (i - start), 0
        if scenario == "optimistic":
            k -= admits + drops
        elif scenario == "pessimistic":
            k -= admits
        else:
            share = min(max((k - 1) / (w - 1), 0.0), 1.0) if w > 1 else 0.0
            k -= admits + drops * share
        if k <= (0.5 if scenario == "central" else 0.0):
            return 30.0 * (i + 1 - start), 1
    return 30.0 * (len(rows) - start), 0


def _random_rows(seed, n):
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(0, 2)), int(rng.integers(0, 3)), int(rng.integers(2, 12)), bool(rng.random() < 0.03)) for _ in range(n)]


def _check_walks(spark, rows):
    out = co.walk_positions(flows(spark, rows), scenarios=SCENARIOS, positions=(1, 3, 7), join_every_min=30).collect()
    want = {}
    for i, r in enumerate(rows):
        for k in (1, 3, 7):
            for s in SCENARIOS:
                if r[2] >= k - 1:
                    want[(i, k, s)] = plain_walk(rows, i, k, s)
    got = {(int((r["join_time"] - START).total_seconds() // 1800), r["position"], r["scenario"]): (r["duration_min"], r["event"]) for r in out}
    assert got == want


def test_walks_match_a_plain_loop(spark):
    _check_walks(spark, _random_rows(3, 120))


def test_hot_section_walks_match_a_plain_loop(spark, tiny_chunks):
    _check_walks(spark, _random_rows(4, 60))


def test_hot_section_thinning(spark, tiny_chunks):
    f = flows(spark, _random_rows(5, 60), minutes=50)
    hot = sorted(r["t0"] for r in co.thin_joins(f, 240).where("kept").collect())
    spark.conf.unset("spark.turnwise.chunkRows")
    assert hot == sorted(r["t0"] for r in co.thin_joins(f, 240).where("kept").collect())
    assert len(hot) == 12


def test_exit_maps_say_what_thinning_leaves():
    rng = np.random.default_rng(7)
    for _ in range(200):
        t = np.sort(rng.choice(500, rng.integers(1, 40), replace=False)) + 1000
        gap = int(rng.integers(1, 300))
        bounds, exits = co.exit_map(t, gap)
        assert len(bounds) <= (t < t[0] + gap).sum() + 1
        for entry in [*range(int(t[0]) - 350, int(t[0]), 7), int(t[0]) - 1]:
            kept = co.keep_spaced(np.zeros(len(t), int), np.array([len(t)]), t, gap, np.array([float(entry)]))
            at = np.searchsorted(bounds, entry)
            assert (exits[at] if at < len(bounds) else entry) == (t[kept][-1] if kept.any() else entry)


def test_levels_and_buckets(spark):
    numbers = ["61A", "C100", "H194", "200", "R1A", "N1", "298", None, "X"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, n string")
    got = [r[0] for r in rows.orderBy("i").select(course_level(F.col("n"))).collect()]
    assert got == ["lower", "upper", "upper", "grad", "lower", "lower", "grad", None, None]
    places = spark.createDataFrame([(p,) for p in (1, 5, 6, 15, 16, 40, 41, 500)], "p int")
    assert [r[0] for r in places.orderBy("p").select(position_bucket(F.col("p"))).collect()] == \
        ["1-5", "1-5", "6-15", "6-15", "16-40", "16-40", "41+", "41+"]
    with pytest.raises(Exception, match="position must be"):
        spark.range(1).select(position_bucket(F.col("id"))).collect()


def test_joinable_only(spark):
    ident = spark.createDataFrame([("1", "STAT 20", "STAT", "20", "LEC")],
                                  "section_id string, course_key string, subject string, catalog_number string, component string")
    build = lambda f: co.build_cohort(f, ident, calendar_for("2268"), positions=(1,), join_every_min=30)
    rows = [(0, 0, 0), (1, 0, 0), (0, 0, 0)]
    is_open = flows(spark, rows).withColumns({"full0": F.lit(False), "enrolled0": F.lit(90).cast("long")})
    assert build(is_open).count() == 0
    assert build(flows(spark, rows)).count() == 3
    assert build(is_open.withColumn("waitlist0", F.lit(2).cast("long"))).count() == 3
    row = build(flows(spark, rows)).first()
    assert (row["level"], row["dept_group"], row["phase"]) == ("lower", "OTHER", "phase1")


def test_scenarios_are_ordered(spark):
    out = co.walk_positions(flows(spark, _random_rows(6, 80)), scenarios=SCENARIOS, positions=(2, 5), join_every_min=30)
    wide = out.groupBy("join_time", "position").pivot("scenario", list(SCENARIOS)).agg(F.first("duration_min"))
    assert wide.where("optimistic > central OR central > pessimistic").count() == 0


def test_thinning_of_very_many_sections_in_one_group():
    n, year = 400_000, 365 * 86_400_000_000
    block = np.repeat(np.arange(n), 2)
    times = np.tile(np.array([0, year]), n) + np.repeat(np.arange(n) % 1000, 2)
    kept = co.keep_spaced(block, np.arange(2, 2 * n + 1, 2), times, 240 * 60_000_000)
    assert kept.all()


@pytest.mark.parametrize("hot", [False, True])
def test_censoring_horizon(spark, hot):
    start = dt.datetime(2026, 4, 1)
    at = lambda m: start + dt.timedelta(minutes=m)
    flows = spark.createDataFrame([("1", at(30 * i), at(30 * i + 30), i == 2) for i in range(4)]
                                  + [("2", at(30 * i), at(30 * i + 30), False) for i in range(9)],
                                  "section_id string, t0 timestamp, t1 timestamp, censored boolean")
    joins = spark.createDataFrame([("1", at(0)), ("1", at(60)), ("1", at(300)), ("2", at(31))], "section_id string, join_time timestamp")
    if hot:
        spark.conf.set("spark.turnwise.chunkRows", "2")
    got = {(r["section_id"], r["join_time"]): r["horizon_min"] for r in co.censoring_horizon(flows, joins).collect()}
    spark.conf.unset("spark.turnwise.chunkRows")
    assert got == {("1", at(0)): 60.0, ("1", at(60)): 0.0, ("1", at(300)): None, ("2", at(31)): 239.0}
