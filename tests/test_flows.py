import datetime as dt

import pytest
from pyspark.sql import functions as F

from turnwise.operators import flows as fl
from turnwise.schema import FLOW_COLUMNS, FLOW_NAMES

START = dt.datetime(2026, 11, 1, 12, 0)
SCHEMA = ("section_id string, run_started_at timestamp, enrolled_count int, enroll_capacity int, waitlist_count int, "
          "waitlist_capacity int, reserved_count int, open_reserved int, section_status string, observed boolean, term_id string")


def panel(spark, rows):
    out = [(r.get("s", "1"), START + dt.timedelta(minutes=30 * r["i"]), r["e"], r.get("c", 100), r["w"], 20, None,
            r.get("open"), r.get("status"), r.get("observed", True), "2268") for r in rows]
    return spark.createDataFrame(out, SCHEMA)


def pair(spark, first, second):
    rows = fl.interval_flows(panel(spark, [{"i": 0, **first}, {"i": 1, **second}])).collect()
    assert len(rows) == 1
    return rows[0]


# (start, end, expected non-zero flows, rule, ambiguous)
CASES = [
    (dict(e=100, w=5), dict(e=102, w=3), {"admits": 2}, "admit", False),
    (dict(e=90, w=5), dict(e=93, w=4), {"admits": 3, "wl_joins": 2}, "admit_join", False),
    (dict(e=99, w=5), dict(e=100, w=2), {"admits": 1, "wl_drops": 2}, "admit_drop", False),
    (dict(e=50, w=2), dict(e=53, w=2), {"admits": 3, "wl_joins": 3}, "admit_join", True),
    (dict(e=90, w=5, open=3), dict(e=91, w=4), {"admits": 1}, "admit", True),
    (dict(e=50, w=0), dict(e=53, w=0), {"enr_joins": 3}, "enr_join", False),
    (dict(e=50, w=0), dict(e=52, w=3), {"enr_joins": 2, "wl_joins": 3}, "enr_join_then_join", False),
    (dict(e=100, w=0), dict(e=102, w=3), {"enr_joins": 2, "wl_joins": 3}, "enr_join_then_join", True),
    (dict(e=50, w=0), dict(e=52, w=-1), {"enr_joins": 2}, "inconsistent", True),
    (dict(e=100, w=4), dict(e=100, w=9), {"wl_joins": 5}, "join", False),
    (dict(e=100, w=4), dict(e=100, w=1), {"wl_drops": 3}, "wl_drop", True),
    (dict(e=90, w=4), dict(e=90, w=1), {"wl_drops": 3}, "wl_drop", False),
    (dict(e=100, w=4), dict(e=100, w=0, c=90), {"wl_drops": 4}, "wl_drop_capcut", True),
    (dict(e=80, w=0), dict(e=78, w=0), {"enr_drops": 2}, "enr_drop", False),
    (dict(e=100, w=6), dict(e=98, w=6), {"enr_drops": 2}, "enr_drop", True),
    (dict(e=100, w=6), dict(e=98, w=5), {"enr_drops": 2, "wl_drops": 1}, "enr_drop_wl_drop", True),
    (dict(e=100, w=6), dict(e=99, w=8), {"enr_drops": 1, "wl_joins": 2}, "enr_drop_join", False),
    (dict(e=100, w=6), dict(e=100, w=6, c=120), {}, "none", False),
]


def test_every_rule(spark):
    rows = []
    for n, (first, second, *_rest) in enumerate(CASES):
        rows += [{"s": f"{n:02d}", "i": 0, **first}, {"s": f"{n:02d}", "i": 1, **second}]
    out = fl.interval_flows(panel(spark, rows)).orderBy("section_id").collect()
    assert len(out) == len(CASES)
    for row, (_a, _b, flows, rule, ambiguous) in zip(out, CASES):
        assert {c: row[c] for c in FLOW_NAMES if row[c]} == flows, row
        assert (row["rule"], row["ambiguous"]) == (rule, ambiguous), row
        assert row["d_enrolled"] == row["admits"] + row["enr_joins"] - row["enr_drops"]
        if rule != "inconsistent":
            assert row["d_waitlist"] == row["wl_joins"] - row["wl_drops"] - row["admits"]


def test_columns_expansion_and_full(spark):
    row = pair(spark, dict(e=95, w=3, open=5), dict(e=95, w=3, c=120))
    assert tuple(row.asDict()) == (*FLOW_COLUMNS, "term_id")
    assert row["full0"] and row["expansion"] and row["interval_min"] == 30.0
    assert not pair(spark, dict(e=95, w=3, open=0), dict(e=95, w=3))["full0"]


def test_unobserved_null_and_tombstone(spark):
    skipped = fl.interval_flows(panel(spark, [
        dict(i=0, e=100, w=5), dict(i=1, e=100, w=5, observed=False), dict(i=2, e=101, w=4)])).collect()
    assert [(r["interval_min"], r["admits"]) for r in skipped] == [(60.0, 1)]
    holes = fl.interval_flows(panel(spark, [dict(i=0, e=100, w=5), dict(i=1, e=100, w=None), dict(i=2, e=100, w=3)])).collect()
    assert [r["interval_min"] for r in holes] == [60.0]
    ended = fl.interval_flows(panel(spark, [
        dict(i=0, e=100, w=5), dict(i=1, e=100, w=4), dict(i=2, e=100, w=4, status="GONE"), dict(i=3, e=100, w=0)])).collect()
    assert [r["t1"] for r in ended] == [START + dt.timedelta(minutes=30)]


def test_outages(spark):
    p = panel(spark, [dict(i=i, e=100, w=5) for i in range(4)])
    minute = lambda m: START + dt.timedelta(minutes=m)
    log = lambda *rows: spark.createDataFrame(list(rows), "start timestamp, end timestamp, kind string, term_id string")
    censored = lambda o: [r["censored"] for r in fl.interval_flows(p, outages=o).orderBy("t0").collect()]
    assert censored(log((minute(40), minute(50), "outage", "2268"), (minute(40), None, "outage", "2272"),
                        (minute(75), None, "source_switch", None))) == [False, True, True]
    assert censored(log((minute(40), None, "outage", None))) == [False, True, True]
    assert censored(log((minute(30), minute(31), "outage", None))) == [True, True, False]  # touching the start counts
    assert all(r["censored"] for r in fl.interval_flows(p, max_interval_min=29).collect())
    many = log((minute(40), minute(50), "outage", "2268"), (minute(75), None, "source_switch", None), (minute(80), None, "outage", "2272"))
    rows = fl.interval_flows(p).drop("censored").withColumn("term_id", F.lit("2268"))
    by_day = fl.attach_outages(rows, many, inline_limit=0).orderBy("t0").collect()
    assert [r["_outage"] for r in by_day] == [r["_outage"] for r in fl.attach_outages(rows, many).orderBy("t0").collect()]


def test_summary_and_totals(spark):
    flows = fl.interval_flows(panel(spark, [dict(i=0, e=100, w=5), dict(i=1, e=102, w=3), dict(i=2, e=102, w=6)]))
    row = fl.flow_summary(flows).first()
    assert (row["sections"], row["intervals"], row["admits"], row["wl_joins"], row["median_interval_min"]) == (1, 2, 2, 3, 30.0)
    assert fl.exit_tally(flows).first().asDict() == {"admitted": 2, "dropped": 0, "still_waiting": 6}
    empty = fl.flow_summary(flows.limit(0)).first()
    assert (empty["intervals"], empty["admits"], empty["share_ambiguous"]) == (0, 0, 0.0)


def test_hot_sections_give_the_same_flows(spark, tiny_chunks):
    rows = [dict(s="hot", i=i, e=90 + i % 7, w=(i * 5) % 6) for i in range(60)] + [dict(s="cold", i=i, e=90 + i, w=2) for i in range(3)]
    p = panel(spark, rows)
    split = fl.cumulative_flows(fl.interval_flows(p))
    got = sorted(map(tuple, split.collect()))
    spark.conf.unset("spark.turnwise.chunkRows")
    assert got == sorted(map(tuple, fl.cumulative_flows(fl.interval_flows(p)).collect()))
    assert len(got) == 61


def test_unknown_column_is_an_error(spark):
    with pytest.raises(Exception, match="section_status"):
        fl.interval_flows(spark.createDataFrame([("1",)], "section_id string")).count()
