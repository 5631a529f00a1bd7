import datetime as dt

import numpy as np

from turnwise.plans.analysis import run_analysis
from turnwise.sources.calendar import calendar_for
from turnwise.sources.tables_out import read_backtests


def test_every_stage_writes_its_tables(spark, tmp_path):
    rng = np.random.default_rng(9)
    start = dt.datetime(2026, 6, 20)
    rows = []
    for section in range(12):
        enrolled, waiting = 100, 6
        for i in range(140):
            rows.append((str(section), start + dt.timedelta(hours=12 * i), enrolled, 100 + 3 * i, waiting, 20, None, None, "O", None,
                         True, "site", "full", "delta", "2268"))
            gain = int(rng.integers(0, 3))
            gain = min(gain, waiting)
            enrolled, waiting = enrolled + gain, max(0, waiting - gain - int(rng.random() < 0.2) + int(rng.integers(0, 3)))
            waiting = min(waiting, 20)
    panel = spark.createDataFrame(rows, "section_id string, run_started_at timestamp, enrolled_count int, enroll_capacity int, waitlist_count int, "
                                  "waitlist_capacity int, reserved_count int, open_reserved int, status string, section_status string, "
                                  "observed boolean, source string, scope string, kind string, term_id string")
    identity = spark.createDataFrame([(str(s), f"S{s % 2} {s * 20}", f"S{s % 2}", str(s * 20), "LEC") for s in range(12)],
                                     "section_id string, course_key string, subject string, catalog_number string, component string")
    out = str(tmp_path / "out")
    done = run_analysis(panel, identity, calendar_for("2268"), out, n_boot=3, positions=(1, 3))
    assert {"flow_summary", "km_phase", "cox", "cox_test", "sensitivity"} <= set(done.tables), done.notes
    index = spark.read.json(f"{out}/tables/index")
    assert index.count() == 12 and set(index.columns) >= {"course_key", "buckets", "joins"}
    assert spark.read.json(f"{out}/tables/courses").where("subject_file = 'S0'").count() > 0
    read = read_backtests(spark, f"{out}/backtest")
    assert {r["predictor"] for r in read.collect()} >= {"bucket", "course"} and read.first()["horizon_label"] == "within 14 days"
    small = run_analysis(panel.where("section_id = '1'").limit(3), identity, calendar_for("2268"), str(tmp_path / "small"), n_boot=0)
    assert small.backtest is None and "too few" in small.notes[0]
