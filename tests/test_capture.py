"""Store, history, quality, sources, streaming and typed names."""
import datetime as dt
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from turnwise.functions.scalars import normalise_course, parse_stamp, shard_of, subject_slug, term_id_of, verdict
from turnwise.operators import activity as ac
from turnwise.operators import flows as fl
from turnwise.operators import history as hi
from turnwise.operators import quality as qu
from turnwise.functions import special
from turnwise.operators import resolve as rs
from turnwise.operators import store as st
from turnwise.schema import SNAPSHOT
from turnwise.sources import catalog as ca
from turnwise.sources import event_log as el
from turnwise.sources import history as hs
from turnwise.sources import parsers as pa
from turnwise.sources import snapshots as sn

T0 = dt.datetime(2026, 11, 1, 0, 0)
UTC = dt.timezone.utc


def snap(i, sid, e=10, w=0, at=None, **kw):
    row = dict(fetched_at=at or T0 + dt.timedelta(minutes=30 * i), term_id="2268", section_id=sid, course_key="A 1", subject="A",
               catalog_number="1", class_number="001", section_number="001", component="LEC", is_primary=None, session_id="1",
               enrolled_count=e, enroll_capacity=20, waitlist_count=w, waitlist_capacity=5, reserved_count=None, open_reserved=None,
               status="O", section_status=None, source="site")
    row.update(kw)
    return tuple(row[f] for f in SNAPSHOT.fieldNames())


def rows(spark, items):
    return spark.createDataFrame(items, SNAPSHOT)


def test_delta_and_tombstones(spark):
    prev = rows(spark, [snap(0, "1"), snap(0, "2"), snap(0, "3"), snap(0, "4", section_status="GONE"), snap(0, "5", source="feed"),
                        snap(0, "6", open_reserved=None)])
    now = rows(spark, [snap(1, "1"), snap(1, "2", w=3), snap(1, "6", open_reserved=0), snap(1, "9")])
    universe = spark.createDataFrame([("1",), ("2",)], "section_id string")
    at = dt.datetime(2026, 11, 1, 1, tzinfo=UTC)
    out = {r["section_id"]: r for r in st.compute_delta(prev, now, universe, at, "site").collect()}
    assert set(out) == {"2", "3", "6", "9"}
    assert out["3"]["section_status"] == "GONE" and out["3"]["enrolled_count"] == 10
    assert out["3"]["fetched_at"] == dt.datetime(2026, 11, 1, 1)
    assert {r["section_id"] for r in st.compute_delta(prev, now, None, at, "site").collect()} == {"2", "6", "9"}
    assert st.baseline_with_tombstones(prev, now, universe, at, "site").count() == 5


def _plain_rebuild(files):
    """State carried forward file by file."""
    state, out = {}, []
    for run, items in files:
        for r in items:
            state[r[2]] = r
        names = SNAPSHOT.fieldNames()
        gone = {k for k, r in state.items() if r[names.index("section_status")] == "GONE"}
        if run["observed_ids"] is not None:
            ids = set(run["observed_ids"])
        elif run["scope"] == "priority":
            ids = {r[2] for r in items}
        else:
            ids = set(state)
        seen = (ids - set(run["missing_ids"])) | gone
        out += [(k, run["run_started_at"], r[names.index("waitlist_count")], k in seen) for k, r in state.items()]
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_rebuild_matches_plain_carry_forward(spark, hot):
    plan = [("baseline", "full", None, [], {"1": 0, "2": 1}), ("delta", "full", None, ["2"], {"3": 2}),
            ("delta", "priority", ["1", "3"], [], {"1": 4}), ("delta", "priority", None, [], {"2": 5}),
            ("delta", "full", ["1"], ["1"], {}), ("delta", "full", None, [], {"3": (7, "GONE")}),
            ("delta", "priority", ["1"], [], {}), ("baseline", "full", None, ["3"], {"1": 1, "2": 1}), ("delta", "full", None, [], {"3": 3})]
    files, snaps, runs = [], [], []
    for i, (kind, scope, listed, missing, counts) in enumerate(plan):
        at = T0 + dt.timedelta(hours=5 * i)
        items = [snap(i, k, w=v[0] if isinstance(v, tuple) else v, at=at, section_status="GONE" if isinstance(v, tuple) else None)
                 for k, v in counts.items()]
        run = dict(run_started_at=at, kind=kind, scope=scope, observed_ids=listed, missing_ids=missing)
        files.append((run, items))
        snaps += [(*r, at, kind) for r in items]
        runs.append((at, "2268", "site", kind, scope, "", "", missing, len(items), len(items), listed, listed is None))
    schema = SNAPSHOT.__class__(list(SNAPSHOT.fields)).add("run_started_at", "timestamp").add("kind", "string")
    from turnwise.schema import RUNS
    if hot:
        spark.conf.set("spark.turnwise.chunkRows", "3")
    out = st.rebuild_panel(spark.createDataFrame(snaps, schema), spark.createDataFrame(runs, RUNS))
    got = sorted((r["section_id"], r["run_started_at"], r["waitlist_count"], r["observed"]) for r in out.collect())
    spark.conf.unset("spark.turnwise.chunkRows")
    assert got == _plain_rebuild(files)
    late = st.rebuild_panel(spark.createDataFrame(snaps, schema), spark.createDataFrame(runs, RUNS), start=dt.date(2026, 11, 2))
    assert {(r["section_id"], r["run_started_at"]) for r in late.collect()} == {g[:2] for g in got if g[1] >= dt.datetime(2026, 11, 2)}


def test_validation(spark):
    good = rows(spark, [snap(0, "1"), snap(0, "2")])
    assert st.validate_snapshots(good, ("site",)).isEmpty()
    bad = rows(spark, [snap(0, "1"), snap(0, "1"), snap(0, "3", source="other")]).withColumn("extra", F.lit(1)).withColumn(
        "waitlist_count", F.col("waitlist_count").cast("double"))
    found = {(r["rule"], r["field"]): r["violations"] for r in st.validate_snapshots(bad, ("site",)).collect()}
    assert found == {("duplicate_id", "section_id"): 1, ("unknown_source", "source"): 1, ("extra_column", "extra"): 1,
                     ("wrong_type", "waitlist_count"): 1}


def test_append_refuses_a_second_write(spark, tmp_path):
    root = str(tmp_path)
    from turnwise.schema import RUNS
    run = spark.createDataFrame([(T0, "2268", "site", "baseline", "full", "", "", [], 2, 0, None, True)], RUNS)
    assert sn.append_run(root, rows(spark, [snap(0, "1"), snap(0, "2")]), run) == 2
    with pytest.raises(FileExistsError):
        sn.append_run(root, rows(spark, [snap(0, "1")]), run)
    assert sn.read_runs(spark, root).first()["n_written"] == 2
    state = st.state_as_of(sn.read_rows(spark, root, start=dt.date(2026, 10, 30)), dt.date(2026, 11, 1))
    assert state.count() == 2
    assert sn.import_footers(spark, root + "/runs").count() >= 1


def test_history_hand_case(spark, tmp_path, tiny_chunks):
    seg = lambda a, b, e, w: dict(startTime=iso(a), endTime=iso(b), status="O", enrolledCount=e, waitlistedCount=w, maxEnroll=100, maxWaitlist=20)
    iso = lambda m: (T0 + dt.timedelta(minutes=m)).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    body = dict(key="A|1|001", term_id="2268", section=dict(course_key="A 1"), enrollment=dict(
        sectionId="7", history=[seg(135, 135, 101, 4), seg(120, 0, 100, 5), seg(330, 600, 101, 6)]))
    for name, key in (("a", "A|1|001"), ("b", "B|1|001")):
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            json.dump({**body, "key": key}, f)
    payloads = hs.first_payloads(hs.read_payloads(spark, str(tmp_path)))
    assert payloads.count() == 1
    segments = hs.segments(payloads)
    panel = hi.history_panel(segments)
    minute = lambda t: int((t - T0).total_seconds() // 60)
    assert sorted(minute(r[0]) for r in panel.select("run_started_at").collect()) == [0, 120, 135, 330, 600]
    gaps = hi.crossings(segments)
    assert sorted((r["minutes"], r["wide"]) for r in gaps.collect()) == [(15.0, False), (195.0, True)]
    flows = hi.history_flows(panel, gaps).orderBy("t0").collect()
    assert [(r["interval_min"], r["rule"], r["censored"]) for r in flows] == [
        (120.0, "none", False), (15.0, "admit", False), (195.0, "join", True), (270.0, "none", False)]


def test_dark_time(spark):
    day = lambda d, h=0: dt.datetime(2026, 11, d, h)
    ident = spark.createDataFrame([("X", day(1), day(4)), ("Y", day(1), day(4))], "section_id string, first_seen timestamp, last_seen timestamp")
    gaps = spark.createDataFrame([("X", day(2), day(3), 1440.0, True)], "section_id string, t0 timestamp, t1 timestamp, minutes double, wide boolean")
    got = [(r["sections_covered"], r["sections_dark"], r["share_time_in_gap"]) for r in hi.dark_time(gaps, ident).orderBy("date").collect()]
    assert got == [(2, 0, 0.0), (2, 1, 0.5), (2, 0, 0.0)]


def test_dark_time_counts_days_without_copying_rows_to_them(spark):
    """Against a loop over days, with stretches that overlap, touch midnight, are empty or share a day; and no row per day."""
    rng = random.Random(5)
    at = lambda: dt.datetime(2026, 11, 1) + dt.timedelta(hours=12 * rng.randrange(40), microseconds=rng.choice((0, 0, 1)))
    gaps = [(rng.choice(("X", "Y", "Z", None)), at(), at(), 1.0, rng.random() < 0.8) for _ in range(60)]
    ident = [(k, *sorted((at(), at()))) for k in "XYZ"]
    inside = lambda a, z, d: (min(z, d + dt.timedelta(days=1)) - max(a, d)).total_seconds()
    first, last = min(i[1] for i in ident), max(i[2] for i in ident) - dt.timedelta(microseconds=1)
    day, want = dt.datetime(first.year, first.month, first.day), []
    while day <= last:
        own = [inside(a, z, day) for _, a, z in ident if z > a and inside(a, z, day) > 0]
        dark = [(k, inside(a, z, day)) for k, a, z, _, wide in gaps if wide and z > a and inside(a, z, day) > 0]
        share = round(sum(x for _, x in dark) / sum(own), 4) if own else 0.0
        want.append((day.date(), len(own), len({k for k, _ in dark if k}), share))
        day += dt.timedelta(days=1)
    out = hi.dark_time(
        spark.createDataFrame(gaps, "section_id string, t0 timestamp, t1 timestamp, minutes double, wide boolean"),
        spark.createDataFrame(ident, "section_id string, first_seen timestamp, last_seen timestamp"))
    got = [tuple(r) for r in out.orderBy("date").collect()]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) <= 1e-4 for g, w in zip(got, want))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(cast(first_seen" not in plan and "sequence(cast(t0" not in plan


def test_catalog_entries_do_not_carry_the_file(spark, tmp_path):
    """The term is worked out once per file, below the explosion, so an entry's row does not hold all entries."""
    (tmp_path / "22681").mkdir()
    entries = [{"section_id": str(i), "term_id": "2265" if i == 3 else None} for i in range(5)]
    (tmp_path / "22681" / "a.json").write_text(json.dumps({"sections": entries}))
    (tmp_path / "22681" / "b.json").write_text(json.dumps({"term_id": "2272", "sections": entries[:1]}))
    rows = ca.read_catalog(spark, str(tmp_path / "*"))
    assert sorted((r["catalog_term_id"], r["ordinal"], r["section_id"]) for r in rows.collect()) == [
        *[("2265", i, str(i)) for i in range(5)], ("2272", 0, "0")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" in plan and plan.index("Generate posexplode") < plan.index("lambda")


def test_cadence(spark):
    times = [(T0 + dt.timedelta(minutes=m), "2268", "full", n, k) for m, n, k in ((0, 10, 0), (30, 8, 2), (60, 1, 9), (150, 5, 5), (180, 0, 0))]
    runs = spark.createDataFrame(times, "run_started_at timestamp, term_id string, scope string, n_observed int, n_missing int")
    report = qu.cadence_report(runs, dt.datetime(2026, 11, 1, 3, tzinfo=UTC))
    row = report.where("scope = 'all'").first()
    assert (row["n_runs"], row["largest_gap_min"], row["share_gaps_le_45min"], row["p95_gap_min"]) == (5, 90.0, 0.75, 81.0)
    share = qu.missing_share(runs)
    assert share.first().asDict() == {"term_id": "2268", "median_missing_share": 0.35, "max_missing_share": 0.9}
    assert qu.breaches(report, share, gap_min=89, runs_lt=6, missing_share_gt=0.5).count() == 2


def test_event_log(spark, tmp_path):
    text = """| start_utc | end_utc | kind | term_id | scope | note | who |
| 2026-09-19T02:46Z | - | outage | 2268 | all | down | a |
| 2026-09-20 | 2026-09-21T10:00Z | schema | - | all | new column | a |
| 2026-09-22 | - | note | - | all | nothing | a |
| 2026-13-45 | - | outage | - | all | bad date | a |
| 2026-09-25T10:00Z | - | source_switch | - | all | switched | a |
| 2026-09-26 | - | correction | 2268 | all | the row that starts 2026-09-19T02:46Z: end_utc is 2026-09-19T08:01Z | a |
"""
    (tmp_path / "log.md").write_text(text)
    got = el.outages(el.read_log(spark, str(tmp_path / "log.md"))).orderBy("start").collect()
    assert [r["kind"] for r in got] == ["outage", "schema", "source_switch"]
    assert got[0]["end"] == dt.datetime(2026, 9, 19, 8, 1) and got[0]["term_id"] == "2268" and got[1]["term_id"] is None


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(term_id_of(F.lit(" spring 2027 "))) == "2272" and one(term_id_of(F.lit("2027"))) is None
    assert one(normalise_course(F.lit("el eng  16a"))) == "ELENG 16A" and one(normalise_course(F.lit("eleng"))) == "ELENG"
    assert one(subject_slug(F.lit("L & S"))) == "L_S"
    assert one(parse_stamp(F.lit("-"))) is None and one(parse_stamp(F.lit("2026-09-19T02:46Z"))) == dt.datetime(2026, 9, 19, 2, 46)
    import hashlib
    for text in ("/content/a", "x", "2026"):
        assert one(shard_of(F.lit(text), 12)) == int(hashlib.sha1(text.encode()).hexdigest(), 16) % 12
    v = lambda p, lo, hi, pool=None: one(verdict(F.lit(p), F.lit(lo), F.lit(hi), F.lit(pool).cast("string")))
    assert [v(.8, .7, .9), v(.5, .4, .6), v(.1, .0, .2), v(.8, .1, .9), v(.8, .7, .9, "all")] == [
        "Likely", "Could go either way", "Unlikely", "Too little data to call", "Too little data to call"]


def test_patterns(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# list\nmath 1*\nel eng *\nSTAT 20 # exact\nDATA\nCOMPSCI [67]?A\n")
    patterns = ca.read_patterns(spark, str(tmp_path / "p.txt"))
    keys = spark.createDataFrame([(k,) for k in ("MATH 1A", "MATH 53", "ELENG 16A", "STAT 20", "DATA C8", "COMPSCI 61A", "COMPSCI 51A")], "course_key string")
    got = {r["course_key"]: r["rank"] for r in ac.course_ranks(keys, patterns).collect()}
    assert got == {"MATH 1A": 0, "ELENG 16A": 1, "STAT 20": 2, "DATA C8": 3, "COMPSCI 61A": 4}


def test_nested_samples(spark):
    s = spark.createDataFrame([(f"k{i}", "LEC" if i % 5 else "IND") for i in range(100)], "key string, component string")
    small, large = ([r["key"] for r in ac.nested_sample(s, "key", limit=n).collect()] for n in (10, 40))
    assert large[:10] == small and len(set(large)) == 40


def test_registrar_and_catalog_json(spark):
    section = {"id": 30174, "number": "001", "component": {"code": "LEC"}, "status": {"code": "A"}, "association": {"primary": True},
               "class": {"number": "001", "course": {"subjectArea": {"code": "EL ENG"}, "catalogNumber": {"formatted": "16A"}},
                         "session": {"id": "1", "term": {"id": "2268"}}},
               "enrollmentStatus": {"status": {"code": "O"}, "enrolledCount": 5, "maxEnroll": 10, "waitlistedCount": 0, "maxWaitlist": 3}}
    page = {"apiResponse": {"response": {"classSections": [section, {**section, "id": 2, "status": {"code": "X"}},
                                                           {**section, "id": 3, "enrollmentStatus": {"enrolledCount": "many"}}]}}}
    raw = spark.createDataFrame([("a", json.dumps(page)), ("b", "{}")], "url string, body string")
    got = {(r["url"], r["section_id"]): r for r in pa.parse_registrar(raw, T0, "registrar").collect()}
    assert set(got) == {("a", "30174"), ("a", "3"), ("b", None)}
    assert got["a", "30174"]["course_key"] == "ELENG 16A" and got["a", "30174"]["reject"] == []
    assert "enrolled_count" in got["a", "3"]["reject"] and got["b", None]["reject"] == ["envelope"]
    latest = {"status": "O", "enrolledCount": 1, "maxEnroll": 2, "waitlistedCount": 0, "maxWaitlist": 0}
    entry = {"subject": "EL ENG", "courseNumber": "16A", "number": "001", "primarySection": {"component": "LEC", "enrollment": {"latest": latest}}}
    cat = {"data": {"catalog": [entry, {**entry, "sessionId": "9"}, {**entry, "number": "002", "primarySection": {"component": "LEC", "enrollment": {}}},
                                {**entry, "number": "003", "primarySection": {"component": "", "enrollment": {"latest": latest}}}]}}
    out = pa.parse_catalog(spark.createDataFrame([("a", json.dumps(cat))], "url string, body string"), T0, "2268", "catalog").collect()
    assert sorted((r["section_id"], r["session_id"], len(r["reject"])) for r in out) == [("bt:ELENG:16A:001", "1", 0), ("bt:ELENG:16A:003", "1", 1)]


def test_section_page_and_feed(spark):
    blob = {"ucb": {"enrollment": {"available": {"id": 30174, "enrollmentStatus": {
        "status": {"code": "W"}, "enrolledCount": 9, "maxEnroll": 9, "waitlistedCount": 2, "maxWaitlist": 5, "openReserved": 0}}}}}
    html = ('<html><head><title>2026 Fall EE 16A 001 LEC 001 | Search</title><link href="https://x.org/content/2026-fall-ee-16a" rel="canonical">'
            f'<script type="application/json" data-drupal-selector="drupal-settings-json">{json.dumps(blob)}</script></head>'
            '<body data-term="2268"></body></html>')
    raw = spark.createDataFrame([("u", html), ("v", "<html><title>Other</title></html>")], "url string, html string")
    got = {r["url"]: r for r in pa.parse_section_pages(raw, T0, "site").collect()}
    row = got["u"]
    assert (row["section_id"], row["course_key"], row["url_path"], row["waitlist_count"], row["term_id"], row["reject"]) == (
        "30174", "EE 16A", "/content/2026-fall-ee-16a", 2, "2268", [])
    assert "settings" in got["v"]["reject"]
    feed = ("<rss><item><title><![CDATA[ 2026 Fall EE 16A 001 LEC 001 ]]></title><link>https://x.org/content/a</link><guid isPermaLink='false'>12 at x</guid></item>"
            "<item><title>no</title><link>https://x.org/about</link><guid>13</guid></item></rss>")
    items = pa.parse_feed(spark.createDataFrame([("f", feed)], "url string, body string")).collect()
    assert [(r["node_id"], r["url_path"], r["title"]) for r in items] == [(12, "/content/a", "2026 Fall EE 16A 001 LEC 001")]


def test_typed_names(spark):
    index = spark.createDataFrame(
        [(f"{s} {n}", s, n, j) for s, n, j in (("COMPSCI", "61A", 90), ("COMPSCI", "70", 40), ("STAT", "20", 30), ("DATA", "C8", 80), ("MATH", "54", 20),
                                               ("COLWRIT", "R1A", 5))], "course_key string, subject string, number string, joins long")
    vocabulary = rs.build_vocabulary(
        spark.createDataFrame([("CS", "COMPSCI"), ("STATS", "STAT")], "alias string, subject string"),
        spark.createDataFrame([("COMPSCI", "Computer Science", 0), ("MATH", "Mathematics", 0)], "subject string, name string, ordinal int"),
        spark.createDataFrame([("Data 8", "DATA C8"), ("coders", "COMPSCI")], "nickname string, target string"))
    want = {"compsci 61a": ("COMPSCI 61A", "exact"), "cs61a": ("COMPSCI 61A", "alias"), "computer science 70": ("COMPSCI 70", "name"),
            "data 8": ("DATA C8", "nickname"), "coders 70": ("COMPSCI 70", "nickname"), "cs 61 A": ("COMPSCI 61A", "split"),
            "cs 61 A lecture": ("COMPSCI 61A", "split"), "fall 2026 stats 20": ("STAT 20", "filler"), "61a": ("COMPSCI 61A", "bare"),
            "compsi 61a": ("COMPSCI 61A", "fuzzy"), "mtah 54": ("MATH 54", "fuzzy"), "colwrit r1a": ("COLWRIT R1A", "exact"),
            "compsci 999": (None, "miss"), "zzz": (None, "miss")}
    asked = spark.createDataFrame([(q,) for q in want], "query string")
    got = {r["query"]: (r["course_key"], r["layer"]) for r in rs.match_courses(asked, index, vocabulary).collect()}
    assert got == want
    near = rs.nearest_courses(asked.where("query IN ('compsci 999', 'zzz')"), index, vocabulary)
    assert {(r["query"], r["rank"]): r["course_key"] for r in near.collect()}["compsci 999", 1] == "COMPSCI 61A"
    assert near.where("query = 'zzz'").count() == 3
    # a misspelt subject without such a number: the nearest subject's courses, not the most joined
    near = rs.nearest_courses(spark.createDataFrame([("mtah 999",), ("stta 1",)], "query string"), index, vocabulary).collect()
    assert sorted((r["query"], r["rank"], r["course_key"]) for r in near) == [("mtah 999", 1, "MATH 54"), ("stta 1", 1, "STAT 20")]


def test_near_subjects_match_all_pairs(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("ABC") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    keys = spark.createDataFrame([(w, w, "1", i) for i, w in enumerate(dict.fromkeys(words[:40]))],
                                 "course_key string, subject string, number string, joins long")
    none = rs.build_vocabulary(spark.createDataFrame([], "alias string, subject string"), spark.createDataFrame(
        [], "subject string, name string, ordinal int"), spark.createDataFrame([], "nickname string, target string"))
    tokens = spark.createDataFrame([(w,) for w in words], "token string")
    got = {(r["token"], r["subject"]): r["d"] for r in rs.near_subjects(tokens, keys, none).collect()}
    want = {(a, z): special._osa(a, z) for a in set(words) for z in set(words[:40])}
    assert got == {k: d for k, d in want.items() if 0 < d <= (1 if len(k[0]) <= 5 else 2)} and len(got) > 50


def test_suggestions(spark):
    index = spark.createDataFrame(
        [(f"{s} {n}", s, n, j) for s, n, j in (("MATH", "1", 1), ("MATH", "10", 9), ("MATH", "1A", 8), ("MATHX", "1", 50), ("MATH", "C10", 7),
                                               ("MATH", "H53", 3), ("STAT", "20", 30), ("DATA", "C8", 80), ("STAT", "C20", 5))],
        "course_key string, subject string, number string, joins long")
    vocabulary = rs.build_vocabulary(
        spark.createDataFrame([("STATS", "STAT")], "alias string, subject string"),
        spark.createDataFrame([("STAT", "Statistics", 0)], "subject string, name string, ordinal int"),
        spark.createDataFrame([("Data 8", "DATA C8")], "nickname string, target string"))
    asked = ["math 1", "mat", "math h", "stats", "statistics", "20", "mtah 1", "data 8", "zzz", "math 7"]
    rows = rs.suggest_courses(spark.createDataFrame([(q,) for q in asked], "query string"), index, vocabulary, n=5).collect()
    got = {q: [r["course_key"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query"] == q] for q in asked}
    assert got["math 1"] == ["MATH 1", "MATH 10", "MATH 1A", "MATH C10", "MATHX 1"]  # the course meant, whole subjects, then prefixes
    assert got["mat"] == ["MATHX 1", "MATH 10", "MATH 1A", "MATH C10", "MATH H53"]
    assert got["math h"] == ["MATH H53"]  # the key begins so
    assert got["stats"] == got["statistics"] == ["STAT 20", "STAT C20"]
    assert got["20"] == ["STAT 20", "STAT C20"]  # nothing begins so: what the matcher finds
    assert got["mtah 1"] == ["MATH 1"] and got["data 8"][0] == "DATA C8"
    assert got["zzz"] == [] and got["math 7"] == []


def test_streams(spark, tmp_path):
    schema = ("section_id string, term_id string, run_started_at timestamp, enrolled_count int, enroll_capacity int, waitlist_count int, "
              "waitlist_capacity int, reserved_count int, open_reserved int, status string, section_status string, observed boolean")
    source = tmp_path / "in"
    items = [("1", "2268", T0 + dt.timedelta(minutes=30 * i), e, 100, w, 20, None, None, "O", None, True)
             for i, (e, w) in enumerate([(100, 5), (100, 5), (102, 3), (102, 6)])]
    from turnwise.streaming import incremental as inc

    def run(build, name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = build(stream).writeStream.format("memory").queryName(name).outputMode("append") \
            .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    for part in (items[:2], items[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    flows = sorted(run(inc.flow_stream, "s_flows"), key=lambda r: r["t0"])
    assert [(r["admits"], r["wl_joins"], r["rule"]) for r in flows] == [(0, 0, "none"), (2, 0, "admit"), (0, 3, "join")]
    assert [(f["admits"], f["rule"]) for f in sorted(fl.interval_flows(spark.createDataFrame(items, schema)).collect(),
                                                     key=lambda r: r["t0"])] == [(f["admits"], f["rule"]) for f in flows]
    delta = run(inc.delta_stream, "s_delta")
    assert sorted((r["enrolled_count"], r["waitlist_count"]) for r in delta) == [(100, 5), (102, 3), (102, 6)]
    gaps = run(lambda s: inc.gap_alerts(s, 20.0), "s_gaps")
    assert sorted(r["gap_min"] for r in gaps if not r["silent"]) == [30.0, 30.0, 30.0]


def test_rows_late_within_the_watermark_are_placed(spark, tmp_path):
    schema = ("section_id string, term_id string, run_started_at timestamp, enrolled_count int, enroll_capacity int, waitlist_count int, "
              "waitlist_capacity int, reserved_count int, open_reserved int, status string, section_status string, observed boolean")
    row = lambda s, i: (s, "2268", T0 + dt.timedelta(minutes=30 * i), 100 + i % 3, 100, (i * 7) % 5, 20, None, None, "O", None, True)
    # rows 1 and 4 come a file late; a row of another section moves event time on at the end
    files = [[row("1", 0), row("1", 2)], [row("1", 1), row("1", 3)], [row("1", 5)], [row("1", 4), row("1", 6)], [row("2", 40)], [row("2", 41)]]
    from turnwise.streaming import incremental as inc

    source = tmp_path / "in"
    for part in files:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))

    def run(build, name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = build(stream).writeStream.format("memory").queryName(name).outputMode("append") \
            .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).where("section_id = '1'").collect()

    everything = spark.createDataFrame([r for part in files for r in part if r[0] == "1"], schema)
    key = lambda r: (r["t0"], r["t1"], r["admits"], r["wl_joins"], r["wl_drops"], r["rule"])
    wanted = sorted(key(r) for r in fl.interval_flows(everything).collect())
    assert len(wanted) == 6
    assert sorted(key(r) for r in run(lambda s: inc.flow_stream(s, wait=True), "w_flows")) == wanted
    assert len(run(inc.flow_stream, "n_flows")) < 6  # at once: what came late is lost
    delta = run(lambda s: inc.delta_stream(s, wait=True), "w_delta")
    assert sorted(r["run_started_at"].minute // 30 + 2 * r["run_started_at"].hour for r in delta) == sorted(
        r[2].minute // 30 + 2 * r[2].hour for part in files for r in part if r[0] == "1")


def test_flow_stream_is_cut_at_the_tombstone_and_knows_outages(spark, tmp_path):
    schema = ("section_id string, term_id string, run_started_at timestamp, enrolled_count int, enroll_capacity int, waitlist_count int, "
              "waitlist_capacity int, reserved_count int, open_reserved int, status string, section_status string, observed boolean")
    items = [(s, t, T0 + dt.timedelta(minutes=30 * i), 100 + i % 3, 100, (i * 7) % 5, 20, None, None, "O",
              "GONE" if (s, t, i) in {("1", "2268", 5), ("2", "2272", 2)} else None, i % 4 != 1)
             for s in "123" for t in ("2268", "2272") for i in range(9)]
    log = spark.createDataFrame([(T0 + dt.timedelta(minutes=70), T0 + dt.timedelta(minutes=95), "outage", "2268")],
                                "start timestamp, end timestamp, kind string, term_id string")
    from turnwise.streaming import incremental as inc

    source = tmp_path / "in"
    for cut in (range(0, 4), range(4, 6), range(6, 9)):
        part = [r for r in items if int((r[2] - T0).total_seconds()) // 1800 in cut]
        spark.createDataFrame(part[::-1], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = inc.flow_stream(stream, outages=log).writeStream.format("memory").queryName("s_cut").outputMode("append") \
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = fl.interval_flows(spark.createDataFrame(items, schema), outages=log)
    key = lambda r: tuple(r[c] for c in ("section_id", "term_id", "t0", "t1", "admits", "wl_joins", "wl_drops", "rule", "censored"))
    assert sorted(map(key, spark.table("s_cut").collect())) == sorted(map(key, batch.collect()))
    assert any(r["censored"] for r in batch.collect())


def test_run_kinds_of_late_runs_keep_all_columns(spark):
    from turnwise.streaming import incremental as inc

    schema = "term_id string, run_started_at timestamp, source string, n_observed int"
    at = lambda h: dt.datetime(2026, 11, 1, h)
    written = spark.createDataFrame([("2268", at(6), "baseline"), ("2268", at(8), "delta")],
                                    "term_id string, run_started_at timestamp, decided string")
    new = spark.createDataFrame([("2268", at(5), "site", 3), ("2268", at(8), "site", 4), ("2272", at(9), "feed", 5), ("2272", at(10), "feed", 6)], schema)
    got = {(r["term_id"], r["run_started_at"].hour): (r["decided"], r["source"], r["n_observed"]) for r in inc.decide_kinds(new, written).collect()}
    assert got == {("2268", 5): ("delta", "site", 3), ("2272", 9): ("baseline", "feed", 5), ("2272", 10): ("delta", "feed", 6)}


def test_later_baselines_do_not_count(spark):
    runs = [("2268", dt.datetime(2026, 11, 1, h), s, k) for h, s, k in
            ((0, "feed", "baseline"), (1, "feed", "delta"), (5, "site", "baseline"), (6, "site", "delta"), (7, "feed", "delta"))]
    out = st.source_mismatches(spark.createDataFrame(runs, "term_id string, run_started_at timestamp, source string, kind string"))
    assert [(r["run_started_at"].hour, r["baseline_source"]) for r in out.collect()] == [(7, "site")]


def test_terms_never_mix(spark):
    items, runs = [], []
    for term, hours in (("2268", (0, 2)), ("2272", (1, 3))):
        for h in hours:
            at = T0 + dt.timedelta(hours=h)
            runs.append((at, term, "site", "delta", "full", "", "", [], 1, 1, None, True))
            items.append((*snap(0, "s1", w=h, at=at, term_id=term), at, "delta"))
    from turnwise.schema import RUNS

    schema = SNAPSHOT.__class__(list(SNAPSHOT.fields)).add("run_started_at", "timestamp").add("kind", "string")
    out = st.rebuild_panel(spark.createDataFrame(items, schema), spark.createDataFrame(runs, RUNS))
    assert sorted((r["term_id"], r["waitlist_count"]) for r in out.collect()) == [("2268", 0), ("2268", 2), ("2272", 1), ("2272", 3)]
    flows = fl.interval_flows(out)
    assert sorted((r["term_id"], r["interval_min"]) for r in flows.collect()) == [("2268", 120.0), ("2272", 120.0)]


def test_payload_files_are_not_a_folder_each(spark, tmp_path):
    from turnwise.sources import history as hs

    rows = [(f"{i}/{k}" if i % 7 else f"{i}-{k}", i, k) for i in range(200) for k in ("a", "b")]
    payloads = spark.createDataFrame(rows, "key string, s long, k string").select(
        "key", F.lit("2268").alias("term_id"), F.struct(F.col("s").cast("string").alias("sectionId"), F.array(F.struct(
            F.lit("2026-01-01T00:00:00Z").alias("startTime"), F.lit(None).cast("string").alias("status"),
            F.when(F.col("k") == "a", "5").otherwise("6").alias("enrolledCount"))).alias("history")).alias("enrollment"))
    assert hs.write_payloads(payloads, str(tmp_path)) == 400
    files = [p for p in tmp_path.rglob("*") if p.is_file()]
    assert len([p for p in files if p.name.endswith(".json.gz")]) == 400
    assert len([p for p in tmp_path.rglob("*") if p.is_dir()]) <= hs.FOLDERS
    found = hs.first_payloads(hs.read_payloads(spark, f"{tmp_path}/*"))
    assert {(r["section_id"], r["enrolled_count"], r["status"]) for r in hs.segments(found).collect()} == {(str(i), 5, "") for i in range(200)}
    # the files are read by one scan
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_flow_rows_go_on_from_the_state():
    from turnwise.streaming import incremental as inc

    row = lambda at, seen=True, gone=False: [at, at, 100, 1, 20, None, None, seen, gone]
    rows = [row(1), row(2, seen=None), row(3), row(4), row(5, seen=False, gone=True), row(6)]
    state, pairs = inc.flow_rows(None, rows)
    assert [(p[0], p[7]) for p in pairs] == [(1, 3), (3, 4)] and state == (4, 4, 100, 1, 20, None, None, True)
    assert inc.flow_rows(state, [row(7)]) == (state, [])
    first, a = inc.flow_rows(None, rows[:2])
    second, z = inc.flow_rows(first, rows[2:])
    assert a + z == pairs and second == state
    assert inc.flow_rows(None, [])[0] == (*[None] * 7, False)


def test_flow_replay_makes_no_frame_per_section(spark, tmp_path):
    from turnwise.plans import queries_sources as qs

    events = [(i, dt.datetime(2024, 1, 1 + i % 31, i % 24), i % 5 if i % 9 else None, "error" if i % 6 == 0 else "view") for i in range(300)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    out = qs.flow_replay(spark, str(tmp_path))
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    from turnwise.operators.flows import interval_flows
    from turnwise.plans import bindings as b
    want = interval_flows(b.panel_from_events(spark, str(tmp_path)).where("section_id IS NOT NULL"))
    got = out.where("section_id IS NOT NULL")
    assert sorted(map(tuple, got.select("section_id", "t0", "t1", "rule").collect())) == sorted(
        map(tuple, want.select("section_id", b.us("t0"), b.us("t1"), "rule").collect()))


def test_wide_crossings_read_the_segments_once(spark, tmp_path, monkeypatch):
    from turnwise.plans import bindings as b
    from turnwise.plans import queries_flows as qf

    stamp = dt.datetime(2024, 1, 1)
    line = [(k % 20, k, 1 + k % 7, float(5 + k % 9), 10.0 + k, stamp + dt.timedelta(days=k * 3)) for k in range(60)]
    spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                "l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, k % 4) for k in range(20)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    out = qf.wide_crossing_censoring(spark, str(tmp_path))
    assert "l_shipdate" not in out._jdf.queryExecution().optimizedPlan().toString()
    seg = b.history_segments(spark, str(tmp_path))
    from turnwise.operators import history as hi
    want = hi.history_flows(hi.history_panel(seg), hi.crossings(seg)).select("section_id", b.us("t0"), "rule", "censored")
    assert out.count() > 0 and sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
