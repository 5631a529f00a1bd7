"""Queries through the file formats and the streaming steps.

A source query writes the given tables in a format that the library reads (payload files, an event log, catalogs, pages,
feeds, a snapshot store, footers), reads the files with the real reader and returns what came back. A replay feeds a
streaming step its rows in two halves with only the step's state between them; its SQL is that of the batch form.
"""
from __future__ import annotations

import datetime as dt
import json
import uuid

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from turnwise.functions.scalars import parse_stamp, subject_slug, term_id_of
from turnwise.operators import activity as ac
from turnwise.operators import store as st
from turnwise.operators import tables as tb
from turnwise.operators.flows import flows_of_pairs
from turnwise.plans import bindings as b
from turnwise.plans import sql as s
from turnwise.plans.queries_flows import _flow_columns, _FLOW_LIST
from turnwise.plans.registry import query
from turnwise.schema import COUNT_FIELDS, RUNS, TOMBSTONE
from turnwise.session import open_file_system, scratch_dir
from turnwise.sources import catalog as ct
from turnwise.sources import event_log, history, parsers, snapshots
from turnwise.sources.calendar import key_dates as calendar_days
from turnwise.streaming import incremental as inc

FETCHED = dt.datetime(2026, 9, 1, tzinfo=dt.timezone.utc)
txt = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
MINUTE = "yyyy-MM-dd'T'HH:mm'Z'"


def _folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _events(spark, d):
    return b.table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))


# ----------------------------------------------------------------------------- histories


@query("history_payloads", """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)-1 AS ordinal, epoch_us(ts) AS a,
   epoch_us(ts)+(event_id%9-2)*3600000000 AS z FROM events)
 SELECT CAST(user_id AS VARCHAR) AS section_id, CAST(ordinal AS INT) AS ordinal, least(a,z) AS start_us, greatest(a,z) AS end_us, CAST(95+event_id%7 AS INT) AS enrolled_count,
   CAST(CASE WHEN event_id%4=0 THEN NULL ELSE event_id%9 END AS INT) AS waitlist_count, CASE WHEN event_id%3=0 THEN '' ELSE 'O' END AS status FROM e""")
def history_payloads(spark, d):
    """One gzip JSON file per section (the user), some sections twice under a later key; the first one is expanded."""
    n = F.col("event_id")
    later = F.timestamp_micros(F.unix_micros("at") + (n % 9 - 2) * 3_600_000_000)
    stamp = lambda c: F.date_format(c, ISO)
    segment = F.struct(n.alias("o"), F.struct(
        stamp(F.col("at")).alias("startTime"), stamp(later).alias("endTime"), F.when(n % 3 != 0, "O").alias("status"), txt(95 + n % 7).alias("enrolledCount"),
        F.when(n % 4 == 0, "?").otherwise(txt(n % 9)).alias("waitlistedCount"), F.lit("100").alias("maxEnroll"), F.lit("20").alias("maxWaitlist")).alias("s"))
    # a section's events, a few dozen rows
    rows = _events(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(segment)), lambda x: x["s"]).alias("history"))
    keys = F.when(F.col("user_id") % 10 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a")))
    rows = rows.withColumn("k", F.explode(keys))
    payload = rows.select(
        F.concat_ws("-", txt("user_id"), "k").alias("key"), F.lit("2268").alias("term_id"),
        F.struct(txt("user_id").alias("sectionId"), F.when(F.col("k") == "b", F.slice("history", 1, 1)).otherwise(F.col("history")).alias("history")).alias("enrollment"))
    folder = _folder(spark, "history")
    history.write_payloads(payload, folder)
    found = history.segments(history.first_payloads(history.read_payloads(spark, f"{folder}/*")))
    return found.select("section_id", "ordinal", b.us("start", "start_us"), b.us("end", "end_us"), "enrolled_count", "waitlist_count", "status")


_LOG = """lg AS (SELECT event_id, event_id//40 AS k, date_trunc('minute', ts) AS a FROM events WHERE event_id%40=0),
 lines AS (SELECT k, a, CASE WHEN k%3=0 THEN NULL ELSE a+to_hours(CAST(k%7 AS INT)) END AS z, CASE k%6 WHEN 1 THEN 'schema' WHEN 4 THEN 'note' WHEN 5 THEN 'correction' ELSE 'outage' END AS kind,
   CASE WHEN k%2=0 THEN '2268' END AS term FROM lg)"""


@query("event_log_outages", f"""WITH {_LOG}, fix AS (SELECT p.a AS start, arg_min(p.a+INTERVAL 9 HOUR, c.k) AS closed FROM lines c JOIN lines p ON p.k=c.k-1 WHERE c.kind='correction' GROUP BY 1)
 SELECT epoch_us(l.a) AS start_us, epoch_us(coalesce(l.z, fix.closed)) AS end_us, l.kind, l.term AS term_id, 'row '||k AS note FROM lines l LEFT JOIN fix ON fix.start=l.a WHERE kind IN ('outage','schema')""")
def event_log_outages(spark, d):
    """A log line for every fortieth event, every sixth one a correction of the line before it."""
    n = F.col("event_id")
    rows = _events(spark, d).where(n % 40 == 0).select((n / 40).cast("long").alias("k"), F.date_trunc("minute", "at").alias("a"))
    before = rows.select((F.col("k") + 1).alias("k"), F.col("a").alias("named"))
    rows = rows.join(before, "k", "left").withColumns({
        "kind": F.when(F.col("k") % 6 == 1, "schema").when(F.col("k") % 6 == 4, "note").when(F.col("k") % 6 == 5, "correction").otherwise("outage"),
        "z": F.timestamp_micros(F.unix_micros("a") + F.col("k") % 7 * 3_600_000_000)})
    stamp = lambda c: F.date_format(c, MINUTE)
    note = F.when(F.col("kind") == "correction", F.concat(
        F.lit("the row that starts "), stamp("named"), F.lit(": end_utc is "), stamp(F.col("named") + F.expr("INTERVAL 9 HOUR")))).otherwise(F.concat(F.lit("row "), txt("k")))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", stamp("a"), F.when(F.col("k") % 3 == 0, "-").otherwise(stamp("z")), "kind",
                                             F.when(F.col("k") % 2 == 0, "2268").otherwise("-"), F.lit("all"), note, F.lit("me")), F.lit(" |"))
    folder = _folder(spark, "log")
    rows.select("k", line.alias("value")).coalesce(1).sortWithinPartitions("k").select("value").write.text(folder)  # the log is one file, in order
    found = event_log.outages(event_log.read_log(spark, folder))
    return found.select(b.us("start", "start_us"), b.us("end", "end_us"), "kind", "term_id", "note")


# ------------------------------------------------------------------ catalogs, pages, feeds


@query("catalog_files", """SELECT CASE WHEN p_size%3=0 THEN '2272' WHEN p_size%3=1 THEN '2265' ELSE '22681' END AS catalog_term_id, CAST(p_partkey AS VARCHAR) AS section_id, p_name AS title,
  CAST(CASE WHEN p_partkey%4=0 THEN 404 ELSE 200 END AS INT) AS last_status, CASE WHEN p_partkey%5=0 THEN p_partkey END AS node_id FROM part""")
def catalog_files(spark, d):
    """Catalog files by part size: with a term of their own, with one in their entries, or with the folder's."""
    n, size = F.col("p_partkey"), F.col("p_size")
    entry = F.struct(
        n.alias("o"), F.struct(txt(n).alias("section_id"), F.col("p_name").alias("title"), F.when(n % 4 == 0, 404).otherwise(200).alias("last_status"),
                               F.when(n % 5 == 0, n).alias("node_id"), F.when(size % 3 == 1, "2265").alias("term_id")).alias("s"))
    files = b.table(spark, d, "part").groupBy("p_size").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["s"]).alias("sections"))
    files = files.select((F.lit(22680) + size % 3 - F.when(size % 3 == 2, 1).otherwise(0)).alias("folder"), size.alias("file"),
                         F.when(size % 3 == 0, "2272").alias("term_id"), "sections")
    folder = _folder(spark, "catalog")
    for kind in ("22680", "22681"):  # a folder a term; the last ones have neither of the other two
        files.where(F.col("folder") == int(kind)).drop("folder").repartition("file").write.option("maxRecordsPerFile", 1).json(f"{folder}/{kind}")
    found = ct.read_catalog(spark, f"{folder}/*")
    return found.select("catalog_term_id", "section_id", "title", "last_status", "node_id")


@query("catalog_sections", """WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id%60, event_id%4 ORDER BY CAST(event_id AS VARCHAR)) AS nth FROM events WHERE event_id%6<>0 AND event_type<>'error')
 SELECT 'bt:EL'||(user_id%60)||':'||(user_id%60)||':'||(event_id%4) AS section_id, 'EL'||(user_id%60)||' '||(user_id%60) AS course_key, CAST(95+event_id%7 AS INT) AS enrolled_count, '' AS reject FROM f WHERE nth=1
 UNION ALL SELECT 'bt:EL'||(user_id%60)||':'||(user_id%60)||':'||(event_id%4), 'EL'||(user_id%60)||' '||(user_id%60), NULL, 'enrolled_count' FROM events WHERE event_id%6<>0 AND event_type='error'""")
def catalog_sections(spark, d):
    """A catalog response per event: unobserved classes are skipped, unread ones rejected, the first of an id is kept."""
    n, u = F.col("event_id"), txt(F.col("user_id") % 60)
    latest = F.struct(F.lit("O").alias("status"), F.when(F.col("event_type") != "error", txt(95 + n % 7)).alias("enrolledCount"), F.lit("100").alias("maxEnroll"),
                      F.lit("1").alias("waitlistedCount"), F.lit("20").alias("maxWaitlist"))
    entry = F.struct(F.concat(F.lit("E L"), u).alias("subject"), F.concat(u, F.lit(" ")).alias("courseNumber"), txt(n % 4).alias("number"),
                     F.struct(F.lit("LEC").alias("component"), F.struct(F.when(n % 6 != 0, latest).alias("latest")).alias("enrollment")).alias("primarySection"))
    raw = _events(spark, d).select(txt(n).alias("url"), F.to_json(F.struct(F.struct(F.array(entry).alias("catalog")).alias("data"))).alias("body"))
    rows = parsers.parse_catalog(raw, FETCHED, "2268", "catalog")
    return rows.select("section_id", "course_key", "enrolled_count", F.array_join("reject", ",").alias("reject"))


@query("section_page_rows", """SELECT event_id, CASE WHEN event_id%5<>0 THEN CAST(user_id AS VARCHAR) END AS section_id, 'S'||(user_id%7)||' '||(user_id%60)||'A' AS course_key,
  CASE WHEN event_id%3=0 THEN '2272' ELSE '2268' END AS term_id, '/content/e-'||event_id AS url_path, CASE WHEN event_id%2=0 THEN event_id END AS node_id, 'LEC' AS component,
  CASE WHEN event_id%5<>0 THEN CAST(95+event_id%7 AS INT) END AS enrolled_count,
  CASE WHEN event_id%5=0 THEN 'settings,section_id,enrolled_count,enroll_capacity,waitlist_count,waitlist_capacity,status' ELSE '' END AS reject FROM events""")
def section_page_rows(spark, d):
    """Section pages written from the events: identity in title and link, term in an attribute or the title, counts in the
    embedded settings, which every fifth page lacks."""
    n, u = F.col("event_id"), F.col("user_id")
    counts = F.struct(F.struct(F.lit("O").alias("code")).alias("status"), txt(95 + n % 7).alias("enrolledCount"), F.lit("100").alias("maxEnroll"),
                      F.lit("2").alias("waitlistedCount"), F.lit("20").alias("maxWaitlist"))
    blob = F.to_json(F.struct(F.struct(F.struct(F.struct(txt(u).alias("id"), counts.alias("enrollmentStatus")).alias("available")).alias("enrollment")).alias("ucb")))
    title = F.concat(F.when(n % 3 == 0, "2027 Spring ").otherwise("2026 Fall "), F.lit("s"), txt(u % 7), F.lit(" "), txt(u % 60), F.lit("a 001 lec 002 | Search"))
    html = F.concat(
        F.lit("<html><head><title>"), title, F.lit('</title><link rel="canonical" href="https://x.example/content/e-'), txt(n), F.lit('">'),
        F.when(n % 5 != 0, F.concat(F.lit('<script type="application/json" data-drupal-selector="drupal-settings-json">'), blob, F.lit("</script>"))).otherwise(""),
        F.lit("</head><body"), F.when(n % 6 == 1, ' data-term="2268"').otherwise(""), F.when(n % 2 == 0, F.concat(F.lit(" data-history-node-id='"), txt(n), F.lit("'"))).otherwise(""),
        F.lit("></body></html>"))
    rows = parsers.parse_section_pages(_events(spark, d).select(txt(n).alias("url"), html.alias("html")), FETCHED, "site")
    return rows.select(F.col("url").cast("long").alias("event_id"), "section_id", "course_key", "term_id", "url_path", "node_id", "component",
                       "enrolled_count", F.array_join("reject", ",").alias("reject"))


@query("feed_items", """SELECT CAST(p_size AS VARCHAR) AS url, p_partkey AS node_id, '/content/'||p_partkey AS url_path, p_name AS title FROM part WHERE p_partkey%9<>0 AND p_partkey%7<>0""")
def feed_items(spark, d):
    """A feed per part size; items without a numeric guid or a content link are skipped."""
    n = F.col("p_partkey")
    link = F.concat(F.when(n % 9 == 0, "https://x.example/about/").otherwise("https://x.example/content/"), txt(n))
    item = F.concat(F.lit("<item><title><![CDATA[ "), F.col("p_name"), F.lit(" ]]></title><link>"), link, F.lit("</link><guid isPermaLink='false'>"),
                    F.when(n % 7 == 0, "none").otherwise(F.concat(txt(n), F.lit(" at x"))), F.lit("</guid></item>"))
    raw = b.table(spark, d, "part").groupBy(txt("p_size").alias("url")).agg(F.array_join(F.collect_list(item), "\n").alias("_items"))
    raw = raw.select("url", F.concat(F.lit("<rss><channel>"), "_items", F.lit("</channel></rss>")).alias("body"))
    return parsers.parse_feed(raw)


# ---------------------------------------------------------------------------------- store


@query("stored_rows", f"""WITH {s.RUN_ROWS} SELECT section_id, epoch_us(run_at) AS run_started_at, kind, CAST(e AS INT) AS enrolled_count, CAST(w AS INT) AS waitlist_count FROM srows
 WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'""")
def stored_rows(spark, d):
    """The store's rows of three days, of which only those days' files are read."""
    folder = _folder(spark, "store")
    b.snapshot_rows(spark, d).drop("run_no").write.partitionBy("date").parquet(f"{folder}/rows")
    rows = snapshots.read_rows(spark, folder, dt.date(2024, 1, 10), dt.date(2024, 1, 12))
    return rows.select("section_id", b.us("run_started_at"), "kind", "enrolled_count", "waitlist_count")


@query("footer_runs", f"""WITH {s.RUN_ROWS} SELECT epoch_us(run_at) AS run_started_at, kind, scope, source, CAST(n_observed AS INT) AS n_observed, complete FROM runs""")
def footer_runs(spark, d):
    """A Parquet file per run with the run in its footer, of which only the footers are read."""
    folder = _folder(spark, "footers")

    def write(frames):
        fs, local = open_file_system(folder)
        fs.create_dir(local, recursive=True)
        for frame in frames:
            for run in frame["run"]:
                table = pa.table({"n": pa.array([1, 2, 3])}).replace_schema_metadata({"metadata": run})
                with fs.open_output_stream(f"{local}/{json.loads(run)['run_no']}-{uuid.uuid4().hex}.parquet", compression=None) as out:
                    pq.write_table(table, out)
            yield pd.DataFrame({"n": [len(frame)]})

    runs = b.run_table(spark, d)
    stamped = F.date_format("run_started_at", ISO)
    body = F.to_json(F.struct("run_no", stamped.alias("run_started_at"), *[c for c in RUNS.fieldNames() if c in runs.columns and c != "run_started_at"]))
    runs.select(body.alias("run")).mapInPandas(write, "n long").agg(F.sum("n")).collect()  # one number
    back = snapshots.import_footers(spark, folder)
    return back.select(b.us("run_started_at"), "kind", "scope", "source", "n_observed", "complete")


@query("panel_identity", f"WITH {s.PANEL}, {s.IDENTITY} SELECT subject, count(*) AS rows, count(DISTINCT section_id) AS sections, CAST(sum(e) AS BIGINT) AS enrolled FROM panel JOIN ident USING (section_id) GROUP BY 1")
def panel_identity(spark, d):
    rows = st.with_identity(b.panel_from_events(spark, d), b.identity_from_events(spark, d))
    return rows.groupBy("subject").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("section_id").alias("sections"), F.sum("enrolled_count").alias("enrolled"))


# ------------------------------------------------------------------------ small expressions


@query("term_ids", """SELECT event_id, CASE WHEN event_id%11=0 THEN NULL ELSE '2'||lpad(CAST(event_id%100 AS VARCHAR),2,'0')||CASE event_id%3 WHEN 0 THEN '2' WHEN 1 THEN '5' ELSE '8' END END AS term_id FROM events""")
def term_ids(spark, d):
    n = F.col("event_id")
    season = F.when(n % 3 == 0, " spring ").when(n % 3 == 1, "Summer ").otherwise("FALL  ")
    name = F.when(n % 11 == 0, "Winter 2026").otherwise(F.concat(season, txt(2000 + n % 100)))
    return _events(spark, d).select("event_id", term_id_of(name).alias("term_id"))


@query("subject_slugs", """SELECT p_partkey, regexp_replace(regexp_replace(upper(' '||p_name||' & '||p_brand||'.'), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part""")
def subject_slugs(spark, d):
    return b.table(spark, d, "part").select("p_partkey", subject_slug(F.concat(F.lit(" "), "p_name", F.lit(" & "), "p_brand", F.lit("."))).alias("slug"))


@query("log_stamps", """SELECT event_id, CASE event_id%4 WHEN 0 THEN epoch_us(date_trunc('day', ts)) WHEN 1 THEN epoch_us(date_trunc('minute', ts)) END AS at FROM events""")
def log_stamps(spark, d):
    n = F.col("event_id")
    text = F.when(n % 4 == 0, F.date_format("at", "yyyy-MM-dd")).when(n % 4 == 1, F.date_format("at", MINUTE)).when(
        n % 4 == 2, F.date_format("at", "yyyy-MM-dd HH:mm")).otherwise(F.concat(F.date_format("at", "yyyy"), F.lit("-13-40")))
    return _events(spark, d).select("event_id", b.us(parse_stamp(F.concat(F.lit(" "), text)), "at"))


@query("days_to_dates", """WITH d(ordinal, key, day) AS (VALUES (0,'phase1_start',DATE '2026-04-13'),(1,'phase2_start',DATE '2026-07-20'),(2,'adjustment_start',DATE '2026-08-17'),
   (3,'instruction_start',DATE '2026-08-26'),(4,'last_auto_waitlist',DATE '2026-09-11'),(5,'add_drop_deadline',DATE '2026-09-16')),
 n AS (SELECT max(ts)+INTERVAL 950 DAY AS now FROM events)
 SELECT CAST(ordinal AS INT) AS ordinal, key, round((epoch_us(CAST(day AS TIMESTAMP))-epoch_us(date_trunc('second', now)))/86400000000.0,6) AS days_left,
   (epoch_us(CAST(day AS TIMESTAMP))-epoch_us(date_trunc('second', now)))/86400000000.0 < -1 AS past FROM d, n""")
def days_to_dates(spark, d):
    """Counted from the last event, moved into the term."""
    last = _events(spark, d).agg(F.date_format(F.max("at") + F.expr("INTERVAL 950 DAY"), "yyyy-MM-dd HH:mm:ss").alias("now")).first()["now"]
    out = calendar_days(spark, b.CALENDAR, dt.datetime.strptime(last, "%Y-%m-%d %H:%M:%S"))
    return out.select("ordinal", "key", F.round("days_left", 6).alias("days_left"), "past")


@query("pattern_digests", "SELECT p_partkey, sha256(p_name) AS sha FROM part")
def pattern_digests(spark, d):
    return b.table(spark, d, "part").select("p_partkey", ac.pattern_sha(F.col("p_name")).alias("sha"))


@query("display_order", f"""WITH {s.COHORT}, c AS (SELECT 'level' AS kind, level AS key, bucket, count(*) AS n FROM cohort GROUP BY ALL UNION ALL SELECT 'phase', phase, bucket, count(*) FROM cohort GROUP BY ALL)
 SELECT kind, key, bucket, n, CAST(CASE kind WHEN 'level' THEN list_position(['lower','upper','grad'], key) ELSE list_position(['before','phase1','between','phase2','adjustment','instruction','after'], key) END-1 AS INT) AS key_rank,
   CAST(list_position(['1-5','6-15','16-40','41+'], bucket)-1 AS INT) AS bucket_rank FROM c""")
def display_order(spark, d):
    c = b.cohort_from_lineitem(spark, d)
    of = lambda kind: c.groupBy(F.lit(kind).alias("kind"), F.col(kind).alias("key"), F.col("position_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    out = tb.ordered_cells(of("level").unionByName(of("phase")))
    return out.select("kind", "key", "bucket", "n", F.col("key_rank").cast("int").alias("key_rank"), F.col("bucket_rank").cast("int").alias("bucket_rank"))


# ------------------------------------------------------------------------------- replays

HALF = dt.datetime(2024, 1, 16, tzinfo=dt.timezone.utc)
_HALF_US = int(HALF.timestamp() * 1_000_000)


def _in_halves(frame: pd.DataFrame, step) -> pd.DataFrame:
    """The outputs of ``step`` on a key's rows before and after ``HALF``, with its state alone between them."""
    frame = frame.sort_values("run_us", kind="stable", ignore_index=True)
    state, out = None, []
    for half in (frame[frame["run_us"] < _HALF_US], frame[frame["run_us"] >= _HALF_US]):
        if len(half):
            state, rows = step(state, half.reset_index(drop=True))
            out.append(rows)
    full = [rows for rows in out if len(rows)]
    return pd.concat(full, ignore_index=True) if full else out[0]


@query("delta_replay", f"""WITH {s.PANEL}, w AS (SELECT *, lag(event_id) OVER x AS before, lag(e) OVER x AS e0, lag(c) OVER x AS c0, lag(w) OVER x AS w0, lag(res) OVER x AS r0, lag(opn) OVER x AS o0, lag(gs) OVER x AS g0
   FROM panel WINDOW x AS (PARTITION BY section_id ORDER BY ts))
 SELECT section_id, epoch_us(ts) AS run_started_at, CAST(e AS INT) AS enrolled_count, CAST(w AS INT) AS waitlist_count FROM w
 WHERE before IS NULL OR e IS DISTINCT FROM e0 OR c IS DISTINCT FROM c0 OR w IS DISTINCT FROM w0 OR res IS DISTINCT FROM r0 OR opn IS DISTINCT FROM o0 OR gs IS DISTINCT FROM g0""")
def delta_replay(spark, d):
    """The delta stream's step on every section, in two halves."""
    rows = b.panel_from_events(spark, d).select("section_id", F.unix_micros("run_started_at").alias("run_us"), *COUNT_FIELDS)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _in_halves(frame, inc.delta_step).assign(section_id=key[0])[["section_id", *inc._ROW_NAMES]]

    out = rows.groupBy("section_id").applyInPandas(run, f"section_id string, {inc._ROW}")
    return out.select("section_id", F.col("run_us").alias("run_started_at"), "enrolled_count", "waitlist_count")


@query("flow_replay", f"WITH {s.FLOWS.replace('interval_min>3000 AS censored', 'false AS censored')} SELECT {_FLOW_LIST} FROM flows")
def flow_replay(spark, d):
    """The flow stream's step on every section, in two halves, and the rules that both forms share."""
    panel = b.panel_from_events(spark, d)
    gone = F.coalesce(F.col("section_status") == TOMBSTONE, F.lit(False))
    names, following = inc._OBS_NAMES, inc._NEXT
    rows = panel.where(F.col("observed") | gone).select(
        "section_id", "term_id", F.unix_micros("run_started_at").alias("run_us"), *names[1:], F.col("observed").alias("seen"), gone.alias("gone"))

    keys = ["section_id", "term_id"]
    schema = f"section_id string, term_id string, {inc._OBSERVED}, " + ", ".join(
        f"{n} {'long' if n == 'next_run_us' else 'int'}" for n in following)
    types = [pa.string(), pa.string()] + [pa.int64() if n in ("run_us", "next_run_us") else pa.int32() for n in (*names, *following)]

    def run(batches):
        # rows come in order; a half ends where the key or the half changes, and only the state goes on to the next
        at, state, held = None, None, []
        for batch in batches:
            out = []
            for key0, key1, late, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key0, key1, late) != at:
                    if held:
                        state, found = inc.flow_rows(state, held)
                        out += [(*at[:2], *pair) for pair in found]
                    if at is None or (key0, key1) != at[:2]:
                        state = None
                    at, held = (key0, key1, late), []
                held.append(row)
            yield packed(out)
        if held:
            yield packed([(*at[:2], *pair) for pair in inc.flow_rows(state, held)[1]])

    def packed(out):
        columns = zip(*out) if out else [[] for _ in types]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[*keys, *names, *following])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    halves = rows.where("run_us IS NOT NULL").withColumn("late", F.col("run_us") >= _HALF_US)
    halves = halves.select(*keys, "late", *names, "seen", "gone").repartition(tasks, *keys).sortWithinPartitions(*keys, "run_us")
    pairs = halves.mapInArrow(run, schema)
    pairs = pairs.withColumn("run_started_at", F.timestamp_micros("run_us")).withColumn("_next", F.struct(
        F.timestamp_micros("next_run_us").alias("run_started_at"), *[F.col(f"next_{c}").alias(c) for c in names[1:5]]))
    return _flow_columns(flows_of_pairs(pairs))


@query("kind_replay", f"""WITH {s.RUN_ROWS} SELECT epoch_us(run_at) AS run_started_at, CASE WHEN run_at=min(run_at) OVER (PARTITION BY CAST(run_at AS DATE)) THEN 'baseline' ELSE 'delta' END AS decided FROM runs""")
def kind_replay(spark, d):
    """Runs decided in two halves, the second given what the first wrote."""
    runs = b.run_table(spark, d).select("term_id", "run_started_at")
    at = F.lit(HALF).cast("timestamp") + F.expr("INTERVAL 13 HOUR")
    none = spark.createDataFrame([], "term_id string, run_started_at timestamp, decided string")
    first = inc.decide_kinds(runs.where(F.col("run_started_at") < at), none)
    written = first.select("term_id", "run_started_at", "decided")
    second = inc.decide_kinds(runs, written)  # runs written before are left out
    return written.unionByName(second.select(*written.columns)).select(b.us("run_started_at"), "decided")
