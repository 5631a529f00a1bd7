"""Queries over the capture side: flows, store, history, quality, walks."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.scalars import days_to_instruction, horizon_days, phase_at
from turnwise.operators import cohort as co
from turnwise.operators import flows as fl
from turnwise.operators import history as hi
from turnwise.operators import quality as qu
from turnwise.operators import store as st
from turnwise.operators.scans import plan_splits
from turnwise.plans import bindings as b
from turnwise.plans import sql as s
from turnwise.plans.registry import query
from turnwise.schema import FLOW_NAMES, POSITIONS, SCENARIOS
from turnwise.session import materialize

r6 = lambda c, name=None: F.round(c, 6).alias(name or c)



def micros(column: str, scale: int, name: str):
    """A duration as whole microseconds, free of rounding at a boundary."""
    return F.round(F.col(column) * scale).cast("long").alias(name)


def flows(spark: SparkSession, d: str) -> DataFrame:
    return fl.interval_flows(b.panel_from_events(spark, d), max_interval_min=3000)


def _flow_columns(df: DataFrame) -> DataFrame:
    plain = ["section_id", "d_enrolled", "d_waitlist", "d_capacity", "d_wl_capacity", "enrolled0", "capacity0",
             "waitlist0", "reserved0", "open_reserved0", "full0", *FLOW_NAMES, "expansion", "ambiguous", "censored", "rule"]
    return df.select(*plain, b.us("t0"), b.us("t1"), r6("interval_min"))


_FLOW_LIST = """section_id, d_enrolled, d_waitlist, d_capacity, d_wl_capacity, enrolled0, capacity0, waitlist0, reserved0,
  open_reserved0, full0, admits, wl_joins, wl_drops, enr_joins, enr_drops, expansion, ambiguous, censored, rule,
  epoch_us(t0) AS t0, epoch_us(t1) AS t1, round(interval_min, 6) AS interval_min"""


@query("interval_flows", f"WITH {s.FLOWS} SELECT {_FLOW_LIST} FROM flows")
def interval_flows(spark, d):
    return _flow_columns(flows(spark, d))


@query("flow_summary", f"""WITH {s.FLOWS} SELECT count(DISTINCT section_id) AS sections, count(*) AS intervals,
  round(avg(CAST(ambiguous AS INT)),4) AS share_ambiguous, round(avg(CAST(censored AS INT)),4) AS share_censored,
  round(quantile_cont(interval_min,0.5),1) AS median_interval_min, CAST(sum(admits) AS BIGINT) AS admits,
  CAST(sum(wl_joins) AS BIGINT) AS wl_joins, CAST(sum(wl_drops) AS BIGINT) AS wl_drops,
  CAST(sum(enr_joins) AS BIGINT) AS enr_joins, CAST(sum(enr_drops) AS BIGINT) AS enr_drops FROM flows""")
def flow_summary(spark, d):
    return fl.flow_summary(flows(spark, d))


@query("daily_flows", f"""WITH {s.FLOWS} SELECT CAST(CAST(t1 AS DATE) AS VARCHAR) AS date, CAST(sum(admits) AS BIGINT) AS admits,
  CAST(sum(wl_joins) AS BIGINT) AS joins, CAST(sum(wl_drops) AS BIGINT) AS drops, count(*) AS intervals,
  round(avg(CAST(censored AS INT)),3) AS share_censored FROM flows GROUP BY 1""")
def daily_flows(spark, d):
    return fl.daily_flows(flows(spark, d)).withColumn("date", F.col("date").cast("string"))


@query("exit_tally", f"""WITH {s.FLOWS} SELECT CAST(sum(a) AS BIGINT) AS admitted, CAST(sum(dr) AS BIGINT) AS dropped,
  CAST(sum(greatest(wait,0)) AS BIGINT) AS still_waiting FROM (SELECT section_id, sum(admits) AS a, sum(wl_drops) AS dr,
  arg_max(waitlist0+d_waitlist, t1) AS wait FROM flows GROUP BY 1)""")
def exit_tally(spark, d):
    return fl.exit_tally(flows(spark, d))


_CUM = ", ".join(f"CAST(sum({c}) OVER w AS BIGINT) AS cum_{c}" for c in FLOW_NAMES)


@query("cumulative_flows", f"WITH {s.FLOWS} SELECT section_id, epoch_us(t0) AS t0, {_CUM} FROM flows WINDOW w AS (PARTITION BY section_id ORDER BY t0)")
def cumulative_flows(spark, d):
    return fl.cumulative_flows(flows(spark, d)).select("section_id", b.us("t0"), *[f"cum_{c}" for c in FLOW_NAMES])


OUTAGES = [
    ("2024-01-05 03:00:00", "2024-01-05 14:30:00", "outage", "2268"),
    ("2024-01-12 00:00:00", None, "source_switch", None),
    ("2024-01-18 06:00:00", "2024-01-19 06:00:00", "outage", "2272"),
    ("2024-01-29 12:00:00", None, "outage", None),
]
_OUTAGE_SQL = ", ".join("(" + ", ".join(
    [f"TIMESTAMP '{a}'", "NULL" if e is None else f"TIMESTAMP '{e}'", f"'{k}'", "NULL" if t is None else f"'{t}'"]) + ")"
    for a, e, k, t in OUTAGES)


_OUTAGE_ANSWER = f"""WITH {s.FLOWS}, o(a, z, kind, term) AS (VALUES {_OUTAGE_SQL})
 SELECT section_id, epoch_us(t0) AS t0, EXISTS (SELECT 1 FROM o WHERE (term IS NULL OR term='2268') AND
   CASE WHEN z IS NULL AND kind<>'outage' THEN t0<=a AND a<=t1 ELSE t1>=a AND (z IS NULL OR t0<z) END) AS censored FROM flows"""


def _outage_log(spark):
    log = spark.createDataFrame(OUTAGES, "start string, end string, kind string, term_id string")
    return log.withColumns({"start": F.col("start").cast("timestamp"), "end": F.col("end").cast("timestamp")})


@query("outage_censoring", _OUTAGE_ANSWER)
def outage_censoring(spark, d):
    out = fl.interval_flows(b.panel_from_events(spark, d), outages=_outage_log(spark))
    return out.select("section_id", b.us("t0"), "censored")


@query("outage_censoring_by_day", _OUTAGE_ANSWER)
def outage_censoring_by_day(spark, d):
    rows = fl.interval_flows(b.panel_from_events(spark, d)).drop("censored")
    out = fl.attach_outages(rows, _outage_log(spark), inline_limit=0)
    return out.select("section_id", b.us("t0"), F.col("_outage").alias("censored"))


@query("tombstone_cutoff", f"WITH {s.PANEL}, {s.GONE}, {s.SERIES} SELECT section_id, count(*) AS observed, epoch_us(max(ts)) AS last_at FROM series GROUP BY 1")
def tombstone_cutoff(spark, d):
    rows = fl.observed_series(b.panel_from_events(spark, d))
    return rows.groupBy("section_id").agg(F.count(F.lit(1)).alias("observed"),
                                          F.unix_micros(F.max("run_started_at")).alias("last_at"))


# ------------------------------------------------------------------------------ history


@query("history_to_panel", f"WITH {s.SEGMENTS} SELECT section_id, epoch_us(ts) AS run_started_at, e AS enrolled_count, w AS waitlist_count FROM hist")
def history_to_panel(spark, d):
    rows = hi.history_panel(b.history_segments(spark, d))
    return rows.select("section_id", b.us("run_started_at"), F.col("enrolled_count").cast("long").alias("enrolled_count"),
                       F.col("waitlist_count").cast("long").alias("waitlist_count"))


@query("history_crossings", f"WITH {s.SEGMENTS} SELECT section_id, epoch_us(t0) AS t0, epoch_us(t1) AS t1, round(minutes,6) AS minutes, wide FROM crossing")
def history_crossings(spark, d):
    return hi.crossings(b.history_segments(spark, d)).select("section_id", b.us("t0"), b.us("t1"), r6("minutes"), "wide")


@query("crossing_quantiles", f"""WITH {s.SEGMENTS} SELECT count(*) AS crossings, CAST(sum(CAST(wide AS INT)) AS BIGINT) AS crossings_wide,
  round(quantile_cont(minutes,0.5),1) AS q50, round(quantile_cont(minutes,0.75),1) AS q75, round(quantile_cont(minutes,0.9),1) AS q90,
  round(quantile_cont(minutes,0.99),1) AS q99, round(avg(CAST(minutes>45 AS INT)),4) AS share_over_45 FROM crossing""")
def crossing_quantiles(spark, d):
    return hi.crossing_quantiles(hi.crossings(b.history_segments(spark, d)))


_HIST_FLOWS = f"""{s.SEGMENTS}, hrows AS (SELECT *, NULL::BIGINT AS res, NULL::BIGINT AS opn FROM hist), {s.flow_ctes('hrows')}"""


@query("wide_crossing_censoring", f"""WITH {_HIST_FLOWS} SELECT f.section_id, epoch_us(f.t0) AS t0, f.rule,
  (SELECT count(*) FROM crossing x WHERE x.wide AND x.section_id=f.section_id AND x.t0=f.t0)>0 AS censored FROM flows0 f""")
def wide_crossing_censoring(spark, d):
    seg = materialize(b.history_segments(spark, d))  # a join, read for the ranges, the panel and the crossings
    splits = plan_splits(seg, ["section_id"], "start")
    out = hi.history_flows(hi.history_panel(seg, splits), hi.crossings(seg, splits=splits))
    return out.select("section_id", b.us("t0"), "rule", "censored")


_DARK = f"""{s.SEGMENTS}, idn AS (SELECT section_id, min(ts) AS fs, max(ts) AS ls FROM hist GROUP BY 1),
 days AS (SELECT CAST(unnest(generate_series(CAST((SELECT min(fs) FROM idn) AS DATE), CAST((SELECT max(ls) FROM idn)-INTERVAL 1 MICROSECOND AS DATE), INTERVAL 1 DAY)) AS DATE) AS day),
 cov AS (SELECT day, sum(sec) AS covered, count(*) AS k FROM (SELECT day, (epoch_us(least(ls, CAST(day+1 AS TIMESTAMP)))-epoch_us(greatest(fs, CAST(day AS TIMESTAMP))))/1000000.0 AS sec
   FROM days JOIN idn ON CAST(fs AS DATE)<=day AND CAST(ls AS DATE)>=day) WHERE sec>0 GROUP BY 1),
 drk AS (SELECT day, sum(sec) AS dark, count(DISTINCT section_id) AS k FROM (SELECT day, section_id, (epoch_us(least(t1, CAST(day+1 AS TIMESTAMP)))-epoch_us(greatest(t0, CAST(day AS TIMESTAMP))))/1000000.0 AS sec
   FROM days JOIN crossing ON wide AND CAST(t0 AS DATE)<=day AND CAST(t1 AS DATE)>=day) WHERE sec>0 GROUP BY 1),
 report AS (SELECT CAST(day AS VARCHAR) AS date, coalesce(cov.k,0) AS sections_covered, coalesce(drk.k,0) AS sections_dark,
   round(coalesce(CASE WHEN covered>0 THEN coalesce(dark,0)/covered END,0),4) AS share_time_in_gap FROM days LEFT JOIN cov USING (day) LEFT JOIN drk USING (day))"""


def _dark(spark, d):
    seg = b.history_segments(spark, d)
    seen = hi.history_panel(seg).groupBy("section_id").agg(
        F.min("run_started_at").alias("first_seen"), F.max("run_started_at").alias("last_seen"))
    return hi.dark_time(hi.crossings(seg), seen)


@query("dark_time_by_day", f"WITH {_DARK} SELECT * FROM report")
def dark_time_by_day(spark, d):
    return _dark(spark, d).withColumn("date", F.col("date").cast("string"))


@query("darkest_days", f"WITH {_DARK} SELECT * FROM report ORDER BY share_time_in_gap DESC, date LIMIT 10")
def darkest_days(spark, d):
    return hi.darkest_days(_dark(spark, d)).withColumn("date", F.col("date").cast("string"))


# -------------------------------------------------------------------------------- store


_REBUILD = f"""{s.RUN_ROWS}, firsts AS (SELECT section_id, min(run_at) AS f FROM srows GROUP BY 1),
 grid AS (SELECT section_id, r.* FROM firsts JOIN runs r ON r.run_at>=f),
 filled AS (SELECT g.*, sr.event_id AS held, last_value(sr.event_id IGNORE NULLS) OVER (PARTITION BY g.section_id ORDER BY g.run_at) AS event_id
   FROM grid g LEFT JOIN srows sr ON sr.section_id=g.section_id AND sr.run_no=g.run_no),
 marks AS (SELECT CAST(user_id AS VARCHAR) AS section_id, run_no, rd=1 AS rd_ok FROM peruser),
 panel2 AS (SELECT f.section_id, f.run_at, f.run_no, {s._COUNTS.replace('event_id', 'f.event_id')},
   ((CASE WHEN lists THEN coalesce(m.rd_ok,false) WHEN scope='priority' THEN held IS NOT NULL ELSE true END) AND coalesce(m.rd_ok,true))
     OR f.event_id%397=0 AS observed
   FROM filled f LEFT JOIN marks m ON m.section_id=f.section_id AND m.run_no=f.run_no)"""


def rebuilt(spark, d, start=None):
    return st.rebuild_panel(b.snapshot_rows(spark, d), b.run_table(spark, d), b.run_marks(spark, d), start=start)


@query("panel_rebuild", f"WITH {_REBUILD} SELECT section_id, epoch_us(run_at) AS run_started_at, e AS enrolled_count, w AS waitlist_count, opn AS open_reserved, observed FROM panel2")
def panel_rebuild(spark, d):
    return rebuilt(spark, d).select("section_id", b.us("run_started_at"), F.col("enrolled_count").cast("long").alias("enrolled_count"),
                                    F.col("waitlist_count").cast("long").alias("waitlist_count"),
                                    F.col("open_reserved").cast("long").alias("open_reserved"), "observed")


# The same events as two terms: odd runs are of one, the others of the other; most sections are in both.
_TERM = "CASE WHEN run_no%2=1 THEN '2272' ELSE '2268' END"
_TERMS = f"""{s.RUN_ROWS}, tsr AS (SELECT *, {_TERM} AS term FROM srows), tr AS (SELECT *, {_TERM} AS term FROM runs),
 firsts AS (SELECT section_id, term, min(run_at) AS f FROM tsr GROUP BY ALL),
 filled AS (SELECT x.section_id, r.*, sr.event_id AS held, last_value(sr.event_id IGNORE NULLS) OVER (PARTITION BY r.term, x.section_id ORDER BY r.run_at) AS event_id
   FROM firsts x JOIN tr r ON r.term=x.term AND r.run_at>=x.f LEFT JOIN tsr sr ON sr.section_id=x.section_id AND sr.run_no=r.run_no),
 marks AS (SELECT CAST(user_id AS VARCHAR) AS section_id, run_no, rd=1 AS rd_ok FROM peruser),
 tpanel AS (SELECT f.section_id, f.term, f.run_at, {s._COUNTS.replace('event_id', 'f.event_id')},
   ((CASE WHEN lists THEN coalesce(m.rd_ok,false) WHEN scope='priority' THEN held IS NOT NULL ELSE true END) AND coalesce(m.rd_ok,true))
     OR f.event_id%397=0 AS observed FROM filled f LEFT JOIN marks m ON m.section_id=f.section_id AND m.run_no=f.run_no)"""


def _two_terms(spark, d):
    term = F.when(F.floor(F.unix_micros("run_started_at") / b.HALF_HOUR_US) % 2 == 1, "2272").otherwise("2268")
    parts = (b.snapshot_rows(spark, d), b.run_table(spark, d), b.run_marks(spark, d))
    return st.rebuild_panel(*[p.withColumn("term_id", term) for p in parts])


@query("panel_rebuild_terms", f"WITH {_TERMS} SELECT term AS term_id, section_id, epoch_us(run_at) AS run_started_at, e AS enrolled_count, w AS waitlist_count, observed FROM tpanel")
def panel_rebuild_terms(spark, d):
    return _two_terms(spark, d).select("term_id", "section_id", b.us("run_started_at"), F.col("enrolled_count").cast("long").alias("enrolled_count"),
                                       F.col("waitlist_count").cast("long").alias("waitlist_count"), "observed")


TERM_FLOWS = f"""{s.PANEL}, terms AS (SELECT *, CASE WHEN event_id%2=1 THEN '2272' ELSE '2268' END AS term FROM panel),
 tgone AS (SELECT section_id, term, min(ts) AS gone_at FROM terms WHERE gs='GONE' GROUP BY ALL),
 ts1 AS (SELECT p.* REPLACE (p.section_id||'/'||p.term AS section_id) FROM terms p LEFT JOIN tgone USING (section_id, term) WHERE observed AND (gone_at IS NULL OR ts<gone_at)),
 {s.flow_ctes('ts1')}"""


def term_flows(spark, d):
    """Interval flows of two terms in one panel."""
    return fl.interval_flows(b.panel_from_events(spark, d, F.when(F.col("event_id") % 2 == 1, "2272").otherwise("2268")))


@query("interval_flows_terms", f"""WITH {TERM_FLOWS} SELECT split_part(section_id,'/',2) AS term_id, split_part(section_id,'/',1) AS section_id, epoch_us(t0) AS t0, epoch_us(t1) AS t1,
  d_enrolled, d_waitlist, admits, wl_joins, wl_drops, rule FROM flows0""")
def interval_flows_terms(spark, d):
    return term_flows(spark, d).select("term_id", "section_id", b.us("t0"), b.us("t1"), "d_enrolled", "d_waitlist", "admits", "wl_joins", "wl_drops", "rule")


@query("panel_warm_up", f"""WITH {_REBUILD} SELECT section_id, count(*) AS runs, CAST(sum(CAST(observed AS INT)) AS BIGINT) AS observed,
  CAST(sum(e) AS BIGINT) AS enrolled FROM panel2 WHERE CAST(run_at AS DATE)>=DATE '2024-01-20' GROUP BY 1""")
def panel_warm_up(spark, d):
    rows = rebuilt(spark, d, start=dt.date(2024, 1, 20))
    return rows.groupBy("section_id").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("observed").cast("long")).alias("observed"),
                                          F.sum("enrolled_count").alias("enrolled"))


def _state(spark, d, day=b.DAY, lookback=7):
    return st.state_as_of(b.snapshot_rows(spark, d), day, lookback)


_STATE_OUT = "section_id, epoch_us(run_at) AS fetched_at, e AS enrolled_count, w AS waitlist_count, gs AS section_status"


def _state_columns(df):
    return df.select("section_id", b.us("fetched_at"), F.col("enrolled_count").cast("long").alias("enrolled_count"),
                     F.col("waitlist_count").cast("long").alias("waitlist_count"), "section_status")


@query("state_as_of", f"WITH {s.RUN_ROWS}, {s.state('st', '2024-01-15', 7)} SELECT {_STATE_OUT} FROM st")
def state_as_of(spark, d):
    return _state_columns(_state(spark, d))


@query("latest_state", f"""WITH {s.RUN_ROWS}, {s.state('st', '2024-01-15', 7)} SELECT {_STATE_OUT} FROM st
  WHERE EXISTS (SELECT 1 FROM runs WHERE kind='baseline' AND CAST(run_at AS DATE)=DATE '2024-01-15')""")
def latest_state(spark, d):
    return _state_columns(st.latest_state(b.snapshot_rows(spark, d), b.run_table(spark, d), "2268", b.DAY))


_DELTA = f"""{s.RUN_ROWS}, {s.state('prev', '2024-01-14', 7)}, {s.state('obs', '2024-01-15', 0)},
 uni AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS section_id FROM events WHERE CAST(ts AS DATE)=DATE '2024-01-15'),
 changed AS (SELECT o.* FROM obs o LEFT JOIN prev p USING (section_id) WHERE p.section_id IS NULL OR (o.e,o.c,o.w,o.wc) IS DISTINCT FROM (p.e,p.c,p.w,p.wc)
   OR o.res IS DISTINCT FROM p.res OR o.opn IS DISTINCT FROM p.opn OR o.gs IS DISTINCT FROM p.gs),
 dead AS (SELECT * FROM prev WHERE coalesce(gs,'')<>'GONE' AND section_id NOT IN (SELECT section_id FROM obs) AND section_id NOT IN (SELECT section_id FROM uni))"""
_DEAD_OUT = "section_id, 1705363200000000 AS fetched_at, e AS enrolled_count, w AS waitlist_count, 'GONE' AS section_status"
_AT = dt.datetime(2024, 1, 16, tzinfo=dt.timezone.utc)


def _delta_inputs(spark, d):
    return (_state(spark, d, dt.date(2024, 1, 14)), _state(spark, d, b.DAY, 0), b.attempted_on(spark, d, b.DAY), _AT, "site")


@query("compute_delta", f"WITH {_DELTA} SELECT {_STATE_OUT} FROM changed UNION ALL SELECT {_DEAD_OUT} FROM dead")
def compute_delta(spark, d):
    return _state_columns(st.compute_delta(*_delta_inputs(spark, d)))


@query("tombstones", f"WITH {_DELTA} SELECT {_DEAD_OUT} FROM dead")
def tombstones(spark, d):
    return _state_columns(st.tombstones(*_delta_inputs(spark, d)))


@query("baseline_with_tombstones", f"WITH {_DELTA} SELECT {_STATE_OUT} FROM obs UNION ALL SELECT {_DEAD_OUT} FROM dead")
def baseline_with_tombstones(spark, d):
    return _state_columns(st.baseline_with_tombstones(*_delta_inputs(spark, d)))


@query("snapshot_validation", """SELECT * FROM (SELECT 'null_value' AS rule, 'section_id' AS field, count(*) AS violations FROM events WHERE user_id IS NULL
  UNION ALL SELECT 'unknown_source', 'source', count(*) FROM events WHERE event_type='view'
  UNION ALL SELECT 'duplicate_id', 'section_id', count(*) FROM (SELECT user_id, epoch_us(ts)//1800000000 AS r FROM events GROUP BY ALL HAVING count(*)>1)) WHERE violations>0""")
def snapshot_validation(spark, d):
    raw = b._named(b._run_keys(b.table(spark, d, "events"))).withColumns({
        **b._counts(), "fetched_at": F.col("run_started_at"), "term_id": F.lit("2268"),
        "source": F.when(F.col("event_type") == "view", "other").otherwise("site")})
    return st.validate_snapshots(raw.select(*st.snapshot_fields(raw)), ("site", "feed"))


@query("section_identity", f"""WITH {s.RUN_ROWS} SELECT section_id, 'S'||(any_value(user_id)%7) AS subject, CAST(any_value(user_id)%60*5 AS VARCHAR) AS catalog_number,
  epoch_us(min(run_at)) AS first_seen, epoch_us(max(run_at)) AS last_seen FROM srows GROUP BY 1""")
def section_identity(spark, d):
    return st.section_identity(b.snapshot_rows(spark, d)).select("section_id", "subject", "catalog_number",
                                                                 b.us("first_seen"), b.us("last_seen"))


@query("run_gates", f"""WITH {s.RUN_ROWS} SELECT epoch_us(run_at) AS run_started_at, round(CASE WHEN n_observed+n_missing>0 THEN n_missing/(n_observed+n_missing) ELSE 0 END,4) AS missing_share,
  CASE WHEN n_observed+n_missing>0 THEN n_missing/(n_observed+n_missing) ELSE 0 END<=0.5 AS accepted, complete AS may_tombstone FROM runs""")
def run_gates(spark, d):
    return st.run_gates(b.run_table(spark, d)).select(b.us("run_started_at"), "missing_share", "accepted", "may_tombstone")


@query("run_kinds", f"""WITH {s.RUN_ROWS} SELECT epoch_us(run_at) AS run_started_at, CASE WHEN run_at=min(run_at) OVER (PARTITION BY CAST(run_at AS DATE)) THEN 'baseline' ELSE 'delta' END AS decided FROM runs""")
def run_kinds(spark, d):
    return st.run_kinds(b.run_table(spark, d)).select(b.us("run_started_at"), "decided")


@query("source_mismatches", f"""WITH {s.RUN_ROWS}, base AS (SELECT *, last_value(CASE WHEN kind='baseline' THEN source END IGNORE NULLS)
   OVER (PARTITION BY CAST(run_at AS DATE) ORDER BY run_at, kind) AS bs FROM runs)
 SELECT epoch_us(run_at) AS run_started_at, source, bs AS baseline_source FROM base WHERE kind='delta' AND source<>bs""")
def source_mismatches(spark, d):
    return st.source_mismatches(b.run_table(spark, d)).select(b.us("run_started_at"), "source", "baseline_source")


@query("last_run_status", f"""WITH {s.RUN_ROWS} SELECT '2268' AS term_id, epoch_us(run_at) AS run_started_at, kind, scope, n_observed, n_missing,
  round(n_missing/(n_observed+n_missing),4) AS missing_share FROM runs ORDER BY run_at DESC LIMIT 1""")
def last_run_status(spark, d):
    out = st.last_run_status(b.run_table(spark, d))
    return out.select("term_id", b.us("run_started_at"), "kind", "scope", F.col("n_observed").cast("long").alias("n_observed"),
                      F.col("n_missing").cast("long").alias("n_missing"), "missing_share")


@query("effective_term", "SELECT CASE WHEN count(DISTINCT user_id)>0 THEN '2268' END AS term_id FROM events")
def effective_term(spark, d):
    return st.effective_term(b.snapshot_rows(spark, d), "2265")


_LIVE = f"""{s.RUN_ROWS}, {s.state('st', '2024-01-15', 7)}, here AS (SELECT *, 'S'||(user_id%7)||' '||(user_id%60*5) AS course_key FROM st WHERE coalesce(gs,'')<>'GONE'),
 live AS (SELECT * FROM here WHERE course_key IN (SELECT course_key FROM here WHERE w>0 OR (c>0 AND e>=c)))"""


@query("live_view", f"WITH {_LIVE} SELECT section_id, course_key, e AS enrolled, c AS capacity, w AS waitlist FROM live")
def live_view(spark, d):
    cast = lambda c: F.col(c).cast("long").alias(c)
    return st.live_view(_state(spark, d)).select("section_id", "course_key", cast("enrolled"), cast("capacity"), cast("waitlist"))


@query("live_board", f"""WITH {_LIVE} SELECT section_id, greatest(c-e,0) AS seats_open, CASE WHEN w>0 THEN 'waitlist' WHEN greatest(c-e,0)=0 THEN 'full'
  WHEN coalesce(opn,0)>=greatest(c-e,0) THEN 'full and reserved' ELSE 'open' END AS board_status,
  (1705363200000000-epoch_us(run_at))/60000000>=360 AS stale FROM live""")
def live_board(spark, d):
    board = st.live_board(st.live_view(_state(spark, d)), F.lit(_AT).cast("timestamp"))
    return board.select("section_id", F.col("seats_open").cast("long").alias("seats_open"), "board_status", "stale")


# ------------------------------------------------------------------------------ quality


_CADENCE = f"""{s.RUN_ROWS}, each AS (SELECT 'all' AS scope, run_at FROM runs UNION ALL SELECT scope, run_at FROM runs),
 gaps AS (SELECT scope, run_at, (epoch_us(run_at)-epoch_us(lag(run_at) OVER (PARTITION BY scope ORDER BY run_at)))/60000000.0 AS g FROM each
   WHERE run_at>=TIMESTAMP '2024-01-24' AND run_at<=TIMESTAMP '2024-01-31'),
 report AS (SELECT '2268' AS term_id, scope, count(*) AS n_runs, round(max(g),3) AS largest_gap_min, round(quantile_cont(g,0.95),3) AS p95_gap_min,
   round(avg(CASE WHEN g IS NOT NULL THEN CAST(g<=45 AS INT) END),4) AS share_gaps_le_45min,
   round((epoch_us(TIMESTAMP '2024-01-31')-epoch_us(max(run_at)))/60000000.0,3) AS minutes_since_last FROM gaps GROUP BY ALL),
 shares AS (SELECT round(quantile_cont(sh,0.5),4) AS median_missing_share, round(max(sh),4) AS max_missing_share
   FROM (SELECT n_missing/nullif(n_observed+n_missing,0) AS sh FROM runs))"""


def _cadence(spark, d):
    return qu.cadence_report(b.run_table(spark, d), b.NOW, 168)


@query("cadence_report", f"WITH {_CADENCE} SELECT * FROM report")
def cadence_report(spark, d):
    return _cadence(spark, d).drop("first", "last")


@query("missing_share", f"WITH {_CADENCE} SELECT '2268' AS term_id, * FROM shares")
def missing_share(spark, d):
    return qu.missing_share(b.run_table(spark, d))


@query("cadence_breaches", f"""WITH {_CADENCE}, a AS (SELECT * FROM report, shares WHERE scope='all')
 SELECT term_id, 'largest_gap_min' AS breach, CAST(largest_gap_min AS DOUBLE) AS value, CAST(90 AS DOUBLE) AS "limit" FROM a WHERE largest_gap_min>90
 UNION ALL SELECT term_id, 'n_runs', CAST(n_runs AS DOUBLE), CAST(400 AS DOUBLE) FROM a WHERE n_runs<400
 UNION ALL SELECT term_id, 'median_missing_share', CAST(median_missing_share AS DOUBLE), CAST(0.1 AS DOUBLE) FROM a WHERE median_missing_share>0.1""")
def cadence_breaches(spark, d):
    return qu.breaches(_cadence(spark, d), qu.missing_share(b.run_table(spark, d)), gap_min=90, runs_lt=400, missing_share_gt=0.1)


@query("run_counts", f"""WITH {s.RUN_ROWS} SELECT 'kind' AS what, kind AS value, count(*) AS n_runs FROM runs GROUP BY ALL
  UNION ALL SELECT 'scope', scope, count(*) FROM runs GROUP BY ALL""")
def run_counts(spark, d):
    return qu.run_counts(b.run_table(spark, d))


@query("panel_profile", f"""WITH {s.PANEL} SELECT count(DISTINCT ts) AS runs, count(DISTINCT section_id) AS sections, count(*) AS rows,
  round(avg(CAST(observed AS INT)),6) AS observed_share, round(avg(CASE WHEN observed THEN CAST(opn IS NULL AS INT) END),6) AS null_open_reserved,
  round(avg(CASE WHEN observed THEN CAST(w IS NULL AS INT) END),6) AS null_waitlist_count FROM panel""")
def panel_profile(spark, d):
    p = qu.panel_profile(b.panel_from_events(spark, d))
    return p.select("runs", "sections", "rows", r6("observed_share"), r6("null_open_reserved"), r6("null_waitlist_count"))


@query("run_gap_summary", f"""WITH {s.RUN_ROWS}, g AS (SELECT (epoch_us(run_at)-epoch_us(lag(run_at) OVER (ORDER BY run_at)))/60000000.0 AS g FROM runs)
 SELECT count(g) AS "count", round(avg(g),6) AS mean, round(stddev_samp(g),6) AS std, min(g) AS "min", quantile_cont(g,0.25) AS p25,
  quantile_cont(g,0.5) AS p50, quantile_cont(g,0.75) AS p75, max(g) AS "max" FROM g""")
def run_gap_summary(spark, d):
    out = qu.run_gap_summary(b.run_table(spark, d).select("run_started_at"))
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})



@query("observation_histogram", f"""WITH {s.PANEL}, n AS (SELECT CASE WHEN k<=1 THEN 0 WHEN k<=2 THEN 1 WHEN k<=5 THEN 2 WHEN k<=10 THEN 3 WHEN k<=48 THEN 4 WHEN k<=96 THEN 5 ELSE 6 END AS o
   FROM (SELECT count(*) AS k FROM panel WHERE observed GROUP BY section_id)), bins(o, label) AS (VALUES (0,'1'),(1,'2'),(2,'3-5'),(3,'6-10'),(4,'11-48'),(5,'49-96'),(6,'97+'))
 SELECT bins.o AS ordinal, label AS observations, count(n.o) AS sections FROM bins LEFT JOIN n USING (o) GROUP BY ALL""")
def observation_histogram(spark, d):
    return qu.observation_histogram(b.panel_from_events(spark, d))


@query("impossible_states", f"""WITH {s.PANEL}, k AS (SELECT section_id, unnest([{{'k':'enrolled_over_capacity','h':e>c}}, {{'k':'queue_over_capacity','h':w>wc}},
   {{'k':'negative','h':e<0 OR c<0 OR w<0 OR wc<0}}, {{'k':'queue_beside_seats','h':w>0 AND e<c AND opn IS NULL}},
   {{'k':'queue_beside_free_seats','h':w>0 AND e<c-coalesce(opn,0)}}]) AS x FROM panel WHERE observed)
 SELECT x.k AS kind, CAST(sum(CAST(x.h AS INT)) AS BIGINT) AS rows, count(DISTINCT CASE WHEN x.h THEN section_id END) AS sections FROM k GROUP BY 1""")
def impossible_states(spark, d):
    return qu.impossible_states(b.panel_from_events(spark, d))


@query("vanished_sections", f"""WITH {s.PANEL}, {s.GONE} SELECT count(*) AS vanished, count(CASE WHEN EXISTS (SELECT 1 FROM panel p WHERE p.section_id=gone.section_id
   AND p.observed AND p.ts>gone_at AND coalesce(p.gs,'')<>'GONE') THEN 1 END) AS reappeared FROM gone""")
def vanished_sections(spark, d):
    return qu.vanished(b.panel_from_events(spark, d))


@query("top_jumps", f"""WITH {s.PANEL}, st AS (SELECT section_id, ts, e, w, c, lag(e) OVER x AS pe, lag(w) OVER x AS pw, lag(c) OVER x AS pc FROM panel WHERE observed WINDOW x AS (PARTITION BY section_id ORDER BY ts)),
 j AS (SELECT section_id, ts, 0 AS o, 'enrolled_count' AS "column", pe AS "from", e AS "to" FROM st UNION ALL SELECT section_id, ts, 1, 'waitlist_count', pw, w FROM st
   UNION ALL SELECT section_id, ts, 2, 'enroll_capacity', pc, c FROM st)
 SELECT section_id, epoch_us(ts) AS run_started_at, "column", "from", "to", abs("to"-"from") AS abs_change FROM j WHERE abs("to"-"from")>0
 ORDER BY abs_change DESC, o, section_id, ts LIMIT 15""")
def top_jumps(spark, d):
    out = qu.top_jumps(b.panel_from_events(spark, d))
    return out.select("section_id", b.us("run_started_at"), "column", *[F.col(c).cast("long").alias(c) for c in ("from", "to", "abs_change")])


_CHECK = f"""{s.RUN_ROWS}, {s.state('a', '2024-01-15', 7)}, {s.state('z', '2024-01-14', 6)},
 pair AS (SELECT coalesce(a.section_id,z.section_id) AS section_id, greatest(abs(a.e-z.e),abs(a.w-z.w),abs(a.c-z.c),abs(a.wc-z.wc)) AS m,
   a.section_id IS NOT NULL AND z.section_id IS NOT NULL AS ok FROM a FULL OUTER JOIN z ON a.section_id=z.section_id),
 verdicts AS (SELECT section_id, CASE WHEN ok THEN m END AS max_diff, CASE WHEN NOT ok THEN 'error' WHEN m=0 THEN 'agree' WHEN m<=10 THEN 'drift' ELSE 'disagree' END AS verdict FROM pair)"""


def _checked(spark, d):
    return qu.cross_check(_state(spark, d), _state(spark, d, dt.date(2024, 1, 14), 6))


@query("cross_check", f"WITH {_CHECK} SELECT * FROM verdicts")
def cross_check(spark, d):
    return _checked(spark, d)


@query("verdict_counts", f"""WITH {_CHECK} SELECT count(*) FILTER (verdict='agree') AS agree, count(*) FILTER (verdict='drift') AS drift,
  count(*) FILTER (verdict='disagree') AS disagree, count(*) FILTER (verdict='error') AS error, count(*) FILTER (verdict<>'error') AS comparable FROM verdicts""")
def verdict_counts(spark, d):
    return qu.verdict_counts(_checked(spark, d))


# -------------------------------------------------------------------------------- walks


_THIN = f"""{s.FLOWS}, fl AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY t0) AS rn FROM flows),
 thin AS (SELECT section_id, rn, t0 AS last_t, true AS kept FROM fl WHERE rn=1
   UNION ALL SELECT f.section_id, f.rn, CASE WHEN f.t0-t.last_t>=INTERVAL 240 MINUTE THEN f.t0 ELSE t.last_t END, f.t0-t.last_t>=INTERVAL 240 MINUTE
   FROM thin t JOIN fl f ON f.section_id=t.section_id AND f.rn=t.rn+1)"""


@query("thin_joins", f"WITH RECURSIVE {_THIN} SELECT section_id, epoch_us(t0) AS t0, kept FROM fl JOIN thin USING (section_id, rn)")
def thin_joins(spark, d):
    return co.thin_joins(flows(spark, d)).select("section_id", b.us("t0"), "kept")


@query("censoring_horizon", f"""WITH {s.FLOWS}, r AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY t0) AS rn FROM flows),
 c AS (SELECT *, min(CASE WHEN censored THEN rn END) OVER (PARTITION BY section_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cut,
   max(t1) OVER (PARTITION BY section_id) AS last_t FROM r),
 h AS (SELECT c.section_id, c.t0, CASE WHEN c.censored THEN c.t0 WHEN c.cut IS NULL THEN c.last_t ELSE p.t1 END AS ends
   FROM c LEFT JOIN r p ON p.section_id=c.section_id AND p.rn=c.cut-1),
 j AS (SELECT section_id, t0+INTERVAL 10 MINUTE AS jt FROM flows)
 SELECT j.section_id, epoch_us(jt) AS join_time, CASE WHEN h.ends IS NOT NULL THEN CAST(round(greatest((epoch_us(h.ends)-epoch_us(jt))/60000000.0, 0)*1000000) AS BIGINT) END AS horizon_us
 FROM j ASOF LEFT JOIN h ON h.section_id=j.section_id AND h.t0>=j.jt""")
def censoring_horizon(spark, d):
    rows = flows(spark, d)
    joins = rows.select("section_id", (F.col("t0") + F.expr("INTERVAL 10 MINUTES")).alias("join_time"))
    return co.censoring_horizon(rows, joins).select("section_id", b.us("join_time"), micros("horizon_min", 1_000_000, "horizon_us"))


def _walk_sql(scenario: str, positions=POSITIONS, thin: bool = True) -> str:
    places = ", ".join(f"({p})" for p in positions)
    step = {"optimistic": "f.admits+f.wl_drops", "pessimistic": "f.admits",
            "central": "f.admits+f.wl_drops*(CASE WHEN f.waitlist0>1 THEN least(greatest((w.k-1.0)/(f.waitlist0-1.0),0.0),1.0) ELSE 0 END)"}[scenario]
    clear = "0.5" if scenario == "central" else "0.0"
    keep = "kept AND (waitlist0>0 OR full0) AND " if thin else ""
    return f"""{_THIN}, joins AS (SELECT f.*, p.pos FROM fl f JOIN thin USING (section_id, rn) CROSS JOIN (VALUES {places}) p(pos) WHERE {keep}waitlist0>=pos-1),
 walk AS (SELECT section_id, rn AS rn0, pos, rn AS cur, CAST(pos AS DOUBLE) AS k, 0 AS state, NULL::TIMESTAMP AS end_t FROM joins
   UNION ALL SELECT w.section_id, w.rn0, w.pos, w.cur+1, CASE WHEN f.censored THEN w.k ELSE w.k-({step}) END,
     CASE WHEN f.censored THEN 2 WHEN w.k-({step})<={clear} THEN 1 ELSE 0 END, CASE WHEN f.censored THEN f.t0 ELSE f.t1 END
   FROM walk w JOIN fl f ON f.section_id=w.section_id AND f.rn=w.cur WHERE w.state=0),
 fin AS (SELECT section_id, rn0, pos, max(state) AS state, max(CASE WHEN state<>0 THEN end_t END) AS end_t FROM walk GROUP BY ALL),
 follow AS (SELECT section_id, rn, coalesce(min(CASE WHEN censored THEN t0 END) OVER (PARTITION BY section_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
   max(t1) OVER (PARTITION BY section_id)) AS fu FROM fl),
 walked AS (SELECT j.section_id, j.t0 AS join_t, j.pos AS position, j.waitlist0, j.capacity0, CASE WHEN state=1 THEN 1 ELSE 0 END AS event,
   (epoch_us(coalesce(end_t, fu))-epoch_us(j.t0))/60000000.0 AS duration_min, (epoch_us(fu)-epoch_us(j.t0))/86400000000.0 AS follow_up_days, j.reserved0
   FROM joins j JOIN fin ON fin.section_id=j.section_id AND fin.rn0=j.rn AND fin.pos=j.pos JOIN follow fo ON fo.section_id=j.section_id AND fo.rn=j.rn)"""


def _register_walks() -> None:
    for scenario in SCENARIOS:
        text = f"""WITH RECURSIVE {_walk_sql(scenario)} SELECT section_id, epoch_us(join_t) AS join_time, position, event, CAST(round(duration_min*60000000) AS BIGINT) AS duration_us,
          CAST(round(follow_up_days*86400000000) AS BIGINT) AS follow_up_us FROM walked"""

        @query(f"position_walk_{scenario}", text)
        def walked(spark, d, scenario=scenario):
            out = co.walk_positions(flows(spark, d), scenarios=(scenario,))
            return out.select("section_id", b.us("join_time"), "position", "event", micros("duration_min", 60_000_000, "duration_us"),
                              micros("follow_up_days", 86_400_000_000, "follow_up_us"))


_register_walks()


@query("virtual_waitlisters", f"""WITH RECURSIVE {_walk_sql('central', (1, 3, 5, 10, 20, 40), False)} SELECT section_id, epoch_us(join_t) AS join_time, position, event,
  CAST(round(CASE WHEN event=1 THEN duration_min END*60000000) AS BIGINT) AS duration_us FROM walked""")
def virtual_waitlisters(spark, d):
    out = co.virtual_waitlisters(flows(spark, d))
    return out.select("section_id", b.us("join_time"), "position", "event", micros("duration_min", 60_000_000, "duration_us"))


def event_cohort(spark, d, scenarios=("central",)):
    return co.build_cohort(flows(spark, d), b.identity_from_events(spark, d), b.CALENDAR, scenarios=scenarios,
                           min_sections_per_group=22)


_COHORT = f"""{_walk_sql('central')}, {s.IDENTITY}, cj AS (SELECT w.*, subject, catalog_number, course_key,
   CASE WHEN CAST(catalog_number AS INT)<100 THEN 'lower' WHEN CAST(catalog_number AS INT)<200 THEN 'upper' ELSE 'grad' END AS level,
   CASE WHEN position<=5 THEN '1-5' WHEN position<=15 THEN '6-15' WHEN position<=40 THEN '16-40' ELSE '41+' END AS position_bucket
   FROM walked w LEFT JOIN ident USING (section_id) WHERE duration_min>0),
 big AS (SELECT subject FROM cj GROUP BY 1 HAVING count(DISTINCT section_id)>=22)"""


@query("cohort", f"""WITH RECURSIVE {_COHORT} SELECT section_id, epoch_us(join_t) AS join_time, position, position_bucket, round(ln(position),6) AS log_position,
  round(CASE WHEN capacity0>0 THEN waitlist0/capacity0 END,6) AS wl_ratio, CAST(round(duration_min*60000000) AS BIGINT) AS duration_us, event, course_key, level,
  CASE WHEN subject IN (SELECT subject FROM big) THEN subject ELSE 'OTHER' END AS dept_group, {s.PHASE.format('join_t')} AS phase,
  epoch_us(TIMESTAMP '2026-08-26')-epoch_us(join_t) AS to_instruction_us, coalesce(reserved0,0)>0 AS reserved FROM cj""")
def cohort(spark, d):
    c = event_cohort(spark, d)
    return c.select("section_id", b.us("join_time"), "position", "position_bucket", r6("log_position"), r6("wl_ratio"),
                    micros("duration_days", 86_400_000_000, "duration_us"), "event", "course_key", "level", "dept_group", "phase", micros("days_to_instruction", 86_400_000_000, "to_instruction_us"), "reserved")


@query("dept_pooling", f"""WITH RECURSIVE {_COHORT} SELECT CASE WHEN subject IN (SELECT subject FROM big) THEN subject ELSE 'OTHER' END AS dept_group,
  count(*) AS rows, count(DISTINCT section_id) AS sections FROM cj GROUP BY 1""")
def dept_pooling(spark, d):
    return event_cohort(spark, d).groupBy("dept_group").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("section_id").alias("sections"))


@query("phase_lookup", f"""WITH {s.COHORT} SELECT row_id, phase, round(dti,6) AS days_to_instruction,
  round((epoch_us(TIMESTAMP '2026-09-12')-epoch_us(join_time))/86400000000.0,6) AS deadline_days FROM cohort""")
def phase_lookup(spark, d):
    c, at = b.cohort_from_lineitem(spark, d), F.col("join_time")
    return c.select("row_id", phase_at(at, b.CALENDAR).alias("phase"),
                    F.round(days_to_instruction(at, b.CALENDAR), 6).alias("days_to_instruction"),
                    F.round(horizon_days(at, b.CALENDAR, "deadline"), 6).alias("deadline_days"))
