"""The bindings and core operators once more, as plain SQL for the cross-check."""
from __future__ import annotations

from turnwise.plans.bindings import COHORT_START_US

_COUNTS = """95+event_id%7 AS e, 100-(CASE WHEN event_id%11=0 THEN 2 ELSE 0 END) AS c,
  greatest(0,(event_id*5)%9-3) AS w, 20 AS wc, CASE WHEN event_id%5=0 THEN event_id%4 END AS res,
  CASE WHEN event_id%5=0 THEN event_id%3 END AS opn, CASE WHEN event_id%397=0 THEN 'GONE' END AS gs"""

PANEL = f"panel AS (SELECT CAST(user_id AS VARCHAR) AS section_id, ts, event_type<>'error' AS observed, event_id, user_id, {_COUNTS} FROM events)"

_FLOW_CASES = """
 SELECT section_id, t0, t1, CAST(((epoch_us(t1)-epoch_us(t0))//1000000) AS DOUBLE)/60.0 AS interval_min,
  de AS d_enrolled, dw AS d_waitlist, dc AS d_capacity, dwc AS d_wl_capacity, e AS enrolled0, c AS capacity0, w AS waitlist0,
  res AS reserved0, opn AS open_reserved0, full0,
  CASE WHEN de>0 AND w>0 THEN de ELSE 0 END AS admits,
  CASE WHEN de>0 AND w>0 THEN (CASE WHEN dw+de>0 THEN dw+de ELSE 0 END) WHEN dw>0 THEN dw ELSE 0 END AS wl_joins,
  CASE WHEN de>0 AND w>0 THEN (CASE WHEN dw+de<0 THEN -(dw+de) ELSE 0 END) WHEN de<=0 AND dw<0 THEN -dw ELSE 0 END AS wl_drops,
  CASE WHEN de>0 AND w=0 THEN de ELSE 0 END AS enr_joins,
  CASE WHEN de<0 THEN -de ELSE 0 END AS enr_drops,
  dc>0 AS expansion,
  CASE WHEN de>0 AND w>0 THEN coalesce(opn,0)>0 OR de>w
       WHEN de>0 AND w=0 AND dw>0 THEN full0
       WHEN de>0 AND w=0 AND dw<0 THEN true
       WHEN de=0 AND dw<0 THEN full0 AND w>0
       WHEN de<0 AND dw=0 THEN full0 AND w>0
       WHEN de<0 AND dw<0 THEN true ELSE false END AS ambiguous,
  CASE WHEN de>0 AND w>0 THEN (CASE WHEN dw+de>0 THEN 'admit_join' WHEN dw+de<0 THEN 'admit_drop' ELSE 'admit' END)
       WHEN de>0 AND w=0 THEN (CASE WHEN dw>0 THEN 'enr_join_then_join' WHEN dw<0 THEN 'inconsistent' ELSE 'enr_join' END)
       WHEN de=0 AND dw>0 THEN 'join'
       WHEN de=0 AND dw<0 THEN (CASE WHEN dc<0 THEN 'wl_drop_capcut' ELSE 'wl_drop' END)
       WHEN de<0 AND dw=0 THEN 'enr_drop' WHEN de<0 AND dw<0 THEN 'enr_drop_wl_drop' WHEN de<0 AND dw>0 THEN 'enr_drop_join'
       ELSE 'none' END AS rule
 FROM diffs WHERE t1 IS NOT NULL"""


def flow_ctes(source: str = "series") -> str:
    """``flows0``: interval flows of the rows of ``source`` (not yet censored)."""
    return f"""diffs AS (SELECT *, e1-e AS de, w1-w AS dw, c1-c AS dc, wc1-wc AS dwc, e>=c-coalesce(opn,0) AS full0 FROM (
   SELECT section_id, ts AS t0, e, c, w, wc, res, opn, lead(ts) OVER x AS t1, lead(e) OVER x AS e1, lead(w) OVER x AS w1,
     lead(c) OVER x AS c1, lead(wc) OVER x AS wc1 FROM {source} WINDOW x AS (PARTITION BY section_id ORDER BY ts))),
 flows0 AS ({_FLOW_CASES})"""


GONE = "gone AS (SELECT section_id, min(ts) AS gone_at FROM panel WHERE gs='GONE' GROUP BY 1)"
SERIES = "series AS (SELECT p.* FROM panel p LEFT JOIN gone USING (section_id) WHERE observed AND (gone_at IS NULL OR ts<gone_at))"
FLOWS = f"{PANEL}, {GONE}, {SERIES}, {flow_ctes()}, flows AS (SELECT *, interval_min>3000 AS censored FROM flows0)"

IDENTITY = """ident AS (SELECT CAST(user_id AS VARCHAR) AS section_id, 'S'||(user_id%7) AS subject, CAST(user_id%60*5 AS VARCHAR) AS catalog_number,
  'S'||(user_id%7)||' '||(user_id%60*5) AS course_key FROM (SELECT DISTINCT user_id FROM events))"""

_RUN = """SELECT *, epoch_us(ts)//1800000000 AS run_no FROM events"""
RUN_ROWS = f"""ev AS ({_RUN}),
 ev2 AS (SELECT *, make_timestamp(run_no*1800000000) AS run_at, CASE WHEN run_no%48=0 THEN 'baseline' ELSE 'delta' END AS kind,
   CASE WHEN run_no%3=1 THEN 'priority' ELSE 'full' END AS scope, CASE WHEN run_no%50=7 THEN 'feed' ELSE 'site' END AS source FROM ev),
 picked AS (SELECT user_id, run_no, run_at, kind, scope, arg_max(event_id, ts) AS event_id FROM ev2 WHERE event_type<>'error' GROUP BY ALL),
 srows AS (SELECT CAST(user_id AS VARCHAR) AS section_id, user_id, run_no, run_at, kind, scope, CAST(run_at AS DATE) AS day, event_id, {_COUNTS} FROM picked),
 peruser AS (SELECT user_id, run_no, run_at, kind, scope, source, max(CASE WHEN event_type<>'error' THEN 1 ELSE 0 END) AS rd FROM ev2 GROUP BY ALL),
 runs AS (SELECT run_no, run_at, kind, scope, source, CAST(sum(rd) AS BIGINT) AS n_observed, CAST(sum(1-rd) AS BIGINT) AS n_missing,
   scope='full' AND run_no%5<>0 AS complete, scope='priority' AND run_no%2=0 AS lists FROM peruser GROUP BY ALL)"""


def state(name: str, day: str, lookback: int) -> str:
    """CTE with the latest row per id in a date window."""
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY run_at DESC, kind DESC) AS rk
   FROM srows WHERE day<=DATE '{day}' AND day>=DATE '{day}'-{lookback}) WHERE rk=1)"""


SEGMENTS = """seg0 AS (SELECT CAST(o_custkey AS VARCHAR) AS section_id, epoch_us(l_shipdate)+l_linenumber*3600000000 AS a,
   CAST((l_quantity-5)*86400000000 AS BIGINT) AS len, CAST(90+l_quantity%15 AS BIGINT) AS e, 100 AS c, CAST(l_partkey%6 AS BIGINT) AS w, 20 AS wc,
   (l_orderkey*8+l_linenumber)*1048576 + CAST(round(l_extendedprice*100) AS BIGINT)%1048576 AS ordinal
   FROM lineitem JOIN orders ON l_orderkey=o_orderkey),
 seg AS (SELECT section_id, make_timestamp(least(a,a+len)) AS s, make_timestamp(greatest(a,a+len)) AS f, e, c, w, wc, ordinal FROM seg0),
 seen AS (SELECT *, max(f) OVER (PARTITION BY section_id ORDER BY s, f, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM seg),
 hist AS (SELECT section_id, s AS ts, e, c, w, wc FROM seen WHERE pm IS NULL OR s>pm
   UNION ALL SELECT section_id, f, e, c, w, wc FROM seen WHERE f>s AND (pm IS NULL OR f>pm)),
 crossing AS (SELECT section_id, pm AS t0, s AS t1, (epoch_us(s)-epoch_us(pm))/60000000.0 AS minutes, (epoch_us(s)-epoch_us(pm))/60000000.0>180 AS wide
   FROM seen WHERE s>pm)"""

PHASE = """CASE WHEN CAST({0} AS DATE)<DATE '2026-04-13' THEN 'before' WHEN CAST({0} AS DATE)<=DATE '2026-06-12' THEN 'phase1'
  WHEN CAST({0} AS DATE)<DATE '2026-07-20' THEN 'between' WHEN CAST({0} AS DATE)<=DATE '2026-08-16' THEN 'phase2'
  WHEN CAST({0} AS DATE)<DATE '2026-08-26' THEN 'adjustment' WHEN CAST({0} AS DATE)<=DATE '2026-09-16' THEN 'instruction' ELSE 'after' END"""

COHORT = f"""co0 AS (SELECT (l_orderkey*8+l_linenumber)*1048576 + CAST(round(l_extendedprice*100) AS BIGINT)%1048576 AS row_id,
   CAST(l_partkey AS VARCHAR) AS section_id, make_timestamp({COHORT_START_US}+(l_orderkey%200)*86400000000+l_linenumber*3600000000) AS join_time,
   [1,3,7,12,18,30,50][l_linenumber] AS position, l_discount AS wl_ratio, l_quantity+l_linenumber*CAST(0.01 AS DOUBLE) AS dur,
   CASE WHEN l_returnflag<>'N' THEN 1 ELSE 0 END AS event, p_brand AS subject, CAST(l_partkey%16*20 AS VARCHAR) AS catalog_number,
   p_brand||' '||(l_partkey%16*20) AS course_key, l_partkey%16*20 AS num, l_partkey%30 AS extra, l_linestatus, l_partkey
   FROM lineitem JOIN part ON l_partkey=p_partkey),
 cohort AS (SELECT *, CASE WHEN position<=5 THEN '1-5' WHEN position<=15 THEN '6-15' WHEN position<=40 THEN '16-40' ELSE '41+' END AS bucket,
   dur+extra AS follow_up, CASE WHEN num<100 THEN 'lower' WHEN num<200 THEN 'upper' ELSE 'grad' END AS level, subject AS dept,
   {PHASE.format('join_time')} AS phase, (epoch_us(TIMESTAMP '2026-08-26')-epoch_us(join_time))/86400000000.0 AS dti FROM co0)"""


def km(name: str, source: str, keys: str, time: str = "dur", event: str = "event") -> str:
    """CTE with a product-limit curve per group: n, d, at_risk, surv at each time."""
    part = f"PARTITION BY {keys} " if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""{name}_e AS (SELECT {lead}{time} AS t, count(*) AS n, CAST(sum({event}) AS BIGINT) AS d FROM {source} GROUP BY ALL),
 {name}_r AS (SELECT *, CAST(sum(n) OVER ({part}ORDER BY t DESC) AS BIGINT) AS at_risk FROM {name}_e),
 {name} AS (SELECT *, product(1-CAST(d AS DOUBLE)/at_risk) OVER ({part}ORDER BY t) AS surv FROM {name}_r)"""


def draws(name: str, sections: str, keys: str = "", n_boot: int = 200, seed: int = 0) -> str:
    """CTEs with the numbered sections of each group (``{name}_n``) and how often each draw picks a number (``{name}``).

    ``sections`` has the group's keys and section_id once each; groups of one section have no draws.
    """
    part, lead = (f"PARTITION BY {keys} ", f"{keys}, ") if keys else ("", "")
    return f"""{name}_n AS (SELECT {lead}section_id, row_number() OVER ({part}ORDER BY CAST('0x'||substr(md5('{seed}:'||section_id),1,15) AS BIGINT), section_id)-1 AS number,
   count(*) OVER ({part.strip()}) AS sections FROM {sections}),
 {name}_h AS (SELECT j, q, md5('{seed}:'||j||':'||q) AS h FROM (SELECT unnest(range(max(sections))) AS j FROM {name}_n), range({-(-n_boot // 4)}) r(q)),
 {name}_w AS (SELECT j, q*4+k AS draw, CAST('0x'||substr(h,CAST(k*8+1 AS INT),8) AS BIGINT) AS word FROM {name}_h, range(4) r(k) WHERE q*4+k<{n_boot}),
 {name} AS (SELECT {lead}draw, word%sections AS number, count(*) AS times FROM {name}_n JOIN {name}_w ON j=number WHERE sections>=2 GROUP BY ALL)"""


def bands(name: str, source: str, keys: str, grid: str) -> str:
    """CTE with the 2.5 and 97.5 percentiles of the resampled clearing curve at each day of ``grid`` (keys, day)."""
    return f"""{name}_c AS (SELECT {keys}, section_id, dur AS t, count(*) AS n, sum(event) AS d FROM {source} GROUP BY ALL),
 {name}_z AS (SELECT DISTINCT {keys}, section_id FROM {name}_c), {draws(name + '_p', name + '_z', keys)},
 {name}_t AS (SELECT {keys}, draw, t, sum(times*n) AS n, sum(times*d) AS d FROM {name}_c JOIN {name}_p_n USING ({keys}, section_id) JOIN {name}_p USING ({keys}, number) GROUP BY ALL),
 {name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {keys}, draw ORDER BY t DESC) AS risk FROM {name}_t),
 {name}_s AS (SELECT {keys}, draw, day, coalesce(product(CASE WHEN t<=day THEN 1-CAST(d AS DOUBLE)/risk END),1) AS s FROM {name}_r JOIN {grid} USING ({keys}) GROUP BY ALL),
 {name} AS (SELECT {keys}, day, quantile_cont(1-s,0.025) AS low, quantile_cont(1-s,0.975) AS high FROM {name}_s GROUP BY ALL)"""
