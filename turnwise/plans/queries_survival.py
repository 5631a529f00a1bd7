"""Queries over the joiner cohort: curves, tests, backtests, hazards."""
from __future__ import annotations

import datetime as dt
import uuid

import numpy as np
from pyspark.sql import functions as F

from turnwise.operators import boot, cox, km
from turnwise.plans import backtest as bt
from turnwise.plans import bindings as b
from turnwise.plans import sql as s
from turnwise.plans.registry import query
from turnwise.session import materialize, scratch_dir
from turnwise.sources.tables_out import summarise_backtests

r6 = lambda c, name=None: F.round(c, 6).alias(name or c)
WHICH = "days:20"
SPLIT_AT = dt.datetime(2026, 7, 1, tzinfo=dt.timezone.utc)


def cohort(spark, d):
    return b.cohort_from_lineitem(spark, d)


@query("km_by_bucket", f"""WITH {s.COHORT}, {s.km('k', 'cohort', 'bucket')} SELECT bucket AS position_bucket, round(t,6) AS t, n, d, at_risk,
  round(surv,6) AS survival FROM k""")
def km_by_bucket(spark, d):
    out = km.kaplan_meier(cohort(spark, d), ["position_bucket"])
    return out.select("position_bucket", r6("t"), "n", "d", "at_risk", r6("survival"))


_CLEAR_AT = ", ".join(f"round(1-coalesce(min(CASE WHEN t<={x} THEN surv END),1),6) AS p_clear_by_{x}d" for x in (1, 3, 7, 14, 30))


@query("km_table", f"""WITH {s.COHORT}, {s.km('k', 'cohort', 'phase')} SELECT phase, CAST(sum(n) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS events,
  round(min(CASE WHEN d>0 AND 1-surv>=0.5 THEN t END),6) AS median_days, {_CLEAR_AT} FROM k GROUP BY 1 HAVING sum(n)>=10""")
def km_table(spark, d):
    out = km.km_table(cohort(spark, d), ["phase"])
    return out.select("phase", "n", "events", r6("median_days"), *[r6(c) for c in out.columns if c.startswith("p_clear")])


@query("km_median", f"""WITH {s.COHORT}, {s.km('k', 'cohort', 'dept, bucket')} SELECT dept AS dept_group, bucket AS position_bucket,
  round(min(CASE WHEN d>0 AND 1-surv>=0.5 THEN t END),6) AS median_days, round(max(t),6) AS reach_days, CAST(sum(n) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS events FROM k GROUP BY ALL""")
def km_median(spark, d):
    by = ["dept_group", "position_bucket"]
    out = km.medians(km.kaplan_meier(cohort(spark, d), by), by)
    return out.select(*by, r6("median_days"), r6("reach_days"), "n", "events")


def _logrank_sql(by: str, column: str) -> str:
    return f"""WITH {s.COHORT}, ev AS (SELECT {column} AS g, dur AS t, count(*) AS n, sum(event) AS d FROM cohort GROUP BY ALL), g AS (SELECT g, sum(n) AS size FROM ev GROUP BY 1),
 p AS (SELECT x.g AS a, y.g AS z, x.size AS na, y.size AS nz FROM g x JOIN g y ON x.g<y.g),
 ts AS (SELECT a, z, t, sum(CASE WHEN ev.g=a THEN n ELSE 0 END) AS ea, sum(n) AS et, sum(CASE WHEN ev.g=a THEN d ELSE 0 END) AS da, sum(d) AS dd FROM p JOIN ev ON ev.g IN (a, z) GROUP BY ALL),
 rk AS (SELECT *, CAST(sum(ea) OVER w AS DOUBLE) AS ra, CAST(sum(et) OVER w AS DOUBLE) AS rt FROM ts WINDOW w AS (PARTITION BY a, z ORDER BY t DESC)),
 st AS (SELECT a, z, sum(da-dd*ra/rt) AS u, sum(CASE WHEN rt>1 THEN dd*(ra/rt)*(1-ra/rt)*(rt-dd)/(rt-1) ELSE 0 END) AS v FROM rk GROUP BY ALL)
 SELECT '{by}' AS "by", a, z AS b, CAST(na AS BIGINT) AS n_a, CAST(nz AS BIGINT) AS n_b, round(u*u/v,6) AS statistic, (SELECT count(*) FROM p) AS comparisons FROM p JOIN st USING (a, z)"""


@query("logrank", _logrank_sql("level", "level"))
def logrank(spark, d):
    return km.logrank(cohort(spark, d), "level").drop("p").withColumn("statistic", F.round("statistic", 6))


#: The upper tail of chi-squared with one degree of freedom: 1 - erf(z), z*z = statistic/2, by erf's series of positive terms.
_TAIL = """CASE WHEN statistic>80 THEN 0 WHEN statistic<=0 THEN 1 ELSE 1-2/sqrt(pi())*exp(-statistic/2)*list_sum(list_transform(range(200),
   lambda n: exp((2*n+1)*ln(sqrt(statistic/2))-ln(2)-lgamma(n+CAST(1.5 AS DOUBLE))+ln(pi())/2))) END"""


@query("logrank_p_values", f"""SELECT "by", a, b, n_a, n_b, round(statistic,4) AS statistic, round({_TAIL},6) AS p, comparisons FROM ({_logrank_sql("phase", "phase").replace("round(u*u/v,6)", "u*u/v")})""")
def logrank_p_values(spark, d):
    out = km.logrank(cohort(spark, d), "phase")
    return out.withColumns({"statistic": F.round("statistic", 4), "p": F.round("p", 6)})


@query("sensitivity", f"""WITH {s.COHORT}, cut AS (SELECT * FROM cohort WHERE position=12 AND level='lower' AND phase='phase1'), {s.km('k', 'cut', '')}
 SELECT 'central' AS scenario, (SELECT count(*) FROM cohort) AS n, CASE WHEN sum(n)>=10 THEN round(min(CASE WHEN d>0 AND 1-surv>=0.5 THEN t END),6) END AS median_days FROM k""")
def sensitivity(spark, d):
    return km.headline_median(cohort(spark, d), position=12).select("scenario", "n", r6("median_days"))


@query("cleared_by_instruction", f"""WITH {s.COHORT} SELECT bucket AS position_bucket, round(avg(CASE WHEN event=1 AND dur<=greatest(dti,0) THEN 1 ELSE 0 END),6) AS share_cleared FROM cohort GROUP BY 1""")
def cleared_by_instruction(spark, d):
    return km.cleared_by_instruction(cohort(spark, d)).select("position_bucket", r6("share_cleared"))


@query("curve_lookup", f"""WITH {s.COHORT}, {s.km('k', 'cohort', 'bucket')}, q AS (SELECT bucket, follow_up/2 AS at, count(*) AS joiners FROM cohort GROUP BY ALL)
 SELECT q.bucket AS position_bucket, round(q.at,6) AS "at", joiners, round(coalesce(k.surv,1),6) AS survival FROM q ASOF LEFT JOIN k ON q.bucket=k.bucket AND q.at>=k.t""")
def curve_lookup(spark, d):
    c = cohort(spark, d)
    asked = c.groupBy("position_bucket", (F.col("follow_up_days") / 2).alias("at")).agg(F.count(F.lit(1)).alias("joiners"))
    out = km.read_survival(asked, km.kaplan_meier(c, ["position_bucket"]), ["position_bucket"], "at", "survival")
    return out.select("position_bucket", r6("at"), "joiners", r6("survival"))


# ---------------------------------------------------------------------------- backtests

_TEMPORAL = """train AS (SELECT section_id, subject, dept, course_key, bucket, dti, 0 AS fold, least(dur, cap) AS dur, CASE WHEN dur>cap THEN 0 ELSE event END AS event
   FROM (SELECT *, (epoch_us(TIMESTAMP '2026-07-01')-epoch_us(join_time))/86400000000.0 AS cap FROM cohort WHERE join_time<TIMESTAMP '2026-07-01') WHERE least(dur, cap)>0),
 test0 AS (SELECT *, 0 AS fold, 20.0::DOUBLE AS h FROM cohort WHERE join_time>=TIMESTAMP '2026-07-01')"""
_GROUPED = """train AS (SELECT c.*, f.fold FROM (SELECT *, num//20%5 AS own FROM cohort) c JOIN (SELECT unnest([0,1,2,3,4]) AS fold) f ON f.fold<>c.own),
 test0 AS (SELECT *, num//20%5 AS fold, (epoch_us(TIMESTAMP '2026-09-12')-epoch_us(join_time))/86400000000.0 AS h FROM cohort)"""
_CROSS = """train AS (SELECT *, 0 AS fold FROM cohort WHERE l_linestatus='F'), test0 AS (SELECT *, 0 AS fold, 14.0::DOUBLE AS h FROM cohort WHERE l_linestatus='O')"""


def _predict_sql(split: str) -> str:
    return f"""{s.COHORT}, {split}, test AS (SELECT * FROM test0 WHERE h>0 AND follow_up+1e-9>=h),
 cells AS (SELECT fold, 'all' AS kind, '' AS key, '' AS b, dur, event, dti FROM train UNION ALL SELECT fold, 'bucket', '', bucket, dur, event, dti FROM train
   UNION ALL SELECT fold, 'dept', dept, bucket, dur, event, dti FROM train UNION ALL SELECT fold, 'course', course_key, bucket, dur, event, dti FROM train),
 sizes AS (SELECT fold, kind, key, b, count(*) AS n, quantile_cont(dti,0.5) AS lead FROM cells GROUP BY ALL),
 fit AS (SELECT c.* FROM cells c JOIN sizes z USING (fold, kind, key, b) WHERE kind IN ('all','bucket') OR z.n>=30),
 {s.km('k', 'fit', 'fold, kind, key, b')}, kn AS (SELECT DISTINCT fold, kind, key, b FROM k),
 typ AS (SELECT fold, quantile_cont(lead,0.5) AS any_lead FROM sizes WHERE kind='bucket' GROUP BY 1),
 placed AS (SELECT t.*, CASE WHEN EXISTS (SELECT 1 FROM sizes z WHERE z.fold=t.fold AND z.kind='dept' AND z.key=t.subject) THEN t.subject ELSE 'OTHER' END AS dk FROM test t),
 chosen AS (SELECT p.*, kb.b IS NOT NULL AS hb, kd.b IS NOT NULL AS hd, kc.b IS NOT NULL AS hc, zc.lead AS cl, zc.n IS NOT NULL AS has_lead, coalesce(zb.lead, any_lead, 0) AS bl
   FROM placed p LEFT JOIN kn kb ON kb.fold=p.fold AND kb.kind='bucket' AND kb.b=p.bucket
   LEFT JOIN kn kd ON kd.fold=p.fold AND kd.kind='dept' AND kd.key=p.dk AND kd.b=p.bucket
   LEFT JOIN kn kc ON kc.fold=p.fold AND kc.kind='course' AND kc.key=p.course_key AND kc.b=p.bucket
   LEFT JOIN sizes zc ON zc.fold=p.fold AND zc.kind='course' AND zc.key=p.course_key AND zc.b=p.bucket
   LEFT JOIN sizes zb ON zb.fold=p.fold AND zb.kind='bucket' AND zb.b=p.bucket LEFT JOIN typ ON typ.fold=p.fold),
 asked AS (SELECT row_id, fold, unnest([
    {{'p':'bucket','kind':CASE WHEN hb THEN 'bucket' ELSE 'all' END,'key':'','b':CASE WHEN hb THEN bucket ELSE '' END,'at':h}},
    {{'p':'dept','kind':CASE WHEN hd THEN 'dept' WHEN hb THEN 'bucket' ELSE 'all' END,'key':CASE WHEN hd THEN dk ELSE '' END,'b':CASE WHEN hd OR hb THEN bucket ELSE '' END,'at':h}},
    {{'p':'course','kind':CASE WHEN hc THEN 'course' WHEN hd THEN 'dept' WHEN hb THEN 'bucket' ELSE 'all' END,'key':CASE WHEN hc THEN course_key WHEN hd THEN dk ELSE '' END,'b':CASE WHEN hc OR hd OR hb THEN bucket ELSE '' END,'at':h}},
    {{'p':'site','kind':CASE WHEN has_lead AND hc THEN 'course' WHEN has_lead AND hd THEN 'dept' WHEN hb THEN 'bucket' ELSE 'all' END,
      'key':CASE WHEN has_lead AND hc THEN course_key WHEN has_lead AND hd THEN dk ELSE '' END,'b':CASE WHEN hb OR (has_lead AND (hc OR hd)) THEN bucket ELSE '' END,
      'at':greatest(CASE WHEN has_lead THEN cl ELSE bl END, 0)}}], recursive := true) FROM chosen),
 readp AS (SELECT a.row_id, a.p, a.kind, 1-coalesce(k.surv,1) AS v FROM asked a ASOF LEFT JOIN k ON a.fold=k.fold AND a.kind=k.kind AND a.key=k.key AND a.b=k.b AND a.at>=k.t),
 wide AS (SELECT row_id, max(v) FILTER (p='bucket') AS p_bucket, max(v) FILTER (p='dept') AS p_dept, max(v) FILTER (p='course') AS p_course,
   max(kind) FILTER (p='course') AS course_level, round(max(v) FILTER (p='site'),2) AS p_site FROM readp GROUP BY 1),
 pred AS (SELECT c.row_id, c.section_id, c.phase, c.bucket, c.dur, c.event, c.h, NOT c.has_lead AS site_fallback, w.* EXCLUDE (row_id) FROM chosen c JOIN wide w USING (row_id))"""


_PRED_OUT = """SELECT row_id, round(p_bucket,6) AS p_bucket, round(p_dept,6) AS p_dept, round(p_course,6) AS p_course, course_level, round(p_site,6) AS p_site,
  site_fallback, round(h,6) AS horizon_days FROM pred"""


def written_cohort(spark, d):
    """The cohort, written once: backtests pass over it several times."""
    return materialize(b.cohort_from_lineitem(spark, d, dealt_out=True))


def _predictions(spark, d, split: str):
    c = written_cohort(spark, d)
    if split == "temporal":
        train, test = bt.temporal_split(c, SPLIT_AT)
        return bt.predict_split(train.withColumn("fold", F.lit(0)), test.withColumn("fold", F.lit(0)), b.CALENDAR, WHICH)[0]
    if split == "grouped":
        own = c.withColumn("fold", (F.col("catalog_number").cast("int") / 20 % 5).cast("int"))
        return bt.predict_split(own, own, b.CALENDAR, "deadline", folds=range(5))[0]
    train, test = c.where("l_linestatus = 'F'"), c.where("l_linestatus = 'O'")
    return bt.predict_split(train.withColumn("fold", F.lit(0)), test.withColumn("fold", F.lit(0)), b.CALENDAR, "days:14")[0]


def _pred_columns(df):
    return df.select("row_id", r6("p_bucket"), r6("p_dept"), r6("p_course"), "course_level", r6("p_site"), "site_fallback", r6("horizon_days"))


@query("temporal_backtest", f"WITH {_predict_sql(_TEMPORAL)} {_PRED_OUT}")
def temporal_backtest(spark, d):
    return _pred_columns(_predictions(spark, d, "temporal"))


@query("grouped_backtest", f"WITH {_predict_sql(_GROUPED)} {_PRED_OUT}")
def grouped_backtest(spark, d):
    return _pred_columns(_predictions(spark, d, "grouped"))


@query("cross_term_backtest", f"WITH {_predict_sql(_CROSS)} {_PRED_OUT}")
def cross_term_backtest(spark, d):
    return _pred_columns(_predictions(spark, d, "cross"))


@query("coverage_by_phase", f"""WITH {s.COHORT}, {_TEMPORAL} SELECT phase, count(*) AS n, CAST(sum(CAST(follow_up+1e-9>=h AS INT)) AS BIGINT) AS observable,
  round(avg(CAST(follow_up+1e-9>=h AS INT)),4) AS share_observable FROM test0 WHERE h>0 GROUP BY 1""")
def coverage_by_phase(spark, d):
    _, test = bt.temporal_split(cohort(spark, d), SPLIT_AT)
    return bt.coverage(test.withColumn("h", F.lit(20.0)))


_WEIGHTS = f"""{{pred}}, cens AS (SELECT dur, 1-event AS c FROM pred), {s.km('g', 'cens', '', 'dur', 'c')},
 wt AS (SELECT p.*, CASE WHEN event=1 AND dur<=h THEN 1.0 ELSE 0.0 END AS y, CASE WHEN event=1 AND dur<=h THEN 1/greatest(coalesce(gl.surv,1),CAST(0.05 AS DOUBLE))
   WHEN dur>h THEN 1/greatest(coalesce(gr.surv,1),CAST(0.05 AS DOUBLE)) ELSE 0 END AS w
   FROM pred p ASOF LEFT JOIN g gl ON p.dur>gl.t ASOF LEFT JOIN g gr ON p.h>=gr.t)"""
_SCORED = _WEIGHTS.replace("{pred}", _predict_sql(_CROSS))
_LONG = f"""{_SCORED}, long AS (SELECT row_id, section_id, phase, bucket, y, w, unnest([{{'predictor':'bucket','p':p_bucket}},{{'predictor':'dept','p':p_dept}},
   {{'predictor':'course','p':p_course}},{{'predictor':'site','p':p_site}}], recursive := true) FROM wt)"""


def _scored(spark, d):
    return bt.with_weights(_predictions(spark, d, "cross"))


def _long(spark, d, written=False):
    # predictions are compared at a fixed precision so both engines see the same ties
    scored = _scored(spark, d)
    rows = bt.long_predictions(materialize(scored) if written else scored)
    return rows.withColumn("p", F.round("p", 9))


@query("ipcw_weights", f"WITH {_SCORED} SELECT row_id, y, round(w,6) AS w FROM wt")
def ipcw_weights(spark, d):
    return _scored(spark, d).select("row_id", "y", r6("w"))


@query("brier", f"""WITH {_LONG} SELECT predictor, count(*) AS n_test, count(*) FILTER (w>0) AS brier_rows, round(avg(CAST(w=0 AS INT)),4) AS share_unknown,
  round(sum(w*(y-p)*(y-p))/sum(w),6) AS brier FROM long GROUP BY 1""")
def brier(spark, d):
    return bt.brier_table(_long(spark, d)).drop("share_fallback").withColumn("brier", F.round("brier", 6))


@query("brier_by_group", f"""WITH {_LONG}, dims AS (SELECT 'phase' AS dimension, phase AS value, predictor, y, w, p FROM long UNION ALL SELECT 'position_bucket', bucket, predictor, y, w, p FROM long)
 SELECT dimension, value, predictor, count(*) AS n, round(avg(CAST(w=0 AS INT)),4) AS share_unknown, round(sum(w*(y-p)*(y-p))/sum(w),6) AS brier FROM dims GROUP BY ALL""")
def brier_by_group(spark, d):
    return bt.brier_by(_long(spark, d)).withColumn("brier", F.round("brier", 6))


@query("weighted_auc", f"""WITH {_LONG}, pp AS (SELECT predictor, round(p,9) AS p, sum(CASE WHEN y=1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y=0 THEN w ELSE 0 END) AS neg FROM long WHERE w>0 GROUP BY ALL),
 rk AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY predictor ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM pp)
 SELECT predictor, round(sum(pos*(below+0.5*neg))/(sum(pos)*sum(neg)),6) AS auc FROM rk GROUP BY 1""")
def weighted_auc(spark, d):
    return bt.weighted_auc(_long(spark, d)).select("predictor", r6("auc"))


@query("calibration", f"""WITH {_LONG}, kn2 AS (SELECT predictor, row_id, round(p,9) AS p, y, w FROM long WHERE w>0),
 rk AS (SELECT *, row_number() OVER (PARTITION BY predictor ORDER BY p, row_id) AS rn, count(*) OVER (PARTITION BY predictor) AS n FROM kn2),
 bn AS (SELECT predictor, least(10, count(DISTINCT p)) AS bins FROM kn2 GROUP BY 1)
 SELECT predictor, CAST(greatest(ceil((rn-1)*bins/CAST(n-1 AS DOUBLE)),1)-1 AS INT) AS decile, count(*) AS n, round(sum(w),6) AS weight, round(sum(w*p)/sum(w),6) AS predicted,
  round(sum(w*y)/sum(w),6) AS observed FROM rk JOIN bn USING (predictor) GROUP BY ALL""")
def calibration(spark, d):
    out = bt.calibration(_long(spark, d, written=True))  # read for the ranks of predictions and of rows
    return out.select("predictor", "decile", "n", r6("weight"), r6("predicted"), r6("observed"))


@query("grouped_folds", f"""WITH {s.COHORT}, c AS (SELECT course_key, (row_number() OVER (ORDER BY CAST('0x'||substr(md5('0:'||course_key),1,15) AS BIGINT), course_key)-1)%5 AS fold
   FROM (SELECT DISTINCT course_key FROM cohort))
 SELECT CAST(fold AS INT) AS fold, count(DISTINCT course_key) AS courses, count(*) AS rows FROM cohort JOIN c USING (course_key) GROUP BY 1""")
def grouped_folds(spark, d):
    folded = bt.grouped_folds(cohort(spark, d), 5)
    return folded.groupBy("fold").agg(F.count_distinct("course_key").alias("courses"), F.count(F.lit(1)).alias("rows"))


@query("bootstrap_gain", f"""WITH {_SCORED}, gs AS (SELECT section_id, sum(w*(y-p_bucket)*(y-p_bucket)) AS sb, sum(w*(y-p_dept)*(y-p_dept)) AS sm, sum(w) AS sw FROM wt GROUP BY 1),
 {s.draws('pk', 'gs')}, dr AS (SELECT draw, (sum(times*sb)-sum(times*sm))/sum(times*sw) AS g FROM pk JOIN pk_n USING (number) JOIN gs USING (section_id) GROUP BY 1)
 SELECT 'dept' AS predictor, round(quantile_cont(g,0.025),6) AS gain_ci_low, round(quantile_cont(g,0.975),6) AS gain_ci_high FROM dr""")
def bootstrap_gain(spark, d):
    scored = _scored(spark, d).withColumn("predictor", F.lit("dept"))
    return boot.bootstrap_gain(scored, ["predictor"], "p_bucket", "p_dept").select("predictor", r6("gain_ci_low"), r6("gain_ci_high"))


@query("bootstrap_band", f"""WITH {s.COHORT}, days AS (SELECT DISTINCT bucket, unnest([7.0::DOUBLE, 14.0, 28.0]) AS day FROM cohort), {s.bands('bd', 'cohort', 'bucket', 'days')}
 SELECT bucket, day, round(low,6) AS low, round(high,6) AS high FROM bd""")
def bootstrap_band(spark, d):
    c = cohort(spark, d).withColumnRenamed("position_bucket", "bucket")
    counts = materialize(boot.section_counts(c, ["bucket"]))  # read for the grid, the ranges, the picks and the bands
    grid = counts.select("bucket").distinct().select("bucket", F.explode(F.array(*[F.lit(float(x)) for x in (7, 14, 28)])).alias("day"))
    return boot.curve_bands(counts, ["bucket"], grid).select("bucket", "day", r6("low"), r6("high"))


@query("score_table", f"""WITH {_WEIGHTS.replace("{pred}", _predict_sql(_TEMPORAL))},
 long AS (SELECT row_id, section_id, y, w, unnest([{{'predictor':'bucket','p':round(p_bucket,9),'fb':false}},{{'predictor':'dept','p':round(p_dept,9),'fb':false}},
   {{'predictor':'course','p':round(p_course,9),'fb':false}},{{'predictor':'site','p':round(p_site,9),'fb':site_fallback}}], recursive := true) FROM wt),
 base AS (SELECT predictor, count(*) AS n_test, count(*) FILTER (w>0) AS brier_rows, round(avg(CAST(w=0 AS INT)),4) AS share_unknown, sum(w*(y-p)*(y-p))/sum(w) AS brier,
   round(avg(CAST(fb AS INT)),4) AS share_fallback FROM long GROUP BY 1),
 pp AS (SELECT predictor, p, sum(CASE WHEN y=1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y=0 THEN w ELSE 0 END) AS neg FROM long WHERE w>0 GROUP BY ALL),
 au AS (SELECT predictor, sum(pos*(below+0.5*neg))/(sum(pos)*sum(neg)) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY predictor ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM pp) GROUP BY 1),
 gs AS (SELECT m.predictor, m.section_id, sum(m.w*(m.y-b.p)*(m.y-b.p)) AS sb, sum(m.w*(m.y-m.p)*(m.y-m.p)) AS sm, sum(m.w) AS sw FROM long m JOIN long b ON b.row_id=m.row_id AND b.predictor='bucket'
   WHERE m.predictor<>'bucket' GROUP BY ALL),
 zs AS (SELECT DISTINCT section_id FROM gs), {s.draws('pk', 'zs')},
 dr AS (SELECT predictor, draw, (sum(times*sb)-sum(times*sm))/sum(times*sw) AS g FROM pk JOIN pk_n USING (number) JOIN gs USING (section_id) GROUP BY ALL),
 ci AS (SELECT predictor, quantile_cont(g,0.025) AS lo, quantile_cont(g,0.975) AS hi FROM dr GROUP BY 1)
 SELECT predictor, n_test, brier_rows, share_unknown, round(brier,6) AS brier, share_fallback, round(auc,6) AS auc, round((SELECT brier FROM base WHERE predictor='bucket'),6) AS brier_baseline,
   round((SELECT brier FROM base WHERE predictor='bucket')-brier,6) AS gain, round(1-brier/(SELECT brier FROM base WHERE predictor='bucket'),6) AS skill,
   round(CASE WHEN predictor='bucket' THEN 0 ELSE lo END,6) AS gain_ci_low, round(CASE WHEN predictor='bucket' THEN 0 ELSE hi END,6) AS gain_ci_high
 FROM base JOIN au USING (predictor) LEFT JOIN ci USING (predictor)""")
def score_table(spark, d):
    """Every score of the curve predictors with its interval; predictions at a fixed precision, so engines see the same ties."""
    pred = _predictions(spark, d, "temporal")
    pred = pred.withColumns({f"p_{p}": F.round(f"p_{p}", 9) for p in ("bucket", "dept", "course", "site")})
    out = bt.score(pred, predictors=bt.PREDICTORS[:4])["metrics"]
    return out.select("predictor", "n_test", "brier_rows", "share_unknown", "share_fallback", *[
        r6(c) for c in ("brier", "auc", "brier_baseline", "gain", "skill", "gain_ci_low", "gain_ci_high")])


_PAST = """SELECT '{0}' AS split, (SELECT count(*) FROM train0) AS n_train, count(*) FILTER (h>0 AND follow_up+1e-9>=h) AS n_test, count(*) FILTER (NOT h>0) AS n_excluded,
   count(*) FILTER (h>0 AND follow_up+1e-9<h) AS n_unobservable FROM test0"""


def _counts_sql(split: str, ctes: str, train: str) -> str:
    return f"(WITH {s.COHORT}, {ctes}, train0 AS ({train}) {_PAST.format(split)})"


@query("backtest_counts", " UNION ALL ".join((
    _counts_sql("temporal", _TEMPORAL, "SELECT * FROM train"), _counts_sql("cross_term", _CROSS, "SELECT * FROM train"),
    _counts_sql("grouped", _GROUPED, "SELECT * FROM cohort"))))
def backtest_counts(spark, d):
    """What each split trains on, scores, and leaves out because the horizon was past or couldn't be observed."""
    c = b.cohort_from_lineitem(spark, d, dealt_out=True)
    rows = []
    for split, (train, test), which in (
            ("temporal", bt.temporal_split(c, SPLIT_AT), WHICH),
            ("cross_term", (c.where("l_linestatus = 'F'"), c.where("l_linestatus = 'O'")), "days:14"), ("grouped", (c, c), "deadline")):
        found = bt.test_counts(bt.with_horizon(test, b.CALENDAR, which))
        rows.append((split, train.count(), found["n_test"], found["n_excluded"], found["n_unobservable"]))
    return spark.createDataFrame(rows, "split string, n_train long, n_test long, n_excluded long, n_unobservable long")


def _summary_sql(run: str, split: str, which: str, label: str, ctes: str) -> str:
    return f"""(WITH {_WEIGHTS.replace("{pred}", _predict_sql(ctes))}, long AS (SELECT y, w, unnest([{{'predictor':'bucket','p':p_bucket}},{{'predictor':'dept','p':p_dept}},
   {{'predictor':'course','p':p_course}},{{'predictor':'site','p':p_site}}], recursive := true) FROM wt), sc AS (SELECT predictor, sum(w*(y-p)*(y-p))/sum(w) AS brier FROM long GROUP BY 1),
 n AS (SELECT (SELECT count(*) FROM train) AS n_train, count(*) FILTER (h>0 AND follow_up+1e-9>=h) AS n_test, count(*) FILTER (NOT h>0) AS n_excluded, count(*) FILTER (h>0 AND follow_up+1e-9<h) AS n_unobservable FROM test0)
 SELECT '{run}' AS run, '{split}' AS split, '{which}' AS "which", '{label}' AS horizon_label, n.*, round(n_test/(n_test+n_unobservable),4) AS share_observable,
   arg_min(predictor, (round(brier,4), predictor)) AS best_predictor, round(min(brier),4) AS best_brier, round(max(brier) FILTER (predictor='bucket')-min(brier),4) AS best_gain FROM sc, n GROUP BY ALL)"""


@query("backtest_summary", _summary_sql("cross_term_days14", "cross_term", "days14", "within 14 days", _CROSS) + " UNION ALL " + _summary_sql(
    "temporal_days20", "temporal", "days20", "within 20 days", _TEMPORAL))
def backtest_summary(spark, d):
    """Two runs of the curve predictors, written as reports and read back as one row each."""
    c = written_cohort(spark, d)
    folder = f"{scratch_dir(spark)}/reports-{uuid.uuid4().hex}"
    line = F.col("l_linestatus")
    for name, cohort_rows, options in (
            ("temporal_days20", c, {"split": "temporal", "which": WHICH, "split_at": SPLIT_AT}),
            ("cross_term_days14", c.where(line == "O"), {"split": "cross_term", "which": "days:14", "train_cohort": c.where(line == "F")})):
        bt.write_tables(bt.run_backtest(cohort_rows, b.CALENDAR, n_boot=0, with_cox=False, **options), f"{folder}/{name}")
    return summarise_backtests(spark, folder).drop("best_auc")


@query("backtest_scores")
def backtest_scores(spark, d):
    run = bt.run_backtest(written_cohort(spark, d), b.CALENDAR, split="temporal", which=WHICH, split_at=SPLIT_AT)
    return run.tables["metrics"]


# ------------------------------------------------------------------------------ hazards


_BETA = {"log_position": 0.2, "wl_ratio": -1.5, "days_to_instruction": 0.001, "reserved": 0.1}
_COX_VALUES = ", ".join(f"{{'n': '{n}', 'v': CAST({v} AS DOUBLE), 'b': CAST({_BETA[n]} AS DOUBLE)}}" for n, v in (
    ("log_position", "ln(position)"), ("wl_ratio", "wl_ratio"), ("days_to_instruction", "dti"),
    ("reserved", "CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END")))


@query("cox_score_at", f"""WITH {s.COHORT},
 x AS (SELECT row_id, ceil(dur/CAST(0.01 AS DOUBLE))*CAST(0.01 AS DOUBLE) AS t, event, unnest([{_COX_VALUES}]) AS c FROM cohort),
 h AS (SELECT row_id, exp(sum(c.v*c.b)) AS h FROM x GROUP BY 1),
 g AS (SELECT c.n AS covariate, any_value(c.b) AS b, t, CAST(sum(event) AS BIGINT) AS m, sum(h) AS w, sum(h*event) AS d0, sum(h*c.v) AS w1,
   sum(h*event*c.v) AS d1, sum(event*c.v) AS e1, sum(h*c.v*c.v) AS w2, sum(h*event*c.v*c.v) AS d2 FROM x JOIN h USING (row_id) GROUP BY ALL),
 r AS (SELECT *, sum(w) OVER o AS s0, sum(w1) OVER o AS s1, sum(w2) OVER o AS s2 FROM g WINDOW o AS (PARTITION BY covariate ORDER BY t DESC)),
 l AS (SELECT covariate, s0-u*d0 AS z, s1-u*d1 AS y, s2-u*d2 AS q FROM (SELECT *, unnest(generate_series(0, m-1))/CAST(m AS DOUBLE) AS u FROM r WHERE m>0)),
 e AS (SELECT covariate, sum(e1) AS e1, sum(e1*b) AS eb FROM r GROUP BY 1),
 i AS (SELECT covariate, sum(y/z) AS yz, sum(q/z-(y/z)*(y/z)) AS info, sum(ln(z)) AS logs FROM l GROUP BY 1)
 SELECT covariate, round(e1-yz, 3) AS gradient, round(info, 3) AS information, round((SELECT sum(eb) FROM e)-logs, 3) AS log_likelihood FROM e JOIN i USING (covariate)""")
def cox_score_at(spark, d):
    plain = cohort(spark, d).withColumns({c: F.lit(None).cast("string") for c in ("level", "dept_group", "phase")})
    out = cox.score_at(plain, _BETA)
    return out.select("covariate", *[F.round(c, 3).alias(c) for c in ("gradient", "information", "log_likelihood")])


# The same model at fixed coefficients in SQL: one numeric covariate, two levels as indicators, phases as strata.
_AT = {"log_position": 0.2, "level=grad": -0.3, "level=upper": 0.1}
_AT_VALUES = {"log_position": "ln(position)", "level=grad": "CAST(level='grad' AS INT)", "level=upper": "CAST(level='upper' AS INT)"}
_K = range(3)
_HAZARD = " + ".join(f"x{k}*CAST({beta} AS DOUBLE)" for k, beta in enumerate(_AT.values()))


def _each(pattern: str) -> str:
    """``pattern`` for every covariate {k}, and for every pair {k} <= {j} where it names {j}."""
    if "{j}" not in pattern:
        return ", ".join(pattern.format(k=k) for k in _K)
    return ", ".join(pattern.format(k=k, j=j) for k in _K for j in _K if k <= j)


def _entry(name: str, k: int, j: int) -> str:
    return f"{name}{min(k, j)}{max(k, j)}"


def _cofactor(name: str, k: int, j: int) -> str:
    r, c = [i for i in _K if i != k], [i for i in _K if i != j]
    return (f"{'-' if (k + j) % 2 else ''}({_entry(name, r[0], c[0])}*{_entry(name, r[1], c[1])}"
            f"-{_entry(name, r[0], c[1])}*{_entry(name, r[1], c[0])})")


def _dot(left: str, right: str) -> str:
    return "+".join(f"{left.format(i=i)}*{right.format(i=i)}" for i in _K)


#: Rows; sums per stratum and time; sums over those at risk; Efron's terms; gradient and information; the inverse.
_COX_AT = f"""{s.COHORT}, cx AS (SELECT row_id, section_id, CASE WHEN phase='phase1' THEN 'phase=ref' ELSE 'phase='||phase END AS g,
   ceil(dur/CAST(0.01 AS DOUBLE))*CAST(0.01 AS DOUBLE) AS t, event, {", ".join(f"CAST({v} AS DOUBLE) AS x{k}" for k, v in enumerate(_AT_VALUES.values()))} FROM cohort),
 hx AS (SELECT *, exp({_HAZARD}) AS h FROM cx),
 gx AS (SELECT g, t, CAST(sum(event) AS BIGINT) AS m, sum(h) AS w, sum(h*event) AS d, {_each("sum(h*x{k}) AS w{k}, sum(h*event*x{k}) AS d{k}, sum(event*x{k}) AS e{k}")},
   {_each("sum(h*x{k}*x{j}) AS w{k}{j}, sum(h*event*x{k}*x{j}) AS d{k}{j}")} FROM hx GROUP BY ALL),
 rx AS (SELECT g, t, m, d, {_each("d{k}, e{k}")}, {_each("d{k}{j}")}, sum(w) OVER o AS s, {_each("sum(w{k}) OVER o AS s{k}")}, {_each("sum(w{k}{j}) OVER o AS s{k}{j}")}
   FROM gx WINDOW o AS (PARTITION BY g ORDER BY t DESC)),
 tx AS (SELECT {_each("(s{k}-u*d{k})/(s-u*d) AS y{k}")}, {_each("(s{k}{j}-u*d{k}{j})/(s-u*d) AS q{k}{j}")} FROM (SELECT *, unnest(generate_series(0, m-1))/CAST(m AS DOUBLE) AS u FROM rx WHERE m>0)),
 ix AS (SELECT {_each("sum(y{k}) AS y{k}")}, {_each("sum(q{k}{j}-y{k}*y{j}) AS i{k}{j}")} FROM tx),
 ex AS (SELECT {_each("sum(e{k}) AS e{k}")}, CAST(sum(m) AS DOUBLE) AS events FROM rx),
 sx AS (SELECT {_each("count(*)*CAST(0.01 AS DOUBLE)*var_samp(x{k}) AS ridge{k}")} FROM cx),
 nx AS (SELECT events, {", ".join(f"e{k}-y{k}-ridge{k}*CAST({beta} AS DOUBLE) AS g{k}" for k, beta in enumerate(_AT.values()))},
   {", ".join(f"i{k}{j}" + (f"+ridge{k}" if k == j else "") + f" AS i{k}{j}" for k in _K for j in _K if k <= j)} FROM ix, ex, sx),
 vx AS (SELECT *, {", ".join(f"{_cofactor('i', k, j)}/det AS v{k}{j}" for k in _K for j in _K if k <= j)} FROM (SELECT *, {"+".join(f"i0{j}*{_cofactor('i', 0, j)}" for j in _K)} AS det FROM nx)),
 bx AS (SELECT g, t, m, {_each("s{k}/s AS a{k}, e{k}")}, sum(m/s) OVER o AS hz, {_each("sum(m/s*s{k}/s) OVER o AS z{k}")} FROM rx WINDOW o AS (PARTITION BY g ORDER BY t))"""


def _unnested(columns: dict[str, str], source: str) -> str:
    """One row per covariate from expressions in {k}."""
    rows = ", ".join("{" + ", ".join([f"'covariate': '{n}'", *[f"'{c}': {e.format(k=k)}" for c, e in columns.items()]]) + "}"
                     for k, n in enumerate(_AT))
    return f"SELECT r.* FROM (SELECT unnest([{rows}]) AS r FROM {source})"


def _at_fixed(spark, d, robust=False):
    """The cohort with those covariates alone, and the model at ``_AT``."""
    plain = cohort(spark, d).withColumns({
        **{c: F.lit(0.0) for c in ("wl_ratio", "days_to_instruction")}, "reserved": F.lit(False), "dept_group": F.lit(None).cast("string")})
    return plain, cox.evaluate(plain, _AT, strata=["phase"], robust=robust)


@query("cox_step_at", f"WITH {_COX_AT} SELECT covariate, round(gradient,3) AS gradient, round(information,3) AS information, round(step,6) AS step FROM ({_unnested({
    'gradient': 'g{k}', 'information': 'i{k}{k}', 'step': '+'.join('list_extract([' + ', '.join(_entry('v', k, i) for k in _K) + '], {k}+1)*g' + str(i) for i in _K)}, 'vx')})")
def cox_step_at(spark, d):
    _, fitted = _at_fixed(spark, d)
    information = np.linalg.inv(fitted.variance)
    rows = [(n, float(g), float(i), float(x)) for n, g, i, x in zip(fitted.names, fitted.gradient, np.diag(information), fitted.step)]
    out = spark.createDataFrame(rows, "covariate string, gradient double, information double, step double")
    return out.select("covariate", *[F.round(c, n).alias(c) for c, n in (("gradient", 3), ("information", 3), ("step", 6))])


@query("cox_robust_at", f"""WITH {_COX_AT}, ux AS (SELECT section_id, {_each("sum(event*(x{k}-a{k})-h*(x{k}*hz-z{k})) AS u{k}")} FROM hx JOIN bx USING (g, t) GROUP BY 1),
 mx AS (SELECT {_each("sum(u{k}*u{j}) AS m{k}{j}")} FROM ux),
 cv AS (SELECT {", ".join("sqrt(" + "+".join(f"{_entry('v', k, i)}*{_entry('m', i, j)}*{_entry('v', j, k)}" for i in _K for j in _K) + f") AS r{k}, sqrt(v{k}{k}) AS o{k}" for k in _K)} FROM vx, mx)
 SELECT covariate, round(robust_se,6) AS robust_se, round(model_se,6) AS model_se FROM ({_unnested({'robust_se': 'r{k}', 'model_se': 'o{k}'}, 'cv')})""")
def cox_robust_at(spark, d):
    _, fitted = _at_fixed(spark, d, robust=True)
    return fitted.summary(spark).select("covariate", r6("robust_se"), r6("model_se"))


@query("cox_ph_at", f"""WITH {_COX_AT}, dt AS (SELECT t, sum(m) AS m FROM rx GROUP BY 1),
 rk AS (SELECT t, sum(m) OVER (ORDER BY t)-m+(m+1)/CAST(2 AS DOUBLE)-((SELECT events FROM ex)+1)/2 AS rank FROM dt),
 px AS (SELECT sum(m*rank*rank) AS spread, {_each("sum(rank*(e{k}-m*a{k})) AS p{k}")} FROM bx JOIN rk USING (t)),
 st AS (SELECT {", ".join(f"pow(({'+'.join(f'p{i}*' + _entry('v', i, k) for i in _K)})*events,2)/(events*v{k}{k}*spread) AS c{k}" for k in _K)} FROM vx, px)
 SELECT covariate, round(statistic,6) AS statistic, (SELECT count(*) FROM cx) AS rows_tested FROM ({_unnested({'statistic': 'c{k}'}, 'st')})""")
def cox_ph_at(spark, d):
    _, fitted = _at_fixed(spark, d)
    return cox.ph_table(fitted, spark).select("covariate", r6("statistic"), "rows_tested")


@query("cox_predict_at", f"""WITH {_COX_AT.replace("CASE WHEN phase='phase1' THEN 'phase=ref' ELSE 'phase='||phase END", "''")},
 q AS (SELECT row_id, h, CAST(row_id%40 AS DOUBLE) AS horizon FROM hx)
 SELECT row_id, round(1-pow(exp(-coalesce(hz,0)), h),6) AS p_cox, false AS cox_fallback FROM q ASOF LEFT JOIN bx ON q.horizon>=bx.t""")
def cox_predict_at(spark, d):
    plain = cohort(spark, d).withColumns({
        **{c: F.lit(0.0) for c in ("wl_ratio", "days_to_instruction")}, "reserved": F.lit(False),
        **{c: F.lit(None).cast("string") for c in ("dept_group", "phase")}})
    fitted = cox.evaluate(plain, _AT, robust=False)
    test = plain.withColumns({"horizon": (F.col("row_id") % 40).cast("double"), "other": F.lit(0.0)})
    return cox.predict(test, fitted, "horizon", "other").select("row_id", r6("p_cox"), "cox_fallback")


@query("cox_fit")
def cox_fit(spark, d):
    return cox.fit(cohort(spark, d)).summary(spark)


@query("cox_ph_test")
def cox_ph_test(spark, d):
    c = cohort(spark, d)
    return cox.ph_table(cox.fit(c, robust=False), spark)


@query("cox_stratified")
def cox_stratified(spark, d):
    return cox.fit(cohort(spark, d), strata=["level"]).summary(spark)


@query("cox_headline")
def cox_headline(spark, d):
    return cox.headline_effects(cox.fit(cohort(spark, d)).summary(spark))


@query("cox_predict")
def cox_predict(spark, d):
    c = cohort(spark, d)
    fitted = cox.fit(c.where("l_linestatus = 'F'"), robust=False)
    test = _predictions(spark, d, "cross")
    return cox.predict(test, fitted, "horizon_days", "p_bucket").select("row_id", "p_cox", "cox_fallback")
