"""Queries over lookup tables, activity, parsers and typed names."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from turnwise.functions.scalars import curve_at, frequency, shard_of, verdict
from turnwise.operators import activity as ac
from turnwise.operators import resolve as rs
from turnwise.operators import tables as tb
from turnwise.plans import bindings as b
from turnwise.plans import sql as s
from turnwise.plans.queries_flows import TERM_FLOWS, flows, term_flows
from turnwise.plans.registry import query
from turnwise.schema import CURVE_DAYS, SELF_STUDY
from turnwise.session import materialize

r6 = lambda c, name=None: F.round(c, 6).alias(name or c)
_DAYS = ", ".join(str(float(x)) for x in CURVE_DAYS)


def cohort(spark, d):
    return b.cohort_from_lineitem(spark, d)


def counted_cohort(spark, d):
    """The cohort as tables of courses without bands read it."""
    return tb.counted(cohort(spark, d), tb.COURSE)


def _cells_sql(name: str, source: str) -> str:
    """CTE with curve points of every cell with 30 rows: kind, key, bucket, day, p, ..."""
    return f"""{name}_z AS (SELECT kind, key, b, count(*) AS n, CAST(sum(event) AS BIGINT) AS events, count(DISTINCT section_id) AS sections, max(dur) AS reach FROM {source} GROUP BY ALL HAVING count(*)>=30),
 {s.km(name + '_k', source, 'kind, key, b')},
 {name}_m AS (SELECT kind, key, b, min(CASE WHEN d>0 AND 1-surv>=0.5 THEN t END) AS med FROM {name}_k GROUP BY ALL),
 {name}_g AS (SELECT z.*, unnest(list_concat(list_filter([{_DAYS}], lambda x: x<=z.reach), CASE WHEN len(list_filter([{_DAYS}], lambda x: x<=z.reach))=0
   OR list_filter([{_DAYS}], lambda x: x<=z.reach)[-1]<z.reach THEN [round(z.reach,2)] ELSE [] END)) AS day FROM {name}_z z),
 {name} AS (SELECT g.kind, g.key, g.b AS bucket, g.day, round(1-coalesce(k.surv,1),3) AS p, round(g.reach,1) AS reach_days, round(m.med,2) AS median_days, g.n, g.events, g.sections
   FROM {name}_g g JOIN {name}_m m USING (kind, key, b) ASOF LEFT JOIN {name}_k k ON g.kind=k.kind AND g.key=k.key AND g.b=k.b AND g.day>=k.t)"""


_POOLS = f"""{s.COHORT}, pooled AS (SELECT 'all' AS kind, 'all' AS key, bucket AS b, section_id, dur, event FROM cohort UNION ALL SELECT 'dept', dept, bucket, section_id, dur, event FROM cohort
   UNION ALL SELECT 'level', level, bucket, section_id, dur, event FROM cohort), {_cells_sql('pc', 'pooled')}"""
_OWN = f"""crs AS (SELECT 'course' AS kind, course_key AS key, bucket AS b, section_id, dur, event FROM cohort), {_cells_sql('cc', 'crs')}"""


@query("pooled_curves", f"WITH {_POOLS} SELECT * FROM pc")
def pooled_curves(spark, d):
    return tb.pool_curves(cohort(spark, d), n_boot=0).drop("low", "high")


@query("pooled_curves_with_bands", f"""WITH {_POOLS}, big AS (SELECT kind, key, b AS bucket, section_id, dur, event FROM pooled JOIN pc_z USING (kind, key, b)),
 days AS (SELECT kind, key, bucket, day FROM pc), {s.bands('bd', 'big', 'kind, key, bucket', 'days')}
 SELECT pc.*, round(low,3) AS low, round(high,3) AS high FROM pc LEFT JOIN bd USING (kind, key, bucket, day)""")
def pooled_curves_with_bands(spark, d):
    return tb.curve_points(tb.pool_cells(cohort(spark, d)))


def pools(c):
    return materialize(tb.pool_tables(c, n_boot=0))


def cells(c, pool):
    return tb.course_tables(c, pool, n_boot=0)


_CELLS = f"""{_POOLS}, {_OWN}, cs AS (SELECT course_key, any_value(dept) AS dept, any_value(level) AS level, bucket, count(*) AS n_course, count(DISTINCT section_id) AS sections_course FROM cohort GROUP BY course_key, bucket),
 pk AS (SELECT DISTINCT kind, key, bucket FROM pc),
 cell AS (SELECT cs.*, n_course>=30 AS own, CASE WHEN n_course>=30 THEN NULL WHEN EXISTS (SELECT 1 FROM pk WHERE kind='dept' AND key=cs.dept AND pk.bucket=cs.bucket) THEN cs.dept
   WHEN EXISTS (SELECT 1 FROM pk WHERE kind='all' AND pk.bucket=cs.bucket) THEN 'all' END AS pooled FROM cs),
 curve AS (SELECT 'course' AS kind, key, bucket, day, p, reach_days, median_days, n, events, sections FROM cc UNION ALL SELECT kind, key, bucket, day, p, reach_days, median_days, n, events, sections FROM pc WHERE kind<>'level'),
 resolved AS (SELECT cell.*, v.reach_days, v.median_days, v.n, v.events, v.sections, coalesce(max(v.p) FILTER (v.day<=7),0) AS p7, coalesce(max(v.p) FILTER (v.day<=14),0) AS p14,
   coalesce(max(v.p) FILTER (v.day<=28),0) AS p28, max(v.p) AS p_reach FROM cell JOIN curve v ON v.bucket=cell.bucket AND
   v.kind=CASE WHEN own THEN 'course' WHEN pooled='all' THEN 'all' ELSE 'dept' END AND v.key=CASE WHEN own THEN course_key ELSE pooled END
   WHERE own OR pooled IS NOT NULL GROUP BY ALL)"""


@query("course_cells", f"WITH {_CELLS} SELECT course_key, bucket, level, dept AS dept_group, own, pooled, n_course, sections_course FROM cell WHERE own OR pooled IS NOT NULL")
def course_cells(spark, d):
    c = cohort(spark, d)
    return tb.course_pointers(c, tb.pool_keys(c)).select("course_key", "bucket", "level", "dept_group", "own", "pooled", "n_course", "sections_course")


def summaries(spark, d):
    c = counted_cohort(spark, d)
    pool = pools(c)
    return tb.summarise_cells(tb.resolve_cells(cells(c, pool), pool))


_SUMMARY = ["course_key", "bucket", "own", "pooled", "n_course", "n", "events", "sections", "reach_days", "median_days", "p7", "p14", "p28", "p_reach"]


@query("cell_summaries", f"WITH {_CELLS} SELECT {', '.join(_SUMMARY)} FROM resolved")
def cell_summaries(spark, d):
    return summaries(spark, d).select(*_SUMMARY)


@query("index_rows", f"""WITH {_CELLS} SELECT course_key, level, count(*) AS buckets, CAST(sum(n) AS BIGINT) AS cases FROM resolved GROUP BY ALL""")
def index_rows(spark, d):
    c = counted_cohort(spark, d)
    pool = pools(c)
    rows = tb.index_rows(cells(c, pool), pool)
    total = F.aggregate(F.map_values("buckets"), F.lit(0).cast("long"), lambda a, c: a + c["n"])
    return rows.select("course_key", "level", F.size("buckets").cast("long").alias("buckets"), total.alias("cases"))


@query("dept_ranking", f"""WITH {_POOLS} SELECT key AS dept, max(p) FILTER (day<=28) AS p, n, sections FROM pc WHERE kind='dept' AND bucket='6-15' AND n>=30 AND sections>=2 GROUP BY ALL""")
def dept_ranking(spark, d):
    return tb.department_ranking(pools(cohort(spark, d))).select("dept", "p", "n", "sections")


@query("fallback_cells", f"""WITH {_POOLS}, q AS (SELECT DISTINCT course_key, dept, level, bucket FROM cohort), pk AS (SELECT DISTINCT kind, key, bucket, n FROM pc)
 SELECT course_key, q.bucket, CASE WHEN a.n IS NOT NULL THEN 'dept' WHEN l.n IS NOT NULL THEN 'level' ELSE 'all' END AS source, coalesce(a.n, l.n, z.n) AS n FROM q
 LEFT JOIN pk a ON a.kind='dept' AND a.key=q.dept AND a.bucket=q.bucket LEFT JOIN pk l ON l.kind='level' AND l.key=q.level AND l.bucket=q.bucket
 LEFT JOIN pk z ON z.kind='all' AND z.bucket=q.bucket""")
def fallback_cells(spark, d):
    c = counted_cohort(spark, d)
    asked = c.times.select("course_key", F.col("dept_group").alias("dept"), "level", "bucket").distinct()
    return tb.fallback_cells(asked, pools(c)).select("course_key", "bucket", "source", "n")


@query("verdicts", f"""WITH {_POOLS} SELECT kind, key, bucket, CASE WHEN p>=CAST(0.75 AS DOUBLE) THEN 'Likely' WHEN p>=CAST(0.40 AS DOUBLE) THEN 'Could go either way' ELSE 'Unlikely' END AS verdict,
  CASE WHEN floor(p*20+0.5)=0 THEN 'Almost no one' WHEN floor(p*20+0.5)=20 THEN 'Almost everyone' ELSE 'About '||CAST(floor(p*20+0.5) AS INT)||' in 20' END AS frequency
  FROM (SELECT kind, key, bucket, max(p) FILTER (day<=28) AS p FROM pc GROUP BY ALL)""")
def verdicts(spark, d):
    p = curve_at(F.col("curve"), F.lit(28.0))["p"]
    # a point band stands in for the resampled one, which no SQL reproduces
    return pools(cohort(spark, d)).select("kind", "key", "bucket", verdict(p, p, p, F.lit(None).cast("string")).alias("verdict"), frequency(p).alias("frequency"))


def _banded(spark, d):
    """Summaries with a point band, so rankings that need one can be checked in SQL."""
    return summaries(spark, d).withColumns({"low14": F.col("p14"), "high14": F.col("p14")})


@query("course_extremes", f"""WITH {_CELLS}, r AS (SELECT *, row_number() OVER (ORDER BY p14 DESC, course_key) AS hi, row_number() OVER (ORDER BY p14, course_key DESC) AS lo, count(*) OVER () AS total
   FROM resolved WHERE own AND bucket='6-15' AND sections>=3)
 SELECT 'most' AS side, hi AS rank, course_key, p14, n, sections FROM r WHERE total>=6 AND hi<=least(10, total//2) UNION ALL SELECT 'least', lo, course_key, p14, n, sections FROM r WHERE total>=6 AND lo<=least(10, total//2)""")
def course_extremes(spark, d):
    return tb.course_extremes(_banded(spark, d)).select("side", F.col("rank").cast("long").alias("rank"), "course_key", "p14", "n", "sections")


@query("course_table", f"WITH {_CELLS} SELECT course_key, own, p14, n FROM resolved WHERE bucket='6-15' AND level='lower' AND (own OR pooled IS NULL)")
def course_table(spark, d):
    return tb.course_table(summaries(spark, d), bucket="6-15", level="lower", hide_pooled=True).select("course_key", "own", "p14", "n")


@query("insight_counts", f"""WITH {s.COHORT} SELECT count(*) AS rows, CAST(sum(event) AS BIGINT) AS events, count(DISTINCT section_id) AS sections, count(DISTINCT course_key) AS courses FROM cohort""")
def insight_counts(spark, d):
    return tb.insight_counts(cohort(spark, d))


@query("phase_curves", f"""WITH {s.COHORT}, ph AS (SELECT 'phase' AS kind, phase AS key, bucket AS b, section_id, dur, event FROM cohort), {_cells_sql('pp', 'ph')}
 SELECT key, bucket, n, coalesce(max(p) FILTER (day<=7),0) AS p7, coalesce(max(p) FILTER (day<=28),0) AS p28 FROM pp GROUP BY ALL""")
def phase_curves(spark, d):
    return tb.phase_cells(cohort(spark, d), n_boot=0).select("key", "bucket", "n", "p7", "p28")


@query("hero_curves", f"""WITH {s.COHORT}, ph AS (SELECT 'hero' AS kind, 'hero' AS key, bucket AS b, section_id, dur, event FROM cohort WHERE level='lower' AND phase='phase1'), {_cells_sql('pp', 'ph')}
 SELECT bucket, n, events, max(p) AS p_reach FROM pp GROUP BY ALL""")
def hero_curves(spark, d):
    return tb.hero_cells(cohort(spark, d), n_boot=0).select("bucket", "n", "events", F.element_at("curve", -1)["p"].alias("p_reach"))


_CAT = """sup AS (SELECT count(*) AS k FROM supplier), keyed AS (SELECT part.*, p_partkey%k AS sk FROM part, sup),
 cat AS (SELECT p_brand||' '||p_size AS course_key, p_name AS title, CASE WHEN p_partkey%4=0 THEN 'LEC' ELSE 'DIS' END AS component,
   s_name||', '||replace(s_name,'Supplier','Second') AS instructors, p_partkey FROM keyed JOIN supplier ON s_suppkey=sk)"""


def catalog(spark, d):
    """Catalog entries: parts as sections, names as titles, suppliers as instructors."""
    parts, people = b.table(spark, d, "part"), b.table(spark, d, "supplier")
    count = people.agg(F.count(F.lit(1)).alias("_k")).withColumn("_one", F.lit(1))
    rows = parts.withColumn("_one", F.lit(1)).join(F.broadcast(count), "_one").withColumn("s_suppkey", F.col("p_partkey") % F.col("_k"))
    rows = rows.join(people.select("s_suppkey", "s_name"), "s_suppkey")
    return rows.select(
        F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("course_key"), F.col("p_brand").alias("subject"),
        F.col("p_size").cast("string").alias("catalog_number"), F.col("p_name").alias("title"),
        F.when(F.col("p_partkey") % 4 == 0, "LEC").otherwise("DIS").alias("component"),
        F.concat(F.col("s_name"), F.lit(", "), F.replace(F.col("s_name"), F.lit("Supplier"), F.lit("Second"))).alias("instructors"),
        F.concat(F.lit("/content/"), F.col("p_partkey").cast("string")).alias("url_path"), F.col("p_partkey").cast("string").alias("section_id"),
        F.when(F.col("p_partkey") % 10 == 3, 404).otherwise(200).alias("last_status"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("2026-09-0"), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit("T00:00:00Z"))).alias("probed_at"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("node_id"))


@query("titles", f"""WITH {_CAT}, n AS (SELECT course_key, title, count(*) AS k, max(CASE WHEN component='LEC' THEN 1 ELSE 0 END) AS lec FROM cat GROUP BY ALL),
 best AS (SELECT course_key, title FROM (SELECT *, row_number() OVER (PARTITION BY course_key ORDER BY k DESC, lec DESC, title) AS r FROM n) WHERE r=1),
 ppl AS (SELECT course_key, string_agg(i, '|' ORDER BY i) AS instructors FROM (SELECT DISTINCT course_key, trim(unnest(string_split(instructors, ','))) AS i FROM cat) GROUP BY 1)
 SELECT course_key, title, instructors FROM best JOIN ppl USING (course_key)""")
def titles(spark, d):
    c = catalog(spark, d)
    return tb.titles_table(c.select("course_key"), c).select("course_key", "title", F.array_join("instructors", "|").alias("instructors"))


# ----------------------------------------------------------------------------- activity

_ACT = f"""{s.FLOWS}, {s.IDENTITY}, act AS (SELECT section_id, CAST(sum(wl_joins) AS BIGINT) AS wl_joins, CAST(sum(admits) AS BIGINT) AS admits, max(waitlist0) AS max_waitlist,
   round(avg(CAST(waitlist0>0 AS INT)),4) AS share_intervals_with_queue, any_value(course_key) AS course_key, any_value(subject) AS subject FROM flows LEFT JOIN ident USING (section_id) GROUP BY 1)"""


def activity(spark, d):
    return ac.section_activity(flows(spark, d), b.identity_from_events(spark, d))


@query("section_activity", f"WITH {_ACT} SELECT section_id, wl_joins, admits, max_waitlist, share_intervals_with_queue, course_key FROM act")
def section_activity(spark, d):
    return activity(spark, d).select("section_id", "wl_joins", "admits", "max_waitlist", "share_intervals_with_queue", "course_key")


@query("course_rank", f"""WITH {_ACT}, top AS (SELECT * FROM act WHERE wl_joins>0 ORDER BY wl_joins DESC, max_waitlist DESC, section_id LIMIT 40),
 tot AS (SELECT course_key, min(subject) AS subject, CAST(sum(wl_joins) AS BIGINT) AS joins, count(DISTINCT section_id) AS sections FROM act GROUP BY 1)
 SELECT tot.*, (SELECT count(DISTINCT section_id) FROM top WHERE top.course_key=tot.course_key) AS top_sections FROM tot
 WHERE course_key IN (SELECT course_key FROM top) OR joins>=90""")
def course_rank(spark, d):
    return ac.rank_courses(activity(spark, d), top_sections=40, min_course_joins=90)


@query("course_rank_terms", f"""WITH {TERM_FLOWS}, {s.IDENTITY}, act AS (SELECT split_part(section_id,'/',1) AS section_id, split_part(section_id,'/',2) AS term, CAST(sum(wl_joins) AS BIGINT) AS wl_joins,
   max(waitlist0) AS max_waitlist FROM flows0 GROUP BY ALL), both_terms AS (SELECT * FROM act JOIN ident USING (section_id)),
 top AS (SELECT * FROM both_terms WHERE wl_joins>0 ORDER BY wl_joins DESC, max_waitlist DESC, section_id, term LIMIT 40),
 tot AS (SELECT course_key, min(subject) AS subject, CAST(sum(wl_joins) AS BIGINT) AS joins, count(DISTINCT section_id) AS sections FROM both_terms GROUP BY 1)
 SELECT tot.*, (SELECT count(DISTINCT section_id) FROM top WHERE top.course_key=tot.course_key) AS top_sections FROM tot
 WHERE course_key IN (SELECT course_key FROM top) OR joins>=90""")
def course_rank_terms(spark, d):
    """Two terms' activity in one ranking."""
    both = ac.activity_of_terms(term_flows(spark, d), b.identity_from_events(spark, d))
    return ac.rank_courses(both, top_sections=40, min_course_joins=90)


PATTERNS = ["# ordered list", "s3", "S1 1*", "S2 25  # one course", "S[45] ?5", "S? *0"]


def patterns(spark):
    lines = spark.createDataFrame(list(enumerate(PATTERNS)), "line_no long, value string")
    return ac.parse_patterns(lines)


def _rank_sql(key: str) -> str:
    return f"""CASE WHEN regexp_full_match({key}, 'S3 .*') THEN 0 WHEN regexp_full_match({key}, 'S1 1.*') THEN 1 WHEN {key}='S2 25' THEN 2
  WHEN regexp_full_match({key}, 'S[45] .5') THEN 3 WHEN regexp_full_match({key}, 'S. .*0') THEN 4 END"""


@query("pattern_ranks", f"WITH {s.IDENTITY} SELECT * FROM (SELECT DISTINCT course_key, {_rank_sql('course_key')} AS rank FROM ident) WHERE rank IS NOT NULL")
def pattern_ranks(spark, d):
    return ac.course_ranks(b.identity_from_events(spark, d), patterns(spark))


@query("pattern_coverage", f"""WITH {_ACT}, m AS (SELECT *, ({_rank_sql('course_key')}) IS NOT NULL AS hit FROM act)
 SELECT count(*) AS sections, count(*) FILTER (hit) AS sections_matched, count(*) FILTER (max_waitlist>0) AS sections_with_queue, count(*) FILTER (max_waitlist>0 AND hit) AS sections_with_queue_matched,
  count(*) FILTER (wl_joins>0) AS sections_with_joins, count(*) FILTER (wl_joins>0 AND hit) AS sections_with_joins_matched, round(sum(CASE WHEN hit THEN wl_joins ELSE 0 END)/sum(wl_joins),4) AS share_joins_matched FROM m""")
def pattern_coverage(spark, d):
    return ac.pattern_coverage(activity(spark, d), patterns(spark))


@query("joins_by_course", f"""WITH {s.FLOWS}, {s.IDENTITY} SELECT course_key, CAST(sum(wl_joins) AS BIGINT) AS joins FROM flows JOIN ident USING (section_id) GROUP BY 1""")
def joins_by_course(spark, d):
    return tb.joins_by_course(b.identity_from_events(spark, d), flows(spark, d))


_SHARD = """CAST((CAST('0x'||substr(sha1('/content/'||p_partkey),1,10) AS BIGINT)%12*(CAST(1099511627776 AS BIGINT)%12)%12*(CAST(1099511627776 AS BIGINT)%12)%12*(CAST(1099511627776 AS BIGINT)%12)%12
  +CAST('0x'||substr(sha1('/content/'||p_partkey),11,10) AS BIGINT)%12*(CAST(1099511627776 AS BIGINT)%12)%12*(CAST(1099511627776 AS BIGINT)%12)%12
  +CAST('0x'||substr(sha1('/content/'||p_partkey),21,10) AS BIGINT)%12*(CAST(1099511627776 AS BIGINT)%12)%12+CAST('0x'||substr(sha1('/content/'||p_partkey),31,10) AS BIGINT)%12)%12 AS INT)"""


@query("stable_shards", f"SELECT p_partkey, {_SHARD} AS shard FROM part")
def stable_shards(spark, d):
    key = F.concat(F.lit("/content/"), F.col("p_partkey").cast("string"))
    return b.table(spark, d, "part").select("p_partkey", shard_of(key, 12).alias("shard"))


PART_PATTERNS = ["brand#3", "BRAND#1 1*", "Brand#2 25"]


def _part_patterns(spark):
    return ac.parse_patterns(spark.createDataFrame(
        [(i, v.replace("#", "N")) for i, v in enumerate(PART_PATTERNS)], "line_no long, value string"))


def _part_catalog(spark, d):
    """The catalog with brand names free of the comment sign."""
    return catalog(spark, d).withColumn("course_key", F.replace("course_key", F.lit("#"), F.lit("n")))


@query("shard_sizes", f"""WITH {_CAT}, c2 AS (SELECT upper(replace(course_key,'#','n')) AS k, {_SHARD} AS sh FROM cat WHERE p_partkey%10<>3),
 m AS (SELECT *, k LIKE 'BRANDN3 %' OR k LIKE 'BRANDN1 1%' OR k='BRANDN2 25' AS hit FROM c2),
 z AS (SELECT CASE WHEN count(*)<12 THEN 0 ELSE min(n) END AS lo, coalesce(max(n),0) AS hi FROM (SELECT count(*) AS n FROM m WHERE NOT hit GROUP BY sh))
 SELECT count(*) AS live, count(*) FILTER (hit) AS matched, count(DISTINCT k) FILTER (hit) AS courses,
  count(*) FILTER (hit)+any_value(lo) AS selection_min, count(*) FILTER (hit)+any_value(hi) AS selection_max FROM m, z""")
def shard_sizes(spark, d):
    return ac.shard_sizes(_part_catalog(spark, d), _part_patterns(spark))


@query("work_list", f"""WITH {_CAT}, c2 AS (SELECT replace(course_key,'#','n') AS course_key, upper(replace(course_key,'#','n')) AS k, '/content/'||p_partkey AS url_path, p_partkey%10=3 AS absent,
   CASE WHEN p_partkey%3=0 THEN '2026-09-0'||(p_partkey%9+1)||'T00:00:00Z' END AS probed FROM cat)
 SELECT 'priority' AS stage, url_path, course_key FROM c2 WHERE NOT absent AND (k LIKE 'BRANDN3 %' OR k LIKE 'BRANDN1 1%' OR k='BRANDN2 25')
 UNION ALL SELECT 'reprobe', url_path, course_key FROM (SELECT * FROM c2 WHERE absent AND (probed IS NULL OR CAST(probed AS TIMESTAMPTZ)<=TIMESTAMPTZ '2026-09-05 00:00:00+00') ORDER BY coalesce(probed,''), url_path LIMIT 100)""")
def work_list(spark, d):
    now = F.lit(dt.datetime(2026, 9, 12, tzinfo=dt.timezone.utc)).cast("timestamp")
    return ac.select_work(_part_catalog(spark, d), _part_patterns(spark), now).select("stage", "url_path", "course_key")


@query("catalog_merge", f"""WITH {_CAT}, old AS (SELECT '/content/'||p_partkey AS url_path, p_partkey, title, CASE WHEN p_partkey%2=0 THEN p_partkey END AS node_id FROM cat WHERE p_partkey%10<>3),
 new AS (SELECT '/content/'||p_partkey AS url_path, p_partkey AS node_id, CASE WHEN p_partkey%5=0 THEN '' ELSE upper(title) END AS title FROM cat)
 SELECT url_path, CASE WHEN new.title<>'' THEN new.title ELSE coalesce(old.title, new.title) END AS title, coalesce(old.node_id, new.node_id) AS node_id, old.url_path IS NULL AS added FROM old FULL OUTER JOIN new USING (url_path)""")
def catalog_merge(spark, d):
    c = catalog(spark, d).select("url_path", "title", "instructors", "node_id", "last_status", "section_id")
    n = F.col("section_id").cast("long")
    fresh = c.withColumns({"node_id": n, "title": F.when(n % 5 == 0, "").otherwise(F.upper("title")), "ordinal": n})
    known = c.where(F.col("last_status") != 404)
    return ac.merge_catalog(known, fresh).select("url_path", "title", "node_id", "added")


@query("nested_sample", f"""WITH {_CAT} SELECT '/content/'||p_partkey AS url_path, course_key FROM cat WHERE coalesce(component,'') NOT IN ({', '.join(f"'{c}'" for c in SELF_STUDY)})
  ORDER BY CAST('0x'||substr(md5('0:/content/'||p_partkey),1,15) AS BIGINT), url_path LIMIT 100""")
def nested_sample(spark, d):
    return ac.nested_sample(catalog(spark, d), "url_path", limit=100).select("url_path", "course_key")


@query("check_order", f"""WITH {_CAT} SELECT '/content/'||p_partkey AS url_path FROM cat
  ORDER BY CASE WHEN p_partkey%10<>3 THEN 0 ELSE 1 END, CASE WHEN upper(split_part(course_key,' ',1)) IN ('BRAND#3','BRAND#5') THEN 0 ELSE 1 END, url_path LIMIT 50""")
def check_order(spark, d):
    return ac.check_order(catalog(spark, d), ("BRAND#3", "BRAND#5"), 50).select("url_path")


# --------------------------------------------------------------------------- raw pages


@query("parse_pages", r"""SELECT page_id, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS script,
  regexp_extract(html, '(?s)^<!DOCTYPE html><html lang="([^"]*)"', 1) AS lang FROM pages""")
def parse_pages(spark, d):
    from turnwise.sources.parsers import page_title

    html = F.col("html")
    return b.table(spark, d, "pages").select(
        "page_id", page_title(html).alias("title"), F.regexp_extract(html, r"(?s)<script[^>]*>(.*?)</script>", 1).alias("script"),
        F.regexp_extract(html, r'(?s)^<!DOCTYPE html><html lang="([^"]*)"', 1).alias("lang"))


@query("section_pages", """SELECT CASE WHEN html LIKE '%drupal-settings-json%' THEN 'settings' ELSE 'none' END AS settings, count(*) AS pages FROM pages GROUP BY 1""")
def section_pages(spark, d):
    from turnwise.sources.parsers import parse_section_pages

    rows = parse_section_pages(b.table(spark, d, "pages"), dt.datetime(2026, 9, 1, tzinfo=dt.timezone.utc), "site", term_id="2268")
    has = F.when(F.array_contains("reject", "settings"), "none").otherwise("settings")
    return rows.groupBy(has.alias("settings")).agg(F.count(F.lit(1)).alias("pages"))


@query("parse_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def parse_props(spark, d):
    return b.table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("raw_sections", """SELECT event_id, CAST(user_id AS VARCHAR) AS section_id, 'EL'||(user_id%7) AS subject, 95+event_id%7 AS enrolled_count, event_type='error' AS rejected FROM events WHERE event_type<>'signup'""")
def raw_sections(spark, d):
    """Registrar pages written from the events (one section each) and parsed again."""
    from turnwise.sources.parsers import parse_registrar

    n = F.col("event_id")
    txt = lambda c: c.cast("string")
    section = F.struct(
        txt(F.col("user_id")).alias("id"), F.lit("001").alias("number"), F.struct(F.lit("LEC").alias("code")).alias("component"),
        F.struct(F.when(F.col("event_type") == "signup", "X").otherwise("A").alias("code")).alias("status"),
        F.struct(F.lit(True).alias("primary")).alias("association"),
        F.struct(F.lit("001").alias("number"), F.struct(
            F.struct(F.concat(F.lit("E L"), txt(F.col("user_id") % 7)).alias("code")).alias("subjectArea"),
            F.struct(txt(F.col("user_id") % 60 * 5).alias("formatted")).alias("catalogNumber")).alias("course"),
            F.struct(F.lit("1").alias("id"), F.struct(F.lit("2268").alias("id")).alias("term")).alias("session")).alias("class"),
        F.struct(F.struct(F.lit("O").alias("code")).alias("status"), txt(95 + n % 7).alias("enrolledCount"), F.lit("100").alias("maxEnroll"),
                 F.when(F.col("event_type") != "error", txt(F.greatest(F.lit(0), (n * 5) % 9 - 3))).alias("waitlistedCount"),
                 F.lit("20").alias("maxWaitlist")).alias("enrollmentStatus"))
    body = F.to_json(F.struct(F.struct(F.struct(F.array(section).alias("classSections")).alias("response")).alias("apiResponse")))
    raw = b.table(spark, d, "events").select(txt(n).alias("url"), body.alias("body"))
    rows = parse_registrar(raw, dt.datetime(2026, 9, 1, tzinfo=dt.timezone.utc), "registrar")
    return rows.select(F.col("url").cast("long").alias("event_id"), "section_id", "subject",
                       F.col("enrolled_count").cast("long").alias("enrolled_count"), (F.size("reject") > 0).alias("rejected"))


# -------------------------------------------------------------------------- typed names


def name_index(spark, d):
    """Courses to look up: two-word part names as subjects, sizes as numbers."""
    p = b.table(spark, d, "part")
    subject = F.upper(F.regexp_replace("p_name", " ", ""))
    rows = p.groupBy(subject.alias("subject"), F.col("p_size").cast("string").alias("number")).agg(F.count(F.lit(1)).alias("joins"))
    return rows.withColumn("course_key", F.concat_ws(" ", "subject", "number"))


def name_vocabulary(spark, d):
    """Shorthand (initials) and full names of the subjects."""
    names = b.table(spark, d, "part").select("p_name").distinct()
    subject = F.upper(F.regexp_replace("p_name", " ", ""))
    full = names.select(subject.alias("subject"), F.col("p_name").alias("name"), F.lit(0).alias("ordinal"))
    short = names.groupBy(F.upper(F.concat(F.substring("p_name", 1, 1), F.substring(F.substring_index("p_name", " ", -1), 1, 3))).alias("alias")).agg(
        F.min(subject).alias("subject"))
    nick = b.table(spark, d, "part").groupBy().agg(F.min(F.concat_ws(" ", subject, F.col("p_size").cast("string"))).alias("target")).select(
        F.lit("starter").alias("nickname"), "target")
    return rs.build_vocabulary(short, full, nick)


def typed_queries(spark, d):
    """Queries as people type them: spaced, lower case, with filler, swapped letters, bare numbers."""
    p = b.table(spark, d, "part").select("p_name", F.col("p_size").cast("string").alias("n"))
    swap = F.concat(F.substring("p_name", 2, 1), F.substring("p_name", 1, 1), F.expr("substring(p_name, 3)"))
    forms = F.array(F.concat_ws(" ", "p_name", "n"), F.concat(F.regexp_replace("p_name", " ", ""), F.col("n")),
                    F.concat_ws(" ", F.lit("class"), "p_name", "n", F.lit("lecture")), F.concat_ws(" ", swap, "n"), F.col("n"),
                    F.concat_ws(" ", "p_name", F.lit("9999")))
    return p.select(F.explode(forms).alias("query")).distinct()


@query("resolve_queries", """WITH p AS (SELECT DISTINCT p_name, p_size FROM part), q AS (SELECT p_name||' '||p_size AS query, upper(replace(p_name,' ',''))||' '||p_size AS course_key, 'exact' AS layer FROM p
  UNION SELECT replace(p_name,' ','')||p_size, upper(replace(p_name,' ',''))||' '||p_size, 'exact' FROM p
  UNION SELECT 'class '||p_name||' '||p_size||' lecture', upper(replace(p_name,' ',''))||' '||p_size, 'filler' FROM p
  UNION SELECT qq, k, 'fuzzy' FROM (SELECT qq, sub||' '||p_size AS k, row_number() OVER (PARTITION BY qq ORDER BY dd, tot DESC, sub) AS r FROM
    (SELECT a.qq, z.sub, a.p_size, tot, damerau_levenshtein(upper(replace(a.nm,' ','')), z.sub) AS dd FROM (SELECT DISTINCT substr(p_name,2,1)||substr(p_name,1,1)||substr(p_name,3) AS nm,
      substr(p_name,2,1)||substr(p_name,1,1)||substr(p_name,3)||' '||p_size AS qq, p_size FROM p) a JOIN (SELECT upper(replace(p_name,' ','')) AS sub, p_size FROM p) z USING (p_size)
      JOIN (SELECT upper(replace(p_name,' ','')) AS sub, count(*) AS tot FROM part GROUP BY 1) t USING (sub)) WHERE dd>0 AND dd<=2) WHERE r=1
  UNION SELECT p_name||' 9999', NULL, 'miss' FROM p
  UNION SELECT CAST(p_size AS VARCHAR), (SELECT k FROM (SELECT upper(replace(p_name,' ',''))||' '||p_size AS k, count(*) AS c FROM part r WHERE r.p_size=p.p_size GROUP BY 1) ORDER BY c DESC, k LIMIT 1), 'bare' FROM p)
 SELECT * FROM q""")
def resolve_queries(spark, d):
    return rs.match_courses(typed_queries(spark, d), name_index(spark, d), name_vocabulary(spark, d))


@query("title_matches", """WITH t AS (SELECT DISTINCT p_brand||' '||p_size AS course_key, p_name FROM part), j AS (SELECT p_brand||' '||p_size AS course_key, count(*) AS joins FROM part GROUP BY 1),
 b AS (SELECT p_name, course_key, row_number() OVER (PARTITION BY p_name ORDER BY joins DESC, course_key) AS r FROM (SELECT course_key, arg_min(title, (-k, title)) AS p_name FROM
   (SELECT p_brand||' '||p_size AS course_key, p_name AS title, count(*) AS k FROM part GROUP BY ALL) GROUP BY 1) JOIN j USING (course_key))
 SELECT 'the '||p_name AS query, course_key, 'title' AS layer FROM b WHERE r=1""")
def title_matches(spark, d):
    p = b.table(spark, d, "part")
    key = F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))
    index = p.groupBy(key.alias("course_key"), F.col("p_brand").alias("subject"), F.col("p_size").cast("string").alias("number")).agg(
        F.count(F.lit(1)).alias("joins"))
    entries = p.select(key.alias("course_key"), F.col("p_name").alias("title"), F.lit("DIS").alias("component"), F.lit("").alias("instructors"))
    asked = p.select(F.concat(F.lit("the "), F.col("p_name")).alias("query")).distinct()
    none = rs.build_vocabulary(spark.createDataFrame([], "alias string, subject string"), spark.createDataFrame([], "subject string, name string, ordinal int"),
                               spark.createDataFrame([], "nickname string, target string"))
    return rs.match_titles(asked, tb.titles_table(index, entries), index, none)


_NAMED = """ix AS (SELECT upper(replace(p_name,' ','')) AS subject, CAST(p_size AS VARCHAR) AS number, count(*) AS joins FROM part GROUP BY ALL),
 ky AS (SELECT *, subject||' '||number AS course_key FROM ix)"""


@query("nearest_courses", f"""WITH p AS (SELECT DISTINCT p_name, p_size FROM part), {_NAMED},
 sw AS (SELECT *, substr(p_name,2,1)||substr(p_name,1,1)||substr(p_name,3) AS nm FROM p),
 q AS (SELECT p_name||' '||p_size AS query, upper(replace(p_name,' ','')) AS token FROM p UNION SELECT replace(p_name,' ','')||p_size, upper(replace(p_name,' ','')) FROM p
   UNION SELECT 'class '||p_name||' '||p_size||' lecture', NULL FROM p UNION SELECT nm||' '||p_size, upper(replace(nm,' ','')) FROM sw
   UNION SELECT CAST(p_size AS VARCHAR), NULL FROM p UNION SELECT p_name||' 9999', upper(replace(p_name,' ','')) FROM p),
 best AS (SELECT subject, course_key, joins, row_number() OVER (PARTITION BY subject ORDER BY joins DESC, course_key) AS rank FROM ky),
 own AS (SELECT query, rank, course_key FROM q JOIN best ON token=subject WHERE rank<=3),
 lost AS (SELECT DISTINCT token FROM q WHERE token IS NOT NULL AND query NOT IN (SELECT query FROM own)),
 tot AS (SELECT subject, sum(joins) AS all_joins FROM ix GROUP BY 1),
 near AS (SELECT token, subject, all_joins, damerau_levenshtein(token, subject) AS d FROM lost JOIN tot ON abs(length(token)-length(subject))<=2),
 close AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY d, all_joins DESC, subject, joins DESC, course_key) AS rank, course_key
   FROM q JOIN near USING (token) JOIN best USING (subject) WHERE best.rank<=3 AND d BETWEEN 1 AND CASE WHEN length(token)<=5 THEN 1 ELSE 2 END),
 offered AS (SELECT * FROM own UNION ALL SELECT * FROM close WHERE rank<=3),
 top AS (SELECT row_number() OVER (ORDER BY joins DESC, course_key) AS rank, course_key FROM ky)
 SELECT query, CAST(rank AS INT) AS rank, course_key FROM offered UNION ALL
 SELECT query, CAST(rank AS INT), course_key FROM (SELECT DISTINCT query FROM q WHERE query NOT IN (SELECT query FROM offered)) JOIN top ON rank<=3""")
def nearest_courses(spark, d):
    return rs.nearest_courses(typed_queries(spark, d), name_index(spark, d), name_vocabulary(spark, d))


@query("suggest_courses", f"""WITH {_NAMED}, al AS (SELECT upper(substr(p_name,1,1)||substr(split_part(p_name,' ',-1),1,3)) AS alias, min(upper(replace(p_name,' ',''))) AS subject FROM part GROUP BY 1),
 q AS (SELECT DISTINCT substr(p_name,1,5) AS query, upper(replace(substr(p_name,1,5),' ','')) AS token, '' AS number FROM part
   UNION SELECT p_name||' '||substr(CAST(p_size AS VARCHAR),1,1), upper(replace(p_name,' ','')), substr(CAST(p_size AS VARCHAR),1,1) FROM part
   UNION SELECT 'class '||p_name||' '||p_size, NULL, NULL FROM part UNION SELECT CAST(p_size AS VARCHAR), NULL, CAST(p_size AS VARCHAR) FROM part),
 c AS (SELECT query, token AS code, number FROM q WHERE token IS NOT NULL UNION SELECT query, al.subject, number FROM q JOIN al ON al.alias=token),
 h AS (SELECT query, course_key, joins, max(CASE WHEN subject=code THEN 2 ELSE 1 END + CASE WHEN c.number<>'' AND subject=token AND ky.number=c.number THEN 10 ELSE 0 END) AS score
   FROM (SELECT c.*, q.token FROM c JOIN q USING (query)) c JOIN ky ON starts_with(subject, code) AND starts_with(ky.number, c.number) GROUP BY ALL
   UNION ALL SELECT query, course_key, joins, 0 FROM q JOIN ky ON token IS NULL AND ky.number=q.number
   UNION ALL SELECT query, course_key, joins, 0 FROM (SELECT DISTINCT 'class '||p_name||' '||p_size AS query, upper(replace(p_name,' ',''))||' '||p_size AS course_key FROM part) JOIN ky USING (course_key))
 SELECT query, CAST(rank AS INT) AS rank, course_key FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, joins DESC, course_key) AS rank FROM h) WHERE rank<=8""")
def suggest_courses(spark, d):
    """Beginnings of names, names with a first digit, names behind a filler word, and bare numbers."""
    size = F.col("p_size").cast("string")
    forms = F.array(F.substring("p_name", 1, 5), F.concat_ws(" ", "p_name", F.substring(size, 1, 1)),
                    F.concat_ws(" ", F.lit("class"), "p_name", size), size)
    return rs.suggest_courses(b.table(spark, d, "part").select(F.explode(forms).alias("query")),
                              name_index(spark, d), name_vocabulary(spark, d))


# ---------------------------------------------------------------------- course rankings

_JOINED = f"""{_CELLS}, jn AS (SELECT course_key, count(*) AS joins FROM cohort GROUP BY 1),
 ix AS (SELECT r.course_key, any_value(r.dept) AS subject, any_value(joins) AS joins, coalesce(bool_or(own AND bucket='6-15'), false) AS stands, bool_or(own) AS any_own,
   coalesce(bool_or(bucket='6-15' AND coalesce(pooled,'')<>'all'), false) AS fit FROM resolved r JOIN jn USING (course_key) GROUP BY 1)"""


def ranked_index(spark, d):
    """The index with the number of joiners standing in for reconstructed joins."""
    c = counted_cohort(spark, d)
    pool = pools(c)
    joins = c.times.groupBy("course_key").agg(F.sum("n").alias("joins"))
    return tb.index_rows(cells(c, pool), pool, joins)


@query("top_courses", f"WITH {_JOINED} SELECT course_key, joins FROM ix ORDER BY CASE WHEN stands THEN 0 WHEN any_own THEN 1 ELSE 2 END, joins DESC, course_key LIMIT 10")
def top_courses(spark, d):
    return tb.top_courses(ranked_index(spark, d), 10).select("course_key", "joins")


@query("related_courses", f"""WITH {_JOINED} SELECT * FROM (SELECT a.course_key, row_number() OVER (PARTITION BY a.course_key ORDER BY z.joins DESC, z.course_key) AS rank, z.course_key AS related,
  z.joins AS related_joins FROM ix a JOIN ix z ON z.subject=a.subject AND z.course_key<>a.course_key AND z.fit) WHERE rank<=5""")
def related_courses(spark, d):
    out = tb.related_courses(materialize(ranked_index(spark, d)))
    return out.select("course_key", F.col("rank").cast("long").alias("rank"), "related", "related_joins")
