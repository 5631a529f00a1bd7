"""Lookup tables: pooled curve cells, course cells with pointers, index and rankings."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.scalars import curve_at
from turnwise.operators import km
from turnwise.operators.boot import N_BOOT, curve_bands, section_counts
from turnwise.operators.scans import step_lookup

from turnwise.schema import BUCKET_ORDER, CURVE_DAYS, HORIZONS, LEVEL_ORDER, PHASE_ORDER
from turnwise.session import checked_broadcast, counted_broadcast, lookup_side, materialize

MIN_N = 30
CELL = ["kind", "key", "bucket"]


def category_rank(value: Column, order: Sequence[str]) -> Column:
    """Sort key: the listed order first, everything else after it (then by name)."""
    out = None
    for i, name in enumerate(order):
        out = F.when(value == name, i) if out is None else out.when(value == name, i)
    return out.otherwise(len(order))


def pool_cells(cohort: DataFrame, kinds: dict[str, Column] | None = None) -> DataFrame:
    """One row per joiner and pool it belongs to: all, its department, its level."""
    keep = cohort.withColumn("_pool", F.explode(_pools(kinds)))
    return keep.select("_pool.kind", "_pool.key", F.col("position_bucket").alias("bucket"), "section_id",
                       "duration_days", "event").where(F.col("key").isNotNull())


def _pools(kinds: dict[str, Column] | None) -> Column:
    kinds = kinds or {"all": F.lit("all"), "dept": F.col("dept_group"), "level": F.col("level")}
    return F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in kinds.items()])


def _with_sections(sizes: DataFrame, sections: DataFrame) -> DataFrame:
    """A cell without any named section, or without a bucket, has none in ``sections``."""
    named = sections.select(*[F.col(c).alias(f"_{c}") for c in CELL], "sections")
    same = F.lit(True)
    for c in CELL:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return sizes.join(named, same, "left").select(
        *CELL, "n", "events", F.coalesce("sections", F.lit(0)).alias("sections"), "_reach")


@dataclass(frozen=True)
class Counted:
    """A cohort reduced to what tables without bands read of it, see ``counted``.

    ``times`` has rows ``n`` and events ``d`` by attributes, bucket and ``t``, ``named`` the number of ``sections`` by
    attributes and bucket. ``several`` has the attributes of the sections that have more than one set of them in a
    bucket, and is None where there is no such section.
    """

    times: DataFrame
    named: DataFrame
    several: DataFrame | None


def counted(cohort: DataFrame, attributes: Sequence[str]) -> Counted:
    """Reduce a cohort by the columns ``attributes``, in one reading: all pools and courses are made from the result."""
    keys = [*attributes, "bucket"]
    rows = cohort.select("section_id", *attributes, F.col("position_bucket").alias("bucket"), F.col("duration_days").alias("t"), "event")
    by_time, by_section = [*keys, "t"], [*keys, "section_id"]
    both = materialize(rows.groupingSets([by_time, by_section], *keys, "t", "section_id").agg(
        F.grouping("t").alias("_named"), F.count(F.lit(1)).alias("n"), F.sum("event").alias("d")))
    times = both.where("_named = 0").select(*by_time, "n", "d")
    seen = both.where("_named = 1 AND section_id IS NOT NULL").select(*by_section)
    named = materialize(seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("sections")))
    often = materialize(seen.groupBy("section_id", "bucket").agg(F.count(F.lit(1)).alias("_sets")).where("_sets > 1"))
    found = often.count()
    if not found:
        return Counted(times, named, None)
    often = counted_broadcast(often.select(F.col("section_id").alias("_s"), F.col("bucket").alias("_b")), found)
    same = (F.col("section_id") == F.col("_s")) & F.col("bucket").eqNullSafe(F.col("_b"))
    return Counted(times, named, materialize(seen.join(often, same, "left_semi")))


def _pooled(rows: DataFrame, kinds: dict[str, Column] | None, *columns: str) -> DataFrame:
    """Rows with ``bucket`` and ``columns`` once for each pool they belong to."""
    return rows.withColumn("_pool", F.explode(_pools(kinds))).select(
        "_pool.kind", "_pool.key", "bucket", *columns).where(F.col("key").isNotNull())


def pool_sections(counts: Counted, kinds: dict[str, Column] | None = None) -> DataFrame:
    """Number of ``sections`` per pool and bucket. A section is counted once for each of its sets of attributes; only
    those with several in a bucket are looked at by name, to take off what was counted too much."""
    summed = _pooled(counts.named, kinds, "sections")
    if counts.several is not None:
        again = _pooled(counts.several, kinds, "section_id").groupBy(*CELL, "section_id").agg(F.count(F.lit(1)).alias("_times"))
        summed = summed.unionByName(again.select(*CELL, (1 - F.col("_times")).alias("sections")))
    return summed.groupBy(*CELL).agg(F.sum("sections").alias("sections"))


def pool_curves(cohort: DataFrame | Counted, kinds: dict[str, Column] | None = None, min_n: int = MIN_N, *,
                n_boot: int = N_BOOT, seed: int = 0) -> DataFrame:
    """``curve_points`` of the cohort's pools. Without bands no (section, time) counts are needed, only those by time."""
    if n_boot > 0:
        return curve_points(pool_cells(cohort, kinds), min_n, n_boot=n_boot, seed=seed)
    if isinstance(cohort, DataFrame):
        pools = kinds or {"dept": F.col("dept_group"), "level": F.col("level")}
        cohort = counted(cohort.select("section_id", "position_bucket", "duration_days", "event", *[
            v.alias(f"_kind_{k}") for k, v in pools.items()]), [f"_kind_{k}" for k in pools])
        kinds = {**({} if kinds else {"all": F.lit("all")}), **{k: F.col(f"_kind_{k}") for k in pools}}
    cells = _pooled(cohort.times, kinds, "t", "n", "d")
    return curve_points(cells, min_n, n_boot=0, sections=pool_sections(cohort, kinds))


def curve_points(cells: DataFrame, min_n: int = MIN_N, *, n_boot: int = N_BOOT, seed: int = 0,
                 sections: DataFrame | None = None) -> DataFrame:
    """Curve cells with at least ``min_n`` rows: one row per cell and grid day.

    The grid is the fixed days inside the cell's follow-up plus its end. Where no bands are asked for, ``sections`` (per
    cell) may be given; ``cells`` then has rows ``n`` and events ``d`` by ``t`` instead of the cell's rows.
    """
    if sections is None:
        # a cell's names are many bytes in a row per section and time, so its number goes through the shuffles
        sizes = cells.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"), F.max("duration_days").alias("_reach"))
        sizes = materialize(sizes.where(F.col("n") >= min_n).withColumn("_cell", F.monotonically_increasing_id()))
        names = checked_broadcast(sizes.select(*CELL, "_cell"))
        rows = cells.join(names, CELL).select("_cell", "section_id", "duration_days", "event")
        counts = materialize(section_counts(rows, ["_cell"]))  # sections, curves and bands all read it
        named = materialize(counts.select("_cell", "section_id").distinct())
        sizes = lookup_side(sizes.join(named.groupBy("_cell").agg(F.count("section_id").alias("sections")), "_cell"))
        events = materialize(counts.groupBy("_cell", "t").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
                             .join(names, "_cell").select(*CELL, "t", "n", "d"))
    else:
        every = materialize(cells.groupBy(*CELL, "t").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
        sizes = every.groupBy(*CELL).agg(
            F.sum("n").alias("n"), F.sum("d").alias("events"), F.max("t").alias("_reach")).where(F.col("n") >= min_n)
        sizes = lookup_side(_with_sections(sizes, sections))
        events = every.join(sizes.select(*CELL), CELL, "left_semi")
    points = km.curves(events, CELL)
    median = km.medians(points, CELL).select(*CELL, "median_days")
    fixed = F.filter(F.array(*[F.lit(float(d)) for d in CURVE_DAYS]), lambda d: d <= F.col("_reach"))
    grid = F.when(F.size(fixed) == 0, F.array(F.round("_reach", 2))).when(
        F.try_element_at(fixed, F.lit(-1)) < F.col("_reach"), F.concat(fixed, F.array(F.round("_reach", 2)))
    ).otherwise(fixed)
    asked = lookup_side(median.join(sizes, CELL)).select(
        *CELL, "n", "events", "sections", F.col("_reach").alias("reach"), "median_days", F.explode(grid).alias("day"))
    read = step_lookup(asked, points, CELL, "day", "t", "survival", "_s")
    if n_boot > 0:
        bands = curve_bands(counts, ["_cell"], asked.join(names, CELL).select("_cell", "day"), n_boot=n_boot, seed=seed, sections=named)
        read = read.join(bands.join(names, "_cell").drop("_cell"), [*CELL, "day"], "left")
    else:
        read = read.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    return read.select(
        *CELL, "day", F.round(F.lit(1.0) - F.col("_s"), 3).alias("p"), F.round("low", 3).alias("low"),
        F.round("high", 3).alias("high"), F.round("reach", 1).alias("reach_days"),
        F.round("median_days", 2).alias("median_days"), "n", "events", "sections")


def assemble(points: DataFrame) -> DataFrame:
    """Curve cells as one row with the curve as an array of (day, p, low, high).

    A curve has at most one entry per grid day, so the array is bounded.
    """
    return points.groupBy(*CELL).agg(
        F.array_sort(F.collect_list(F.struct("day", "p", "low", "high"))).alias("curve"),
        *[F.first(c).alias(c) for c in ("reach_days", "median_days", "n", "events", "sections")])


def pool_tables(cohort: DataFrame | Counted, *, min_n: int = MIN_N, n_boot: int = N_BOOT, seed: int = 0) -> DataFrame:
    """Curve cells for all, department and level pools by bucket. Without bands a ``Counted`` by them serves as well."""
    return assemble(pool_curves(cohort, None, min_n, n_boot=n_boot, seed=seed))


#: What tables of courses read of a cohort; by these a cohort is ``counted`` for them.
COURSE = ("course_key", "subject", "catalog_number", "level", "dept_group")


def course_attributes(cohort: DataFrame) -> DataFrame:
    return cohort.where(F.col("course_key").isNotNull()).groupBy("course_key").agg(
        *[F.min(c).alias(c) for c in COURSE[1:]])


def _course_sizes(cohort: DataFrame | Counted) -> DataFrame:
    if isinstance(cohort, DataFrame):
        return cohort.groupBy("course_key", F.col("position_bucket").alias("bucket")).agg(
            F.count(F.lit(1)).alias("n_course"), F.count_distinct("section_id").alias("sections_course"))
    rows = cohort.times.groupBy("course_key", "bucket").agg(F.sum("n").alias("n_course"))
    sections = pool_sections(cohort, {"course": F.col("course_key")}).select(
        F.col("key").alias("_key"), F.col("bucket").alias("_bucket"), "sections")
    same = (F.col("course_key") == F.col("_key")) & F.col("bucket").eqNullSafe(F.col("_bucket"))
    return rows.join(sections, same, "left").select(
        "course_key", "bucket", "n_course", F.coalesce("sections", F.lit(0)).alias("sections_course"))


def pool_keys(cohort: DataFrame, min_n: int = MIN_N) -> DataFrame:
    """kind, key and bucket of the pools that have a curve, from row counts alone."""
    bucket = F.col("position_bucket").alias("bucket")
    dept = cohort.where(F.col("dept_group").isNotNull()).groupBy(F.lit("dept").alias("kind"), F.col("dept_group").alias("key"), bucket)
    every = cohort.groupBy(F.lit("all").alias("kind"), F.lit("all").alias("key"), bucket)
    counted = dept.agg(F.count(F.lit(1)).alias("n")).unionByName(every.agg(F.count(F.lit(1)).alias("n")))
    return counted.where(F.col("n") >= min_n).drop("n")


def course_tables(cohort: DataFrame | Counted, pools: DataFrame, *, min_n: int = MIN_N, n_boot: int = N_BOOT,
                  estimate_level: str = "course", seed: int = 0) -> DataFrame:
    """Per course and bucket: its own curve, or a pointer to the pool standing in, see ``course_pointers``.

    Without bands a cohort ``counted`` by ``COURSE`` serves as well.
    """
    cells = course_pointers(cohort, pools.select("kind", "key", "bucket").distinct(), min_n=min_n, estimate_level=estimate_level)
    if estimate_level == "course":
        curves = assemble(pool_curves(cohort, {"course": F.col("course_key")}, min_n, n_boot=n_boot, seed=seed)).drop("kind") \
            .withColumnRenamed("key", "course_key")
        return cells.join(curves, ["course_key", "bucket"], "left")
    return cells.withColumns({
        "curve": F.lit(None).cast("array<struct<day:double,p:double,low:double,high:double>>"),
        **{c: F.lit(None).cast(k) for c, k in (("reach_days", "double"), ("median_days", "double"), ("n", "long"),
                                               ("events", "long"), ("sections", "long"))}})


def course_pointers(cohort: DataFrame | Counted, have: DataFrame, *, min_n: int = MIN_N, estimate_level: str = "course") -> DataFrame:
    """Sizes per course and bucket, and what stands for it, without any curve.

    ``pooled`` is null for an own curve, else the department or ``all``; cells
    without any pool in ``have`` (kind, key, bucket) are left out.
    """
    if estimate_level not in ("dept", "course"):
        raise ValueError(f"estimate_level must be dept or course, got {estimate_level!r}")
    sizes = _course_sizes(cohort).where(F.col("course_key").isNotNull())
    rows = cohort if isinstance(cohort, DataFrame) else cohort.times
    cells = sizes.join(course_attributes(rows), "course_key")
    dept = have.where("kind = 'dept'").select(F.col("key").alias("dept_group"), "bucket", F.lit(True).alias("_dept"))
    every = have.where("kind = 'all'").select("bucket", F.lit(True).alias("_all"))
    cells = cells.join(dept, ["dept_group", "bucket"], "left").join(every, "bucket", "left")
    own = F.lit(estimate_level == "course") & (F.col("n_course") >= min_n)
    pooled = F.when(own, F.lit(None)).when(F.col("_dept"), F.col("dept_group")).when(F.col("_all"), F.lit("all"))
    cells = cells.withColumn("own", own).withColumn("pooled", pooled).where(F.col("own") | F.col("pooled").isNotNull())
    return cells.drop("_dept", "_all")


CELL_FIELDS = ("curve", "reach_days", "median_days", "n", "events", "sections")


def resolve_cells(cells: DataFrame, pools: DataFrame) -> DataFrame:
    """Replace pointers by the pool's curve and numbers (the course's own counts stay)."""
    target = F.when(F.col("pooled") == "all", F.lit("all")).when(F.col("pooled").isNotNull(), F.lit("dept"))
    pool = pools.where(F.col("kind").isin("all", "dept")).select(
        F.col("kind").alias("_kind"), F.col("key").alias("_key"), F.col("bucket").alias("_bucket"),
        *[F.col(c).alias(f"_p_{c}") for c in CELL_FIELDS])
    joined = cells.withColumn("_target", target).join(
        pool, (F.col("_target") == F.col("_kind")) & (F.col("pooled") == F.col("_key"))
        & (F.col("bucket") == F.col("_bucket")), "left")
    kept = [c for c in cells.columns if c not in CELL_FIELDS]
    return joined.where(F.col("own") | F.col("_key").isNotNull()).select(
        *kept, *[F.when(F.col("own"), F.col(c)).otherwise(F.col(f"_p_{c}")).alias(c) for c in CELL_FIELDS])


def fallback_cells(asked: DataFrame, pools: DataFrame) -> DataFrame:
    """For courses without a cell: the department's curve, else the level's, else all.

    ``asked`` has ``dept, level, bucket``; adds ``source`` and the cell's fields.
    """
    def rung(kind: str, on: Column, tag: str) -> tuple[DataFrame, Column]:
        side = pools.where(F.col("kind") == kind).select(
            F.col("key").alias(f"_{tag}_key"), F.col("bucket").alias(f"_{tag}_bucket"),
            F.struct(*CELL_FIELDS).alias(f"_{tag}"))
        return side, (on == F.col(f"_{tag}_key")) & (F.col("bucket") == F.col(f"_{tag}_bucket"))

    out = asked
    for kind, on, tag in (("dept", F.col("dept"), "d"), ("level", F.col("level"), "l"), ("all", F.lit("all"), "a")):
        side, cond = rung(kind, on, tag)
        out = out.join(side, cond, "left")
    source = F.when(F.col("_d").isNotNull(), "dept").when(F.col("_l").isNotNull(), "level") \
        .when(F.col("_a").isNotNull(), "all")
    return out.select(*asked.columns, source.alias("source"), F.coalesce("_d", "_l", "_a").alias("_cell")) \
        .select(*asked.columns, "source", "_cell.*")


def summarise_cells(cells: DataFrame) -> DataFrame:
    """Shares and bands at 7, 14 and 28 days and at the reach, without the curve."""
    reads = {f"_c{int(h)}": curve_at(F.col("curve"), F.lit(h)) for h in HORIZONS}
    out = cells.withColumns(reads)
    for h in HORIZONS:
        c = F.col(f"_c{int(h)}")
        out = out.withColumns({f"p{int(h)}": F.coalesce(c["p"], F.lit(0.0)), f"low{int(h)}": c["low"],
                               f"high{int(h)}": c["high"]})
    out = out.withColumn("p_reach", F.element_at("curve", -1)["p"])
    return out.drop("curve", *reads)


def joins_by_course(cohort: DataFrame, flows: DataFrame) -> DataFrame:
    """Reconstructed joins per course, over the sections the cohort knows."""
    course = cohort.groupBy("section_id").agg(F.min("course_key").alias("course_key"))
    per_section = flows.groupBy("section_id").agg(F.sum("wl_joins").alias("joins"))
    return per_section.join(course, "section_id").where(F.col("course_key").isNotNull()) \
        .groupBy("course_key").agg(F.sum("joins").alias("joins"))


def index_rows(cells: DataFrame, pools: DataFrame, joins: DataFrame | None = None) -> DataFrame:
    """One row per course with a map of bucket summaries (at most four entries)."""
    summary = summarise_cells(resolve_cells(cells, pools))
    shown = [c for c in summary.columns if c not in ("course_key", "subject", "catalog_number", "level",
                                                     "dept_group", "bucket", "own")]
    rows = summary.groupBy("course_key", "subject", "catalog_number", "level", "dept_group").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", F.struct(*shown)))).alias("buckets"))
    if joins is None:
        return rows.withColumn("joins", F.lit(None).cast("long"))
    return rows.join(joins, "course_key", "left").withColumn("joins", F.coalesce("joins", F.lit(0)))


# ----------------------------------------------------------------- insights, rankings


def insight_counts(cohort: DataFrame) -> DataFrame:
    return cohort.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("event"), F.lit(0)).alias("events"),
                      F.count_distinct("section_id").alias("sections"),
                      F.count_distinct("course_key").alias("courses"))


def hero_cells(cohort: DataFrame, *, min_n: int = MIN_N, n_boot: int = N_BOOT) -> DataFrame:
    """Curves by bucket for lower-level courses joined in the first phase."""
    cut = cohort.where((F.col("level") == "lower") & (F.col("phase") == "phase1"))
    return assemble(pool_curves(cut, {"hero": F.lit("hero")}, min_n, n_boot=n_boot))


def phase_cells(cohort: DataFrame, *, min_n: int = MIN_N, n_boot: int = N_BOOT) -> DataFrame:
    return summarise_cells(assemble(pool_curves(cohort, {"phase": F.col("phase")}, min_n, n_boot=n_boot)))


def ordered_cells(cells: DataFrame) -> DataFrame:
    """Cells with their display order: phases, levels and buckets in their own order."""
    rank = F.when(F.col("kind") == "phase", category_rank(F.col("key"), PHASE_ORDER)).when(
        F.col("kind") == "level", category_rank(F.col("key"), LEVEL_ORDER)).otherwise(F.lit(0))
    return cells.withColumns({"key_rank": rank, "bucket_rank": category_rank(F.col("bucket"), BUCKET_ORDER)})


def department_ranking(pools: DataFrame, bucket: str = "6-15", day: float = 28.0, *, min_n: int = 30,
                       min_sections: int = 2) -> DataFrame:
    """Departments by share cleared within ``day`` days, best first."""
    rows = pools.where((F.col("kind") == "dept") & (F.col("bucket") == bucket) & (F.col("n") >= min_n)
                       & (F.col("sections") >= min_sections))
    at = curve_at(F.col("curve"), F.lit(float(day)))
    return rows.select(F.col("key").alias("dept"), F.coalesce(at["p"], F.lit(0.0)).alias("p"), at["low"].alias("low"),
                       at["high"].alias("high"), "n", "sections").orderBy(F.desc("p"), "dept")


def course_extremes(summaries: DataFrame, *, bucket: str = "6-15", most: int = 10, min_sections: int = 3) -> DataFrame:
    """Courses with their own curve that moved most and least; none below six courses.

    ``summaries`` are resolved course cells with ``p14``; ranks come from a
    top-k on each side, so nothing is ordered globally.
    """
    rows = summaries.where(F.col("own") & (F.col("bucket") == bucket) & (F.col("sections") >= min_sections)
                           & F.col("low14").isNotNull())
    total = rows.agg(F.count(F.lit(1)).alias("_total")).withColumn("_one", F.lit(1))
    cols = ["course_key", "p14", "low14", "high14", "n", "sections"]
    window = Window.partitionBy("side").orderBy("_o1", "course_key_order")
    best = rows.orderBy(F.desc("p14"), "course_key").limit(most).select(
        F.lit("most").alias("side"), *cols, (-F.col("p14")).alias("_o1"), F.col("course_key").alias("course_key_order"))
    worst = rows.orderBy(F.asc("p14"), F.desc("course_key")).limit(most).select(
        F.lit("least").alias("side"), *cols, F.col("p14").alias("_o1"), F.col("course_key").alias("course_key_order"))
    # within the least side, later names come first among equal shares
    ranked_best = best.withColumn("rank", F.row_number().over(window))
    ranked_worst = worst.withColumn("rank", F.row_number().over(
        Window.partitionBy("side").orderBy(F.asc("_o1"), F.desc("course_key_order"))))
    both = ranked_best.unionByName(ranked_worst).withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    limit = F.least(F.lit(most), F.floor(F.col("_total") / 2))
    return both.where((F.col("_total") >= 6) & (F.col("rank") <= limit)).select("side", "rank", *cols)


def course_table(summaries: DataFrame, *, bucket: str, sort: str = "p14", descending: bool = True,
                 hide_pooled: bool = False, estimate_level: str = "course", dept: str | None = None,
                 level: str | None = None, subject_prefix: str | None = None,
                 number_prefix: str | None = None) -> DataFrame:
    """The filterable course list: nulls last in either direction, key as tie-break."""
    rows = summaries.where(F.col("bucket") == bucket)
    if hide_pooled:
        rows = rows.where((F.coalesce("pooled", F.lit("")) != "all") if estimate_level == "dept" else F.col("own"))
    if dept is not None:
        rows = rows.where(F.col("dept_group") == dept)
    if level is not None:
        rows = rows.where(F.col("level") == level)
    if subject_prefix:
        tight = F.regexp_replace("course_key", r"\s+", "")
        rows = rows.where(F.col("subject").startswith(subject_prefix) | tight.startswith(subject_prefix))
    if number_prefix:
        rows = rows.where(F.col("catalog_number").startswith(number_prefix))
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return rows.orderBy(key, "course_key")


def top_courses(index: DataFrame, n: int = 3, bucket: str = "6-15") -> DataFrame:
    """Most-joined courses that stand on their own at ``bucket``; filled from courses
    with any own cell, then from the rest."""
    cell = F.col("buckets")[bucket]
    stands = cell.isNotNull() & (cell["pooled"].isNull() | ((cell["pooled"] != "all") & (F.coalesce(cell["n_course"], F.lit(0)) >= 30)))
    any_own = F.exists(F.map_values("buckets"), lambda c: c["pooled"].isNull())
    tier = F.when(F.coalesce(stands, F.lit(False)), 0).when(any_own, 1).otherwise(2)
    return index.withColumn("tier", tier).orderBy("tier", F.desc("joins"), "course_key").limit(n)


def related_courses(index: DataFrame, bucket: str = "6-15", n: int = 5) -> DataFrame:
    """Up to ``n`` other courses of each course's subject, most-joined first.

    Every course of a subject sees the subject's first ``n + 1`` courses, which
    always contain its own ``n`` others, so no pairs beyond those are formed.
    """
    cell = F.col("buckets")[bucket]
    fit = index.where(cell.isNotNull() & (F.coalesce(cell["pooled"], F.lit("")) != "all"))
    rank = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("joins"), "course_key"))
    best = fit.select("subject", F.col("course_key").alias("related"), F.col("joins").alias("related_joins"),
                      rank.alias("_r")).where(F.col("_r") <= n + 1)
    pairs = index.select("course_key", "subject").join(best, "subject").where(F.col("course_key") != F.col("related"))
    order = F.row_number().over(Window.partitionBy("course_key").orderBy(F.desc("related_joins"), "related"))
    return pairs.withColumn("rank", order).where(F.col("rank") <= n).select("course_key", "rank", "related", "related_joins")


def titles_table(index_keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Most common title per course (lecture titles, then names, break ties) and the
    sorted union of instructors."""
    known = entries.join(index_keys.select("course_key").distinct(), "course_key", "left_semi")
    title = F.trim(F.coalesce("title", F.lit("")))
    counts = known.where(title != "").groupBy("course_key", title.alias("title")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.upper("component") == "LEC", 1).otherwise(0)).alias("_lec"))
    best = counts.groupBy("course_key").agg(
        F.min_by("title", F.struct(-F.col("_n"), -F.col("_lec"), F.col("title"))).alias("title"))
    people = known.select("course_key", F.explode(F.split(F.coalesce("instructors", F.lit("")), ",")).alias("_p"))
    people = people.select("course_key", F.trim("_p").alias("_p")).where("_p <> ''").distinct()
    names = people.groupBy("course_key").agg(F.array_sort(F.collect_list("_p")).alias("instructors"))
    return best.join(names, "course_key", "full_outer").select(
        "course_key", F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("instructors", F.array().cast("array<string>")).alias("instructors"))
