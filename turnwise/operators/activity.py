"""Section activity, course ranking, ordered patterns, work selection."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.scalars import normalise_course, seeded_order, shard_of
from turnwise.operators.scans import Scan, plan_splits, scan
from turnwise.schema import SELF_STUDY

MAX_REPROBES = 100
REPROBE_DAYS = 7


def section_activity(flows: DataFrame, identity: DataFrame) -> DataFrame:
    """Joins, admits, longest queue and share of intervals with a queue per section."""
    act = flows.groupBy("section_id").agg(
        F.sum("wl_joins").alias("wl_joins"), F.sum("admits").alias("admits"),
        F.max("waitlist0").alias("max_waitlist"),
        F.round(F.avg((F.col("waitlist0") > 0).cast("int")), 4).alias("share_intervals_with_queue"))
    who = identity.select("section_id", "course_key", "subject", "catalog_number")
    return act.join(who, "section_id", "left")


def activity_of_terms(flows: DataFrame, identity: DataFrame) -> DataFrame:
    """Section activity of several terms, one row per term and section: what a ranking over terms takes.

    A section id may come back in a later term, as another course: ``identity`` may have ``term_id``.
    """
    keys = ["term_id", "section_id"]
    act = flows.groupBy(*keys).agg(
        F.sum("wl_joins").alias("wl_joins"), F.sum("admits").alias("admits"),
        F.max("waitlist0").alias("max_waitlist"),
        F.round(F.avg((F.col("waitlist0") > 0).cast("int")), 4).alias("share_intervals_with_queue"))
    on = [k for k in keys if k in identity.columns]
    return act.join(identity.select(*on, "course_key", "subject", "catalog_number"), on, "left")


def rank_courses(activity: DataFrame, *, top_sections: int = 900, min_course_joins: int = 0) -> DataFrame:
    """Courses of the most-joined sections, plus courses above a joins floor (0 = off).

    ``activity`` may hold several terms: a section ranks once a term, and a course's joins are those of all terms.
    """
    terms = ["term_id"] if "term_id" in activity.columns else []
    top = activity.where(F.col("wl_joins") > 0).orderBy(
        F.desc("wl_joins"), F.desc("max_waitlist"), "section_id", *terms).limit(top_sections)
    in_top = top.where(F.col("course_key").isNotNull()).groupBy("course_key").agg(
        F.count_distinct("section_id").alias("_top"))
    totals = activity.where(F.col("course_key").isNotNull()).groupBy("course_key").agg(
        F.min("subject").alias("subject"), F.sum("wl_joins").alias("joins"),
        F.count_distinct("section_id").alias("sections"))
    floor = F.lit(min_course_joins > 0) & (F.col("joins") >= min_course_joins)
    return totals.join(in_top, "course_key", "left").where(F.col("_top").isNotNull() | floor).select(
        "course_key", "subject", "joins", "sections", F.coalesce("_top", F.lit(0)).alias("top_sections"))


# ------------------------------------------------------------------------- patterns


def parse_patterns(lines: DataFrame) -> DataFrame:
    """``rank, pattern, kind`` from the lines of a pattern file (``line_no, value``).

    Text after # is a comment. A bare subject, an exact course, or a course with
    wildcards; the earliest rank wins.
    """
    clean = F.trim(F.element_at(F.split("value", "#"), 1))
    rows = lines.select("line_no", normalise_course(clean).alias("pattern")).where("pattern <> ''")
    rows = rows.withColumn("_all", F.lit(1))
    rows = scan(rows, ["_all"], ["line_no"], [Scan("_n", F.lit(1), "sum")], plan_splits(rows, ["_all"], "line_no"))
    kind = F.when(~F.col("pattern").contains(" "), "subject").when(F.col("pattern").rlike(r"[*?\[]"), "wildcard") \
        .otherwise("exact")
    return rows.select((F.col("_n") - 1).cast("int").alias("rank"), "pattern", kind.alias("kind"))


def pattern_sha(text: Column) -> Column:
    return F.sha2(text, 256)


def _wildcard_regex(pattern: Column) -> Column:
    escaped = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(F.replace(escaped, F.lit("[!"), F.lit("[^")), F.lit("*"), F.lit(".*")),
                                          F.lit("?"), F.lit(".")), F.lit("$"))


GRAM = 3


def _piece_of(pattern: Column) -> Column:
    """The first letters, ``GRAM`` at most, of a pattern's longest literal piece; empty where it has none."""
    pieces = F.split(F.regexp_replace(pattern, r"\[[^\]]*\]|[*?]", "\n"), "\n")
    longest = F.array_max(F.transform(pieces, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))))
    return F.substring(longest["t"], 1, GRAM)


def _grams(key: Column) -> Column:
    """All runs of up to ``GRAM`` letters of a key, and the empty one."""
    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - n + 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(n)))

    return F.array_distinct(F.concat(F.array(F.lit("")), *[runs(n) for n in range(1, GRAM + 1)]))


def course_ranks(course_keys: DataFrame, patterns: DataFrame) -> DataFrame:
    """Lowest matching pattern rank per distinct course (courses without a match are absent).

    Exact courses, bare subjects and wildcards behind a literal subject are
    equi-joins. A wildcard inside the subject meets, also by equality, the courses
    that hold the first letters of its longest literal piece, and is tried on those.
    """
    keys = course_keys.select("course_key").where(F.col("course_key").isNotNull()).distinct()
    keys = keys.withColumn("_key", normalise_course(F.col("course_key")))
    keys = keys.withColumn("_subject", F.when(F.col("_key").contains(" "), F.regexp_replace("_key", " [^ ]+$", ""))
                           .otherwise(F.col("_key")))
    pick = lambda kind: patterns.where(F.col("kind") == kind)
    exact = keys.join(pick("exact").withColumnRenamed("pattern", "_key"), "_key")
    bare = keys.join(pick("subject").withColumnRenamed("pattern", "_subject"), "_subject")
    wild = pick("wildcard").select("rank", _wildcard_regex(F.col("pattern")).alias("_re"),
                                   F.regexp_replace("pattern", " [^ ]+$", "").alias("_subject"))
    open_subject = F.col("_subject").rlike(r"[*?\[]")
    near = keys.join(wild.where(~open_subject), "_subject").where(F.expr("_key rlike _re"))
    pieces = pick("wildcard").select("rank", "pattern", _wildcard_regex(F.col("pattern")).alias("_re"), _piece_of(F.col("pattern")).alias("_gram"))
    pieces = pieces.where(F.regexp_replace("pattern", " [^ ]+$", "").rlike(r"[*?\[]")).drop("pattern")
    held = keys.select("course_key", "_key", F.explode(_grams(F.col("_key"))).alias("_gram"))
    far = held.join(pieces, "_gram").where(F.expr("_key rlike _re"))
    found = exact.select("course_key", "rank")
    for part in (bare, near, far):
        found = found.unionByName(part.select("course_key", "rank"))
    return found.groupBy("course_key").agg(F.min("rank").alias("rank"))


def pattern_coverage(activity: DataFrame, patterns: DataFrame) -> DataFrame:
    """How much of the observed queueing a pattern list catches."""
    rows = activity.join(course_ranks(activity, patterns), "course_key", "left")
    hit, queued, joined = F.col("rank").isNotNull(), F.col("max_waitlist") > 0, F.col("wl_joins") > 0
    return rows.agg(
        F.count(F.lit(1)).alias("sections"), F.count_if(hit).alias("sections_matched"),
        F.count_if(queued).alias("sections_with_queue"), F.count_if(queued & hit).alias("sections_with_queue_matched"),
        F.count_if(joined).alias("sections_with_joins"), F.count_if(joined & hit).alias("sections_with_joins_matched"),
        F.round(F.coalesce(F.try_divide(F.sum(F.when(hit, F.col("wl_joins")).otherwise(0)), F.sum("wl_joins")),
                           F.lit(0.0)), 4).alias("share_joins_matched"))


def shard_sizes(catalog: DataFrame, patterns: DataFrame, n_shards: int = 12) -> DataFrame:
    """Selection size of a run: matched sections plus the smallest / largest shard of the rest."""
    live = catalog.where(F.col("last_status") == 200)
    rows = live.join(course_ranks(live, patterns), "course_key", "left").withColumn(
        "_shard", F.when(F.col("rank").isNull(), shard_of(F.col("url_path"), n_shards)))
    totals = rows.agg(
        F.count(F.lit(1)).alias("live"), F.count("rank").alias("matched"),
        F.count_distinct(F.when(F.col("rank").isNotNull(), F.col("course_key"))).alias("courses")).withColumn("_one", F.lit(1))
    shards = rows.where("_shard IS NOT NULL").groupBy("_shard").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.when(F.count(F.lit(1)) < n_shards, 0).otherwise(F.min("_n")).alias("_lo"),
        F.coalesce(F.max("_n"), F.lit(0)).alias("_hi")).withColumn("_one", F.lit(1))
    return totals.join(F.broadcast(shards), "_one").select(  # one row each
        "live", "matched", "courses", (F.col("matched") + F.col("_lo")).alias("selection_min"),
        (F.col("matched") + F.col("_hi")).alias("selection_max"))


# ------------------------------------------------------------------------- work lists


def select_work(catalog: DataFrame, patterns: DataFrame | None, now: Column, *, shard: tuple[int, int] | None = None,
                max_reprobes: int = MAX_REPROBES) -> DataFrame:
    """What to read next: patterned sections by rank, one shard of the rest, then the
    absent pages longest unprobed. ``stage`` and ``ordinal`` give the order."""
    absent = F.coalesce(F.col("last_status") == 404, F.lit(False))
    live = catalog.where(~absent)
    if patterns is None:
        first = live.withColumn("rank", F.lit(None).cast("int")).limit(0)
        rest = live.withColumn("rank", F.lit(None).cast("int"))
    else:
        ranked = live.join(course_ranks(live, patterns), "course_key", "left")
        first, rest = ranked.where("rank IS NOT NULL"), ranked.where("rank IS NULL")
        if shard is None:
            rest = rest.limit(0)
        else:
            rest = rest.where(shard_of(F.col("url_path"), shard[1]) == shard[0])
    probed = F.try_to_timestamp(F.col("probed_at"))
    due = catalog.where(absent & (probed.isNull() | (probed <= now - F.expr(f"INTERVAL {REPROBE_DAYS} DAYS"))))
    due = due.orderBy(F.coalesce("probed_at", F.lit("")), "url_path").limit(max_reprobes)
    cols = ["url_path", "course_key"]
    tagged = [
        first.select(*cols, F.lit("priority").alias("stage"), F.lit(0).alias("stage_order"), F.col("rank").alias("_r"), F.lit("").alias("_p")),
        rest.select(*cols, F.lit("shard").alias("stage"), F.lit(1).alias("stage_order"), F.lit(0).alias("_r"), F.lit("").alias("_p")),
        due.select(*cols, F.lit("reprobe").alias("stage"), F.lit(2).alias("stage_order"), F.lit(0).alias("_r"),
                   F.coalesce("probed_at", F.lit("")).alias("_p")),
    ]
    out = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    key = F.when(F.col("stage") == "priority", F.col("course_key")).otherwise("")
    return out.withColumn("sort_key", F.struct("stage_order", "_r", key.alias("k"), "_p", "url_path")) \
        .select("stage", "url_path", "course_key", "sort_key")


def merge_catalog(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Union by ``url_path``: known entries keep what was learned, gain a node id when
    they lack one, and take a newer non-empty title or instructor list."""
    latest = fresh.withColumn("_o", F.monotonically_increasing_id() if "ordinal" not in fresh.columns else F.col("ordinal"))
    # the first fresh row introduces a path; later ones update it like any other
    cols = [c for c in existing.columns if c != "url_path"]
    text = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.col(c))
    news = latest.groupBy("url_path").agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), "_o").alias("_new"),
        F.min_by("node_id", F.when(F.col("node_id").isNotNull(), F.col("_o"))).alias("_node"),
        F.max_by("title", F.when(text("title").isNotNull(), F.col("_o"))).alias("_title"),
        F.max_by("instructors", F.when(text("instructors").isNotNull(), F.col("_o"))).alias("_people"))
    joined = existing.withColumn("_known", F.lit(True)).join(news, "url_path", "full_outer")
    old = lambda c: F.when(F.col("_known"), F.col(c)).otherwise(F.col(f"_new.{c}"))
    special = {"node_id": F.coalesce(old("node_id"), F.col("_node")),
               "title": F.coalesce("_title", old("title")), "instructors": F.coalesce("_people", old("instructors"))}
    return joined.select("url_path", *[special.get(c, old(c)).alias(c) for c in cols],
                         F.col("_known").isNull().alias("added"))


def nested_sample(sections: DataFrame, key: str, *, seed: int = 0, limit: int | None = None,
                  exclude_components: Sequence[str] = SELF_STUDY) -> DataFrame:
    """One row per key in a seeded order; smaller limits are prefixes of larger ones.

    The order depends on the key alone, never on counts.
    """
    rows = sections.where(~F.coalesce(F.col("component"), F.lit("")).isin(*exclude_components))
    rows = rows.dropDuplicates([key]).withColumn("_h", seeded_order(seed, F.col(key)))
    ordered = rows.orderBy("_h", key)
    return (ordered.limit(limit) if limit is not None else ordered).drop("_h")


def check_order(refs: DataFrame, preferred: Sequence[str], n: int) -> DataFrame:
    """Known good pages first, then preferred subjects, then by path."""
    known = F.when((F.coalesce("section_id", F.lit("")) != "") & (F.col("last_status") == 200), 0).otherwise(1)
    liked = F.when(F.upper("subject").isin(*preferred), 0).otherwise(1)
    return refs.orderBy(known, liked, "url_path").limit(n)


def top_sections(activity: DataFrame, n: int) -> DataFrame:
    return activity.orderBy(F.desc("wl_joins"), F.desc("max_waitlist"), "section_id").limit(n)
