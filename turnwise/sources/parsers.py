"""Raw responses to snapshot rows: JSON pages, catalog JSON, HTML pages, feeds.

Every parser keeps the raw table's grain, works on columns and returns good
rows and rejects (with a reason) side by side.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.scalars import term_id_of

_REQUIRED = ("enrolled_count", "enroll_capacity", "waitlist_count", "waitlist_capacity")
# The page title's and link's form.
TITLE = r"^\s*(\d{4})\s+(Spring|Summer|Fall)\s+(\S+)\s+(\S+)\s+(\S+)\s+([A-Za-z]{2,4})\s+(\S+)\s*$"
CONTENT_PATH = r"(/content/.*)$"

_COUNTS = ("enrolledCount:string, maxEnroll:string, waitlistedCount:string, maxWaitlist:string, "
           "reservedCount:string, openReserved:string")
_SECTION = (
    "id:string, number:string, component:struct<code:string>, status:struct<code:string>, "
    "association:struct<primary:boolean>, "
    "class:struct<number:string, course:struct<subjectArea:struct<code:string>, "
    "catalogNumber:struct<formatted:string>>, session:struct<id:string, term:struct<id:string>>>, "
    f"enrollmentStatus:struct<status:struct<code:string>, {_COUNTS}>"
)
REGISTRAR = f"apiResponse struct<response:struct<classSections:array<struct<{_SECTION}>>>>"
CATALOG = (
    "errors array<struct<message:string>>, data struct<catalog:array<struct<subject:string, courseNumber:string, "
    "number:string, sessionId:string, primarySection:struct<component:string, number:string, "
    f"enrollment:struct<latest:struct<status:string, {_COUNTS}>>>>>>"
)
PAGE = ("ucb struct<enrollment:struct<available:struct<id:string, "
        f"enrollmentStatus:struct<status:struct<code:string>, {_COUNTS}>>>>")


def _whole(path: str) -> Column:
    text = F.col(path)
    return F.when(text.rlike(r"^-?\d+$"), text).try_cast("int")


def _counts(prefix: str) -> dict[str, Column]:
    return {
        "enrolled_count": _whole(f"{prefix}.enrolledCount"), "enroll_capacity": _whole(f"{prefix}.maxEnroll"),
        "waitlist_count": _whole(f"{prefix}.waitlistedCount"), "waitlist_capacity": _whole(f"{prefix}.maxWaitlist"),
        "reserved_count": _whole(f"{prefix}.reservedCount"), "open_reserved": _whole(f"{prefix}.openReserved"),
    }


def _tight(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def _missing(*names: str) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))


def parse_registrar(raw: DataFrame, fetched_at: dt.datetime, source: str, *, include_cancelled: bool = False) -> DataFrame:
    """Sections of registrar JSON pages (``url, body``). ``reject`` names what is missing;
    a page without the expected envelope is one rejected row, never an empty page."""
    pages = raw.select("url", F.from_json("body", REGISTRAR)["apiResponse"]["response"]["classSections"].alias("list"))
    broken = pages.where("list IS NULL").select("url", F.lit(True).alias("_bad"))
    rows = pages.select("url", F.explode("list").alias("s"))
    if not include_cancelled:
        rows = rows.where(F.coalesce(F.col("s.status.code"), F.lit("")) != "X")
    subject = _tight(F.col("s.class.course.subjectArea.code"))
    number = F.trim("s.class.course.catalogNumber.formatted")
    out = rows.select(
        "url", F.lit(fetched_at).cast("timestamp").alias("fetched_at"), F.col("s.class.session.term.id").alias("term_id"),
        F.when(F.col("s.id").rlike(r"^\d+$"), F.col("s.id")).alias("section_id"),
        F.when(subject.isNotNull() & number.isNotNull(), F.concat_ws(" ", subject, number)).alias("course_key"),
        subject.alias("subject"), number.alias("catalog_number"), F.col("s.class.number").alias("class_number"),
        F.col("s.number").alias("section_number"), F.col("s.component.code").alias("component"),
        F.col("s.association.primary").alias("is_primary"), F.col("s.class.session.id").alias("session_id"),
        *[c.alias(n) for n, c in _counts("s.enrollmentStatus").items()],
        F.col("s.enrollmentStatus.status.code").alias("status"), F.col("s.status.code").alias("section_status"),
        F.lit(source).alias("source"))
    out = out.withColumn("reject", _missing("section_id", "term_id", "course_key", "class_number", "section_number",
                                            "component", "session_id", *_REQUIRED, "status"))
    return out.unionByName(broken.select("url", F.array(F.lit("envelope")).alias("reject")), allowMissingColumns=True)


def parse_catalog(raw: DataFrame, fetched_at: dt.datetime, term_id: str, source: str, *, id_prefix: str = "bt",
                  default_session: str = "1") -> DataFrame:
    """Classes of catalog JSON responses: those never observed are skipped, the first of
    a repeated id is kept, the rest of the failures are rejects."""
    pages = raw.select("url", F.from_json("body", CATALOG).alias("p"))
    broken = pages.where(F.col("p.data.catalog").isNull() | (F.size(F.coalesce("p.errors", F.array().cast(
        "array<struct<message:string>>"))) > 0)).select("url", F.array(F.lit("envelope")).alias("reject"))
    rows = pages.where(F.col("p.data.catalog").isNotNull()).join(broken.select("url"), "url", "left_anti").select(
        "url", F.posexplode("p.data.catalog").alias("ordinal", "s"))
    rows = rows.where(F.col("s.primarySection.enrollment.latest").isNotNull())
    subject, number, cls = _tight(F.coalesce("s.subject", F.lit(""))), F.trim(F.coalesce("s.courseNumber", F.lit(""))), \
        F.trim(F.coalesce("s.number", F.lit("")))
    named = (subject != "") & (number != "") & (cls != "")
    latest = "s.primarySection.enrollment.latest"
    out = rows.select(
        "url", "ordinal", F.lit(fetched_at).cast("timestamp").alias("fetched_at"), F.lit(term_id).alias("term_id"),
        F.concat_ws(":", F.lit(id_prefix), subject, number, cls).alias("section_id"),
        F.when(named, F.concat_ws(" ", subject, number)).alias("course_key"), subject.alias("subject"),
        number.alias("catalog_number"), cls.alias("class_number"),
        F.coalesce(F.nullif("s.primarySection.number", F.lit("")), cls).alias("section_number"),
        F.nullif("s.primarySection.component", F.lit("")).alias("component"), F.lit(True).alias("is_primary"),
        F.coalesce("s.sessionId", F.lit(default_session)).alias("session_id"),
        *[c.alias(n) for n, c in _counts(latest).items()],
        F.nullif(F.col(f"{latest}.status"), F.lit("")).alias("status"), F.lit(None).cast("string").alias("section_status"),
        F.lit(source).alias("source"))
    out = out.withColumn("reject", _missing("course_key", "component", *_REQUIRED, "status"))
    # the first good row of an id is kept; failed rows do not shadow it
    first = out.where(F.size("reject") == 0).groupBy("section_id").agg(F.min(F.struct("url", "ordinal")).alias("_first"))
    out = out.join(first, "section_id", "left").where(
        (F.size("reject") > 0) | (F.struct("url", "ordinal") == F.col("_first"))).drop("_first", "ordinal")
    return out.unionByName(broken, allowMissingColumns=True)


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def title_identity(title: Column) -> dict[str, Column]:
    """Term, subject, numbers and component from ``2026 Fall SUBJ 10 001 LEC 001``;
    null when it is no section title."""
    text = F.element_at(F.split(title, r"\|"), 1)
    part = lambda i: F.nullif(F.regexp_extract(text, TITLE, i), F.lit(""))
    return {
        "term_name": F.when(part(1).isNotNull(), F.concat_ws(" ", part(2), part(1))),
        "subject": F.upper(part(3)), "catalog_number": F.upper(part(4)), "class_number": F.upper(part(5)),
        "component": F.upper(part(6)), "section_number": F.upper(part(7)),
    }


def _attribute(html: Column, tag: str, marker: str, name: str) -> Column:
    """Value of one attribute of the first tag that carries the marker, in any order."""
    opening = F.regexp_extract(html, rf"(?is)(<{tag}\b[^>]*{marker}[^>]*>)", 1)
    return F.nullif(F.regexp_extract(opening, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def parse_section_pages(raw: DataFrame, fetched_at: dt.datetime, source: str, *, term_id: str | None = None,
                        root: str = "ucb", default_session: str = "1") -> DataFrame:
    """Section pages (``url, html``): identity from the title and canonical link, counts
    from the embedded settings JSON. ``term_id`` stands in when the page has none."""
    html = F.col("html")
    blob = F.regexp_extract(html, r"(?is)<script\b[^>]*drupal-settings-json[^>]*>(.*?)</script>", 1)
    settings = F.from_json(blob, PAGE.replace("ucb struct", f"{root} struct", 1))
    rows = raw.withColumns({"_has": blob != "", "s": settings[root]["enrollment"]["available"],
                            "_path": F.nullif(F.regexp_extract(_attribute(html, "link", r"\bcanonical\b", "href"),
                                                               CONTENT_PATH, 1), F.lit("")),
                            "_term": F.nullif(F.regexp_extract(html, r"(?is)\bdata-term\s*=\s*[\"'](\d+)[\"']", 1), F.lit("")),
                            "node_id": F.regexp_extract(html, r"(?is)data-history-node-id\s*=\s*[\"'](\d+)[\"']", 1)
                            .try_cast("bigint"),
                            **title_identity(page_title(html))})
    rows = rows.select(
        "url", "_has", F.col("_path").alias("url_path"), "node_id",
        F.lit(fetched_at).cast("timestamp").alias("fetched_at"),
        F.coalesce("_term", F.lit(term_id), term_id_of(F.col("term_name"))).alias("term_id"),
        F.when(F.col("s.id").rlike(r"^\d+$"), F.col("s.id")).alias("section_id"),
        F.when(F.col("subject").isNotNull(), F.concat_ws(" ", "subject", "catalog_number")).alias("course_key"),
        "subject", "catalog_number", "class_number", "section_number", "component",
        F.lit(None).cast("boolean").alias("is_primary"), F.lit(default_session).alias("session_id"),
        *[c.alias(n) for n, c in _counts("s.enrollmentStatus").items()],
        F.col("s.enrollmentStatus.status.code").alias("status"),
        F.lit(None).cast("string").alias("section_status"), F.lit(source).alias("source"))
    page = F.array_compact(F.array(F.when(~F.col("_has"), F.lit("settings"))))
    return rows.withColumn("reject", F.concat(page, _missing("section_id", "course_key", "url_path", *_REQUIRED, "status"))) \
        .drop("_has")


def parse_feed(raw: DataFrame) -> DataFrame:
    """``node_id, url_path, title`` of every item of a site feed (``url, body``);
    items without a numeric guid or a content link are skipped."""
    item = F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1)))
    rows = raw.select("url", item.alias("i"))
    link = F.regexp_extract("i", r"<link>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)", 1)
    return rows.select(
        "url", F.regexp_extract("i", r"<guid[^>]*>\s*(?:<!\[CDATA\[)?\s*(\d+)", 1).try_cast("bigint").alias("node_id"),
        F.nullif(F.regexp_extract(link, CONTENT_PATH, 1), F.lit("")).alias("url_path"),
        F.regexp_extract("i", r"(?s)<title>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</title>", 1).alias("title"),
    ).where("node_id IS NOT NULL AND url_path IS NOT NULL")
