"""The hand-kept event log (a Markdown table) as outages."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.scalars import parse_stamp

# Kinds that censor the intervals they touch.
CENSORING_KINDS = ("outage", "source_switch", "schema", "term_switch")
_STAMP = r"(\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}Z)?)"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the log with their order."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"))


def outages(lines: DataFrame, kinds: Sequence[str] = CENSORING_KINDS) -> DataFrame:
    """``start, end, kind, term_id, scope, note`` with later corrections applied.

    A ``correction`` names an earlier row's start and closes it with the end it
    states, else its own end, else its own start. Rows with a bad date are left out.
    """
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r" \| "), lambda c: F.trim(c))
    rows = lines.where(F.col("value").startswith("| 20")).select("line_no", cells.alias("c")).where(F.size("c") >= 6)
    rows = rows.select("line_no", *[F.col("c")[i].alias(n) for i, n in enumerate(
        ("start_text", "end_text", "kind", "term", "scope", "note"))])
    empty = F.col("end_text").isin("", "-")
    rows = rows.withColumns({"start": parse_stamp(F.col("start_text")), "end": parse_stamp(F.col("end_text"))})
    good = F.col("start").isNotNull() & (empty | F.col("end").isNotNull())
    kept = rows.where(F.col("kind").isin(*kinds) & good)
    stated = parse_stamp(F.regexp_extract("note", f"end_utc is {_STAMP}", 1))
    fixes = rows.where(F.col("kind") == "correction").select(
        "line_no", parse_stamp(F.regexp_extract("note", f"starts {_STAMP}", 1)).alias("start"),
        F.coalesce(stated, "end", "start").alias("_close")).where("start IS NOT NULL AND _close IS NOT NULL")
    first = fixes.groupBy("start").agg(F.min_by("_close", "line_no").alias("_close"))
    joined = kept.join(first, "start", "left")
    return joined.select(
        "start", F.coalesce("end", "_close").alias("end"), "kind",
        F.when(~F.col("term").isin("", "-"), F.col("term")).alias("term_id"), "scope", "note")
