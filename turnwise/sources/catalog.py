"""Section catalogs, pattern files and name tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = ("section_id:string, url_path:string, course_key:string, subject:string, catalog_number:string, "
         "class_number:string, section_number:string, component:string, last_status:int, probed_at:string, "
         "node_id:bigint, title:string, instructors:string, term_id:string")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Entries of ``{"term_id", "sections": [...]}`` files with the catalog's term.

    The term is the file's own, else one its entries carry, else the folder's number.
    """
    files = spark.read.schema(f"term_id string, sections array<struct<{ENTRY}>>").option("multiLine", True).json(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)/[^/]*$", 1)
    carried = F.try_element_at(F.filter(F.transform("sections", lambda s: s["term_id"]), lambda t: t.isNotNull()), F.lit(1))
    term = F.coalesce("term_id", carried, F.nullif(folder, F.lit("")))
    # the term first: beside the explosion it would be worked out, and the whole file copied, once per entry
    rows = files.select(term.alias("catalog_term_id"), "sections").select(
        "catalog_term_id", F.posexplode("sections").alias("ordinal", "s"))
    return rows.select("catalog_term_id", "ordinal", "s.*")


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    from turnwise.operators.activity import parse_patterns

    return parse_patterns(spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value"))


def read_names(spark: SparkSession, path: str, key: str = "subject", value: str = "name") -> DataFrame:
    """A flat JSON object of strings as two columns."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))
