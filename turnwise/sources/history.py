"""History payloads: one gzip JSON file per section with run-length segments."""
from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.session import open_file_system

SEGMENT = ("startTime string, endTime string, granularitySeconds string, status string, enrolledCount string, "
           "waitlistedCount string, reservedCount string, maxEnroll string, maxWaitlist string, openReserved string")
SECTION = ("key string, course_key string, subject string, catalog_number string, class_number string, "
           "section_number string, session_id string, component string")
PAYLOAD = (f"key string, term_id string, term_name string, fetched_at string, section struct<"
           + ", ".join(f.replace(" ", ":") for f in SECTION.split(", "))
           + ">, enrollment struct<sectionId:string, history:array<struct<"
           + ", ".join(f.replace(" ", ":") for f in SEGMENT.split(", ")) + ">>>")


#: Folders that payload files are dealt to.
FOLDERS = 64


def write_payloads(payloads: DataFrame, folder: str) -> int:
    """Write one gzip JSON file per row into numbered folders below ``folder``, named by the row's ``key``; returns how many.

    Each task writes its rows' files where they stay, so no folder is made per file and none is moved by the driver. A
    task that runs again writes the same files.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_file_system(folder)
        made = set()
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place = f"{root}/{zlib.crc32(key.encode()) % FOLDERS:02}"
                if place not in made:
                    fs.create_dir(place, recursive=True)
                    made.add(place)
                with fs.open_output_stream(f"{place}/{quote(key, safe='')}.json.gz", compression=None) as out:
                    out.write(gzip.compress(body.encode()))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["files"])

    named = payloads.select(F.coalesce("key", F.lit("")).alias("key"), F.to_json(F.struct(*payloads.columns)).alias("body"))
    return named.mapInArrow(write, "files long").agg(F.sum("files")).first()[0] or 0


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per payload file (gzip is read by suffix)."""
    return spark.read.schema(PAYLOAD).option("multiLine", True).json(path)


def first_payloads(payloads: DataFrame) -> DataFrame:
    """Payloads with an id and a history; the first key wins a repeated section id."""
    named = payloads.withColumn("section_id", F.col("enrollment.sectionId").cast("string"))
    named = named.where((F.coalesce("section_id", F.lit("")) != "") & (F.size("enrollment.history") > 0))
    # the files are opened once: a section's payloads meet, and their keys with them
    first = F.min("key").over(Window.partitionBy("section_id"))
    return named.withColumn("_first", first).where(F.col("key") == F.col("_first")).drop("_first")


def segments(payloads: DataFrame, source: str = "history") -> DataFrame:
    """Segments with parsed times in order (swapped when reversed) and integer counts."""
    rows = payloads.select("section_id", "term_id", F.posexplode("enrollment.history").alias("ordinal", "s"))
    a, b = F.to_timestamp("s.startTime"), F.to_timestamp("s.endTime")
    whole = lambda c: F.col(f"s.{c}").try_cast("int")
    return rows.select(
        "section_id", "term_id", "ordinal", F.least(a, b).alias("start"), F.greatest(a, b).alias("end"),
        F.coalesce("s.status", F.lit("")).alias("status"),
        whole("enrolledCount").alias("enrolled_count"), whole("maxEnroll").alias("enroll_capacity"),
        whole("waitlistedCount").alias("waitlist_count"), whole("maxWaitlist").alias("waitlist_capacity"),
        whole("reservedCount").alias("reserved_count"), whole("openReserved").alias("open_reserved"),
        F.lit(source).alias("source"))
