"""Snapshot rows and run metadata as partitioned tables."""
from __future__ import annotations

import datetime as dt
import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.schema import RUNS, SNAPSHOT
from turnwise.session import open_file_system


def read_rows(spark: SparkSession, root: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Snapshot rows with ``run_started_at, kind, date``; dates prune partitions."""
    schema = SNAPSHOT
    for name, kind in (("run_started_at", "timestamp"), ("kind", "string"), ("date", "date")):
        schema = schema.__class__(list(schema.fields)).add(name, kind)
    rows = spark.read.schema(schema).parquet(f"{root}/rows").select(*schema.fieldNames())
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end))
    return rows


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Run metadata; no row data is touched."""
    return spark.read.schema(RUNS).parquet(f"{root}/runs")


def append_run(root: str, rows: DataFrame, run: DataFrame) -> int:
    """Write one run's rows and append its metadata row; an existing run is refused.

    ``run`` is one row of the run table without ``n_written``, which is stamped here.
    The rows go to a partition of their own, which a repeated attempt overwrites, and
    what is counted is what was written. The run row comes last: a run that is listed
    is complete, and rows of a run that was cut off are never doubled.
    """
    spark = rows.sparkSession
    key = run.select("run_started_at", "term_id", "kind").first()
    try:
        taken = read_runs(spark, root).join(run.select("run_started_at", "term_id", "kind"),
                                            ["run_started_at", "term_id", "kind"], "left_semi")
        exists = not taken.isEmpty()
    except AnalysisException as problem:  # the first run finds no folder yet
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        exists = False
    if exists:
        raise FileExistsError(f"run {key['run_started_at']} ({key['kind']}) of term {key['term_id']} is already written")
    stamped = rows.select(*SNAPSHOT.fieldNames()).withColumns({
        "run_started_at": F.lit(key["run_started_at"]).cast("timestamp"), "kind": F.lit(key["kind"])})
    name = f"{key['term_id']}-{key['run_started_at']:%Y%m%dT%H%M%S%f}-{key['kind']}"
    place = f"{root}/rows/date={key['run_started_at'].date()}/run={name}"
    stamped.write.mode("overwrite").parquet(place)
    written = spark.read.schema(stamped.schema).parquet(place).count()
    full = run.withColumn("n_written", F.lit(written)).select(*[F.col(f.name).cast(f.dataType) for f in RUNS.fields])
    full.write.mode("append").parquet(f"{root}/runs")
    return written


def import_footers(spark: SparkSession, path: str, key: str = "metadata") -> DataFrame:
    """Run metadata kept as JSON in the footer of existing Parquet files.

    Spark lists the files without their contents; each task opens its own ones and reads the footer from a file's end.
    """
    def read(batches):
        import pyarrow.parquet as pq

        for frame in batches:
            found = []
            for name in frame["path"]:
                fs, local = open_file_system(name)
                with fs.open_input_file(local) as source:
                    values = pq.read_metadata(source).metadata or {}
                decoded = {k.decode(): v.decode() for k, v in values.items() if not k.startswith(b"ARROW")}
                found.append((name, decoded.get(key) or json.dumps(decoded)))
            yield pd.DataFrame(found, columns=["path", "metadata"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet") \
        .option("recursiveFileLookup", "true").load(path).select("path")
    raw = files.mapInPandas(read, "path string, metadata string")
    return raw.select("path", F.from_json("metadata", RUNS).alias("r")).select("path", "r.*")


def save_panel(out_dir: str, **tables: DataFrame) -> None:
    """Write named tables (panel, identity, gaps, flows) for a later session."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{out_dir}/{name}")


def load_panel(spark: SparkSession, out_dir: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{out_dir}/{name}") for name in names}
