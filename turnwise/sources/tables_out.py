"""Writing the lookup tables and reading backtest runs back."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.scalars import horizon_label, subject_slug
from turnwise.operators import flows as fl
from turnwise.operators import tables as tb
from turnwise.session import materialize

RUN_FOLDER = r"/((temporal|grouped|cross_term)_(days\d+|deadline|instruction))/"


def write_lookup_tables(out_dir: str, cohort: DataFrame, calendar, *, flows: DataFrame | None = None,
                        catalog: DataFrame | None = None, forecast=None, min_n: int = tb.MIN_N,
                        n_boot: int = tb.N_BOOT, estimate_level: str = "course") -> dict[str, str]:
    """Pools, course cells (one folder per subject file), index, insights, titles, meta.

    Folders are overwritten, so nothing of an earlier export stays behind.
    """
    forecast = forecast or calendar
    pools = materialize(tb.pool_tables(cohort, min_n=min_n, n_boot=n_boot))
    cells = materialize(tb.course_tables(cohort, pools, min_n=min_n, n_boot=n_boot, estimate_level=estimate_level))
    joins = None if flows is None else tb.joins_by_course(cohort, flows)
    index = tb.index_rows(cells, pools, joins)
    out = {
        "pooled": pools, "index": index, "hero": tb.hero_cells(cohort, min_n=min_n, n_boot=n_boot),
        "by_phase": tb.phase_cells(cohort, min_n=min_n, n_boot=n_boot), "counts": tb.insight_counts(cohort),
        "meta": cohort.agg(
            F.count(F.lit(1)).alias("cohort_rows"), F.sum("event").alias("events"),
            F.count_distinct("section_id").alias("sections"), F.min("join_time").alias("join_from"),
            F.max("join_time").alias("join_to"), F.max("scenario").alias("scenario"),
            F.array_sort(F.collect_set("position")).alias("positions")).withColumns({
                "term_id": F.lit(calendar.term_id), "term_name": F.lit(calendar.name),
                "forecast_term_id": F.lit(forecast.term_id), "forecast_term_name": F.lit(forecast.name),
                "deadline": F.lit(forecast.last_auto_waitlist), "instruction_start": F.lit(forecast.instruction_start),
                "min_n": F.lit(min_n), "n_boot": F.lit(n_boot), "estimate_level": F.lit(estimate_level)}),
    }
    if flows is not None:
        out["daily"], out["exits"] = fl.daily_flows(flows), fl.exit_tally(flows)
    if catalog is not None:
        out["titles"] = tb.titles_table(index, catalog)
    for name, table in out.items():
        table.write.mode("overwrite").json(f"{out_dir}/{name}")
    named = cells.withColumn("subject_file", subject_slug(F.col("subject")))
    named.write.mode("overwrite").partitionBy("subject_file").json(f"{out_dir}/courses")
    return {name: f"{out_dir}/{name}" for name in [*out, "courses"]}


def read_backtests(spark: SparkSession, reports: str, table: str = "metrics") -> DataFrame:
    """One table of every backtest run, tagged with the split and horizon in its folder
    name; unscored runs have no rows, NaN becomes null, figures are rounded to four places."""
    rows = spark.read.option("header", True).option("inferSchema", True).option("recursiveFileLookup", True) \
        .option("pathGlobFilter", "*.csv").csv(f"{reports}/*/{table}*")
    path = F.col("_metadata.file_path")
    clean = []
    for f in rows.schema.fields:
        value = F.col(f.name)
        if f.dataType.simpleString() in ("double", "float"):
            value = F.round(F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value), 4)
        clean.append(value.alias(f.name))
    tagged = rows.select(
        F.regexp_extract(path, RUN_FOLDER, 1).alias("run"), F.regexp_extract(path, RUN_FOLDER, 2).alias("split"),
        F.regexp_extract(path, RUN_FOLDER, 3).alias("which"), *clean)
    return tagged.where("run <> ''").withColumn("horizon_label", horizon_label(F.col("which")))


def summarise_backtests(spark: SparkSession, reports: str) -> DataFrame:
    """One row per run under ``reports``, whether it was scored or not: its counts, the observable share of its test rows
    ahead of their horizon, its best predictor and what it gains over the bucket baseline."""
    counts = read_backtests(spark, reports, "counts").select(
        "run", "split", "which", "horizon_label", *[F.col(c).cast("long").alias(c) for c in (
            "n_train", "n_test", "n_excluded", "n_unobservable")])
    covered = F.try_divide(F.col("n_test"), F.col("n_test") + F.col("n_unobservable"))
    out = counts.withColumn("share_observable", F.round(covered, 4))
    if not _written(spark, reports, "metrics"):
        return out.withColumns({**{c: F.lit(None).cast("string") for c in ("best_predictor",)},
                                **{c: F.lit(None).cast("double") for c in ("best_brier", "best_gain", "best_auc")}})
    scores = read_backtests(spark, reports, "metrics").where(F.col("brier").isNotNull())
    best = scores.groupBy("run").agg(F.min(F.struct("brier", "predictor", "gain", "auc")).alias("m"))
    return out.join(best, "run", "left").select(
        *out.columns, F.col("m.predictor").alias("best_predictor"), F.col("m.brier").alias("best_brier"),
        F.col("m.gain").alias("best_gain"), F.col("m.auc").alias("best_auc"))


def _written(spark: SparkSession, reports: str, table: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{reports}/*/{table}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def report_counts(spark: SparkSession, reports: str) -> DataFrame:
    """Training, scored, past-horizon and unobservable rows from the report texts."""
    text = spark.read.text(f"{reports}/*/report.md", wholetext=True)
    pattern = (r"(\d+) training rows, (\d+) scored test rows, (\d+) test rows past their horizon at joining "
               r"and (\d+) whose follow-up ended before their horizon")
    part = lambda i: F.regexp_extract("value", pattern, i).try_cast("long")
    return text.select(F.regexp_extract(F.col("_metadata.file_path"), RUN_FOLDER, 1).alias("run"), part(1).alias("train"),
                       part(2).alias("test"), part(3).alias("past"), part(4).alias("unobservable"))
