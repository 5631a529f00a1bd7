"""The whole analysis: panel to flows, joiners, curves, hazards, backtest, tables."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators import cohort as co
from turnwise.operators import cox, km, quality
from turnwise.operators import flows as fl
from turnwise.plans import backtest as bt
from turnwise.schema import POSITIONS, SCENARIOS
from turnwise.session import materialize
from turnwise.sources.tables_out import write_lookup_tables

# Cohort columns that split curves, and the gates for fitting anything.
STRATA = ("position_bucket", "level", "dept_group", "phase")
MIN_ROWS, MIN_EVENTS = 100, 10


@dataclass
class Analysis:
    flows: DataFrame
    cohort: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    backtest: bt.Backtest | None = None
    notes: list[str] = field(default_factory=list)


def run_analysis(panel: DataFrame, identity: DataFrame, calendar, out_dir: str, *, flows: DataFrame | None = None,
                 outages: DataFrame | None = None, max_interval_min: float | None = None,
                 positions: Sequence[int] = POSITIONS, join_every_min: float = 240, min_cohort_rows: int = MIN_ROWS,
                 n_boot: int = 200, catalog: DataFrame | None = None, forecast=None,
                 estimate_level: str = "course", cox_max_rows: int | None = None) -> Analysis:
    """Run every stage and write its tables under ``out_dir``.

    Flows and joiners are written first and read by everything after them.
    ``flows`` replaces the reconstruction (histories bring their own). Small
    cohorts stop after the profile with a note.
    """
    made = flows if flows is not None else fl.interval_flows(panel, outages=outages, max_interval_min=max_interval_min)
    made.write.mode("overwrite").parquet(f"{out_dir}/flows")
    spark = panel.sparkSession
    flows = spark.read.parquet(f"{out_dir}/flows")
    everyone = co.build_cohort(flows, identity, calendar, scenarios=SCENARIOS, positions=positions,
                               join_every_min=join_every_min)
    everyone.write.mode("overwrite").partitionBy("scenario").parquet(f"{out_dir}/cohort")
    everyone = spark.read.parquet(f"{out_dir}/cohort")
    central = everyone.where(F.col("scenario") == "central")
    result = Analysis(flows, everyone)
    out = result.tables
    out["profile"], out["impossible"] = quality.panel_profile(panel), quality.impossible_states(panel)
    out["top_jumps"], out["flow_summary"] = quality.top_jumps(panel), fl.flow_summary(flows)
    out["sensitivity"] = km.headline_median(everyone)
    size = central.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("event"), F.lit(0)).alias("e")).first()
    if size["n"] < min_cohort_rows or size["e"] < MIN_EVENTS:
        result.notes.append(f"{size['n']} joiners with {size['e']} clearings: too few to fit curves")
    else:
        for name in STRATA:
            out[f"km_{name}"] = km.km_table(central, [name])
            out[f"logrank_{name}"] = km.logrank(central, name)
        out["cleared_by_instruction"] = km.cleared_by_instruction(central)
        try:
            first, test, refit = cox.fit_with_check(central, max_rows=cox_max_rows)
            out["cox"], out["cox_test"] = first.summary(spark), test
            out["cox_headline"] = cox.headline_effects(out["cox"])
            if refit is not None:
                out["cox_stratified"] = refit.summary(spark)
        except (cox.NoFit, np.linalg.LinAlgError) as problem:
            result.notes.append(f"no hazards fit: {problem}")
        result.backtest = bt.run_backtest(central, calendar, split="temporal", which="days:14", n_boot=n_boot,
                                          cox_max_rows=cox_max_rows)
        bt.write_tables(result.backtest, f"{out_dir}/backtest/temporal_days14")
        write_lookup_tables(f"{out_dir}/tables", central, calendar, flows=flows, catalog=catalog, forecast=forecast,
                            n_boot=n_boot, estimate_level=estimate_level)
    for name, table in out.items():
        kept = materialize(table)
        kept.write.mode("overwrite").json(f"{out_dir}/report/{name}")
        out[name] = kept
    return result
