"""Backtests: splits, five predictors, censoring weights and scores.

``fold`` is a key column, so all folds are fitted, read and scored in one plan.
Training counts are reduced to (cell, time) before they are copied to the folds
they train.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.rules import days_between
from turnwise.functions.scalars import horizon_days, seeded_order
from turnwise.operators import cox, km
from turnwise.operators.boot import bootstrap_gain
from turnwise.operators.ranks import quantiles
from turnwise.operators.scans import Scan, plan_splits, read_steps, scan, step_lookup
from turnwise.session import checked_broadcast, counted_broadcast, lookup_side, materialize

# Predictors, gates, weight floor.
PREDICTORS = ("bucket", "dept", "course", "site", "cox")
BASELINE = "bucket"
MIN_TRAIN_ROWS, MIN_TRAIN_EVENTS, MIN_TEST_ROWS = 50, 10, 50
G_FLOOR = 0.05
ROW_ID = "row_id"
CURVE = ["fold", "kind", "key", "bucket"]


def with_row_id(cohort: DataFrame) -> DataFrame:
    """A tie-break per row; callers with a natural integer id keep theirs."""
    if ROW_ID in cohort.columns:
        return cohort
    return cohort.withColumn(ROW_ID, F.xxhash64("section_id", "join_time", "position"))


# ---------------------------------------------------------------------------- splits


def censor_at(cohort: DataFrame, moment: dt.datetime) -> DataFrame:
    """Rows as known at ``moment``: later ends are cut back and their events undone."""
    cap = days_between(F.col("join_time"), F.lit(moment).cast("timestamp"))
    over = F.col("duration_days") > cap
    out = cohort.withColumns({
        "event": F.when(over, 0).otherwise(F.col("event")),
        "duration_days": F.when(over, cap).otherwise(F.col("duration_days")),
    }).withColumn("duration_min", F.col("duration_days") * 1440.0)
    return out.where(F.col("duration_days") > 0)


def temporal_split(cohort: DataFrame, split_at: dt.datetime, as_of: bool = True) -> tuple[DataFrame, DataFrame]:
    at = F.lit(split_at).cast("timestamp")
    train, test = cohort.where(F.col("join_time") < at), cohort.where(F.col("join_time") >= at)
    return (censor_at(train, split_at) if as_of else train), test


def grouped_folds(cohort: DataFrame, folds: int = 5, seed: int = 0) -> DataFrame:
    """Add ``fold``: courses in a seeded order dealt out in turn, so fold sizes differ
    by at most one course and a course is never in two folds."""
    courses = cohort.select(F.coalesce("course_key", F.lit("")).alias("_course")).distinct().withColumns(
        {"_all": F.lit(1), "_h": seeded_order(seed, F.col("_course"))})
    dealt = scan(courses, ["_all"], ["_h", "_course"], [Scan("_n", F.lit(1), "sum")],
                 plan_splits(courses, ["_all"], "_h"))
    dealt = dealt.select("_course", F.pmod(F.col("_n") - 1, F.lit(folds)).cast("int").alias("fold"))
    return cohort.withColumn("_course", F.coalesce("course_key", F.lit(""))).join(dealt, "_course").drop("_course")


# ------------------------------------------------------------------------ train curves


@dataclass
class Curves:
    """Fitted curves of all folds and the cells they belong to."""

    points: DataFrame  # cell, t, survival
    cells: DataFrame  # fold, kind, key, bucket, n, lead, cell (null below the row minimum)


def _expand(rows: DataFrame, folds: Sequence[int] | None) -> DataFrame:
    """Copy pre-aggregated rows of a fold to every other fold (grouped splits)."""
    if folds is None:
        return rows
    targets = F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: f != F.col("fold"))
    return rows.withColumn("fold", F.explode(targets))


def fit_curves(train: DataFrame, *, min_n: int = 30, folds: Sequence[int] | None = None) -> Curves:
    """Curves for all rows, buckets, departments and courses by bucket.

    ``train`` has ``fold``: the fold it trains, or with ``folds`` given the fold
    it belongs to (it then trains the others). Department and course curves
    need ``min_n`` rows.
    """
    place = F.col("position_bucket")
    cells = F.array(
        F.struct(F.lit("all").alias("kind"), F.lit("").alias("key"), F.lit("").alias("bucket")),
        F.struct(F.lit("bucket").alias("kind"), F.lit("").alias("key"), place.alias("bucket")),
        F.struct(F.lit("dept").alias("kind"), F.col("dept_group").alias("key"), place.alias("bucket")),
        F.struct(F.lit("course").alias("kind"), F.col("course_key").alias("key"), place.alias("bucket")),
    )
    base = train.select("fold", "dept_group", "course_key", "position_bucket", "duration_days", "event",
                        "days_to_instruction", cells.alias("_cells"))
    rows = base.select("fold", F.explode("_cells").alias("c"), "duration_days", "event", "days_to_instruction")
    rows = rows.select("fold", "c.*", F.col("duration_days").alias("t"), "event", "days_to_instruction")
    rows = rows.where(F.col("key").isNotNull() & F.col("bucket").isNotNull())
    events = rows.groupBy(*CURVE, "t").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("d"))
    if folds is not None:
        events = _expand(events, folds).groupBy(*CURVE, "t").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    events = materialize(events)
    lead = rows.where("kind IN ('bucket', 'course')").groupBy(*CURVE, "days_to_instruction").agg(
        F.count(F.lit(1)).alias("_m"))
    if folds is not None:
        lead = _expand(lead, folds).groupBy(*CURVE, "days_to_instruction").agg(F.sum("_m").alias("_m"))
    lead = quantiles(lead, CURVE, "days_to_instruction", [0.5], "_m", "_q").select(*CURVE, F.col("_q")[0].alias("lead"))
    sizes = events.groupBy(*CURVE).agg(F.sum("n").alias("n")).join(lead, CURVE, "left")
    enough = F.col("kind").isin("all", "bucket") | (F.col("n") >= min_n)
    # written before use, so the numbers stay what they are
    cells = materialize(sizes.withColumn("cell", F.when(enough, F.monotonically_increasing_id())))
    named = checked_broadcast(cells.where("cell IS NOT NULL").select(*CURVE, "cell"))
    fitted = events.join(named, CURVE).groupBy("cell", "t").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return Curves(km.curves(fitted, ["cell"]).select("cell", "t", "survival"), cells)


def predict_curves(test: DataFrame, curves: Curves) -> DataFrame:
    """Add p_bucket, p_dept, p_course, course_level, p_site and site_fallback.

    ``test`` has ``fold`` and ``h``. Each row finds the cells of its ladder
    (course, department, bucket, all); the distinct (cell, time) pairs of all
    four predictors are then read in one ordered pass.
    """
    n = curves.cells.count()
    hint = lambda df: counted_broadcast(df, n)
    of = lambda kind: curves.cells.where(F.col("kind") == kind)
    place = F.col("bucket").alias("position_bucket")
    depts = hint(of("dept").select("fold", F.col("key").alias("subject"), F.lit(True).alias("_known")).distinct())
    dept = hint(of("dept").select("fold", F.col("key").alias("_dept"), place, F.col("cell").alias("_c_dept")))
    course = hint(of("course").select("fold", F.col("key").alias("course_key"), place, F.col("cell").alias("_c_course"),
                                      F.col("lead").alias("_course_lead"), F.lit(True).alias("_has_lead")))
    bucket = hint(of("bucket").select("fold", place, F.col("cell").alias("_c_bucket"), F.col("lead").alias("_bucket_lead")))
    every = hint(of("all").select("fold", F.col("cell").alias("_c_all")).join(
        of("bucket").groupBy("fold").agg(F.percentile("lead", 0.5).alias("_any_lead")), "fold", "left"))
    rows = test.join(depts, ["fold", "subject"], "left")
    rows = rows.withColumn("_dept", F.when(F.col("_known"), F.col("subject")).otherwise("OTHER"))
    rows = rows.join(dept, ["fold", "_dept", "position_bucket"], "left")
    rows = rows.join(course, ["fold", "course_key", "position_bucket"], "left")
    rows = rows.join(bucket, ["fold", "position_bucket"], "left").join(every, "fold", "left")
    rows = rows.withColumn("_bucket", F.coalesce("_c_bucket", "_c_all"))
    rows = rows.withColumn("_by_dept", F.coalesce("_c_dept", "_bucket"))
    rows = rows.withColumn("_by_course", F.coalesce("_c_course", "_by_dept"))
    lead = F.coalesce("_course_lead", "_bucket_lead", "_any_lead", F.lit(0.0))
    rows = rows.withColumns({
        "_by_site": F.when(F.col("_has_lead"), F.col("_by_course")).otherwise(F.col("_bucket")),
        "_at": F.greatest("h", F.lit(0.0)), "_at_site": F.greatest(lead, F.lit(0.0)),
        "site_fallback": F.col("_has_lead").isNull(),
        "course_level": F.when(F.col("_c_course").isNotNull(), "course").when(F.col("_c_dept").isNotNull(), "dept")
        .when(F.col("_c_bucket").isNotNull(), "bucket").otherwise("all"),
    })
    reads = {"_bucket": "_at", "_by_dept": "_at", "_by_course": "_at", "_by_site": "_at_site"}
    asked = rows.select(F.inline(F.array(*[F.struct(F.col(c).alias("cell"), F.col(h).alias("at")) for c, h in reads.items()])))
    read = lookup_side(read_steps(asked, curves.points, ["cell"], "t", "survival"))
    for c, h in reads.items():
        side = read.select(F.col("cell").alias(c), F.col("at").alias(h), (F.lit(1.0) - F.coalesce("value", F.lit(1.0))).alias(f"p{c}"))
        rows = rows.join(side, [c, h], "left")
    return rows.select(
        *test.columns, F.col("p_bucket"), F.col("p_by_dept").alias("p_dept"), F.col("p_by_course").alias("p_course"),
        "course_level", F.round("p_by_site", 2).alias("p_site"), "site_fallback")


def observability(test: DataFrame) -> Column:
    """Followed at least to the horizon; an unknown follow-up is unlimited."""
    follow = F.when(F.isnan("follow_up_days"), None).otherwise(F.col("follow_up_days"))
    return follow.isNull() | (follow + F.lit(1e-9) >= F.col("h"))


def coverage(test: DataFrame) -> DataFrame:
    """Per phase: rows, rows observable at their horizon, and the share."""
    rows = test.withColumn("_ok", observability(test).cast("int"))
    return rows.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.sum("_ok").alias("observable"),
                                     F.round(F.avg("_ok"), 4).alias("share_observable"))


# ---------------------------------------------------------------------------- scoring


def with_weights(pred: DataFrame, *, g_floor: float = G_FLOOR, by: Sequence[str] = ()) -> DataFrame:
    """Add ``y`` (cleared by the horizon) and its inverse-censoring weight ``w``.

    The censoring curve is read just before each row's own end when it cleared,
    and at the horizon when it was still waiting; otherwise the weight is 0.
    """
    by = list(by) or ["_all"]
    rows = pred.withColumn("_all", F.lit(1)) if by == ["_all"] else pred
    events = km.event_table(rows, by, event=F.lit(1) - F.col("event"))
    points = km.curves(events, by).select(*by, "t", "survival")
    rows = step_lookup(rows, points, by, "duration_days", "t", "survival", "_g_t", left=True)
    rows = step_lookup(rows, points, by, "horizon_days", "t", "survival", "_g_h")
    cleared = (F.col("event") == 1) & (F.col("duration_days") <= F.col("horizon_days"))
    floor = lambda c: F.greatest(F.col(c), F.lit(g_floor))
    weight = F.when(cleared, F.lit(1.0) / floor("_g_t")).when(
        F.col("duration_days") > F.col("horizon_days"), F.lit(1.0) / floor("_g_h")).otherwise(F.lit(0.0))
    return rows.withColumns({"y": cleared.cast("double"), "w": weight}).drop("_g_t", "_g_h", "_all")


def long_predictions(scored: DataFrame, predictors: Sequence[str] = PREDICTORS,
                     keep: Sequence[str] = ("phase", "position_bucket")) -> DataFrame:
    """One row per scored row and predictor."""
    have = [p for p in predictors if f"p_{p}" in scored.columns]
    flag = lambda p: F.col(f"{p}_fallback") if f"{p}_fallback" in scored.columns else F.lit(False)
    each = F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(f"p_{p}").alias("p"), flag(p).alias("fallback"))
                     for p in have])
    return scored.select(ROW_ID, "section_id", "y", "w", *keep, F.inline(each))


def _known() -> Column:
    return (F.col("w") > 0) & F.col("p").isNotNull() & ~F.isnan("p")


def brier_of() -> Column:
    """Self-normalised weighted squared error over rows with a known outcome."""
    miss = F.col("y") - F.col("p")
    return F.try_divide(F.sum(F.when(_known(), F.col("w") * miss * miss)), F.sum(F.when(_known(), F.col("w"))))


def brier_table(long: DataFrame, by: Sequence[str] = ("predictor",)) -> DataFrame:
    return long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("w") > 0).alias("brier_rows"),
        F.round(F.avg((F.col("w") == 0).cast("int")), 4).alias("share_unknown"),
        brier_of().alias("brier"), F.round(F.avg(F.col("fallback").cast("int")), 4).alias("share_fallback"))


def brier_by(long: DataFrame) -> DataFrame:
    """Brier by phase and by position bucket, as ``dimension, value, predictor``."""
    dims = F.array(F.struct(F.lit("phase").alias("dimension"), F.col("phase").alias("value")),
                   F.struct(F.lit("position_bucket").alias("dimension"), F.col("position_bucket").alias("value")))
    rows = long.select("predictor", "p", "y", "w", "fallback", F.inline(dims))
    return rows.groupBy("dimension", "value", "predictor").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("w") == 0).cast("int")), 4).alias("share_unknown"),
        brier_of().alias("brier"))


def weighted_auc(long: DataFrame, by: Sequence[str] = ("predictor",)) -> DataFrame:
    """Weighted chance that a cleared row is ranked above one still waiting, ties half.

    Weights are summed per distinct prediction before the ordered pass.
    """
    by = list(by)
    per_p = long.where(_known()).groupBy(*by, "p").agg(
        F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("_pos"),
        F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0.0)).alias("_neg"))
    ranked = scan(per_p, by, ["p"], [Scan("_below", F.col("_neg"), "sum", inclusive=False)],
                  plan_splits(per_p, by, "p"))
    above = F.col("_pos") * (F.coalesce("_below", F.lit(0.0)) + F.lit(0.5) * F.col("_neg"))
    return ranked.groupBy(*by).agg(F.try_divide(
        F.sum(above), F.nullif(F.sum("_pos") * F.sum("_neg"), F.lit(0.0))).alias("auc"))


def calibration(long: DataFrame, by: Sequence[str] = ("predictor",), deciles: int = 10) -> DataFrame:
    """Weighted predicted and observed shares in equal-count bins of the prediction.

    A row's rank is the number of rows with smaller predictions plus its place
    among equal predictions (by row id). Most predictions lie in one bin with all
    their rows, which then count without an order of their own; only the rows of the
    predictions that an edge cuts, fewer than there are bins, are ranked, in ranges.
    """
    by = list(by)
    rows = long.where(_known())
    sums = {"_m": F.count(F.lit(1)), "_w": F.sum("w"), "_wp": F.sum(F.col("w") * F.col("p")), "_wy": F.sum(F.col("w") * F.col("y"))}
    added = [c.alias(name) for name, c in sums.items()]
    per_p = materialize(rows.groupBy(*by, "p").agg(*added))
    below = scan(per_p, by, ["p"], [Scan("_below", F.col("_m"), "sum", inclusive=False)],
                 plan_splits(per_p, by, "p")).withColumn("_below", F.coalesce("_below", F.lit(0)))
    totals = per_p.groupBy(*by).agg(F.sum("_m").alias("_n"), F.least(
        F.lit(deciles), F.greatest(F.lit(1), F.count(F.lit(1)))).alias("_bins"))

    def decile(rank: Column) -> Column:
        position = F.try_divide((rank - 1) * F.col("_bins"), (F.col("_n") - 1).cast("double"))
        return (F.greatest(F.ceil(F.coalesce(position, F.lit(0.0))), F.lit(1)) - 1).cast("int")

    placed = below.join(totals, by).withColumns({
        "decile": decile(F.col("_below") + 1), "_last": decile(F.col("_below") + F.col("_m"))})
    whole = placed.where(F.col("decile") == F.col("_last")).select(*by, "decile", *sums)
    cut = lookup_side(placed.where(F.col("decile") < F.col("_last")).select(*by, "p", "_below", "_n", "_bins"))
    part = rows.select(*by, "p", ROW_ID, "w", "y").join(cut, [*by, "p"])
    within = scan(part, [*by, "p"], [ROW_ID], [Scan("_place", F.lit(1), "sum")], plan_splits(part, [*by, "p"], ROW_ID))
    ranked = within.withColumn("decile", decile(F.col("_below") + F.col("_place"))).groupBy(*by, "decile").agg(*added)
    return whole.unionByName(ranked).groupBy(*by, "decile").agg(
        F.sum("_m").alias("n"), F.sum("_w").alias("weight"), (F.sum("_wp") / F.sum("_w")).alias("predicted"),
        (F.sum("_wy") / F.sum("_w")).alias("observed"))


def score(pred: DataFrame, *, n_boot: int = 200, seed: int = 0, g_floor: float = G_FLOOR,
          predictors: Sequence[str] = PREDICTORS) -> dict[str, DataFrame]:
    """metrics, by (phase and bucket) and calibration of pooled predictions."""
    scored = materialize(with_weights(pred, g_floor=g_floor))
    long = long_predictions(scored, predictors)
    table = brier_table(long).join(weighted_auc(long), "predictor", "left")
    base = brier_table(long.where(F.col("predictor") == BASELINE)).select(
        F.col("brier").alias("brier_baseline"), F.lit(1).alias("_one"))
    table = table.withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one").drop("_one")  # one row
    gain = F.col("brier_baseline") - F.col("brier")
    table = table.withColumns({
        "gain": gain,
        "skill": F.when(F.col("brier_baseline") > 0, F.lit(1.0) - F.col("brier") / F.col("brier_baseline"))})
    if n_boot > 0:
        have = [p for p in predictors if f"p_{p}" in scored.columns]
        wide = scored.select("section_id", "y", "w", F.col(f"p_{BASELINE}").alias("p_base"), F.inline(F.array(*[
            F.struct(F.lit(p).alias("predictor"), F.col(f"p_{p}").alias("p_model")) for p in have if p != BASELINE])))
        bands = bootstrap_gain(wide, ["predictor"], "p_base", "p_model", n_boot=n_boot, seed=seed)
        table = table.join(bands, "predictor", "left").withColumns({
            c: F.when(F.col("predictor") == BASELINE, F.lit(0.0)).otherwise(F.col(c))
            for c in ("gain_ci_low", "gain_ci_high")})
    return {"metrics": table, "by": brier_by(long), "calibration": calibration(long)}


# ------------------------------------------------------------------------------- runs


@dataclass
class Backtest:
    split: str
    which: str
    predictions: DataFrame | None
    coverage: DataFrame | None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)


def with_horizon(test: DataFrame, calendar, which: str) -> DataFrame:
    """Add each test row's horizon ``h`` in days, and a tie-break."""
    return with_row_id(test).withColumn("h", horizon_days(F.col("join_time"), calendar, which))


def test_counts(test: DataFrame) -> dict[str, int]:
    """Scored rows, rows past their horizon when they joined, and rows whose follow-up ends before it."""
    ahead = F.coalesce(F.col("h") > 0, F.lit(False))
    row = test.agg(F.count_if(ahead & observability(test)).alias("n_test"), F.count_if(~ahead).alias("n_excluded"),
                   F.count_if(ahead & ~observability(test)).alias("n_unobservable")).first()
    return row.asDict()


def predict_split(train: DataFrame, test: DataFrame, calendar, which: str, *, min_n: int = 30,
                  folds: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Curve predictions of every scorable test row, and the coverage table."""
    test = with_horizon(test, calendar, which).where("h > 0")
    covered = coverage(test)
    rows = test.where(observability(test))
    return predict_curves(rows, fit_curves(train, min_n=min_n, folds=folds)).withColumn("horizon_days", F.col("h")), covered


def run_backtest(cohort: DataFrame, calendar, *, split: str = "temporal", which: str = "deadline",
                 split_at: dt.datetime | None = None, train_cohort: DataFrame | None = None, folds: int = 5,
                 n_boot: int = 200, seed: int = 0, min_n: int = 30, as_of: bool = True, with_cox: bool = True,
                 cox_max_rows: int | None = None) -> Backtest:
    """Fit on one part, score the other; folds too small to fit are skipped with a note."""
    notes = [f"weights floored at {G_FLOOR}; intervals from {n_boot} section resamples"]
    fold_list = None
    if split == "temporal":
        if split_at is None:
            split_at = dt.datetime.combine(calendar.phase2_start, dt.time(), dt.timezone.utc)
        train, test = temporal_split(cohort, split_at, as_of)
        train, test = train.withColumn("fold", F.lit(0)), test.withColumn("fold", F.lit(0))
    elif split == "grouped":
        train = test = materialize(grouped_folds(cohort, folds, seed))
        fold_list = list(range(folds))
    elif split == "cross_term":
        if train_cohort is None:
            raise ValueError("cross_term needs train_cohort")
        train, test = train_cohort.withColumn("fold", F.lit(0)), cohort.withColumn("fold", F.lit(0))
    else:
        raise ValueError(f"unknown split {split!r}; expected temporal, grouped or cross_term")
    size = lambda df: {r["fold"]: (r["n"], r["e"] or 0) for r in df.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event").alias("e")).collect()}  # one row per fold
    trained, tested = size(train), size(test)
    if fold_list is not None:
        n_all, e_all = sum(v[0] for v in trained.values()), sum(v[1] for v in trained.values())
        trained = {f: (n_all - v[0], e_all - v[1]) for f, v in trained.items()}
    good = [f for f in tested if trained.get(f, (0, 0))[0] >= MIN_TRAIN_ROWS
            and trained[f][1] >= MIN_TRAIN_EVENTS and tested[f][0] > 0]
    notes += [f"skipped fold {f}: {trained.get(f, (0, 0))} training rows and events" for f in tested if f not in good]
    counts = {"n_train": sum(v[0] for v in trained.values())}
    if not good:
        return Backtest(split, which, None, None, {}, counts, [*notes, "too few training rows"])
    test = test.where(F.col("fold").isin(good))
    counts |= test_counts(with_horizon(test, calendar, which))
    pred, covered = predict_split(train, test, calendar, which, min_n=min_n, folds=fold_list)
    pred = materialize(pred)
    if counts["n_test"] < MIN_TEST_ROWS:
        return Backtest(split, which, pred, covered, {}, counts, [*notes, f"too few scored rows ({counts['n_test']})"])
    if with_cox:
        pred, extra = add_cox(train, pred, good, fold_list is not None, cox_max_rows, seed)
        notes += extra
    tables = score(pred, n_boot=n_boot, seed=seed)
    return Backtest(split, which, pred, covered, tables, counts, notes)


def add_cox(train: DataFrame, pred: DataFrame, folds: Sequence[int], grouped: bool, max_rows: int | None,
            seed: int) -> tuple[DataFrame, list[str]]:
    """Add ``p_cox``; the folds' models are fitted together, unless each is to have its own ``max_rows`` rows. A fold
    without a model repeats the bucket baseline with a note."""
    fits, notes = {}, []
    try:
        if grouped and max_rows is None:
            fits = cox.fit_folds(train, folds)
        else:
            for fold in folds:
                own = train.where(F.col("fold") != fold) if grouped else train
                fits[fold] = cox.fit(own, max_rows=max_rows, seed=seed, robust=False)
    except (cox.NoFit, np.linalg.LinAlgError) as problem:
        notes.append(f"no proportional-hazards fit: {problem}")
    notes += [f"no proportional-hazards fit for fold {fold}" for fold in folds if fold not in fits]
    notes += [f"the hazards fit of fold {fold} had not converged after {fit.iterations} steps"
              for fold, fit in fits.items() if not fit.converged]
    shared = len({tuple(fit.names) for fit in fits.values()}) <= 1  # separate samples may lack covariates
    if shared:
        return materialize(cox.predict(pred, fits, "horizon_days", "p_bucket", by_subject=True)), notes
    out = None
    for fold in folds:
        own = {fold: fits[fold]} if fold in fits else {}
        part = cox.predict(pred.where(F.col("fold") == fold), own, "horizon_days", "p_bucket", by_subject=True)
        out = part if out is None else out.unionByName(part)
    return materialize(out), notes


def write_tables(run: Backtest, out_dir: str) -> None:
    """metrics, by, calibration, coverage and counts as CSV folders, predictions as Parquet."""
    spark = SparkSession.active()
    names = ("n_train", "n_test", "n_excluded", "n_unobservable")
    counts = spark.createDataFrame([tuple(run.counts.get(n, 0) for n in names)], ", ".join(f"{n} long" for n in names))
    for name, table in {**run.tables, "coverage": run.coverage, "counts": counts}.items():
        if table is not None:
            table.write.mode("overwrite").option("header", True).csv(f"{out_dir}/{name}")
    if run.predictions is not None:
        run.predictions.write.mode("overwrite").parquet(f"{out_dir}/predictions")
