"""Proportional hazards on Spark: fit, robust errors, residual test, prediction.

Times are rounded up to a fixed resolution, so the distinct times of a study
are bounded by its length, not by its rows. Each Newton step makes two passes:

1. sums per (stratum, time) of the risk weights and weighted covariates, reduced
   map-side over rows spread by hash (a tied time is never one task), and from them
   the cumulative hazards of each stratum: one job, whose small result is written;
2. with those hazards joined to the rows, the weighted covariate products, reduced
   to one d x d matrix.

The models of several folds are fitted together: the model is a key of the sums, a
row is read once a pass and counts in every model that trains on it. So a backtest
needs as many passes as its slowest fold, and no row is copied to the folds.

The per-time tables stay in Spark: a task turns the times of one model's stratum into
hazards, and the driver holds d x d numbers only. Ties follow Efron in the
likelihood, exactly for any number of ties; residuals use the tie-free (Breslow)
form on the same sums.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.special import chi2_1_p, digamma, trigamma
from turnwise.operators.scans import step_lookup
from turnwise.session import checked_broadcast, counted_broadcast, materialize

# Covariates, reference levels, time resolution, penalty.
NUMERIC = ("log_position", "wl_ratio", "days_to_instruction", "reserved")
REFERENCES = {"level": "lower", "dept_group": "OTHER", "phase": "phase1"}
TIME_RESOLUTION_DAYS = 0.01
PENALIZER = 0.01
#: Sums of up to so many tied terms are added one by one, longer ones in closed form; both are exact to rounding.
_TERM_BY_TERM = 4096
#: (stratum, time) sums that a task holds before it sends them on.
_HELD_KEYS = 20_000
#: Of the quadrature over ties: worked out once, not for every time.
_NODES, _NODE_WEIGHTS = np.polynomial.legendre.leggauss(64)


class NoFit(ValueError):
    """The cohort has nothing to fit: no event, or no covariate that varies."""


@dataclass
class Design:
    """Compact rows: ``fold, stratum, t, event, section_id``, one column per numeric covariate
    and one code per categorical family (0 is the reference or an unused level).

    ``models`` are the folds that get a model, trained on the rows of all other folds; one model on all rows if None."""

    rows: DataFrame
    numeric: list[str]
    families: dict[str, list[str]]
    models: list[int] | None = None

    @property
    def keys(self) -> list[int]:
        return [0] if self.models is None else self.models

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *[f"{f}={v}" for f, levels in self.families.items() for v in levels]]


@dataclass
class CoxFit:
    names: list[str]
    beta: np.ndarray
    variance: np.ndarray  # inverse of the penalised information
    robust: np.ndarray  # clustered by section
    baseline: DataFrame  # stratum, t, survival
    log_likelihood: float
    iterations: int
    n: int
    events: int
    means: np.ndarray
    strata: list[str] = field(default_factory=list)
    design: Design | None = None
    times: DataFrame | None = None  # per (stratum, time): see ``_study_table``
    converged: bool = True
    gradient: np.ndarray | None = None  # with the penalty's part, at ``beta``

    @property
    def step(self) -> np.ndarray:
        """The Newton step from ``beta``."""
        return self.variance @ self.gradient

    def summary(self, spark) -> DataFrame:
        """Coefficients with clustered errors, ratios and p-values."""
        se = np.sqrt(np.maximum(np.diag(self.robust), 0.0))
        rows = [(n, float(b), float(np.exp(b)), float(s), float(np.sqrt(max(v, 0.0))))
                for n, b, s, v in zip(self.names, self.beta, se, np.diag(self.variance))]
        out = spark.createDataFrame(
            rows, "covariate string, coef double, hazard_ratio double, robust_se double, model_se double")
        z = F.try_divide("coef", "robust_se")
        return out.withColumn("z", z).withColumn("p", chi2_1_p(z * z))


# -------------------------------------------------------------------- design matrix


def _numeric(name: str) -> Column:
    value = F.col(name)
    return value.cast("int").cast("double") if name == "reserved" else value.cast("double")


def _usable(names: Sequence[str] = NUMERIC) -> Column:
    out = F.col("duration_days").isNotNull()
    for name in names:
        value = _numeric(name)
        out = out & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return out


def design_matrix(cohort: DataFrame, *, resolution: float = TIME_RESOLUTION_DAYS, strata: Sequence[str] = (),
                  models: Sequence[int] | None = None) -> Design:
    """Rows with every numeric covariate known, durations rounded up to the resolution;
    constant columns and levels are left out. ``strata`` families become strata. With ``models`` the cohort has ``fold``.

    The rows are written once, in even ranges of sections, and every pass reads them back. A section's rows lie together,
    so its scores are added up where they are read; one with more rows than a range is cut by time.
    """
    families = [f for f in REFERENCES if f not in strata]
    ref = lambda f: F.col(f).isNull() | (F.col(f) == REFERENCES[f])
    time = F.ceil(F.col("duration_days") / F.lit(resolution)) * F.lit(resolution)
    stratum = F.lit("") if not strata else F.concat_ws("|", *[
        F.when(ref(f), F.lit(f"{f}=ref")).otherwise(F.concat(F.lit(f"{f}="), F.col(f))) for f in strata])
    fold = F.lit(0) if models is None else F.col("fold").cast("int")
    base = cohort.where(_usable()).select(
        fold.alias("fold"), stratum.alias("stratum"), time.alias("t"), F.col("event").cast("int").alias("event"),
        F.col("section_id").cast("string").alias("section_id"), *[_numeric(c).alias(c) for c in NUMERIC],
        *[F.when(~ref(f), F.col(f)).alias(f) for f in families])
    parts = int(cohort.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    base = materialize(base.repartitionByRange(parts, "section_id", "t", *NUMERIC).sortWithinPartitions("section_id"))
    spread = base.agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"lo_{c}") for c in NUMERIC],
                      *[F.max(c).alias(f"hi_{c}") for c in NUMERIC]).first()
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in families]) if families else F.array()
    # category names and counts only
    seen = base.select(F.inline(pairs)).where("v IS NOT NULL").groupBy("f", "v").count().collect() if families else []
    levels = {f: sorted(r["v"] for r in seen if r["f"] == f and r["count"] < spread["n"]) for f in families}
    numeric = [c for c in NUMERIC if spread[f"lo_{c}"] is not None and spread[f"lo_{c}"] < spread[f"hi_{c}"]]
    rows = _coded(base, levels).select("fold", "stratum", "t", "event", "section_id", *numeric, *[f"_{f}" for f in levels])
    return Design(rows, numeric, levels, None if models is None else list(models))


def _coded(rows: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """Add ``_family``: the 1-based number of the row's level, 0 for any other."""
    codes = {}
    for family, levels in families.items():
        place = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(family)) if levels else F.lit(0)
        codes[f"_{family}"] = F.coalesce(place, F.lit(0)).cast("int")
    return rows.withColumns(codes) if codes else rows


def sample_rows(cohort: DataFrame, max_rows: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """A deterministic subsample: the rows with the smallest hashes (a top-k, no global sort)."""
    return cohort.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(max_rows)


# ----------------------------------------------------------------------------- fit


class _Batch:
    """Columns of one Arrow batch and the sparse sums over them."""

    def __init__(self, batch: pa.RecordBatch, numeric: Sequence[str], families: dict[str, list[str]], center: np.ndarray):
        get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        self.t, self.died, self.fold = get("t"), get("event").astype(float), get("fold")
        self.stratum = batch.column("stratum")
        self.section = batch.column("section_id")
        self.x = np.column_stack([get(c) for c in numeric]) - center[:len(numeric)] if numeric else np.empty((batch.num_rows, 0))
        self.codes = [get(f"_{f}") for f in families]
        self.sizes = [len(v) for v in families.values()]

    def trains(self, model: int, grouped: bool) -> np.ndarray:
        """1 for the rows that the model is trained on, else 0."""
        return (self.fold != model).astype(float) if grouped else np.ones(len(self.t))

    def linear(self, beta: np.ndarray) -> np.ndarray:
        k = self.x.shape[1]
        out = self.x @ beta[:k]
        for codes, size in zip(self.codes, self.sizes):
            out = out + np.append(0.0, beta[k:k + size])[codes]
            k += size
        return out

    def sums_by(self, slot: np.ndarray, n: int, weight: np.ndarray) -> np.ndarray:
        """Weighted covariate sums per slot, without spelling out the indicators."""
        parts = [np.bincount(slot, weight * self.x[:, j], minlength=n)[:, None] for j in range(self.x.shape[1])]
        for codes, size in zip(self.codes, self.sizes):
            cells = np.bincount(slot * (size + 1) + codes, weight, minlength=n * (size + 1))
            parts.append(cells.reshape(n, size + 1)[:, 1:])
        return np.concatenate(parts, axis=1)

    def products(self, weight: np.ndarray) -> np.ndarray:
        """Sum of weight * x x'."""
        blocks = [[(self.x * weight[:, None]).T @ self.x]]
        for codes, size in zip(self.codes, self.sizes):
            blocks[0].append(np.stack([np.bincount(codes, weight * self.x[:, j], minlength=size + 1)[1:]
                                       for j in range(self.x.shape[1])]) if self.x.shape[1] else np.empty((0, size)))
        for i, (a, na) in enumerate(zip(self.codes, self.sizes)):
            row = [blocks[0][1 + i].T]
            for c, nc in zip(self.codes, self.sizes):
                row.append(np.bincount(a * (nc + 1) + c, weight, minlength=(na + 1) * (nc + 1)).reshape(na + 1, nc + 1)[1:, 1:])
            blocks.append(row)
        return np.block(blocks)

    def dense(self) -> np.ndarray:
        parts = [self.x]
        for codes, size in zip(self.codes, self.sizes):
            parts.append(np.eye(size + 1)[codes][:, 1:])
        return np.concatenate(parts, axis=1)


def _lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()))


def _merge_lists(pieces: DataFrame, keys: Sequence[str], types: str) -> DataFrame:
    """Add up list columns ``v`` per key: rows of a key meet in one task, in order, and are summed as they pass."""
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last key so far
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            columns = [rows.column(k).to_numpy() for k in keys]
            new = np.zeros(rows.num_rows, bool)
            new[0] = True
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            values = rows.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            summed = pa.RecordBatch.from_arrays(
                [*[rows.column(k).chunk(0).take(pa.array(at)) for k in keys], _lists(np.add.reduceat(values, at, axis=0))],
                [*keys, "v"])
            held = summed.slice(len(at) - 1)
            if len(at) > 1:
                yield summed.slice(0, len(at) - 1)
        if held is not None:
            yield held

    return pieces.select(*keys, "v").repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(add, f"{types}, v array<double>")


def _time_sums(design: Design, betas: dict[int, np.ndarray], center: np.ndarray) -> DataFrame:
    """Per (model, stratum, time), as list ``v``: rows, events, risk weights and covariate sums.

    A task sends one row per model and time it holds, so what moves is tasks x times.
    """
    numeric, families, grouped = design.numeric, design.families, design.models is not None
    width = 4 + 3 * len(center)

    def packed(keys: dict, sums: np.ndarray) -> pa.RecordBatch:
        n = len(keys)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(list(betas), np.int32), n)), pa.array([k[0] for k in keys] * len(betas), pa.string()),
             pa.array([k[1] for k in keys] * len(betas), pa.float64()), _lists(sums[:, :n].reshape(-1, width))],
            ["model", "stratum", "t", "v"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict = {}
        held = np.zeros((len(betas), 1024, width))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            b = _Batch(batch, numeric, families, center)
            coded = b.stratum.dictionary_encode()
            names, group = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            at, t = pd.factorize(b.t, use_na_sentinel=False)
            slot, used = pd.factorize(group * len(t) + at)
            n = len(used)
            place = np.array([keys.setdefault((names[u // len(t)], t[u % len(t)]), len(keys)) for u in used])
            while len(keys) > held.shape[1]:
                held = np.concatenate([held, np.zeros_like(held)], axis=1)
            count = lambda w: np.bincount(slot, w, minlength=n)[:, None]
            for m, (model, beta) in enumerate(betas.items()):
                own = b.trains(model, grouped)
                weight, died = np.exp(b.linear(beta)) * own, b.died * own
                held[m, place] += np.concatenate([
                    count(own), count(died), count(weight), count(weight * died),
                    b.sums_by(slot, n, weight), b.sums_by(slot, n, weight * died), b.sums_by(slot, n, died)], axis=1)
            if len(keys) > _HELD_KEYS:
                yield packed(keys, held)
                keys, held = {}, np.zeros((len(betas), 1024, width))
        if keys:
            yield packed(keys, held)

    pieces = design.rows.mapInArrow(partial, "model int, stratum string, t double, v array<double>")
    return _merge_lists(pieces, ["model", "stratum", "t"], "model int, stratum string, t double")


def _quadrature(f, slope, m: int) -> float:
    """Sum of f(l / m) over l < m for a smooth f and large m (Euler and Maclaurin)."""
    return float(m * (_NODE_WEIGHTS / 2 * f((_NODES + 1) / 2)).sum() + (f(0.0) - f(1.0)) / 2 + (slope(1.0) - slope(0.0)) / (12 * m))


def _tie_sum(m: int, s0: float, d0: float, power: int, degree: int) -> float:
    """Sum over l < m of (l/m)^degree / (s0 - l/m d0)^power, exact to rounding for any m.

    With a = m s0 / d0 the terms are powers of 1 / (a - l), so their sums are differences of the digamma and trigamma
    functions. Those lose digits where the dying are few among those at risk; there the terms change so little that
    quadrature with its end corrections is exact.
    """
    if m <= _TERM_BY_TERM:
        u = np.arange(m) / m
        return float((u**degree / (s0 - u * d0) ** power).sum())
    if d0 <= s0 / 2:
        f = lambda u: u**degree / (s0 - u * d0) ** power
        slope = lambda u: ((degree * u ** (degree - 1) if degree else 0.0) / (s0 - u * d0) ** power
                           + u**degree * power * d0 / (s0 - u * d0) ** (power + 1))
        return _quadrature(f, slope, m)
    a = max(m * s0 / d0, float(m))  # all at risk may die: rounding must not push it below
    first = digamma(a + 1) - digamma(a - m + 1)
    if power == 1:
        return m / d0 * first if degree == 0 else (a * first - m) / d0
    second = trigamma(a - m + 1) - trigamma(a + 1)
    return {0: m * m * second, 1: m * (a * second - first), 2: a * a * second - 2 * a * first + m}[degree] / d0**2


def _tie_log(m: int, s0: float, d0: float) -> float:
    """Sum over l < m of log(s0 - l/m d0)."""
    if m <= _TERM_BY_TERM:
        return float(np.log(s0 - np.arange(m) / m * d0).sum())
    if d0 <= s0 / 2:
        return _quadrature(lambda u: np.log(s0 - u * d0), lambda u: -d0 / (s0 - u * d0), m)
    a = max(m * s0 / d0, float(m))
    return m * math.log(d0 / m) + math.lgamma(a + 1) - math.lgamma(a - m + 1)


def _tie_sums(deaths: np.ndarray, s0: np.ndarray, d0: np.ndarray, power: int, degree: int) -> np.ndarray:
    """``_tie_sum`` per time."""
    out = np.zeros(len(deaths))
    for i in np.flatnonzero(deaths > 0):
        out[i] = _tie_sum(int(deaths[i]), float(s0[i]), float(d0[i]), power, degree)
    return out


def _hazards(sums: np.ndarray, d: int) -> dict[str, np.ndarray]:
    """Risk sums and cumulative hazards at the ascending times of one stratum."""
    out = {"n": sums[:, 0], "deaths": sums[:, 1], "d0": sums[:, 3], "s1": sums[:, 4:4 + d],
           "d1": sums[:, 4 + d:4 + 2 * d], "e1": sums[:, 4 + 2 * d:4 + 3 * d]}
    s0 = np.cumsum(sums[::-1, 2])[::-1]
    s1 = np.cumsum(out["s1"][::-1], axis=0)[::-1]
    # where all at risk die the two sums are the same numbers in another order
    s0 = np.where(out["deaths"] == np.cumsum(out["n"][::-1])[::-1], np.maximum(s0, out["d0"]), s0)
    first = _tie_sums(out["deaths"], s0, out["d0"], 1, 0)
    own = _tie_sums(out["deaths"], s0, out["d0"], 1, 1)
    step = np.where(s0 > 0, out["deaths"] / np.where(s0 > 0, s0, 1.0), 0.0)
    mean = s1 / np.where(s0 > 0, s0, 1.0)[:, None]
    return {**out, "s0": s0, "risk1": s1, "first": first, "own": own, "total": np.cumsum(first), "step": step,
            "breslow": np.cumsum(step), "mean": mean}


def _per_stratum(table: DataFrame, d: int, build, schema: str) -> DataFrame:
    """``build(model, stratum, times, hazards)`` of every stratum. A task holds one stratum's times: at most the study's
    length over the time resolution."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t", ignore_index=True)
        own = build(frame["model"].iloc[0], frame["t"].to_numpy(), _hazards(np.stack(frame["v"].to_numpy()), d))
        return own.assign(model=frame["model"], stratum=frame["stratum"], t=frame["t"])

    return materialize(table.groupBy("model", "stratum").applyInPandas(run, f"model int, stratum string, t double, {schema}"))


def _newton_table(table: DataFrame, betas: dict[int, np.ndarray]) -> DataFrame:
    """Per (model, stratum, time) the hazards ``total`` and ``own``; a stratum's first row also has, as list ``pieces``,
    its log-likelihood, gradient and the second part of the information."""
    def build(model: int, t: np.ndarray, h: dict) -> pd.DataFrame:
        logs = sum(_tie_log(int(h["deaths"][i]), float(h["s0"][i]), float(h["d0"][i]))
                   for i in np.flatnonzero(h["deaths"] > 0))
        s1, d1 = h["risk1"], h["d1"]
        gradient = h["e1"].sum(axis=0) - (h["first"][:, None] * s1 - h["own"][:, None] * d1).sum(axis=0)
        # sum over ties of mean mean', expanded in powers of the tie fraction
        q = [_tie_sums(h["deaths"], h["s0"], h["d0"], 2, k) for k in (0, 1, 2)]
        cross = (s1 * q[1][:, None]).T @ d1
        second = (s1 * q[0][:, None]).T @ s1 - cross - cross.T + (d1 * q[2][:, None]).T @ d1
        pieces = np.concatenate([[float((h["e1"] @ betas[int(model)]).sum()) - logs], gradient, second.ravel()])
        return pd.DataFrame({"total": h["total"], "own": h["own"], "pieces": [pieces, *[None] * (len(t) - 1)]})

    return _per_stratum(table, len(next(iter(betas.values()))), build, "total double, own double, pieces array<double>")


def _study_table(table: DataFrame, d: int) -> DataFrame:
    """Per (model, stratum, time), for errors, test and prediction: deaths, breslow hazard, and lists ``e1`` (covariate sums
    of the dying), ``mean`` (of those at risk) and ``shift`` (cumulated hazard steps times means)."""
    def build(model: int, t: np.ndarray, h: dict) -> pd.DataFrame:
        shift = np.cumsum(h["step"][:, None] * h["mean"], axis=0)
        return pd.DataFrame({"deaths": h["deaths"], "breslow": h["breslow"],
                             "e1": list(h["e1"]), "mean": list(h["mean"]), "shift": list(shift)})

    return _per_stratum(table, d, build, "deaths double, breslow double, e1 array<double>, mean array<double>, "
                                         "shift array<double>")


def _summed(lists: DataFrame, column: str) -> np.ndarray:
    """Elementwise sum of a list column; as many rows come back as the lists are long."""
    rows = lists.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["i"]] = r["x"]
    return out


def _weighted_products(design: Design, newton: DataFrame, betas: dict[int, np.ndarray], center: np.ndarray,
                       points: int) -> dict[int, np.ndarray]:
    """Per model the sum over rows of weight * x x' with weights from the cumulative hazards.

    The hazards become one row per (stratum, time), ``points`` of them: that count decides on broadcasting them."""
    d, numeric, families, grouped = len(center), design.numeric, design.families, design.models is not None
    hazards = newton.groupBy("stratum", "t").agg(*[
        F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{c}_{m}") for m in betas for c in ("total", "own")])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {m: np.zeros((d, d)) for m in betas}
        for batch in batches:
            b = _Batch(batch, numeric, families, center)
            for m, beta in betas.items():
                hazard, own = (batch.column(f"{c}_{m}").to_numpy(zero_copy_only=False) for c in ("total", "own"))
                weight = np.exp(b.linear(beta)) * (hazard - b.died * own)
                totals[m] += b.products(np.where(b.trains(m, grouped) > 0, weight, 0.0))
        for m, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, m, np.int32)), pa.array(np.arange(d, dtype=np.int32)),
                                              _lists(total)], ["model", "i", "v"])

    rows = design.rows.join(counted_broadcast(hazards, points, 64 + 16 * len(betas)), ["stratum", "t"])
    return _squares(rows.mapInArrow(partial, "model int, i int, v array<double>"))


def _squares(pieces: DataFrame) -> dict[int, np.ndarray]:
    """The summed d x d matrix of row pieces, per model."""
    merged = _merge_lists(pieces, ["model", "i"], "model int, i int").toPandas().sort_values(["model", "i"])
    return {int(m): np.stack(own["v"].to_numpy()) for m, own in merged.groupby("model")}


def _score(design: Design, betas: dict[int, np.ndarray], center: np.ndarray):
    """Per-time hazards, and per model log-likelihood, gradient and the second part of the information."""
    d = len(center)
    newton = _newton_table(_time_sums(design, betas, center), betas)
    rows = newton.where("pieces IS NOT NULL").select("model", F.posexplode("pieces").alias("i", "x")) \
        .groupBy("model", "i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")  # d x d numbers a model
    out = {}
    for m, own in rows.groupby("model"):
        x = own["x"].to_numpy()
        out[int(m)] = float(x[0]), x[1:1 + d], x[1 + d:].reshape(d, d)
    return newton, out


def score_at(cohort: DataFrame, beta: dict[str, float]) -> DataFrame:
    """Log-likelihood, gradient and information's diagonal at given coefficients, without penalty, one row per covariate."""
    fitted = evaluate(cohort, beta, penalizer=0.0, robust=False)
    information = np.diag(np.linalg.inv(fitted.variance))
    rows = [(n, float(g), float(i), fitted.log_likelihood) for n, g, i in zip(fitted.names, fitted.gradient, information)]
    return cohort.sparkSession.createDataFrame(rows, "covariate string, gradient double, information double, log_likelihood double")


def evaluate(cohort: DataFrame, beta: dict[str, float], *, strata: Sequence[str] = (), penalizer: float = PENALIZER,
             robust: bool = True) -> CoxFit:
    """The model at given coefficients (0 where none is given): everything that ``fit`` says of its last point."""
    design = design_matrix(cohort, strata=strata)
    if not design.names:
        raise NoFit("no covariate varies in this cohort")
    center, stats = _moments(design)
    values = {0: np.array([beta.get(n, 0.0) for n in design.names])}
    newton, found = _score(design, values, center)
    value, gradient, second = found[0]
    ridge = stats[0].n * penalizer * stats[0].scale**2
    information = _weighted_products(design, newton, values, center, newton.count())[0] - second + np.diag(ridge)
    state = _Model(values[0], at=values[0], information=information, gradient=gradient - ridge * values[0],
                   best=value - 0.5 * float(ridge @ values[0]**2), steps=0)
    return _described(design, {0: state}, center, stats, robust, strata)[0]


@dataclass
class _Model:
    """Where one model's Newton iteration stands."""

    beta: np.ndarray
    at: np.ndarray | None = None  # the last accepted point, of which the following are known
    information: np.ndarray | None = None
    gradient: np.ndarray | None = None
    best: float = -np.inf
    step: np.ndarray | None = None
    steps: int = 0
    converged: bool = False


@dataclass
class _Stats:
    n: int
    events: int
    scale: np.ndarray


def fit(cohort: DataFrame, *, strata: Sequence[str] = (), penalizer: float = PENALIZER,
        max_rows: int | None = None, seed: int = 0, tolerance: float = 1e-7, max_steps: int = 30,
        robust: bool = True, keys: Sequence[str] = ("section_id", "join_time", "position")) -> CoxFit:
    """Ridge-penalised partial likelihood: penalty ``n * penalizer / 2 * |beta|^2`` on
    standardised covariates. Step halving keeps the likelihood rising; ``converged``
    is false when the steps ran out before they became small."""
    if max_rows is not None:
        cohort = sample_rows(cohort, max_rows, seed, keys)
    design = design_matrix(cohort, strata=strata)
    fitted = _fitted(design, penalizer, tolerance, max_steps, robust, strata)
    if not fitted:
        raise NoFit("no events to fit")
    return fitted[0]


def fit_folds(cohort: DataFrame, folds: Sequence[int], *, penalizer: float = PENALIZER, tolerance: float = 1e-7,
              max_steps: int = 30) -> dict[int, CoxFit]:
    """A model per fold, trained on the rows of all other folds (column ``fold``), in common passes over the rows.

    All have the covariates of the whole cohort; one that a fold's rows lack has no effect there. Folds without a training
    event have no model.
    """
    return _fitted(design_matrix(cohort, models=folds), penalizer, tolerance, max_steps, False, ())


def _fitted(design: Design, penalizer: float, tolerance: float, max_steps: int, robust: bool,
            strata: Sequence[str]) -> dict[int, CoxFit]:
    d = len(design.names)
    if d == 0:
        raise NoFit("no covariate varies in this cohort")
    center, stats = _moments(design)
    ridge = {m: s.n * penalizer * s.scale**2 for m, s in stats.items()}
    models = {m: _Model(np.zeros(d), step=np.zeros(d)) for m in design.keys if stats[m].events}
    points = None
    for _ in range(max_steps):
        betas = {m: s.beta for m, s in models.items() if not s.converged}
        if not betas:
            break
        newton, found = _score(design, betas, center)
        risen = {}
        for m, beta in betas.items():
            s, value = models[m], found[m][0] - 0.5 * float(ridge[m] @ beta**2)
            s.steps += 1
            if value < s.best - 1e-9 * abs(s.best) and np.abs(s.step).max() > 1e-12:
                s.step = s.step / 2
                s.beta = beta - s.step
            else:
                risen[m] = (beta, value - s.best)
                s.best = value
        if not risen:
            continue
        points = newton.count() if points is None else points
        products = _weighted_products(design, newton, {m: b for m, (b, _) in risen.items()}, center, points)
        for m, (beta, gain) in risen.items():
            s = models[m]
            s.at, s.information = beta, products[m] - found[m][2] + np.diag(ridge[m])
            s.gradient = found[m][1] - ridge[m] * beta
            s.step = np.linalg.solve(s.information, s.gradient)
            if float(s.gradient @ s.step) / 2 < tolerance * max(abs(s.best), 1.0) * 1e-3 or gain == 0.0:
                s.converged = True
            else:
                s.beta = beta + s.step
    return _described(design, models, center, stats, robust, strata) if models else {}


def _described(design: Design, models: dict[int, _Model], center: np.ndarray, stats: dict[int, _Stats], robust: bool,
               strata: Sequence[str]) -> dict[int, CoxFit]:
    """The fits at the models' last accepted points."""
    betas = {m: s.at for m, s in models.items()}
    study = _study_table(_time_sums(design, betas, center), len(center))
    out = {}
    for m, s in models.items():
        variance = np.linalg.inv(s.information)
        times = study.where(F.col("model") == m).drop("model") if design.models is not None else study.drop("model")
        cover = variance @ _robust_meat(design, times, s.at, center) @ variance if robust else variance
        baseline = times.select("stratum", "t", F.exp(-F.col("breslow")).alias("survival"))
        out[m] = CoxFit(design.names, s.at, variance, cover, baseline, s.best, s.steps, stats[m].n, stats[m].events, center,
                        list(strata), design, times, s.converged, s.gradient)
    return out


def _moments(design: Design) -> tuple[np.ndarray, dict[int, _Stats]]:
    """Centres (numeric means of all rows, 0 for indicators), and per model its rows, events and the columns' spreads."""
    folds = {r["fold"]: r for r in design.rows.groupBy("fold").agg(  # one row per fold
        F.count(F.lit(1)).alias("n"), F.sum("event").alias("e"), *[F.avg(c).alias(f"m_{c}") for c in design.numeric],
        *[F.var_pop(c).alias(f"v_{c}") for c in design.numeric]).collect()}
    pairs = [F.struct(F.lit(f).alias("f"), F.col(f"_{f}").alias("code")) for f in design.families]
    counts = {(r["fold"], r["f"], r["code"]): r["count"] for r in design.rows.select("fold", F.inline(F.array(*pairs)))
              .groupBy("fold", "f", "code").count().collect()} if pairs else {}  # one row per fold and level

    def pooled(own: list) -> tuple[int, int, list[float], list[float]]:
        n = sum(folds[k]["n"] for k in own)
        mean = [sum(folds[k]["n"] * folds[k][f"m_{c}"] for k in own) / max(n, 1) for c in design.numeric]
        scale = [math.sqrt(sum(folds[k]["n"] * (folds[k][f"v_{c}"] + (folds[k][f"m_{c}"] - m) ** 2) for k in own)
                           / max(n - 1, 1)) or 1.0 for c, m in zip(design.numeric, mean)]
        for f, levels in design.families.items():
            for i in range(len(levels)):
                p = sum(counts.get((k, f, i + 1), 0) for k in own) / max(n, 1)
                scale.append(math.sqrt(p * (1 - p) * n / max(n - 1, 1)) or 1.0)
        return n, sum(folds[k]["e"] or 0 for k in own), mean, scale

    center = np.zeros(len(design.names))
    center[:len(design.numeric)] = pooled(list(folds))[2]
    stats = {}
    for m in design.keys:
        n, events, _, scale = pooled([k for k in folds if design.models is None or k != m])
        stats[m] = _Stats(n, int(events), np.array(scale, float))
    return center, stats


def _robust_meat(design: Design, study: DataFrame, beta: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Sum over sections of their score sums' outer products."""
    d = len(beta)
    numeric, families = design.numeric, design.families

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _Batch(batch, numeric, families, center)
            hazard = batch.column("breslow").to_numpy(zero_copy_only=False)
            moved, xbar = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) for c in ("shift", "mean"))
            x, weight = b.dense(), np.exp(b.linear(beta))
            score = b.died[:, None] * (x - xbar) - weight[:, None] * (x * hazard[:, None] - moved)
            index, section = pd.factorize(b.section.to_numpy(zero_copy_only=False))
            order = np.argsort(index, kind="stable")
            edges = np.searchsorted(index[order], np.arange(len(section)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(section, pa.string()), _lists(np.add.reduceat(score[order], edges, axis=0))], ["section_id", "score"])

    rows = design.rows.join(checked_broadcast(study.select("stratum", "t", "breslow", "shift", "mean"), 16 * d + 64),
                            ["stratum", "t"])
    pieces = rows.mapInArrow(scores, "section_id string, score array<double>")
    per_section = pieces.groupBy("section_id").agg(*[F.sum(F.col("score")[i]).alias(f"u{i}") for i in range(d)])

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            u = np.column_stack([batch.column(f"u{i}").to_numpy(zero_copy_only=False) for i in range(d)])
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(d, np.int32)), pa.array(np.arange(d, dtype=np.int32)),
                                          _lists(total)], ["model", "i", "v"])

    return _squares(per_section.mapInArrow(outer, "model int, i int, v array<double>"))[0]


# ------------------------------------------------------------------ test and refit


def ph_table(fitted: CoxFit, spark, *, alpha: float = 0.05) -> DataFrame:
    """Score test of each covariate's residuals against the rank of the event time.

    Everything it needs is in the per-time sums of the full fit: event covariates minus the
    risk-set mean, weighted by the average rank of the events at that time. The mean of average
    ranks over N events is (N + 1) / 2.
    """
    total = float(fitted.events)
    # one row per distinct time: the study's length over the resolution at most
    ranks = fitted.times.groupBy("t").agg(F.sum("deaths").alias("_d")).select("t", (
        F.sum("_d").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_d")
        + (F.col("_d") + 1) / 2 - (total + 1) / 2).alias("_rank"))
    rows = fitted.times.join(checked_broadcast(ranks), "t")
    weighted = F.zip_with("e1", "mean", lambda e, m: F.col("_rank") * (e - F.col("deaths") * m))
    spread = F.array(F.col("deaths") * F.col("_rank") * F.col("_rank"))
    sums = _summed(rows.select(F.concat(spread, weighted).alias("v")), "v")
    top = (sums[1:] @ fitted.variance * total) ** 2
    bottom = total * np.diag(fitted.variance) * sums[0]
    out = spark.createDataFrame([(n, float(s), int(fitted.n)) for n, s in zip(fitted.names, top / bottom)],
                                "covariate string, statistic double, rows_tested long")
    return out.withColumn("p", chi2_1_p("statistic")).withColumn("violates", F.col("p") < alpha)


def fit_with_check(cohort: DataFrame, *, alpha: float = 0.05, max_rows: int | None = None):
    """Fit, test, and refit with the violating categorical families as strata.

    Returns (first fit, test table, stratified refit or None).
    """
    first = fit(cohort, max_rows=max_rows)
    table = ph_table(first, cohort.sparkSession, alpha=alpha)
    bad = {r["covariate"].split("=")[0] for r in table.where("violates").collect()}  # one row per covariate
    families = sorted(bad & set(REFERENCES))
    return first, table, fit(cohort, strata=families, max_rows=max_rows) if families else None


def headline_effects(summary: DataFrame) -> DataFrame:
    """Largest department effect and the hazard ratio per log position."""
    dept = summary.where(F.col("covariate").startswith("dept_group=")).orderBy(F.desc(F.abs("coef")), "covariate").limit(1)
    place = summary.where(F.col("covariate") == "log_position")
    cols = ["covariate", "hazard_ratio", "p"]
    return dept.select(F.lit("largest_department_effect").alias("what"), *cols).unionByName(
        place.select(F.lit("position_per_log_unit").alias("what"), *cols))


def predict(test: DataFrame, fitted: CoxFit | dict[int, CoxFit], horizon: str, fallback: str, name: str = "p_cox",
            by_subject: bool = False) -> DataFrame:
    """Clearing chance ``1 - S0(h)^exp(x beta)``; rows with a missing covariate, or of a fold without a model, take
    ``fallback`` and are flagged. ``fitted`` may hold a model for each value of the column ``fold``. With ``by_subject``
    a row's department is its subject, where the models know it, and OTHER elsewhere."""
    fits = fitted if isinstance(fitted, dict) else {0: fitted}
    fold = F.col("fold") if isinstance(fitted, dict) else F.lit(0)
    if not fits:
        return test.withColumns({name: F.col(fallback), "cox_fallback": F.lit(True)})
    of_fold = lambda values: F.element_at(F.create_map(*[c for f, v in values.items() for c in (F.lit(f), v)]), fold)
    names, means = next((f.names, f.means) for f in fits.values())  # the same in all
    rows = test.withColumn("_dept", F.col("dept_group"))
    if by_subject:
        rows = rows.withColumn("dept_group", F.col("subject"))
    families: dict[str, list[int]] = {}
    linear = F.lit(0.0)
    for k, column in enumerate(names):
        if "=" in column:
            families.setdefault(column.split("=", 1)[0], []).append(k)
        else:
            effect = of_fold({f: F.lit(float(fit.beta[k])) for f, fit in fits.items()})
            linear = linear + (_numeric(column) - F.lit(float(means[k]))) * effect
    rows = _coded(rows, {f: [names[k].split("=", 1)[1] for k in own] for f, own in families.items()})
    for family, own in families.items():
        effects = of_fold({f: F.array(F.lit(0.0), *[F.lit(float(fit.beta[k])) for k in own]) for f, fit in fits.items()})
        linear = linear + F.element_at(effects, F.col(f"_{family}") + 1)
    rows = rows.withColumns({"_linear": linear, "_known": _usable() & fold.isin(*fits), "_h": F.greatest(F.col(horizon), F.lit(0.0)),
                             "_stratum": F.lit(""), "_model": fold}).drop(*[f"_{f}" for f in families])
    steps = None
    for f, fit in fits.items():
        own = fit.baseline.select(F.lit(f).alias("_model"), F.col("stratum").alias("_stratum"), "t", "survival")
        steps = own if steps is None else steps.unionByName(own)
    rows = step_lookup(rows, steps, ["_model", "_stratum"], "_h", "t", "survival", "_s0")
    return rows.withColumns({
        name: F.when(F.col("_known"), F.lit(1.0) - F.pow(F.col("_s0"), F.exp("_linear"))).otherwise(F.col(fallback)),
        "cox_fallback": ~F.col("_known"), "dept_group": F.col("_dept")}).drop(
            "_linear", "_known", "_h", "_s0", "_stratum", "_model", "_dept")
