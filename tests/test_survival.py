import hashlib
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.operators import boot, cox, km, ranks
from turnwise.operators import tables as tb
from turnwise.plans import backtest as bt
from turnwise.sources.calendar import calendar_for

CAL = calendar_for("2268")


def make_cohort(spark, n=600, seed=0):
    """Joiners with a known effect of position; sections nested in courses."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        section = int(rng.integers(0, 40))
        place = int(rng.choice([1, 3, 8, 12, 20, 50]))
        time = rng.exponential(5 * place**0.5)
        follow = rng.exponential(25) + 1
        event = int(time <= follow)
        bucket = "1-5" if place <= 5 else "6-15" if place <= 15 else "16-40" if place <= 40 else "41+"
        subject = f"S{section % 4}"
        number = str(section % 10 * 30)
        level = "lower" if section % 10 * 30 < 100 else "upper" if section % 10 * 30 < 200 else "grad"
        join = dt.datetime(2026, 4, 15) + dt.timedelta(hours=float(rng.integers(0, 4000)))
        phase = ["phase1", "phase2"][int(rng.integers(0, 2))]
        rows.append((i, str(section), join, place, bucket, math.log(place), float(rng.random()), round(min(time, follow), 3) + 0.001,
                     event, float(follow), f"{subject} {number}", subject, number, level, subject, phase,
                     (dt.datetime(2026, 8, 26) - join).total_seconds() / 86400, bool(rng.integers(0, 2)), "central"))
    return spark.createDataFrame(rows, "row_id long, section_id string, join_time timestamp, position int, position_bucket string, "
                                 "log_position double, wl_ratio double, duration_days double, event int, follow_up_days double, "
                                 "course_key string, subject string, catalog_number string, level string, dept_group string, "
                                 "phase string, days_to_instruction double, reserved boolean, scenario string")


def plain_km(t, e):
    out, s = [], 1.0
    for x in np.unique(t):
        s *= 1 - e[t == x].sum() / (t >= x).sum()
        out.append((x, s))
    return out


def test_curves_match_a_plain_estimate(spark, tiny_chunks):
    c = make_cohort(spark, 200)
    rows = c.select("position_bucket", "duration_days", "event").toPandas()
    got = km.kaplan_meier(c, ["position_bucket"]).toPandas()
    for bucket, g in rows.groupby("position_bucket"):
        want = plain_km(g["duration_days"].to_numpy(), g["event"].to_numpy())
        mine = got[got["position_bucket"] == bucket].sort_values("t")
        assert np.allclose(mine[["t", "survival"]], want)
        assert mine["survival"].is_monotonic_decreasing and mine["survival"].between(0, 1).all()


def test_step_reading_left_and_right(spark, tiny_chunks):
    steps = spark.createDataFrame([("a", float(t), 1 - t / 20) for t in range(1, 19)], "k string, t double, survival double")
    asked = spark.createDataFrame([("a", x / 2) for x in range(0, 40)] + [("b", 3.0)], "k string, at double")
    for left in (False, True):
        for row in km.read_survival(asked, steps, ["k"], "at", "s", left=left).collect():
            if row["k"] == "b":
                assert row["s"] == 1.0
                continue
            at = math.ceil(row["at"]) - 1 if left else math.floor(row["at"])
            assert row["s"] == pytest.approx(1.0 if at < 1 else 1 - min(at, 18) / 20)


def test_logrank_by_hand(spark):
    rows = [("a", 1.0, 1), ("a", 3.0, 1), ("a", 4.0, 0), ("b", 2.0, 1), ("b", 5.0, 1), ("b", 6.0, 0)]
    out = km.logrank(spark.createDataFrame(rows, "g string, duration_days double, event int"), "g").first()
    o_e = v = 0.0
    t, e, g = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    for x in np.unique(t[e == 1]):
        n, n1, d = (t >= x).sum(), ((t >= x) & (g == "a")).sum(), ((t == x) & (e == 1)).sum()
        o_e += ((t == x) & (e == 1) & (g == "a")).sum() - d * n1 / n
        v += d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) if n > 1 else 0
    assert out["statistic"] == pytest.approx(o_e**2 / v)
    assert out["p"] == pytest.approx(math.erfc(math.sqrt(o_e**2 / v / 2)))
    assert (out["n_a"], out["n_b"], out["comparisons"]) == (3, 3, 1)


def test_weighted_auc_and_brier(spark):
    def table(w):
        rows = list(zip((0, 1, 1, 0, 1, 0), (.2, .9, .8, .1, .3, .3), w))
        return spark.createDataFrame([(i, "m", float(y), float(p), float(x), False) for i, (y, p, x) in enumerate(rows)],
                                     "row_id long, predictor string, y double, p double, w double, fallback boolean")
    assert bt.weighted_auc(table([1] * 6)).first()["auc"] == pytest.approx(8.5 / 9)
    assert bt.weighted_auc(table([1, 1, 1, 1, 0, 2])).first()["auc"] == pytest.approx(1.0)
    assert bt.brier_table(table([1] * 6)).first()["brier"] == pytest.approx(np.mean(np.square([.2, .1, .2, .1, .7, .3])))


def test_calibration_bins_are_even(spark, tiny_chunks):
    rows = [(i, "m", float(i % 2), 0.5 if i < 40 else i / 100, 1.0, False) for i in range(60)]
    out = bt.calibration(spark.createDataFrame(rows, "row_id long, predictor string, y double, p double, w double, fallback boolean"))
    got = out.orderBy("decile").toPandas()
    assert list(got["n"]) == [6] * 10 and list(got["decile"]) == list(range(10))


def test_censoring_weights_recover_the_rate(spark):
    rng = np.random.default_rng(2)
    t, c = rng.exponential(5, 4000), rng.exponential(6, 4000)
    rows = [(i, float(min(a, b)), int(a <= b), 7.0) for i, (a, b) in enumerate(zip(t, c))]
    out = bt.with_weights(spark.createDataFrame(rows, "row_id long, duration_days double, event int, horizon_days double")).toPandas()
    rate = (out["w"] * out["y"]).sum() / out["w"].sum()
    known = out[out["w"] > 0]
    assert abs(rate - (1 - math.exp(-7 / 5))) < 0.03
    assert known["y"].mean() - (1 - math.exp(-7 / 5)) > 0.05


def test_horizons(spark):
    from turnwise.functions.scalars import horizon_days
    cal = calendar_for("2272")
    rows = spark.createDataFrame([(dt.datetime(2027, 2, 5, 12),), (dt.datetime(2027, 2, 7),), (dt.datetime(2027, 1, 18),)], "j timestamp")
    read = lambda w: [r[0] for r in rows.select(horizon_days(F.col("j"), cal, w)).collect()]
    assert read("deadline") == [0.5, -1.0, 19.0]
    assert read("instruction") == [-17.5, -19.0, 1.0]
    assert read("days:14") == [14.0] * 3


def test_picks_are_draws_of_n():
    word = lambda seed, j, b: int(hashlib.md5(f"{seed}:{j}:{b // 4}".encode()).hexdigest()[b % 4 * 8:b % 4 * 8 + 8], 16)
    found = boot.words(3, 5, 9, 10)
    assert [[word(3, j, b) for b in range(10)] for j in range(5, 9)] == found.tolist()
    many = boot.picks(50, 0, 2000)
    assert (many.sum(axis=0) == 50).all()
    assert abs(many.var() - (1 - 1 / 50)) < 0.05


def test_drawn_counts_are_the_picks(spark):
    rows = [(g, f"s{i}", 1.0, 1, 0) for g, n in (("a", 40), ("b", 7), ("c", 1), ("d", 40)) for i in range(n)]
    counts = spark.createDataFrame(rows, "g string, section_id string, t double, n int, d int")
    for block in (boot.BLOCK, 8):
        got = boot.drawn(counts, ["g"], n_boot=30, seed=4, block=block).collect()
        assert len(got) == 87
        for g, n in (("a", 40), ("b", 7), ("d", 40)):
            own = sorted((r["number"], r["picks"]) for r in got if r["g"] == g)
            assert [k for k, _ in own] == list(range(n)) and [p for _, p in own] == boot.picks(n, 4, 30).tolist()


def _bands(spark, c):
    counts = boot.section_counts(c, ["position_bucket"])
    grid = c.select("position_bucket").distinct().select("position_bucket", F.explode(F.array(F.lit(5.0), F.lit(15.0))).alias("day"))
    return boot.curve_bands(counts, ["position_bucket"], grid, n_boot=40).orderBy("position_bucket", "day").toPandas()


def test_picks_are_not_sent_through_the_driver(spark, monkeypatch):
    """Neither making the picks nor using them broadcasts a table with a row per section."""
    seen = []

    def noted(df, write=boot.materialize):
        seen.append(df)
        return write(df)

    monkeypatch.setattr(boot, "materialize", noted)
    rows = spark.range(300).select(F.lit("a").alias("g"), F.col("id").cast("string").alias("section_id"),
                                   (F.col("id") % 7 + 1.0).alias("duration_days"), (F.col("id") % 2).cast("int").alias("event"))
    counts = boot.section_counts(rows, ["g"])
    grid = spark.createDataFrame([("a", 3.0), ("a", 7.0)], "g string, day double")
    seen.append(boot.curve_bands(counts, ["g"], grid, n_boot=8))
    scored = rows.withColumns({"w": F.lit(1.0), "y": F.col("event").cast("double"), "p": F.lit(0.5), "q": F.lit(0.4)})
    seen.append(boot.bootstrap_gain(scored, ["g"], "p", "q", n_boot=8))
    for df in seen:
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
        assert not [line for line in joins if "number" in line or "section_id" in line], joins


def test_bands_do_not_depend_on_the_ranges(spark):
    c = make_cohort(spark, 300)
    plain = _bands(spark, c)
    spark.conf.set("spark.turnwise.chunkRows", "6")
    split = _bands(spark, c)
    spark.conf.unset("spark.turnwise.chunkRows")
    assert np.allclose(plain[["low", "high"]], split[["low", "high"]])
    assert (plain["low"] < plain["high"]).all()


def test_words_are_md5():
    """Words made for many picks at once are those of the digests, whatever the digits of pick and seed."""
    for seed, first, last in ((0, 0, 12), (7, 95, 105), (123456789, 8185, 10_003), (10**48, 9, 11)):
        found = boot._words_of(seed, first, last, range(3, 9))
        each = [[int(hashlib.md5(f"{seed}:{j}:{b // 4}".encode()).hexdigest()[b % 4 * 8:b % 4 * 8 + 8], 16) for b in range(3, 9)]
                for j in range(first, last)]
        assert found.T.tolist() == each


def plain_bands(rows, day, n_boot, seed=0):
    """Percentiles of a group's curve at a day, of rows (section, t, n, d)."""
    order = lambda s: (int(hashlib.md5(f"{seed}:{s}".encode()).hexdigest()[:15], 16), s)
    numbers = {s: i for i, s in enumerate(sorted({r[0] for r in rows}, key=order))}
    times, out = boot.picks(len(numbers), seed, n_boot), []
    for b in range(n_boot):
        own = [(t, n * times[numbers[s], b], d * times[numbers[s], b]) for s, t, n, d in rows]
        survival = 1.0
        for at in sorted({t for t, _, _ in own if t is not None and t <= day}):
            risk = sum(n for t, n, _ in own if t is None or t >= at)
            survival *= 1.0 - sum(d for t, _, d in own if t == at) / risk if risk else 1.0
        out.append(1.0 - survival)
    return np.percentile(out, [2.5, 97.5])


def test_bands_store_rows_but_no_picks(spark, monkeypatch):
    """Bands read the rows past picks that each task makes: no table holds a section's picks, however rows and draws are cut."""
    rng = np.random.default_rng(8)
    rows = [(g, f"s{rng.integers(0, size)}", float(rng.integers(1, 9)), 1, int(rng.integers(0, 2)))
            for g, size, n in (("a", 40, 150), ("b", 5, 30), ("c", 9, 20)) for _ in range(n)]
    rows += [("e", "s1", 1.0, 1, None), ("e", "s2", 1.0, 1, 1), ("e", "s2", 2.0, 1, 1)]  # one event is not known
    rows += [("a", "s1", None, 2, 0), ("d", "s1", 3.0, 1, 1), (None, "s1", 3.0, 1, 1), (None, "s2", 3.0, 1, 1)]
    counts = spark.createDataFrame(rows, "g string, section_id string, t double, n int, d int")
    grid = counts.select("g").distinct().select("g", F.explode(F.array(F.lit(0.5), F.lit(3.0), F.lit(6.5))).alias("day"))
    written = []

    def noted(df, write=boot.stored, **options):
        written.append(df)
        return write(df, **options)

    monkeypatch.setattr(boot, "stored", noted)
    monkeypatch.setattr(boot, "materialize", lambda df: spark.read.schema(df.schema).parquet(noted(df)))
    for held, numbers, pairs, shelf in ((32_000_000, 500_000, 400_000_000, 50_000_000), (100, 60, 900, 160)):
        for name, value in (("HELD_WORDS", held), ("HELD_NUMBERS", numbers), ("TASK_PAIRS", pairs), ("SHELF_ROWS", shelf), ("_GROUP_ROWS", 1)):
            monkeypatch.setattr(boot, name, value)
        found = {(r["g"], r["day"]): (r["low"], r["high"]) for r in boot.curve_bands(counts, ["g"], grid, n_boot=40).collect()}
        assert set(found) == {(g, day) for g in "abce" for day in (0.5, 3.0, 6.5)}
        assert [found.pop(("e", day)) for day in (0.5, 3.0, 6.5)] == [(0.0, 0.0), (None, None), (None, None)]
        for (g, day), band in found.items():
            assert band == pytest.approx(plain_bands([r[1:] for r in rows if r[0] == g], day, 40))
    assert not [c for df in written for c in df.columns if c in ("picks", "codes")]
    assert sum(df.count() for df in written) < 3_000


def test_bands_of_cells_keep_names_out_of_section_rows(spark, monkeypatch):
    """A cell's names are in no written row per section, and bands leave the other columns as they are without them."""
    written = []

    def noted(df, write=tb.materialize):
        written.append(df.columns)
        return write(df)

    monkeypatch.setattr(tb, "materialize", noted)
    cells = make_cohort(spark, 200).select(F.lit("all").alias("kind"), F.col("dept_group").alias("key"), F.col("position_bucket").alias("bucket"),
                                           "section_id", "duration_days", "event")
    cells = cells.unionByName(cells.limit(3).withColumn("bucket", F.lit(None).cast("string")))
    order = ["kind", "key", "bucket", "day"]
    found = tb.curve_points(cells, 5, n_boot=20).orderBy(*order).toPandas()
    assert [c for c in written if "section_id" in c] and not [c for c in written if "section_id" in c and "kind" in c]
    events = cells.groupBy("kind", "key", "bucket", F.col("duration_days").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("d"))
    sections = cells.groupBy("kind", "key", "bucket").agg(F.count_distinct("section_id").alias("sections"))
    plain = tb.curve_points(events, 5, n_boot=0, sections=sections).orderBy(*order).toPandas()
    assert len(found) and found.drop(columns=["low", "high"]).equals(plain.drop(columns=["low", "high"]))
    assert (found["low"] <= found["high"]).any()


def test_gain_interval_is_that_of_the_picks(spark, monkeypatch):
    """Sums per section are weighed by the picks of each draw; a value that is no number counts only where it was picked."""
    rng = np.random.default_rng(6)
    rows = [(g, f"s{i % size}", float(rng.integers(0, 2)), w, float(rng.random()), 0.4) for g, size in (("m", 25), ("k", 7))
            for i in range(60) for w in (1.0,)] + [("m", "odd", 1.0, float("inf"), 0.5, 0.4)]
    df = spark.createDataFrame(rows, "predictor string, section_id string, y double, w double, p_model double, p_base double")
    monkeypatch.setattr(boot, "TASK_PAIRS", 100)
    order = lambda s: (int(hashlib.md5(f"2:{s}".encode()).hexdigest()[:15], 16), s)
    for g in ("m", "k"):
        own = [r for r in rows if r[0] == g and math.isfinite(r[3])]
        names = sorted({r[1] for r in rows if r[0] == g}, key=order)
        times, draws = boot.picks(len(names), 2, 60), []
        for b in range(60):
            if g == "m" and times[names.index("odd"), b]:
                continue  # infinity less infinity is no number
            w = np.array([times[names.index(r[1]), b] * r[3] for r in own])
            draws.append(sum(k * ((r[2] - r[5]) ** 2 - (r[2] - r[4]) ** 2) for k, r in zip(w, own)) / w.sum())
        got = boot.bootstrap_gain(df.where(F.col("predictor") == g), ["predictor"], "p_base", "p_model", n_boot=60, seed=2).first()
        if g == "k":
            assert (got["gain_ci_low"], got["gain_ci_high"]) == pytest.approx(tuple(np.percentile(draws, [2.5, 97.5])))
        else:  # draws without the odd section are numbers still
            assert 0 < len(draws) < 60 and got["gain_ci_low"] == pytest.approx(sorted(draws)[int(0.025 * 59)], abs=0.05)


def test_scores_read_the_cohort_once(spark, tmp_path, monkeypatch):
    """backtest_scores joins lines and parts once, not for each of the backtest's passes."""
    from turnwise.plans import queries_survival as q

    spark.range(40).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 5).alias("l_partkey"), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"),
        F.lit(3.0).alias("l_quantity"), F.lit(10.0).alias("l_extendedprice"), F.lit(0.1).alias("l_discount"), F.lit("N").alias("l_returnflag"),
        F.lit("F").alias("l_linestatus")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(5).select(F.col("id").alias("p_partkey"), F.lit("B").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    seen = []
    monkeypatch.setattr(q.bt, "run_backtest", lambda cohort, *a, **b: seen.append(cohort) or bt.Backtest("temporal", "x", None, None, {"metrics": cohort}))
    assert q.backtest_scores(spark, str(tmp_path)).count() == 40
    assert "Join" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_shuffle_files_go_with_their_query(spark):
    from turnwise import session

    before = spark.conf.get(session.CLEANUP_CONF, None)
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for f in manager.getAllFiles().toList().mkString("\n").split("\n") if "/shuffle_" in f}
    start = held()
    out = session.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not held() - start and out.count() == 7 and spark.conf.get(session.CLEANUP_CONF, None) == before


def test_quantiles_by_rank(spark, tiny_chunks):
    rng = np.random.default_rng(3)
    rows = [("a", float(v), int(m)) for v, m in zip(rng.integers(0, 40, 200), rng.integers(1, 4, 200))]
    rows += [("b", float(v), 1) for v in rng.random(31)] + [("c", 5.0, 9), ("d", None, 3), ("d", float("nan"), 1), (None, 1.0, 1), (None, 2.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, m int")
    at = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["g"]: r["q"] for r in ranks.quantiles(df, ["g"], "v", at, "m", "q").collect()}
    assert set(got) == {"a", "b", "c", None}
    for g in got:
        values = np.repeat([v for k, v, _ in rows if k == g], [m for k, _, m in rows if k == g])
        assert got[g] == pytest.approx(np.quantile(values, at))
    every = [v for _, v, _ in rows if v is not None and v == v]
    assert ranks.quantiles(df, [], "v", at, name="q").first()["q"] == pytest.approx(np.quantile(every, at))
    assert ranks.quantiles(df.limit(0), [], "v", at).count() == 0


def test_gain_interval_matches_direct_resampling(spark):
    rng = np.random.default_rng(5)
    rows = [("m", str(int(rng.integers(0, 30))), float(rng.integers(0, 2)), 1.0, float(rng.random()), 0.5) for _ in range(400)]
    df = spark.createDataFrame(rows, "predictor string, section_id string, y double, w double, p_model double, p_base double")
    out = boot.bootstrap_gain(df, ["predictor"], "p_base", "p_model", n_boot=400).first()
    y, m, s = (np.array([r[i] for r in rows]) for i in (2, 4, 1))
    diff = {k: (((y - .5)**2 - (y - m)**2)[s == k].sum(), (s == k).sum()) for k in np.unique(s)}
    values = np.array(list(diff.values()))
    draws = [values[rng.integers(0, len(values), len(values))].sum(axis=0) for _ in range(4000)]
    low, high = np.percentile([a / b for a, b in draws], [2.5, 97.5])
    assert out["gain_ci_low"] == pytest.approx(low, abs=0.012) and out["gain_ci_high"] == pytest.approx(high, abs=0.012)


# ------------------------------------------------------------------------------ hazards


def test_rows_of_a_section_lie_together(spark):
    """Scores are added up where a section's rows are read; a section with most of the rows is still cut."""
    c = make_cohort(spark, 900)
    places = lambda rows: rows.withColumn("file", F.input_file_name()).groupBy("section_id").agg(F.count_distinct("file").alias("files")).toPandas()["files"]
    spread = places(cox.design_matrix(c).rows)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(spread) == 40 and spread.sum() < 40 + parts
    hot = c.withColumn("section_id", F.when(F.col("row_id") < 800, "hot").otherwise(F.col("section_id")))
    assert places(cox.design_matrix(hot).rows).max() > 1
    fitted = cox.fit(hot, max_steps=2)
    assert np.isfinite(fitted.robust).all()


def plain_cox(x, t, e, ridge, steps=25):
    """Newton's method on Efron's likelihood, written out."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        g, h, w = np.zeros_like(b), np.zeros((len(b), len(b))), np.exp(x @ b)
        for u in np.unique(t[e == 1]):
            risk, tied = t >= u, (t == u) & (e == 1)
            m = tied.sum()
            g += x[tied].sum(axis=0)
            for l in range(m):
                weight = w * risk - l / m * w * tied
                mean = weight @ x / weight.sum()
                g -= mean
                h += (x * weight[:, None]).T @ x / weight.sum() - np.outer(mean, mean)
        g, h = g - ridge * b, h + np.diag(ridge)
        b = b + np.linalg.solve(h, g)
    return b, h


def _plain_design(c):
    f = c.toPandas()
    t = np.ceil(f["duration_days"] / 0.01) * 0.01
    cols = {n: f[n].astype(float) for n in cox.NUMERIC}
    for fam, ref in cox.REFERENCES.items():
        for v in sorted(set(f[fam]) - {ref}):
            cols[f"{fam}={v}"] = (f[fam] == v).astype(float)
    return cols, np.round(t.to_numpy(), 6), f["event"].to_numpy(), f["section_id"].to_numpy()


def test_hazard_fit_matches_a_plain_newton(spark):
    c = make_cohort(spark, 300).withColumn("duration_days", F.ceil("duration_days"))  # many ties
    fitted = cox.fit(c)
    cols, t, e, section = _plain_design(c)
    assert set(fitted.names) == set(cols)
    x = np.column_stack([cols[n] for n in fitted.names])
    x = x - fitted.means
    ridge = len(x) * cox.PENALIZER * x.std(axis=0, ddof=1)**2
    beta, information = plain_cox(x, t, e, ridge)
    assert np.allclose(fitted.beta, beta, atol=1e-5)
    assert np.allclose(fitted.variance, np.linalg.inv(information), atol=1e-6)
    # clustered errors from the tie-free residuals
    w = np.exp(x @ beta)
    score = np.zeros_like(x)
    for i in range(len(x)):
        for u in np.unique(t[e == 1]):
            if u > t[i]:
                continue
            risk = t >= u
            mean = (w[risk] @ x[risk]) / w[risk].sum()
            score[i] -= w[i] * ((t == u) & (e == 1)).sum() / w[risk].sum() * (x[i] - mean)
            if u == t[i] and e[i]:
                score[i] += x[i] - mean
    sums = np.array([score[section == s].sum(axis=0) for s in np.unique(section)])
    assert np.allclose(fitted.robust, fitted.variance @ (sums.T @ sums) @ fitted.variance, atol=1e-6)


def test_strata_and_test_table(spark):
    c = make_cohort(spark, 400)
    fitted = cox.fit(c, strata=["level"])
    assert not any(n.startswith("level=") for n in fitted.names)
    assert fitted.baseline.select("stratum").distinct().count() == 3 and fitted.converged
    table = cox.ph_table(fitted, spark).toPandas()
    assert len(table) == len(fitted.names) and table["p"].between(0, 1).all()
    effect = {r["covariate"]: r for r in cox.fit(c).summary(spark).collect()}["log_position"]
    assert effect["coef"] < -0.2 and effect["p"] < 0.01


@pytest.mark.parametrize("m", [5000, 1_000_000])
@pytest.mark.parametrize("share", [1.0, 0.9999, 0.78, 0.3, 1e-6])
def test_many_ties_use_the_same_value(m, share):
    """All at risk dying, nearly all, some, and next to none."""
    d0 = 7000.0
    s0 = d0 / share
    u = np.arange(m, dtype=np.longdouble) / m
    for power, degree in ((1, 0), (1, 1), (2, 0), (2, 1), (2, 2)):
        exact = float((u**degree / (np.longdouble(s0) - u * np.longdouble(d0)) ** power).sum())
        assert cox._tie_sum(m, s0, d0, power, degree) == pytest.approx(exact, rel=1e-8)
    assert cox._tie_log(m, s0, d0) == pytest.approx(float(np.log(np.longdouble(s0) - u * np.longdouble(d0)).sum()), rel=1e-10)


def test_last_time_at_which_all_die(spark):
    c = make_cohort(spark, 200).withColumn("duration_days", F.lit(3.0)).withColumn("event", F.lit(1))
    old, cox._TERM_BY_TERM = cox._TERM_BY_TERM, 50
    try:
        fitted = cox.fit(c)
        assert np.isfinite(fitted.beta).all() and np.isfinite(fitted.log_likelihood)
    finally:
        cox._TERM_BY_TERM = old
    assert np.allclose(fitted.beta, cox.fit(c).beta, atol=1e-8)


def test_backtests_run_end_to_end(spark):
    c = make_cohort(spark, 700)
    run = bt.run_backtest(c, CAL, split="grouped", which="days:10", folds=3, n_boot=20)
    table = {r["predictor"]: r for r in run.tables["metrics"].collect()}
    assert set(table) == set(bt.PREDICTORS)
    assert table["bucket"]["gain"] == 0 and table["bucket"]["gain_ci_low"] == 0
    assert all(0 <= r["brier"] <= 1 and 0 <= r["auc"] <= 1 for r in table.values())
    scored = run.predictions.select("fold", "course_key").distinct().groupBy("course_key").count()
    assert scored.where("count > 1").isEmpty()  # a course is scored in one fold
    tiny = bt.run_backtest(c.limit(20), CAL, split="temporal", which="days:10", n_boot=0)
    assert tiny.tables == {} and "too few" in tiny.notes[-1]


def test_censor_at_undoes_later_events(spark):
    c = make_cohort(spark, 200)
    at = dt.datetime(2026, 6, 1, tzinfo=dt.timezone.utc)
    train, test = bt.temporal_split(c, at)
    assert train.count() + test.count() <= 200
    limit = (F.unix_micros(F.lit(at).cast("timestamp")) - F.unix_micros("join_time")) / 86_400_000_000
    assert train.where((F.col("duration_days") > limit + 1e-9) | (F.col("duration_days") <= 0)).isEmpty()


# ------------------------------------------------------------------------- lookup tables


def test_cells_without_bands_count_no_section_times(spark, monkeypatch):
    """The same cells as with bands, nulls included, but no table of sections and times is written for them."""
    n = F.col("id")
    rows = spark.range(700).select(
        F.when(n % 9 > 0, (n % 40).cast("string")).alias("section_id"), (n % 11 * 1.0).alias("duration_days"),
        F.when(n % 13 > 0, (n % 2).cast("int")).alias("event"), F.when(n % 17 > 0, F.concat(F.lit("1-"), (n % 3).cast("string"))).alias("position_bucket"),
        F.when(n % 5 > 0, (n % 5).cast("string")).alias("dept_group"), F.when(n % 8 > 1, "lower").alias("level"))
    plain = [*tb.CELL, "day", "p", "reach_days", "median_days", "n", "events", "sections"]
    read = lambda df: sorted(map(repr, df.select(*plain).collect()))
    want = read(tb.curve_points(tb.pool_cells(rows), n_boot=2))
    monkeypatch.setattr(tb, "section_counts", lambda *_: pytest.fail("counts by section and time"))
    got = read(tb.assemble(tb.pool_curves(rows, n_boot=0)).select("*", F.inline("curve")))
    assert got == want and len(want) > 40
    assert tb.pool_tables(rows, n_boot=0).count() == len({r.split(", day=")[0] for r in want})


def mixed_cohort(spark, n=700):
    """Sections, courses, buckets and attributes with nulls; a section has several of each. Also a count of rows read."""
    seen = spark.sparkContext.accumulator(0)

    def read(_):
        seen.add(1)
        return True

    k = F.col("id")
    rows = spark.range(n).where(F.udf(read, "boolean").asNondeterministic()(k)).select(
        F.when(k % 9 > 0, (k % 40).cast("string")).alias("section_id"), (k % 11 * 1.0).alias("duration_days"),
        F.when(k % 13 > 0, (k % 2).cast("int")).alias("event"), F.when(k % 17 > 0, F.concat(F.lit("1-"), (k % 3).cast("string"))).alias("position_bucket"),
        F.when(k % 5 > 0, (k % 5).cast("string")).alias("dept_group"), F.when(k % 8 > 1, "lower").alias("level"),
        F.when(k % 7 > 0, F.concat(F.lit("c"), (k % 6).cast("string"))).alias("course_key"), F.lit("S").alias("subject"),
        (k % 4).cast("string").alias("catalog_number"))
    return rows, seen


def test_pools_without_bands_read_the_cohort_once(spark):
    rows, seen = mixed_cohort(spark)
    cells = tb.pool_tables(rows, n_boot=0).collect()
    assert seen.value == 700
    raw = rows.collect()
    for cell in cells:
        mine = [r for r in raw if r["position_bucket"] == cell["bucket"]
                and cell["key"] == {"all": "all", "dept": r["dept_group"], "level": r["level"]}[cell["kind"]]]
        assert (cell["n"], cell["events"]) == (len(mine), sum(r["event"] or 0 for r in mine))
        assert cell["sections"] == len({r["section_id"] for r in mine} - {None})
    assert len(cells) > 10


@pytest.mark.parametrize("min_n", [1, 30])
def test_courses_from_a_counted_cohort(spark, min_n):
    """Pools, course cells and index of a cohort counted once are those of its rows."""
    rows, seen = mixed_cohort(spark)
    counted = tb.counted(rows, tb.COURSE)
    pools = tb.materialize(tb.pool_tables(counted, min_n=min_n, n_boot=0))
    cells = tb.course_tables(counted, pools, min_n=min_n, n_boot=0)
    index = sorted(map(repr, tb.index_rows(cells.where("bucket IS NOT NULL"), pools).withColumn("buckets", F.array_sort(F.map_entries("buckets"))).collect()))
    got = sorted(map(repr, cells.collect()))
    assert seen.value == 700
    plain = tb.course_tables(rows, pools, min_n=min_n, n_boot=0)
    assert got == sorted(map(repr, plain.select(cells.columns).collect())) and len(got) > 5
    assert index == sorted(map(repr, tb.index_rows(plain.where("bucket IS NOT NULL"), pools).withColumn("buckets", F.array_sort(F.map_entries("buckets"))).collect()))
    raw = rows.collect()
    for r in cells.collect():
        mine = [x for x in raw if (x["course_key"], x["position_bucket"]) == (r["course_key"], r["bucket"])]
        assert (r["n_course"], r["sections_course"]) == (len(mine), len({x["section_id"] for x in mine} - {None}))


def test_cells_and_pointers(spark):
    c = make_cohort(spark, 700)
    pools = tb.pool_tables(c, n_boot=10)
    cells = tb.course_tables(c, pools, n_boot=0, min_n=30)
    for row in cells.collect():
        assert row["own"] == (row["n_course"] >= 30)
        assert row["own"] or row["pooled"] in {"all", row["dept_group"]}
    whole = pools.where("kind = 'all'").collect()
    assert sum(r["n"] for r in whole) == 700
    for r in whole:
        days = [p["day"] for p in r["curve"]]
        assert days == sorted(days) and all(p["low"] <= p["high"] for p in r["curve"])
    dept_only = tb.course_tables(c, pools, estimate_level="dept")
    assert dept_only.where("own").isEmpty()
    with pytest.raises(ValueError):
        tb.course_tables(c, pools, estimate_level="section")


def test_curve_reading(spark):
    from turnwise.functions.scalars import curve_at
    df = spark.sql("SELECT array(named_struct('day', 0.5D, 'p', 0.1D), named_struct('day', 1D, 'p', 0.3D), named_struct('day', 7D, 'p', 0.6D)) c")
    got = [df.select(F.coalesce(curve_at(F.col("c"), F.lit(h))["p"], F.lit(0.0))).first()[0] for h in (0.2, 0.5, 3.0, 100.0)]
    assert got == [0.0, 0.1, 0.3, 0.6]


def test_titles(spark):
    rows = [("A 1", "LEC", "Common", "Ann B"), ("A 1", "DIS", "Common", "Cy D, Ann B"), ("A 1", "LEC", "Rare", None),
            ("B 1", "DIS", "Alpha", ""), ("B 1", "LEC", "Zebra", ""), ("C 1", "DIS", "Beta", ""), ("C 1", "DIS", "Alpha", ""),
            ("D 1", "LEC", "", "Eve F"), ("X 9", "LEC", "Unseen", "")]
    entries = spark.createDataFrame(rows, "course_key string, component string, title string, instructors string")
    keys = spark.createDataFrame([(k,) for k in ("A 1", "B 1", "C 1", "D 1", "E 1")], "course_key string")
    got = {r["course_key"]: (r["title"], r["instructors"]) for r in tb.titles_table(keys, entries).collect()}
    assert got == {"A 1": ("Common", ["Ann B", "Cy D"]), "B 1": ("Zebra", []), "C 1": ("Alpha", []), "D 1": ("", ["Eve F"])}


def test_tables_counted_as_large_are_not_broadcast(spark, monkeypatch):
    from turnwise import session

    monkeypatch.setattr(session, "BROADCAST_ROWS", 5)
    left = spark.createDataFrame([(i, i % 3) for i in range(40)], "k long, v long")
    for rows, sent in ((5, True), (6, False)):
        right = spark.createDataFrame([(i, "b") for i in range(rows)], "k long, name string")
        joined = left.join(session.checked_broadcast(right), "k")
        assert joined.count() == rows
        assert ("BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()) == sent


def test_a_cohort_of_many_sections_is_joined_by_shuffle(spark, tmp_path, monkeypatch):
    from turnwise import session
    from turnwise.plans import bindings as b

    line = [(k, k % 7, 1 + k % 7, 5.0, 100.0 + k, 0.05, "N", "O") for k in range(30)]
    spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                "l_discount double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"Brand{k}") for k in range(7)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(session, "BROADCAST_ROWS", 5)
    cohort = b.cohort_from_lineitem(spark, str(tmp_path))
    assert cohort.count() == 30
    assert "Broadcast" not in cohort._jdf.queryExecution().executedPlan().toString()


def test_calibration_ranks_only_predictions_that_an_edge_cuts(spark, monkeypatch):
    # 100 rows over 20 predictions of 5 rows each, in 4 bins of 25 rows: edges at ranks 26, 51 and 76 meet predictions' ends
    rows = [(i, "a", float(i % 2), (i // 5) / 20, 1.0 + i % 3, False) for i in range(100)]
    rows += [(i, "b", float(i % 2), 0.1 if i < 40 else 0.9, 1.0, False) for i in range(100)]
    long = spark.createDataFrame(rows, "row_id long, predictor string, y double, p double, w double, fallback boolean")
    ranked = []
    real = bt.scan

    def seen(df, keys, order, *more):
        if order == [bt.ROW_ID]:
            ranked.append({(r["predictor"], r["p"]) for r in df.select("predictor", "p").distinct().collect()})
        return real(df, keys, order, *more)

    monkeypatch.setattr(bt, "scan", seen)
    out = {(r["predictor"], r["decile"]): r for r in bt.calibration(long, deciles=4).collect()}
    assert len(ranked[0]) <= 4  # three edges of 'a', one of 'b'
    for predictor, bins in (("a", 4), ("b", 2)):
        own = sorted(((r[3], r[0], r[4], r[2]) for r in rows if r[1] == predictor))
        want = {}
        for rank, (p, _, w, y) in enumerate(own):
            want.setdefault(max(math.ceil(rank * bins / (len(own) - 1)), 1) - 1, []).append((p, w, y))
        for d, part in want.items():
            r, weight = out.pop((predictor, d)), sum(w for _, w, _ in part)
            assert r["n"] == len(part) and r["weight"] == pytest.approx(weight)
            assert r["predicted"] == pytest.approx(sum(w * p for p, w, _ in part) / weight)
            assert r["observed"] == pytest.approx(sum(w * y for _, w, y in part) / weight)
    assert not out


def test_quadrature_nodes_are_made_once(monkeypatch):
    def again(n):
        raise AssertionError("made again")

    monkeypatch.setattr(np.polynomial.legendre, "leggauss", again)
    m, s0, d0 = 10_000, 30_000.0, 9_000.0
    assert cox._tie_sum(m, s0, d0, 1, 0) == pytest.approx(sum(1 / (s0 - i / m * d0) for i in range(m)), rel=1e-12)


def test_time_sums_of_mixed_strata(spark):
    cohort = make_cohort(spark, 300)
    design = cox.design_matrix(cohort, strata=["level"])
    zero = np.zeros(len(design.names))
    got = {(r["stratum"], round(r["t"], 6)): r["v"][:2] for r in cox._time_sums(design, {0: zero}, zero).collect()}
    want = {(r["stratum"], round(r["t"], 6)): [float(r["n"]), float(r["e"])] for r in design.rows.groupBy("stratum", "t").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event").alias("e")).collect()}
    assert len({s for s, _ in want}) > 1 and got == want
