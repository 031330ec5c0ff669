"""Quantiles, moments, fits that go on, codebooks, encoders and batches, against numpy and hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import batches, fit, quantiles, states
from ledgerloom.schema import feature_names


@pytest.mark.parametrize("seed, scale", [(1, 1), (2, 1e-9), (3, 1e200)])
def test_quantiles_by_histograms_are_exact(spark, seed, scale):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=700), rng.lognormal(0, 12, 500), -rng.lognormal(0, 6, 300), np.zeros(150), np.repeat(3.25, 400), rng.integers(0, 9, 200)]
    values = np.concatenate(parts) * scale
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
    marks = [0.0, 0.01, 0.25, 0.5, 0.731, 0.95, 1.0]
    n, got = quantiles.exact_quantiles(df, F.col("v"), marks, few=20)
    assert n == len(values) and np.allclose(got, np.quantile(values, marks), rtol=1e-12, atol=0)
    assert quantiles.exact_quantiles(df, F.col("v"), marks)[1] == pytest.approx(got, rel=1e-12)
    assert quantiles.exact_quantiles(df.filter("v > 1e300"), F.col("v"), [0.5]) == (0, [None])


def test_medians_and_scales_by_histograms(spark):
    rng = np.random.default_rng(5)
    d = np.where(rng.random(301) < 0.1, 0, rng.lognormal(0, 3, 301))
    df = spark.createDataFrame([(float(v), k) for k, v in enumerate(d)], "d double, place long")
    few, all_ = (fit.target_scale(df, "d", "place", n).first().asDict() for n in (10, 10**6))
    assert few == pytest.approx(all_) and few["pairs"] == 301 and few["scale"] == pytest.approx(np.median(d[d > 0]))
    first = d[:151]  # the first half has the odd one
    assert few["first_half"] == pytest.approx(np.median(first[first > 0]))
    assert fit.positive_median(df, "d", 10).first()["median"] == pytest.approx(np.median(d[d > 0]))


def observed(spark, n=200, sessions=3, seed=0):
    names = feature_names()
    rng = np.random.default_rng(seed)
    x = np.abs(rng.normal(size=(n, len(names)))) * 10
    for i, name in enumerate(names):
        if name.endswith("_present"):
            x[:, i] = rng.random(n) < 0.7
    x[:, 80] = 4.0  # constant
    return x, spark.createDataFrame([(int(k % sessions), [float(v) for v in row]) for k, row in enumerate(x)], "session long, x array<double>").repartition(4)


def moments_of(x, tau):
    out = {}
    for i, name in enumerate(feature_names()):
        v = x[:, i]
        if i < 80 and not name.endswith("_present"):
            v = v[x[:, i // 4 * 4 + 3] > 0]
        if name.endswith(("_quantity", "_orders")):
            v = np.log1p(v)
        if name == "time_delta_seconds":
            v = np.log1p(v / tau)
        kept = name.endswith("_present") or name == "initial" or name.startswith("tod_")
        constant = v.std() <= 1e-12
        out[name] = (len(v), 0 if kept else v.mean(), 1 if kept or constant else v.std(), bool(constant))
    return out


def test_moments_are_numpys(spark):
    x, df = observed(spark)
    got = {r["feature"]: (r["n"], r["mean"], r["scale"], r["constant"]) for r in fit.feature_moments(df, 0.5).collect()}
    want = moments_of(x, 0.5)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    none = {r["feature"]: tuple(r)[1:] for r in fit.feature_moments(df.limit(0), 0.5).collect()}
    assert none == {}
    with pytest.raises(Exception, match="negative"):
        fit.feature_moments(df.withColumn("x", F.transform("x", lambda v: -v)), 0.5)
    with pytest.raises(Exception, match="negative"):
        fit.standardise(df.withColumn("x", F.transform("x", lambda v: -v)), fit.feature_moments(df, 0.5), 0.5).collect()


def test_a_fit_goes_on_where_it_was_left(spark, tmp_path):
    x, df = observed(spark)
    folder, about = str(tmp_path / "fit"), {"days": ["a", "b"]}
    broken = df.withColumn("x", F.when(F.col("session") == 2, F.transform("x", lambda v: -v)).otherwise(F.col("x")))
    with pytest.raises(Exception, match="negative"):
        fit.resumable_moments(broken, 0.5, "session", folder, about, at_once=1)
    parts = spark.read.parquet(f"{folder}/parts")
    assert {r["session"] for r in parts.select("session").distinct().collect()} == {0, 1}  # what was done stays
    before = sorted(parts.inputFiles())
    got = {r["feature"]: (r["n"], r["mean"], r["scale"], r["constant"]) for r in fit.resumable_moments(df, 0.5, "session", folder, about).collect()}
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in moments_of(x, 0.5).items())
    assert set(before) < set(spark.read.parquet(f"{folder}/parts").inputFiles())
    for changed in ({"tau": 0.6}, {"sources": {"days": ["a"]}}):
        with pytest.raises(ValueError):
            fit.resumable_moments(df, changed.get("tau", 0.5), "session", folder, changed.get("sources", about))


def test_a_reservoir_by_days_is_that_of_all_days(spark, tmp_path):
    gaps = spark.range(3000).select("id", (F.col("id") % 7).alias("day"), ((F.col("id") * 37 % 1001) / 10.0 - 5).alias("gap"))
    whole = fit.reservoir_median(gaps, "gap", "id", 3, 200).first()
    first = fit.resumable_reservoir(gaps.filter("day < 4"), "gap", "id", "day", str(tmp_path / "r"), {}, 3, 200)
    assert first.first()["n"] == 200
    assert fit.resumable_reservoir(gaps, "gap", "id", "day", str(tmp_path / "r"), {}, 3, 200).first() == whole


def test_priorities_are_spread(spark):
    rows = spark.range(3_000_000).select(S.hash_priority(F.col("id"), 1).alias("p"))
    assert rows.distinct().count() == 3_000_000
    share = rows.filter(F.col("p") < (1 << 60) // 10).count() / 3_000_000
    assert abs(share - 0.1) < 0.002
    assert spark.range(1).select(S.hash_priority(F.lit(2**62), 1)).first()[0] >= 0


def test_a_small_sample_of_many_rows(spark):
    rows = spark.range(20_000)
    every = sorted((r["priority"], r["id"]) for r in rows.select("id", S.hash_priority(F.col("id"), 9).alias("priority")).collect())
    for k in (1, 7, 300):
        got = fit.bottom_k(rows.repartition(6), "id", 9, k).collect()
        assert [(r["priority"], r["id"]) for r in got] == every[:k]
    assert fit.bottom_k(rows.limit(5), "id", 9, 7).count() == 5


# --- codebooks ---


def clusters(spark, n=3000, seed=2):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [8, 0, 0], [0, 8, 0], [0, 0, 8]], float)
    own = rng.integers(0, 4, n)
    x = centres[own] + rng.normal(0, 0.35, (n, 3))
    return centres, spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, v array<double>")


def test_mini_batches_find_the_clusters_however_they_come(spark):
    centres, df = clusters(spark)
    books = [states.MiniBatchCodebook(4, 127, 381, 3, 17).fit(rows, "v", "id").freeze(spark) for rows in (df, df.repartition(7), df.orderBy(F.desc("id")))]
    found = [np.array([r["prototype"] for r in b.orderBy("code").collect()]) for b in books]
    assert all(np.allclose(found[0], f, atol=1e-9) for f in found[1:])
    assert max(np.abs(found[0] - c).sum(1).min() for c in centres) < 0.2


def test_a_codebook_has_a_life(spark, tmp_path):
    _, df = clusters(spark, 400)
    book = states.MiniBatchCodebook(4, 64, seed=3)
    with pytest.raises(states.CodebookError):
        book.freeze(spark)
    frozen = book.fit(df, "v", "id").freeze(spark)
    with pytest.raises(states.CodebookError):
        book.fit(df, "v", "id")
    with pytest.raises(states.CodebookError):
        states.MiniBatchCodebook(500, 64).fit(df, "v", "id")
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            states.MiniBatchCodebook(bad)
    path = str(tmp_path / "book")
    states.save_codebook(frozen, path, {"corpus": "c"})
    assert sorted(map(tuple, states.load_codebook(spark, path, corpus="c").collect()), key=str) == sorted(map(tuple, frozen.collect()), key=str)
    with pytest.raises(Exception):
        states.save_codebook(frozen, path, {"corpus": "c"})
    with pytest.raises(states.CodebookError):
        states.load_codebook(spark, path, corpus="d")
    with pytest.raises(states.CodebookError):
        states.save_codebook(frozen.withColumn("code", F.col("code") + 1), str(tmp_path / "other"), {})
    frozen.withColumn("prototype", F.transform("prototype", lambda v: v + 1)).write.mode("overwrite").parquet(f"{path}/prototypes")
    with pytest.raises(states.CodebookError):
        states.load_codebook(spark, path)


def test_future_summaries_are_kept(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [10.0, 20.0]), (0, [3.0, 4.0])], "code int, y array<double>")
    found, path = states.state_futures(rows), str(tmp_path / "futures")
    states.save_futures(found, path, 3, 2, {"codebook": "b"})
    again = states.load_futures(spark, path, 3, 2, codebook="b")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.select("code", "step", "n", "mean", "var").collect()))
    for wrong in ({"states": 4}, {"horizon": 3}, {"codebook": "c"}):
        with pytest.raises(ValueError):
            states.load_futures(spark, path, wrong.get("states", 3), wrong.get("horizon", 2), codebook=wrong.get("codebook", "b"))
    for bad in (found.filter("step = 0"), found.withColumn("code", F.lit(7)), found.withColumn("n", F.lit(0).cast("long"))):
        with pytest.raises(ValueError):
            states.save_futures(bad, str(tmp_path / "bad"), 3, 2, {})


def test_the_nearest_of_a_library_met_in_blocks(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 4, (120, 5)).astype(float)
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, v array<double>")
    got = {r["query"]: (r["nearest"], r["distance"]) for r in states.nearest_in_library(rows.filter("id < 30"), rows.filter("id >= 30"), "id", "v", block=7).collect()}
    for q in range(30):
        d = np.sqrt(((x[30:] - x[q]) ** 2).sum(1))
        assert got[q] == (30 + int(d.argmin()), pytest.approx(d.min()))


def test_projections_of_wide_vectors(spark):
    rng = np.random.default_rng(1)
    w, b, x = rng.normal(size=(3, 22_016)), rng.normal(size=3), rng.normal(size=(4, 22_016))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, v array<double>")
    got = np.array([r["z"] for r in states.project(df, "v", w, b).orderBy("id").collect()])
    assert np.allclose(got, x @ w.T + b)
    with pytest.raises(Exception, match="22016"):
        states.project(df.withColumn("v", F.slice("v", 1, 5)), "v", w, b).collect()
    with pytest.raises(ValueError):
        states.project(df, "v", w * np.nan, b)


def test_training_goes_on_from_a_saved_state(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 4))
    pair = np.array([(i, j) for i in range(40) for j in range(40, 80)])
    target = np.abs(x[pair[:, 0], 0] - x[pair[:, 1], 0])
    whole = states.train_projection(spark, x, pair, target, 2, steps=60)
    state = states.train_projection(spark, x, pair, target, 2, steps=20)[3]
    path = str(tmp_path / "state.json")
    states.save_training(spark, path, state, {"sample": "s"})
    rest = states.train_projection(spark, x, pair, target, 2, steps=40, state=states.load_training(spark, path, {"sample": "s"}))
    assert np.allclose(rest[0], whole[0]) and np.allclose(rest[2], whole[2][20:])
    with pytest.raises(ValueError):
        states.load_training(spark, path, {"sample": "t"})
    with pytest.raises(ValueError):
        states.train_projection(spark, x, pair, target, 3, state=state)


def test_codes_are_checked(spark):
    df = spark.createDataFrame([(0,), (3,)], "c int")
    assert [r[0] for r in df.select(S.codes_in_range(F.col("c"), 4)).collect()] == [0, 3]
    with pytest.raises(Exception, match="out of range"):
        df.select(S.codes_in_range(F.col("c"), 3)).collect()


# --- batches ---


def test_a_batch_of_one_session(spark, tmp_path):
    rng = np.random.default_rng(4)
    n, names = 240, feature_names()
    x = np.abs(rng.normal(size=(n, len(names)))) + 0.1
    for i, name in enumerate(names):
        if name.endswith("_present"):
            x[:, i] = 1
    mid = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    rows = [(0, int(3 * k), int(k >= 120), 10**9 * k, float(mid[k]), [float(v) for v in x[k]]) for k in range(n)]
    obs = spark.createDataFrame(rows, "session long, source_row long, segment long, ts long, mid double, x array<double>").repartition(3)
    batch = batches.build_batch(obs, 6, 3, 20, 7)
    r = batch.report
    assert (r["rows"], r["segments"], r["split_row"], r["anchors"]) == (240, 2, 160, 20)
    # rows 0-119 and 120-159 train, 160-239 are held out
    assert (r["train_anchors"], r["held_out_anchors"]) == ((120 - 8) + (40 - 8), 80 - 8) and r["query_anchor"] == 165
    kept = sorted(e["anchor"] for e in batch.episodes.collect())
    assert len(kept) == 20 and r["pairs"] == sum(b - a >= 9 for a in kept for b in kept)
    moments = moments_of(x[[*range(117), *range(120, 157)]], r["tau"])  # a history ends three rows before its run at the latest
    got = {m["feature"]: (m["n"], m["mean"], m["scale"], m["constant"]) for m in batch.moments.collect()}
    assert all(got[k] == pytest.approx(moments[k], abs=1e-9) for k in moments)
    y = {e["anchor"]: np.array(e["y"]) for e in batch.episodes.collect()}
    assert all(np.allclose(v, np.log(mid[a + 1 : a + 4] / mid[a])) for a, v in y.items())
    d = {(p["a"], p["b"]): (p["d_raw"], p["d"]) for p in batch.pairs.collect()}
    for (a, b), (raw, scaled) in d.items():
        assert raw == pytest.approx(np.sqrt(((y[a] - y[b]) ** 2).mean())) and scaled == pytest.approx(raw / r["scale"]["scale"])
    flat = {e["anchor"]: np.array(e["x"]).ravel() for e in batch.episodes.collect()}
    q = batch.query.first()
    near = min(flat, key=lambda a: (((flat[a] - np.array(q["x"]).ravel()) ** 2).sum(), a))
    assert r["nearest_anchor"] == near and r["forecast_rms"] == pytest.approx(np.sqrt(((y[near] - np.array(q["y"])) ** 2).mean()))
    batches.save_batch(batch, str(tmp_path / "batch"))
    with pytest.raises(Exception):
        batches.save_batch(batch, str(tmp_path / "batch"))
    for wrong in (dict(history=200), dict(anchors=1), dict(anchors=10_000)):
        with pytest.raises(ValueError):
            batches.build_batch(obs, **{"history": 6, "horizon": 3, "anchors": 20, "seed": 7} | wrong)
