"""Model fitting, special functions, signals and sources, where there is no SQL: gradients, hand-worked and metamorphic cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialgrid.functions import special as sp
from trialgrid.operators import arrays as ar
from trialgrid.operators import auc, decoders, stats
from trialgrid.operators import relational as rel


def test_special_functions():
    assert sp.t_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert sp.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-8) and sp.chi2_tail(18.30703805, 10) == pytest.approx(0.05, abs=1e-8)
    assert sp.binom_tail(8, 10) == pytest.approx(56 / 1024) and sp.binom_tail(0, 3) == 1
    assert sp.beta_inc(3, 5, sp.beta_quantile(0.95, 3, 5)) == pytest.approx(0.95)
    assert math.isnan(sp.t_p.func(pd.Series([None], dtype=float), pd.Series([3.0]))[0])


def test_logistic_gradient_is_zero():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((80, 5)), (rng.random(80) < 0.3).astype(int)
    for c in (1e-3, 1.0, 100.0):
        w = decoders.fit_logistic(x, y, c)
        s = np.where(y == 1, 1.0, -1.0)
        weight = c * np.where(y == 1, 80 / (2 * y.sum()), 80 / (2 * (80 - y.sum())))
        assert np.abs(w - x.T @ (weight * s / (1 + np.exp(s * (x @ w))))).max() < 1e-6


def test_pca_takes_the_fewest_components():
    x = np.outer(np.arange(20.0), [1, 2, 3]) + np.random.default_rng(1).standard_normal((20, 3)) * 1e-3
    assert decoders.fit_pipeline(x, np.arange(20) % 2, 1.0, 0.95)["pca"].shape[0] == 1


def test_decoding_finds_a_planted_signal(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i, [float(v) for v in rng.standard_normal(12) + (i % 2) * np.r_[np.zeros(6), np.ones(6) * 2]], i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "channel int, epoch long, samples array<double>, cls int")
    inputs = decoders.folds(decoders.decoding_inputs(df, "cls", 6, 6, 0, 12, ["channel", "epoch"]), ["channel", "smin"], "epoch", 4)
    out = decoders.cross_validated(inputs, ["channel", "smin"], "epoch").cache()
    assert out.count() == 240 and out.select("smin", "epoch").distinct().count() == 240
    score = {r.smin: r.auc for r in auc.grouped_auc(out, "y", "proba", ["smin"]).collect()}
    assert score[6] > 0.9 and score[0] < 0.7
    # stored models give the fold's own predictions again
    models = decoders.fitted_models(inputs, ["channel", "smin"], 1.0)
    again = decoders.transferred(inputs, models, ["channel"], "epoch", F.col("smin") == 6, F.col("smin") == 6)
    direct = decoders.cross_validated(inputs.where("smin = 6"), ["channel", "smin"], "epoch", (1.0,))
    both = again.join(direct.select("epoch", F.col("proba").alias("q")), "epoch")
    assert both.count() == 120 and both.agg(F.max(F.abs(F.col("proba") - F.col("q")))).first()[0] < 1e-9
    shuffled = decoders.permuted(inputs, ["channel", "smin"], "epoch", 2)
    assert shuffled.groupBy("smin", "permutation").agg(F.sum("y")).select("sum(y)").distinct().collect()[0][0] == 60


def test_one_class_and_ties(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.7), ("b", 0, 0.5), ("b", 1, 0.5), ("c", 0, 0.1), ("c", 1, 0.9)], "g string, y int, p double")
    got = {r.g: r.auc for r in auc.grouped_auc(df, "y", "p", ["g"]).collect()}
    assert got == {"a": None, "b": 0.5, "c": 1.0}
    flipped = {r.g: r.auc for r in auc.grouped_auc(df.withColumn("p", 1 - F.col("p")), "y", "p", ["g"]).collect()}
    assert flipped == {"a": None, "b": 0.5, "c": 0.0}


def test_false_discovery_by_hand(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.02, 0.03, 0.5])], "k int, p double")
    got = [r.q for r in stats.false_discovery(df, "p", ["k"]).orderBy("k").collect()]
    assert got == pytest.approx([0.04, 0.04, 0.04, 0.5])


def test_yates_correction(spark):
    df = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 25 + [("b", "y")] * 15, "p string, q string")
    got = stats.chi_squared(stats.contingency(df, "p", "q"), "p", "q").first()
    assert got.df == 1 and got.chi2 == pytest.approx(4.725, abs=1e-3)


def test_ridge_recovers_lags(spark):
    rng = np.random.default_rng(3)
    signal, events = [], []
    for t in range(60):
        v, at, x = rng.standard_normal(20) * 0.01, int(rng.integers(2, 10)), float(rng.choice([-1, 1]))
        v[at] += 1.0
        v[at + 2] += 2.0 * x
        signal += [(t, 0, k, float(a)) for k, a in enumerate(v)]
        events.append((t, at, 1.0, x))
    out = decoders.lagged_ridge(spark.createDataFrame(events, "trial int, at int, onset double, cue double"), spark.createDataFrame(signal, "trial int, channel int, pos int, v double"), "trial", ["onset", "cue"], [0, 1, 2], 1e-6)
    got = {(r.feature, r.lag): (r.coef, r.unique) for r in out.collect()}
    assert got["onset", 0][0] == pytest.approx(1, abs=0.02) and got["cue", 2][0] == pytest.approx(2, abs=0.02) and abs(got["cue", 1][0]) < 0.02
    assert got["cue", 0][1] > got["onset", 0][1] > 0


def test_warping_and_resampling(spark):
    pairs = spark.createDataFrame([(1, [0.0, 1.0, 2.0], [0.0, 0.0, 1.0, 2.0]), (2, [0.0, 0.0], [1.0, 1.0])], "k int, a array<double>, b array<double>")
    assert [r.distance for r in ar.warped_distances(pairs).orderBy("k").collect()] == pytest.approx([0.0, math.sqrt(2)])
    wave = [math.sin(2 * math.pi * 2 * i / 64) for i in range(64)]
    got = ar.resampled(spark.createDataFrame([(wave,)], "samples array<double>"), 32).first().samples
    assert got == pytest.approx(wave[::2], abs=1e-9)


def test_quantile_and_equal_bins_on_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 0, 1, 2, 3, 4)], "v double")
    assert [r.bin for r in rel.equal_bins(df, "v", 4).orderBy("v").collect()] == [0, 0, 0, 1, 2, 3]
    assert rel.quantile_bins(df.where("v = 0"), "v", 4).select("bin").distinct().count() == 1


def test_sources(spark, tmp_path):
    from trialgrid.sources.tables import read_keyed, read_tables, write_tables

    for s in ("s1", "s2"):
        (tmp_path / s).mkdir()
        (tmp_path / s / "scores.csv").write_text("smin,auc\n1,0.5\n2,0.75\n")
    got = read_keyed(spark, f"{tmp_path}/*/scores.csv", {"subject": r"/(s\d)/scores"}, "smin int, auc double")
    assert sorted(map(tuple, got.collect())) == [(1, 0.5, "s1"), (1, 0.5, "s2"), (2, 0.75, "s1"), (2, 0.75, "s2")]
    assert read_keyed(spark, f"{tmp_path}/*/none.csv", {"subject": "x"}, "smin int").columns == ["smin", "subject"]
    with pytest.raises(ValueError):
        read_keyed(spark, f"{tmp_path}/a.xyz", {})
    for kind in ("parquet", "csv", "json"):
        write_tables({"t": got}, f"{tmp_path}/{kind}", kind)
        back = read_tables(spark, f"{tmp_path}/{kind}", {"t": "smin int, auc double, subject string"}, kind)["t"]
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, got.collect()))


def test_key_report_is_of_all_rows(spark):
    from trialgrid.plans.registry import QUERIES
    from trialgrid.sources.tables import predictions

    data = "/root/testdata/sf0.001"
    counts = {(r.word, r.fold): r["count"] for r in predictions(spark, data).groupBy("word", "fold").count().collect()}
    assert {(r.word, r.fold): r.n_rows for r in QUERIES["repeated_keys_of_all"](spark, data).collect()} == {k: n for k, n in counts.items() if n > 1}


def test_permutations_at_peak_windows(spark):
    from trialgrid.plans.registry import QUERIES

    data = "/root/testdata/sf0.001"
    true, got = QUERIES["decoding_searchlight"](spark, data).toPandas(), QUERIES["permuted_decoding"](spark, data).toPandas()
    fold = true.groupby(["channel", "smin", "fold"]).apply(lambda g: decoders._auc(g["y"].to_numpy(), g["proba"].to_numpy()), include_groups=False)
    peak = fold.groupby(level=[0, 1]).mean().groupby(level=0).idxmax().tolist()
    assert sorted(set(zip(got["channel"], got["smin"]))) == sorted(peak)
    assert (got.groupby("channel")["permutation"].nunique() == 20).all()
    chosen = true.groupby(["channel", "smin", "fold"])["c"].first()
    assert all(chosen[k] == c for *k, c in got[["channel", "smin", "fold", "c"]].drop_duplicates().itertuples(index=False, name=None) for k in [tuple(k)])
