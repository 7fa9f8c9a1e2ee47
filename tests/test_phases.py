"""Three-class and phased decoders, cluster geometry, intervals: zero gradients, rare classes, no leak between phases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialgrid.operators import arrays as ar
from trialgrid.operators import geometry as ge
from trialgrid.operators import phases as ph


def gradient(w, x, y, c):
    n, classes = len(y), len(w)
    counts = np.bincount(y, minlength=classes)
    weight = c * n / ((counts > 0).sum() * counts[y])
    return w + (weight[:, None] * (ph.softmax(x @ w.T) - np.eye(classes)[y])).T @ x


def test_softmax_is_at_its_minimum():
    rng = np.random.default_rng(1)
    for c in (0.01, 1.0, 100.0):
        x, y = rng.standard_normal((150, 6)), rng.integers(0, 3, 150)
        x[:, 0] += y
        w = ph.fit_softmax(x, y, 3, c)
        assert np.abs(gradient(w, x, y, c)).max() < 1e-6 and np.abs(w.sum(0)).max() < 1e-6
    two = ph.fit_softmax(x, (y > 0).astype(int), 2, 1.0)  # two classes: half of a logistic fit with twice the penalty on the difference
    assert np.abs(gradient(two, x, (y > 0).astype(int), 1.0)).max() < 1e-7 and two[0] == pytest.approx(-two[1])
    apart = np.r_[np.full((20, 1), -5.0), np.full((20, 1), 5.0)]
    w = ph.fit_softmax(apart, np.repeat([0, 1], 20), 3, 1000.0)  # separable, and a class without rows
    assert np.isfinite(w).all() and np.abs(gradient(w, apart, np.repeat([0, 1], 20), 1000.0)).max() < 1e-5


def sessions(spark, n=90, classes=(-1, 0, 1)):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(3):
        for i in range(n):
            y = classes[i % 3] if g == 0 else (classes[0] if g == 1 else (classes[2] if i == 5 else classes[i % 2]))
            x = rng.standard_normal(5)
            x[y + 1] += 2
            rows.append((g, i, y, i % 6 + 1, int(y > 0), x.tolist(), i // 3 % 3))
    return rows, spark.createDataFrame(rows, "g int, id long, y int, step int, z int, x array<double>, fold int")


def test_three_classes(spark):
    rows, df = sessions(spark)
    got = ph.class_decoder(df, ["g"], "id", [-1, 0, 1])
    out = got.collect()
    first = [r for r in out if r.g == 0]
    assert len(first) == 90 and np.mean([r.predicted == r.y for r in first]) > 0.7 and all(sum(r.probas) == pytest.approx(1) for r in out)
    assert not [r for r in out if r.g == 1]  # one class
    rare = [r for r in out if r.g == 2]
    assert len(rare) == 90 and all(np.isfinite(r.probas).all() for r in rare)  # one trial of the third class
    p = got.withColumn("p", ph.proba_of("probas", [-1, 0, 1], F.col("y"))).where("g = 0").collect()
    assert all(r.p == r.probas[r.y + 1] for r in p)
    # trials of folds below 0 are scored but never trained on: other labels for them change nothing
    held = df.where("g = 0").withColumn("fold", F.when(F.col("id") < 30, -1).otherwise(F.col("fold")))
    other = held.withColumn("y", F.when(F.col("fold") < 0, F.lit(None).cast("int")).otherwise(F.col("y")))
    a, b = ({r.id: r.probas for r in ph.class_decoder(t, ["g"], "id", [-1, 0, 1]).collect()} for t in (held, other))
    assert set(a) == set(b) == set(range(90)) and all(a[i] == pytest.approx(b[i], abs=1e-12) for i in a)
    assert ph.class_decoder(df.limit(0), ["g"], "id", [-1, 0, 1]).count() == 0


def test_phases_do_not_leak(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, i % 6 + 1, i // 6 % 2, (rng.standard_normal(4) + (i // 6 % 2)).tolist()) for i in range(180)] + [(1, i, 1 + i % 2, 0, [0.0] * 4) for i in range(20)]
    df = spark.createDataFrame(rows, "g int, id long, step int, y int, x array<double>")
    held = ph.end_step_decoder(df, ["g"], "id", "step")
    got = {r.id: r for r in held.collect()}
    assert set(got) == {i for i in range(180) if i % 6 not in (0, 5)} and {r.n_models for r in got.values()} == {2} and {r.g for r in got.values()} == {0}
    assert np.mean([(r.proba > 0.5) == r.y for r in got.values()]) > 0.7
    flipped = df.withColumn("y", F.when(F.col("step").isin(1, 6), F.col("y")).otherwise(1 - F.col("y")))  # labels of held-out trials
    again = {r.id: r.proba for r in ph.end_step_decoder(flipped, ["g"], "id", "step").collect()}
    assert all(got[i].proba == pytest.approx(again[i], abs=1e-12) for i in got)
    half = ph.end_step_decoder(df.where("g = 0"), ["g"], "id", "step", "stratify").collect()
    assert len(half) == 90 and {s: sum(r.step == s for r in half) for s in range(1, 7)} == dict.fromkeys(range(1, 7), 15)
    with pytest.raises(ValueError):
        ph.end_step_decoder(df, ["g"], "id", "step", "other")

    later = spark.createDataFrame([(0, i, 0, 3 * got[i].proba + 0.1 * rng.standard_normal() if i in got else 1e9) for i in range(180)] + [(0, i, 1, float(rng.standard_normal())) for i in range(180)], "g int, id long, part int, v double")
    between = spark.createDataFrame([(0, i, rng.standard_normal(3).tolist()) for i in range(180)], "g int, id long, x array<double>")
    fits = ph.second_phase(held, between, later, ["g"], "id", "step", ["part"], "v").collect()
    assert len(fits) == 4 and all(r.names == ["1", "proba", "x-0", "x-1", "x-2"] for r in fits)  # trained trials, with 1e9, have no part in it
    for r in fits:
        assert r.r2_baseline == pytest.approx(r.r2 - r.unique["proba"])
        assert r.r2 > 0.8 > 0.2 > r.r2_baseline if r.part == 0 else r.r2 < 0.3
    (r,) = ph.phase_correlation(held, held.withColumn("q", 1 - F.col("proba")), ["g"], "id", "proba", "q").collect()
    assert r.n == len(got) and r.r == pytest.approx(-1)


def test_cluster_geometry(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 4)) * [1, 5, 0, 2] + [0, 1, 7, 3]
    label = rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(60)], "id int, k int, x array<double>").repartition(3)
    z = np.where(x.std(0) > 1e-12, (x - x.mean(0)) / np.where(x.std(0) > 1e-12, x.std(0), 1), 0)
    std = ge.standardised_vectors(df, "x")
    assert all(r.x == pytest.approx(z[r.id]) for r in std.collect())
    profiles = ge.cluster_profiles(std, "k", "x")
    centers = {r.k: r for r in profiles.collect()}
    for k in range(3):
        own = z[label == k]
        assert centers[k].n == len(own) and centers[k].center == pytest.approx(own.mean(0)) and centers[k].spread == pytest.approx(own.std(0) / np.sqrt(len(own)))
    for r in ge.cluster_distances(profiles, "k").collect():
        far = ((z[label == r.a][:, None] - z[label == r.b][None]) ** 2).sum(2)
        assert r.members == pytest.approx(np.sqrt(far.mean())) and r.centers == pytest.approx(np.linalg.norm(z[label == r.a].mean(0) - z[label == r.b].mean(0)))
    for own in (False, True):
        got = {(r.k, r.rank): (r.id, r.distance) for r in ge.nearest_members(std, profiles, "id", "k", "x", 3, own).collect()}
        for k in range(3):
            d = sorted((np.linalg.norm(z[i] - z[label == k].mean(0)), i) for i in range(60) if not own or label[i] == k)
            assert [got[k, j + 1][0] for j in range(3)] == [i for _, i in d[:3]] and got[k, 1][1] == pytest.approx(d[0][0])
    scored = df.withColumn("score", F.col("id").cast("double"))
    up = ge.upper_clusters(scored, "k", "score", 0.5, "x", 2, 2).collect()
    assert {r.id for r in up} == {i for k in range(3) for i in np.flatnonzero(label == k) if i > np.quantile(np.flatnonzero(label == k), 0.5)}
    assert ge.upper_clusters(scored.limit(0), "k", "score", 0.5, "x", 2, 2).count() == 0
    best = ge.best_settings(spark.createDataFrame([("a", 1e-3), ("a", 1.0), ("a", 1e2), ("b", 10.0)], "g string, c double"), ["g"], "c", (1e-3, 1e2))
    assert {r.g: (r.n, r.at_bound, round(r.mean_log, 9)) for r in best.collect()} == {"a": (3, 2, round(-1 / 3, 9)), "b": (1, 0, 1.0)}


def test_intervals_and_long_forms(spark):
    intervals = spark.createDataFrame([("s", " ", 9.0), ("s", "aa", 4.0), ("s", "b", 6.0), ("s", None, 8.0), ("t", "\t\n ", 3.0)], "k string, mark string, until double")
    ends = ar.last_marked_end(intervals, ["k"], "mark", "until")
    assert [tuple(r) for r in ends.collect()] == [("s", 6.0)]
    windows = spark.createDataFrame([("s", 6.0), ("s", 6.5), ("s", 1.0), ("t", 1.0)], "k string, last double")
    assert sorted((r.last, r.ahead) for r in ar.windows_until(windows, ends, ["k"], "last").collect()) == [(1.0, 5.0), (6.0, 0.0)]
    rows = spark.createDataFrame([(1, [0.5, 1.5]), (2, []), (3, None)], "e int, samples array<double>")
    long = ar.long_form(rows, ["e"], "samples", -0.4, 100.0)
    assert [(r.e, round(r.time, 9), r.value) for r in long.collect()] == [(1, -0.4, 0.5), (1, -0.39, 1.5)]
    both = ar.with_contrast(long.withColumn("label", F.lit("a")).withColumn("extra", F.lit(1)), long, "label", {"flag": False}).collect()
    assert [(r.label, r.extra, r.flag) for r in both] == [("a", 1, None)] * 2 + [("contrast", None, False)] * 2
