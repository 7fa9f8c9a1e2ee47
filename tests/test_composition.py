"""Compositions and regressions from sums against numpy: parts of three models, wrong sizes, refits on the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialgrid.functions.special import f_tail
from trialgrid.operators import composition as co
from trialgrid.operators import decoders
from trialgrid.operators import regression as rg


def sigmoid(v):
    return 1 / (1 + np.exp(-v))


def models(spark, rng, n, dim, axes, base=0):
    rows = [(k, rng.standard_normal(dim).tolist(), rng.uniform(0.5, 2, dim).tolist(), rng.standard_normal(base).tolist(), rng.uniform(0.5, 2, base).tolist(), rng.standard_normal((axes, dim)).tolist(), rng.standard_normal(base + axes).tolist()) for k in range(n)]
    return rows, spark.createDataFrame(rows, "k int, center array<double>, scale array<double>, base_center array<double>, base_scale array<double>, pca array<array<double>>, coef array<double>")


def test_three_models_in_one(spark):
    rng = np.random.default_rng(1)
    a, scaler = models(spark, rng, 4, 6, 3)
    b, axes = models(spark, rng, 3, 6, 2)
    c, classifier = models(spark, rng, 4, 6, 2, base=2)
    xs = [(k, i, rng.standard_normal(6).tolist(), float(i), 2.0) for k in range(5) for i in range(7)]
    vectors = spark.createDataFrame(xs, "k int, id int, x array<double>, f double, g double")
    got = {(r.k, r.id): r for r in co.composed(vectors, ["k"], scaler, axes, classifier, 2).collect()}
    assert set(got) == {(k, i) for k in range(3) for i in range(7)}  # keys with all three parts
    for k, i, x, f, g in xs[:21]:
        z = (np.array(x) - a[k][1]) / a[k][2]
        assert got[k, i].logit == pytest.approx(np.array(b[k][5]) @ z @ np.array(c[k][6])[2:]) and got[k, i].proba == pytest.approx(sigmoid(got[k, i].logit))
    whole = {(r.k, r.id): r for r in co.whole_pipeline(vectors, classifier, ["k"], ["f", "g"]).collect()}
    for k, i, x, f, g in xs[:28]:
        z = np.r_[(np.array([f, g]) - c[k][3]) / c[k][4], np.array(c[k][5]) @ ((np.array(x) - c[k][1]) / c[k][2])]
        assert whole[k, i].logit == pytest.approx(z @ np.array(c[k][6])) and set(whole[k, i].asDict()) == {"k", "id", "x", "f", "g", "logit", "proba"}
    by_id = {r.id: r for r in co.ensemble(co.composed(vectors, ["k"], scaler, axes, classifier, 2), ["id"]).collect()}
    assert by_id[3].n_models == 3 and by_id[3].proba == pytest.approx(sigmoid(np.mean([got[k, 3].logit for k in range(3)])))
    mean = {r.id: r.proba for r in co.ensemble(co.composed(vectors, ["k"], scaler, axes, classifier, 2), ["id"], "proba").collect()}
    assert mean[3] == pytest.approx(np.mean([got[k, 3].proba for k in range(3)]))
    for wrong in ((scaler, axes, classifier, 1), (models(spark, rng, 3, 5, 2)[1], axes, classifier, 2), (scaler, models(spark, rng, 3, 7, 2)[1], classifier, 2)):
        with pytest.raises(Exception, match="sizes don't fit"):
            co.composed(vectors, ["k"], *wrong).collect()


def test_outcome_sets_are_those_of_numpy(spark):
    """Fitted models: M12 to M14's orders of scaler, axes and classifier, and the baseline's zeroed or real feature."""
    rng = np.random.default_rng(2)
    n, dim = 120, 8
    y = rng.integers(0, 2, n)
    rows = [(0, i, s, int(y[i]), (rng.standard_normal(dim) + y[i] * (s + 1) * 0.3).tolist(), float(i % 4), i % 3) for i in range(n) for s in (0, 32)]
    x = spark.createDataFrame(rows, "g int, id int, smin int, y int, x array<double>, cue double, fold int")
    early, late = x.where("smin = 0"), x.where("smin = 32")
    phonetic, behavioural = decoders.fitted_models(early, ["g"], kept=None), co.models_with_baseline(late, ["g"], ["cue"])
    p, b = ({r.fold: r for r in t.collect()} for t in (phonetic, behavioural))
    for k, m in b.items():
        own = np.array([r[4] for r in rows if r[2] == 32 and r[6] != k])
        assert m.center == pytest.approx(own.mean(0)) and len(m.coef) == 1 + len(m.pca)
        z, plain, cls = (own - own.mean(0)) / own.std(0), np.array([r[5] for r in rows if r[2] == 32 and r[6] != k]), np.array([r[3] for r in rows if r[2] == 32 and r[6] != k])
        f = np.hstack([((plain - plain.mean()) / plain.std())[:, None], z @ np.array(m.pca).T])
        s, w = np.where(cls == 1, 1, -1), np.array(m.coef)
        weight = np.where(cls == 1, len(cls) / (2 * (cls == 1).sum()), len(cls) / (2 * (cls == 0).sum()))
        assert np.abs(w - f.T @ (weight * s * sigmoid(-s * (f @ w)))).max() < 1e-7  # the loss is flat there
    at = {(r[1], r[2]): (np.array(r[4]), r[5], r[6]) for r in rows}
    for r in co.behaviour_on_phonetic(early, phonetic, behavioural, ["g", "fold"], 1).collect():
        v, _, k = at[r.id, 0]
        assert r.logit == pytest.approx(np.array(b[k].coef)[1:] @ (np.array(b[k].pca) @ ((v - p[k].center) / p[k].scale)))
    for r in co.phonetic_on_behaviour(late, phonetic, behavioural, ["g", "fold"]).collect():
        v, _, k = at[r.id, 32]
        assert r.logit == pytest.approx(np.array(p[k].coef) @ (np.array(p[k].pca) @ ((v - b[k].center) / b[k].scale)))
    for r in co.whole_pipeline(early, behavioural, ["g", "fold"], ["cue"]).collect():
        v, cue, k = at[r.id, 0]
        z = np.r_[(cue - b[k].base_center[0]) / b[k].base_scale[0], np.array(b[k].pca) @ ((v - b[k].center) / b[k].scale)]
        assert r.logit == pytest.approx(z @ np.array(b[k].coef))
    both = decoders.fitted_models(x, ["g", "smin"])
    sets = co.transfer_sets(x, both, ["g", "fold"], 0, 32)
    assert sets.count() == 4 * n and {(r.data_window, r.model_window) for r in sets.collect()} == {(a, c) for a in ("early", "late") for c in ("early", "late")}
    (s,) = co.transfer_summary(sets, ["g"]).collect()
    assert s.early_to_late == pytest.approx(s.early_late_auc / s.late_late_auc) and s.early_effect == pytest.approx(s.early_early_auc - s.late_early_auc)
    own = {r.fold: r for r in co.transfer_summary(sets, ["g", "fold"], spark.createDataFrame([(0, 1, 0.5, 0.25)], "g int, fold int, early_auc double, late_auc double")).collect()}
    assert set(own) == {1} and own[1].late_to_early == pytest.approx(own[1].late_early_auc / 0.5)


def test_weights_go_back_through_the_axes(spark):
    rng = np.random.default_rng(3)
    rows, m = models(spark, rng, 3, 12, 4, base=1)
    back = co.back_projected(m, 1)
    for r in back.collect():
        assert r.weights == pytest.approx(np.array(rows[r.k][6])[1:] @ np.array(rows[r.k][5])) and r.base_weights == rows[r.k][6][:1]
        long = {(s.channel, s.place): s.weight for s in co.split_weights(back.where(F.col("k") == r.k), ["k"], 3).collect()}
        assert [long[c, i] for c in range(3) for i in range(4)] == pytest.approx(r.weights)
    with pytest.raises(Exception, match="sizes don't fit"):
        co.split_weights(back, ["k"], 5).collect()
    with pytest.raises(Exception, match="sizes don't fit"):
        co.back_projected(m, 2).collect()


def rows_of(rng, n):
    pair = rng.integers(0, 3, n)
    f = {"a": np.round(rng.standard_normal(n), 3), "b": rng.integers(0, 2, n).astype(float)}
    y = np.stack([f["a"] * (pair + 1) + 0.3 * rng.standard_normal(n) + 2, f["b"] - 0.5 * f["a"] + rng.standard_normal(n), np.full(n, 1.5)], 1)
    return pair, f, y


@pytest.mark.parametrize("scaled", [True, False])
def test_folds_from_sums_equal_refits(spark, scaled):
    rng = np.random.default_rng(4)
    n, alphas = 240, [0.01, 1.0, 30.0, 1000.0]
    pair, f, y = rows_of(rng, n)
    t = spark.createDataFrame([(1, i, int(pair[i]), float(f["a"][i]), float(f["b"][i])) for i in range(n)], "g int, id int, pair int, a double, b double").repartition(3)
    cells = rg.nested_cells(t, ["g"], "id", ["pair"], 3, 2)
    design = t.select("g", "id", rg.terms_by_condition(["a", "b"], "pair").alias("terms")).join(cells, ["g", "id"])
    out = spark.createDataFrame([(1, i, c, float(y[i, c])) for i in range(n) for c in range(3)] + [(1, 5, 9, None)], "g int, id int, c int, y double")
    got = {(r.c, r.outer): r for r in rg.nested_ridge(design, out, ["g"], "id", ["c"], "y", alphas, {"a": ["a"], "b1": ["b-1"]}, scaled).collect()}
    cell = {r.id: (r.outer, r.inner) for r in cells.collect()}
    outer, inner = (np.array([cell[i][k] for i in range(n)]) for k in (0, 1))
    assert set(np.bincount(outer)) <= {79, 80, 81} and all(len({cell[i] for i in range(n) if pair[i] == q}) == 6 for q in range(3))
    names = [f"{c}-{q}" for c in ("a", "b") for q in range(3)]
    x = np.stack([f[c] * (pair == q) for c in ("a", "b") for q in range(3)], 1)

    def refit(train, v, alpha, keep):
        m, s = x[train][:, keep].mean(0), x[train][:, keep].std(0) if scaled else 1.0
        z = (x[:, keep] - m) / s
        w = np.linalg.solve(z[train].T @ z[train] + alpha * np.eye(keep.sum()), z[train].T @ (v[train] - v[train].mean()))
        return z @ w + v[train].mean(), w / s

    r2 = lambda v, p, held: 1 - ((v - p)[held] ** 2).sum() / ((v[held] - v[held].mean()) ** 2).sum()
    every = np.ones(6, bool)
    for c in (0, 1):
        for k in range(3):
            train, r = outer != k, got[c, k]
            mean = [np.mean([r2(y[:, c], refit(train & (inner != j), y[:, c], a, every)[0], train & (inner == j)) for j in range(2)]) for a in alphas]
            assert r.alpha == alphas[int(np.argmax(mean))] and r.names == ["1", *names]
            p, w = refit(train, y[:, c], r.alpha, every)
            assert r.r2 == pytest.approx(r2(y[:, c], p, ~train), abs=1e-8) and r.coef[1:] == pytest.approx(w, abs=1e-8)
            for name, keep in (("a", np.arange(6) >= 3), ("b1", np.arange(6) != 4)):
                assert r.unique[name] == pytest.approx(r.r2 - r2(y[:, c], refit(train, y[:, c], r.alpha, keep)[0], ~train), abs=1e-8)
    assert got[2, 0].r2 is None and got[2, 0].coef == pytest.approx([1.5, *[0.0] * 6], abs=1e-9)  # an output that doesn't vary
    one = design.withColumn("outer", F.lit(0))
    assert rg.nested_ridge(one, out, ["g"], "id", ["c"], "y", alphas).count() == 0
    assert rg.nested_ridge(design.limit(0), out, ["g"], "id", ["c"], "y", alphas).count() == 0


def test_nested_f(spark):
    rng = np.random.default_rng(5)
    n = 50
    a, b = rng.standard_normal(n), rng.standard_normal(n)
    y = a + 0.4 * b + rng.standard_normal(n)
    rows = [("x", float(y[i]), float(a[i]), float(b[i]), float(2 * a[i])) for i in range(n)] + [("x", None, 1.0, 1.0, 2.0), ("two", 1.0, 1.0, 2.0, 2.0), ("two", 2.0, 3.0, 1.0, 6.0), ("flat", 1.0, 1.0, 2.0, 2.0), ("flat", 1.0, 2.0, 5.0, 4.0), ("flat", 1.0, 2.0, 1.0, 4.0), ("flat", 1.0, 0.0, 1.0, 0.0)]
    got = {(r.g, r.step): r for r in rg.nested_f_tests(spark.createDataFrame(rows, "g string, y double, a double, b double, c double"), ["g"], "y", [["a"], ["b"], ["c"]]).collect()}
    rss = []
    for cols in ([], [a], [a, b]):
        z = np.stack([np.ones(n), *cols], 1)
        rss.append(((y - z @ np.linalg.lstsq(z, y, rcond=None)[0]) ** 2).sum())
    for k in (1, 2):
        r, f = got["x", k], (rss[k - 1] - rss[k]) / (rss[k] / (n - k - 1))
        assert (r.n, r.df1, r.df2) == (n, 1, n - k - 1) and r.rss == pytest.approx(rss[k]) and r.f == pytest.approx(f) and r.rss_drop == pytest.approx(rss[k - 1] - rss[k])
        assert r.p == pytest.approx(f_tail(f, 1, n - k - 1)) and r.r2 == pytest.approx(1 - rss[k] / ((y - y.mean()) ** 2).sum())
    assert got["x", 3].f is None and got["x", 3].df1 == 0 and got["x", 3].rss == pytest.approx(rss[2])  # depends on a
    assert got["two", 1].f is None and got["flat", 1].f is None and got["flat", 1].r2 is None
    assert f_tail(4.0, 1, 10) == pytest.approx(0.0734, abs=1e-4) and f_tail(3.0, 2, 12) == pytest.approx(1.5 ** -6, rel=1e-9)
