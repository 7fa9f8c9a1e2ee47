"""Costs that grew with the input or with rounding: line searches at the end of a fit, groups a solver call gets."""

import numpy as np

from trialgrid.operators import decoders
from trialgrid.operators import regression as rg


def test_fit_ends_without_halving(monkeypatch):
    """A step whose gain is below the loss's rounding is taken as it is; the search isn't halved to nothing again and again."""
    rng, calls = np.random.default_rng(0), []
    x, y = rng.normal(size=(240, 17)), (rng.random(240) < 0.5).astype(int)
    plain = np.logaddexp
    monkeypatch.setattr(np, "logaddexp", lambda *a: calls.append(1) or plain(*a))
    s = np.where(y == 1, 1.0, -1.0)
    for c in np.logspace(-8, 3, 10):
        w = decoders.fit_logistic(x, y, c)
        weight = c * np.where(y == 1, 240 / (2 * (y == 1).sum()), 240 / (2 * (y == 0).sum()))
        assert np.abs(w - x.T @ (weight * s / (1 + np.exp(s * (x @ w))))).max() < 1e-9
    assert len(calls) < 150


def test_auc_shares_ties():
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 60), rng.integers(0, 7, 60) / 7
    pairs = [(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]
    assert abs(decoders._auc(y, p) - np.mean(pairs)) < 1e-12


def test_a_solver_call_has_one_output(spark, monkeypatch):
    """The solver gets one output's sums a call, however many groups there are."""
    rows = [(g, k, k % 2, k // 2 % 2, [("a", float(k + g))], float(k)) for g in range(20) for k in range(8)]
    design = spark.createDataFrame(rows, "g int, id int, outer int, inner int, terms array<struct<term:string,x:double>>, y double")
    fits = rg.nested_ridge(design.drop("y"), design.select("g", "id", "y", "outer").withColumnRenamed("outer", "_o").selectExpr("g", "id", "'o' AS c", "y"), ["g"], "id", ["c"], "y", [1.0, 10.0])
    assert fits.count() == 40
    plan = fits._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "MapInPandas " not in plan.replace("FlatMapGroupsInPandas", "")
