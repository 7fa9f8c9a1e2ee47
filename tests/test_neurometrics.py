"""Peak tables, polarities, window comparisons, populations and re-alignment on small tables with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialgrid.operators import arrays as ar
from trialgrid.operators import auc
from trialgrid.operators import neurometrics as ne


def test_bounded_peaks(spark):
    means = spark.createDataFrame([("a", "p", 0, 15, 0.9), ("a", "p", 2, 17, 0.7), ("a", "p", 4, 19, 0.7), ("a", "p", 6, 21, 0.8), ("b", "p", 2, 17, 0.5), ("c", "q", 2, 17, 0.9), ("d", None, 2, 17, 0.9)], "site string, pair string, smin int, smax int, s double")
    ends = spark.createDataFrame([("p", 12), ("p", 19), ("q", 16)], "pair string, end int")
    got = ne.bounded_peaks(means, ends, ["site", "pair"], ["pair"], "s", 2, 0.6).collect()
    assert [(r.site, r.smin) for r in got] == [("a", 2)]  # too early, too late, too low, no end; of equal ones the earlier


def test_predictions_at_peaks(spark):
    peaks = spark.createDataFrame([("a", 2, "x"), ("b", 3, "x")], "site string, smin int, word string")
    pred = spark.createDataFrame([("a", 2, 10), ("a", 2, 11), ("a", 2, 12), ("a", 4, 10)], "site string, smin int, epoch int")
    md = spark.createDataFrame([(10, "x"), (11, "y")], "epoch int, word string")
    assert sorted((r.site, r.epoch or 0, r.word or "") for r in ne.at_peaks(peaks.drop("word"), pred, ["site", "smin"], md, ["epoch"]).collect()) == [("a", 10, "x"), ("a", 11, "y"), ("a", 12, ""), ("b", 0, "")]
    assert [(r.site, r.epoch) for r in ne.at_peaks(peaks, pred, ["site", "smin"], md, ["epoch"], "word").collect()] == [("a", 10)]


def test_regression_table(spark):
    rows = [("k", s, r, float(v), float(w)) for s, r, v, w in [(1, 0, 5, 0), (6, 1, 2, 0), (6, 0, 99, 0), (3, 0, 1, 4), (3, 1, 1, 9), (4, 1, 7, 100)]] + [("m", 1, 0, 1.0, 1.0), ("m", 3, 0, 1.0, 2.0), ("m", 3, 1, 1.0, 3.0)]
    t = spark.createDataFrame(rows, "key string, step int, response int, early double, late double").withColumn("target", (F.col("step") > 3).cast("int"))
    steps = spark.createDataFrame([("k", [3]), ("m", [3])], "key string, steps array<int>")
    got = ne.regression_table(t, steps, ["key"], "early", "late", "step", "target", "response", F.col("target") == F.col("response")).collect()
    assert len(got) == 6 and {r.key for r in got} == {"k"}  # m has one target only among its consistent end steps
    assert {(r.early_polarity, r.late_polarity) for r in got} == {(-1, 1)} and sorted(r.early_signed for r in got) == [-99, -7, -5, -2, -1, -1]
    assert {(r.step, r.is_ambiguous) for r in got} == {(1, False), (6, False), (3, True), (4, False)}


def test_window_comparison(spark):
    rng = np.random.default_rng(1)
    rows = [(s, i, w, float(rng.standard_normal() + s * w)) for s in range(3) for i in range(4) for w in (0, 1)] + [(0, 9, 0, 1.0), (7, 1, 0, 1.0), (8, 1, 0, 1.0), (8, 1, 1, 2.0)]
    got = {r.s: r for r in ne.window_comparison(spark.createDataFrame(rows, "s int, site int, w int, v double"), {"a": F.col("w") == 0, "b": F.col("w") == 1}, "s", ["site"], "v").collect()}
    assert set(got) == {0, 1, 2, 8, None} and got[8].t is None and got[8].n == 1
    gaps = {s: np.array([next(v for a, i, w, v in rows if (a, i, w) == (s, k, 1)) - next(v for a, i, w, v in rows if (a, i, w) == (s, k, 0)) for k in range(4)]) for s in range(3)}
    for s, g in gaps.items():
        assert got[s].gap == pytest.approx(g.mean()) and got[s].t == pytest.approx(g.mean() / (g.std(ddof=1) / 2))
    over = np.array([gaps[0].mean(), gaps[1].mean(), gaps[2].mean(), 1.0])
    assert got[None].n == 4 and got[None].t == pytest.approx(over.mean() / (over.std(ddof=1) / 2))
    assert ne.window_comparison(spark.createDataFrame([], "s int, site int, w int, v double"), {"a": F.col("w") == 0, "b": F.col("w") == 1}, "s", ["site"], "v").count() == 0


def test_curves_and_population_vectors(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 3.0), ("a", 2, 5.0), ("b", 1, 2.0), ("b", 1, None)], "site string, step int, v double")
    got = {(r.site, r.step): r for r in ne.curves(rows, ["site"], "step", "v").collect()}
    assert got["a", 1].n == 2 and got["a", 1].mean == 2 and got["a", 1].slope == pytest.approx(3.0) and got["b", 1].slope is None and got["b", 1].n == 1
    x = spark.createDataFrame([(0, t, s, 1, [float(t), float(s)]) for t in range(3) for s in range(3) if (t, s) != (2, 1)], "g int, trial int, site int, y int, x array<double>")
    members = spark.createDataFrame([("all", 0, s) for s in range(3)] + [("one", 0, 2)], "population string, g int, site int")
    out = {(r.population, r.trial): r.x for r in ne.population_vectors(x, members, "population", ["g"], "site", "trial", "x", ["y"]).collect()}
    assert out == {("all", 0): [0, 0, 0, 1, 0, 2], ("all", 1): [1, 0, 1, 1, 1, 2], ("one", 0): [0, 2], ("one", 1): [1, 2], ("one", 2): [2, 2]}


def test_events_and_binary_targets(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (2, [1.0, 2.0, 3.0, 4.0, 5.0], 4), (3, [1.0, 2.0, 3.0, 4.0, 5.0], 5), (4, [1.0, 2.0, 3.0, 4.0, 5.0], None), (5, [1.0, 2.0, 3.0, 4.0, 5.0], 3)], "id int, samples array<double>, at int")
    got = {r.id: r.samples for r in ar.aligned_to_event(df, "at", 2).collect()}
    assert got == {1: [None, 1, 2, 3], 2: [3, 4, 5, None], 5: [2, 3, 4, 5]}
    assert [r.samples for r in ar.aligned_to_event(df.where("id = 1"), "at", 2).collect()] == [[None, 1, 2, 3, 4]]
    for bad in (2, None, -1):
        rows = spark.createDataFrame([("g", 1, 0.5), ("g", bad, 0.2)], "g string, t int, p double")
        with pytest.raises(Exception, match="is not 0 or 1"):
            auc.grouped_auc(rows, "t", "p", ["g"]).collect()
