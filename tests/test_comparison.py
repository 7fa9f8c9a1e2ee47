"""Paired model comparison: planted signals, rare labels, equal folds, stored settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialgrid.operators import comparison as cm
from trialgrid.operators.auc import grouped_auc, threshold_metrics
from trialgrid.operators.decoders import fit_logistic

SCHEMA = "site int, epoch long, cue double, x array<double>, y int"


def _table(spark, n=150, rare=None):
    """Site 0: the signal tells; site 1: noise only. The cue tells a little in both."""
    rng = np.random.default_rng(5)
    rows = []
    for site in (0, 1):
        for i in range(n):
            y = i % 2 if rare is None else int(i < rare)
            rows.append((site, i, float(y + rng.standard_normal() * 2), [float(v) for v in rng.standard_normal(6) + (y * 1.5 if site == 0 else 0)], y))
    return spark.createDataFrame(rows, SCHEMA)


def test_start_does_not_change_the_solution():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((60, 4)), (rng.random(60) < 0.4).astype(int)
    w = fit_logistic(x, y, 1.0)
    assert np.abs(fit_logistic(x, y, 1.0, start=w * 3 + 1) - w).max() < 1e-6


def test_planted_signal_gains_and_noise_does_not(spark):
    rows = _table(spark)
    rows = rows.join(cm.repeated_splits(rows, ["site"], "epoch", "y", ["y"]), ["site", "epoch"]).cache()
    held = cm.compared(rows, ["site"], "epoch", ["cue"]).cache()
    # 30 of 150 held out in each of 5 repeats, those of the table of splits and no others
    assert held.count() == 2 * 5 * 30
    want = rows.select("site", "epoch", F.posexplode("split").alias("repeat", "fold")).where("fold < 0")
    assert held.join(want, ["site", "epoch", "repeat"]).count() == 300
    scores = cm.paired_scores(held, ["site"])
    gain = {r.site: r.g for r in scores.groupBy("site").agg(F.avg("auc_gain").alias("g")).collect()}
    assert gain[0] > 0.15 and abs(gain[1]) < 0.15
    assert {r.baseline_c for r in scores.collect()} <= set(cm.BASELINE_C) and {r.full_kept for r in scores.collect()} <= set(cm.KEPT)
    # both ways to the same scores
    one = grouped_auc(held, "y", "full_proba", ["site", "repeat"]).join(threshold_metrics(held, "y", "full_proba", ["site", "repeat"]), ["site", "repeat"]).join(scores, ["site", "repeat"])
    assert one.count() == 10
    for name in ("auc", "accuracy", "precision", "recall", "log_loss"):
        assert one.agg(F.max(F.abs(F.col(name) - F.col(f"full_{name}")))).first()[0] < 1e-9
    # stored settings give the same probabilities without a search
    fixed = held.groupBy("site", "repeat").agg(*[F.first(c).alias(c) for c in ("baseline_c", "baseline_kept", "full_c", "full_kept")])
    again = cm.compared(rows, ["site"], "epoch", ["cue"], fixed=fixed.where("repeat < 2")).withColumnRenamed("full_proba", "q")
    both = again.join(held.select("site", "repeat", "epoch", "full_proba"), ["site", "repeat", "epoch"])
    assert both.count() == 2 * 2 * 30 and both.agg(F.max(F.abs(F.col("q") - F.col("full_proba")))).first()[0] < 1e-9


def test_baseline_model_by_hand(spark):
    rows = _table(spark, 40)
    rows = rows.join(cm.repeated_splits(rows, ["site"], "epoch", "y", ["y"], repeats=1), ["site", "epoch"])
    got = cm.compared(rows, ["site"], "epoch", ["cue"], baseline_grid=(10.0,), full_grid=(1.0,), kept=(0.9,)).where("site = 0").toPandas().set_index("epoch")
    part = rows.where("site = 0").toPandas()
    train = part["split"].map(lambda s: s[0] >= 0).to_numpy()
    w = fit_logistic(part[["cue"]].to_numpy()[train], part["y"].to_numpy()[train], 10.0)
    for e, cue in part.loc[~train, ["epoch", "cue"]].itertuples(index=False):
        assert got.loc[e, "baseline_proba"] == pytest.approx(1 / (1 + np.exp(-w[0] * cue)), abs=1e-9)


@pytest.mark.parametrize(("rare", "folds"), [(1, None), (4, None), (8, 2), (10, 2), (30, 3)])
def test_rare_labels_reduce_folds_or_skip(spark, rare, folds):
    got = cm.repeated_splits(_table(spark, 60, rare).where("site = 0"), ["site"], "epoch", "y", ["y"], repeats=2)
    seen = [s for r in got.collect() for s in r.split]
    assert (max(seen) + 1 if seen else None) == folds


def test_nulls_one_label_and_no_rows(spark):
    rows = spark.createDataFrame([(0, i, None if i % 2 else 1.0, [1.0, None], 1) for i in range(30)] + [(1, i, 1.0, None, None) for i in range(5)], SCHEMA)
    assert cm.repeated_splits(rows, ["site"], "epoch", "y", ["y"]).count() == 0
    mixed = _table(spark, 40).withColumn("cue", F.when(F.col("epoch") != 3, F.col("cue"))).withColumn("x", F.when(F.col("epoch") != 5, F.col("x")))
    mixed = mixed.join(cm.repeated_splits(mixed, ["site"], "epoch", "y", ["y"], repeats=1), ["site", "epoch"])
    out = cm.compared(mixed, ["site"], "epoch", ["cue"], full_grid=(1.0,))
    assert out.where("epoch in (3, 5)").count() == 0 and out.count() > 0
    assert cm.paired_scores(cm.compared(mixed.where("false"), ["site"], "epoch", ["cue"]), ["site"]).count() == 0
