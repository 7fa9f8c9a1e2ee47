"""Larger groups and ties: places in several buckets, means on a threshold whatever the order of rows."""

import random

from pyspark.sql import functions as F

from trialgrid.operators import auc
from trialgrid.operators import relational as rel


def test_matched_sample_in_buckets(spark):
    """A table of more than one bucket of places gives the rows that one bucket does."""
    rows = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id").alias("epoch"))
    wanted = spark.createDataFrame([(0, 150), (1, 30), (2, 0)], "g long, k long")
    sample = lambda most: sorted(map(tuple, rel.matched_sample(rows, wanted, ["g"], "epoch", 1, most).select("g", "draw", "epoch").collect()))
    assert sample(40) == sample(1 << 17) and len(sample(40)) == 180


def test_means_on_a_threshold(spark):
    """Folds whose mean is a threshold are on it in any order; 0.1 + 0.2 + 0.3 isn't 0.3 + 0.2 + 0.1."""
    rng, rows = random.Random(1), []
    for site in range(200):
        folds = [0.1, 0.2, 0.3, 0.7, 0.95]  # the mean is 0.45
        rng.shuffle(folds)
        rows += [(site, 0, v) for v in folds]
    means = auc.fold_means(spark.createDataFrame(rows, "site int, smin int, auc double").repartition(7), "auc", ["site", "smin"])
    assert {r.mean_auc for r in means.collect()} == {0.45}
    found = auc.swept_peaks(means, [0.45]).first()
    assert found.n_sites == 200


def test_later_peaks_tie(spark):
    """Gains that agree in nine digits are a tie, as in SQL: the earlier window is taken."""
    peaks = spark.createDataFrame([(1, 0)], "site int, smin int")
    gains = spark.createDataFrame([(1, "a", 5, 0.2), (1, "a", 7, 0.2 + 3e-11), (1, "b", 5, 0.1), (1, "b", 5, 0.2), (1, "b", 5, -0.3)], "site int, word string, smin int, gain double")
    assert [(r.word, r.smin) for r in auc.later_peaks(peaks, gains, 1).collect()] == [("a", 5)]


def test_tuning_of_equal_means(spark, tmp_path):
    """Equal means of both pairs prefer neither, whatever the order in which they are summed."""
    import trialgrid.plans.composites  # noqa: F401
    from trialgrid.plans.registry import QUERIES

    rows = [(7, t, v, k) for k in (1, 4) for t, vs in (("signup", (0.1, 0.2, 0.3)), ("view", (0.3, 0.2, 0.1))) for v in vs]
    events = spark.createDataFrame([(7, i, t, v, f'{{"k": {k}}}') for i, (_, t, v, k) in enumerate(rows)], "user_id long, event_id long, event_type string, value double, props string")
    events.withColumn("ts", F.current_timestamp()).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["tuning_comparison"](spark, str(tmp_path)).select("electrode", "early", "late", "same").collect()] == [(7, "d", "d", True)]


def test_counterfactual_sites_in_blocks(spark, monkeypatch):
    """Correlations of sites that don't fit beside each other in a row of draws are the same."""
    from trialgrid.operators import resampling as rs

    rng = random.Random(4)
    trials = [(i % 3, "a", i % 2, i, rng.randint(0, 5) / 2) for i in range(70)]
    outputs = spark.createDataFrame(trials, "subject int, pair string, step int, epoch long, value double")
    responses = outputs.select("subject", "pair", "step", "epoch", F.posexplode(F.array(*[F.pmod(F.col("epoch") * k, F.lit(7)) for k in (1, 2, 3)])).alias("site", "response"))
    run = lambda: sorted((r.subject, r.other, r.site, r.repeat, round(r.r, 9)) for r in rs.counterfactual_correlations(outputs, responses, "subject", ["pair"], "site", ["step"], "epoch", "value", "response", 2).collect())
    whole = run()
    monkeypatch.setattr(rs, "SITES", 2)
    assert len(whole) == 3 * 2 * 3 * 2 and run() == whole


def test_false_discovery_in_buckets(spark):
    """q by rank with ties and a null, the same in any number of buckets."""
    from trialgrid.operators import stats

    ps = [0.001, 0.01, 0.01, 0.03, 0.2, 0.2, 0.21, 1.0, None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "k int, p double")
    m, known = len(ps), [p for p in ps if p is not None]
    want = [1.0 if p is None else min(1.0, min(q * m / (i + 1) for i, q in enumerate(known) if q >= p)) for p in ps]
    for buckets in (1, 4, 4096):
        got = [r.q for r in stats.false_discovery(df, "p", ["k"], buckets=buckets).orderBy("k").collect()]
        assert all(abs(a - b) < 1e-12 for a, b in zip(got, want, strict=True))
