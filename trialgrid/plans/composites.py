"""Composite jobs: channel selection, site search, early and late means, transfer summaries, tuning, set work."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialgrid.operators import arrays as ar
from trialgrid.operators import auc, stats
from trialgrid.operators.quantiles import exact_percentiles
from trialgrid.plans.registry import query
from trialgrid.sources.tables import epochs, predictions, trials

_W = "SELECT e.epoch, e.channel, e.cls, s AS smin, list_avg(e.samples[s + 1 : s + 8]) AS x FROM v_epochs e, (SELECT unnest(range(0, 57, 4))::INT AS s)"
_WT = f"""SELECT channel, smin, (m1 - m0) / sqrt(a + b) AS t FROM (SELECT channel, smin, avg(x) FILTER (WHERE cls = 1) AS m1, avg(x) FILTER (WHERE cls = 0) AS m0,
  var_samp(x) FILTER (WHERE cls = 1) / count(*) FILTER (WHERE cls = 1) AS a, var_samp(x) FILTER (WHERE cls = 0) / count(*) FILTER (WHERE cls = 0) AS b FROM ({_W}) GROUP BY channel, smin)"""


@query("SELECT channel, n, mean, t, n - 1 AS df, coalesce(t > 7, false) AS responsive FROM (SELECT channel, count(*)::DOUBLE AS n, avg(x) AS mean, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t FROM (SELECT channel, list_avg(samples[11:64]) - list_avg(samples[1:10]) AS x FROM v_epochs) GROUP BY channel)", ("mean", "t"))
def responsive_channels(spark, d):
    """Channels whose mean after onset is above the mean before it: paired t over trials, accepted above 7."""
    gap = ar.mean(ar.window("samples", F.lit(10), F.lit(64))) - ar.mean(ar.window("samples", F.lit(0), F.lit(10)))
    out = stats.one_sample_t(epochs(spark, d), gap, ["channel"])
    return out.withColumn("responsive", F.coalesce(F.col("t") > 7, F.lit(False)))


@query(f"SELECT channel, smin, t FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY round(abs(t), 9) DESC NULLS LAST, smin) AS k FROM ({_WT})) WHERE k = 1", ("t",))
def best_t_windows(spark, d):
    """Site search: the window with the largest absolute Welch t between classes, the earliest on ties."""
    means = ar.window_means(epochs(spark, d), 8, 4, 0, 64)
    t = stats.welch_t(means, "x", "cls", ["channel", "smin"]).select("channel", "smin", "t")
    return auc.best_row(t, ["channel"], [F.desc_nulls_last(F.round(F.abs("t"), 9)), F.col("smin")])


@query(f"SELECT channel, smin, count(*)::DOUBLE AS n, avg(x) AS mean, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t, count(*)::DOUBLE - 1 AS df FROM ({_W}) GROUP BY channel, smin", ("mean", "t"))
def one_sample_windows(spark, d):
    """t of each window's mean against 0."""
    return stats.one_sample_t(ar.window_means(epochs(spark, d), 8, 4, 0, 64), F.col("x"), ["channel", "smin"])


@query("""SELECT channel, (m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1 / n0 + 1 / n1)) AS t, n0 + n1 - 2 AS df FROM (SELECT channel, count(*) FILTER (WHERE cls = 0)::DOUBLE AS n0, count(*) FILTER (WHERE cls = 1)::DOUBLE AS n1,
  avg(x) FILTER (WHERE cls = 0) AS m0, avg(x) FILTER (WHERE cls = 1) AS m1, var_samp(x) FILTER (WHERE cls = 0) AS v0, var_samp(x) FILTER (WHERE cls = 1) AS v1 FROM (SELECT channel, cls, pos, avg(x) AS x FROM v_samples GROUP BY channel, cls, pos) GROUP BY channel)""", ("t", "df"))
def t_across_samples(spark, d):
    """Student's t between the time samples of two class averages (not between trials)."""
    traces = ar.evoked(epochs(spark, d), ["channel", "cls"]).withColumnRenamed("mean", "x")
    return stats.student_t(traces, "x", "cls", ["channel"])


@query(f"""SELECT e.epoch, e.channel, e.cls, p.smin, list_avg(e.samples[p.smin + 1 : p.smin + 8]) AS early, CASE WHEN p.smin + 20 <= 56 THEN list_avg(e.samples[p.smin + 21 : p.smin + 28]) END AS late, p.t > 0 AS positive
  FROM v_epochs e JOIN (SELECT channel, smin, t FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY round(abs(t), 9) DESC NULLS LAST, smin) AS k FROM ({_WT})) WHERE k = 1) p USING (channel)""", ("early", "late"))
def early_late_means(spark, d):
    """Each trial's mean in its site's best window and in a later one (null if that leaves the signal)."""
    peaks = auc.best_row(stats.welch_t(ar.window_means(epochs(spark, d), 8, 4, 0, 64), "x", "cls", ["channel", "smin"]).select("channel", "smin", "t"), ["channel"], [F.desc_nulls_last(F.round(F.abs("t"), 9)), F.col("smin")])
    rows = epochs(spark, d).join(F.broadcast(peaks), "channel")  # a row per channel
    late = F.when(F.col("smin") + 20 <= 56, ar.mean(ar.window("samples", F.col("smin") + 20, F.col("smin") + 28)))
    return rows.select("epoch", "channel", "cls", "smin", ar.mean(ar.window("samples", F.col("smin"), F.col("smin") + 8)).alias("early"), late.alias("late"), (F.col("t") > 0).alias("positive"))


@query("""SELECT e.epoch, e.channel, s AS "first", s + 8 AS "last", s - ev AS relative FROM (SELECT *, (10 + epoch % 5)::INT AS ev FROM v_epochs) e, (SELECT unnest(range(0, 57, 8))::INT AS k) g, LATERAL (SELECT (e.ev % 8 + g.k)::INT AS s) WHERE s >= 4 AND s + 8 <= least(64, (SELECT quantile_cont(48 + epoch % 10, 0.8) FROM v_epochs))""")
def aligned_window_grid(spark, d):
    """Windows in phase with each trial's event, from a global first sample to the 80th percentile of the trials' ends."""
    rows = epochs(spark, d).withColumn("at", (F.lit(10) + F.col("epoch") % 5).cast("int"))
    cut = exact_percentiles(rows, 48 + F.col("epoch") % 10, [0.8]).select(F.col("percentile").alias("cut"))
    start = F.explode(F.transform(F.sequence(F.lit(0), F.lit(56), F.lit(8)), lambda k: (F.col("at") % 8 + k).cast("int"))).alias("first")
    grid = rows.crossJoin(F.broadcast(cut)).select("epoch", "channel", "at", "cut", start)
    return grid.where((F.col("first") >= 4) & (F.col("first") + 8 <= F.least(F.lit(64.0), F.col("cut")))).select("epoch", "channel", "first", (F.col("first") + 8).alias("last"), (F.col("first") - F.col("at")).alias("relative"))


@query("""SELECT subject, avg(z) AS mean_z, avg(z) / (stddev_samp(z) / sqrt(count(*))) AS t, count(*) AS n FROM (SELECT subject, atanh(least(0.999, greatest(-0.999, corr(step, value)))) AS z FROM v_trials GROUP BY subject, electrode) GROUP BY subject""", ("mean_z", "t"))
def fisher_z(spark, d):
    """Fisher-transformed correlations of sites, their mean and t by subject."""
    z = trials(spark, d).groupBy("subject", "electrode").agg(F.atanh(F.least(F.lit(0.999), F.greatest(F.lit(-0.999), F.corr("step", "value")))).alias("z"))
    return z.groupBy("subject").agg(F.avg("z").alias("mean_z"), (F.avg("z") / (F.stddev_samp("z") / F.sqrt(F.count("z")))).alias("t"), F.count("*").alias("n"))


@query("""SELECT a.electrode, a.pref AS early, b.pref AS late, a.pref = b.pref AS same FROM (SELECT electrode, CASE WHEN avg(value) FILTER (WHERE pair = 'bm') > avg(value) FILTER (WHERE pair = 'dn') THEN 'b' ELSE 'd' END AS pref FROM v_trials WHERE step <= 3 GROUP BY electrode) a
  JOIN (SELECT electrode, CASE WHEN avg(value) FILTER (WHERE pair = 'bm') > avg(value) FILTER (WHERE pair = 'dn') THEN 'b' ELSE 'd' END AS pref FROM v_trials WHERE step > 3 GROUP BY electrode) b USING (electrode)""")
def tuning_comparison(spark, d):
    """A site's preferred pair in two data sets, and whether they agree."""
    mean = lambda p: F.avg(F.when(F.col("pair") == p, F.col("value")))
    # two means that are equal may differ in their last digits, as their sums are taken in any order
    above = lambda a, b: (a > b) & (a - b > F.abs(b) * 1e-12)
    pref = lambda rows, name: rows.groupBy("electrode").agg(F.when(above(mean("bm"), mean("dn")), "b").otherwise("d").alias(name))
    t = trials(spark, d)
    return pref(t.where("step <= 3"), "early").join(pref(t.where("step > 3"), "late"), "electrode").withColumn("same", F.col("early") == F.col("late"))


@query("""SELECT subject, sum(same)::BIGINT AS on_diagonal, (count(*) - sum(same))::BIGINT AS off_diagonal, avg(same) FILTER (WHERE response = 1) AS hit_share, avg(same) FILTER (WHERE response = 0) AS reject_share
  FROM (SELECT subject, response, CAST((step > 3) = (response = 1) AS INT) AS same FROM v_trials) GROUP BY subject""", ("hit_share", "reject_share"))
def congruency(spark, d):
    """Trials whose response follows the stimulus, and the shares among both responses."""
    rows = trials(spark, d).withColumn("same", ((F.col("step") > 3) == (F.col("response") == 1)).cast("int"))
    share = lambda k: F.avg(F.when(F.col("response") == k, F.col("same")))
    return rows.groupBy("subject").agg(F.sum("same").alias("on_diagonal"), (F.count("*") - F.sum("same")).alias("off_diagonal"), share(1).alias("hit_share"), share(0).alias("reject_share"))


@query("""SELECT electrode, source FROM ((SELECT electrode, 'both' AS source FROM (SELECT electrode FROM v_trials WHERE value > 60 INTERSECT SELECT electrode FROM v_trials WHERE value < 1)) UNION ALL (SELECT electrode, 'high only' FROM (SELECT electrode FROM v_trials WHERE value > 60 EXCEPT SELECT electrode FROM v_trials WHERE value < 1)))""")
def key_set_work(spark, d):
    """Keys in both of two sets and in the first only, as one labelled union."""
    t = trials(spark, d)
    high, low = t.where("value > 60").select("electrode").distinct(), t.where("value < 1").select("electrode").distinct()
    return high.intersect(low).withColumn("source", F.lit("both")).unionByName(high.subtract(low).withColumn("source", F.lit("high only")))


@query("""SELECT epoch, channel, k::INT AS k FROM (SELECT e.epoch, e.channel, row_number() OVER (PARTITION BY e.channel ORDER BY round(list_sum([pow(p[1] - p[2], 2) FOR p IN list_zip(e.samples, c.m)]), 9), e.epoch) AS k
  FROM v_epochs e JOIN (SELECT channel, list(mean ORDER BY pos) AS m FROM (SELECT channel, pos, avg(x) AS mean FROM v_samples GROUP BY channel, pos) GROUP BY channel) c USING (channel)) WHERE k <= 3""")
def nearest_to_centroid(spark, d):
    """The three signals nearest to their channel's mean."""
    centre = ar.collected(ar.evoked(epochs(spark, d), ["channel"]), ["channel"], "mean").withColumnRenamed("samples", "m")
    rows = epochs(spark, d).join(F.broadcast(centre), "channel")  # a row per channel
    far = F.round(ar.total(F.zip_with("samples", "m", lambda a, b: (a - b) * (a - b))), 9)
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("channel").orderBy(far, "epoch"))).where("k <= 3").select("epoch", "channel", "k")


@query("SELECT site, word, count(*) AS n, avg(CAST((proba > 0.05) = (target = 1) AS INT)) AS full_accuracy, avg(CAST((baseline_proba > 0.04) = (target = 1) AS INT)) AS baseline_accuracy, min_by(smin, (-proba, epoch, smin)) AS smin_of_top FROM v_predictions GROUP BY site, word", ("full_accuracy", "baseline_accuracy"))
def accuracy_by_word(spark, d):
    """Accuracies of two scores by site and word, and the window of the most certain prediction."""
    hit = lambda c, cut: F.avg(((F.col(c) > cut) == (F.col("target") == 1)).cast("int"))
    return predictions(spark, d).groupBy("site", "word").agg(F.count("*").alias("n"), hit("proba", 0.05).alias("full_accuracy"), hit("baseline_proba", 0.04).alias("baseline_accuracy"), F.min_by("smin", F.struct(-F.col("proba"), "epoch", "smin")).alias("smin_of_top"))
