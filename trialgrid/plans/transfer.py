"""Compositions of stored models over the signals' windows, transfer summaries, weights by channel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialgrid.operators import composition as co
from trialgrid.operators import decoders
from trialgrid.operators.auc import grouped_auc
from trialgrid.plans.comparison import SITE, _signals
from trialgrid.plans.registry import query
from trialgrid.sources.storage import stored
from trialgrid.sources.tables import epochs

SIZE, EARLY, LATE = 16, 0, 32
#: Fixed axes for models made of moments: cosines over a window.
AXES = [[round(math.cos(math.pi * (i + 0.5) * k / SIZE), 6) for i in range(SIZE)] for k in range(4)]
FOLDS = 3


# models of moments: a scaler from means and deviations, fixed axes, class means as the classifier; all of it is SQL


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """epoch, channel, smin, x, y of both windows."""
    return decoders.decoding_inputs(epochs(spark, d), "cls", SIZE, LATE - EARLY, EARLY, LATE + SIZE, ["channel", "epoch"])


def _moments(rows: DataFrame) -> DataFrame:
    """channel, smin, center, scale, pca, coef: a feature's mean and deviation, and how far the classes' means are apart on each axis."""
    long = rows.select("channel", "smin", "y", F.posexplode("x").alias("i", "v")).groupBy("channel", "smin", "i")
    sums = long.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.avg(F.when(F.col("y") == 1, F.col("v"))).alias("m1"), F.avg(F.when(F.col("y") == 0, F.col("v"))).alias("m0"))
    flat = sums.groupBy("channel", "smin").agg(F.array_sort(F.collect_list(F.struct("i", "m", "s", ((F.col("m1") - F.col("m0")) / F.col("s")).alias("gap")))).alias("f"))
    axes = F.array(*[F.array(*map(F.lit, a)) for a in AXES])
    gap = F.transform("f", lambda r: r["gap"])
    return flat.select("channel", "smin", F.transform("f", lambda r: r["m"]).alias("center"), F.transform("f", lambda r: r["s"]).alias("scale"), axes.alias("pca"), co.projected(gap, axes).alias("coef"))


_AXIS = " UNION ALL ".join(f"SELECT {k} AS k, {i} AS i, {v}::DOUBLE AS a" for k, axis in enumerate(AXES) for i, v in enumerate(axis))
_MOMENTS = f"""axis AS ({_AXIS}), w AS (SELECT unnest([{EARLY}, {LATE}]) AS smin), v AS (SELECT channel, epoch, cls, smin, pos - smin AS i, x FROM v_samples, w WHERE pos >= smin AND pos < smin + {SIZE}),
  mom AS (SELECT channel, smin, i, avg(x) AS m, stddev_pop(x) AS s, (avg(x) FILTER (WHERE cls = 1) - avg(x) FILTER (WHERE cls = 0)) / stddev_pop(x) AS gap FROM v GROUP BY channel, smin, i),
  coef AS (SELECT channel, smin, k, sum(a * gap) AS c FROM mom JOIN axis USING (i) GROUP BY channel, smin, k)"""
_SETS = f"""{_MOMENTS}, part AS (SELECT channel, epoch, cls, smin, k, sum(a * (x - m) / s) AS p FROM v JOIN mom USING (channel, smin, i) JOIN axis USING (i) GROUP BY channel, epoch, cls, smin, k),
  scored AS (SELECT p.channel, epoch, cls AS y, CASE p.smin WHEN {EARLY} THEN 'early' ELSE 'late' END AS data_window, CASE c.smin WHEN {EARLY} THEN 'early' ELSE 'late' END AS model_window, 1 / (1 + exp(-sum(p * c))) AS proba FROM part p JOIN coef c ON p.channel = c.channel AND p.k = c.k GROUP BY ALL)"""


def _sets(spark: SparkSession, d: str) -> DataFrame:
    rows = _windows(spark, d)
    return co.transfer_sets(rows, _moments(rows), ["channel"], EARLY, LATE)


@query(f"WITH {_SETS} SELECT channel, epoch, y, data_window, model_window, proba FROM scored", ("proba",))
def transfer_sets(spark, d):
    """The four sets of two windows: each window's data, own scaler, under the axes and classifier of each window."""
    return _sets(spark, d).select("channel", "epoch", "y", "data_window", "model_window", "proba")


_SUMMARY = f"""WITH {_SETS}, r AS (SELECT *, rank() OVER (PARTITION BY channel, data_window, model_window ORDER BY round(proba, 9)) + (count(*) OVER (PARTITION BY channel, data_window, model_window, round(proba, 9)) - 1) / 2.0 AS r FROM scored),
  a AS (SELECT channel, data_window AS d, model_window AS m, (sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM r GROUP BY ALL),
  p AS (SELECT channel, max(auc) FILTER (WHERE m = 'early' AND d = 'early') AS ee, max(auc) FILTER (WHERE m = 'early' AND d = 'late') AS el, max(auc) FILTER (WHERE m = 'late' AND d = 'early') AS le, max(auc) FILTER (WHERE m = 'late' AND d = 'late') AS ll FROM a GROUP BY channel)
  SELECT channel, ee AS early_early_auc, el AS early_late_auc, le AS late_early_auc, ll AS late_late_auc, ee AS early_auc, ll AS late_auc, el / ll AS early_to_late, le / ee AS late_to_early, ee - le AS early_effect FROM p"""
_SCORES = ("early_early_auc", "early_late_auc", "late_early_auc", "late_late_auc", "early_auc", "late_auc", "early_to_late", "late_to_early", "early_effect")


@query(_SUMMARY, _SCORES)
def transfer_summary(spark, d):
    """AUC of the four sets, what the transfer keeps of the own decoder's AUC, and its effect."""
    return co.transfer_summary(_sets(spark, d).withColumn("proba", F.round("proba", 9)), ["channel"])


@query(f"""WITH {_MOMENTS} SELECT channel, epoch, cls AS y, 1 / (1 + exp(-sum(c * p))) AS proba FROM (SELECT v.channel, epoch, cls, k, sum(a * (x - m) / s) AS p FROM v JOIN mom ON v.channel = mom.channel AND v.smin = mom.smin AND v.i = mom.i JOIN axis ON axis.i = v.i WHERE v.smin = {EARLY} GROUP BY v.channel, epoch, cls, k)
  JOIN (SELECT channel AS ch, k AS kk, c FROM coef WHERE smin = {LATE}) ON ch = channel AND kk = k GROUP BY channel, epoch, cls""", ("proba",))
def composed_models(spark, d):
    """The early window's scaler, and the late window's axes and classifier behind two zeroed baseline features."""
    rows = _windows(spark, d)
    models = _moments(rows)
    late = models.where(F.col("smin") == LATE).withColumn("coef", F.concat(F.array(F.lit(3.0), F.lit(-2.0)), "coef"))
    out = co.behaviour_on_phonetic(rows.where(F.col("smin") == EARLY), models.where(F.col("smin") == EARLY), late, ["channel"], 2)
    return out.select("channel", "epoch", "y", "proba")


@query(f"WITH {_MOMENTS} SELECT channel, smin, i // 4 AS part, i % 4 AS place, sum(a * c) AS weight FROM coef JOIN axis USING (k) GROUP BY channel, smin, i", ("weight",))
def weights_by_part(spark, d):
    """Classifier weights taken back through the axes and split into four channels of four samples."""
    models = co.back_projected(_moments(_windows(spark, d)).withColumnRenamed("channel", "site"))
    parts = co.split_weights(models, ["site", "smin"], 4)
    return parts.select(F.col("site").alias("channel"), "smin", F.col("channel").alias("part"), "place", "weight")


@query(f"WITH {_MOMENTS} SELECT channel, smin, ['mean', 'slope'][k // 2 + 1] AS feature, (k % 2)::INT AS lag, c AS coef FROM coef", ("coef",))
def coefficient_table(spark, d):
    """Coefficients by feature and lag."""
    return co.coefficient_table(_moments(_windows(spark, d)), ["channel", "smin"], "coef", ["mean", "slope"], 2)


# fitted models, by session


def _behaviour(rows: DataFrame) -> DataFrame:
    """Signals with the behaviour (a stand-in: the class, but for every fifth trial) and the word, from the id."""
    flipped = (F.pmod("epoch", F.lit(5)) == 0).cast("int")
    return rows.withColumn("behaviour", F.pmod(F.col("y") + flipped, F.lit(2)).cast("int")).withColumn("word", F.when(F.pmod(F.floor(F.col("epoch") / 3), F.lit(2)) == 0, "a").otherwise("b"))


def _fitted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Vectors of both windows with their folds, phonetic models, behavioural models of each word, keys of a model."""
    rows = _behaviour(_signals(spark, d))
    x = decoders.decoding_inputs(rows, "y", SIZE, LATE - EARLY, EARLY, LATE + SIZE, [*SITE, "epoch", "cue", "behaviour", "word"])
    by = Window.partitionBy(*SITE, "smin", "y", "behaviour").orderBy("epoch")
    x = stored(x.withColumn("fold", ((F.row_number().over(by) - 1) % FOLDS).cast("int")))
    phonetic = stored(decoders.fitted_models(x.where(F.col("smin") == EARLY), [*SITE, "smin"]))
    late = x.where(F.col("smin") == LATE).withColumn("y", F.col("behaviour"))
    behavioural = stored(co.models_with_baseline(late, [*SITE, "word", "smin"], ["cue"]))
    return x, phonetic, behavioural, late


@query()
def behaviour_on_phonetic_window(spark, d):
    """Behavioural decoders on the phonetic window against the acoustic class, beside the phonetic decoder's own AUC."""
    x, phonetic, behavioural, _ = _fitted(spark, d)
    key = [*SITE, "word", "fold"]
    early = x.where(F.col("smin") == EARLY).drop("smin")
    scaler = phonetic.drop("smin").join(behavioural.select(*key), [*SITE, "fold"])  # for each word's models
    out = co.behaviour_on_phonetic(early, scaler, behavioural, key, 1)
    own = co.composed(early, [*SITE, "fold"], phonetic, phonetic, phonetic)
    score = lambda rows, name: grouped_auc(rows.select(*key, F.col("y").alias("target"), "proba"), "target", "proba", key).select(*key, F.col("auc").alias(name))
    return score(out, "transfer_auc").join(score(own, "own_auc"), key).withColumn("kept", F.try_divide("transfer_auc", "own_auc"))


@query()
def phonetic_on_behaviour_window(spark, d):
    """Phonetic decoders on the behavioural window against the behaviour, by word."""
    x, phonetic, behavioural, late = _fitted(spark, d)
    key = [*SITE, "word", "fold"]
    models = phonetic.drop("smin").join(behavioural.select(*key), [*SITE, "fold"])
    out = co.phonetic_on_behaviour(late.drop("smin"), models, behavioural, key)
    return grouped_auc(out.select(*key, F.col("y").alias("target"), "proba"), "target", "proba", key)


@query()
def whole_pipeline_transfer(spark, d):
    """The late behavioural decoder, unchanged, on the early window and on its own: AUC of both and the difference."""
    x, _, behavioural, late = _fitted(spark, d)
    key = [*SITE, "word", "fold"]
    models = behavioural.drop("smin")
    early = x.where(F.col("smin") == EARLY).withColumn("y", F.col("behaviour")).drop("smin")
    score = lambda rows, name: grouped_auc(co.whole_pipeline(rows, models, key, ["cue"]).select(*key, F.col("y").alias("target"), "proba"), "target", "proba", key).select(*key, F.col("auc").alias(name))
    return score(early, "early_auc").join(score(late.drop("smin"), "late_auc"), key).withColumn("gain", F.col("early_auc") - F.col("late_auc"))


@query()
def ensemble_predictions(spark, d):
    """Every trial of the late window under all models of its session and word: the probability of the mean log odds."""
    _, _, behavioural, late = _fitted(spark, d)
    models = behavioural.drop("smin").withColumnRenamed("fold", "model")
    rows = late.drop("smin", "fold").join(models.select(*SITE, "word", "model"), [*SITE, "word"])
    scored = co.whole_pipeline(rows, models, [*SITE, "word", "model"], ["cue"])
    return co.ensemble(scored, [*SITE, "word", "epoch"])
