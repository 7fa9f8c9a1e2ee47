"""Peak tables, predictions at peaks, polarities, window comparisons, neurometric curves, populations of sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.operators import arrays as ar
from trialgrid.operators import auc, decoders
from trialgrid.operators import comparison as cm
from trialgrid.operators import derived as dv
from trialgrid.operators import geometry as ge
from trialgrid.operators import neurometrics as ne
from trialgrid.operators import phases as ph
from trialgrid.operators import regression as rg
from trialgrid.operators import relational as rel
from trialgrid.operators.quantiles import correlation
from trialgrid.plans.comparison import SITE, _signals, _windows
from trialgrid.plans.registry import GAINS, MEANS, _means, query
from trialgrid.sources.storage import stored
from trialgrid.sources.tables import predictions, table, trials

# peaks: windows of one sample; the word O ends at 5, the word F at 6

_ENDS = "(SELECT site, max(CASE word WHEN 'O' THEN 5 ELSE 6 END) AS \"end\" FROM v_predictions GROUP BY site)"
_EARLY = f"""SELECT site, smin, mean_auc FROM (SELECT m.site, m.smin, m.mean_auc, row_number() OVER (PARTITION BY m.site ORDER BY round(m.mean_auc, 9) DESC, m.smin) AS k FROM ({MEANS}) m JOIN {_ENDS} e ON m.site = e.site AND m.smin + 1 <= e."end" WHERE m.smin >= 2 AND round(m.mean_auc, 9) >= 0.5) WHERE k = 1"""
_LATE = f"""SELECT site, word, smin, gain FROM (SELECT *, row_number() OVER (PARTITION BY site, word ORDER BY round(gain, 9) DESC, smin) AS k FROM (SELECT site, word, smin, avg(gain) AS gain FROM ({GAINS}) GROUP BY site, word, smin) WHERE round(gain, 9) > 0) WHERE k = 1"""


def _early(spark: SparkSession, d: str) -> DataFrame:
    means = _means(spark, d).select("site", "smin", (F.col("smin") + 1).alias("smax"), F.round("mean_auc", 9).alias("mean_auc"))
    ends = predictions(spark, d).select("site", F.when(F.col("word") == "O", 5).otherwise(6).alias("end"))
    return ne.bounded_peaks(means, ends, ["site"], ["site"], "mean_auc", 2, 0.5).select("site", "smin", "mean_auc")


def _late(spark: SparkSession, d: str) -> DataFrame:
    gains = auc.compared_auc(predictions(spark, d)).groupBy("site", "word", "smin").agg(F.round(F.avg("gain"), 9).alias("gain")).where("gain > 0")
    return auc.best_row(gains, ["site", "word"], [F.desc("gain"), F.col("smin")])


@query(_EARLY, ("mean_auc",))
def bounded_peaks(spark, d):
    """The early peak with its bounds: not before the second sample, over before the latest word end, at least 0.5."""
    return _early(spark, d)


_MD = "(SELECT o_orderkey AS epoch, o_orderpriority AS priority FROM orders)"
_PEAK_TABLES = f"""WITH p AS ({_EARLY}), b AS ({_LATE})
  SELECT 'early_early' AS "table", p.site, p.smin, v.word, v.epoch, v.fold, v.proba AS score, m.priority FROM p LEFT JOIN v_predictions v ON p.site = v.site AND p.smin = v.smin LEFT JOIN {_MD} m ON m.epoch = v.epoch
  UNION ALL SELECT 'late_early', b.site, b.smin, v.word, v.epoch, v.fold, v.proba, m.priority FROM b JOIN v_predictions v ON b.site = v.site AND b.smin = v.smin AND b.word = v.word LEFT JOIN {_MD} m ON m.epoch = v.epoch
  UNION ALL SELECT 'early_late', p.site, p.smin, v.word, v.epoch, v.fold, v.baseline_proba, NULL FROM p LEFT JOIN v_predictions v ON p.site = v.site AND p.smin = v.smin
  UNION ALL SELECT 'late_late', b.site, b.smin, b.word, v.epoch, v.fold, v.baseline_proba, NULL FROM b LEFT JOIN v_predictions v ON b.site = v.site AND b.smin = v.smin AND b.word = v.word"""


@query(_PEAK_TABLES)
def predictions_at_peaks(spark, d):
    """The four tables of predictions in peak windows: early and late peaks with either kind of prediction."""
    early, late, pred = _early(spark, d).select("site", "smin"), _late(spark, d).select("site", "word", "smin"), predictions(spark, d)
    phon, behav = pred.select("site", "smin", "word", "epoch", "fold", F.col("proba").alias("score")), pred.select("site", "smin", "word", "epoch", "fold", F.col("baseline_proba").alias("score"))
    md = table(spark, d, "orders").select(F.col("o_orderkey").alias("epoch"), F.col("o_orderpriority").alias("priority"))
    tables = {
        "early_early": ne.at_peaks(early, phon, ["site", "smin"], md, ["epoch"]), "late_early": ne.at_peaks(late, phon, ["site", "smin"], md, ["epoch"], "word"),
        "early_late": ne.at_peaks(early, behav, ["site", "smin"]), "late_late": ne.at_peaks(late, behav, ["site", "word", "smin"]),
    }
    return dv.labelled_union(tables, "table").select("table", "site", "smin", "word", "epoch", "fold", "score", "priority")


@query(f"SELECT p.site, b.word, p.smin AS early_smin, b.smin AS late_smin, p.mean_auc, b.gain FROM ({_EARLY}) p JOIN ({_LATE}) b ON p.site = b.site", ("mean_auc", "gain"))
def peak_pairs(spark, d):
    """Sites with an early and a late peak."""
    early, late = _early(spark, d).withColumnRenamed("smin", "early_smin"), _late(spark, d).withColumnRenamed("smin", "late_smin")
    return early.join(late, "site").select("site", "word", "early_smin", "late_smin", "mean_auc", "gain")


_K = "subject, pair"
_REG = f"""WITH t AS (SELECT *, (step > 3)::INT AS target, value AS early, slider AS late FROM v_trials),
  s AS (SELECT {_K}, list(step::INT ORDER BY step) AS steps FROM (SELECT {_K}, step, count(*) FILTER (WHERE response = 1) AS y, count(*) FILTER (WHERE response = 0) AS n FROM v_trials WHERE step NOT IN (1, 6) GROUP BY ALL) WHERE least(y, n) > 2 GROUP BY ALL),
  l AS (SELECT t.*, list_contains(steps, step::INT) AS is_ambiguous FROM t LEFT JOIN s USING ({_K})),
  e AS (SELECT {_K}, sign(avg(early) FILTER (WHERE target = 1) - avg(early) FILTER (WHERE target = 0))::INT AS early_polarity FROM t WHERE step IN (1, 6) AND target = response GROUP BY ALL HAVING early_polarity IS NOT NULL),
  f AS (SELECT {_K}, sign(avg(late) FILTER (WHERE response = 1) - avg(late) FILTER (WHERE response = 0))::INT AS late_polarity FROM l WHERE is_ambiguous GROUP BY ALL HAVING late_polarity IS NOT NULL)
  SELECT subject, pair, epoch, is_ambiguous, early_polarity, late_polarity, early * early_polarity AS early_signed, late * late_polarity AS late_signed FROM l JOIN e USING ({_K}) JOIN f USING ({_K})"""


@query(_REG, ("early_signed", "late_signed"))
def regression_table(spark, d):
    """Trials with the polarity of the early value between acoustic targets and of the late one between choices."""
    t = trials(spark, d).withColumn("target", (F.col("step") > 3).cast("int")).withColumn("early", F.col("value")).withColumn("late", F.col("slider"))
    steps = rel.ambiguous_steps(t, 2, ("subject", "pair"))
    out = ne.regression_table(t, steps, ["subject", "pair"], "early", "late", "step", "target", "response", F.col("target") == F.col("response"))
    return out.select("subject", "pair", "epoch", "is_ambiguous", "early_polarity", "late_polarity", "early_signed", "late_signed")


_CASES = f"(SELECT site % 10 AS subject, site, avg(gain) FILTER (WHERE smin <= 3) AS early, avg(gain) FILTER (WHERE smin >= 5) AS late FROM ({GAINS}) GROUP BY site)"
_TESTED = "count(*) AS n, avg(early) AS early, avg(late) AS late, avg(gap) AS gap, stddev_samp(gap) / sqrt(count(*)) AS sem, CASE WHEN stddev_samp(gap) / sqrt(count(*)) > 1e-12 THEN avg(gap) / (stddev_samp(gap) / sqrt(count(*))) END AS t"


@query(f"""WITH c AS (SELECT *, late - early AS gap FROM {_CASES} WHERE early IS NOT NULL AND late IS NOT NULL), s AS (SELECT subject, {_TESTED} FROM c GROUP BY subject) SELECT * FROM s UNION ALL SELECT NULL, {_TESTED} FROM s HAVING count(*) > 0""", ("early", "late", "gap", "sem", "t"))
def window_comparison(spark, d):
    """Gains in early and in late windows by subject, and the subjects' differences tested against 0."""
    gains = auc.compared_auc(predictions(spark, d)).withColumn("subject", F.col("site") % 10)
    return ne.window_comparison(gains, {"early": F.col("smin") <= 3, "late": F.col("smin") >= 5}, "subject", ["site"], "gain")


@query("""SELECT electrode, step, n, mean, sem, slope FROM (SELECT electrode, step, count(value) AS n, avg(value) AS mean, stddev_samp(value) / sqrt(count(value)) AS sem FROM v_trials GROUP BY electrode, step) JOIN (SELECT electrode, CASE WHEN var_pop(step) > 1e-12 THEN covar_pop(step, value) / var_pop(step) END AS slope FROM v_trials GROUP BY electrode) USING (electrode)""", ("mean", "sem", "slope"))
def neurometric_curves(spark, d):
    """Mean output by step and site, with the site's slope."""
    return ne.curves(trials(spark, d), ["electrode"], "step", "value")


# populations: four parts of a window stand in for the sites of a session


def _sites(spark: SparkSession, d: str) -> DataFrame:
    """A row a trial and site: session, epoch, y, site, x."""
    rows = _signals(spark, d)
    parts = F.posexplode(F.array(*[ar.window("samples", F.lit(k * 16), F.lit(k * 16 + 16)) for k in range(4)])).alias("site", "x")
    return rows.select(*SITE, "epoch", "y", parts)


def _scored(rows: DataFrame, group: list[str]) -> DataFrame:
    """AUC of held-out predictions by group."""
    held = decoders.cross_validated(decoders.folds(rows, group, "epoch", 4), group, "epoch")
    return auc.grouped_auc(held.select(*group, F.col("y").alias("target"), "proba"), "target", "proba", group).select(*group, "auc")


@query()
def population_decoding(spark, d):
    """Populations of a session's sites against the best single one of them: two regions, all sites, sites that decode by
    themselves, and sites by the correlation of their mean with the class."""
    rows = stored(_sites(spark, d))
    single = stored(_scored(rows, [*SITE, "site"]))
    tuned = rows.groupBy(*SITE, "site").agg(correlation(ar.mean("x"), "y").alias("r"))
    named = lambda t, name: t.select(F.lit(name).alias("population"), *SITE, "site")
    members = [
        named(single.where("site < 2"), "first half"), named(single.where("site >= 2"), "second half"), named(single, "all"),
        named(single.where("auc > 0.5"), "decoding"), named(tuned.where("abs(r) >= 0.05"), "correlated"), named(tuned.where("abs(r) < 0.05"), "uncorrelated"),
    ]
    members = reduce(DataFrame.unionByName, members)
    vectors = ne.population_vectors(rows, members, "population", SITE, "site", "epoch", "x", ["y"])
    best = members.join(single, [*SITE, "site"]).groupBy("population", *SITE).agg(F.count("*").alias("n_sites"), F.max("auc").alias("best_site_auc"))
    return _scored(vectors, ["population", *SITE]).join(best, ["population", *SITE]).withColumn("gain", F.col("auc") - F.col("best_site_auc"))


@query()
def behaviour_from_mean(spark, d):
    """The class from one number, a window's mean, by session and window; sessions with fewer than 10 trials of a class are left out."""
    rows = _windows(_signals(spark, d)).withColumn("x", F.array(ar.mean("x")))
    group = [*SITE, "smin"]
    enough = rows.groupBy(*group).agg(F.least(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).alias("n")).where("n >= 10")
    return _scored(rows.join(enough.select(*group), group, "left_semi"), group)


@query()
def two_targets(spark, d):
    """Two targets from one design and the same folds: R2 of either and the difference."""
    rows = ph.dealt_folds(_signals(spark, d), SITE, ["y", "cue"], "epoch", 4, "outer").withColumn("inner", F.col("epoch") % 2)
    design = rows.select(*SITE, "epoch", "outer", F.col("inner").cast("int").alias("inner"), rg.terms_of_array("x", "samples").alias("terms"))
    targets = F.explode(F.array(F.struct(F.lit("class").alias("target"), F.col("y").cast("double").alias("v")), F.struct(F.lit("cue").alias("target"), F.col("cue").cast("double").alias("v")))).alias("t")
    fits = rg.nested_ridge(design, rows.select(*SITE, "epoch", targets).select(*SITE, "epoch", "t.*"), SITE, "epoch", ["target"], "v", [10.0**k for k in range(0, 6)])
    pick = lambda t: F.max(F.when(F.col("target") == t, F.col("r2")))
    return fits.groupBy(*SITE, "outer").agg(pick("class").alias("class_r2"), pick("cue").alias("cue_r2")).withColumn("gap", F.col("class_r2") - F.col("cue_r2"))


@query()
def chosen_settings(spark, d):
    """The penalties that the comparison's search chose by session and window: their mean logarithm and how often a bound was hit."""
    group = [*SITE, "smin"]
    scores = cm.paired_scores(cm.compared(_windows(_signals(spark, d)), group, "epoch", ["cue"]), group)
    return ge.best_settings(scores, group, "full_c", (cm.FULL_C[0], cm.FULL_C[-1]))
