"""Registered queries of the main library, and DuckDB SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialgrid.functions import features as ft
from trialgrid.operators import arrays as ar
from trialgrid.functions.special import beta_q, binom_p, t_p
from trialgrid.operators import auc, decoders, stats
from trialgrid.operators import relational as rel
from trialgrid.operators.quantiles import percentile_columns
from trialgrid.sources.tables import SQL_VIEWS, epochs, predictions, table, trials

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def sql_order(key: str, seed: str = "0") -> str:
    """``relational.hash_order`` in SQL."""
    x = f"(({key})::BIGINT % {rel.KEY_MODULUS} + {rel.KEY_MODULUS}) % {rel.KEY_MODULUS} + ({seed}) * {rel.SEED_STEP} + 1"
    x = f"((({x}) * ({x})) % {rel.HASH_MODULUS} + {rel.SHIFT}) * {rel.MULTIPLIER} % {rel.HASH_MODULUS}"
    return f"(({x}) * ({x}) % {rel.HASH_MODULUS})"


def query(sql: str | None = None, rounded: tuple[str, ...] = ()):
    """Register a function as a query by its own name; ``rounded`` columns are rounded to 6 digits on both sides, after 12
    digits, so that a tie at the sixth digit doesn't hang on the order of a sum."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.round(F.round(F.col(c), 12), 6) + F.lit(0.0) for c in rounded})

        QUERIES[f.__name__] = run
        if sql:
            outer = ", ".join([f'round(round("{c}", 12), 6) + 0.0 AS "{c}"' for c in rounded])
            body = f"SELECT * REPLACE ({outer}) FROM ({sql})" if rounded else f"SELECT * FROM ({sql})" if sql.lstrip().startswith("WITH") else sql
            SQL[f.__name__] = f"WITH {SQL_VIEWS.strip()} {body}"
        return run

    return put


AUC = """SELECT {key}, count(*) AS n, sum(target)::BIGINT AS n_pos,
  CASE WHEN sum(target) > 0 AND sum(1 - target) > 0 THEN (sum(r * target) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * sum(1 - target)) END AS {name}
  FROM (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY {proba}) + (count(*) OVER (PARTITION BY {key}, {proba}) - 1) / 2.0 AS r FROM v_predictions) GROUP BY {key}"""
FOLD_AUC = AUC.format(key="site, smin, fold", proba="proba", name="auc")
MEANS = f"SELECT site, smin, avg(auc) AS mean_auc, count(auc) AS n_folds FROM ({FOLD_AUC}) GROUP BY site, smin"
PEAKS = f"SELECT site, smin, mean_auc, n_folds FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY mean_auc DESC NULLS LAST, smin) AS k FROM ({MEANS})) WHERE k = 1"
_K4 = "site, word, smin, fold"
GAINS = f"""SELECT f.site, f.word, f.smin, f.fold, f.s AS "full", b.s AS baseline, f.s - b.s AS gain FROM ({AUC.format(key=_K4, proba="proba", name="s")}) f JOIN ({AUC.format(key=_K4, proba="baseline_proba", name="s")}) b USING ({_K4})"""


def _means(spark: SparkSession, d: str) -> DataFrame:
    return auc.fold_means(auc.grouped_auc(predictions(spark, d), "target", "proba", ["site", "smin", "fold"]), "auc", ["site", "smin"])


# predictions to peaks


@query(PEAKS, ("mean_auc",))
def peak_windows(spark, d):
    return auc.peak_windows(predictions(spark, d))


@query(FOLD_AUC, ("auc",))
def grouped_auc(spark, d):
    return auc.grouped_auc(predictions(spark, d), "target", "proba", ["site", "smin", "fold"])


@query(MEANS, ("mean_auc",))
def fold_means(spark, d):
    return _means(spark, d)


@query("SELECT epoch, smin, proba, rank() OVER (PARTITION BY site ORDER BY proba) + (count(*) OVER (PARTITION BY site, proba) - 1) / 2.0 AS average_rank FROM v_predictions", ("average_rank",))
def average_ranks(spark, d):
    return predictions(spark, d).select("epoch", "smin", "proba", auc.average_rank("proba", ["site"]).alias("average_rank"))


@query(GAINS, ("full", "baseline", "gain"))
def compared_auc(spark, d):
    return auc.compared_auc(predictions(spark, d))


@query(f"""SELECT site, word, smin, gain, first_smin FROM (SELECT g.*, p.smin AS first_smin, row_number() OVER (PARTITION BY g.site, g.word ORDER BY round(g.gain, 9) DESC, g.smin) AS k
  FROM (SELECT site, word, smin, avg(gain) AS gain FROM ({GAINS}) GROUP BY site, word, smin) g JOIN ({PEAKS}) p ON g.site = p.site AND g.smin > p.smin + 1
  JOIN (SELECT word, max(smin) - 21 + (word = 'O')::INT AS "end" FROM v_predictions GROUP BY word) e ON g.word = e.word AND g.smin + 1 <= e."end" + 20 WHERE g.gain > 0) WHERE k = 1""", ("gain",))
def later_peaks(spark, d):
    p = predictions(spark, d)
    ends = p.groupBy("word").agg((F.max("smin") - 21 + F.first(F.col("word") == "O").cast("int")).alias("end"))
    return auc.later_peaks(auc.peak_windows(p), auc.compared_auc(p), size=1, ends=ends)


@query(f"SELECT a.site, a.smin, a.mean_auc, max(b.mean_auc) AS best_before FROM ({MEANS}) a LEFT JOIN ({MEANS}) b ON a.site = b.site AND b.smin + 1 < a.smin GROUP BY a.site, a.smin, a.mean_auc", ("mean_auc", "best_before"))
def best_before(spark, d):
    return auc.best_before(_means(spark, d), size=1)


@query(f"SELECT site, \"at\", smin, distance FROM (SELECT m.site, m.site % 7 + 0.5::DOUBLE AS \"at\", smin, abs(smin - (m.site % 7 + 0.5::DOUBLE)) AS distance, row_number() OVER (PARTITION BY m.site ORDER BY abs(smin - (m.site % 7 + 0.5::DOUBLE)), smin) AS k FROM ({MEANS}) m) WHERE k = 1", ("at", "distance"))
def nearest_windows(spark, d):
    means = _means(spark, d)
    return auc.nearest_window(means, means.select("site", (F.col("site") % 7 + F.lit(0.5).cast("double")).alias("at")).distinct())


@query(f"SELECT cut, count(*) FILTER (WHERE peak >= cut) AS n_sites, avg(peak) FILTER (WHERE peak >= cut) AS mean_peak FROM (SELECT site, max(mean_auc) AS peak FROM ({MEANS}) GROUP BY site), (SELECT unnest([0.5::DOUBLE, 0.52::DOUBLE, 0.55::DOUBLE]) AS cut) GROUP BY cut", ("mean_peak",))
def threshold_sweep(spark, d):
    return auc.swept_peaks(_means(spark, d), [0.5, 0.52, 0.55])


@query("""SELECT site, fold, (tp + tn) / (tp + tn + fp + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  (CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2 AS macro_f1, log_loss
  FROM (SELECT site, fold, (count(*) FILTER (WHERE target = 1 AND proba > 0.05))::DOUBLE AS tp, (count(*) FILTER (WHERE target = 0 AND proba > 0.05))::DOUBLE AS fp, (count(*) FILTER (WHERE target = 1 AND proba <= 0.05))::DOUBLE AS fn,
  (count(*) FILTER (WHERE target = 0 AND proba <= 0.05))::DOUBLE AS tn, avg(-ln(CASE WHEN target = 1 THEN greatest(proba, 1e-15) ELSE 1 - greatest(proba, 1e-15) END)) AS log_loss FROM v_predictions GROUP BY site, fold)""", ("accuracy", "precision", "recall", "macro_f1", "log_loss"))
def fold_metrics(spark, d):
    return auc.threshold_metrics(predictions(spark, d), "target", "proba", ["site", "fold"], 0.05)


@query("""SELECT site, proba, sum(p) OVER w / nullif(sum(p) OVER (PARTITION BY site), 0) AS tpr, sum(q) OVER w / nullif(sum(q) OVER (PARTITION BY site), 0) AS fpr
  FROM (SELECT site, proba, sum(target)::DOUBLE AS p, sum(1 - target)::DOUBLE AS q FROM v_predictions GROUP BY site, proba) WINDOW w AS (PARTITION BY site ORDER BY proba DESC)""", ("tpr", "fpr"))
def roc_points(spark, d):
    return auc.roc_points(predictions(spark, d), "target", "proba", ["site"])


@query("""SELECT site, epoch, target, "full", baseline, "full" > 0.05 AS full_decision, baseline > m AS baseline_decision, ("full" > 0.05) <> (baseline > m) AS changed, CAST("full" > 0.05 AS INT) = target AS correct, abs("full" - baseline) AS "update"
  FROM (SELECT *, (SELECT avg(b) FROM (SELECT avg(baseline_proba) AS b FROM v_predictions GROUP BY site, epoch)) AS m FROM (SELECT site, epoch, max(target) AS target, avg(proba) AS "full", avg(baseline_proba) AS baseline FROM v_predictions GROUP BY site, epoch))""", ("full", "baseline", "update"))
def trial_ensembles(spark, d):
    return auc.trial_ensemble(predictions(spark, d), 0.05)


# trials


_CUES = """SELECT *, CASE WHEN linear_cue > 0 THEN 1 ELSE -1 END AS category_cue FROM (
    SELECT t.*, s.lo, s.hi, (step - mid) / nullif((hi - lo)::DOUBLE, 0) * 2 AS linear_cue, 2 * lexical - 1 AS lexical_cue, pair[1] AS a, pair[2] AS b,
      CASE WHEN "left" <> pair[1] THEN -1 ELSE 1 END AS response_sign, CASE WHEN "left" <> pair[1] THEN -1 ELSE 1 END * (slider - 5.5) / 4.5 AS linear_response
    FROM v_trials t JOIN (SELECT subject, min(step) AS lo, max(step) AS hi, avg(DISTINCT step) AS mid FROM v_trials GROUP BY subject) s USING (subject))"""
_MARKS = f"""SELECT *, CASE WHEN category_cue <> lexical_cue THEN 1 ELSE -1 END AS mismatch, (lexical_cue - linear_cue) / 2 AS belief_update, trunc((lexical_cue - linear_cue) / 2 * 5)::INT AS belief_level,
  CASE WHEN category_cue < 0 THEN a ELSE b END AS heard, CASE WHEN lexical_cue < 0 THEN a ELSE b END AS meant, sign(linear_response)::INT AS forced_response, CASE WHEN slider IN (5, 6) THEN 0 ELSE sign(linear_response)::INT END AS dummy_response,
  -1 + (least(greatest(ceil((linear_response + 1) / (2.0 / 6) - 1e-9), 1), 6) - 0.5) * (2.0 / 6) AS response_bin,
  (step - lo) / nullif((hi - lo)::DOUBLE, 0) * (max(linear_response) OVER (PARTITION BY subject) - min(linear_response) OVER (PARTITION BY subject)) + min(linear_response) OVER (PARTITION BY subject) AS rescaled_step FROM ({_CUES})"""
FEATURES = f"""SELECT subject, epoch, step, pair, linear_cue, category_cue, lexical_cue, (2.5 - abs(step - 3.5)) / 2 AS ambiguity, mismatch, linear_response, belief_update, dummy_response, forced_response, rescaled_step,
  forced_response = category_cue AS follows_acoustics, CASE WHEN mismatch = 1 THEN lexical_cue ELSE 0 END AS directed_mismatch, belief_level, response_sign,
  CASE WHEN abs(belief_level) >= 4 THEN 5 WHEN abs(belief_level) >= 1 THEN 2 ELSE 0 END::DOUBLE * sign(belief_level) AS coarse_update,
  CASE WHEN abs(belief_level) >= 4 THEN 5 * sign(belief_level) WHEN abs(belief_level) = 3 THEN 2 * sign(belief_level) END::DOUBLE AS coarse_mismatch,
  pair || CASE WHEN mismatch = 1 THEN ' mismatch' ELSE ' match' END AS stratum, heard, meant, heard || '→' || meant AS inference, response_bin, (forced_response > 0)::INT AS forced_dummy,
  linear_response - rescaled_step AS response_shift, response_bin - rescaled_step AS bin_shift, CASE dummy_response WHEN -1 THEN a WHEN 1 THEN b ELSE '~' END AS response_label, CASE forced_response WHEN -1 THEN a WHEN 1 THEN b END AS forced_label,
  meant = heard AND meant <> CASE dummy_response WHEN -1 THEN a WHEN 1 THEN b ELSE '~' END AS ignores_both, 'L' || meant || 'B' || CASE dummy_response WHEN -1 THEN a WHEN 1 THEN b ELSE '~' END AS meant_answered,
  'A' || heard AS heard_mark, 'B' || CASE dummy_response WHEN -1 THEN a WHEN 1 THEN b ELSE '~' END AS answer_mark, dummy_response * category_cue AS answer_by_acoustics, dummy_response * lexical_cue AS answer_by_lexical,
  dummy_response * CASE WHEN mismatch = 1 THEN lexical_cue ELSE 0 END AS answer_by_mismatch FROM ({_MARKS})"""
_FEATURE_COLUMNS = """subject epoch step pair linear_cue category_cue lexical_cue ambiguity mismatch linear_response belief_update dummy_response forced_response rescaled_step follows_acoustics directed_mismatch
  belief_level response_sign coarse_update coarse_mismatch stratum heard meant inference response_bin forced_dummy response_shift bin_shift response_label forced_label ignores_both meant_answered heard_mark answer_mark
  answer_by_acoustics answer_by_lexical answer_by_mismatch""".split()


@query(FEATURES, ("linear_cue", "ambiguity", "linear_response", "belief_update", "rescaled_step", "coarse_update", "coarse_mismatch", "response_bin", "response_shift", "bin_shift"))
def trial_features(spark, d):
    return ft.trial_features(trials(spark, d)).select(*_FEATURE_COLUMNS)


@query(f"""SELECT subject, pair, min(CASE WHEN s <> p THEN place - 1 END)::INT AS crossing, CASE WHEN round(sum(t), 9) < 0 THEN -1 ELSE 1 END AS side FROM (
  SELECT *, row_number() OVER w AS place, sign(m) AS s, sign(lag(m) OVER w) AS p FROM (SELECT subject, pair, step, sum(linear_response) AS t, round(avg(linear_response), 9) AS m FROM ({FEATURES}) WHERE mismatch = -1 GROUP BY subject, pair, step) WINDOW w AS (PARTITION BY subject, pair ORDER BY step)) GROUP BY subject, pair""")
def zero_crossings(spark, d):
    return ft.zero_crossings(ft.trial_features(trials(spark, d)))


@query("""SELECT epoch, linear_response, -1 + (least(greatest(ceil((linear_response + 1) / (2.0 / 6) - 1e-9), 1), 6) - 0.5) * (2.0 / 6) AS bin_centre, CASE WHEN dummy < 0 THEN pair[1] WHEN dummy > 0 THEN pair[2] ELSE '~' END AS label
  FROM (SELECT epoch, pair, s * (slider - 5.5) / 4.5 AS linear_response, CASE WHEN slider IN (5, 6) THEN 0 ELSE s * sign(slider - 5.5) END AS dummy FROM (SELECT *, CASE WHEN "left" <> pair[1] THEN -1 ELSE 1 END AS s FROM v_trials))""", ("linear_response", "bin_centre"))
def response_bins(spark, d):
    return ft.trial_features(trials(spark, d)).select("epoch", "linear_response", F.col("response_bin").alias("bin_centre"), F.col("response_label").alias("label"))


@query("SELECT subject, pair, word, list_sort(list(step)) AS steps FROM (SELECT subject, pair, word, step FROM v_trials WHERE step NOT IN (1, 6) GROUP BY subject, pair, word, step HAVING least(sum(response), sum(1 - response)) > 2) GROUP BY subject, pair, word")
def ambiguous_steps(spark, d):
    return rel.ambiguous_steps(trials(spark, d))


@query("""SELECT g.subject, g.step, coalesce(k, 0) AS k, coalesce(k, 0) / sum(coalesce(k, 0)) OVER (PARTITION BY g.subject) AS share
  FROM (SELECT DISTINCT s.subject, t.step FROM v_trials s, (SELECT DISTINCT step FROM v_trials) t) g LEFT JOIN (SELECT subject, step, count(*) AS k FROM v_trials GROUP BY subject, step) c ON g.subject = c.subject AND g.step = c.step""", ("share",))
def level_proportions(spark, d):
    return rel.proportions(trials(spark, d), ["subject"], "step")


CONTINGENCY = """SELECT *, observed - expected AS residual, observed / sum(observed) OVER (PARTITION BY pair) AS row_share FROM (SELECT pair, response, count(*)::DOUBLE AS observed,
  (sum(count(*)) OVER (PARTITION BY pair) * sum(count(*)) OVER (PARTITION BY response))::DOUBLE / sum(count(*)) OVER () AS expected FROM (SELECT CASE WHEN pair = 'bm' THEN 'x' ELSE 'y' END AS pair, step % 2 AS response FROM v_trials) GROUP BY pair, response)"""


def _contingency(spark: SparkSession, d: str) -> DataFrame:
    rows = trials(spark, d).select(F.when(F.col("pair") == "bm", "x").otherwise("y").alias("pair"), (F.col("step") % 2).alias("response"))
    return stats.contingency(rows, "pair", "response")


@query(CONTINGENCY, ("expected", "residual", "row_share"))
def contingency(spark, d):
    return _contingency(spark, d)


@query(f"SELECT sum(pow(abs(residual) - least(0.5, abs(residual)), 2) / expected) AS chi2, 1::BIGINT AS df FROM ({CONTINGENCY})", ("chi2",))
def chi_squared(spark, d):
    return stats.chi_squared(_contingency(spark, d), "pair", "response")


_CLASS = """SELECT electrode, (count(*) FILTER (WHERE response = 0))::DOUBLE AS n0, (count(*) FILTER (WHERE response = 1))::DOUBLE AS n1, avg(value) FILTER (WHERE response = 0) AS m0, avg(value) FILTER (WHERE response = 1) AS m1,
  var_samp(value) FILTER (WHERE response = 0) AS v0, var_samp(value) FILTER (WHERE response = 1) AS v1 FROM v_trials GROUP BY electrode"""


@query(f"""SELECT electrode, n0, n1, CASE WHEN fine THEN (m1 - m0) / sqrt(a + b) END AS t, CASE WHEN fine THEN (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1)) END AS df
  FROM (SELECT *, n0 >= 3 AND n1 >= 3 AND a + b > 0 AS fine FROM (SELECT *, v1 / n1 AS a, v0 / n0 AS b FROM ({_CLASS})))""", ("t", "df"))
def welch_t(spark, d):
    return stats.welch_t(trials(spark, d), "value", "response", ["electrode"], 3)


@query(f"""SELECT electrode, CASE WHEN n0 >= 2 AND n1 >= 2 AND p > 0 THEN (m1 - m0) / sqrt(p * (1 / n0 + 1 / n1)) END AS t, CASE WHEN n0 >= 2 AND n1 >= 2 AND p > 0 THEN n0 + n1 - 2 END AS df
  FROM (SELECT *, ((n0 - 1) * v0 + (n1 - 1) * v1) / nullif(n0 + n1 - 2, 0) AS p FROM ({_CLASS}))""", ("t", "df"))
def student_t(spark, d):
    return stats.student_t(trials(spark, d), "value", "response", ["electrode"])


@query(f"SELECT electrode, sign(round(m1 - m0, 9))::DOUBLE AS polarity, (m1 - m0) / nullif(sqrt((v1 + v0) / 2), 0) AS d_prime, sqrt(v0) AS sd0, sqrt(v1) AS sd1 FROM ({_CLASS})", ("polarity", "d_prime", "sd0", "sd1"))
def polarity(spark, d):
    return stats.polarity(trials(spark, d), "value", "response", ["electrode"])


@query("SELECT site, count(*)::DOUBLE AS n, avg(x) AS mean, CASE WHEN count(*) > 1 AND stddev_samp(x) > 0 THEN avg(x) / (stddev_samp(x) / sqrt(count(*))) END AS t, count(*)::DOUBLE - 1 AS df FROM (SELECT site, proba - baseline_proba AS x FROM v_predictions) GROUP BY site", ("mean", "t"))
def paired_t(spark, d):
    return stats.one_sample_t(predictions(spark, d), F.col("proba") - F.col("baseline_proba"), ["site"])


@query("""SELECT electrode, n, pearson, spearman, CASE WHEN abs(spearman) < 1 AND n > 2 THEN spearman * sqrt((n - 2) / (1 - spearman * spearman)) END AS t FROM (
  SELECT electrode, count(*) AS n, CASE WHEN var_pop(step) > 1e-12 AND var_pop(value) > 1e-12 THEN corr(step, value) END AS pearson, CASE WHEN var_pop(a) > 1e-12 AND var_pop(b) > 1e-12 THEN corr(a, b) END AS spearman FROM (
  SELECT electrode, step, value, rank() OVER (PARTITION BY electrode ORDER BY step) + (count(*) OVER (PARTITION BY electrode, step) - 1) / 2.0 AS a, rank() OVER (PARTITION BY electrode ORDER BY value) + (count(*) OVER (PARTITION BY electrode, value) - 1) / 2.0 AS b FROM v_trials) GROUP BY electrode)""", ("pearson", "spearman", "t"))
def rank_correlations(spark, d):
    return stats.correlations(trials(spark, d), "step", "value", ["electrode"])


_SUBJECT_STEP = "SELECT subject, step, avg(value) AS v FROM v_trials GROUP BY subject, step"


@query(f"SELECT x.subject AS a, y.subject AS b, count(*) AS n, corr(x.v, y.v) AS r FROM ({_SUBJECT_STEP}) x JOIN ({_SUBJECT_STEP}) y ON x.step = y.step AND x.subject < y.subject GROUP BY x.subject, y.subject", ("r",))
def pairwise_pearson(spark, d):
    return stats.pairwise_pearson(trials(spark, d).groupBy("subject", "step").agg(F.avg("value").alias("v")), "subject", "step", "v")


# permutations: a target at a hashed place of its site stands in for a shuffled one
_PERM = f"""SELECT site, permutation, avg(CASE WHEN t = 1 THEN proba END) - avg(CASE WHEN t = 0 THEN proba END) AS gap FROM (
  SELECT p.site, q.permutation, p.proba, CAST({sql_order("p.epoch", "q.permutation * 97 + p.smin")} < {rel.HASH_MODULUS // 3} AS INT) AS t FROM v_predictions p, (SELECT unnest(range(20)) AS permutation) q) GROUP BY site, permutation"""
_TRUE = "SELECT site, avg(CASE WHEN target = 1 THEN proba END) - avg(CASE WHEN target = 0 THEN proba END) AS gap FROM v_predictions GROUP BY site"
_P = f"SELECT t.site, round(t.gap, 9) AS gap, (count(*) FILTER (WHERE round(p.gap, 9) >= round(t.gap, 9)) + 1) / 21.0 AS p FROM ({_TRUE}) t LEFT JOIN ({_PERM}) p ON t.site = p.site GROUP BY t.site, t.gap"


def _permutation(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d)
    gap = lambda t: F.round(F.avg(F.when(t == 1, F.col("proba"))) - F.avg(F.when(t == 0, F.col("proba"))), 9)
    true = rows.groupBy("site").agg(gap(F.col("target")).alias("gap"))
    # dealt before they are copied: a task has few sites' sums to keep, and a large site is several tasks
    dealt = rows.select("site", "epoch", "smin", "proba").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("site"), F.pmod("epoch", F.lit(4)))
    copies = dealt.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(19))))
    label = (rel.hash_order("epoch", F.col("permutation") * 97 + F.col("smin")) < rel.HASH_MODULUS // 3).cast("int")
    permuted = copies.withColumn("t", label).groupBy("site", "permutation").agg(gap(F.col("t")).alias("gap"))  # summed before it is shuffled
    return stats.permutation_p(true, permuted, ["site"], "gap")


@query(_P, ("gap", "p"))
def permutation_p(spark, d):
    return _permutation(spark, d)


@query(f"SELECT site, gap, p, least(1.0, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q, p * m AS bonferroni, least(1.0, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) < 0.05 AS significant FROM (SELECT *, row_number() OVER (ORDER BY p, site) AS r, count(*) OVER () AS m FROM ({_P}))", ("gap", "p", "q", "bonferroni"))
def false_discovery(spark, d):
    return stats.false_discovery(_permutation(spark, d), "p", ["site"])


@query("SELECT site, CASE WHEN 1 - e / t >= 0 THEN 1 - e / t END AS r2 FROM (SELECT l_suppkey AS site, sum(pow(l_extendedprice - l_quantity * 1500, 2)) AS e, var_pop(l_extendedprice) * count(*) AS t FROM lineitem GROUP BY l_suppkey)", ("r2",))
def r_squared(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("site"), "l_extendedprice", (F.col("l_quantity") * 1500).alias("fit"))
    return stats.r_squared(rows, "l_extendedprice", "fit", ["site"])


# signals

WINDOWS = "SELECT e.epoch, e.channel, e.cls, s AS smin, least({high}, s + {size}) AS smax, list_avg(e.samples[s + 1 : least({high}, s + {size})]) AS x FROM v_epochs e, (SELECT unnest(range({low}, {end}, {stride}))::INT AS s)"


@query(WINDOWS.format(high=64, size=15, low=1, end=64 - 15 + 1, stride=2), ("x",))
def window_means(spark, d):
    return ar.window_means(epochs(spark, d), 15, 2, 1, 64)


@query(WINDOWS.format(high=64, size=15, low=0, end=64, stride=10), ("x",))
def ragged_window_means(spark, d):
    return ar.window_means(epochs(spark, d), 15, 10, 0, 64, ragged=True)


@query("SELECT epoch, channel, list_max([abs(x - list_avg(samples[1:10])) FOR x IN samples[11:64]]) AS largest FROM v_epochs", ("largest",))
def baseline_and_crop(spark, d):
    rows = epochs(spark, d).withColumn("samples", ar.baseline_corrected("samples", 0, 10))
    return rows.select("epoch", "channel", F.array_max(F.transform(ar.window("samples", F.lit(10), F.lit(64)), F.abs)).alias("largest"))


@query("SELECT channel, pos, avg(x) AS mean, stddev_samp(x) / sqrt(count(*)) AS sem, count(*) AS n FROM v_samples GROUP BY channel, pos", ("mean", "sem"))
def evoked_average(spark, d):
    return ar.evoked(epochs(spark, d), ["channel"])


@query("SELECT channel, pos, avg(x) FILTER (WHERE cls = 1) - avg(x) FILTER (WHERE cls = 0) AS contrast FROM v_samples GROUP BY channel, pos", ("contrast",))
def condition_contrast(spark, d):
    return ar.contrast(epochs(spark, d), "cls", ["channel"])


@query("SELECT pos, avg(c) AS mean, stddev_pop(c) / sqrt(count(*)) AS sem FROM (SELECT channel, pos, (1 - channel) * (avg(x) FILTER (WHERE cls = 1) - avg(x) FILTER (WHERE cls = 0)) AS c FROM v_samples GROUP BY channel, pos) GROUP BY pos", ("mean", "sem"))
def signed_trace(spark, d):
    rows = ar.contrast(epochs(spark, d), "cls", ["channel"]).withColumn("polarity", 1 - F.col("channel"))
    return ar.signed_trace(rows, [], "polarity")


@query("SELECT epoch, channel, cls, [samples[i + epoch % 20 + 1] FOR i IN range(30)] AS samples FROM v_epochs")
def realigned_signals(spark, d):
    return epochs(spark, d).withColumn("samples", ar.realigned("samples", F.col("epoch") % 20, 30))


@query("""WITH t AS (SELECT *, (5 + epoch % 80)::INT AS "event" FROM v_epochs), k AS (SELECT * FROM t WHERE "event" < len(samples)), n AS (SELECT max(len(samples) - ("event" - 20)) AS n FROM k WHERE "event" > 20)
  SELECT epoch, channel, cls, "event", [CASE WHEN i + "event" - 20 >= 0 THEN samples[i + "event" - 20 + 1] END FOR i IN range(len(samples))][1 : coalesce(n, len(samples))] AS samples FROM k, n""")
def event_aligned_signals(spark, d):
    """Signals with their event at sample 20; events behind the signal go."""
    return ar.aligned_to_event(epochs(spark, d).withColumn("event", (5 + F.col("epoch") % 80).cast("int")), "event", 20)


@query("SELECT epoch, channel, cls, samples[p - 4 : p + 6] AS samples, p::INT AS peak FROM (SELECT *, list_position(samples, list_max(samples)) - 1 AS p FROM v_epochs) WHERE p >= 5 AND p + 5 < len(samples)")
def peak_aligned_signals(spark, d):
    return ar.aligned_to_peak(epochs(spark, d), 5)


@query("SELECT s.epoch, s.channel, s.pos, greatest(-3, least(3, (s.x - m) / sd)) AS z FROM v_samples s JOIN (SELECT channel, avg(x) AS m, stddev_pop(x) AS sd FROM v_samples GROUP BY channel) c USING (channel)", ("z",))
def channel_zscores(spark, d):
    return ar.zscored(epochs(spark, d), "channel").select("epoch", "channel", F.posexplode("samples").alias("pos", "z"))


@query("SELECT s.epoch, s.channel, s.pos, (s.x - lo) / (hi - lo) AS scaled FROM v_samples s JOIN (SELECT channel, min(x) AS lo, max(x) AS hi FROM v_samples GROUP BY channel) c USING (channel)", ("scaled",))
def jointly_scaled_signals(spark, d):
    return ar.jointly_scaled(epochs(spark, d), ["channel"]).select("epoch", "channel", F.posexplode("samples").alias("pos", "scaled"))


@query("SELECT epoch // 3 AS trial, flatten(list(samples[6:10] ORDER BY epoch % 3)) AS vector FROM v_epochs GROUP BY epoch // 3")
def flattened_channels(spark, d):
    rows = epochs(spark, d).withColumn("trial", F.floor(F.col("epoch") / 3)).withColumn("place", F.col("epoch") % 3)
    return ar.flattened(rows, ["trial"], "place", 5, 10)


@query("SELECT s.epoch, s.pos, s.x FROM v_samples s WHERE s.channel NOT IN (SELECT channel FROM v_epochs WHERE list_max(samples) > 0.45)", ("x",))
def clean_channels(spark, d):
    marked = epochs(spark, d).withColumn("samples", F.transform("samples", lambda x: F.when(x <= 0.45, x)))
    return ar.without_bad_channels(marked, "channel").select("epoch", F.posexplode("samples").alias("pos", "x"))


_DAILY = "SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY user_id, CAST(ts AS DATE)"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))


@query(f"""SELECT user_id, min(day) AS start, max(day) AS stop, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY day) AS run FROM (
  SELECT *, CASE WHEN (v > 60) <> coalesce(lag(v > 60) OVER (PARTITION BY user_id ORDER BY day), false) THEN 1 ELSE 0 END AS c FROM ({_DAILY}))) WHERE v > 60 GROUP BY user_id, run""")
def runs_above(spark, d):
    return ar.runs_above(_daily(spark, d), ["user_id"], "day", "v", 60.0)


@query(f"""SELECT user_id, day, smooth FROM (SELECT user_id, day, avg(v) OVER w AS smooth, count(v) OVER w AS k, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM ({_DAILY}) WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE k = 3 AND (i - 1) % 3 = 0""", ("smooth",))
def smoothed_series(spark, d):
    return ar.smoothed(_daily(spark, d), ["user_id"], "day", "v")


# relational work

@query("SELECT subject, step, epoch FROM (SELECT *, row_number() OVER (PARTITION BY subject, step ORDER BY " + sql_order("epoch", "7") + ", epoch) AS k FROM v_trials) WHERE k <= 5")
def stratified_sample(spark, d):
    return rel.sampled(trials(spark, d), ["subject", "step"], "epoch", 5, 7).select("subject", "step", "epoch")


@query(f"""SELECT epoch, response, seed, k <= floor(n * 0.8 + 0.5) AS train FROM (SELECT epoch, response, seed, row_number() OVER (PARTITION BY seed, response ORDER BY {sql_order("epoch", "seed")}, epoch) AS k, count(*) OVER (PARTITION BY seed, response) AS n
  FROM v_trials, (SELECT unnest([0, 1])::INT AS seed))""")
def stratified_split(spark, d):
    return rel.split(trials(spark, d).select("epoch", "response"), ["response"], "epoch", seeds=(0, 1))


@query(f"""SELECT a.subject, a.draw, b.epoch FROM (SELECT subject, n, unnest(range(w)) AS draw FROM (SELECT subject, count(*) AS n, 2 * count(*) - 3 AS w FROM v_trials WHERE response = 1 GROUP BY subject)) a
  JOIN (SELECT subject, epoch, row_number() OVER (PARTITION BY subject ORDER BY {sql_order("epoch", "1")}, epoch) - 1 AS i FROM v_trials WHERE response = 1) b ON a.subject = b.subject AND a.draw % a.n = b.i""")
def matched_sample(spark, d):
    rows = trials(spark, d).where("response = 1")
    wanted = rows.groupBy("subject").agg((2 * F.count("*") - 3).alias("k"))
    return rel.matched_sample(rows.select("subject", "epoch"), wanted, ["subject"], "epoch", 1).select("subject", "draw", "epoch")


@query("""WITH t AS (SELECT subject, step, epoch, row_number() OVER (PARTITION BY subject, step ORDER BY epoch) AS place FROM v_trials)
  SELECT a.subject, a.step, a.place::INT AS place, a.epoch, b.epoch AS partner FROM t a JOIN t b ON b.subject = a.subject + 1 AND a.step = b.step AND a.place = b.place""")
def paired_populations(spark, d):
    """Each subject's trials paired with the next subject's by step and place."""
    t = trials(spark, d)
    a, b = t.select("subject", "step", "epoch"), t.select((F.col("subject") - 1).alias("subject"), "step", F.col("epoch").alias("partner"))
    return rel.paired(a, b, ["subject", "step"], ["epoch"], ["partner"])


@query("""SELECT subject, step, a, b, a - b AS gap FROM (SELECT subject, step, avg(value) FILTER (WHERE pair = 'bm') AS a, avg(value) FILTER (WHERE pair = 'dn') AS b FROM v_trials GROUP BY subject, step) WHERE a IS NOT NULL AND b IS NOT NULL""", ("a", "b", "gap"))
def pivot_gaps(spark, d):
    return rel.pivot_gap(trials(spark, d), ["subject", "step"], "pair", ("bm", "dn"), "value")


@query("SELECT pair, avg(gap) AS mean_gap, max(gap) AS max_gap FROM (SELECT t.pair, t.value - r.v AS gap FROM v_trials t JOIN (SELECT subject, avg(value) AS v FROM v_trials WHERE step = 1 GROUP BY subject) r USING (subject) WHERE step <> 1) GROUP BY pair", ("mean_gap", "max_gap"))
def reference_gaps(spark, d):
    return rel.from_reference(trials(spark, d), ["subject"], "pair", F.col("step") == 1, "value")


@query("SELECT s_suppkey, coalesce(f.fixed, n.n_name) AS n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN (SELECT n_nationkey AS s_nationkey, 'fixed ' || n_name AS fixed FROM nation WHERE n_regionkey = 2) f ON s.s_nationkey = f.s_nationkey")
def recoded_keys(spark, d):
    n = table(spark, d, "nation")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(n.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    fixes = n.where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"), F.concat(F.lit("fixed "), "n_name").alias("fixed"))
    return rel.recoded(rows, ["s_nationkey"], fixes, "n_name").select("s_suppkey", "n_name")


@query("""SELECT epoch, bin, (c[bin + 1] + c[bin + 2]) / 2 AS mid FROM (SELECT epoch, c, greatest(0, len(list_filter(c, lambda x: x < value)) - 1)::INT AS bin FROM v_trials, (SELECT list_sort(list_distinct(quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]))) AS c FROM v_trials))""", ("mid",))
def quantile_bins(spark, d):
    return rel.quantile_bins(trials(spark, d), "value", 4).select("epoch", "bin", "mid")


@query("SELECT epoch, greatest(least(ceil((value - lo) / ((hi - lo) / 5)) - 1, 4), 0)::INT AS bin FROM v_trials, (SELECT min(value) AS lo, max(value) AS hi FROM v_trials)")
def equal_bins(spark, d):
    return rel.equal_bins(trials(spark, d), "value", 5).select("epoch", "bin")


@query("SELECT subject, quantile_cont(value, 0.8) AS p80, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM v_trials GROUP BY subject", ("p80", "q1", "q2", "q3"))
def percentiles(spark, d):
    return percentile_columns(trials(spark, d), "value", {"p80": 0.8, "q1": 0.25, "q2": 0.5, "q3": 0.75}, ["subject"])


@query("SELECT electrode, pair, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, stddev_samp(value) / sqrt(count(*)) AS sem, bool_or(response = 1) AS any_response, max(step) AS last_step FROM v_trials GROUP BY electrode, pair HAVING count(*) >= 3", ("mean", "sd", "sem"))
def group_summaries(spark, d):
    return trials(spark, d).groupBy("electrode", "pair").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("sem"), F.bool_or(F.col("response") == 1).alias("any_response"), F.max("step").alias("last_step")).where("n >= 3")


@query("""SELECT subject, count(*) AS n_sites, count(*) FILTER (WHERE up) AS n_up, avg(top) AS mean_top FROM (SELECT subject, electrode, bool_or(value > 50) AS up, max(value) AS top FROM v_trials GROUP BY subject, electrode) GROUP BY subject""", ("mean_top",))
def two_level_counts(spark, d):
    site = trials(spark, d).groupBy("subject", "electrode").agg(F.bool_or(F.col("value") > 50).alias("up"), F.max("value").alias("top"))
    return site.groupBy("subject").agg(F.count("*").alias("n_sites"), F.count_if("up").alias("n_up"), F.avg("top").alias("mean_top"))


@query("SELECT electrode, pair, k FROM (SELECT electrode, pair, count(*) AS k, row_number() OVER (PARTITION BY electrode ORDER BY count(*) DESC, pair) AS r FROM v_trials GROUP BY electrode, pair) WHERE r = 1")
def most_frequent_level(spark, d):
    counts = trials(spark, d).groupBy("electrode", "pair").agg(F.count("*").alias("k"))
    return auc.best_row(counts, ["electrode"], [F.desc("k"), F.col("pair")])


@query("SELECT bm, dn, pb, count(*) AS n FROM (SELECT electrode, bool_or(pair = 'bm') AS bm, bool_or(pair = 'dn') AS dn, bool_or(pair = 'pb') AS pb FROM v_trials GROUP BY electrode) GROUP BY bm, dn, pb")
def presence_patterns(spark, d):
    seen = trials(spark, d).groupBy("electrode").agg(*[F.bool_or(F.col("pair") == p).alias(p) for p in ("bm", "dn", "pb")])
    return seen.groupBy("bm", "dn", "pb").agg(F.count("*").alias("n"))


@query("SELECT site, word, smin, fold, count(*) AS n_rows FROM v_predictions GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, d):
    return rel.unique_key_report(predictions(spark, d), ["site", "word", "smin", "fold"])


@query("SELECT word, fold, count(*) AS n_rows FROM v_predictions GROUP BY word, fold HAVING count(*) > 1")
def repeated_keys_of_all(spark, d):
    return rel.unique_key_report(predictions(spark, d), ["word", "fold"])


@query("""SELECT rule, n_broken, n_broken = 0 AS passed FROM (SELECT 'step_range' AS rule, count(*) FILTER (WHERE step NOT BETWEEN 1 AND 6) AS n_broken FROM v_trials UNION ALL SELECT 'slider_range', count(*) FILTER (WHERE slider NOT BETWEEN 1 AND 10) FROM v_trials
  UNION ALL SELECT 'binary_response', count(*) FILTER (WHERE response NOT IN (0, 1)) FROM v_trials UNION ALL SELECT 'small_value', count(*) FILTER (WHERE NOT coalesce(value < 50, false)) FROM v_trials)""")
def quality_rules(spark, d):
    rules: dict[str, Column] = {"step_range": F.col("step").between(1, 6), "slider_range": F.col("slider").between(1, 10), "binary_response": F.col("response").isin(0, 1), "small_value": F.col("value") < 50}
    return rel.quality_report(trials(spark, d), rules)


@query("SELECT site, word, fold, kind, value FROM (UNPIVOT (SELECT site, word, fold, avg(proba) AS \"full\", avg(baseline_proba) AS baseline FROM v_predictions GROUP BY site, word, fold) ON \"full\", baseline INTO NAME kind VALUE value)", ("value",))
def unpivoted_scores(spark, d):
    wide = predictions(spark, d).groupBy("site", "word", "fold").agg(F.avg("proba").alias("full"), F.avg("baseline_proba").alias("baseline"))
    return wide.unpivot(["site", "word", "fold"], ["full", "baseline"], "kind", "value")


@query("SELECT coalesce(a.subject, b.subject) AS subject, a.n AS n_early, b.n AS n_late, coalesce(a.label, 'none') AS label FROM (SELECT electrode AS subject, count(*) AS n, 'early' AS label FROM v_trials WHERE step <= 2 AND value > 40 GROUP BY electrode) a FULL JOIN (SELECT electrode AS subject, count(*) AS n FROM v_trials WHERE step >= 5 AND value > 40 GROUP BY electrode) b ON a.subject = b.subject")
def full_outer_sites(spark, d):
    t = trials(spark, d).where("value > 40")
    a = t.where("step <= 2").groupBy(F.col("electrode").alias("subject")).agg(F.count("*").alias("n_early"), F.lit("early").alias("label"))
    b = t.where("step >= 5").groupBy(F.col("electrode").alias("subject")).agg(F.count("*").alias("n_late"))
    return a.join(b, "subject", "full").select("subject", "n_early", "n_late", F.coalesce("label", F.lit("none")).alias("label"))


@query("SELECT s_suppkey, s_nationkey, EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal > 9900) AS has_rich FROM supplier s")
def semi_and_anti(spark, d):
    s, c = table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("s_nationkey"))
    return s.join(c, "s_nationkey", "left_semi").withColumn("has_rich", F.lit(True)).unionByName(s.join(c, "s_nationkey", "left_anti").withColumn("has_rich", F.lit(False)))


@query("""SELECT a.site, a.smin AS first, b.smin AS second FROM (SELECT DISTINCT site, smin FROM v_predictions WHERE proba > 0.09 AND fold = 0) a JOIN (SELECT DISTINCT site, smin FROM v_predictions WHERE proba > 0.09 AND fold = 1) b ON a.site = b.site AND a.smin + 2 <= b.smin""")
def interval_precedence(spark, d):
    p = predictions(spark, d).where("proba > 0.09")
    a = p.where("fold = 0").select("site", F.col("smin").alias("first")).distinct()
    b = p.where("fold = 1").select("site", F.col("smin").alias("second")).distinct()
    return a.join(b, (a["site"] == b["site"]) & (a["first"] + 2 <= b["second"])).select(a["site"], "first", "second")


@query("""SELECT electrode, kind FROM (SELECT electrode, unnest(['early', 'late']) AS kind, bool_or(value > 70) AS hi, bool_or(value < 2) AS lo FROM v_trials GROUP BY electrode) WHERE (kind = 'early' AND hi) OR (kind = 'late' AND lo)""")
def exploded_flags(spark, d):
    flags = trials(spark, d).groupBy("electrode").agg(F.bool_or(F.col("value") > 70).alias("hi"), F.bool_or(F.col("value") < 2).alias("lo"))
    kinds = F.array(F.when(F.col("hi"), F.lit("early")), F.when(F.col("lo"), F.lit("late")))
    return flags.select("electrode", F.explode(F.array_compact(kinds)).alias("kind"))


@query("SELECT site, smin, epoch, proba FROM v_predictions ORDER BY proba DESC, epoch, smin LIMIT 50")
def top_predictions(spark, d):
    return predictions(spark, d).select("site", "smin", "epoch", "proba").orderBy(F.desc("proba"), "epoch", "smin").limit(50)


@query("SELECT subject, epoch, value, side FROM (SELECT *, 'head' AS side, row_number() OVER (PARTITION BY subject ORDER BY value DESC, epoch) AS k FROM v_trials UNION ALL SELECT *, 'tail', row_number() OVER (PARTITION BY subject ORDER BY value, epoch) FROM v_trials) WHERE k <= 3")
def heads_and_tails(spark, d):
    t = trials(spark, d)
    pick = lambda order, side: t.withColumn("k", F.row_number().over(Window.partitionBy("subject").orderBy(order, "epoch"))).where("k <= 3").select("subject", "epoch", "value", F.lit(side).alias("side"))
    return pick(F.desc("value"), "head").union(pick(F.col("value"), "tail"))


# many small models; no SQL can fit them, tests check gradients, held-out scores and hand-worked cases


#: Vectors of a session of a channel: a fit stays at some hundred trials, whatever the table's size.
SESSION = 900
_SITE = ["channel", "session"]


def _windows(spark: SparkSession, d: str) -> DataFrame:
    sessions = epochs(spark, d).withColumn("session", F.floor(F.col("epoch") / SESSION))
    rows = decoders.decoding_inputs(sessions, "cls", 16, 16, 0, 64, [*_SITE, "epoch"])
    return decoders.folds(rows, [*_SITE, "smin"], "epoch", 4)


@query()
def decoding_searchlight(spark, d):
    return decoders.cross_validated(_windows(spark, d), [*_SITE, "smin"], "epoch")


@query()
def decoding_scores(spark, d):
    return auc.grouped_auc(decoders.cross_validated(_windows(spark, d), [*_SITE, "smin"], "epoch"), "y", "proba", [*_SITE, "smin", "fold"])


@query()
def model_table(spark, d):
    return decoders.fitted_models(_windows(spark, d), [*_SITE, "smin"])


@query()
def window_transfer(spark, d):
    rows = _windows(spark, d)
    return decoders.transferred(rows, decoders.fitted_models(rows, [*_SITE, "smin"]), _SITE, "epoch", F.col("smin") == 0, F.col("smin") == 32)


@query()
def permuted_decoding(spark, d):
    rows = _windows(spark, d)
    true = decoders.cross_validated(rows, [*_SITE, "smin"], "epoch")
    peaks = auc.peak_windows(true.select(F.struct(*_SITE).alias("site"), "smin", "fold", F.col("y").alias("target"), "proba")).select("site.*", "smin")
    fits = true.select(*_SITE, "smin", "fold", "c").distinct()
    at_peaks = rows.join(peaks, [*_SITE, "smin"], "left_semi").join(fits, [*_SITE, "smin", "fold"], "left")
    return decoders.cross_validated(decoders.permuted(at_peaks, [*_SITE, "smin"], "epoch", 20), [*_SITE, "smin", "permutation"], "epoch", given="c")


@query()
def lagged_response_model(spark, d):
    signal = epochs(spark, d).select("epoch", "channel", F.posexplode("samples").alias("pos", "v"))
    events = epochs(spark, d).select("epoch", F.lit(10).alias("at"), F.lit(1.0).alias("onset"), F.col("cls").cast("double").alias("cls"))
    return decoders.lagged_ridge(events, signal, "epoch", ["onset", "cls"], [0, 1, 2, 3], 1.0)


@query()
def clustered_signals(spark, d):
    return decoders.clustered(epochs(spark, d), "samples", 6, 8).select("epoch", "channel", "cluster")


@query()
def warped_distances(spark, d):
    rows = ar.collected(ar.evoked(epochs(spark, d).withColumn("site", F.col("epoch") % 25), ["site"]), ["site"], "mean")
    a, b = rows.select(F.col("site").alias("s"), F.col("samples").alias("a")), rows.select(F.col("site").alias("t"), F.col("samples").alias("b"))
    return ar.warped_distances(a.join(b, F.col("s") < F.col("t")))


@query()
def resampled_signals(spark, d):
    return ar.resampled(epochs(spark, d), 32)


@query()
def welch_p_values(spark, d):
    rows = stats.welch_t(trials(spark, d), "value", "response", ["electrode"], 3)
    return rows.withColumn("p", t_p("t", "df")).withColumn("stars", ft.stars(F.col("p")))


@query()
def chance_thresholds(spark, d):
    n = predictions(spark, d).groupBy("site").agg(F.sum("target").cast("double").alias("n_pos"), F.sum(1 - F.col("target")).cast("double").alias("n_neg"))
    return n.withColumn("upper", beta_q(F.lit(0.95), F.col("n_pos"), F.col("n_neg"))).withColumn("p_majority", binom_p(F.greatest("n_pos", "n_neg"), F.col("n_pos") + F.col("n_neg")))
