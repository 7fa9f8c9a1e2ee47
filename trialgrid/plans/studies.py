"""Checks of the design, studies of sites, cluster memberships and the relation of early and late preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.functions.special import binom_p
from trialgrid.operators import auc, stats
from trialgrid.operators import studies as st
from trialgrid.plans.registry import AUC, query
from trialgrid.sources.tables import predictions, table, trials

CUES = ["linear_cue", "category_cue", "lexical_cue", "mismatch", "belief_update"]
#: Seconds at which the sounds of a pair part, as a table in the code.
PARTING = """
bm, 0.12
dn, 0.21
pb, 0.08
"""

_CUES = """SELECT *, CASE WHEN category_cue <> lexical_cue THEN 1 ELSE -1 END AS mismatch, (lexical_cue - linear_cue) / 2 AS belief_update FROM (SELECT pair, linear_cue, CASE WHEN linear_cue > 0 THEN 1 ELSE -1 END AS category_cue, 2 * lexical - 1 AS lexical_cue
  FROM (SELECT t.pair, t.lexical, (t.step - s.mid) / s.span * 2 AS linear_cue FROM v_trials t, (SELECT sum(DISTINCT step) / count(DISTINCT step) AS mid, (max(step) - min(step))::DOUBLE AS span FROM v_trials) s))"""
_SCOPES = " UNION ALL ".join(
    f"SELECT '{scope}' AS scope, {pair} AS pair, '{c}' AS cue, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, avg({c}) AS mean FROM c {end}"
    for c in CUES for scope, pair, end in (("all", "NULL", ""), ("group", "pair", "GROUP BY pair"))
)


def _cues(spark: SparkSession, d: str) -> DataFrame:
    rows = trials(spark, d)
    span = rows.agg((F.sum_distinct("step") / F.count_distinct("step")).alias("_mid"), (F.max("step") - F.min("step")).cast("double").alias("_span"))
    rows = rows.crossJoin(F.broadcast(span))  # one row
    rows = rows.withColumn("linear_cue", (F.col("step") - F.col("_mid")) / F.col("_span") * 2).withColumn("category_cue", F.when(F.col("linear_cue") > 0, 1).otherwise(-1)).withColumn("lexical_cue", 2 * F.col("lexical") - 1)
    return rows.withColumn("mismatch", F.when(F.col("category_cue") != F.col("lexical_cue"), 1).otherwise(-1)).withColumn("belief_update", (F.col("lexical_cue") - F.col("linear_cue")) / 2)


@query(f"WITH c AS ({_CUES}) SELECT *, abs(low + 1) <= 1e-6 AND abs(high - 1) <= 1e-6 AS spans, abs(mean) <= 1e-6 AS balanced FROM ({_SCOPES})", ("low", "high", "mean"))
def cue_balance(spark, d):
    """Range and mean of each cue over all trials and by pair, and whether they are as the design wants them."""
    return st.balance_report(_cues(spark, d), CUES, "pair")


@query("""SELECT electrode, pair, len(s)::INT AS n_levels, list_max(s) AS highest, list_filter(range(1, list_max(s) + 1), lambda x: NOT list_contains(s, x)) AS missing, len(list_filter(range(1, list_max(s) + 1), lambda x: NOT list_contains(s, x))) = 0 AND list_min(s) = 1 AS contiguous
  FROM (SELECT electrode, pair, list(DISTINCT step) AS s FROM v_trials WHERE step IS NOT NULL GROUP BY electrode, pair)""")
def step_levels(spark, d):
    """Which steps up to the highest a site's trials of a pair lack."""
    return st.level_report(trials(spark, d), ["electrode", "pair"], "step")


@query("""SELECT t.epoch, t.pair, p.parting, '/' || t.word || '_' || t.step || '.TextGrid' AS grid_path FROM v_trials t JOIN (VALUES ('bm', 0.12::DOUBLE), ('dn', 0.21), ('pb', 0.08)) p(pair, parting) ON t.pair = p.pair""", ("parting",))
def parting_times(spark, d):
    """Trials with the time at which their pair's sounds part, and the annotation file beside each recording."""
    times = F.broadcast(st.literal_table(spark, PARTING, "pair string, parting double"))  # three rows
    rows = trials(spark, d).join(times, "pair").withColumn("root", F.concat(F.lit("/audio/"), F.col("subject").cast("string")))
    path = F.concat("root", F.lit("/"), "word", F.lit("_"), F.col("step").cast("string"), F.lit(".wav"))
    return rows.select("epoch", "pair", "parting", st.sibling_path(path, F.col("root"), (".wav", ".TextGrid")).alias("grid_path"))


@query("""SELECT epoch, a AS acoustic_label, l AS lexical_label, a || '→' || l || ' (' || response || ')' AS arrow FROM (SELECT epoch, response, CASE WHEN step > 3 THEN 'n' ELSE 'd' END AS a, CASE WHEN lexical = 1 THEN 'necessary' ELSE 'desolate' END AS l FROM v_trials)""")
def code_labels(spark, d):
    """Codes of 1 and -1 as labels, and all of them with the response as one arrow label."""
    rows = trials(spark, d).select("epoch", F.col("response").cast("string").alias("response"), F.when(F.col("step") > 3, 1).otherwise(-1).alias("acoustic"), (2 * F.col("lexical") - 1).alias("lexical"))
    out = st.code_labels(rows, {"acoustic": {-1: "d", 1: "n"}, "lexical": {-1: "desolate", 1: "necessary"}}, "arrow", "response")
    return out.select("epoch", "acoustic_label", "lexical_label", "arrow")


_POSITIONS = "(SELECT c_nationkey AS subject, c_custkey AS site, c_custkey // 25 AS position FROM customer)"


@query(f"SELECT p.subject, p.site, p.position, n.n_channels FROM {_POSITIONS} p JOIN (SELECT s_nationkey AS subject, count(*) AS n_channels FROM supplier GROUP BY s_nationkey) n USING (subject) WHERE p.position < n.n_channels")
def sites_with_data(spark, d):
    """Sites whose position is below the number of channels that their subject has data for."""
    items = table(spark, d, "customer").select(F.col("c_nationkey").alias("subject"), F.col("c_custkey").alias("site"), F.floor(F.col("c_custkey") / 25).alias("position"))
    sizes = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("subject")).agg(F.count("*").alias("n_channels"))
    return st.with_data(items, sizes, "subject", "position").select("subject", "site", "position", "n_channels")


@query("""SELECT subject, list_sort(list(t)) AS tables, count(*) = 3 AS complete FROM (SELECT DISTINCT user_id AS subject, 'trials' AS t FROM events UNION ALL SELECT DISTINCT l_suppkey, 'predictions' FROM lineitem UNION ALL SELECT DISTINCT o_custkey, 'records' FROM orders) WHERE subject IS NOT NULL GROUP BY subject""")
def subject_coverage(spark, d):
    """In which tables each subject is, and whether in all."""
    key = lambda name, column: table(spark, d, name).select(F.col(column).alias("subject"))
    return st.coverage_report({"trials": key("events", "user_id"), "predictions": key("lineitem", "l_suppkey"), "records": key("orders", "o_custkey")}, "subject")


def _half(where: str) -> str:
    return AUC.format(key="site, smin", proba="proba", name="auc").replace("FROM v_predictions)", f"FROM v_predictions WHERE {where})")


@query(f"""SELECT site, smin, s AS stored, a AS again, CASE WHEN hb IS NULL THEN 'only stored' WHEN ha IS NULL THEN 'only again' WHEN coalesce(abs(s - a) <= 1e-9, s IS NULL AND a IS NULL) THEN 'same' ELSE 'differs' END AS status
  FROM (SELECT site, smin, auc AS s, 1 AS ha FROM ({_half("smin < 7")})) FULL JOIN (SELECT site, smin, auc AS a, 1 AS hb FROM ({_half("smin > 1 AND (smin > 2 OR fold < 4)")})) USING (site, smin)""", ("stored", "again"))
def rescored_sites(spark, d):
    """Scores beside those computed again from other runs' predictions, with what became of each."""
    rows = predictions(spark, d)
    score = lambda part: auc.grouped_auc(rows.where(part), "target", "proba", ["site", "smin"])
    return st.rescored_report(score("smin < 7"), score("smin > 1 and (smin > 2 or fold < 4)"), ["site", "smin"], "auc")


_SCORES = """(SELECT l_suppkey AS site, CAST(l_orderkey % 5 AS INT) AS fold, CASE WHEN l_linenumber % 4 > 0 THEN 'block ' || (l_linenumber % 4) END AS block, avg(l_extendedprice) AS score FROM lineitem GROUP BY ALL)"""
_VARIANCE = f"""(SELECT *, greatest(unique_variance, 0) / nullif(sum(greatest(unique_variance, 0)) OVER (PARTITION BY site), 0) AS share FROM (SELECT site, s.block AS block, avg(s.score - b.score) AS unique_variance, count(*) AS n_folds FROM {_SCORES} s JOIN {_SCORES} b USING (site, fold) WHERE s.block IS NOT NULL AND b.block IS NULL GROUP BY site, s.block))"""


def _variance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("site"), (F.col("l_orderkey") % 5).cast("int").alias("fold"), F.when(F.col("l_linenumber") % 4 > 0, F.concat(F.lit("block "), (F.col("l_linenumber") % 4).cast("string"))).alias("block"))
    return st.unique_variance(rows.agg(F.avg("l_extendedprice").alias("score")), ["site"], "fold", "block", "score")


@query(f"SELECT * FROM {_VARIANCE}", ("unique_variance", "share"))
def unique_variances(spark, d):
    """Each block's unique variance by site, from fits with and without it, and its part of the site's."""
    return _variance(spark, d)


_SITES = "(SELECT s_suppkey AS site, s_nationkey AS subject FROM supplier)"
_MEMBERS = "(SELECT s_suppkey AS site, s_nationkey AS subject, (s_suppkey * 7 % 11 % 6)::INT AS cluster FROM supplier)"
_ROWS = f"""v AS {_VARIANCE}, chosen AS (SELECT site, subject, block FROM v JOIN {_SITES} USING (site) WHERE share > 0.4),
  r AS (SELECT m.cluster, c.block AS "column" FROM chosen c JOIN {_MEMBERS} m USING (site) UNION ALL SELECT cluster, 'marginal' FROM {_MEMBERS} WHERE subject IN (SELECT subject FROM chosen)
    UNION ALL SELECT cluster, 'responsive' FROM {_MEMBERS} WHERE subject IN (SELECT subject FROM chosen) AND site IN (SELECT site FROM v WHERE unique_variance > 1000)),
  g AS (SELECT a.cluster, b."column", coalesce(n, 0)::DOUBLE AS observed FROM (SELECT DISTINCT cluster FROM r) a CROSS JOIN (SELECT DISTINCT "column" FROM r) b LEFT JOIN (SELECT cluster, "column", count(*) AS n FROM r GROUP BY ALL) k ON a.cluster = k.cluster AND b."column" = k."column"),
  e AS (SELECT cluster, "column", observed, sum(observed) OVER (PARTITION BY cluster) * sum(observed) OVER (PARTITION BY "column") / sum(observed) OVER () AS expected, observed / sum(observed) OVER (PARTITION BY cluster) AS row_share FROM g)"""


def _membership(spark: SparkSession, d: str) -> DataFrame:
    variance = _variance(spark, d)
    members = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_nationkey").alias("subject"), (F.col("s_suppkey") * 7 % 11 % 6).cast("int").alias("cluster"))
    chosen = variance.where("share > 0.4").join(members.select("site", "subject"), "site")
    responsive = st.responsive_sites(variance, ["site"], 1000.0)
    return st.membership_rows(chosen, "block", members, "cluster", ["site"], "subject", {"marginal": None, "responsive": responsive})


@query(f"WITH {_ROWS} SELECT cluster, \"column\", observed, expected, observed - expected AS residual, row_share FROM e", ("expected", "residual", "row_share"))
def cluster_membership(spark, d):
    """Clusters of the sites with one dominating block, beside those of all sites and of the responsive ones."""
    return stats.contingency(_membership(spark, d), "cluster", "column")


@query(f"WITH {_ROWS} SELECT sum(pow(observed - expected, 2) / expected) AS chi2, ((count(DISTINCT cluster) - 1) * (count(DISTINCT \"column\") - 1))::BIGINT AS df FROM e", ("chi2",))
def cluster_membership_test(spark, d):
    """Chi-squared of the table of cluster memberships."""
    return stats.chi_squared(stats.contingency(_membership(spark, d), "cluster", "column"), "cluster", "column")


_STUDY = """(SELECT site, least_p, smin, least_control_p FROM (SELECT site, p AS least_p, smin, min(control_p) OVER (PARTITION BY site) AS least_control_p, row_number() OVER (PARTITION BY site ORDER BY p, smin) AS k
  FROM (SELECT site, smin, (count(*) FILTER (WHERE proba >= 0.095) + 1) / (count(*) + 1) AS p, (count(*) FILTER (WHERE baseline_proba >= 0.065) + 1) / (count(*) + 1) AS control_p FROM v_predictions GROUP BY site, smin)) WHERE k = 1)"""


@query(f"""SELECT *, CASE WHEN least_control_p <= 0.05 THEN 'control significant' WHEN least_p >= least_control_p THEN 'control as good' WHEN least_p >= 0.06 THEN 'not significant' ELSE 'kept' END AS verdict, ln(least_p) < -2.5 AND ln(least_control_p) > -2.3 AS by_logs FROM {_STUDY}""", ("least_p", "least_control_p"))
def study_sites(spark, d):
    """Each site's best window with its least p, the least p of the control, and whether the site is in the study."""
    share = lambda hit: (F.count_if(hit) + 1) / (F.count("*") + 1)
    windows = predictions(spark, d).groupBy("site", "smin").agg(share(F.col("proba") >= 0.095).alias("p"), share(F.col("baseline_proba") >= 0.065).alias("control_p"))
    best = st.best_window(windows, ["site"], "smin", "p", "control_p")
    return best.withColumn("verdict", st.study_verdict("least_p", "least_control_p", 0.06)).withColumn("by_logs", st.log_study("least_p", "least_control_p", -2.5, -2.3))


@query("SELECT site, smin, fold, word, epoch, baseline_proba AS score FROM v_predictions")
def predictions_of_measure(spark, d):
    """One measure's predictions out of all subjects' outcomes of every measure."""
    rows = predictions(spark, d)
    keep = ["site", "smin", "fold", "word", "epoch"]
    return st.measure_of(rows.unpivot(keep, ["proba", "baseline_proba"], "measure", "score"), "baseline_proba")


_POLARITY = "SELECT site, word, sign(round(avg(proba) FILTER (WHERE target = 1) - avg(proba) FILTER (WHERE target = 0), 9))::INT AS polarity FROM v_predictions WHERE {} GROUP BY site, word"
_RELATION = f"""(SELECT g.early_selectivity, g.late_selectivity, coalesce(n, 0) AS n FROM (SELECT a AS early_selectivity, b AS late_selectivity FROM (VALUES ('d'), ('n')) x(a), (VALUES ('d'), ('n')) y(b)) g LEFT JOIN
  (SELECT CASE e.polarity WHEN -1 THEN 'd' WHEN 1 THEN 'n' END AS early_selectivity, CASE l.polarity WHEN -1 THEN 'd' WHEN 1 THEN 'n' END AS late_selectivity, count(*) AS n FROM ({_POLARITY.format('smin <= 3')}) e JOIN ({_POLARITY.format('smin > 3')}) l USING (site, word) GROUP BY ALL) s USING (early_selectivity, late_selectivity))"""
_COUNTS = f"(SELECT sum(n) FILTER (WHERE early_selectivity = late_selectivity)::BIGINT AS congruent, sum(n) FILTER (WHERE early_selectivity <> late_selectivity)::BIGINT AS incongruent FROM {_RELATION})"


def _relation(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda k: F.avg(F.when(F.col("target") == k, F.col("proba")))
    side = lambda part, name: predictions(spark, d).where(part).groupBy("site", "word").agg(F.signum(F.round(mean(1) - mean(0), 9)).cast("int").alias(name))
    return st.preference_relation(side("smin <= 3", "early_polarity"), side("smin > 3", "late_polarity"), ["site", "word"], {-1: "d", 1: "n"})


@query(f"SELECT * FROM {_RELATION}")
def preference_relation(spark, d):
    """How often sites with an early preference have which late one."""
    return _relation(spark, d)


@query(f"SELECT congruent, incongruent, round(p, 6) AS p, 'Congruent: ' || congruent || ', incongruent: ' || incongruent || ', significant at 0.05: ' || CASE WHEN p < 0.05 THEN 'yes' ELSE 'no' END AS report FROM (SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) FROM (SELECT c.congruent + c.incongruent AS n, unnest(range(c.congruent, c.congruent + c.incongruent + 1)) AS k)) AS p FROM {_COUNTS} c)", ("p",))
def congruency_report(spark, d):
    """One row: congruent and incongruent preferences, the one-sided binomial p, and a line for a report."""
    out = st.congruency_counts(_relation(spark, d)).withColumn("p", binom_p(F.col("congruent"), F.col("congruent") + F.col("incongruent")))
    text = F.concat(F.lit("Congruent: "), F.col("congruent").cast("string"), F.lit(", incongruent: "), F.col("incongruent").cast("string"), F.lit(", significant at 0.05: "), F.when(F.col("p") < 0.05, "yes").otherwise("no"))
    return out.withColumn("report", text)


_GAINS = ", ".join(f"avg(proba - baseline_proba - 0.01) FILTER (WHERE fold = {k}) AS g{k}" for k in range(5))
_G = [f"g{k}" for k in range(5)]


@query(f"""SELECT * FROM (SELECT *, {' + '.join(f'coalesce({g} > 0, false)::INT' for g in _G)} AS n_positive, ({' + '.join(f'coalesce({g}, 0)' for g in _G)}) / ({' + '.join(f'({g} IS NOT NULL)::INT' for g in _G)}) AS row_mean
  FROM (SELECT site, smin, {', '.join(f'round({g}, 9) AS {g}' for g in _G)} FROM (SELECT site, smin, {_GAINS} FROM v_predictions GROUP BY site, smin))) WHERE n_positive >= 2""", (*_G, "row_mean"))
def mostly_positive(spark, d):
    """Windows with a gain above zero in two folds at least, with their mean."""
    gain = F.col("proba") - F.col("baseline_proba") - 0.01
    rows = predictions(spark, d).groupBy("site", "smin").agg(*[F.round(F.avg(F.when(F.col("fold") == k, gain)), 9).alias(f"g{k}") for k in range(5)])
    return st.many_positive(rows, _G)
