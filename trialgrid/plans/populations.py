"""Draws between populations: counterfactual correlations, size-matched controls, pooled pseudo-trials, percentile bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.functions.special import t_p
from trialgrid.operators import decoders
from trialgrid.operators import derived as dv
from trialgrid.operators import resampling as rs
from trialgrid.operators.auc import grouped_auc
from trialgrid.operators.quantiles import average_ranks, percentile_columns
from trialgrid.plans.registry import MEANS, _means, query, sql_order
from trialgrid.sources.tables import epochs, predictions, table, trials

REPEATS = 5
_STRATUM = ["step", "lexical"]

_BY_TRIAL = sql_order("epoch", "r")
_SITES = "sites AS (SELECT subject, pair, step, lexical, epoch, 0 AS site, slider AS response FROM v_trials UNION ALL SELECT subject, pair, step, lexical, epoch, 1, value * step FROM v_trials)"
_DRAWS = f"""have AS (SELECT subject AS other, pair, step, lexical, count(*) AS k FROM v_trials GROUP BY ALL),
  need AS (SELECT subject, pair, step, lexical, count(*) AS m FROM v_trials GROUP BY ALL),
  met AS (SELECT n.*, other, k, count(*) OVER (PARTITION BY n.subject, other, n.pair) AS met FROM need n JOIN have h ON n.pair = h.pair AND n.step = h.step AND n.lexical = h.lexical AND n.subject <> h.other),
  both_ AS (SELECT * FROM met JOIN (SELECT subject, pair, count(*) AS strata FROM need GROUP BY ALL) USING (subject, pair) WHERE met = strata),
  given AS (SELECT subject AS other, pair, step, lexical, value, r, row_number() OVER (PARTITION BY subject, pair, step, lexical, r ORDER BY {_BY_TRIAL}, epoch) AS place FROM v_trials, (SELECT unnest(range({REPEATS})) AS r)),
  wanted AS (SELECT subject, pair, step, lexical, epoch, row_number() OVER (PARTITION BY subject, pair, step, lexical ORDER BY {sql_order("epoch")}, epoch) AS j FROM v_trials),
  asked AS (SELECT w.*, other, r, CASE WHEN m <= k THEN j ELSE {sql_order("epoch", f"r + {REPEATS}")} % k + 1 END AS place FROM wanted w JOIN both_ USING (subject, pair, step, lexical), (SELECT unnest(range({REPEATS})) AS r)),
  drawn AS (SELECT subject, pair, other, r, epoch, value FROM asked JOIN given USING (other, pair, step, lexical, r, place))"""
_RANK = "rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"
_RANKED = f"""WITH {_SITES}, {_DRAWS}, rx AS (SELECT *, {_RANK.format(by="subject, pair, other, r", x="value")} AS x FROM drawn), ry AS (SELECT *, {_RANK.format(by="subject, pair, site", x="response")} AS y FROM sites)"""
_CORR = "CASE WHEN var_pop(x) > 1e-12 AND var_pop(y) > 1e-12 THEN corr(x, y) END"
_COUNTERFACTUAL = f"{_RANKED} SELECT subject, pair, site, other, r::INT AS repeat, {_CORR} AS r FROM rx JOIN ry USING (subject, pair, epoch) GROUP BY subject, pair, site, other, r"
_OBSERVED = f"SELECT subject, pair, site, {_CORR} AS r FROM (SELECT *, {_RANK.format(by='subject, pair', x='value')} AS x FROM v_trials) JOIN ry USING (subject, pair, epoch) GROUP BY subject, pair, site"


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    return trials(spark, d).select("subject", "pair", *_STRATUM, "epoch", "value")


def _responses(spark: SparkSession, d: str) -> DataFrame:
    two = F.posexplode(F.array(F.col("slider"), F.col("value") * F.col("step"))).alias("site", "response")
    return trials(spark, d).select("subject", "pair", *_STRATUM, "epoch", two)


def _counterfactual(spark: SparkSession, d: str) -> DataFrame:
    return rs.counterfactual_correlations(_outputs(spark, d), _responses(spark, d), "subject", ["pair"], "site", _STRATUM, "epoch", "value", "response", REPEATS)


@query(f"WITH {_DRAWS} SELECT subject, pair, other, r::INT AS repeat, epoch, value FROM drawn")
def counterfactual_draws(spark, d):
    """For each trial and repeat a trial of another subject from the same stratum."""
    t = trials(spark, d).select("subject", "pair", *_STRATUM, "epoch")
    return rs.counterfactual_draws(_outputs(spark, d), t, "subject", ["pair"], _STRATUM, "epoch", "value", REPEATS)


@query(_COUNTERFACTUAL, ("r",))
def counterfactual_correlations(spark, d):
    """Spearman's correlation of two response series with other subjects' outputs, in each repeat."""
    return _counterfactual(spark, d)


_TESTED = f"""{_RANKED}, c AS (SELECT subject, pair, site, other, r AS repeat, {_CORR} AS r FROM rx JOIN ry USING (subject, pair, epoch) GROUP BY subject, pair, site, other, r),
  o AS ({_OBSERVED}), z AS (SELECT subject, pair, site, avg(atanh(r)) AS z_mean, stddev_samp(atanh(r)) AS z_sd, count(r) AS n FROM c WHERE abs(r) < 1 GROUP BY ALL)
  SELECT subject, pair, site, o.r AS true_r, z_mean, z_sd, coalesce(n, 0) AS n, (atanh(o.r) - z_mean) / nullif(z_sd, 0) AS z, coalesce(n, 0) - 1 AS df FROM o FULL JOIN z USING (subject, pair, site)"""


def _tested(spark: SparkSession, d: str) -> DataFrame:
    observed = rs.observed_correlations(_outputs(spark, d), _responses(spark, d), "subject", ["pair"], "site", "epoch", "value", "response")
    return dv.counterfactual_z(observed, _counterfactual(spark, d).where("abs(r) < 1").select("subject", "pair", "site", "r"), ["subject", "pair", "site"])


@query(_TESTED, ("true_r", "z_mean", "z_sd", "z"))
def counterfactual_test(spark, d):
    """A site's own correlation against those with other subjects' outputs, on Fisher's scale."""
    return _tested(spark, d)


@query()
def counterfactual_p_values(spark, d):
    """As ``counterfactual_test``, with the two-sided tail of t."""
    return _tested(spark, d).where("n > 1 and z is not null").withColumn("p", t_p("z", "df"))


_PEAK_SETS = f"(SELECT site, CASE WHEN peak >= 0.64 THEN 2 ELSE 1 END AS set_id FROM (SELECT site, max(mean_auc) AS peak FROM ({MEANS}) GROUP BY site) WHERE peak >= 0.62)"


@query(f"""WITH s AS (SELECT s_suppkey AS site, n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey), t AS (SELECT set_id, region, site FROM {_PEAK_SETS} JOIN s USING (site)),
  k AS (SELECT set_id, region, count(*) AS k FROM t GROUP BY ALL), f AS (SELECT region, site FROM s WHERE site NOT IN (SELECT site FROM t)),
  p AS (SELECT k.*, site, draw, row_number() OVER (PARTITION BY set_id, draw, region ORDER BY {sql_order("site", "set_id * 10 + draw")}, site) AS place FROM f JOIN k USING (region), (SELECT unnest(range(10))::INT AS draw))
  SELECT set_id, draw, region, site FROM p WHERE place <= k""")
def control_sets(spark, d):
    """Ten controls for each set of sites with a high peak, matched by region, without a site of any set."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region"))
    sites = table(spark, d, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("site"), "region")
    peaks = _means(spark, d).groupBy("site").agg(F.max("mean_auc").alias("peak")).where("peak >= 0.62").withColumn("set_id", F.when(F.col("peak") >= 0.64, 2).otherwise(1))
    return rs.control_sets(peaks.join(sites, "site"), sites, ["region"], "site", "set_id", 10)


_PLACED = f"""n AS (SELECT subject, pair, step, response, count(*) AS n FROM v_trials GROUP BY ALL), least_n AS (SELECT min(n) AS m FROM n),
  whole AS (SELECT pair, step, response FROM n JOIN (SELECT pair, count(DISTINCT subject) AS subjects FROM n GROUP BY pair) USING (pair) GROUP BY pair, step, response, subjects HAVING count(*) = subjects),
  placed AS (SELECT * FROM (SELECT subject, pair, step, response, epoch, row_number() OVER (PARTITION BY subject, pair, step, response ORDER BY {sql_order("epoch")}, epoch) AS place FROM v_trials JOIN whole USING (pair, step, response)) WHERE place <= (SELECT m FROM least_n))"""


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return rs.pseudo_trials(trials(spark, d), "subject", ["pair"], ["step", "response"], "epoch")


def _pooled(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d)
    vectors = F.array(F.array("slider", "value"), F.array(F.col("value") * F.col("step"), F.col("value") - F.col("slider")))
    signals = t.select("subject", "epoch", F.posexplode(vectors).alias("site", "x"))
    sites = t.select("subject").distinct().select("subject", F.explode(F.array(F.lit(0), F.lit(1))).alias("site"))
    members = sites.select(F.lit("all").alias("population"), "*").unionByName(sites.select(F.concat(F.lit("site"), F.col("site").cast("string")).alias("population"), "*"))
    return rs.pooled_features(_placed(spark, d), signals, members, "population", "subject", ["pair"], ["step", "response"], "epoch", "site", "x")


@query(f"WITH {_PLACED} SELECT pair, step, response, place::INT AS place, subject, epoch FROM placed")
def pseudo_trials(spark, d):
    """Trials of all subjects aligned by place within step and response."""
    return _placed(spark, d)


@query(f"""WITH {_PLACED}, s AS (SELECT p.*, 0 AS site, [slider, t.value] AS x FROM placed p JOIN (SELECT epoch, slider, value FROM v_trials) t USING (epoch) UNION ALL SELECT p.*, 1, [t.value * p.step, t.value - slider] FROM placed p JOIN (SELECT epoch, slider, value FROM v_trials) t USING (epoch)),
  m AS (SELECT 'all' AS population, * FROM s UNION ALL SELECT 'site' || site, * FROM s)
  SELECT population, pair, step, response, place::INT AS place, count(*)::INT AS parts, list_sum(list_transform(flatten(list(x ORDER BY subject, site)), lambda v, i: v * i)) AS total FROM m GROUP BY population, pair, step, response, place""", ("total",))
def pooled_features(spark, d):
    """The vectors of all sites of a population side by side, as a sum weighted by place."""
    total = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return _pooled(spark, d).select("population", "pair", "step", "response", "place", "parts", total.alias("total"))


@query()
def pooled_decoding(spark, d):
    """The response decoded from pooled populations, scored on held-out pseudo-trials."""
    rows = _pooled(spark, d).withColumn("y", F.col("response").cast("int")).withColumn("trial", F.col("step") * 1_000_000 + F.col("place") * 2 + F.col("y"))
    group = ["population", "pair"]
    held = decoders.cross_validated(decoders.folds(rows, group, "trial", 3), group, "trial")
    return grouped_auc(held.select(*group, F.col("y").alias("target"), "proba"), "target", "proba", group)


@query("SELECT channel, quantile_cont(x, 0.1) AS low, quantile_cont(x, 0.9) AS high FROM v_samples GROUP BY channel", ("low", "high"))
def channel_bounds(spark, d):
    """The tenth and ninetieth percentile of a channel's samples over all trials."""
    samples = epochs(spark, d).select("channel", F.explode("samples").alias("x"))
    return percentile_columns(samples, "x", {"low": 0.1, "high": 0.9}, ["channel"])


@query(f"SELECT epoch, site, smin, {_RANK.format(by='site', x='proba')} AS average_rank FROM v_predictions", ("average_rank",))
def distributed_ranks(spark, d):
    """Average ranks from the distinct values of a site."""
    return average_ranks(predictions(spark, d).select("epoch", "site", "smin", "proba"), "proba", ["site"], "average_rank").drop("proba")
