"""Decoders in phases over sessions of the signals, geometry of clusters, intervals and long forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.operators import arrays as ar
from trialgrid.operators import decoders
from trialgrid.operators import geometry as ge
from trialgrid.operators import phases as ph
from trialgrid.plans.comparison import SITE, _signals
from trialgrid.plans.registry import query
from trialgrid.sources.storage import stored
from trialgrid.sources.tables import epochs, predictions, table

CLASSES = [-1, 0, 1]


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """Signals with a step (1 to 6) and a three-valued mismatch (-1, 0, 1), stand-ins from the id and the cue."""
    rows = _signals(spark, d)
    return rows.withColumn("step", (F.pmod("epoch", F.lit(6)) + 1).cast("int")).withColumn("mismatch", (F.pmod(F.col("cue") + F.col("y"), F.lit(3)) - 1).cast("int"))


def _window(rows: DataFrame, low: int, target: str = "y") -> DataFrame:
    return decoders.decoding_inputs(rows, target, 16, 16, low, low + 16, [*SITE, "epoch", "step", "mismatch"])


def _first(spark: SparkSession, d: str, strategy: str = "extreme") -> DataFrame:
    return ph.end_step_decoder(_window(_sessions(spark, d), 0), SITE, "epoch", "step", strategy)


@query()
def first_phase(spark, d):
    """Class decoders trained on the end steps, and on half of every step: probabilities of the trials held out."""
    return _first(spark, d).withColumn("strategy", F.lit("extreme")).unionByName(_first(spark, d, "stratify").withColumn("strategy", F.lit("stratify")))


@query()
def second_phase(spark, d):
    """Later activity on intervening activity and the first phase's probability, with and without it."""
    rows = _sessions(spark, d)
    means = F.posexplode(F.array(ar.mean(ar.window("samples", F.lit(32), F.lit(48))), ar.mean(ar.window("samples", F.lit(48), F.lit(64))))).alias("part", "later")
    held = stored(_first(spark, d))
    fits = ph.second_phase(held, _window(rows, 16), rows.select(*SITE, "epoch", means), SITE, "epoch", "step", ["part"], "later")
    return fits.select(*SITE, "part", "outer", "alpha", "r2", "r2_baseline", F.col("unique")["proba"].alias("gain"))


def _mismatch(spark: SparkSession, d: str, held: DataFrame) -> DataFrame:
    """The three-class decoder on a later window: trained where the first phase was, applied to what it held out."""
    rows = _window(_sessions(spark, d), 32, "mismatch")
    kept = held.select(*SITE, "epoch", F.lit(True).alias("held"))
    rows = ph.dealt_folds(rows.join(kept, [*SITE, "epoch"], "left"), SITE, ["y"], "epoch", 2)
    return ph.class_decoder(rows.withColumn("fold", F.when(F.col("held"), -1).otherwise(F.col("fold"))).drop("held"), SITE, "epoch", CLASSES)


@query()
def mismatch_decoder(spark, d):
    """Three-class decoding by session: accuracy and mean log probability of each fold, and of the trials held out (-1)."""
    out = _mismatch(spark, d, stored(_first(spark, d))).withColumn("p", ph.proba_of("probas", CLASSES, F.col("y")))
    return out.groupBy(*SITE, "fold").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("y")).cast("double")).alias("accuracy"), F.avg(F.ln(F.greatest("p", F.lit(1e-300)))).alias("log_probability"))


@query()
def phase_correlations(spark, d):
    """By session: the first phase's probability of the true class against that of the own mismatch, where there is one."""
    held = stored(_first(spark, d))
    first = held.withColumn("p", F.when(F.col("y") == 1, F.col("proba")).otherwise(1 - F.col("proba")))
    second = _mismatch(spark, d, held).where("fold < 0 and y != 0").withColumn("q", ph.proba_of("probas", CLASSES, F.col("y")))
    return ph.phase_correlation(first, second, SITE, "epoch", "p", "q")


# clusters: the label stands in for the cluster where SQL is to agree

_Z = "z AS (SELECT vec_id, label, i, coalesce((v - avg(v) OVER (PARTITION BY i)) / nullif(stddev_pop(v) OVER (PARTITION BY i), 0), 0) AS z FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS i FROM embeddings WHERE label IS NOT NULL))"
_C = "c AS (SELECT label, i, count(*) AS n, avg(z) AS m, avg(z * z) AS q, stddev_pop(z) / sqrt(count(*)) AS e FROM z GROUP BY label, i)"


def _standardised(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where("label is not null").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return ge.standardised_vectors(rows, "x")


@query(f"WITH {_Z} SELECT vec_id, sum(z * (i + 1)) AS weighted FROM z GROUP BY vec_id", ("weighted",))
def standardised_vectors(spark, d):
    """Vectors standardised at each place over all rows, as a sum weighted by place."""
    total = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return _standardised(spark, d).select("vec_id", total.alias("weighted"))


@query(f"WITH {_Z}, {_C} SELECT label, i::INT AS place, n, m AS center, e AS spread FROM c", ("center", "spread"))
def cluster_profiles(spark, d):
    """Mean vector and standard error of each cluster."""
    p = ge.cluster_profiles(_standardised(spark, d), "label", "x")
    return p.select("label", "n", F.posexplode(F.arrays_zip("center", "spread")).alias("place", "s")).select("label", "place", "n", "s.center", "s.spread")


@query(f"WITH {_Z}, {_C} SELECT a.label AS a, b.label AS b, sqrt(sum((a.m - b.m) ** 2)) AS centers, sqrt(greatest(sum(a.q + b.q - 2 * a.m * b.m), 0)) AS members FROM c a JOIN c b USING (i) GROUP BY a.label, b.label", ("centers", "members"))
def cluster_distances(spark, d):
    """Distances between clusters: of their centres, and root mean square of their members."""
    return ge.cluster_distances(ge.cluster_profiles(_standardised(spark, d), "label", "x"), "label")


@query(f"""WITH {_Z}, {_C}, f AS (SELECT c.label, vec_id, sqrt(sum((z - m) ** 2)) AS distance FROM z JOIN c USING (i) GROUP BY c.label, vec_id)
  SELECT label, "rank"::INT AS "rank", vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS "rank" FROM f) WHERE "rank" <= 4""", ("distance",))
def nearest_members(spark, d):
    """The four vectors nearest to each cluster's centre."""
    rows = _standardised(spark, d)
    return ge.nearest_members(rows, ge.cluster_profiles(rows, "label", "x"), "vec_id", "label", "x", 4)


@query()
def upper_clusters(spark, d):
    """For each channel the signals of which the peak is in the upper half, in clusters with their sizes and mean peak."""
    rows = epochs(spark, d).withColumn("peak", F.array_max("samples"))
    found = ge.upper_clusters(rows, "channel", "peak", 0.5, "samples", 6, 4)
    return found.groupBy("channel", "cluster").agg(F.count("*").alias("n"), F.avg("peak").alias("mean_peak"))


@query("""SELECT w.site, w.epoch, w.smin, e.last_end - (w.smin + 1) AS ahead FROM v_predictions w JOIN (SELECT l_orderkey AS epoch, max(l_linenumber) AS last_end FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey) e USING (epoch) WHERE w.smin + 1 <= e.last_end""")
def windows_until_end(spark, d):
    """Windows that end before the last marked interval of their stimulus does."""
    intervals = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("epoch"), F.col("l_linenumber").alias("until"), F.when(F.col("l_returnflag") == "N", " \t").otherwise(F.col("l_returnflag")).alias("mark"))
    windows = predictions(spark, d).select("site", "epoch", "smin", (F.col("smin") + 1).alias("last"))
    return ar.windows_until(windows, ar.last_marked_end(intervals, ["epoch"], "mark", "until"), ["epoch"], "last").select("site", "epoch", "smin", "ahead")


@query("""SELECT epoch, -0.4 + pos / 100.0 AS time, x AS value, CASE WHEN channel = 0 THEN CASE cls WHEN 1 THEN 'a' ELSE 'b' END ELSE 'contrast' END AS label, CASE WHEN channel = 0 THEN cls = 1 ELSE false END AS mismatch FROM v_samples""", ("time", "value"))
def long_signals(spark, d):
    """Samples of one channel in long form with their label, above those of the others as a contrast."""
    rows = epochs(spark, d)
    own = rows.where("channel = 0").withColumn("label", F.when(F.col("cls") == 1, "a").otherwise("b")).withColumn("mismatch", F.col("cls") == 1)
    own, others = ar.long_form(own, ["epoch", "label", "mismatch"], "samples", -0.4, 100.0), ar.long_form(rows.where("channel != 0"), ["epoch"], "samples", -0.4, 100.0)
    return ar.with_contrast(own, others, "label", {"mismatch": False})
