"""Paired model comparisons over the signals: sites are sessions of a channel, so that a fit stays at some hundred trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.operators import comparison as cm
from trialgrid.operators import decoders
from trialgrid.plans.registry import query, sql_order
from trialgrid.sources.tables import table

#: Vectors of a session; a third of them are of one channel.
SESSION = 900
SITE = ["channel", "session"]

_TRIALS = f"SELECT vec_id AS epoch, CAST(label % 3 AS INT) AS channel, vec_id // {SESSION} AS session, CAST(label >= 5 AS INT) AS y, CAST(label % 4 AS INT) AS cue FROM embeddings WHERE label IS NOT NULL"


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """Epochs with their session, class and acoustic cue (0 to 3)."""
    rows = table(spark, d, "embeddings").where("label is not null")
    return rows.select(
        F.col("vec_id").alias("epoch"), (F.col("label") % 3).cast("int").alias("channel"), F.floor(F.col("vec_id") / SESSION).alias("session"),
        (F.col("label") >= 5).cast("int").alias("y"), (F.col("label") % 4).cast("int").alias("cue"), F.transform("embedding", lambda v: v.cast("double")).alias("samples"),
    )


def _splits(rows: DataFrame) -> DataFrame:
    return cm.repeated_splits(rows, SITE, "epoch", "y", ["cue", "y"])


def _windows(rows: DataFrame) -> DataFrame:
    return decoders.decoding_inputs(rows, "y", 16, 16, 0, 64, [*SITE, "epoch", "cue"]).join(_splits(rows), [*SITE, "epoch"])


_ORDER = sql_order("epoch", "repeat") + ", epoch"


@query(f"""SELECT * FROM (WITH t AS ({_TRIALS}), c AS (SELECT channel, session, y, count(*) AS n, floor(count(*) * 0.8 + 0.5)::BIGINT AS k FROM t GROUP BY ALL),
  z AS (SELECT channel, session, min(n) AS least_n, min(k) AS train, min(n - k) AS held, least(3, floor(round(min(n) * 0.8, 9)))::BIGINT AS f FROM c GROUP BY ALL HAVING count(*) = 2),
  s AS (SELECT channel, session, CASE WHEN train >= f AND held >= f THEN f WHEN least(train, held) >= 2 THEN held END AS folds FROM z),
  r AS (SELECT t.*, k, folds, unnest(range(5))::INT AS repeat FROM t JOIN c USING (channel, session, y) JOIN s USING (channel, session) WHERE folds >= 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY channel, session, repeat, y ORDER BY {_ORDER}) <= k AS train FROM r)
  SELECT channel, session, epoch, repeat, CASE WHEN train THEN (row_number() OVER (PARTITION BY channel, session, repeat, train, cue, y ORDER BY {_ORDER}) - 1) % folds ELSE -1 END::INT AS fold FROM o)""")
def comparison_splits(spark, d):
    """Held-out trials (-1) and inner folds of each repeat, the same for both models and all windows."""
    return _splits(_signals(spark, d)).select(*SITE, "epoch", F.posexplode("split").alias("repeat", "fold"))


@query(f"""SELECT epoch, smin, x FROM (SELECT epoch, w.smin, list_concat([CAST(cue AS DOUBLE)], CAST(e.embedding AS DOUBLE[])[w.smin + 1 : w.smin + 16]) AS v FROM ({_TRIALS}) t JOIN (SELECT vec_id, embedding FROM embeddings) e ON e.vec_id = t.epoch, (SELECT unnest([0, 16, 32, 48])::INT AS smin) w), LATERAL (SELECT list_sum(v) AS x)""", ("x",))
def baseline_and_signal(spark, d):
    """The sum over the baseline feature and the window that follow each other in one vector."""
    rows = decoders.decoding_inputs(_signals(spark, d), "y", 16, 16, 0, 64, ["epoch", "cue"])
    return rows.select("epoch", "smin", F.aggregate(cm.with_baseline(["cue"]), F.lit(0.0), lambda s, v: s + v).alias("x"))


@query()
def model_comparison(spark, d):
    """Cue alone against cue and signal: paired scores by site, window and repeat."""
    group = [*SITE, "smin"]
    return cm.paired_scores(cm.compared(_windows(_signals(spark, d)), group, "epoch", ["cue"]), group)


@query()
def comparison_predictions(spark, d):
    """Held-out probabilities of both models, with the settings each took."""
    return cm.compared(_windows(_signals(spark, d)), [*SITE, "smin"], "epoch", ["cue"])
