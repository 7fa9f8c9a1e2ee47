"""Windowed regression of the signals on trial features, unique variance, and nested F tests, all from sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.operators import arrays as ar
from trialgrid.operators import regression as rg
from trialgrid.plans.registry import query, sql_order
from trialgrid.sources.tables import table

SESSION = 900
OUTER, INNER = 4, 3
ALPHAS = [10.0**k for k in range(-2, 6)]
FEATURES = ["level", "lexical", "load"]
WINDOWS = [(0, 16), (16, 32), (32, 48), (48, 64)]


def _trials(spark: SparkSession, d: str) -> DataFrame:
    """epoch, session, pair and three features (stand-ins from the label), beside the samples."""
    rows = table(spark, d, "embeddings").where("label is not null")
    return rows.select(
        F.col("vec_id").alias("epoch"), F.floor(F.col("vec_id") / SESSION).alias("session"), (F.col("label") % 3).cast("int").alias("pair"), (F.col("label") - 4).cast("double").alias("level"),
        (F.col("label") % 2).cast("double").alias("lexical"), (F.pmod(F.col("vec_id"), F.lit(7)) - 3).cast("double").alias("load"), F.transform("embedding", lambda v: v.cast("double")).alias("samples"),
    )


def _design(spark: SparkSession, d: str) -> DataFrame:
    rows = _trials(spark, d)
    cells = rg.nested_cells(rows, ["session"], "epoch", ["pair", "level"], OUTER, INNER)
    return rows.select("session", "epoch", rg.terms_by_condition(FEATURES, "pair").alias("terms")).join(cells, ["session", "epoch"])


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """session, epoch, smin, part, y: the window's mean of even and of odd samples, as two channels."""
    rows = _trials(spark, d)
    windows = F.explode(F.array(*[F.lit(a) for a, _ in WINDOWS])).alias("smin")
    every_second = lambda k: F.filter(ar.window("samples", F.col("smin"), F.col("smin") + 16), lambda v, i: i % 2 == k)
    part = F.posexplode(F.array(ar.mean(every_second(0)), ar.mean(every_second(1)))).alias("part", "y")
    return rows.select("session", "epoch", "samples", windows).select("session", "epoch", "smin", part)


_TRIALS = f"t AS (SELECT vec_id AS epoch, vec_id // {SESSION} AS session, (label % 3)::INT AS pair, (label - 4)::DOUBLE AS level, (label % 2)::DOUBLE AS lexical, ((vec_id % 7 + 7) % 7 - 3)::DOUBLE AS load, CAST(embedding AS DOUBLE[]) AS samples FROM embeddings WHERE label IS NOT NULL)"
_CELLS = f"c AS (SELECT epoch, session, (k % {OUTER})::INT AS outer_, (k // {OUTER} % {INNER})::INT AS inner_ FROM (SELECT epoch, session, row_number() OVER (PARTITION BY session, pair, level ORDER BY {sql_order('epoch')}, epoch) - 1 AS k FROM t))"
_TERMS = "z AS (SELECT session, epoch, '1' AS term, 1.0::DOUBLE AS x FROM t UNION ALL " + " UNION ALL ".join(f"SELECT session, epoch, '{f}-' || pair, {f} FROM t WHERE {f} <> 0" for f in FEATURES) + ")"
_Y = "y AS (SELECT session, epoch, smin, part, list_avg(list_filter(samples[smin + 1 : smin + 16], lambda v, i: (i - 1) % 2 = part)) AS y FROM t, (SELECT unnest([0, 16, 32, 48])::INT AS smin), (SELECT unnest([0, 1])::INT AS part))"


@query(f"""WITH {_TRIALS}, {_CELLS}, {_TERMS} SELECT a.session, outer_ AS "outer", inner_ AS "inner", a.term, b.term AS other, sum(a.x * b.x) AS xx FROM z a JOIN z b ON a.session = b.session AND a.epoch = b.epoch AND a.term <= b.term JOIN c ON c.session = a.session AND c.epoch = a.epoch GROUP BY ALL""", ("xx",))
def gram_sums(spark, d):
    """Sums of products of terms by session and cell of the split: all that a fit needs of the design."""
    return rg.gram_sums(_design(spark, d), ["session"])


@query(f"""WITH {_TRIALS}, {_CELLS}, {_TERMS}, {_Y} SELECT z.session, smin, part, outer_ AS "outer", inner_ AS "inner", term, sum(x * y) AS xy, sum(y * y) FILTER (WHERE term = '1') AS yy FROM z JOIN c USING (session, epoch) JOIN y USING (session, epoch) GROUP BY ALL""", ("xy", "yy"))
def output_sums(spark, d):
    """Sums of products of terms and outputs."""
    return rg.output_sums(_design(spark, d), _responses(spark, d), ["session"], "epoch", ["smin", "part"], "y")


def _fitted(spark: SparkSession, d: str) -> DataFrame:
    blocks = {"level": ["level"], "lexical": ["lexical"], "load": ["load"]}
    return rg.nested_ridge(_design(spark, d), _responses(spark, d), ["session"], "epoch", ["smin", "part"], "y", ALPHAS, blocks)


@query()
def windowed_regression(spark, d):
    """R2, penalty and unique variance of each feature, by session, window, channel and held-out fold."""
    return _fitted(spark, d).select("session", "smin", "part", "outer", "alpha", "r2", *[F.col("unique")[b].alias(f"unique_{b}") for b in FEATURES])


@query()
def windowed_coefficients(spark, d):
    """Coefficients of the windowed regression by term and fold."""
    return _fitted(spark, d).select("session", "smin", "part", "outer", F.inline(F.arrays_zip("names", "coef")))


_R = "r AS (SELECT l_suppkey AS site, l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem)"
_FITS = f"""WITH {_R}, s AS (SELECT site, count(*) AS n, var_pop(y) * count(*) AS total, corr(y, a) AS ya, corr(y, b) AS yb, corr(a, b) AS ab FROM r GROUP BY site),
  f AS (SELECT site, n, total, 0.0::DOUBLE AS r0, ya * ya AS r1, (ya * ya + yb * yb - 2 * ya * yb * ab) / (1 - ab * ab) AS r2 FROM s),
  l AS (SELECT site, n, total, 1 AS step, r0 AS before, r1 AS after FROM f UNION ALL SELECT site, n, total, 2, r1, r2 FROM f)
  SELECT site, step, n, after AS r2, after - before AS r2_gain, (after - before) / ((1 - after) / (n - step - 1)) AS f, 1 AS df1, (n - step - 1)::INT AS df2 FROM l WHERE n > 3"""


def _nested(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    return rg.nested_f_tests(rows, ["site"], "y", [["a"], ["b"]])


@query(_FITS, ("r2", "r2_gain", "f"))
def nested_f(spark, d):
    """Price on quantity, then on discount besides: R2 and F of each step."""
    return _nested(spark, d).where("n > 3").select("site", "step", "n", "r2", "r2_gain", "f", "df1", "df2")


@query()
def nested_f_p_values(spark, d):
    """As ``nested_f``, with residual sums and the tail of F."""
    return _nested(spark, d)
