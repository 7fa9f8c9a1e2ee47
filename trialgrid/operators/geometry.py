"""Geometry of clusters of vectors: standardised vectors, distances between clusters, nearest members, clusters by target.

Members meet the few centres and never each other: the root mean square distance between all members of two clusters
follows from their sizes, means and summed squares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.operators.decoders import clustered
from trialgrid.operators.quantiles import exact_percentiles


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def standardised_vectors(rows: DataFrame, x: str) -> DataFrame:
    """``rows`` with ``x`` less its mean and by its population deviation at each place, over all rows; a place that doesn't
    vary becomes 0. Vectors have one length; the table of means is a row of it."""
    long = rows.select(F.posexplode(x).alias("_i", "_v")).groupBy("_i").agg(F.avg("_v").alias("m"), F.stddev_pop("_v").alias("s"))
    moments = long.agg(F.array_sort(F.collect_list(F.struct("_i", "m", "s"))).alias("_ms"))
    z = F.zip_with(x, "_ms", lambda v, r: F.coalesce(F.try_divide(v - r["m"], r["s"]), F.lit(0.0)))
    return rows.crossJoin(F.broadcast(moments)).withColumn(x, z).drop("_ms")  # one row


def cluster_profiles(rows: DataFrame, cluster: str, x: str) -> DataFrame:
    """``cluster``, n, center (mean vector), spread (standard error at each place), square (mean squared length)."""
    long = rows.select(cluster, F.posexplode(x).alias("i", "v")).groupBy(cluster, "i")
    cells = long.agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.avg(F.col("v") * F.col("v")).alias("q"), (F.stddev_pop("v") / F.sqrt(F.count("v"))).alias("e"))
    flat = cells.groupBy(cluster).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "m", "e"))).alias("_c"), F.sum("q").alias("square"))
    return flat.select(cluster, "n", F.transform("_c", lambda c: c["m"]).alias("center"), F.transform("_c", lambda c: c["e"]).alias("spread"), "square")


def cluster_distances(profiles: DataFrame, cluster: str) -> DataFrame:
    """a, b, centers (distance of the centres), members (root mean square distance of a member of a to one of b, pairs of a
    member with itself included), for each ordered pair of clusters, a cluster with itself too."""
    a = profiles.select(F.col(cluster).alias("a"), F.col("center").alias("_x"), F.col("square").alias("_p"), F.lit(1).alias("_all"))
    b = profiles.select(F.col(cluster).alias("b"), F.col("center").alias("_y"), F.col("square").alias("_q"), F.lit(1).alias("_all"))
    pairs = a.join(b, "_all")  # clusters, not members
    between = F.zip_with("_x", "_y", lambda p, q: (p - q) * (p - q))
    apart = F.sqrt(F.aggregate(between, F.lit(0.0), lambda s, v: s + v))
    mean = F.col("_p") + F.col("_q") - 2 * _dot(F.col("_x"), F.col("_y"))
    return pairs.select("a", "b", apart.alias("centers"), F.sqrt(F.greatest(mean, F.lit(0.0))).alias("members"))


def nearest_members(rows: DataFrame, profiles: DataFrame, id_: str, cluster: str, x: str, k: int, own: bool = False) -> DataFrame:
    """The ``k`` vectors nearest to each centre: ``cluster``, rank (from 1), ``id_``, distance; by distance, then id.

    All vectors are candidates for each centre, or with ``own`` only the cluster's members. Each task keeps its own first
    k before any row moves.
    """
    centers = profiles.select(F.col(cluster).alias("_k"), F.col("center").alias("_c"))
    joined = rows.withColumn("_k", F.col(cluster)).join(centers, "_k") if own else rows.select(id_, x, F.lit(1).alias("_all")).join(centers.withColumn("_all", F.lit(1)), "_all")
    far = F.sqrt(F.aggregate(F.zip_with(x, "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    rows = joined.select(F.col("_k").alias(cluster), id_, far.alias("distance"))
    place = F.row_number().over(Window.partitionBy(cluster).orderBy("distance", id_))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select(cluster, "rank", id_, "distance")


def upper_clusters(rows: DataFrame, target: str, score: str, share: float, x: str, components: int, k: int, seed: int = 1) -> DataFrame:
    """Rows whose score is above its target's own percentile, with ``cluster`` from principal components and k-means of each
    target's rows. A target with fewer such rows than ``components`` or ``k`` is one cluster. Targets are few: each is a fit."""
    limits = exact_percentiles(rows, score, [share], [target]).select(target, F.col("percentile").alias("_limit"))
    upper = rows.join(F.broadcast(limits), target).where(F.col(score) > F.col("_limit")).drop("_limit")  # a row a target
    parts = []
    for t, n in sorted((r[0], r["count"]) for r in upper.groupBy(target).count().collect()):
        own = upper.where(F.col(target) == t)
        parts.append(clustered(own, x, components, k, seed) if n > max(components, k) else own.withColumn("cluster", F.lit(0)))
    out = parts[0] if parts else upper.withColumn("cluster", F.lit(0))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def best_settings(scores: DataFrame, group: list[str], setting: str, bounds: tuple[float, float]) -> DataFrame:
    """``group``, n, mean_log (of the setting to base 10), at_bound: how often the search ended at a bound of its grid."""
    low, high = bounds
    edge = (F.abs(F.log10(setting) - F.log10(F.lit(low))) < 1e-9) | (F.abs(F.log10(setting) - F.log10(F.lit(high))) < 1e-9)
    return scores.groupBy(*group).agg(F.count("*").alias("n"), F.avg(F.log10(setting)).alias("mean_log"), F.count_if(edge).alias("at_bound"))
