"""Exact percentiles and ranks of groups of any size, without a task that holds a group's values.

Percentiles: every group keeps, for each rank that is asked for, the interval that holds it. A pass over the rows counts
them by bin of the interval (partial counts are merged like any sum) and the interval shrinks to the one bin that holds
the rank, with that bin's own least and largest value as its ends. It ends when both are equal, or when the bin has so
few rows that they can be ordered. The first bins are of equal width in the logarithm, so that values of all magnitudes
part, later ones of equal width in the value. Both are monotone, so the result is exact whatever the values'
distribution, and a double's 52 bits are used up after seven passes.

Ranks: distinct values with their counts are dealt to ranges, ordered in each, and the ranges' sizes are summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.sources.storage import stored

BINS = 1024
#: First bins in each doubling of the value.
OCTAVE = 64
#: Rows of one bin that are ordered in one task.
SMALL = 50_000
#: Rows of a table of intervals that is broadcast.
BROADCAST_ROWS = 100_000


def group_key(group: list[str]) -> Column:
    """The group as one column that equals itself also where parts of it are null."""
    return F.struct(*[F.col(g) for g in group]) if group else F.struct(F.lit(0).alias("all"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's r as an aggregate; null where a side is constant."""
    both = F.var_pop(x) * F.var_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.when((F.var_pop(x) > 1e-12) & (F.var_pop(y) > 1e-12), both)))


def exact_percentiles(rows: DataFrame, value: str | Column, shares: list[float], group: list[str] | None = None, bins: int = BINS, small: int = SMALL) -> DataFrame:
    """``group``, share, percentile: a row for each group and share, interpolated between the two ranks around it.

    Null, NaN and infinite values don't count; a group without others gives no rows, an empty table neither. A null in
    the group is a value like any other. At most two intervals a share are open in a group at a time.
    """
    group = list(group or [])
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    live = rows.select(*group, v.alias("_v")).where(F.abs("_v") < F.lit(float("inf"))).select(group_key(group).alias("_g"), "_v")
    live = live.where("not isnan(_v)")
    ends = stored(live.groupBy("_g").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    places = [F.struct(F.lit(s).alias("share"), ((F.col("n") - 1) * F.lit(s)).alias("at")) for s in shares]
    asked = ends.select("_g", F.inline(F.array(*places)))
    ranks = asked.select("_g", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("k")).distinct()
    at = stored(ranks.join(ends, "_g").select("_g", "k", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")))
    first = True
    while True:
        still = at.where("lo < hi")
        found = still.agg(F.max("inside").alias("most"), F.count("*").alias("n")).first()
        if not found.n:
            break
        open_ = still.select("_g", "lo", "hi").distinct()
        near = live.join(_small(open_, found.n), "_g").where("_v between lo and hi")
        if found.most <= small:
            place = F.row_number().over(Window.partitionBy("_g", "lo", "hi").orderBy("_v")) - 1
            picked = near.withColumn("_i", place).join(_small(still, found.n), ["_g", "lo", "hi"]).where("_i = k - before")
            at = at.where("lo = hi").unionByName(picked.select("_g", "k", F.col("_v").alias("lo"), F.col("_v").alias("hi"), "before", "inside"))
            break
        width = F.col("hi") - F.col("lo")
        part = F.when(width < float("inf"), (F.col("_v") - F.col("lo")) / width).otherwise((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))
        size = F.floor(F.log2(F.nullif(F.abs("_v"), F.lit(0.0))) * OCTAVE) + 1100 * OCTAVE
        bin_ = F.coalesce(size * F.signum("_v"), F.lit(0.0)) if first else F.least(F.floor(part * bins), F.lit(bins - 1))
        first = False
        counts = near.groupBy("_g", "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        run = Window.partitionBy("_g", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("below", F.coalesce(F.sum("c").over(run), F.lit(0)))
        hit = still.join(counts, ["_g", "lo", "hi"]).where("k >= before + below and k < before + below + c")
        at = stored(at.where("lo = hi").unionByName(hit.select("_g", "k", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("before") + F.col("below")).alias("before"), F.col("c").alias("inside"))))
    values = at.select("_g", "k", F.col("lo").alias("x"))
    low, high = values.select("_g", F.col("k").alias("k0"), F.col("x").alias("x0")), values.select("_g", F.col("k").alias("k1"), F.col("x").alias("x1"))
    out = asked.withColumn("k0", F.floor("at")).withColumn("k1", F.ceil("at")).join(low, ["_g", "k0"]).join(high, ["_g", "k1"])
    rest = F.col("at") - F.col("k0")
    return out.select(*[F.col(f"_g.{g}").alias(g) for g in group], "share", (F.col("x0") * (1 - rest) + F.col("x1") * rest).alias("percentile"))


def percentile_columns(rows: DataFrame, value: str | Column, shares: dict[str, float], group: list[str] | None = None) -> DataFrame:
    """As ``exact_percentiles``, a row a group with a column for each named share."""
    group = list(group or [])
    found = exact_percentiles(rows, value, sorted(set(shares.values())), group)
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("share") == s, F.col("percentile"))).alias(name) for name, s in shares.items()])


def value_ranks(rows: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """``group``, ``value``, before, n: each distinct value that isn't null, the rows of its group below it, and its own."""
    group = list(group or [])
    # stored, as ranges are found by a pass of their own
    counts = stored(rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n")))
    spark = rows.sparkSession
    dealt = stored(counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *group, value).withColumn("_p", F.spark_partition_id()).withColumn("_g", group_key(group)))
    sizes = dealt.groupBy("_g", "_p").agg(F.sum("n").alias("_n"))
    earlier = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_p", "_g").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = dealt.withColumn("_in", inside).join(earlier.select("_g", "_p", "_b"), ["_g", "_p"])
    return out.select(*group, value, (F.col("_b") + F.col("_in")).alias("before"), "n")


def average_ranks(rows: DataFrame, value: str, group: list[str], out: str) -> DataFrame:
    """``rows`` with the average rank (from 1, ties shared) of ``value`` in its group; null where it is null."""
    key = F.struct(*[F.col(c) for c in [*group, value]])
    ranks = value_ranks(rows, value, group).select(key.alias("_k"), (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    return rows.withColumn("_k", key).join(ranks, "_k", "left").drop("_k")
