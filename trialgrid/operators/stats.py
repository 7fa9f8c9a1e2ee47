"""Group statistics from sufficient aggregates: t tests, correlations, chi-squared, permutation p and FDR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.operators.auc import average_rank
from trialgrid.operators.quantiles import correlation


def _class_sums(rows: DataFrame, value: str, cls: str, group: list[str]) -> DataFrame:
    parts = []
    for k in (0, 1):
        x = F.when(F.col(cls) == k, F.col(value))
        parts += [F.count(x).cast("double").alias(f"n{k}"), F.avg(x).alias(f"m{k}"), F.var_samp(x).alias(f"v{k}")]
    return rows.groupBy(*group).agg(*parts)


def welch_t(rows: DataFrame, value: str, cls: str, group: list[str], least: int = 2) -> DataFrame:
    """Welch's t and degrees of freedom of class 1 against 0; null where a class has fewer than ``least`` rows."""
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    fine = (F.col("n0") >= least) & (F.col("n1") >= least) & (a + b > 0)
    df = (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))
    return _class_sums(rows, value, cls, group).select(*group, "n0", "n1", F.when(fine, (F.col("m1") - F.col("m0")) / F.sqrt(a + b)).alias("t"), F.when(fine, df).alias("df"))


def student_t(rows: DataFrame, value: str, cls: str, group: list[str]) -> DataFrame:
    """Equal-variance t of class 1 against 0."""
    df = F.col("n0") + F.col("n1") - 2
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / F.nullif(df, F.lit(0.0))
    fine = (F.col("n0") >= 2) & (F.col("n1") >= 2) & (pooled > 0)
    return _class_sums(rows, value, cls, group).select(*group, F.when(fine, (F.col("m1") - F.col("m0")) / F.sqrt(pooled * (1 / F.col("n0") + 1 / F.col("n1")))).alias("t"), F.when(fine, df).alias("df"))


def one_sample_t(rows: DataFrame, value: Column, group: list[str]) -> DataFrame:
    """t of a mean against 0; with a difference as the value it is the paired t."""
    s = rows.withColumn("_x", value).groupBy(*group).agg(F.count("_x").cast("double").alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("sd"))
    return s.select(*group, "n", "mean", F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).alias("df"))


def correlations(rows: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """Pearson and Spearman (average ranks) by group, and Spearman's t; null where a side is constant."""
    ranked = rows.withColumn("_rx", average_rank(x, group)).withColumn("_ry", average_rank(y, group))
    out = ranked.groupBy(*group).agg(F.count("*").alias("n"), correlation(x, y).alias("pearson"), correlation("_rx", "_ry").alias("spearman"))
    rho = F.col("spearman")
    return out.withColumn("t", F.when((F.abs(rho) < 1) & (F.col("n") > 2), rho * F.sqrt((F.col("n") - 2) / (1 - rho * rho))))


def pairwise_pearson(rows: DataFrame, item: str, on: str, value: str) -> DataFrame:
    """Pearson of each pair of items once (a < b) over the keys both have."""
    a = rows.select(F.col(on).alias("_on"), F.col(item).alias("a"), F.col(value).alias("x"))
    b = rows.select(F.col(on).alias("_on"), F.col(item).alias("b"), F.col(value).alias("y"))
    return a.join(b, (a["_on"] == b["_on"]) & (a["a"] < b["b"])).groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected counts of the complete grid of two columns' levels, residuals, and shares of the row."""
    seen = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("k"))
    grid = seen.select(a).distinct().crossJoin(F.broadcast(seen.select(b).distinct()))  # levels, not rows
    full = grid.join(seen, [a, b], "left").withColumn("observed", F.coalesce("k", F.lit(0)).cast("double")).drop("k")
    row, col = F.sum("observed").over(Window.partitionBy(a)), F.sum("observed").over(Window.partitionBy(b))
    total = full.agg(F.sum("observed").alias("_t"))
    out = full.withColumn("_row", row).withColumn("_col", col).crossJoin(F.broadcast(total)).withColumn("expected", F.col("_row") * F.col("_col") / F.col("_t"))
    return out.select(a, b, "observed", "expected", (F.col("observed") - F.col("expected")).alias("residual"), (F.col("observed") / F.col("_row")).alias("row_share"))


def chi_squared(table: DataFrame, a: str, b: str) -> DataFrame:
    """Statistic and degrees of freedom of a ``contingency`` table; 2 by 2 gets Yates's correction."""
    gap = F.abs("residual")
    s = table.agg(F.sum(gap * gap / F.col("expected")).alias("plain"), F.sum(F.pow(gap - F.least(F.lit(0.5), gap), F.lit(2)) / F.col("expected")).alias("yates"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"))
    df = (F.col("r") - 1) * (F.col("c") - 1)
    return s.select(F.when(df == 1, F.col("yates")).otherwise(F.col("plain")).alias("chi2"), df.cast("long").alias("df"))


def permutation_p(true: DataFrame, permuted: DataFrame, key: list[str], value: str) -> DataFrame:
    """(number of permuted values at or above the true one + 1) / (number of permutations + 1); key, value, p."""
    k = permuted.agg(F.count_distinct("permutation").alias("_k"))
    hits = true.select(*key, value).join(permuted.select(*key, F.col(value).alias("_v")), key, "left").groupBy(*key, value).agg(F.count_if(F.col("_v") >= F.col(value)).alias("_h"))
    return hits.crossJoin(F.broadcast(k)).select(*key, value, ((F.col("_h") + 1) / (F.col("_k") + 1)).alias("p"))


def false_discovery(rows: DataFrame, p: str, key: list[str], alpha: float = 0.05, buckets: int = 4096) -> DataFrame:
    """Benjamini-Hochberg q, its flag, and Bonferroni's product. One row per test; q depends on p alone.

    Distinct p are ranked by bucket of their value, and only the buckets' sizes and minima are in one task. A null p
    counts as a test, has no place among the others, and its q is 1.
    """
    m = F.broadcast(rows.agg(F.count("*").alias("_m")))  # one row
    by = rows.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n")).withColumn("_b", F.floor(F.col("_p") * buckets))
    sizes = by.groupBy("_b").agg(F.sum("_n").alias("_size"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_b", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    upto = F.sum("_n").over(Window.partitionBy("_b").orderBy("_p")) + F.col("_before")
    by = by.join(sizes, "_b").crossJoin(m).withColumn("_x", F.col("_p") * F.col("_m") / upto)
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    rest = by.groupBy("_b").agg(F.min("_x").alias("_x")).select("_b", F.min("_x").over(later).alias("_rest"))
    own = F.min("_x").over(Window.partitionBy("_b").orderBy(F.desc("_p")))
    q = by.join(rest, "_b").select(F.col("_p").alias(p), F.least(own, "_rest").alias("q"))
    out = rows.join(q, p, "left").crossJoin(m).withColumn("q", F.least(F.lit(1.0), "q"))
    return out.withColumn("bonferroni", F.col(p) * F.col("_m")).withColumn("significant", F.col("q") < alpha).drop("_m")


def polarity(rows: DataFrame, value: str, cls: str, group: list[str]) -> DataFrame:
    """Sign of the class-1 mean less the class-0 mean (null if one is missing), d-prime and both deviations."""
    s = _class_sums(rows, value, cls, group)
    gap = F.col("m1") - F.col("m0")
    return s.select(*group, F.signum(F.round(gap, 9)).alias("polarity"), (gap / F.nullif(F.sqrt((F.col("v1") + F.col("v0")) / 2), F.lit(0.0))).alias("d_prime"), F.sqrt("v0").alias("sd0"), F.sqrt("v1").alias("sd1"))


def r_squared(rows: DataFrame, y: str, predicted: str, group: list[str]) -> DataFrame:
    """1 - residual / total sum of squares by group; negative values become null."""
    s = rows.groupBy(*group).agg(F.sum(F.pow(F.col(y) - F.col(predicted), F.lit(2))).alias("e"), (F.var_pop(y) * F.count(y)).alias("t"))
    r = 1 - F.col("e") / F.nullif(F.col("t"), F.lit(0.0))
    return s.select(*group, F.when(r >= 0, r).alias("r2"))
