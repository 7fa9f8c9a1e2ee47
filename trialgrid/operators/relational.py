"""Relational building blocks: complete grids, pivots, differences from a reference row, ranges, sampling, quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.operators.quantiles import exact_percentiles, group_key

#: Numbers of an order that any engine can reproduce: a hash of the key and a seed by squares modulo a prime. Every step
#: stays in 64 bits. Squaring twice with a shift between makes the orders of different seeds unlike each other; a seed
#: that is only added would turn the whole order by a little.
KEY_MODULUS, SEED_STEP, SHIFT, MULTIPLIER, HASH_MODULUS = 1000000007, 7919, 40503, 48271, 2147483647


def hash_order(key: str | Column, seed: int | str | Column = 0) -> Column:
    """A hash of an integer key, from 0 up to HASH_MODULUS; equal hashes are rare but possible."""
    key = F.col(key) if isinstance(key, str) else key
    seed = F.lit(seed) if isinstance(seed, int) else F.col(seed) if isinstance(seed, str) else seed
    x = F.pmod(key.cast("long"), F.lit(KEY_MODULUS)) + seed.cast("long") * SEED_STEP + 1
    x = (x * x % F.lit(HASH_MODULUS) + SHIFT) * MULTIPLIER % F.lit(HASH_MODULUS)
    return x * x % F.lit(HASH_MODULUS)


def seeded_places(rows: DataFrame, group: list[str], order: Column, key: str, out: str = "place", most: int = 1 << 17) -> DataFrame:
    """``rows`` with their place from 1 in the group, by ``order`` (0 up to HASH_MODULUS), then ``key``.

    Rows are ranked in buckets of the order and the buckets' sizes are summed up, about ``most`` rows a bucket: a hash
    spreads any group evenly, so no group is one task. Where the table fits one bucket it is a plain window.
    """
    buckets = max(1, -(-rows.count() // most))
    named = rows.withColumn("_o", order)
    if buckets == 1:
        return named.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy("_o", key))).drop("_o")
    named = named.withColumn("_b", F.floor(F.col("_o") * F.lit(buckets) / F.lit(HASH_MODULUS))).withColumn("_g", group_key(group))
    sizes = named.groupBy("_g", "_b").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_f", F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_o", key))
    placed = named.withColumn("_in_bucket", inside).join(sizes.select("_g", "_b", "_f"), ["_g", "_b"])
    return placed.withColumn(out, (F.col("_f") + F.col("_in_bucket")).cast("int")).drop("_o", "_b", "_g", "_f", "_in_bucket")


def sampled(df: DataFrame, stratum: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each stratum without replacement, in seeded order."""
    by = Window.partitionBy(*stratum).orderBy(hash_order(key, seed), key)
    return df.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).drop("_n")


def matched_sample(df: DataFrame, wanted: DataFrame, stratum: list[str], key: str, seed: int = 0, most: int = 1 << 17) -> DataFrame:
    """As many rows of each stratum as ``wanted`` (stratum, k) says; with replacement, in turn, where there are too few."""
    rows = seeded_places(df, stratum, hash_order(key, seed), key, "_i", most).withColumn("_i", F.col("_i") - 1)
    draws = wanted.where("k > 0").select(*stratum, F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("draw"))
    sizes = df.groupBy(*stratum).agg(F.count("*").alias("_size"))
    picks = draws.join(sizes, stratum).withColumn("_i", F.pmod(F.col("draw"), F.col("_size")).cast("int")).drop("_size")
    return picks.join(rows, [*stratum, "_i"]).drop("_i")


def split(df: DataFrame, label: list[str], key: str, share: float = 0.8, seeds: tuple[int, ...] = (0, 1, 2, 3, 4)) -> DataFrame:
    """Repeated stratified split: a row per seed with ``seed`` and ``train``."""
    rows = df.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    order = hash_order(key, "seed")
    sizes = df.groupBy(*label).agg(F.floor(F.count("*") * share + 0.5).alias("_train")).select(group_key(label).alias("_l"), "_train")
    placed = seeded_places(rows, ["seed", *label], order, key, "_n").withColumn("_l", group_key(label)).join(sizes, "_l")
    return placed.withColumn("train", F.col("_n") <= F.col("_train")).drop("_n", "_l", "_train")


def paired(a: DataFrame, b: DataFrame, stratum: list[str], order_a: list[str], order_b: list[str]) -> DataFrame:
    """Two populations paired by place within the stratum: stratum, place, and both sides' rows."""
    place = lambda order: F.row_number().over(Window.partitionBy(*stratum).orderBy(*order))
    return a.withColumn("place", place(order_a)).join(b.withColumn("place", place(order_b)), [*stratum, "place"])


def ambiguous_steps(trials: DataFrame, least: int = 2, key: tuple[str, ...] = ("subject", "pair", "word")) -> DataFrame:
    """Steps other than 1 and 6 with both responses, the rarer one more than ``least`` times: key, steps."""
    c = trials.where("step not in (1, 6)").groupBy(*key, "step").agg(F.count_if(F.col("response") == 1).alias("y"), F.count_if(F.col("response") == 0).alias("n"))
    return c.where(F.least("y", "n") > least).groupBy(*key).agg(F.array_sort(F.collect_list("step")).alias("steps"))


def proportions(df: DataFrame, group: list[str], level: str) -> DataFrame:
    """Count and share of each level in each group, with the levels a group doesn't have as 0."""
    grid = df.select(*group).distinct().crossJoin(F.broadcast(df.select(level).distinct()))  # levels are few
    out = grid.join(df.groupBy(*group, level).agg(F.count("*").alias("k")), [*group, level], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return out.withColumn("share", F.col("k") / F.sum("k").over(Window.partitionBy(*group)))


def pivot_gap(df: DataFrame, group: list[str], source: str, sides: tuple[str, str], value: str) -> DataFrame:
    """Mean by source side by side, and the first less the second; groups that miss a side go."""
    out = df.groupBy(*group).pivot(source, list(sides)).agg(F.avg(value)).toDF(*group, "a", "b").na.drop(subset=["a", "b"])
    return out.withColumn("gap", F.col("a") - F.col("b"))


def from_reference(df: DataFrame, group: list[str], name: str, reference: Column, value: str) -> DataFrame:
    """Each row's value less that of the group's reference row, then the mean by name and the largest one."""
    ref = df.where(reference).groupBy(*group).agg(F.avg(value).alias("_ref"))
    gaps = df.where(~reference).join(ref, group).withColumn("gap", F.col(value) - F.col("_ref"))
    return gaps.groupBy(name).agg(F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"))


def recoded(df: DataFrame, keys: list[str], fixes: DataFrame, column: str) -> DataFrame:
    """Overrides of a column by key: ``fixes`` has the keys and ``fixed``. A key not listed keeps its value."""
    return df.join(fixes, keys, "left").withColumn(column, F.coalesce("fixed", column)).drop("fixed")


def quantile_bins(df: DataFrame, value: str, n: int) -> DataFrame:
    """Bin 0..n-1 by exact quantile cut points (equal ones count once), right-closed, and the bin's midpoint."""
    found = exact_percentiles(df, value, [i / n for i in range(n + 1)])  # a row a cut
    cuts = found.agg(F.array_distinct(F.array_sort(F.collect_list("percentile"))).alias("_c"))
    x = F.col(value)
    rows = df.crossJoin(F.broadcast(cuts)).withColumn("bin", F.greatest(F.lit(0), F.size(F.filter("_c", lambda c: c < x)) - 1))
    return rows.withColumn("mid", (F.get("_c", F.col("bin")) + F.get("_c", F.col("bin") + 1)) / 2).drop("_c")


def equal_bins(df: DataFrame, value: str, n: int) -> DataFrame:
    """Right-closed bins of equal width over the value's range: bin 0..n-1."""
    s = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rows = df.crossJoin(F.broadcast(s))
    place = F.ceil((F.col(value) - F.col("_lo")) / F.nullif((F.col("_hi") - F.col("_lo")) / n, F.lit(0.0)))
    return rows.withColumn("bin", F.coalesce(F.least(F.greatest(place - 1, F.lit(0)), F.lit(n - 1)), F.lit(0)).cast("int")).drop("_lo", "_hi")


def quality_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row per rule: how many rows break it (null counts as broken), and whether all pass."""
    broken = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    long = df.agg(*broken).unpivot([], list(rules), "rule", "n_broken")
    return long.withColumn("passed", F.col("n_broken") == 0)


def unique_key_report(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys in more than one row, with how many."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
