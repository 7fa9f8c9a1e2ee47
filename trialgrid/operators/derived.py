"""Small operators on result tables: recodes, cleaning, unions, percentile filters, partitions and paired statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.operators.quantiles import exact_percentiles


def site_key(*parts: Column) -> Column:
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def consistent(trials: DataFrame) -> DataFrame:
    """Without trials whose response contradicts an unambiguous step: step 1 with response 1, step 6 with response 0."""
    return trials.where("not (step = 1 and response = 1) and not (step = 6 and response = 0)")


def polarity_code(x: Column) -> Column:
    return F.when(x == "+", 1).when(x == "-", -1).otherwise(0)


def clean_effects(rows: DataFrame) -> DataFrame:
    """Curated effects (left, right: + or - or null; pattern, tracks, pair, tuning) with flags; dropped patterns go.

    A side other than +, - or null ends the job with an error.
    """
    known = lambda c: F.when(F.col(c).isNull() | F.col(c).isin("+", "-"), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("not a polarity: "), c)).cast("string"))
    rows = rows.where(F.col("pattern").isNotNull() & ~F.col("pattern").isin("drop", "dupe"))
    rows = rows.withColumn("left_polarity", polarity_code(known("left"))).withColumn("right_polarity", polarity_code(known("right")))
    total, one = F.col("left_polarity") + F.col("right_polarity"), F.abs("left_polarity") + F.abs("right_polarity") == 1
    rows = rows.withColumn("one_sided_positive", one & (total == 1)).withColumn("one_sided_negative", one & (total == -1))
    rows = rows.withColumn("tracking", F.col("tracks").isNull() | (F.col("tracks") != "n"))
    letter = lambda k: F.regexp_extract("pair", "([a-z])([a-z])", k)
    above = lambda x, y: F.concat(F.lit("/"), x, F.lit("/ > /"), y, F.lit("/"))
    rows = rows.withColumn("left_dominant", F.coalesce(F.col("tuning") == above(letter(1), letter(2)), F.lit(False)))
    return rows.withColumn("right_dominant", F.coalesce(F.col("tuning") == above(letter(2), letter(1)), F.lit(False))).withColumn("tuned_both", F.col("tuning").contains("="))


def split_default(x: Column, sep: str, default: str, recode: dict[str, str]) -> tuple[Column, Column]:
    """What stands before the first ``sep``, and after it: ``default`` if nothing does, recoded by a map."""
    parts = F.split(x, sep, 2)
    tail = F.get(parts, 1)
    for old, new in recode.items():
        tail = F.when(tail == old, new).otherwise(tail)
    return F.get(parts, 0), F.coalesce(tail, F.lit(default))


def winning_side(rows: DataFrame, value: str, companions: list[str]) -> DataFrame:
    """Of value_left and value_right the smaller one (left on ties), its side, and each companion of that side."""
    left = F.col(f"{value}_left") <= F.col(f"{value}_right")
    out = rows.withColumn(f"{value}_min", F.least(f"{value}_left", f"{value}_right")).withColumn("side", F.when(left, "left").otherwise("right"))
    return out.withColumns({c: F.when(left, F.col(f"{c}_left")).otherwise(F.col(f"{c}_right")) for c in companions})


def margin_preference(sides: dict[str, Column], third: Column, third_name: str, margin: float) -> Column:
    """The larger of two named columns if it is above a third by the margin, the third if below it by that, else none."""
    (a, x), (b, y) = sides.items()
    gap = F.greatest(x, y) - third
    return F.when(gap > margin, F.when(x >= y, a).otherwise(b)).when(gap < -margin, third_name).otherwise("none")


def filtered(rows: DataFrame, condition: str | None) -> DataFrame:
    """Rows that meet a user's condition, written as SQL; all without one."""
    return rows.where(condition) if condition else rows


def labelled_union(tables: dict[str, DataFrame], label: str | None) -> DataFrame:
    """Tables one under the other by column name, missing columns null, with each one's name in ``label``."""
    named = [t.withColumn(label, F.lit(name)) if label else t for name, t in tables.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), named)


def early_late(rows: DataFrame, key: list[str], at: str, latest: int, gap: int) -> DataFrame:
    """Each early row (``at`` up to ``latest``) with the row ``gap`` later, columns named by side."""
    rest = [c for c in rows.columns if c not in key]
    early = rows.where(F.col(at) <= latest).withColumnsRenamed({c: f"{c}_early" for c in rest})
    late = rows.withColumnsRenamed({c: f"{c}_late" for c in rest}).withColumn(f"{at}_early", F.col(f"{at}_late") - gap)
    return early.join(late, [*key, f"{at}_early"])


def changed(column: str, group: list[str], order: list[str]) -> Column:
    """Whether a column differs from that of the row before it in its group."""
    return F.coalesce(F.col(column) != F.lag(column).over(Window.partitionBy(*group).orderBy(*order)), F.lit(False))


def above_percentile(scores: DataFrame, score: str, q: float) -> DataFrame:
    """Rows of a table of group scores above its own percentile."""
    limit = exact_percentiles(scores, score, [q]).select(F.col("percentile").alias("_limit"))  # one row
    return scores.crossJoin(F.broadcast(limit)).where(F.col(score) > F.col("_limit")).drop("_limit")


def repeats(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys of more than one row: a join on them isn't many-to-one."""
    return rows.groupBy(*key).count().where("count > 1").drop("count")


def counted_partition(rows: DataFrame, parts: dict[str, Column], group: list[str]) -> DataFrame:
    """Rows of each part by group, and n. A row in no part or in two of them ends the job with an error."""
    hits = reduce(lambda x, y: x + y, [F.coalesce(c, F.lit(False)).cast("int") for c in parts.values()])
    checked = rows.withColumn("_hits", F.when(hits == 1, 1).otherwise(F.raise_error(F.lit("the parts don't divide the rows")).cast("int")))
    return checked.groupBy(*group).agg(*[F.count_if(c).alias(name) for name, c in parts.items()], F.sum("_hits").alias("n"))


def counterfactual_z(observed: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """An observed correlation (key, r) against counterfactual ones (key, r): true_r, z_mean, z_sd, n, z, df."""
    z = others.groupBy(*key).agg(F.avg(F.atanh("r")).alias("z_mean"), F.stddev_samp(F.atanh("r")).alias("z_sd"), F.count("r").alias("n"))
    rows = observed.withColumnRenamed("r", "true_r").join(z, key, "full").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("z", (F.atanh("true_r") - F.col("z_mean")) / F.nullif(F.col("z_sd"), F.lit(0.0))).withColumn("df", F.col("n") - 1)


def nested_gains(fits: DataFrame, key: list[str], model: str) -> DataFrame:
    """Of models by number (r2, rss): what each adds to the one before it."""
    before = fits.select(*key, (F.col(model) + 1).alias(model), F.col("r2").alias("_r2"), F.col("rss").alias("_rss"))
    return fits.join(before, [*key, model]).select(*key, model, (F.col("r2") - F.col("_r2")).alias("r2_gain"), (F.col("_rss") - F.col("rss")).alias("rss_drop"))
