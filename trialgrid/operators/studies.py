"""Designs and studies: literal tables, balance and level checks, coverage, re-scored values, unique variance, memberships,
study filters and the relation of two preferences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows: str | dict | list[tuple], schema: str) -> DataFrame:
    """A small table written in the code: a mapping (key, value), tuples, or lines of comma-separated text.

    Blank lines go, blanks around a field too; fields are cast to ``schema``, and what can't be cast is null.
    """
    if isinstance(rows, str):
        lines = spark.createDataFrame([(line,) for line in rows.splitlines() if line.strip()], "line string")
        options = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
        return lines.select(F.from_csv("line", schema, options).alias("row")).select("row.*")
    return spark.createDataFrame(list(rows.items()) if isinstance(rows, dict) else rows, schema)


def sibling_path(path: Column, root: Column, suffixes: tuple[str, str]) -> Column:
    """A path below its root, with another suffix. A path that has neither stays as it is."""
    old, new = suffixes
    below = F.when(F.length(root) > 0, F.replace(path, root, F.lit(""))).otherwise(path)
    return F.when(F.endswith(below, F.lit(old)), F.concat(F.substring(below, F.lit(1), F.length(below) - len(old)), F.lit(new))).otherwise(below)


def code_labels(rows: DataFrame, labels: dict[str, dict[int, str]], arrow: str, answer: str) -> DataFrame:
    """For each column of codes a column ``<name>_label``, and ``arrow``: the labels joined by an arrow, then the answer.

    A code without a label, or null, has a null label and is left out of the arrow label.
    """
    for column, names in labels.items():
        rows = rows.withColumn(f"{column}_label", F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col(column)))
    return rows.withColumn(arrow, F.concat_ws(" ", F.concat_ws("→", *[f"{c}_label" for c in labels]), F.concat(F.lit("("), answer, F.lit(")"))))


def with_data(items: DataFrame, sizes: DataFrame, subject: str, position: str) -> DataFrame:
    """Items whose position is below the number of channels of their subject; ``sizes``: subject, n_channels, a row each.
    Subjects without a size have no data."""
    return items.join(sizes.select(subject, "n_channels"), subject).where(F.col(position) < F.col("n_channels"))


def balance_report(rows: DataFrame, cues: list[str], group: str, tolerance: float = 1e-6) -> DataFrame:
    """By cue, over all rows and by group: scope, group, cue, low, high, mean, spans (from -1 to 1) and balanced (mean 0).

    All scopes come from one shuffle of partial sums. The scope tells a null group from all rows; no rows, no report.
    """
    seen = [F.struct(F.lit(c).alias("cue"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.avg(c).alias("mean")).alias(f"_{i}") for i, c in enumerate(cues)]
    sums = rows.rollup(group).agg(F.when(F.grouping(group) == 1, "all").otherwise("group").alias("scope"), *seen)
    long = sums.select("scope", group, F.explode(F.array(*[f"_{i}" for i in range(len(cues))])).alias("of")).select("scope", group, "of.*")
    spans = (F.abs(F.col("low") + 1) <= tolerance) & (F.abs(F.col("high") - 1) <= tolerance)
    return long.withColumn("spans", spans).withColumn("balanced", F.abs("mean") <= tolerance)


def level_report(rows: DataFrame, group: list[str], level: str) -> DataFrame:
    """Whether a group's levels are exactly 1 to their maximum: n_levels, highest, missing (sorted), contiguous.

    Null levels don't count; a group with none but those has no highest level and isn't contiguous. Levels are few.
    """
    out = rows.groupBy(*group).agg(F.collect_set(level).alias("_s"))
    out = out.select(*group, F.size("_s").alias("n_levels"), F.array_max("_s").alias("highest"), "_s")
    wanted = F.when(F.col("highest") >= 1, F.sequence(F.lit(1).cast("long"), F.col("highest").cast("long")))
    missing = F.coalesce(F.array_except(wanted, F.transform("_s", lambda x: x.cast("long"))), F.array().cast("array<bigint>"))
    return out.withColumn("missing", missing).withColumn("contiguous", F.coalesce((F.size("missing") == 0) & (F.array_min("_s") == 1), F.lit(False))).drop("_s")


def coverage_report(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Each key found in any table: key, tables (sorted names of those that have it), complete (all have it)."""
    parts = [table.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_t", F.lit(name)) for name, table in tables.items()]
    found = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.array_sort(F.collect_list("_t")).alias("tables"))
    return found.withColumn("complete", F.size("tables") == len(tables))


def rescored_report(stored: DataFrame, again: DataFrame, key: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Stored values beside those computed again: key, stored, again, status (same, differs, only stored, only again).

    Two nulls are the same; a null beside a value differs.
    """
    a = stored.select(*key, F.col(value).alias("stored"), F.lit(True).alias("_a"))
    b = again.select(*key, F.col(value).alias("again"), F.lit(True).alias("_b"))
    near = F.coalesce(F.abs(F.col("stored") - F.col("again")) <= tolerance, F.col("stored").isNull() & F.col("again").isNull())
    status = F.when(F.col("_b").isNull(), "only stored").when(F.col("_a").isNull(), "only again").when(near, "same").otherwise("differs")
    return a.join(b, key, "full").select(*key, "stored", "again", status.alias("status"))


def unique_variance(scores: DataFrame, site: list[str], fold: str, dropped: str, score: str) -> DataFrame:
    """A block's unique variance at a site: mean over folds of the score of the fit named for it, less that of the fit
    whose ``dropped`` is null. ``share``: its part of the site's sum of positive ones; null without any. Folds that lack
    either fit don't count."""
    base = scores.where(F.col(dropped).isNull()).select(*site, fold, F.col(score).alias("_base"))
    gains = scores.where(F.col(dropped).isNotNull()).join(base, [*site, fold]).groupBy(*site, dropped)
    out = gains.agg(F.avg(F.col(score) - F.col("_base")).alias("unique_variance"), F.count("*").alias("n_folds"))
    positive = F.greatest(F.col("unique_variance"), F.lit(0.0))
    total = F.sum(positive).over(Window.partitionBy(*site))  # a site has a row per block
    return out.withColumn("share", positive / F.nullif(total, F.lit(0.0)))


def responsive_sites(variances: DataFrame, site: list[str], least: float) -> DataFrame:
    """Sites with a block above ``least``, with their largest unique variance."""
    return variances.where(F.col("unique_variance") > least).groupBy(*site).agg(F.max("unique_variance").alias("unique_variance"))


def membership_rows(selected: DataFrame, block: str, members: DataFrame, cluster: str, site: list[str], subject: str, marginals: dict[str, DataFrame | None]) -> DataFrame:
    """cluster, column: a row for each selected site in a cluster under its block, and one under each marginal's name for
    each member of a subject with selected sites; a marginal with a table counts only the sites in it.

    A site selected under several blocks counts under each. ``stats.contingency`` makes the table; a cluster no column
    counts isn't in it.
    """
    out = selected.select(*site, F.col(block).alias("column")).join(members.select(*site, cluster), site).select(cluster, "column")
    known = members.join(selected.select(subject).distinct(), subject, "left_semi")
    for name, only in marginals.items():
        rows = known if only is None else known.join(only.select(*site).distinct(), site, "left_semi")
        out = out.union(rows.select(cluster, F.lit(name)))
    return out


def study_verdict(p: str, control: str, alpha: float = 0.05, least_control: float = 0.05) -> Column:
    """Why a result is in a study or isn't: the control test must not be anywhere near good, nor better than the result."""
    a, b = F.col(p), F.col(control)
    return (
        F.when(a.isNull() | b.isNull(), "untested").when(b <= least_control, "control significant").when(a >= b, "control as good")
        .when(a >= alpha, "not significant").otherwise("kept")
    )


def log_study(p: str, control: str, most_log: float, least_log: float) -> Column:
    """The same by natural logarithms: result below one bound and control above the other; null where a p isn't positive."""
    return (F.log(F.nullif(F.col(p), F.lit(0.0))) < most_log) & (F.log(F.nullif(F.col(control), F.lit(0.0))) > least_log)


def best_window(rows: DataFrame, site: list[str], window: str, p: str, control: str) -> DataFrame:
    """A site's least p with its window (the first of equals) and the least p of the control over all windows."""
    best = F.min(F.struct(F.col(p), F.col(window)))
    out = rows.where(F.col(p).isNotNull()).groupBy(*site).agg(best.alias("_b"), F.min(control).alias(f"least_{control}"))
    return out.select(*site, F.col("_b")[window].alias(window), F.col("_b")[p].alias(f"least_{p}"), f"least_{control}")


def measure_of(outcomes: DataFrame, measure: str) -> DataFrame:
    """Predictions of one measure, without the measure column. The filter reaches the scan of ``outcomes``."""
    return outcomes.where(F.col("measure") == measure).drop("measure")


def preference_relation(early: DataFrame, late: DataFrame, key: list[str], labels: dict[int, str]) -> DataFrame:
    """How often each early polarity goes with each late one: early_selectivity, late_selectivity, n; every pair of
    ``labels`` is there, with 0 where it wasn't seen. Polarities without a label don't count."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    a = early.select(*key, F.element_at(names, F.col("early_polarity").cast("int")).alias("early_selectivity"))
    b = late.select(*key, F.element_at(names, F.col("late_polarity").cast("int")).alias("late_selectivity"))
    seen = a.join(b, key).groupBy("early_selectivity", "late_selectivity").agg(F.count("*").alias("n"))
    grid = early.sparkSession.createDataFrame([(x, y) for x in labels.values() for y in labels.values()], "early_selectivity string, late_selectivity string")
    return grid.join(seen, ["early_selectivity", "late_selectivity"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def congruency_counts(relation: DataFrame) -> DataFrame:
    """One row from a ``preference_relation``: congruent (same selectivity) and incongruent counts."""
    same = F.col("early_selectivity") == F.col("late_selectivity")
    return relation.agg(F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)).alias("congruent"), F.coalesce(F.sum(F.when(~same, F.col("n"))), F.lit(0)).alias("incongruent"))


def many_positive(rows: DataFrame, columns: list[str], least: int = 2) -> DataFrame:
    """Rows with ``least`` positive columns or more: n_positive, and row_mean over the columns that aren't null."""
    count = reduce(Column.__add__, [F.coalesce(F.col(c) > 0, F.lit(False)).cast("int") for c in columns])
    known = reduce(Column.__add__, [F.col(c).isNotNull().cast("int") for c in columns])
    total = reduce(Column.__add__, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    return rows.withColumn("n_positive", count).where(F.col("n_positive") >= least).withColumn("row_mean", total / known)
