"""Peak tables with bounds, the predictions at peaks, polarity and regression tables, window comparisons, populations of sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.operators.auc import best_row


def bounded_peaks(means: DataFrame, ends: DataFrame, site: list[str], condition: list[str], score: str, first: int, cut: float) -> DataFrame:
    """The best window of each ``site`` among those from ``first`` on that end (``smax``) no later than the latest end of the
    site's condition and score ``cut`` or more; equal scores go to the earlier window. A condition without an end has no peak.

    ``means``: site (which holds ``condition``), smin, smax, score; ``ends``: condition, end, in any number of rows.
    """
    latest = ends.groupBy(*condition).agg(F.max("end").alias("_end"))
    rows = means.join(latest, condition).where((F.col("smin") >= first) & (F.col("smax") <= F.col("_end")) & (F.col(score) >= cut))
    return best_row(rows, site, [F.desc(score), F.col("smin")]).drop("_end")


def at_peaks(peaks: DataFrame, predictions: DataFrame, key: list[str], trials: DataFrame | None = None, trial: list[str] | None = None, word: str | None = None) -> DataFrame:
    """All predictions of the peaks' windows: ``peaks`` left join ``predictions`` on ``key``, then left join ``trials`` on ``trial``.

    ``word``: the peaks have a column of this name that isn't in ``key``; only predictions of trials with that word stay,
    so peaks without any go. Else a peak without predictions is a row of nulls. Keys that are null meet nothing.
    """
    own = peaks.withColumnRenamed(word, "_word") if word else peaks
    rows = own.join(predictions, key, "left")
    rows = rows.join(trials, trial, "left") if trials is not None else rows
    return rows.where(F.col(word) == F.col("_word")).drop("_word") if word else rows


def polarity_between(rows: DataFrame, key: list[str], value: str, side: str, out: str) -> DataFrame:
    """``key``, ``out``: the sign of the mean of ``value`` where ``side`` is 1 less that where it is 0; keys that lack a side are left out."""
    mean = lambda k: F.avg(F.when(F.col(side) == k, F.col(value)))
    gap = rows.groupBy(*key).agg((mean(1) - mean(0)).alias("_gap")).where("_gap is not null")
    return gap.select(*key, F.signum("_gap").cast("int").alias(out))


def in_steps(step: str, steps: str) -> Column:
    """Whether a step is one of its row's list; null where there is no list."""
    return F.array_contains(steps, F.col(step).cast("int"))


def regression_table(rows: DataFrame, steps: DataFrame, key: list[str], early: str, late: str, step: str, target: str, choice: str, consistent: Column, ends: tuple[int, int] = (1, 6)) -> DataFrame:
    """Trials with both polarities, signed values and is_ambiguous.

    The early polarity is that of ``early`` between the targets, over consistent trials of the end steps; the late one that
    of ``late`` between the choices, over trials whose step is in the key's list (``steps``: key, steps). Keys that lack
    either polarity are left out; is_ambiguous is null for none of the rest.
    """
    listed = rows.join(steps, key, "left").withColumn("is_ambiguous", in_steps(step, "steps"))
    first = polarity_between(rows.where(F.col(step).isin(*ends) & consistent), key, early, target, "early_polarity")
    second = polarity_between(listed.where("is_ambiguous"), key, late, choice, "late_polarity")
    out = listed.join(first, key).join(second, key).drop("steps")
    return out.withColumn("early_signed", F.col(early) * F.col("early_polarity")).withColumn("late_signed", F.col(late) * F.col("late_polarity"))


def window_comparison(scores: DataFrame, windows: dict[str, Column], subject: str, site: list[str], value: str) -> DataFrame:
    """Two sets of windows compared over sites, by subject and over subjects.

    Each site's mean ``value`` in either set, and the second less the first, for sites that have both. A row a subject
    with n sites, both means, the mean difference, its standard error and t against 0; and one row with a null subject,
    where the subjects' mean differences are the cases. t is null with fewer than two cases or no spread.
    """
    (a, first), (b, second) = windows.items()
    means = scores.groupBy(subject, *site).agg(F.avg(F.when(first, F.col(value))).alias(a), F.avg(F.when(second, F.col(value))).alias(b)).na.drop(subset=[a, b])
    cases = means.withColumn("gap", F.col(b) - F.col(a))

    def tested(rows: DataFrame, group: list[Column | str]) -> DataFrame:
        error = F.stddev_samp("gap") / F.sqrt(F.count("gap"))
        out = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg(a).alias(a), F.avg(b).alias(b), F.avg("gap").alias("gap"), error.alias("sem"))
        return out.withColumn("t", F.try_divide("gap", F.when(F.col("sem") > 1e-12, F.col("sem"))))

    by_subject = tested(cases, [subject])
    over = tested(by_subject.select(a, b, "gap"), []).where("n > 0").withColumn(subject, F.lit(None).cast(dict(scores.dtypes)[subject]))
    return by_subject.unionByName(over)


def curves(rows: DataFrame, site: list[str], step: str, value: str) -> DataFrame:
    """Mean output by step: ``site``, ``step``, n, mean, sem, and slope, that of the site's outputs on the step."""
    points = rows.groupBy(*site, step).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))
    fits = rows.groupBy(*site).agg(F.covar_pop(step, value).alias("_c"), F.var_pop(step).alias("_v"))
    return points.join(fits, site).withColumn("slope", F.try_divide("_c", F.when(F.col("_v") > 1e-12, F.col("_v")))).drop("_c", "_v")


def population_vectors(rows: DataFrame, members: DataFrame, population: str, group: list[str], site: str, trial: str, x: str, keep: list[str]) -> DataFrame:
    """``population``, ``group``, ``trial``, ``keep``, ``x``: the vectors of a population's sites one after the other, by site.

    ``members``: population, group, site, each pair once; a site may be in many populations. A trial that lacks one of the
    sites isn't used, so all vectors of a population have one length.
    """
    sizes = members.groupBy(population, *group).agg(F.count("*").alias("_size"))
    joined = rows.join(members, [*group, site]).groupBy(population, *group, trial, *keep)
    parts = joined.agg(F.array_sort(F.collect_list(F.struct(site, x))).alias("_parts")).join(sizes, [population, *group]).where(F.size("_parts") == F.col("_size"))
    return parts.select(population, *group, trial, *keep, F.flatten(F.transform("_parts", lambda p: p[x])).alias(x))
