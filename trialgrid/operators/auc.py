"""Scores of predictions: average ranks, grouped tie-corrected ROC-AUC, threshold metrics, ROC points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, group: list[str]) -> Column:
    """Rank within the group; ties share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*group).orderBy(value)) + (F.count("*").over(Window.partitionBy(*group, value)) - 1) / F.lit(2.0)


def grouped_auc(rows: DataFrame, target: str, proba: str, group: list[str], name: str = "auc") -> DataFrame:
    """ROC-AUC by group from rank sums (Mann-Whitney, ties shared): group, n, n_pos, name; null where one class is missing.

    Rows are first summed by (group, score), so a large group doesn't sort its rows in one task but its distinct scores.
    A target other than 0 and 1, null too, ends the job with an error.
    """
    binary = F.when(F.col(target).isin(0, 1), F.col(target)).otherwise(F.raise_error(F.lit(f"{target} is not 0 or 1")).cast("int"))
    by_score = rows.groupBy(*group, proba).agg(F.count("*").alias("_k"), F.sum(binary).alias("_p"))
    below = F.coalesce(F.sum("_k").over(Window.partitionBy(*group).orderBy(proba).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by_score.withColumn("_r", below + (F.col("_k") + 1) / F.lit(2.0))
    out = ranked.groupBy(*group).agg(F.sum("_k").alias("n"), F.sum("_p").alias("n_pos"), F.sum(F.col("_r") * F.col("_p")).alias("_s"))
    pos, neg = F.col("n_pos").cast("double"), (F.col("n") - F.col("n_pos")).cast("double")
    return out.select(*group, "n", "n_pos", F.when((pos > 0) & (neg > 0), (F.col("_s") - pos * (pos + 1) / 2) / (pos * neg)).alias(name))


def threshold_metrics(rows: DataFrame, target: str, proba: str, group: list[str], cut: float = 0.5) -> DataFrame:
    """Accuracy, precision and recall (0 where undefined), macro F1 and log-loss (probabilities clipped at 1e-15)."""
    t, hit = F.col(target) == 1, F.col(proba) > cut
    p = F.least(F.greatest(F.col(proba), F.lit(1e-15)), F.lit(1 - 1e-15))
    c = rows.groupBy(*group).agg(
        F.count_if(t & hit).cast("double").alias("tp"), F.count_if(~t & hit).cast("double").alias("fp"), F.count_if(t & ~hit).cast("double").alias("fn"), F.count_if(~t & ~hit).cast("double").alias("tn"),
        F.avg(-F.ln(F.when(t, p).otherwise(1 - p))).alias("log_loss"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f1 = lambda a: share(2 * F.col(a), 2 * F.col(a) + F.col("fp") + F.col("fn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select(*group, ((F.col("tp") + F.col("tn")) / total).alias("accuracy"), share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ((f1("tp") + f1("tn")) / 2).alias("macro_f1"), "log_loss")


def roc_points(rows: DataFrame, target: str, proba: str, group: list[str]) -> DataFrame:
    """Points of each group's ROC curve, one per distinct score: rows at or above it, as shares of both classes."""
    by = rows.groupBy(*group, proba).agg(F.sum(target).alias("p"), F.sum(1 - F.col(target)).alias("q"))
    down, whole = Window.partitionBy(*group).orderBy(F.desc(proba)), Window.partitionBy(*group)
    share = lambda c: F.sum(c).over(down) / F.nullif(F.sum(c).over(whole).cast("double"), F.lit(0.0))
    return by.select(*group, proba, share("p").alias("tpr"), share("q").alias("fpr"))


def ordered_mean(value: str) -> Column:
    """Mean of scores of a few units as an aggregate that doesn't hang on the order of rows.

    Decimals are summed and the mean is rounded to 12 digits, so that one that equals a threshold, or another mean, does so
    in every run; a sum of doubles falls on either side of it, as the shuffle has it.
    """
    return F.round(F.sum(F.col(value).cast("decimal(38,18)")).cast("double") / F.count(value), 12)


def fold_means(scores: DataFrame, value: str, key: list[str], name: str = "mean_auc") -> DataFrame:
    """Mean over folds."""
    return scores.groupBy(*key).agg(ordered_mean(value).alias(name), F.count(value).alias("n_folds"))


def best_row(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given full order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_n = 1").drop("_n")


def peak_windows(pred: DataFrame, least: float | None = None) -> DataFrame:
    """Best window of each site by mean AUC over folds; ties go to the earlier window. ``least``: keep peaks at or above it."""
    means = fold_means(grouped_auc(pred, "target", "proba", ["site", "smin", "fold"]), "auc", ["site", "smin"])
    peaks = best_row(means, ["site"], [F.desc_nulls_last("mean_auc"), F.col("smin")])
    return peaks if least is None else peaks.where(F.col("mean_auc") >= least)


def compared_auc(pred: DataFrame) -> DataFrame:
    """AUC of the full and of the baseline score on the same folds, and their difference, by site, word, window and fold."""
    key = ["site", "word", "smin", "fold"]
    full, base = grouped_auc(pred, "target", "proba", key, "full"), grouped_auc(pred, "target", "baseline_proba", key, "baseline")
    return full.join(base.drop("n", "n_pos"), key).select(*key, "full", "baseline", (F.col("full") - F.col("baseline")).alias("gain"))


def later_peaks(peaks: DataFrame, compared: DataFrame, size: int = 15, ends: DataFrame | None = None, slack: int = 20) -> DataFrame:
    """Of windows that start after a site's first peak has ended, the one with the largest mean gain above 0, by word.

    Gains that agree in nine digits are equal, and the earlier window is taken.
    A window has ``size`` samples. ``ends`` (word, end): a window must end at most ``slack`` samples after its word's end.
    """
    gains = compared.groupBy("site", "word", "smin").agg(ordered_mean("gain").alias("gain"))
    first = peaks.select("site", F.col("smin").alias("first_smin"))
    later = gains.join(first, "site").where((F.col("smin") > F.col("first_smin") + size) & (F.col("gain") > 0))
    if ends is not None:
        later = later.join(ends, "word", "left").where(F.col("smin") + size <= F.col("end") + slack).drop("end")
    return best_row(later, ["site", "word"], [F.round("gain", 9).desc(), F.col("smin")])


def best_before(means: DataFrame, size: int = 15) -> DataFrame:
    """For each window of a site, the best mean score of the site's windows of ``size`` samples that end before it starts."""
    before = Window.partitionBy("site").orderBy("smin").rangeBetween(Window.unboundedPreceding, -size - 1)
    return means.select("site", "smin", "mean_auc", F.max("mean_auc").over(before).alias("best_before"))


def nearest_window(means: DataFrame, targets: DataFrame) -> DataFrame:
    """For each site's target time, its window with the smallest distance; ties go to the earlier window."""
    near = means.join(targets, "site").withColumn("distance", F.abs(F.col("smin") - F.col("at")))
    return best_row(near, ["site"], [F.col("distance"), F.col("smin")]).select("site", "at", "smin", "distance")


def swept_peaks(means: DataFrame, cuts: list[float]) -> DataFrame:
    """How many sites have a peak at or above each threshold: all thresholds in one pass over the peaks."""
    peaks = means.groupBy("site").agg(F.max("mean_auc").alias("peak"))
    grid = F.explode(F.array(*[F.lit(c) for c in cuts])).alias("cut")
    return peaks.select("peak", grid).groupBy("cut").agg(F.count_if(F.col("peak") >= F.col("cut")).alias("n_sites"), F.avg(F.when(F.col("peak") >= F.col("cut"), F.col("peak"))).alias("mean_peak"))


def trial_ensemble(pred: DataFrame, cut: float = 0.5) -> DataFrame:
    """Mean of the fold predictions of a trial, with decisions: full above the cut, baseline above its global mean."""
    per = pred.groupBy("site", "epoch").agg(F.max("target").alias("target"), F.avg("proba").alias("full"), F.avg("baseline_proba").alias("baseline"))
    mean = per.agg(F.avg("baseline").alias("_m"))  # one row
    rows = per.crossJoin(F.broadcast(mean))
    full, base = F.col("full") > cut, F.col("baseline") > F.col("_m")
    return rows.select("site", "epoch", "target", "full", "baseline", full.alias("full_decision"), base.alias("baseline_decision"), (full != base).alias("changed"), (full.cast("int") == F.col("target")).alias("correct"), F.abs(F.col("full") - F.col("baseline")).alias("update"))
