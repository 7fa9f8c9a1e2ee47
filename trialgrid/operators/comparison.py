"""Paired model comparison: baseline features alone against baseline features and signal, on the same splits.

The splits are a table of trials made before any fit and joined to every window, so both models of a window, and all
windows of a site, hold out the same trials. A group (site and window, some hundred trials) is one ``applyInPandas``
call, which returns held-out probabilities; all scores are sums and ranks over these in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.operators.decoders import _auc, dealt, fit_logistic
from trialgrid.operators.relational import hash_order

#: Fixed values of the search: C of the baseline, C of the full model, shares of variance that PCA keeps.
BASELINE_C = tuple(np.logspace(-1, 1, 2).tolist())
FULL_C = tuple(np.logspace(-8, 3, 10).tolist())
KEPT = (0.1, 0.25, 0.5, 0.75, 0.9)


def with_baseline(features: list[str], x: str = "x") -> Column:
    """The baseline features before the signal's vector, as one array of doubles."""
    return F.concat(F.array(*[F.col(f).cast("double") for f in features]), x)


def repeated_splits(trials: DataFrame, group: list[str], id_: str, label: str, stratum: list[str], repeats: int = 5, share: float = 0.8, n_folds: int = 3) -> DataFrame:
    """``group``, ``id_``, ``split``: for each repeat -1 where the trial is held out, else its inner fold.

    Trials of each label are put in the repeat's hash order and the first ``share`` of them train. Training trials of each
    ``stratum`` are dealt to inner folds in turn. With a rare label there are as many folds as it has held-out trials;
    a group with one label, or with a label of fewer than two trials on either side, isn't split and gives no rows. Rows
    with a null label are left out; ids are unique in a group.
    """
    rows = trials.where(F.col(label).isNotNull()).select(*group, id_, F.col(label).alias("_y"), F.struct(*stratum).alias("_s"))
    classes = rows.groupBy(*group, "_y").agg(F.count("*").alias("_n")).withColumn("_train", F.floor(F.col("_n") * share + 0.5))
    sizes = classes.groupBy(*group).agg(F.count("*").alias("_c"), F.min("_n").alias("_least"), F.min("_train").alias("_t"), F.min(F.col("_n") - F.col("_train")).alias("_h"))
    first = F.least(F.lit(n_folds), F.floor(F.round(F.col("_least") * share, 9)))
    enough = (F.col("_t") >= first) & (F.col("_h") >= first)
    sizes = sizes.where("_c = 2").withColumn("_f", F.when(enough, first).when(F.least("_t", "_h") >= 2, F.col("_h"))).where("_f >= 2")
    rows = rows.join(classes.select(*group, "_y", "_train"), [*group, "_y"]).join(sizes.select(*group, "_f"), group)
    rows = rows.withColumn("_seed", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = hash_order(id_, "_seed")
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*group, "_seed", "_y").orderBy(order, id_))).withColumn("_in", F.col("_k") <= F.col("_train"))
    turn = F.row_number().over(Window.partitionBy(*group, "_seed", "_in", "_s").orderBy(order, id_)) - 1
    rows = rows.withColumn("_fold", F.when(F.col("_in"), turn % F.col("_f")).otherwise(-1).cast("int"))
    got = rows.groupBy(*group, id_).agg(F.array_sort(F.collect_list(F.struct("_seed", "_fold"))).alias("_all"))
    return got.select(*group, id_, F.transform("_all", lambda s: s["_fold"]).alias("split"))


@dataclass
class Prepared:
    """Scaled columns that stay as they are, and the signal's on its principal axes; ``reach`` is the summed share of variance."""

    plain: np.ndarray
    projected: np.ndarray
    reach: np.ndarray

    def at(self, kept: float | None, like: Prepared | None = None) -> np.ndarray:
        """The features with the fewest axes that reach ``kept``; ``like``: as counted on those training rows."""
        reach = (like or self).reach
        n = 0 if kept is None else min(len(reach), int(np.searchsorted(reach, kept, side="right")) + 1)
        return np.hstack([self.plain, self.projected[:, :n]])


def _prepare(x: np.ndarray, train: np.ndarray, n_plain: int, scale_plain: bool) -> tuple[Prepared, Prepared]:
    """Scalers and axes of the training rows, applied to these and to the others."""
    center, scale = x[train].mean(0), x[train].std(0)
    z = (x - center) / np.where(scale > 0, scale, 1.0)
    plain, signal = (z if scale_plain else x)[:, :n_plain], z[:, n_plain:]
    reach, projected = np.zeros(0), signal
    if signal.shape[1]:
        _, size, axes = np.linalg.svd(signal[train], full_matrices=False)
        reach, projected = np.cumsum(size**2) / max((size**2).sum(), 1e-300), signal @ axes.T
    return Prepared(plain[train], projected[train], reach), Prepared(plain[~train], projected[~train], reach)


def _best(x: np.ndarray, y: np.ndarray, inner: np.ndarray, n_plain: int, scale_plain: bool, grid: tuple[float, ...], levels: tuple[float | None, ...]) -> tuple[float, float | None]:
    """The first C, and share at it, with the best mean AUC over the inner folds; axes are found once a fold."""
    total = np.zeros((len(grid), len(levels)))
    numbers = np.unique(inner)
    for k in numbers:
        fit = inner != k
        if len(np.unique(y[fit])) < 2 or len(np.unique(y[~fit])) < 2:
            return grid[0], levels[0]  # a fold without both labels has no AUC, so no setting has a mean
        a, b = _prepare(x, fit, n_plain, scale_plain)
        for j, kept in enumerate(levels):
            w = None
            for i, c in enumerate(grid):
                w = fit_logistic(a.at(kept), y[fit], c, start=w)
                total[i, j] += _auc(y[~fit], b.at(kept, a) @ w) / len(numbers)
    i, j = np.unravel_index(np.argmax(np.round(total, 12)), total.shape)
    return grid[i], levels[j]


def compared(rows: DataFrame, group: list[str], id_: str, baseline: list[str], kept: tuple[float, ...] = KEPT, baseline_grid: tuple[float, ...] = BASELINE_C, full_grid: tuple[float, ...] = FULL_C, fixed: DataFrame | None = None) -> DataFrame:
    """Held-out probabilities of both models: group, repeat, id_, y, baseline_proba, full_proba and the settings chosen.

    ``rows``: ``group``, ``id_``, y in {0, 1}, the baseline features, the signal x and ``split``. A single baseline feature
    is taken as it is by the baseline model and scaled in the full one; of several, the baseline model takes principal axes
    as well. ``fixed``: group, repeat, baseline_c, baseline_kept, full_c, full_kept of an earlier run, used in place of the
    search; groups and repeats that it doesn't have are left out. Rows with a null in y, a feature or x are left out; a
    group with one label gives no rows.
    """
    settings = ["baseline_c", "baseline_kept", "full_c", "full_kept"]
    usable = F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
    for f in baseline:
        usable &= F.col(f).isNotNull()
    known = rows.where(usable).select(*group, id_, "split", "y", with_baseline(baseline).alias("x"))
    if fixed is not None:
        known = known.join(fixed.groupBy(*group).agg(F.collect_list(F.struct("repeat", *settings)).alias("fixed")), group)
    n, is_fixed = len(baseline), fixed is not None
    columns = [*group, id_, "repeat", "y", "baseline_proba", "full_proba", *settings]

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(id_, ignore_index=True)
        x, y, split = np.stack(part["x"].to_numpy()).astype(float), part["y"].to_numpy(), np.stack(part["split"].to_numpy())
        given = {s["repeat"]: s for s in part["fixed"].iloc[0]} if is_fixed else None
        out = []
        for r in range(split.shape[1]):
            train = split[:, r] >= 0
            if train.all() or len(np.unique(y[train])) < 2 or (given is not None and r not in given):
                continue
            probas, chosen = [], []
            # features, how many of them are plain, whether these are scaled, grid, shares
            cases = [(x[:, :n], n if n == 1 else 0, False, baseline_grid, (None,) if n == 1 else kept), (x, n, True, full_grid, kept)]
            for name, (own, n_plain, scale_plain, grid, levels) in zip(("baseline", "full"), cases, strict=True):
                if given is not None:
                    c, level = given[r][f"{name}_c"], given[r][f"{name}_kept"]
                    level = None if level is None or np.isnan(level) else level
                else:
                    c, level = _best(own[train], y[train], split[train, r], n_plain, scale_plain, grid, levels)
                a, b = _prepare(own, train, n_plain, scale_plain)
                probas.append(1 / (1 + np.exp(-np.clip(b.at(level, a) @ fit_logistic(a.at(level), y[train], c), -500, 500))))
                chosen += [c, level]
            held = part.loc[~train, [*group, id_, "y"]].assign(repeat=r, baseline_proba=probas[0], full_proba=probas[1])
            out.append(held.assign(**{k: np.nan if v is None else v for k, v in zip(settings, chosen, strict=True)}))
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    kinds = dict(known.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*group, id_]], "repeat int", f"y {kinds['y']}", *[f"{c} double" for c in ["baseline_proba", "full_proba", *settings]]])
    return dealt(known, group).groupBy(*group).applyInPandas(fit, schema)


def paired_scores(held: DataFrame, group: list[str]) -> DataFrame:
    """Scores of both models side by side: a row per group and repeat.

    For the baseline and the full model AUC (ties shared; null where one label was held out), accuracy, precision and
    recall at 1/2 (0 where undefined), log loss and the settings; ``auc_gain`` is full less baseline. ``held`` is read
    once, as it holds the fits: rows are summed by model and score, and all scores come from these sums.
    """
    keys = [*group, "repeat"]
    sides = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"{m}_proba").alias("p"), F.col(f"{m}_c").alias("c"), F.col(f"{m}_kept").alias("kept")) for m in ("baseline", "full")])).alias("s")
    by = held.select(*keys, "y", sides).groupBy(*keys, "s.m", "s.c", "s.kept", "s.p").agg(F.count("*").cast("double").alias("k"), F.sum("y").cast("double").alias("pos"))
    below = F.coalesce(F.sum("k").over(Window.partitionBy(*keys, "m").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    neg, sure = F.col("k") - F.col("pos"), F.least(F.greatest("p", F.lit(1e-15)), F.lit(1 - 1e-15))
    hit = lambda v: F.sum(F.when(F.col("p") > 0.5, v).otherwise(0.0))
    sums = by.withColumn("r", below + (F.col("k") + 1) / 2).groupBy(*keys, "m", "c", "kept").agg(
        F.sum("k").alias("n"), F.sum("pos").alias("n1"), F.sum(F.col("r") * F.col("pos")).alias("ranks"), hit(F.col("pos")).alias("tp"), hit(neg).alias("fp"),
        (-F.sum(F.col("pos") * F.ln(sure) + neg * F.ln(1 - sure)) / F.sum("k")).alias("log_loss"),
    )
    n1, n0, tp, fp = F.col("n1"), F.col("n") - F.col("n1"), F.col("tp"), F.col("fp")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    scores = {
        "auc": F.when((n1 > 0) & (n0 > 0), (F.col("ranks") - n1 * (n1 + 1) / 2) / (n1 * n0)), "accuracy": (tp + n0 - fp) / F.col("n"),
        "precision": share(tp, tp + fp), "recall": share(tp, n1), "log_loss": F.col("log_loss"), "c": F.col("c"), "kept": F.col("kept"),
    }
    pick = [F.max(F.when(F.col("m") == m, v)).alias(f"{m}_{name}") for m in ("baseline", "full") for name, v in scores.items()]
    out = sums.groupBy(*keys).agg(F.max("n").cast("long").alias("n_test"), *pick)
    return out.withColumn("auc_gain", F.col("full_auc") - F.col("baseline_auc"))
