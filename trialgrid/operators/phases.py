"""Decoders in phases: three and more classes, training on end steps, and a second fit that uses the first one's held-out output.

A group is some hundred trials and one ``applyInPandas`` call; what a later phase is given is always an output for trials
that the earlier fit did not see.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.operators import regression as rg
from trialgrid.operators.decoders import dealt, fit_pipeline
from trialgrid.operators.quantiles import correlation
from trialgrid.operators.relational import hash_order


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, c: float, steps: int = 100) -> np.ndarray:
    """Coefficients (classes x features) by Newton's method on |W|^2 / 2 + C * sum of weight * -log p, with balanced weights.

    ``y`` in 0 .. classes - 1. A class without rows has no weight; its coefficients follow from the penalty alone.
    """
    n, p = x.shape
    counts = np.bincount(y, minlength=classes)
    weight = c * n / ((counts > 0).sum() * counts[y])
    hot = np.eye(classes)[y]
    w = np.zeros((classes, p))
    loss = lambda v: (v * v).sum() / 2 - weight @ np.log(np.maximum((softmax(x @ v.T) * hot).sum(1), 1e-300))
    for _ in range(steps):
        q = softmax(x @ w.T)
        grad = w + (weight[:, None] * (q - hot)).T @ x
        if np.abs(grad).max() < 1e-9:
            break
        hessian = np.eye(classes * p)
        for a in range(classes):
            for b in range(classes):
                s = weight * q[:, a] * ((a == b) - q[:, b])
                hessian[a * p : (a + 1) * p, b * p : (b + 1) * p] += (x.T * s) @ x
        move = np.linalg.solve(hessian, grad.ravel()).reshape(classes, p)
        rate, now = 1.0, loss(w)
        while rate > 1e-10 and loss(w - rate * move) > now - 1e-4 * rate * (grad * move).sum():
            rate /= 2
        w = w - rate * move
    return w


def _axes(x: np.ndarray, kept: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    center, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    _, size, axes = np.linalg.svd((x - center) / scale, full_matrices=False)
    share = np.cumsum(size**2) / max((size**2).sum(), 1e-300)
    return center, scale, axes[: int(np.searchsorted(share, kept - 1e-12) + 1)]


def dealt_folds(rows: DataFrame, group: list[str], stratum: list[str], id_: str, n: int, out: str = "fold", seed: int = 0) -> DataFrame:
    """``rows`` with a fold number: trials of each stratum of a group in hash order, dealt in turn."""
    by = Window.partitionBy(*group, *stratum).orderBy(hash_order(id_, seed), id_)
    return rows.withColumn(out, ((F.row_number().over(by) - 1) % n).cast("int"))


def class_decoder(rows: DataFrame, group: list[str], id_: str, classes: list[int], grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), kept: float = 0.9) -> DataFrame:
    """Probabilities of each class: ``group``, ``id_``, y, fold, c, probas (in the order of ``classes``), predicted.

    ``rows``: group, id_, y (one of ``classes``, or null), x and fold; a fold below 0 is never trained on. Trials of a fold are
    scored by a model of the other folds; trials of folds below 0 by a model of all others. C is the one with the best mean
    log probability of the true class when each training fold in turn is left out (the first of equal ones). Rows with a
    null y are scored but not trained on; a training part with one class gives no model and no rows for its fold.
    """
    place = {c: i for i, c in enumerate(classes)}

    def model(x: np.ndarray, y: np.ndarray, c: float):
        center, scale, axes = _axes(x, kept)
        w = fit_softmax(((x - center) / scale) @ axes.T, y, len(classes), c)
        return lambda v: softmax(((v - center) / scale) @ axes.T @ w.T)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(id_, ignore_index=True)
        x, fold = np.stack(part["x"].to_numpy()).astype(float), part["fold"].to_numpy()
        known = part["y"].notna().to_numpy()
        y = np.array([place[int(v)] if k else 0 for v, k in zip(part["y"], known, strict=True)])
        out = []
        for k in np.unique(np.maximum(fold, -1)):
            train, test = known & (fold >= 0) & (fold != k), (fold < 0) if k < 0 else fold == k
            if len(np.unique(y[train])) < 2:
                continue
            scores = np.zeros(len(grid))
            for j in np.unique(fold[train]):
                rest, held = train & (fold != j), train & (fold == j)
                if len(np.unique(y[rest])) == len(np.unique(y[train])):
                    scores += [np.log(np.maximum(model(x[rest], y[rest], c)(x[held])[np.arange(held.sum()), y[held]], 1e-300)).mean() for c in grid]
            c = grid[int(np.argmax(np.round(scores, 12)))]
            q = model(x[train], y[train], c)(x[test])
            out.append(part.loc[test, [*group, id_, "y", "fold"]].assign(c=c, probas=list(q), predicted=[classes[i] for i in q.argmax(1)]))
        return pd.concat(out) if out else pd.DataFrame(columns=[*group, id_, "y", "fold", "c", "probas", "predicted"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*group, id_]], f"y {kinds['y']}", "fold int", "c double", "probas array<double>", "predicted int"])
    return dealt(rows.select(*group, id_, "y", "x", F.col("fold").cast("int").alias("fold")), group).groupBy(*group).applyInPandas(fit, schema)


def end_step_decoder(rows: DataFrame, group: list[str], id_: str, step: str, strategy: str = "extreme", grid: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0), kept: float | None = 0.95) -> DataFrame:
    """Phase one: ``group``, ``id_``, ``step``, y, n_models, proba for the trials held out.

    ``extreme`` trains on the least and the largest step of a group and holds the rest out; ``stratify`` trains on every
    second trial of each step in hash order. The training trials are cut in two halves by class; each half makes a model,
    whose C is the best by log probability on the other half; held-out trials get the probability of the mean log odds. A
    half with one class makes no model; a group without a model gives no rows.
    """
    if strategy not in ("extreme", "stratify"):
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "extreme":
        ends = rows.groupBy(*group).agg(F.min(step).alias("_least"), F.max(step).alias("_most"))
        marked = rows.join(ends, group).withColumn("_held", ~F.col(step).isin(F.col("_least"), F.col("_most"))).drop("_least", "_most")
    else:
        marked = dealt_folds(rows, group, [step], id_, 2, "_side").withColumn("_held", F.col("_side") == 1).drop("_side")
    marked = dealt_folds(marked, [*group, "_held"], ["y"], id_, 2, "_half", 1)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(id_, ignore_index=True)
        x, y, held, half = np.stack(part["x"].to_numpy()).astype(float), part["y"].to_numpy(), part["_held"].to_numpy(bool), part["_half"].to_numpy()
        logits = []
        for k in (0, 1):
            train, other = ~held & (half == k), ~held & (half != k)
            if len(np.unique(y[train])) < 2:
                continue
            models = [fit_pipeline(x[train], y[train], c, kept) for c in grid]
            odds = lambda m, v: ((v - m["center"]) / m["scale"]) @ m["pca"].T @ m["coef"]
            fits = [-np.logaddexp(0, -np.where(y[other] == 1, 1, -1) * odds(m, x[other])).mean() if other.any() else 0.0 for m in models]
            logits.append(odds(models[int(np.argmax(np.round(fits, 12)))], x[held]))
        columns = [*group, id_, step, "y"]
        if not logits or not held.any():
            return pd.DataFrame(columns=[*columns, "n_models", "proba"])
        return part.loc[held, columns].assign(n_models=len(logits), proba=1 / (1 + np.exp(-np.clip(np.mean(logits, 0), -500, 500))))

    kinds = dict(marked.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*group, id_, step]], f"y {kinds['y']}", "n_models int", "proba double"])
    return dealt(marked.select(*group, id_, step, "y", "x", "_held", "_half"), group).groupBy(*group).applyInPandas(fit, schema)


def second_phase(held: DataFrame, intervening: DataFrame, later: DataFrame, group: list[str], id_: str, step: str, output: list[str], value: str, alphas: list[float] | None = None) -> DataFrame:
    """Phase two: later activity on intervening activity and on phase one's held-out probability, beside the same without it.

    ``held``: group, id_, step, proba of ``end_step_decoder``; ``intervening``: group, id_, x; ``later``: group, id_, output,
    value. Only trials with a held-out probability enter, so no trial that phase one was trained on does. Two outer folds
    and two inner ones are dealt by step; the penalty is chosen inside. Returns what ``regression.nested_ridge`` does, and
    r2_baseline, R2 without the probability at the same penalty.
    """
    rows = held.select(*group, id_, step, "proba").join(intervening.select(*group, id_, "x"), [*group, id_])
    cells = rg.nested_cells(rows, group, id_, [step], 2, 2)
    terms = F.concat(rg.terms_of_array("x", "x"), F.array(F.struct(F.lit("proba").alias("term"), F.col("proba").alias("x"))))
    design = rows.select(*group, id_, terms.alias("terms")).join(cells, [*group, id_])
    known = later.join(rows.select(*group, id_), [*group, id_], "left_semi")
    fits = rg.nested_ridge(design, known, group, id_, output, value, alphas or [10.0**k for k in np.linspace(-2, 5, 6)], {"proba": ["proba"]})
    return fits.withColumn("r2_baseline", F.col("r2") - F.col("unique")["proba"])


def proba_of(probas: str, classes: list[int], wanted: Column) -> Column:
    """The probability of a row's own class; null for one that isn't in ``classes``."""
    at = F.array_position(F.array(*map(F.lit, classes)), wanted).cast("int")
    return F.when(at > 0, F.get(probas, at - 1))


def phase_correlation(first: DataFrame, second: DataFrame, group: list[str], id_: str, x: str, y: str) -> DataFrame:
    """Pearson's r by group between two phases' outputs on the trials that both held out, with their number."""
    rows = first.select(*group, id_, F.col(x).alias("_x")).join(second.select(*group, id_, F.col(y).alias("_y")), [*group, id_]).na.drop(subset=["_x", "_y"])
    return rows.groupBy(*group).agg(F.count("*").alias("n"), correlation("_x", "_y").alias("r"))
