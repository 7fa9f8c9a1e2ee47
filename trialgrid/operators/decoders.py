"""Many small models, one per group: windowed logistic decoding, model comparison, permutation, transfer, ridge, clusters.

Folds are a table made before fitting, so paired models share them. Each group (site and window, some hundred trials) is
one ``applyInPandas`` call; the solver is Newton's method on the L2-penalised logistic loss without intercept, with
balanced class weights: |w|^2 / 2 + C * sum of weight * log(1 + exp(-y w.x)).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.operators.arrays import sliding_windows, window
from trialgrid.operators.relational import hash_order


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float, steps: int = 50, start: np.ndarray | None = None) -> np.ndarray:
    """Coefficients; y in {0, 1}, both present. ``start``: coefficients to begin from, such as those of a close C."""
    s, n = np.where(y == 1, 1.0, -1.0), len(y)
    weight = c * np.where(y == 1, n / (2 * (y == 1).sum()), n / (2 * (y == 0).sum()))
    w = np.zeros(x.shape[1]) if start is None else start
    loss = lambda v: v @ v / 2 + weight @ np.logaddexp(0, -s * (x @ v))
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(s * (x @ w), -500, 500)))
        grad = w - x.T @ (weight * s * p)
        if np.abs(grad).max() < 1e-9:
            break
        move = np.linalg.solve(np.eye(len(w)) + (x.T * (weight * p * (1 - p))) @ x, grad)
        # close to the end a step's gain is below the loss's own rounding, where halving it would go on for nothing
        rate, most = 1.0, now + 1e-12 * now
        while (new := loss(w - rate * move)) > most - 1e-4 * rate * (grad @ move) and rate > 1e-10:
            rate /= 2
        w, now = w - rate * move, new
    return w


def fit_pipeline(x: np.ndarray, y: np.ndarray, c: float, kept: float | None) -> dict[str, np.ndarray]:
    """Scaler (population deviation), PCA with the fewest components that reach a share of the variance, classifier."""
    center, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    z = (x - center) / scale
    axes = np.eye(x.shape[1])
    if kept is not None:
        _, size, axes = np.linalg.svd(z - z.mean(0), full_matrices=False)
        share = np.cumsum(size**2) / max((size**2).sum(), 1e-300)
        axes = axes[: int(np.searchsorted(share, kept - 1e-12) + 1)]
    return {"center": center, "scale": scale, "pca": axes, "coef": fit_logistic(z @ axes.T, y, c)}


def scored(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(((x - model["center"]) / model["scale"]) @ model["pca"].T @ model["coef"], -500, 500)))


def decoding_inputs(epochs: DataFrame, target: str, size: int, stride: int, low: int, high: int, keep: list[str]) -> DataFrame:
    """A row per trial and window with its feature vector x: keep columns, smin, smax, x, y."""
    rows = sliding_windows(epochs, size, stride, low, high)
    return rows.select(*keep, "smin", "smax", window("samples", F.col("smin"), F.col("smax")).alias("x"), F.col(target).cast("int").alias("y"))


def folds(rows: DataFrame, group: list[str], id_: str, n: int = 5, seed: int = 0) -> DataFrame:
    """Stratified fold numbers: in each group and class, trials in hash order are dealt out in turn."""
    by = Window.partitionBy(*group, "y").orderBy(hash_order(id_, seed), id_)
    return rows.withColumn("fold", (F.row_number().over(by) - 1) % n)


def dealt(rows: DataFrame, group: list[str]) -> DataFrame:
    """Groups dealt to all shuffle partitions: fits cost time by far more than bytes, so small partitions mustn't be merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group)


def _auc(y: np.ndarray, p: np.ndarray) -> float:
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    _, at, size = np.unique(p, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(size) - (size - 1) / 2)[at]
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) if n1 and n0 else np.nan


def cross_validated(rows: DataFrame, group: list[str], id_: str, grid: tuple[float, ...] = (0.01, 1.0), kept: float | None = 0.95, given: str | None = None) -> DataFrame:
    """Held-out probabilities of each trial: group, id, fold, y, proba, c. C is chosen by an inner split of the training folds.

    A fold whose training part has one class gives no rows. ``given``: a column with the C of each fold; where it is null, C is chosen.
    """

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x, y, fold = np.stack(part["x"].to_numpy()).astype(float), part["y"].to_numpy(), part["fold"].to_numpy()
        out = []
        for k in np.unique(fold):
            train, test = fold != k, fold == k
            if len(np.unique(y[train])) < 2:
                continue
            inner = train & (fold % 2 == (k + 1) % 2)
            own = part[given].to_numpy(float)[test][0] if given else np.nan
            best, chosen = -np.inf, grid[0] if np.isnan(own) else own
            for c in grid if np.isnan(own) else ():
                rest = train & ~inner
                if len(np.unique(y[rest])) == 2 and len(np.unique(y[inner])) == 2:
                    score = _auc(y[inner], scored(fit_pipeline(x[rest], y[rest], c, kept), x[inner]))
                    if score > best:
                        best, chosen = score, c
            model = fit_pipeline(x[train], y[train], chosen, kept)
            out.append(part.loc[test, [*group, id_, "fold", "y"]].assign(proba=scored(model, x[test]), c=chosen))
        return pd.concat(out) if out else part.iloc[:0][[*group, id_, "fold", "y"]].assign(proba=0.0, c=0.0)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*group, id_, "fold", "y"]], "proba double", "c double"])
    return dealt(rows.select(*group, id_, "fold", "y", "x", *([given] if given else [])), group).groupBy(*group).applyInPandas(fit, schema)


def fitted_models(rows: DataFrame, group: list[str], c: float = 1.0, kept: float | None = 0.95) -> DataFrame:
    """The model table: group, fold, center, scale, pca, coef, c; each fold's model leaves that fold out."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x, y, fold = np.stack(part["x"].to_numpy()).astype(float), part["y"].to_numpy(), part["fold"].to_numpy()
        out = []
        for k in np.unique(fold):
            train = fold != k
            if len(np.unique(y[train])) == 2:
                m = fit_pipeline(x[train], y[train], c, kept)
                out.append({**{g: part[g].iloc[0] for g in group}, "fold": int(k), "center": m["center"].tolist(), "scale": m["scale"].tolist(), "pca": m["pca"].tolist(), "coef": m["coef"].tolist(), "c": c})
        return pd.DataFrame(out, columns=[*group, "fold", "center", "scale", "pca", "coef", "c"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{g}` {kinds[g]}" for g in group], "fold int", "center array<double>", "scale array<double>", "pca array<array<double>>", "coef array<double>", "c double"])
    return dealt(rows.select(*group, "fold", "y", "x"), group).groupBy(*group).applyInPandas(fit, schema)


def applied(x: str, scaler: str, pca: str, coef: str) -> Column:
    """Probability of a stored model (struct columns) on a vector, in expressions: scale, project, classify."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    z = F.zip_with(F.zip_with(x, f"{scaler}.center", lambda a, b: a - b), f"{scaler}.scale", lambda a, b: a / b)
    parts = F.transform(pca, lambda axis: dot(axis, z))
    return 1 / (1 + F.exp(-dot(parts, coef)))


def transferred(vectors: DataFrame, models: DataFrame, key: list[str], id_: str, own: Column, other: Column) -> DataFrame:
    """Models of one window on the vectors of another: the vectors' own scaler, the other window's PCA and classifier.

    ``own`` and ``other`` pick the windows among ``smin``. Each trial is scored by the models that left its fold out.
    """
    scaler = models.where(own).select(*key, "fold", F.struct("center", "scale").alias("scaler"))
    classifier = models.where(other).select(*key, "fold", "pca", "coef", F.col("smin").alias("model_smin"))
    rows = vectors.where(own).join(scaler, [*key, "fold"]).join(classifier, [*key, "fold"])
    return rows.select(*key, id_, "fold", "smin", "model_smin", "y", applied("x", "scaler", "pca", "coef").alias("proba"))


def permuted(rows: DataFrame, group: list[str], id_: str, copies: int) -> DataFrame:
    """Label permutations: ``copies`` of each group with labels dealt to trials in hash order of the copy's own seed."""
    out = rows.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    seeded = F.xxhash64("permutation", id_)
    place = lambda order: F.row_number().over(Window.partitionBy(*group, "permutation").orderBy(*order))
    labels = out.select(*group, "permutation", place([F.col(id_)]).alias("_i"), F.col("y").alias("_y"))
    return out.withColumn("_i", place([seeded, F.col(id_)])).join(labels, [*group, "permutation", "_i"]).withColumn("y", F.col("_y")).drop("_i", "_y")


def lagged_ridge(events: DataFrame, response: DataFrame, trial: str, features: list[str], lags: list[int], ridge: float) -> DataFrame:
    """Linear response model: a signal (trial, pos, v) on impulse events (trial, at, features) at several lags.

    Normal equations are sums over rows in Spark; only the small system of each channel is solved in numpy. Returns
    channel, feature, lag, coef, and unique, the rise of the residual sum when the feature is left out.
    """
    terms = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(k).alias("lag"), (F.col("at") + k).alias("pos"), F.col(f).cast("double").alias("x")) for f in features for k in lags])).alias("t")
    design = events.select(trial, terms).select(trial, "t.pos", F.concat_ws(":", "t.f", F.col("t.lag").cast("string")).alias("term"), "t.x").where("x != 0").groupBy(trial, "pos", "term").agg(F.sum("x").alias("x"))
    rows = response.join(design, [trial, "pos"])
    xy = rows.groupBy("channel", "term").agg(F.sum(F.col("x") * F.col("v")).alias("xy"))
    pairs = rows.select("channel", trial, "pos", "term", "x").join(design.toDF(trial, "pos", "other", "z"), [trial, "pos"]).groupBy("channel", "term", "other").agg(F.sum(F.col("x") * F.col("z")).alias("xx"))
    gathered = pairs.join(xy, ["channel", "term"]).join(response.groupBy("channel").agg(F.sum(F.col("v") * F.col("v")).alias("vv")), "channel")

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        names = sorted(part["term"].unique())
        a = part.pivot(index="term", columns="other", values="xx").reindex(index=names, columns=names).fillna(0.0).to_numpy()
        b, vv = part.groupby("term")["xy"].first().reindex(names).to_numpy(), part["vv"].iloc[0]

        def rest(keep: np.ndarray) -> tuple[np.ndarray, float]:
            w = np.linalg.solve(a[np.ix_(keep, keep)] + ridge * np.eye(len(keep)), b[keep]) if len(keep) else np.zeros(0)
            return w, vv - 2 * w @ b[keep] + w @ a[np.ix_(keep, keep)] @ w

        whole, error = rest(np.arange(len(names)))
        of = np.array([n.rsplit(":", 1)[0] for n in names])
        unique = {f: rest(np.flatnonzero(of != f))[1] - error for f in set(of)}
        return pd.DataFrame({"channel": part["channel"].iloc[0], "feature": of, "lag": [int(n.rsplit(":", 1)[1]) for n in names], "coef": whole, "unique": [unique[f] for f in of]})

    kind = dict(response.dtypes)["channel"]
    return gathered.groupBy("channel").applyInPandas(solve, f"channel {kind}, feature string, lag int, coef double, unique double")


def clustered(vectors: DataFrame, column: str, components: int, k: int, seed: int = 1) -> DataFrame:
    """PCA of an array column, then k-means: the rows with ``cluster``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = vectors.withColumn("_v", array_to_vector(column))
    reduced = PCA(k=components, inputCol="_v", outputCol="_p").fit(rows).transform(rows)
    model = KMeans(k=k, seed=seed, featuresCol="_p", predictionCol="cluster").fit(reduced)
    return model.transform(reduced).drop("_v", "_p")

