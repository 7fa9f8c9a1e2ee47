"""Parts of stored models put together anew: one model's scaler, another's axes, a third's classifier.

A model table has a row a model: center, scale (of the signal), pca (axes as arrays), coef (first of baseline features,
then of the axes), and where there are baseline features base_center and base_scale. Applying a composition is a join of
table rows with feature vectors and matrix products as array expressions; nothing is fitted and no row leaves the JVM.
Sizes that don't fit together end the job with an error and not with a null or a cut product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.operators.auc import grouped_auc
from trialgrid.operators.decoders import dealt, fit_logistic


def _fits(value: Column, same: Column, what: str) -> Column:
    wrong = F.raise_error(F.concat(F.lit(f"{what}: sizes don't fit")))
    return F.when(F.coalesce(same, F.lit(False)), value).otherwise(wrong.cast("array<double>"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def standardised(x: Column, center: Column, scale: Column) -> Column:
    z = F.zip_with(F.zip_with(x, center, lambda a, b: a - b), scale, lambda a, b: a / b)
    return _fits(z, (F.size(x) == F.size(center)) & (F.size(x) == F.size(scale)), "scaler")


def projected(z: Column, axes: Column) -> Column:
    """The product of the axes with a vector; without axes (null) the vector itself."""
    parts = _fits(F.transform(axes, lambda axis: _dot(axis, z)), F.forall(axes, lambda axis: F.size(axis) == F.size(z)), "axes")
    return F.when(axes.isNull(), z).otherwise(parts)


def classified(parts: Column, coef: Column) -> Column:
    """Log odds of class 1."""
    checked = _fits(coef, F.size(parts) == F.size(coef), "classifier")
    return _dot(parts, checked)


def probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(500.0)), F.lit(-500.0))))


def composed(vectors: DataFrame, key: list[str], scaler: DataFrame, axes: DataFrame, classifier: DataFrame, n_base: int = 0, base: list[str] | None = None) -> DataFrame:
    """``vectors`` (``key``, x and others) with the columns logit and proba.

    ``scaler`` (key, center, scale), ``axes`` (key, pca) and ``classifier`` (key, coef) may come from three models, each
    with a row a key; a row without all three is left out. ``n_base`` coefficients stand before those of the axes: with
    ``base`` the standardised baseline features they belong to, else these features are zero.
    """
    rows = vectors.join(scaler.select(*key, F.struct("center", "scale").alias("_s")), key)
    rows = rows.join(axes.select(*key, F.struct("pca").alias("_a")), key).join(classifier.select(*key, F.struct("coef").alias("_c")), key)
    ahead = F.array(*[F.col(b).cast("double") for b in base]) if base else F.array_repeat(F.lit(0.0), n_base)
    parts = F.concat(ahead, projected(standardised(F.col("x"), F.col("_s.center"), F.col("_s.scale")), F.col("_a.pca")))
    return rows.withColumn("logit", classified(parts, F.col("_c.coef"))).withColumn("proba", probability(F.col("logit"))).drop("_s", "_a", "_c")


def ensemble(scored: DataFrame, key: list[str], mean_of: str = "logit") -> DataFrame:
    """One prediction a ``key`` from those of several models: the mean probability, or that of the mean log odds."""
    proba = probability(F.avg("logit")) if mean_of == "logit" else F.avg("proba")
    return scored.groupBy(*key).agg(F.count("*").alias("n_models"), proba.alias("proba"))


def transfer_sets(vectors: DataFrame, models: DataFrame, key: list[str], early: int, late: int, window: str = "smin") -> DataFrame:
    """The four sets of two windows: data of each (its own scaler) under the axes and classifier of each.

    ``vectors`` and ``models`` have ``key`` (with the fold that a model left out) and the window's first sample. Returns
    the vectors' columns with data_window and model_window (``early`` or ``late``), logit and proba.
    """
    name = lambda c: F.when(c == early, "early").when(c == late, "late")
    at = F.col(window)
    data = vectors.withColumn("data_window", name(at)).where("data_window is not null")
    own = models.withColumn("data_window", name(at)).where("data_window is not null").select(*key, "data_window", "center", "scale")
    other = models.withColumn("model_window", name(at)).where("model_window is not null").select(*key, "model_window", "pca", "coef")
    rows = data.join(other.select(*key, "model_window"), key)
    on = [*key, "data_window", "model_window"]
    both = own.join(other, key)
    return composed(rows, on, both, both, both)


def transfer_summary(sets: DataFrame, key: list[str], in_window: DataFrame | None = None) -> DataFrame:
    """AUC of the four sets by ``key`` side by side, ratios and the effect of the transfer.

    ``in_window``: key, early_auc, late_auc of the windows' own decoders, else the sets' own. Keys that lack a set or
    have a set of one class are left out, so each key is one row.
    """
    scores = grouped_auc(sets.select(*key, "data_window", "model_window", F.col("y").alias("target"), "proba"), "target", "proba", [*key, "data_window", "model_window"])
    pick = lambda d, m: F.max(F.when((F.col("data_window") == d) & (F.col("model_window") == m), F.col("auc")))
    wide = scores.groupBy(*key).agg(*[pick(d, m).alias(f"{m}_{d}_auc") for m in ("early", "late") for d in ("early", "late")])
    wide = wide.na.drop(subset=[f"{m}_{d}_auc" for m in ("early", "late") for d in ("early", "late")])
    wide = wide.join(in_window, key) if in_window is not None else wide.withColumns({"early_auc": F.col("early_early_auc"), "late_auc": F.col("late_late_auc")})
    return wide.withColumns({
        "early_to_late": F.try_divide("early_late_auc", "late_auc"), "late_to_early": F.try_divide("late_early_auc", "early_auc"), "early_effect": F.col("early_early_auc") - F.col("late_early_auc"),
    })


def models_with_baseline(rows: DataFrame, group: list[str], base: list[str], c: float = 1.0, kept: float = 0.9) -> DataFrame:
    """The model table of baseline features and signal: group, fold, center, scale, base_center, base_scale, pca, coef.

    ``rows``: group, fold, y in {0, 1}, the baseline features and the signal x. Each fold's model leaves that fold out; a
    fold whose training part has one class has no model. Groups are some hundred rows.
    """

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x, plain = np.stack(part["x"].to_numpy()).astype(float), part[base].to_numpy(float)
        y, fold = part["y"].to_numpy(), part["fold"].to_numpy()
        out = []
        for k in np.unique(fold):
            train = fold != k
            if len(np.unique(y[train])) < 2:
                continue
            center, scale, base_center, base_scale = x[train].mean(0), x[train].std(0), plain[train].mean(0), plain[train].std(0)
            scale, base_scale = np.where(scale > 0, scale, 1.0), np.where(base_scale > 0, base_scale, 1.0)
            z = (x[train] - center) / scale
            _, size, axes = np.linalg.svd(z, full_matrices=False)
            share = np.cumsum(size**2) / max((size**2).sum(), 1e-300)
            axes = axes[: int(np.searchsorted(share, kept - 1e-12) + 1)]
            coef = fit_logistic(np.hstack([(plain[train] - base_center) / base_scale, z @ axes.T]), y[train], c)
            out.append((*[part[g].iloc[0] for g in group], int(k), center.tolist(), scale.tolist(), base_center.tolist(), base_scale.tolist(), axes.tolist(), coef.tolist()))
        return pd.DataFrame(out, columns=[*group, "fold", "center", "scale", "base_center", "base_scale", "pca", "coef"])

    kinds = dict(rows.dtypes)
    arrays = ", ".join(f"{c} array<double>" for c in ("center", "scale", "base_center", "base_scale"))
    schema = ", ".join([*[f"`{g}` {kinds[g]}" for g in group], "fold int", arrays, "pca array<array<double>>", "coef array<double>"])
    return dealt(rows.select(*group, "fold", "y", "x", *base), group).groupBy(*group).applyInPandas(fit, schema)


def behaviour_on_phonetic(vectors: DataFrame, phonetic: DataFrame, behavioural: DataFrame, key: list[str], n_base: int) -> DataFrame:
    """The behavioural decoder on the phonetic window: the phonetic scaler, the behavioural axes, zeroed baseline features,
    the behavioural classifier. ``vectors``: the phonetic window's, of the trials each fold held out, y the acoustic target."""
    return composed(vectors, key, phonetic, behavioural, behavioural, n_base)


def phonetic_on_behaviour(vectors: DataFrame, phonetic: DataFrame, behavioural: DataFrame, key: list[str]) -> DataFrame:
    """The phonetic decoder on the behavioural window: the behavioural scaler of the signal, then the phonetic axes (if it
    has any) and classifier. ``vectors``: the behavioural window's, of the trials each fold held out, y the behaviour."""
    return composed(vectors, key, behavioural, phonetic, phonetic)


def whole_pipeline(vectors: DataFrame, models: DataFrame, key: list[str], base: list[str]) -> DataFrame:
    """A model with baseline features as it is, on any window's vectors: own scalers, axes and classifier."""
    rows = vectors.join(models.select(*key, F.col("base_center").alias("_bc"), F.col("base_scale").alias("_bs")), key)
    names = [f"_b{i}" for i in range(len(base))]
    rows = rows.withColumns({n: (F.col(b).cast("double") - F.get("_bc", F.lit(i))) / F.get("_bs", F.lit(i)) for i, (n, b) in enumerate(zip(names, base, strict=True))})
    return composed(rows, key, models, models, models, len(base), names).drop("_bc", "_bs", *names)


# --- weights taken back to the channels ---


def back_projected(models: DataFrame, n_base: int = 0) -> DataFrame:
    """``models`` (pca, coef and others) with weights, the classifier's coefficients of the axes taken back to the features
    that went into these, and base_weights, those of the baseline features."""
    own = F.slice("coef", n_base + 1, F.greatest(F.size("coef") - n_base, F.lit(0)))
    width = F.size(F.get("pca", F.lit(0)))
    places = F.sequence(F.lit(0), width - 1)
    weights = F.transform(places, lambda i: _dot(own, F.transform("pca", lambda axis: F.get(axis, i))))
    same = (F.size(own) == F.size("pca")) & F.forall("pca", lambda axis: F.size(axis) == width)
    return models.withColumn("weights", _fits(weights, same, "axes and coefficients")).withColumn("base_weights", F.slice("coef", 1, n_base))


def split_weights(models: DataFrame, keys: list[str], n_channels: int) -> DataFrame:
    """``keys``, channel, place, weight: the weights of ``back_projected`` cut into equal runs, one a channel, places kept."""
    size = F.size("weights") / n_channels
    whole = _fits(F.col("weights"), F.size("weights") % n_channels == 0, "channels")
    long = models.select(*keys, size.cast("int").alias("_n"), F.posexplode(whole).alias("_i", "weight"))
    return long.select(*keys, F.floor(F.col("_i") / F.col("_n")).cast("int").alias("channel"), (F.col("_i") % F.col("_n")).alias("place"), "weight")


def coefficient_table(models: DataFrame, keys: list[str], coefficients: str, features: list[str], n_lags: int) -> DataFrame:
    """``keys``, feature, lag, coef: an array of coefficients, feature by feature with all lags of each, in long form."""
    whole = _fits(F.col(coefficients), F.size(coefficients) == len(features) * n_lags, "features and lags")
    long = models.select(*keys, F.posexplode(whole).alias("_i", "coef"))
    name = F.get(F.array(*map(F.lit, features)), F.floor(F.col("_i") / n_lags).cast("int"))
    return long.select(*keys, name.alias("feature"), (F.col("_i") % n_lags).alias("lag"), "coef")
