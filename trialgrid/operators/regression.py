"""Least squares from sums: windowed multi-output regression, nested choice of the penalty, unique variance, F tests.

Spark sums products of terms and outputs by cell of a split (outer and inner fold). A fit that leaves cells out takes
their sums from the total, so no row is read again for a fold, a penalty, or a model without a block of terms; one
decomposition of a training part serves all penalties. Sums are as large as the number of terms and not of rows. The
solver sees one output of one group at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.functions.special import f_tail
from trialgrid.operators.relational import hash_order

#: The term that every row has; it is never penalised and never dropped.
ONE = "1"


def terms_by_condition(features: list[str], condition: str) -> Column:
    """Sparse terms of a row: each feature under its name and the row's condition. Null and zero values have no term."""
    cells = [F.struct(F.concat(F.lit(f"{f}-"), F.col(condition).cast("string")).alias("term"), F.col(f).cast("double").alias("x")) for f in features]
    return F.filter(F.array(*cells), lambda c: c["x"] != 0)


def terms_of_array(name: str, x: str) -> Column:
    """A term for each place of an array."""
    return F.transform(x, lambda v, i: F.struct(F.concat(F.lit(f"{name}-"), i.cast("string")).alias("term"), v.cast("double").alias("x")))


def nested_cells(trials: DataFrame, group: list[str], trial: str, stratum: list[str], outer: int, inner: int, seed: int = 0) -> DataFrame:
    """``group``, ``trial``, outer, inner: trials of each stratum dealt in hash order to outer folds, and in turn to inner ones."""
    place = F.row_number().over(Window.partitionBy(*group, *stratum).orderBy(hash_order(trial, seed), trial)) - 1
    rows = trials.select(*group, trial, *stratum).withColumn("_k", place)
    return rows.select(*group, trial, (F.col("_k") % outer).cast("int").alias("outer"), (F.floor(F.col("_k") / outer) % inner).cast("int").alias("inner"))


def gram_sums(design: DataFrame, group: list[str]) -> DataFrame:
    """``group``, outer, inner, term, other, xx: sums of products, each pair of terms once (term <= other).

    ``design``: group, outer, inner and terms, an array of (term, x). The constant term is added.
    """
    one = F.array(F.struct(F.lit(ONE).alias("term"), F.lit(1.0).alias("x")))
    rows = design.select(*group, "outer", "inner", F.concat(one, "terms").alias("terms"))
    rows = rows.select(*group, "outer", "inner", "terms", F.explode("terms").alias("a"))
    pairs = rows.select(*group, "outer", "inner", "a", F.explode("terms").alias("b")).where("a.term <= b.term")
    return pairs.groupBy(*group, "outer", "inner", F.col("a.term").alias("term"), F.col("b.term").alias("other")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("xx"))


def output_sums(design: DataFrame, responses: DataFrame, group: list[str], trial: str, output: list[str], value: str) -> DataFrame:
    """``group``, ``output``, outer, inner, term, xy and yy: products of terms and outputs; yy, the squares, stands at the constant term."""
    one = F.array(F.struct(F.lit(ONE).alias("term"), F.lit(1.0).alias("x")))
    rows = design.select(*group, trial, "outer", "inner", F.concat(one, "terms").alias("terms")).join(responses.select(*group, trial, *output, F.col(value).alias("_y")), [*group, trial])
    long = rows.select(*group, *output, "outer", "inner", "_y", F.explode("terms").alias("t"))
    sums = long.groupBy(*group, *output, "outer", "inner", F.col("t.term").alias("term"))
    return sums.agg(F.sum(F.col("t.x") * F.col("_y")).alias("xy"), F.sum(F.when(F.col("t.term") == ONE, F.col("_y") * F.col("_y"))).alias("yy"))


class Sums:
    """Sums of one output: xx (terms, the constant first), xy, yy of each cell."""

    def __init__(self, names: list[str], xx: np.ndarray, xy: np.ndarray, yy: np.ndarray) -> None:
        self.names, self.xx, self.xy, self.yy = names, xx, xy, yy

    def of(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        return self.xx[cells].sum(0), self.xy[cells].sum(0), float(self.yy[cells].sum())


def ridge_path(xx: np.ndarray, xy: np.ndarray, alphas: np.ndarray, scaled: bool) -> np.ndarray:
    """Coefficients (constant first) for each penalty, from one decomposition. Terms that don't vary get 0."""
    n = xx[0, 0]
    mean, top = xx[0, 1:] / n, xy[0] / n
    a, b = xx[1:, 1:] - n * np.outer(mean, mean), xy[1:] - n * mean * top
    deviation = np.sqrt(np.maximum(np.diag(a), 0) / n)
    live = deviation > 1e-9 * np.sqrt(np.maximum(np.diag(xx)[1:] / n, 1e-300))
    scale = np.where(live, deviation if scaled else 1.0, 1.0)
    a, b = (a / np.outer(scale, scale))[np.ix_(live, live)], (b / scale)[live]
    values, axes = np.linalg.eigh(a) if live.any() else (np.zeros(0), np.zeros((0, 0)))
    values = np.maximum(values, 0)
    with np.errstate(divide="ignore"):
        shrunk = np.where(values[None] + alphas[:, None] > 1e-12 * max(values.max(initial=0), 1e-300), 1 / (values[None] + alphas[:, None]), 0.0)
    w = np.zeros((len(alphas), len(scale)))
    w[:, live] = (shrunk * (axes.T @ b)) @ axes.T / scale[live]
    return np.hstack([(top - w @ mean)[:, None], w])


def r_squared(w: np.ndarray, xx: np.ndarray, xy: np.ndarray, yy: float) -> float:
    """Of coefficients on the rows behind the sums; NaN where the output doesn't vary there or there are fewer than two rows."""
    n = xx[0, 0]
    total = yy - xy[0] ** 2 / n if n > 1 else 0.0
    return float(1 - (yy - 2 * w @ xy + w @ xx @ w) / total) if total > 1e-12 * max(yy, 1e-300) else np.nan


def nested_fit(sums: Sums, outer: np.ndarray, inner: np.ndarray, alphas: np.ndarray, blocks: dict[str, list[str]], scaled: bool) -> list[dict]:
    """For each outer fold the penalty with the best mean inner R2 (the first of equal ones), its fit on all other folds,
    R2 on the fold, and what R2 loses without each block at the same penalty."""
    out = []
    for k in np.unique(outer):
        train, test = outer != k, outer == k
        if not train.any() or sums.of(train)[0][0, 0] < 2:
            continue
        scores = []
        for j in np.unique(inner[train]):
            rest, held = train & (inner != j), train & (inner == j)
            if rest.any() and sums.of(rest)[0][0, 0] >= 2:
                xx, xy, _ = sums.of(rest)
                scores.append([r_squared(w, *sums.of(held)) for w in ridge_path(xx, xy, alphas, scaled)])
        mean = np.nanmean(np.where(np.isnan(scores), np.nan, scores), axis=0) if scores and not np.isnan(scores).all(0).any() else np.zeros(len(alphas))
        alpha = float(alphas[int(np.argmax(np.round(mean, 12)))])
        w = ridge_path(*sums.of(train)[:2], np.array([alpha]), scaled)[0]
        score = r_squared(w, *sums.of(test))
        row = {"outer": int(k), "alpha": alpha, "r2": score, "coef": w.tolist(), "unique": {}}
        for name, dropped in blocks.items():
            keep = np.array([t not in dropped and t.split("-")[0] not in dropped for t in sums.names])
            keep[0] = True
            part = Sums([], sums.xx[:, keep][:, :, keep], sums.xy[:, keep], sums.yy)
            less = ridge_path(*part.of(train)[:2], np.array([alpha]), scaled)[0]
            row["unique"][name] = score - r_squared(less, *part.of(test))
        out.append(row)
    return out


def nested_ridge(design: DataFrame, responses: DataFrame, group: list[str], trial: str, output: list[str], value: str, alphas: list[float], blocks: dict[str, list[str]] | None = None, scaled: bool = True) -> DataFrame:
    """A row for each output of a group and outer fold: alpha, r2, names, coef (the constant first), unique (by block).

    ``design``: group, trial, outer, inner, terms (each term once a row). ``responses``: group, trial, output, value; every
    output of a group has a value for all its trials. Rows with a null or NaN value, and groups without a second outer
    fold, give nothing. ``blocks``: terms, or the parts of their names before a dash, that are left out together. ``scaled``
    penalises terms in units of their training deviation. r2 is null where the output doesn't vary in the held-out fold.
    """
    responses = responses.where(F.col(value).isNotNull() & ~F.isnan(value))
    xx = gram_sums(design, group).groupBy(*group).agg(F.collect_list(F.struct("outer", "inner", "term", "other", "xx")).alias("_xx"))
    sums = output_sums(design, responses, group, trial, output, value)
    xy = sums.groupBy(*group, *output).agg(F.collect_list(F.struct("outer", "inner", "term", "xy", "yy")).alias("_xy"))
    rows = xy.join(xx, group) if group else xy.crossJoin(F.broadcast(xx))  # one row of sums
    grid, parts = np.array(alphas, float), dict(blocks or {})
    keys = [*group, *output]

    def solve(one: pd.DataFrame) -> pd.DataFrame:
        r = one.to_dict("records")[0]
        cells = sorted({(c["outer"], c["inner"]) for c in r["_xx"]})
        names = sorted({c["term"] for c in r["_xx"]} | {c["other"] for c in r["_xx"]}, key=lambda t: (t != ONE, t))
        at, place = {c: i for i, c in enumerate(cells)}, {t: i for i, t in enumerate(names)}
        s = Sums(names, np.zeros((len(cells), len(names), len(names))), np.zeros((len(cells), len(names))), np.zeros(len(cells)))
        for c in r["_xx"]:
            i, j = place[c["term"]], place[c["other"]]
            s.xx[at[c["outer"], c["inner"]], i, j] = s.xx[at[c["outer"], c["inner"]], j, i] = c["xx"]
        for c in r["_xy"]:
            i = at[c["outer"], c["inner"]]
            s.xy[i, place[c["term"]]] = c["xy"]
            if c["term"] == ONE:
                s.yy[i] = c["yy"]
        outer, inner = (np.array([c[i] for c in cells]) for i in (0, 1))
        found = [{**{k: r[k] for k in keys}, "names": names, **fit, "r2": None if np.isnan(fit["r2"]) else fit["r2"], "unique": {b: None if np.isnan(v) else v for b, v in fit["unique"].items()}} for fit in (nested_fit(s, outer, inner, grid, parts, scaled) if len(set(outer)) > 1 else [])]
        return pd.DataFrame(found, columns=[*keys, "outer", "alpha", "r2", "names", "coef", "unique"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "outer int", "alpha double", "r2 double", "names array<string>", "coef array<double>", "unique map<string,double>"])
    # a call has the sums of one output; in batches of rows a worker's memory would grow with the number of groups
    return rows.groupBy(*keys).applyInPandas(solve, schema)


def nested_f_tests(rows: DataFrame, group: list[str], y: str, steps: list[list[str]]) -> DataFrame:
    """Nested least squares: a row for each group and step (from 1): n, r2, rss, r2_gain, rss_drop, F, df1, df2, p.

    Step 0 is the constant alone; each step adds its columns to those before. Rows with a null in any column are left out.
    One pass sums all products; F is null where a step adds nothing (its columns depend on those before) or leaves no
    degrees of freedom or no residual.
    """
    names = [c for s in steps for c in s]
    known = rows.na.drop(subset=[y, *names])
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in names], F.col(y).cast("double")]
    sums = [F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    sizes, width = np.cumsum([1, *[len(s) for s in steps]]), len(cols)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                g = np.zeros((width, width))
                for i in range(width):
                    for j in range(i, width):
                        g[i, j] = g[j, i] = r[f"s{i}_{j}"]
                n, fits = g[0, 0], []
                total = g[-1, -1] - g[0, -1] ** 2 / n
                for p in sizes:
                    w = ridge_path(g[:p, :p], g[:p, -1], np.zeros(1), True)[0]
                    rank = 1 if p == 1 else 1 + int(np.linalg.matrix_rank(_correlations(g[:p, :p]), tol=1e-9))
                    fits.append((max(g[-1, -1] - 2 * w @ g[:p, -1] + w @ g[:p, :p] @ w, 0.0), rank))
                for k in range(1, len(fits)):
                    (rss0, p0), (rss1, p1) = fits[k - 1], fits[k]
                    df1, df2 = p1 - p0, int(n) - p1
                    fine = df1 > 0 and df2 > 0 and rss1 > 1e-12 * max(total, 1e-300)
                    f = (rss0 - rss1) / df1 / (rss1 / df2) if fine else None
                    share = lambda rss: 1 - rss / total if total > 0 else None  # noqa: B023, E731
                    out.append((*[r[c] for c in group], k, int(n), share(rss1), rss1, (rss0 - rss1) / total if total > 0 else None, rss0 - rss1, f, df1, df2, f_tail(f, df1, df2) if fine else None))
            yield pd.DataFrame(out, columns=[*group, "step", "n", "r2", "rss", "r2_gain", "rss_drop", "f", "df1", "df2", "p"])

    gathered = known.groupBy(*group).agg(*sums)
    kinds = dict(gathered.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in group], "step int, n long, r2 double, rss double, r2_gain double, rss_drop double, f double, df1 int, df2 int, p double"])
    return gathered.mapInPandas(solve, schema)


def _correlations(xx: np.ndarray) -> np.ndarray:
    n, mean = xx[0, 0], xx[0, 1:] / xx[0, 0]
    a = xx[1:, 1:] - n * np.outer(mean, mean)
    d = np.sqrt(np.maximum(np.diag(a), 0))
    live = d > 1e-9 * np.sqrt(np.maximum(np.diag(xx)[1:], 1e-300))
    d = np.where(live, d, 1.0)
    return np.where(np.outer(live, live), a / np.outer(d, d), 0.0)
