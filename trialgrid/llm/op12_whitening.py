"""Embedding whitening; the eigenpairs come from spectrum slicing.

Spark makes each distinct integer vector once, its sums and its Gram matrix about the nearest integer mean. All of these
are integers, so a rerun with other partitions has the same covariance to the last bit. The driver holds the covariance
alone, which has the square of the dimension as its size, whatever the number of rows.

Eigenpairs: reflections make the covariance tridiagonal once, which keeps its inertia under any shift s and makes
each factor L D L^T of the shifted matrix linear in the dimension. By Sylvester's law D has as many positive entries as there are
eigenvalues over s. Bisection on that count isolates each leading eigenvalue, Rayleigh quotient iteration starts inside
its interval and converges cubically, and counts on both sides of the result certify its number. Where the iteration
lands on another eigenvalue, the interval is cut on. Each vector is kept orthogonal to those before it, so that
eigenvalues which no double separates get an orthonormal basis of their space.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.llm.shared import free_name, stored

SCALE, OFFSET = 64.0, 1_000_000
COMPONENTS = 16

#: Entries beyond this have no exact sum of squares in a double's integers; the Gram matrix is then summed in doubles.
EXACT = 1 << 20
#: Rows after which a task hands out its partial sums, so that these stay exact.
FLUSH = 1 << 20
#: Entries of a block of rows that is worked on at once.
BLOCK = 1 << 19
#: Eigenvalues at most this share of the largest count as zero and have no component.
ZERO = 1e-13


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors as doubles, in blocks of rows of one length. Null vectors, empty ones, and vectors with null
    or non-finite entries or entries whose integer doesn't fit a long aren't there."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = column.values
    good = np.asarray(flat.is_valid()) if flat.null_count else np.ones(len(flat), bool)
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    good &= np.abs(values) < 2.0**56  # false for NaN too
    bad = np.concatenate([[0], np.cumsum(~good)])
    lengths = np.diff(offsets)
    fine = np.asarray(column.is_valid()) & (lengths > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    for dim in np.unique(lengths[fine]).tolist():
        rows = np.flatnonzero(fine & (lengths == dim))
        step = max(1, BLOCK // dim)
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            yield own, values[offsets[own][:, None] + np.arange(dim)]


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors).astype(np.int64) + OFFSET


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dim, x: a vector's integers less OFFSET in the fewest bytes that hold them all; equal vectors give equal bytes."""
    for batch in batches:
        for _, v in _vectors(batch.column(0)):
            y = integers(v) - OFFSET
            most = np.maximum(y.max(1), -1 - y.min(1))
            for low, high, kind in ((-1, 1 << 15, np.int16), (1 << 15, 1 << 31, np.int32), (1 << 31, (1 << 63) - 1, np.int64)):
                own = y[(most >= low) & (most < high)].astype(kind)
                if len(own):
                    data = pa.py_buffer(own.tobytes())
                    offsets = np.arange(len(own) + 1, dtype=np.int32) * own[0].nbytes
                    x = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), data])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), y.shape[1]), pa.int32()), x], names=["dim", "x"])


def _unpacked(batch: pa.RecordBatch, dim: int) -> Iterator[np.ndarray]:
    """Blocks of integer vectors from a batch of ``x``."""
    x = batch.column(0).combine_chunks() if isinstance(batch.column(0), pa.ChunkedArray) else batch.column(0)
    offsets = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64) if len(x) else np.zeros(1, np.int64)
    data = np.frombuffer(x.buffers()[2], np.uint8) if len(x) else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    for kind in (np.int16, np.int32, np.int64):
        width = dim * np.dtype(kind).itemsize
        rows, step = np.flatnonzero(sizes == width), max(1, BLOCK // dim)
        for at in range(0, len(rows), step):
            own = data[offsets[rows[at : at + step]][:, None] + np.arange(width)]
            yield np.ascontiguousarray(own).view(kind).astype(np.int64) + OFFSET


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, [0] * dim, np.full(dim, np.iinfo(np.int64).max), np.full(dim, np.iinfo(np.int64).min)
        for batch in batches:
            for x in _unpacked(batch, dim):
                n += len(x)
                part = x.sum(0) if np.abs(x).max() < 1 << 40 else x.astype(object).sum(0)
                total = [a + int(b) for a, b in zip(total, part, strict=True)]
                low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array(low), pa.array(high)],
                names=["j", "n", "s", "low", "high"],
            )

    return run


def _gram(dim: int, middle: list[int], mean: np.ndarray, exact: bool):
    """i, j, exact and double partial sums of the products of centred entries."""
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            g = total[upper]
            whole = pa.array(g if exact else [None] * len(g), pa.int64())
            parts = pa.array([None] * len(g) if exact else g, pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), whole, parts], names=["i", "j", "g", "f"])

        total, n = np.zeros((dim, dim), np.int64 if exact else float), 0
        for batch in batches:
            for x in _unpacked(batch, dim):
                y = (x - np.array(middle)).astype(float) if exact else x - mean
                step = max(1, (1 << 53) // max(1, int(np.abs(y).max()) ** 2)) if exact else len(y)
                for at in range(0, len(y), step):
                    part = y[at : at + step].T @ y[at : at + step]  # whole numbers below 2 ** 53
                    total += part.astype(total.dtype)
                n += len(x)
            if n >= FLUSH:
                yield out()
                total[:], n = 0, 0
        if n:
            yield out()

    return run


def distinct_vectors(df: DataFrame, vector: str) -> DataFrame:
    """dim, x: every distinct integer vector once, packed. Repeats go in the tasks first, so a very common vector is no hot key."""
    return stored(df.select(vector).mapInArrow(_packed, "dim int, x binary").distinct())


# --- eigenpairs of the covariance ---


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of a tridiagonal matrix that reflections make of ``v``, and the reflections' unit vectors."""
    a, turns = v.copy(), []
    for k in range(len(v) - 2):
        u = a[k + 1 :, k].copy()
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        size = np.linalg.norm(u)
        u = u / size if size else u
        turns.append(u)
        p = a[k + 1 :, k + 1 :] @ u
        p -= (u @ p) * u
        change = np.outer(2 * u, p)
        a[k + 1 :, k + 1 :] -= change
        a[k + 1 :, k + 1 :] -= change.T
        a[k + 1, k] -= 2 * u[0] * (u @ a[k + 1 :, k])
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), turns


def count_above(diagonal: list[float], squares: list[float], s: float, floor: float) -> int:
    """Eigenvalues over ``s``: the positive pivots D of the L D L^T of the shifted tridiagonal matrix."""
    out, pivot = 0, 1.0
    for d, e in zip(diagonal, squares, strict=True):
        pivot = d - s - e / pivot
        if abs(pivot) < floor:
            pivot = -floor
        out += pivot > 0
    return out


def solved(diagonal: np.ndarray, off: np.ndarray, s: float, b: np.ndarray, floor: float) -> np.ndarray:
    """x of (T - s I) x = b by elimination with row exchanges; a vanishing pivot becomes ``floor``."""
    n, y = len(b), b.tolist()
    d, up, up2, low = (diagonal - s).tolist(), [*off.tolist(), 0.0], [0.0] * n, off.tolist()
    for k in range(n - 1):
        if abs(low[k]) > abs(d[k]):
            d[k], low[k], up[k], d[k + 1] = low[k], d[k], d[k + 1], up[k]
            up2[k], up[k + 1] = up[k + 1], 0.0
            y[k], y[k + 1] = y[k + 1], y[k]
        if not d[k]:
            d[k] = floor
        part = low[k] / d[k]
        d[k + 1] -= part * up[k]
        up[k + 1] -= part * up2[k]
        y[k + 1] -= part * y[k]
    out = [0.0] * (n + 2)
    for k in range(n - 1, -1, -1):
        pivot = d[k] if abs(d[k]) > floor else floor
        out[k] = (y[k] - up[k] * out[k + 1] - up2[k] * out[k + 2]) / pivot
    return np.array(out[:n])


def leading_pairs(v: np.ndarray, most: int = COMPONENTS, zero: float = ZERO) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix by falling size, and their unit vectors as columns: the first ``most`` of those over
    ``zero`` times the largest."""
    dim = len(v)
    radius = np.abs(v).sum(1).max(initial=0.0)  # no eigenvalue is larger
    if not radius:
        return np.zeros(0), np.zeros((dim, 0))
    scale = 2.0 ** np.floor(np.log2(radius))
    v = v / scale
    eps = 4 * np.finfo(float).eps
    diagonal, off, turns = tridiagonal(v)
    plain, squares = diagonal.tolist(), [0.0, *(off * off).tolist()]
    counted = {4.0: 0, -4.0: dim}

    def above(s: float) -> int:
        if s not in counted:
            counted[s] = count_above(plain, squares, s, eps * eps)
        return counted[s]

    def halved(k: int, low: float, high: float) -> tuple[float, float]:
        half = (low + high) / 2
        return (half, high) if above(half) >= k else (low, half)

    values, found, rng = [], [], np.random.default_rng(12)
    for k in range(1, min(most, dim) + 1):
        low = max(s for s, c in counted.items() if c >= k)
        high = min(s for s, c in counted.items() if c < k and s > low)
        while True:
            while above(low) - above(high) > 1 and high - low > eps:
                low, high = halved(k, low, high)
            value, z, left = (low + high) / 2, rng.standard_normal(dim), np.inf
            for _ in range(30):
                z = solved(diagonal, off, value, z / np.linalg.norm(z), eps * eps)
                for other in found * 2:  # near ones would else share what rounding mixes
                    z -= (other @ z) * other
                z /= np.linalg.norm(z)
                product = diagonal * z
                product[1:] += off * z[:-1]
                product[:-1] += off * z[1:]
                value, before = z @ product, left
                left = np.linalg.norm(product - value * z)
                if left <= eps or left >= before / 2 and left < eps * dim:
                    break
            slack = max(left, eps) * 2
            if high - low <= eps or low - eps <= value <= high + eps and above(value - slack) >= k > above(value + slack):
                break
            low, high = halved(k, low, high)  # the iteration went to another eigenvalue
        if value <= zero * (values or [1.0])[0]:
            break
        values.append(value)
        found.append(z)
    vectors = np.array(found).T.reshape(dim, len(found))
    for k in range(len(turns) - 1, -1, -1):
        vectors[k + 1 :] -= np.outer(2 * turns[k], turns[k] @ vectors[k + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    return (vectors * (v @ vectors)).sum(0) * scale, vectors


# --- the model and its use ---


class Whitening:
    """What a fit gives: n, sums, mean, values and vectors of the components, trace, identity_error."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float) -> None:
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.middle = [(2 * s + n) // (2 * n) for s in sums]  # nearest integers to the mean
        self.rest = [s - n * m for s, m in zip(sums, self.middle, strict=True)]
        self.identity_error = float("nan")

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.middle)).astype(float) - np.array([r / self.n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, whole numbers of any size; none where a long doesn't hold it."""
        y = x - np.array(self.middle)
        if np.abs(y).max() >= 1 << 24 or self.n >= 1 << 31:
            y = y.astype(object)
        rest = np.array(self.rest, dtype=y.dtype)
        squares, products = (y * y).sum(1).astype(object), (y * rest).sum(1).astype(object)
        whole = self.n * self.n * squares - 2 * self.n * products + sum(r * r for r in self.rest)
        return [int(d) if d < 1 << 63 else None for d in whole]


def fit(df: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct integer vectors of ``df``; none if no vector is left. See ``whiten``."""
    found = distinct_vectors(df, vector)
    common = found.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return None
    dim = common["dim"]
    vectors = found.where(F.col("dim") == dim).select("x")
    sums = vectors.mapInArrow(_sums(dim), "j int, n long, s decimal(38,0), low long, high long")
    sums = sorted(sums.groupBy("j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).collect())
    n, total = sums[0].n, [int(r.s) for r in sums]
    model = Whitening(n, total, np.zeros(0), np.zeros((dim, 0)), 0.0)
    exact = max(max(abs(r.low - m), abs(r.high - m)) for r, m in zip(sums, model.middle, strict=True)) < EXACT
    mean = np.array([s / n for s in total])
    gram = vectors.mapInArrow(_gram(dim, model.middle, mean, exact), "i int, j int, g long, f double")
    v = np.zeros((dim, dim))
    for r in gram.groupBy("i", "j").agg(F.sum(F.col("g").cast("decimal(38,0)")).alias("g"), F.sum("f").alias("f")).collect():
        # n * sum(y y) - sum(y) sum(y) is a whole number, divided once
        v[r.i, r.j] = v[r.j, r.i] = (n * int(r.g) - model.rest[r.i] * model.rest[r.j]) / (n * n) if exact else r.f / n
    values, axes = leading_pairs(v, most)
    model = Whitening(n, total, values, axes, float(np.trace(v)))
    model.identity_error = _identity_error(vectors, dim, model)
    return model


def _identity_error(vectors: DataFrame, dim: int, model: Whitening) -> float:
    """Measured on the fit list: the largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = len(model.values)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for x in _unpacked(batch, dim):
                w = model.whitened(x)
                total += np.concatenate([w.sum(0)[None], w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "t"])

    total = np.zeros((k + 1) * k)
    for r in vectors.mapInArrow(run, "at int, t double").groupBy("at").agg(F.sum("t").alias("t")).collect():
        total[r["at"]] = r["t"]
    total = total.reshape(k + 1, k) / model.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: ``key``, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out, as are entries of 2 ** 56 and more,
    which have no long. If lengths differ, the length of most distinct vectors (the smaller of two) is the one that is
    fitted and returned. Repeated rows and null keys are rows like any other, repeated vectors count once in the fit.
    There are as many components as the covariance has eigenvalues over ZERO times the largest, 16 at most: none if all
    vectors are equal. Equal eigenvalues get any orthonormal vectors of their space. deviation is null if it doesn't fit a
    long. More columns of ``df``, of any name, are ignored. An empty table gives no rows.
    """
    names = [key, *free_name(df.select(key), "component", "n", "deviation", "whitened", "explained", "identity_error")]
    kind = df.schema[key].dataType.simpleString()
    model = fit(df, vector, most)
    schema = f"`{key}` {kind}, `{names[1]}` int, `{names[2]}` long, `{names[3]}` long, " + ", ".join(f"`{c}` double" for c in names[4:])
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    k, dim = len(model.values), len(model.sums)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, v in _vectors(batch.column(1)):
                if v.shape[1] != dim:
                    continue
                x, many = integers(v), len(rows) * k
                columns = [
                    batch.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()), pa.array(np.full(many, model.n), pa.int64()),
                    pa.array([d for d in model.deviations(x) for _ in range(k)], pa.int64()), pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(many, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(F.col(key), F.col(vector).alias(free_name(df.select(key), "v")[0])).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
