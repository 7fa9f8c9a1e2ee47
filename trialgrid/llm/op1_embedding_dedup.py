"""Near-duplicate embeddings by randomised-rotation binary codes.

Each vector is rotated by seeded random rotations and kept as the signs of its coordinates, with a correction factor
for each rotation: the inner product of the vector and its own code. Dividing a code's inner product with another
vector by that factor estimates the two vectors' inner product without bias; the mean over rotations has a known spread,
and a pair is recomputed exactly only if the threshold lies below the estimate's upper confidence bound.

Which pairs are estimated at all: bits of the codes, taken a few at a time, put each vector into a bucket of each of
some tables, and pairs within a bucket are estimated. The bits of a table grow with the logarithm of the label's size,
so that buckets stay small; the tables grow so that a pair at the threshold shares no bucket with a chance of 1e-7 at
most, a closer pair with less. A pair is counted in the first table where it meets. Buckets over a fixed size are cut
into blocks that meet pairwise. Pairs never become rows: a bucket gives a row for each vector that has partners in it.

Equal vectors with equal labels are one vector with a count from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.llm.components import components
from trialgrid.llm.shared import stored
from trialgrid.llm.textbytes import cells, mix

THRESHOLD = 0.93
#: Bound in standard deviations, rotations an estimate uses, chance to miss a pair at the threshold, vectors of a bucket (aim, and most before it is cut).
SIGMAS, ESTIMATORS, MISS, AIM, BLOCK = 5.0, 4, 1e-7, 256, 2048


@lru_cache(maxsize=256)
def rotation(number: int, dim: int) -> np.ndarray:
    """A seeded random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([number, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=None)
def table_shape(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a table and number of tables for a label of n vectors."""
    bits = min(30, max(0, round(np.log2(max(1, n / AIM)))))
    together = (1 - np.arccos(threshold) / np.pi) ** bits
    return bits, 1 if bits == 0 else int(np.ceil(np.log(MISS) / np.log1p(-together)))


def _coded(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of tables: bucket, table, uid, signs (of all rotations), factors and the vector in 8 bits."""
        for batch in batches:
            shape = np.array([batch.column("d").to_numpy(), batch.column("n").to_numpy()])
            flat, ends = batch.column("embedding").values.to_numpy(zero_copy_only=False), np.cumsum(shape[0])
            skip = batch.column("embedding").offsets[0].as_py()
            for d, n in np.unique(shape, axis=1).T.tolist():
                at = np.flatnonzero((shape[0] == d) & (shape[1] == n))
                x = _unit(flat[skip + (ends[at] - d)[:, None] + np.arange(d)].astype(np.float64))
                bits, tables = table_shape(n, threshold)
                n_rot = max(-(-bits * tables // d), ESTIMATORS)
                turned = [x @ rotation(r, d).T for r in range(n_rot)]
                sign = np.concatenate(turned, 1) >= 0
                factor = np.stack([np.abs(t).sum(1) / np.sqrt(d) for t in turned[:ESTIMATORS]], 1).astype(np.float32)
                keys = _table_keys(sign, bits, tables)
                step = np.abs(x).max(1) / 127
                small = np.rint(x / step[:, None]).astype(np.int8)
                label = batch.column("label_hash").to_numpy()[at].view(np.uint64)
                uid = batch.column("uid").take(pa.array(at))
                fixed = [uid, _binary(np.packbits(sign, axis=1)), _binary(factor), _binary(small), pa.array(step.astype(np.float32)), pa.array(np.full(len(at), d, np.int32)), pa.array(np.full(len(at), bits, np.int32))]
                for t in range(tables):
                    bucket = mix(mix(label + np.uint64(d)) + (np.uint64(t) << np.uint64(32)) + keys[:, t])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(np.full(len(at), t, np.int32)), *fixed], names=["bucket", "t", "uid", "codes", "factor", "small", "step", "d", "bits"])

    return run


_CODED = "bucket long, t int, uid long, codes binary, factor binary, small binary, step float, d int, bits int"


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their length; scaled first, as squares of very large or small components leave the range of a double."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _table_keys(sign: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A number for each row and table, of the table's own ``bits`` signs."""
    keys = np.zeros((len(sign), tables), np.uint32)
    for b in range(bits):
        keys |= sign[:, b : bits * tables : bits].astype(np.uint32) << np.uint32(b)
    return keys


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    size = rows.shape[1] * rows.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, size * len(rows) + 1, max(size, 1), dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition sorted by ``keys``, one after the other, whatever batches they lie in."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        cols = [table.column(k).to_numpy() for k in keys]
        new = np.zeros(table.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        if not table.num_rows:
            continue
        new[0] = last is not None and any(c[0] != v for c, v in zip(cols, last, strict=True))
        cut = [0, *np.flatnonzero(new).tolist(), table.num_rows] if not new[0] else [*np.flatnonzero(new).tolist(), table.num_rows]
        if new[0] and held:
            yield pa.concat_tables(held)
            held = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a and held:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
        last = [c[-1] for c in cols]
    if held:
        yield pa.concat_tables(held)


def _rows(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    parts = []
    for chunk in column.chunks:
        data, offsets = cells(chunk)
        parts.append(data[offsets[0] : offsets[-1]].reshape(len(chunk), -1))
    return np.ascontiguousarray(np.concatenate(parts)).view(dtype)


def _partners(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each vector of a block pair with partners that the bound can't rule out: group, uid, place and the partners' places."""
        for group in whole_groups(batches, ["bucket", "lo", "hi"]):
            n = group.num_rows
            if n < 2:
                continue
            d, t = group.column("d")[0].as_py(), group.column("t")[0].as_py()
            uid, block = group.column("uid").to_numpy(), group.column("block").to_numpy()
            signs = np.unpackbits(_rows(group.column("codes"), np.uint8), axis=1)
            sign = signs[:, : ESTIMATORS * d].reshape(n, ESTIMATORS, d).astype(np.float32) * 2 - 1
            factor = _rows(group.column("factor"), np.float32)
            step = group.column("step").to_numpy()
            x = _rows(group.column("small"), np.int8).astype(np.float32) * step[:, None]
            mean = np.zeros((n, n), np.float32)
            for r in range(ESTIMATORS):
                mean += sign[:, r] @ (x @ rotation(r, d).T.astype(np.float32)).T / (np.sqrt(d) * factor[:, r : r + 1])
            mean /= ESTIMATORS
            spread = np.sqrt(((1 - np.minimum(factor, 1) ** 2) / factor**2).mean(1) / (ESTIMATORS * max(1, d - 1)))
            rounding = step * np.sqrt(d) / 2 / factor.min(1)  # at most this far off by the 8 bits
            may = mean + (SIGMAS * spread)[:, None] + rounding[None, :] + 1e-5 >= threshold
            may &= np.triu(np.ones((n, n), bool), 1) if block[0] == block[-1] and (block == block[0]).all() else (block[:, None] < block[None, :])
            i, j = np.nonzero(may)
            if t and len(i):
                keys = _table_keys(signs.astype(bool), group.column("bits")[0].as_py(), t)
                first = np.concatenate([~(keys[i[a : a + 65536]] == keys[j[a : a + 65536]]).any(1) for a in range(0, len(i), 65536)])
                i, j = i[first], j[first]
            if len(i):
                used = np.unique(np.concatenate([i, j]))
                at = np.searchsorted(i, used)
                to = np.searchsorted(i, used, "right")
                key = mix(group.column("bucket").to_numpy()[:1].view(np.uint64) + np.uint64((group.column("lo")[0].as_py() << 20) + group.column("hi")[0].as_py())).view(np.int64)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), key)), pa.array(used.astype(np.int32)), pa.array(uid[used]), pa.array([j[a:b].astype(np.int32).tobytes() for a, b in zip(at, to, strict=True)], pa.binary())], names=["bucket", "place", "uid", "partners"])

    return run


def _exact(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact cosines of the partners in each group: for each vector the vectors it links with, and one link of a forest."""
        for group in whole_groups(batches, ["bucket"]):
            place, uid, copies = (group.column(c).to_numpy() for c in ("place", "uid", "copies"))
            x = _unit(np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in group.column("embedding").chunks]).astype(np.float64).reshape(group.num_rows, -1))
            partners = [np.frombuffer(b, np.int32) for b in group.column("partners").to_pylist()]
            i = np.repeat(np.arange(len(place)), [len(p) for p in partners])
            j = np.searchsorted(place, np.concatenate(partners))
            good = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + 16384]], x[j[a : a + 16384]]) >= threshold for a in range(0, len(i), 16384)])
            i, j = i[good], j[good]
            if not len(i):
                continue
            n = np.bincount(i, copies[j], len(place)) + np.bincount(j, copies[i], len(place))
            root = list(range(len(place)))
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                while root[a] != a:
                    root[a] = a = root[root[a]]
                while root[b] != b:
                    root[b] = b = root[root[b]]
                root[max(a, b)] = min(a, b)
            for v in range(len(root)):  # roots point down, so one pass flattens
                root[v] = root[root[v]]
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(n.astype(np.int64)), pa.array(uid[root])], names=["uid", "linked", "to"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links and components of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows link when labels and dimensions are equal and the cosine (double precision) reaches the threshold. A row with
    a null label or vec_id, or a vector that is null, empty, zero or holds null or non-finite components, links with
    nothing and is its own component (null where vec_id is null, and then not kept). Every row of a repeated vec_id is
    a vector of its own. More columns are ignored; an empty table gives no rows.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("embedding"), "label").withColumn("uid", F.when(F.coalesce(fine, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.xxhash64("label", "embedding")))
    own = rows.where("uid is not null").groupBy("uid", "label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    own = stored(own.withColumn("d", F.size("embedding")).withColumn("label_hash", F.xxhash64("label")))
    sizes = own.groupBy("label_hash", "d").agg(F.count("*").alias("n"))
    coded = own.join(sizes, ["label_hash", "d"]).select("uid", "embedding", "d", "n", "label_hash")
    coded = coded.mapInArrow(_coded(threshold), _CODED)
    large = stored(coded.select("bucket").groupBy("bucket").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK))
    cut = coded.withColumn("blocks", F.lit(1))
    if large.limit(1).count():
        cut = coded.join(large, "bucket", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("k") / F.lit(BLOCK)), F.lit(1)).cast("int")).drop("k")
    cut = cut.withColumn("block", F.pmod(F.xxhash64(F.lit(9), "uid"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")
    found = cut.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "block", "uid").mapInArrow(_partners(threshold), "bucket long, place int, uid long, partners binary")
    checked = stored(found).join(own.select("uid", "embedding", "copies"), "uid").repartition("bucket").sortWithinPartitions("bucket", "place")
    links = stored(checked.mapInArrow(_exact(threshold), "uid long, linked long, to long"))
    linked = links.groupBy("uid").agg(F.sum("linked").alias("linked"))
    group = components(links.select(F.col("uid").alias("a"), F.col("to").alias("b"))).toDF("uid", "root")
    known = own.select("uid", "least", "copies").join(linked, "uid", "left").join(group, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    known = known.join(known.groupBy("root").agg(F.min("least").alias("component")), "root")
    known = known.select("uid", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    out = rows.select("vec_id", "uid").join(known, "uid", "left")
    component = F.coalesce("component", F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
