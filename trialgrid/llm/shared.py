"""Helpers that several operators of this subpackage use: tables in the shared folder, and ranks without a single task."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: runs of anything but space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a small side (two longs each at most) up to which a broadcast is allowed; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

#: Rows of a file at least, where a narrow table's rows are counted or bounded before it is written.
FILE_ROWS = 8192

#: Set while a table is written, it deletes the job's shuffle files at its end; else they stay until the driver happens to
#: collect its garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset a folder of our own if all runs on
    one machine, as in tests, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/trialgrid"
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_dir[0]


def stored(df: DataFrame, partition_by: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends there, and a lost executor costs only a reread.
    ``most``: no more rows than that are written; they go into files of ``FILE_ROWS`` rows or so, where that makes fewer
    files than shuffle partitions, as opening a file takes longer than writing some hundred rows."""
    spark = df.sparkSession
    if most is not None and (files := max(1, -(-most // FILE_ROWS))) < partitions(spark):
        df = df.coalesce(files)
    path = f"{shared_dir(spark)}/trialgrid-{uuid.uuid4().hex}"
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "zstd")
    with setting(spark, SHUFFLES_END, "true"):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at, out._stored_seen = path, seen  # so that drop_stored and stored_rows can find them
    return out


def stored_rows(df: DataFrame) -> int:
    """Rows of a table of ``stored``, as counted by the job that wrote it."""
    return df._stored_seen.get["n"]


def stored_sorted(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As ``stored``, dealt into ``buckets`` by the hash of ``key`` and sorted by it: joins of two such tables on ``key``
    move no rows. Spark keeps buckets in its catalog only, so this is an external table there until ``drop_stored``."""
    spark = df.sparkSession
    name = f"trialgrid_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    with setting(spark, SHUFFLES_END, "true"):
        df.write.mode("overwrite").option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    _written.append((spark, path))
    out = spark.table(name)
    out._stored_at, out._stored_as = path, name
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete a table of ``stored`` or ``stored_sorted`` that nothing reads any more."""
    if name := getattr(df, "_stored_as", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session may be gone at exit; nothing depends on this
            return


def tidy(run):
    """A function for ``mapInArrow`` that gives its freed memory back to the machine when its task ends: idle Python workers
    stay, and those of earlier stages would else hold theirs beside the next stage's."""

    def whole(batches):
        if not gc.get_freeze_count():
            gc.freeze()  # modules stay anyway; the search for garbage at each task's end needn't go through them
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            gc.collect()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Jobs that run inside have this setting of the session."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that run inside send batches of ``most`` rows at most to Python; a batch is in memory twice on either side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_or_shuffled(small: DataFrame, rows: int) -> DataFrame:
    """``small`` with a broadcast hint if its counted rows allow that, else with a shuffle-hash hint."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small.hint("shuffle_hash")


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def unit(key: Column) -> Column:
    """A 64-bit hash as a double in (0, 1)."""
    return (F.shiftrightunsigned(key, 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def bucket_count(rows: int, target: int = 512, most: int = 1 << 20) -> int:
    """Buckets to cut ``rows`` ordered rows into: ``target`` rows each, and more where a million buckets don't suffice."""
    return max(1, min(most, -(-rows // target)))


def exact_quantile(rows: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """``group``, ``quantile``: the interpolated quantile of a positive ``value``, as ``percentile`` gives it, without a
    group's values in one task: equal values are counted first, then bins of the value's logarithm; only the bins that
    hold the two ranks around the quantile are ordered, each by itself. One row per group, whose groups must be few."""
    counts = stored(rows.groupBy(group, F.col(value).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_bin", F.floor(F.log2("_v") * 4096)))
    bins = counts.groupBy(group, "_bin").agg(F.sum("_n").alias("_n"))
    total = bins.groupBy(group).agg(F.sum("_n").alias("_all")).withColumn("_at", (F.col("_all") - 1) * F.lit(q))
    run = Window.partitionBy(group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0))).join(F.broadcast(total), group)
    has = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
    low, high = F.floor("_at"), F.ceil("_at")
    wanted = bins.where(has(low) | has(high)).select(group, "_bin", "_before", "_at")  # two rows a group at most
    inside = Window.partitionBy(group, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    near = counts.join(F.broadcast(wanted), [group, "_bin"])
    near = near.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    share = F.col("_at") - low
    return near.groupBy(group).agg((F.max(F.when(has(low), F.col("_v") * (1 - share))) + F.max(F.when(has(high), F.col("_v") * share))).alias("quantile"))
