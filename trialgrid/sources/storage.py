"""Intermediate tables in the folder that all executors share: lineage ends there, so a lost executor costs a reread."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, the warehouse on a cluster and a folder of our own on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/trialgrid"
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own[0]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/trialgrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone at exit; nothing depends on this
            return
