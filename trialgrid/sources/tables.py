"""Reading and writing: keyed multi-file scans, table sets, and the stand-in views on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats by suffix, with reader options.
FORMATS = {"csv": ("csv", {"header": "true"}), "tsv": ("csv", {"header": "true", "sep": "\t"}), "parquet": ("parquet", {}), "json": ("json", {})}


def read_keyed(spark: SparkSession, glob: str, keys: dict[str, str | Column], schema: str | None = None) -> DataFrame:
    """All files of a glob, with key columns taken from each path: a pattern with one group, or a column over ``path``.

    The suffix decides the format. A glob without files gives an empty table with the key columns (and the schema's).
    """
    suffix = glob.rsplit(".", 1)[-1]
    if suffix not in FORMATS:
        raise ValueError(f"no reader for .{suffix}")
    kind, options = FORMATS[suffix]
    reader = spark.read.format(kind).options(**options)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where):
        return spark.createDataFrame([], ", ".join(filter(None, [schema, *[f"{k} string" for k in keys]])))
    rows = (reader.schema(schema) if schema else reader).load(glob).withColumn("path", F.col("_metadata.file_path"))
    for name, key in keys.items():
        rows = rows.withColumn(name, F.regexp_extract("path", key, 1) if isinstance(key, str) else key)
    return rows.drop("path")


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """A set of named tables, one folder each: results, models, scores or population records (``kind`` json)."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite").format(kind)
        (writer.partitionBy(*partition_by) if partition_by else writer).options(**(FORMATS[kind][1])).save(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, schemas: dict[str, str], kind: str = "parquet") -> dict[str, DataFrame]:
    """A set of named tables back, cast to their schemas."""
    return {name: spark.read.format(kind).options(**FORMATS[kind][1]).schema(schema).load(f"{folder}/{name}") for name, schema in schemas.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold predictions by site and window: site, smin, fold, word, target, proba, baseline_proba, epoch."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("site"), F.col("l_linenumber").alias("smin"), (F.col("l_orderkey") % 5).cast("int").alias("fold"), F.col("l_linestatus").alias("word"),
        (F.col("l_returnflag") == "R").cast("int").alias("target"), F.col("l_discount").alias("proba"), F.col("l_tax").alias("baseline_proba"), F.col("l_orderkey").alias("epoch"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials: subject, electrode, epoch, step 1..6, response 0/1, slider 1..10, pair, lexical 0/1, value, ts, word, left."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("subject"), F.col("user_id").alias("electrode"), F.col("event_id").alias("epoch"), (k % 6 + 1).alias("step"),
        F.col("event_type").isin("purchase", "click").cast("int").alias("response"), (F.lit(1) + F.least(F.floor(F.col("value") / 10), F.lit(9))).cast("double").alias("slider"),
        F.element_at(F.array(F.lit("bm"), F.lit("dn"), F.lit("pb")), (F.length("event_type") % 3 + 1).cast("int")).alias("pair"), (k % 2).alias("lexical"), "value", "ts", F.col("event_type").alias("word"),
    ).withColumn("left", F.substring("pair", F.when(F.col("epoch") % 4 == 0, 2).otherwise(1), F.lit(1)))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals: epoch, channel 0..2, samples array<double>, cls 0/1."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("epoch"), (F.col("label") % 3).cast("int").alias("channel"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"), (F.col("label") >= 5).cast("int").alias("cls"))


#: The same views in DuckDB.
SQL_VIEWS = r"""
v_predictions AS (SELECT l_suppkey AS site, l_linenumber AS smin, CAST(l_orderkey % 5 AS INT) AS fold, l_linestatus AS word, CAST(l_returnflag = 'R' AS INT) AS target, l_discount AS proba, l_tax AS baseline_proba, l_orderkey AS epoch FROM lineitem),
v_events AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
v_trials AS (SELECT *, substring(pair, CASE WHEN epoch % 4 = 0 THEN 2 ELSE 1 END, 1) AS "left" FROM (SELECT user_id % 10 AS subject, user_id AS electrode, event_id AS epoch, k % 6 + 1 AS step, CAST(event_type IN ('purchase', 'click') AS INT) AS response,
  CAST(1 + least(floor(value / 10), 9) AS DOUBLE) AS slider, ['bm', 'dn', 'pb'][length(event_type) % 3 + 1] AS pair, k % 2 AS lexical, value, ts, event_type AS word FROM v_events)),
v_epochs AS (SELECT vec_id AS epoch, CAST(label % 3 AS INT) AS channel, CAST(embedding AS DOUBLE[]) AS samples, CAST(label >= 5 AS INT) AS cls FROM embeddings),
v_samples AS (SELECT epoch, channel, cls, unnest(samples) AS x, CAST(unnest(range(len(samples))) AS INT) AS pos FROM v_epochs)
"""
