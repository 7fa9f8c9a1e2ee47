"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Each source's rows are ranked in a seeded random order; the rank divided by the source's size is a fraction in (0, 1),
evenly spread for each source. All rows sorted by that fraction are cut into equal runs, so each shard holds every
source in the proportion of the whole (to within one row or two), and shard sizes differ by one row at most.

Neither rank is taken in one task: rows fall into buckets of the ordering value (a uniform hash, then the fraction),
each bucket is ranked by itself, and a running sum of the bucket counts gives each bucket's first rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialgrid.llm.shared import bucket_count, free_name, partitions, stored, unit


def _first_ranks(counts: DataFrame, group: list[str]) -> DataFrame:
    """For each group's buckets: how many rows the earlier buckets hold. ``counts``: group columns, _wb, _wn."""
    run = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    run = run.orderBy("_wb").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_wbefore", F.coalesce(F.sum("_wn").over(run), F.lit(0)))


def interleave(df: DataFrame, source: str, tie: list[Column], n_shards: int, seed: int = 17) -> DataFrame:
    """Give each row ``shard`` (0..n_shards-1) and ``slot`` (gapless from 0 in its shard).

    ``tie``: columns that fix a row's place in the seeded order, most significant first; rows that agree in all of them
    are interchangeable. A null source is a source of its own. An empty table gives an empty result. Columns of ``df``
    may have any name but those starting with ``_w``; they are carried along, so pass narrow rows.
    """
    total = df.count()
    n_buckets = bucket_count(total)
    rows = df.withColumn("_wh", F.xxhash64(F.lit(seed), *tie)).withColumn("_wb", F.floor(unit(F.col("_wh")) * n_buckets).cast("int"))
    # a null source as a struct key, so that joins and windows treat it like any other
    rows = rows.withColumn("_ws", F.struct(F.col(source).isNull().alias("z"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s")))
    counts = rows.groupBy("_ws", "_wb").agg(F.count("*").alias("_wn"))
    firsts = _first_ranks(counts, ["_ws"]).join(counts.groupBy("_ws").agg(F.sum("_wn").alias("_wtotal")), "_ws").select("_ws", "_wb", "_wbefore", "_wtotal")
    inside = Window.partitionBy("_ws", "_wb").orderBy("_wh", *tie)
    ranked = rows.withColumn("_wr", F.row_number().over(inside)).join(firsts, ["_ws", "_wb"])
    # a place in the row's own 1/n of the source, the same for all its rows, so that sources of one size don't fall together
    ranked = ranked.withColumn("_wf", (F.col("_wbefore") + F.col("_wr") - unit(F.xxhash64(F.lit(seed), "_ws"))) / F.col("_wtotal"))
    ranked = stored(ranked.withColumn("_wb", F.least(F.floor(F.col("_wf") * n_buckets).cast("int"), F.lit(n_buckets - 1))).drop("_wbefore", "_wr", "_wtotal"))
    firsts = _first_ranks(ranked.groupBy("_wb").agg(F.count("*").alias("_wn")), []).select("_wb", "_wbefore")
    inside = Window.partitionBy("_wb").orderBy("_wf", "_ws", "_wh", *tie)
    at = ranked.withColumn("_wr", F.row_number().over(inside)).join(firsts, "_wb").withColumn("_wp", F.col("_wbefore") + F.col("_wr") - 1)
    # integer arithmetic: shard k begins at the least p with p * n_shards >= k * total
    shard = F.expr(f"(_wp * {n_shards}L) div {max(total, 1)}L")
    at = at.withColumn("shard", shard.cast("int"))
    begin = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return at.withColumn("slot", (F.col("_wp") - begin).cast("long")).drop("_ws", "_wb", "_wh", "_wf", "_wr", "_wbefore", "_wp")


def assign_shards(docs: DataFrame, n_shards: int = 8, seed: int = 17) -> DataFrame:
    """Shard every document: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: shard sizes are at most one row apart, and each source is spread in proportion. Equal texts are free
    to fall into different shards under this law. Null text counts as empty (size 1, checksum 0); null doc_ids and
    sources, and repeated rows, are rows like any other; more columns of ``docs`` are ignored; an empty table gives no rows.
    """
    narrow = docs.select(
        F.col("doc_id"), F.col("source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = interleave(narrow, "source", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], n_shards, seed)
    return placed.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, path: str, n_shards: int = 8, seed: int = 17) -> None:
    """Write the documents themselves, one folder ``shard=k`` per shard, in slot order within each file.

    Needs a unique non-null doc_id. The text moves once, to the task that writes its shard's part.
    """
    shard, slot = free_name(docs, "shard", "slot")
    where = assign_shards(docs, n_shards, seed).select("doc_id", F.col("shard").alias(shard), F.col("slot").alias(slot))
    spread = max(1, partitions(docs.sparkSession) // n_shards)
    out = docs.join(where, "doc_id").repartition(n_shards * spread, F.col(shard), F.pmod(F.col(slot), F.lit(spread)))
    out.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
