"""Mixing sources to target weights with Efraimidis-Spirakis sampling, in DataFrame operations only.

A source whose target is e times its size plus a rest gives e complete epochs of all its documents; the rest is drawn
without replacement: each document gets an exponential key -ln(u) / weight, u from a seeded hash and the weight from
the document's quality, and documents are taken in key order while their running size stays within the rest. Where a
long document would go beyond it, the order goes on behind it with the documents that still fit, pass by pass: after each
pass only documents no longer than what is missing take part. Passes end when no source misses more than a thousandth
of its target, or when none has a document left that fits, or after MOST_PASSES; then one document more is taken where that
brings a source nearer.

Running sums are taken by bucket of the key: bucket totals first, then within each bucket, so that a source with a
third of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialgrid.llm.shared import WORD, bucket_count, free_name, small_or_shuffled, stored, unit

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source, and so no document, is taken more than this many times.
MOST_EPOCHS = 3
#: Passes of the draw, each over one row a document without texts.
MOST_PASSES = 6
#: Share of its target that a source may miss before another pass is made.
NEAR = 0.001


def quality_weight(text: Column, size: Column) -> Column:
    """A document's weight in the draw, from 0.05 to 1: lower with few words, with a mean word length far from that of
    prose, and with a large share of digits and symbols."""
    length = F.greatest(F.length(text), F.lit(1))
    plain = F.length(F.translate(text, "0123456789#*$%&|<>", "")) / length
    off = (length / F.greatest(size, F.lit(1)) - 6.5) / 4
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), size / 50) * F.pow(plain, 4) * F.exp(-off * off))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Targets by source. ``sizes``: _s (struct z, s: null sources last), source_size. Adds target.

    All sizes together are shared by weight; a target stops at ``most`` times its source's size and the excess is
    shared again. The fixed point is min(cap, level * weight). In the order of cap / weight, capping all sources before
    one leaves a level for it and the rest, (total - their caps) / remaining weight; capping too few or too many of them
    only lowers that, so the level is the largest of these. One row per source; no document is here.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("_s")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("_w", F.element_at(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
    rows = rows.withColumn("_cap", F.col("source_size").cast("double") * most)
    by = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), "_s")
    before, onward = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    rows = rows.withColumn("_level", F.max("_level").over(every))
    return rows.select("_s", "source_size", F.least(F.col("_cap"), F.col("_level") * F.col("_w")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 29, weight: Column | None = None) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken, copies.

    ``size``: words of the text (null: 0). ``copies``: how often the document is taken; taken = copies * size.
    ``weight``: a positive column of ``docs``; by default ``quality_weight``. Null sources form one source, last in
    order; repeated rows and null ids are rows of their own; documents without words take part with size 0 and are
    taken when their place in the order falls within the rest; an empty table, or one without words, gives taken 0.
    More columns of ``docs`` are ignored. The same input and seed give the same result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    z = F.struct(F.col("source").isNull().alias("z"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s"))
    rows = docs.select("doc_id", "source", z.alias("_s"), size.alias("size"), F.col("text").alias("_t"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(-1)).alias("_crc"), (weight if weight is not None else F.lit(None).cast("double")).alias("_q"))
    rows = rows.withColumn("_q", F.coalesce("_q", quality_weight(F.col("_t"), F.col("size")))).drop("_t")
    u = unit(F.xxhash64(F.lit(seed), "doc_id", "_crc", "size"))
    rows = stored(rows.withColumn("_key", -F.ln(u) / F.col("_q")).drop("_q").withColumn("_uid", F.monotonically_increasing_id()))
    # steps of the key's logarithm: an exponential key of any rate has at most 0.26 of its mass in a doubling of the key,
    # so no bucket is hot, whatever the weights
    steps = bucket_count(rows.count(), 1024)
    rows = rows.withColumn("_b", F.floor(F.log2(F.greatest("_key", F.lit(1e-300))) * steps))
    parts = stored(rows.groupBy("_s", "_b").agg(F.sum("size").alias("_n")))
    # what belongs to a source reaches its rows by bucket, so that a source with a third of all rows is no single task
    by_bucket = lambda per_source: parts.select("_s", "_b").join(per_source, "_s")
    targets = source_targets(parts.groupBy("_s").agg(F.sum("_n").alias("source_size")), weights, most)
    run = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0)
    targets = targets.withColumn("_e", epochs.cast("long"))
    rest = F.greatest(F.col("target") - F.col("_e") * F.col("source_size"), F.lit(0.0))
    targets = targets.withColumn("_rest", F.when(rest > 1e-6, rest).otherwise(-1.0))
    out = rows.join(by_bucket(targets), ["_s", "_b"]).withColumn("_drawn", F.lit(False))
    inside = Window.partitionBy("_s", "_b").orderBy("_key", "doc_id", "_crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    for k in range(MOST_PASSES):
        # what is missing, the documents that fit into it, and their running size: buckets first, then inside each
        missing = out.groupBy("_s").agg((F.first("_rest") - F.coalesce(F.sum(F.when(F.col("_drawn"), F.col("size"))), F.lit(0))).alias("_gap"))
        out = out.join(by_bucket(missing), ["_s", "_b"])
        fits = F.when(~F.col("_drawn") & (F.col("size") <= F.col("_gap")) if k else F.lit(True), F.col("size"))
        sums = out.groupBy("_s", "_b").agg(F.coalesce(F.sum(fits), F.lit(0)).alias("_n"))
        firsts = sums.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0))).drop("_n")
        out = out.withColumn("_in", F.coalesce(F.sum(fits).over(inside), F.lit(0))).join(firsts, ["_s", "_b"])
        now = fits.isNotNull() & (F.col("_before") + F.col("_in") + F.col("size") <= F.col("_gap"))
        out = stored(out.withColumn("_drawn", F.col("_drawn") | now).drop("_gap", "_in", "_before"))
        state = out.groupBy("_s").agg(F.first("_rest").alias("r"), F.first("target").alias("t"), F.coalesce(F.sum(F.when(F.col("_drawn"), F.col("size"))), F.lit(0)).alias("d"), F.min(F.when(~F.col("_drawn") & (F.col("size") > 0), F.col("size"))).alias("least"))
        if not state.where((F.col("r") - F.col("d") > F.col("t") * NEAR) & (F.col("least") <= F.col("r") - F.col("d"))).limit(1).count():
            break
    # one document more, the shortest of those that don't fit, where that brings its source nearer
    missing = out.groupBy("_s").agg((F.first("_rest") - F.coalesce(F.sum(F.when(F.col("_drawn"), F.col("size"))), F.lit(0))).alias("_gap"))
    beyond = out.where(~F.col("_drawn")).join(by_bucket(missing), ["_s", "_b"]).where((F.col("size") > F.col("_gap")) & (F.col("size") < 2 * F.col("_gap")))
    last = beyond.groupBy("_s").agg(F.min(F.struct("size", "_key", "doc_id", "_crc", "_uid")).getField("_uid").alias("_last"))
    out = out.join(by_bucket(last), ["_s", "_b"], "left").withColumn("_drawn", F.col("_drawn") | F.coalesce(F.col("_uid") == F.col("_last"), F.lit(False)))
    out = out.withColumn("copies", F.col("_e") + F.when(F.col("_drawn"), 1).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "_crc")


def take_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents, each as often as the mix takes it, with all columns of ``docs``.

    Rows equal in doc_id and text get the same number of copies each, the largest that one of them is given.
    """
    copies, crc, doc_id = free_name(docs, "copies", "crc", "id")
    taken = mix_sources(docs, **how).where("copies > 0").groupBy(F.struct("doc_id", F.col("_crc").alias("crc")).alias(doc_id)).agg(F.max("copies").alias(copies))
    taken = stored(taken)
    key = F.struct("doc_id", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(-1)).alias("crc"))
    rows = docs.withColumn(doc_id, key).join(small_or_shuffled(taken, taken.count()), doc_id)
    return rows.withColumn(crc, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies).cast("long")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
