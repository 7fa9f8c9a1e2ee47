"""Merkle manifest of a table by bitmap-rank indexing, in DataFrame operations.

A row's place in its group is a rank query and not a sort of the rows. Each group's doc_ids are a compressed bitmap:
words of 64 ids, of which only those with a bit are stored; tasks build partial words and an OR merges them. A
directory of popcounts over the words (containers of 64 words, then three levels of 2 ** 14 children) tells how many
ids lie before a word, and the bits below the own one do the rest. No window of the directory sees more than 2 ** 14
rows, however the ids are spread.

The tree is reduced in levels: a node goes by the key (group, place div 16) to its run's slot array, whose digest is the
next level's node. Going down again, each run hands its members the left and right siblings of all levels above, so a
path is made once for a run and not once for a row; rows fold their own leaf along it.

Rows with one doc_id in one group are ordered by leaf digest; rows that also agree in that are interchangeable. They
are counted by bucket of the digest, so a third of a table may share one doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialgrid.llm.shared import free_name, partitions, stored

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

#: Children of a node.
ARITY = 16

#: Bits that one step of the directory takes off the doc_id: a word, a container, then wide nodes up to all 64 bits.
STEPS = [6, 12, 26, 40, 54]

#: The word of rows without a doc_id, before all others.
NO_ID = -(2**57) - 1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    parts = [f.cast("string") for f in fields]
    return sha(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]))


def _before(counts: DataFrame, group: list[str], order: str, n: str, out: str) -> DataFrame:
    """``counts`` with what the earlier rows of the group hold in sum."""
    run = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(n).over(run), F.lit(0)))


def bitmap(rows: DataFrame) -> DataFrame:
    """``rows``: g (not null), id (long or null) -> g, w, bits, n: the words of each group's compressed bitmap, and its rows
    counted with repeats. Partial words are merged by OR."""
    bit = F.expr("shiftleft(1L, int(coalesce(id, 0L) & 63L))")
    return rows.groupBy("g", _word().alias("w")).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))


def _word() -> Column:
    return F.coalesce(F.shiftright("id", STEPS[0]), F.lit(NO_ID))


def directory(words: DataFrame) -> DataFrame:
    """``words`` of ``bitmap`` with before (rows of the group in lower words) and total (rows of the group)."""
    levels = [words.select("g", F.col("w").alias("u0"), "n")]
    for k in range(1, len(STEPS)):
        down = STEPS[k] - STEPS[k - 1]
        levels.append(levels[-1].groupBy("g", F.shiftright(f"u{k - 1}", down).alias(f"u{k}")).agg(F.sum("n").alias("n")))
    top = _before(levels[-1], ["g"], f"u{len(STEPS) - 1}", "n", "before")
    out = top.withColumn("total", F.sum("n").over(Window.partitionBy("g"))).drop("n")
    for k in range(len(STEPS) - 2, -1, -1):
        down = STEPS[k + 1] - STEPS[k]
        own = levels[k].withColumn(f"u{k + 1}", F.shiftright(f"u{k}", down))
        own = _before(own, ["g", f"u{k + 1}"], f"u{k}", "n", "_b").drop("n")
        out = own.join(out, ["g", f"u{k + 1}"]).withColumn("before", F.col("before") + F.col("_b")).drop("_b", f"u{k + 1}")
    return out.withColumnRenamed("u0", "w").join(words, ["g", "w"])


def _ties(rows: DataFrame) -> DataFrame:
    """uid, inside: a row's place among the rows of its word, by id, then leaf. Counts by bucket of the digest's first four
    digits, and for equal digests by bucket of the row, keep each window far below a hot id's rows."""
    own = rows.select("g", "w", F.coalesce("id", F.lit(0)).alias("id"), F.substring("leaf", 1, 4).alias("lb"), "leaf", F.pmod(F.xxhash64("uid"), F.lit(4096)).alias("ub"), "uid")
    keys = [["g", "w", "id", "lb", "leaf", "ub"], ["g", "w", "id", "lb", "leaf"], ["g", "w", "id", "lb"], ["g", "w", "id"]]
    out = own.withColumn("inside", F.row_number().over(Window.partitionBy(*keys[0]).orderBy("uid")).cast("long") - 1)
    counts = own.groupBy(*keys[0]).agg(F.count("*").alias("n"))
    for key in keys:
        placed = _before(counts, key[:-1], key[-1], "n", "_b").drop("n")
        out = out.join(placed, key).withColumn("inside", F.col("inside") + F.col("_b")).drop("_b")
        counts = counts.groupBy(*key[:-1]).agg(F.sum("n").alias("n"))
    return out.select("uid", "inside")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows``: g (string, not null), id, leaf, uid (unique) and others -> also at (place in the group from 0) and total."""
    index = stored(directory(bitmap(rows)))
    rows = rows.withColumn("w", _word())
    below = F.expr("bit_count(bits & ~shiftleft(-1L, int(coalesce(id, 0L) & 63L)))").cast("long")
    out = rows.join(index, ["g", "w"])
    repeats = index.where("n > bit_count(bits)").select("g", "w")
    if not repeats.limit(1).count():
        return out.withColumn("at", F.col("before") + below).drop("w", "bits", "n", "before")
    ties = _ties(rows.join(repeats, ["g", "w"], "left_semi"))
    return out.join(ties, "uid", "left").withColumn("at", F.col("before") + F.coalesce("inside", below)).drop("w", "bits", "n", "before", "inside")


def _slots(digest: str = "digest") -> Column:
    """The digests of a run in the order of their slots."""
    by_slot = F.map_from_entries(F.collect_list(F.struct("slot", digest)))
    return F.transform(F.sequence(F.lit(0), F.count("*").cast("int") - 1), lambda k: F.element_at(by_slot, k))


def reduce_level(nodes: DataFrame) -> DataFrame:
    """``nodes``: g, at, total, digest, totals over 1 -> g, at, total, digest of the next level, and kids, the run's digests."""
    slotted = nodes.select("g", F.expr(f"at div {ARITY}").alias("up"), (F.col("at") % ARITY).cast("int").alias("slot"), "digest", F.expr(f"(total + {ARITY - 1}) div {ARITY}").alias("total"))
    runs = slotted.groupBy("g", "up").agg(_slots().alias("kids"), F.max("total").alias("total"))
    return runs.select("g", F.col("up").alias("at"), "total", "kids", sha(F.concat_ws("", "kids")).alias("digest"))


def reduced(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All levels of runs above ``nodes``, lowest first, and the tops: g, level (runs above a leaf), digest. A lone node is its own top."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    levels, tops = [], [nodes.where("total = 1").select("g", F.lit(0).alias("level"), "digest")]
    while most > 1:
        runs = stored(reduce_level(nodes.where("total > 1")))
        levels.append(runs)
        tops.append(runs.where("total = 1").select("g", F.lit(len(levels)).alias("level"), "digest"))
        nodes, most = runs, -(-most // ARITY)
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return levels, out


def _siblings(kids: str, slot: str) -> Column:
    left = F.concat_ws("", F.slice(kids, F.lit(1), F.col(slot)))
    right = F.concat_ws("", F.slice(kids, F.col(slot) + 2, F.lit(ARITY)))
    return F.struct(left.alias("left"), right.alias("right"))


def paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``tops``: g, level, path and more -> g, at, path and the same for the runs of the lowest level: the siblings of the
    levels above, nearest first. Groups whose top is a leaf have no run and aren't here."""
    carried = [c for c in tops.columns if c not in ("g", "level", "path")]
    now = None
    for k in range(len(levels), 0, -1):
        here = tops.where(F.col("level") == k).select("g", F.lit(0).cast("long").alias("at"), "path", *carried)
        now = here if now is None else now.unionByName(here)
        if k == 1:
            return now
        full = levels[k - 1].select("g", "at", "kids").join(now, ["g", "at"])
        kids = full.select("g", "at", "kids", "path", *carried, F.posexplode("kids").alias("slot", "_"))
        now = kids.select("g", (F.col("at") * ARITY + F.col("slot")).alias("at"), F.concat(F.array(_siblings("kids", "slot")), "path").alias("path"), *carried)
    return tops.select("g", F.lit(0).cast("long").alias("at"), "path", *carried).where("false")


def group_ranks(groups: DataFrame) -> DataFrame:
    """``groups``: g (distinct) -> also at and total, in the order of their UTF-8 bytes. Ranges of groups are ranked each by
    itself and their sizes summed, so any number of groups will do."""
    n = partitions(groups.sparkSession)
    dealt = stored(groups.repartitionByRange(n, "g").withColumn("p", F.spark_partition_id()))
    sizes = _before(dealt.groupBy("p").agg(F.count("*").alias("n")).withColumn("_all", F.lit(1)), ["_all"], "p", "n", "before")
    sizes = sizes.withColumn("total", F.sum("n").over(Window.partitionBy("_all"))).drop("_all", "n")
    inside = F.row_number().over(Window.partitionBy("p").orderBy("g")).cast("long") - 1
    return dealt.withColumn("_r", inside).join(sizes, "p").withColumn("at", F.col("before") + F.col("_r")).drop("p", "_r", "before")


def _fold(path: Column, start: Column) -> Column:
    return F.aggregate(path, start, lambda acc, s: sha(F.concat(s["left"], acc, s["right"])))


def _joined(path: Column) -> Column:
    return F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"])))


def manifest(docs: DataFrame, group: str = "source", key: str = "doc_id", fields: list[str] = FIELDS, changed: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of ``docs``: ``key``, ``group``, place (in the group, from 0), leaf, subroot, root, proof_sha256,
    folded_root, verified.

    ``fields`` make the leaf. ``changed`` gives columns that stand in for fields when a leaf is computed anew to be
    verified (default: the table as it is); folded_root is that leaf folded along the row's proof.
    ``key`` is an integer; rows without one come first in their group; a null group comes first of the groups, apart from
    the empty string. Rows with one key in one group are ordered by leaf digest, and equal rows are leaves each. Null and
    empty texts differ. ``docs`` may hold more columns of any name. An empty table gives no rows.
    """
    changed = changed or {}
    rows = docs.select(
        F.col(key).cast("long").alias("id"), F.col(group).cast("string").alias("grp"), leaf_digest([F.col(f) for f in fields]).alias("leaf"),
        leaf_digest([changed.get(f, F.col(f)) for f in fields]).alias("now") if changed else F.lit(None).cast("string").alias("now"),
    )
    # the texts are read once; row numbers are kept from here on, so a lost task can't renumber them
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("g", F.concat(F.when(F.col("grp").isNull(), "0").otherwise("1"), F.coalesce("grp", F.lit("")))))
    leaves = ranked(rows).select("g", "grp", "id", "at", "total", F.col("leaf").alias("digest"), F.coalesce("now", "leaf").alias("now"))
    leaves = stored(leaves)

    levels, tops = reduced(leaves)
    tops = stored(tops)
    places = group_ranks(tops.select("g"))
    subs = stored(tops.join(places, "g").select(F.lit("").alias("all"), "g", "level", "at", "total", "digest"))
    above, root = reduced(subs.select(F.col("all").alias("g"), "at", "total", "digest"))
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    root = root.select("g", "level", nothing.alias("path"), F.col("digest").alias("root"))
    group_paths = paths(above, root)
    of_group = _members(subs.select(F.col("all").alias("g"), "at", F.col("g").alias("group_key"), "level", F.col("digest").alias("subroot")), above, group_paths, root)
    seeds = stored(of_group.select(F.col("group_key").alias("g"), "level", "path", "subroot", "root"))

    # rows of a run get its path and its slots; lone leaves get their group's path
    step = _siblings("kids", "slot")
    cols = ["grp", "id", "at", "digest", "now", "subroot", "root"]
    lone = leaves.where("total = 1").join(seeds.where("level = 0").drop("level"), "g").select(*cols, _joined(F.col("path")).alias("rest"), "path", F.lit(None).cast("array<string>").alias("kids"), F.lit(0).alias("slot"))
    out = lone.select(*cols, "path", F.col("rest").alias("proof"))
    if levels:
        whole = paths(levels, seeds).withColumn("rest", _joined(F.col("path")))
        members = leaves.where("total > 1").groupBy("g", F.expr(f"at div {ARITY}").alias("up")).agg(F.collect_list(F.struct("grp", "id", "at", "digest", "now")).alias("rows"))
        runs = members.join(levels[0].select("g", F.col("at").alias("up"), "kids").join(whole.withColumnRenamed("at", "up"), ["g", "up"]), ["g", "up"])
        each = runs.select("kids", "path", "rest", "subroot", "root", F.inline("rows")).withColumn("slot", (F.col("at") % ARITY).cast("int"))
        each = each.withColumn("step", step)
        out = out.unionByName(each.select(*cols, F.concat(F.array("step"), "path").alias("path"), F.concat("step.left", "step.right", "rest").alias("proof")))
    names = free_name(docs.select(key, group), "place", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    folded = _fold(F.col("path"), F.col("now"))
    out = out.select("grp", "id", "at", "digest", "subroot", "root", sha(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.select(F.col("id").alias(key), F.col("grp").alias(group), *[F.col(c).alias(n) for c, n in zip(["at", "digest", "subroot", "root", "proof_sha256", "folded_root"], names, strict=False)], (F.col("folded_root") == F.col("root")).alias(names[-1]))


def _members(nodes: DataFrame, levels: list[DataFrame], run_paths: DataFrame, tops: DataFrame) -> DataFrame:
    """``nodes`` with the path and the columns of their top."""
    if not levels:
        return nodes.join(tops.select("g", "path", "root"), "g")
    runs = levels[0].select("g", F.col("at").alias("up"), "kids").join(run_paths.withColumnRenamed("at", "up"), ["g", "up"])
    near = nodes.withColumn("up", F.expr(f"at div {ARITY}")).withColumn("slot", (F.col("at") % ARITY).cast("int")).join(runs, ["g", "up"])
    return near.withColumn("path", F.concat(F.array(_siblings("kids", "slot")), "path"))


def tampered_text() -> Column:
    """The text in lower case (A-Z only) where 5 divides the CRC-32 of the decimal doc_id, else as it is; also without a doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = manifest(docs, changed={"text": tampered_text()})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
