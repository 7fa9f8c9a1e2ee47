"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text and per-document perplexity.

The model is over bytes, order 4, one for each language: letters in lower case, digits as one symbol, white space as
one blank. Counts of the trusted documents are sharded tables; lower orders hold continuation counts, and the
probabilities of each order come from joins of its counts with its contexts' sums and with the order below. All counts
and discounts are of the whole trusted corpus, and so are the tables that score. Nothing of them is broadcast: documents
are cut into blocks of some MB, the distinct grams of each block are joined with the probability of every distinct gram,
and each block then meets its own grams' probabilities. That shuffles the text once and the distinct grams of blocks,
not those of documents.

A document is kept if its perplexity isn't above its language's threshold: a high quantile of the trusted documents'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.llm.shared import drop_stored, exact_quantile, small_or_shuffled, stored
from trialgrid.llm.textbytes import Chunk, chunks

#: Highest order; quantile of trusted perplexities and the slack on it; grams that a verdict needs.
ORDER, QUANTILE, SLACK, GUARD = 4, 0.995, 1.3, 150
#: Grams that a counting task holds before it sums them up.
HELD = 1 << 23
#: Bytes of text in a block that is scored at once.
BLOCK_BYTES = 16 << 20

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13]] = 32
_CLASS[48:58] = 48


def _grams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte grams of a chunk and the bounds of each text's; a text and the blank after it give length - 2 of them."""
    data = _CLASS[chunk.data].astype(np.uint32)
    if len(data) < ORDER:
        return np.zeros(0, np.uint32), np.zeros(len(chunk.starts) + 1, np.int64)
    code = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    n = np.maximum(chunk.ends - chunk.starts + 1 - 3, 0)
    good = np.ones(len(code), bool)
    for start, end, k in zip(chunk.starts.tolist(), chunk.ends.tolist(), n.tolist(), strict=True):
        good[start + k : end + 1] = False
    return code[good], np.concatenate([[0], np.cumsum(n)])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
        gram, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(gram, kind="stable")
        gram, n = gram[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        return gram[first], np.add.reduceat(n, first)

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            gram, n = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "g", "c"])

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for chunk in chunks(batch.column("text")):
            code, bounds = _grams(chunk)
            row = np.repeat(langs[chunk.rows], np.diff(bounds))
            for lang in set(langs[chunk.rows].tolist()):
                own, n = np.unique(code[row == lang], return_counts=True)
                if len(own):
                    held.setdefault(lang, []).append((own, n))
                    size += len(own)
            if size > HELD:
                yield from rows()
                held.clear()
                size = 0
    yield from rows()


def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts by language: lang, d1, d2, d3. Where counts of counts are missing, 0.5, 1 and 1.5."""
    n = counts.groupBy("lang").agg(*[F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    whole = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    d = [F.when(whole, F.greatest(F.lit(0.0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))).otherwise(0.5 * k) for k in (1, 2, 3)]
    return n.select("lang", *[x.alias(f"d{k}") for k, x in enumerate(d, 1)])


def kneser_ney(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Of 4-gram counts (lang, g, c): for orders 1 to 4 the grams (lang, g, c, p) and the contexts (lang, h, total, back).

    A gram's first byte is its lowest; its context is all but the last byte, its suffix all but the first. The third
    list is what to drop when done.
    """
    tables = [counts]
    for _ in range(ORDER - 1):  # how many different bytes stand before a gram
        tables.append(stored(tables[-1].groupBy("lang", F.shiftright("g", 8).alias("g")).agg(F.count("*").alias("c"))))
    tables.reverse()
    grams, contexts, temporary = [], [], tables[:-1]
    for k, table in enumerate(tables, 1):
        taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        # a row per language: as many as there are languages
        rows = table.join(F.broadcast(_discounts(table)), "lang").select("lang", "g", "c", F.least(taken, F.col("c")).alias("d"), F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).alias("h"))
        context = stored(rows.groupBy("lang", "h").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("back")))
        rows = rows.join(context, ["lang", "h"])
        own = (F.col("c") - F.col("d")) / F.col("total")
        if k == 1:
            rows = rows.select("lang", "g", "c", (own + F.col("back") / 256).alias("p"))
        else:
            lower = grams[-1].select("lang", F.col("g").alias("s"), F.col("p").alias("q"))
            rows = rows.withColumn("s", F.shiftright("g", 8)).join(lower, ["lang", "s"]).select("lang", "g", "c", (own + F.col("back") * F.col("q")).alias("p"))
        grams.append(stored(rows))
        contexts.append(context)
        temporary += [grams[-1], context]
    return grams, contexts, temporary


def train(trusted: DataFrame) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """``trusted``: lang (not null) and text. As ``kneser_ney``."""
    counts = trusted.mapInArrow(_counted, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))
    counts = stored(counts)
    grams, contexts, temporary = kneser_ney(counts)
    return grams, contexts, [counts, *temporary]


def log_probabilities(wanted: DataFrame, grams: list[DataFrame], contexts: list[DataFrame]) -> DataFrame:
    """Of distinct 4-grams (lang, g), seen or not: (lang, g, v), the log probability of the last byte after the others.

    Orders go from 1 up, so that no key of a join has more than 256 rows of a language.
    """
    out = None
    for k in range(1, ORDER + 1):
        own = grams[k - 1].select("lang", "g", F.ln("p").alias("own"))
        back = contexts[k - 1].select("lang", "h", F.coalesce(F.ln("back"), F.lit(float("nan"))).alias("back"))
        rows = wanted.select("lang", F.shiftright("g", 8 * (ORDER - k)).alias("g"))
        rows = rows if k == ORDER else rows.distinct()
        rows = rows.withColumn("h", F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(own, ["lang", "g"], "left").join(back, ["lang", "h"], "left")
        if out is None:
            rows = rows.withColumn("lower", F.lit(float(np.log(1 / 256))))
        else:
            rows = rows.withColumn("s", F.shiftright("g", 8)).join(out.select("lang", F.col("g").alias("s"), F.col("v").alias("lower")), ["lang", "s"])
        out = rows.select("lang", "g", F.coalesce("own", F.coalesce("back", F.lit(0.0)) + F.col("lower")).alias("v"))
    return out


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with each row's block: BLOCK_BYTES of text in a row of one task."""
    first, seen = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        if batch.num_rows:
            size = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            end = seen + np.cumsum(size)
            yield batch, first + (end - size) // BLOCK_BYTES
            seen = int(end[-1])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, block in _numbered(batches):
        yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], names=["block", *batch.schema.names])


def _block_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct grams of each block and language: block, lang, g."""
    held: dict[str, list[np.ndarray]] = {}
    now = -1

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            gram = np.unique(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), now)), pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64))], names=["block", "lang", "g"])
        held.clear()

    for batch, block in _numbered(batches):
        langs = np.array(batch.column("lang").to_pylist(), object)
        for chunk in chunks(batch.column("text")):
            code, bounds = _grams(chunk)
            n = np.diff(bounds)
            row, of = np.repeat(langs[chunk.rows], n), np.repeat(block[chunk.rows], n)
            for b in np.unique(of).tolist():
                if b != now:
                    yield from rows()
                    now = b
                for lang in set(row[of == b].tolist()):
                    held.setdefault(lang, []).append(np.unique(code[(of == b) & (row == lang)]))
    yield from rows()


def _scored(docs: pa.Table, values: pa.Table) -> pa.Table:
    """A block's documents (block, text, doc_id, lang) by its grams' log probabilities (block, lang, g, v)."""
    docs = docs.combine_chunks()
    known = {}
    for lang in pc.unique(values["lang"]).to_pylist():
        own = values.filter(pc.equal(values["lang"], lang))
        gram, v = own["g"].to_numpy(), own["v"].to_numpy()
        order = np.argsort(gram)
        known[lang] = gram[order], v[order]
    langs = np.array(docs["lang"].to_pylist(), object)
    count, value = np.zeros(len(langs), np.int64), np.full(len(langs), np.nan)
    for chunk in chunks(docs["text"].combine_chunks()):
        code, bounds = _grams(chunk)
        of, n = langs[chunk.rows], np.diff(bounds)
        total = np.full(len(n), np.nan)
        for lang in set(of.tolist()) & known.keys():
            which = np.flatnonzero((of == lang) & (n > 0))
            if len(which):
                gram, v = known[lang]
                own = code[np.repeat(of == lang, n)].astype(np.int64)
                at = np.minimum(np.searchsorted(gram, own), len(gram) - 1)
                if (gram[at] != own).any():
                    raise RuntimeError("a block has other texts than when its grams were listed: store the documents first")
                total[which] = np.add.reduceat(v[at], np.concatenate([[0], np.cumsum(n[which])[:-1]]))
        count[chunk.rows] = n
        with np.errstate(invalid="ignore", divide="ignore"):
            value[chunk.rows] = np.exp(-total / n)
    return pa.table({"doc_id": docs["doc_id"], "lang": docs["lang"], "n_grams": count, "perplexity": pa.array(value, mask=np.isnan(value))})


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, guard: int = GUARD) -> DataFrame:
    """Verdict on every document: doc_id, lang, n_grams, perplexity, threshold, kept.

    ``trusted_ids``: doc_id of trusted documents. A null lang is a language of its own (shown as an empty string), as is
    every other value. perplexity is null for texts too short for a gram and for languages without trusted text; such
    documents, and those with fewer grams than ``guard``, are kept. The threshold is ``slack`` times the exact quantile
    over the language's trusted documents that reach the guard. Null text counts as empty; rows with a null doc_id
    are never trusted; repeated rows are rows of their own; more columns are ignored. ``docs`` is read three times and has
    to give the same rows in the same order, as scans do; a run where it doesn't may end with an error.
    """
    ids = stored(trusted_ids.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct())
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    trusted = rows.join(small_or_shuffled(ids, ids.count()), rows["doc_id"] == ids["_id"], "left_semi")
    grams, contexts, temporary = train(trusted.select("lang", "text"))
    # a row per language: those without trusted text have no probabilities
    listed = stored(rows.mapInArrow(_block_grams, "block long, lang string, g long").join(F.broadcast(contexts[0].select("lang")), "lang", "left_semi").select("block", "lang", "g"))
    wanted = stored(listed.select("lang", "g").distinct())
    values = listed.join(log_probabilities(wanted, grams, contexts), ["lang", "g"]).select("block", "lang", "g", "v")
    kind = dict(rows.dtypes)["doc_id"]
    blocks = rows.mapInArrow(_blocks, f"block long, text string, doc_id {kind}, lang string")
    scored = stored(blocks.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(_scored, f"doc_id {kind}, lang string, n_grams long, perplexity double"))
    for table in [*temporary, listed, wanted]:
        drop_stored(table)
    known = scored.where((F.col("n_grams") >= guard) & F.col("perplexity").isNotNull()).join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
    limit = exact_quantile(known, "lang", "perplexity", quantile).select("lang", (F.col("quantile") * slack).alias("threshold"))
    out = scored.join(F.broadcast(limit), "lang", "left")  # a row per language
    bad = (F.col("n_grams") >= guard) & (F.col("perplexity") > F.col("threshold"))
    return out.select("doc_id", "lang", "n_grams", "perplexity", "threshold", (~F.coalesce(bad, F.lit(False))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id"))
