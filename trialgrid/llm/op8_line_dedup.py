"""Line dedup with levelled sorted runs of line hashes.

``LineIndex`` keeps the lines met so far as runs: tables of (line hash, documents that hold it, largest of their ids),
dealt into buckets by hash and sorted in each. A new batch's lines are merge-joined with the runs, bucket by bucket and
without moving the runs: those that no run has are new (an anti-join) and become a run of level 0, so that a line is in
one run only; the same job marks the others as repeats. When a level has ``fanout`` runs they are merged into one run of
the next level before the next batch, so a batch meets a number of runs that grows with the logarithm of the batches. A
line's documents are those of its run's entry and of its repeats.

Lines are compared by a key (white space stripped at both ends, A-Z lower-cased) of 20 code points at least, as a
64-bit hash; two given different keys agree with a chance of about 2 ** -64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.llm.shared import drop_stored, free_name, partitions, small_or_shuffled, stored, stored_rows, stored_sorted, tidy
from trialgrid.llm.textbytes import BEGINS, IS_SPACE, Chunk, chunks, span_hashes

#: Code points of a key from which it counts, documents that must hold it, runs of a level.
MIN_CHARS, MIN_DOCS, FANOUT = 20, 3, 2
#: ``drop_lines`` takes the partitions of its input in batches of so many at most, and in so many batches at least.
BATCH_PARTS, BATCHES = 4096, 5


def _lines(chunk: Chunk, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's lines: starts, ends, key hashes and whether the key is long enough; at [i]:[i+1] the lines of text i."""
    ends = np.flatnonzero(chunk.data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    bounds = np.append(np.searchsorted(starts, chunk.starts), len(starts))
    solid = np.flatnonzero(~IS_SPACE[chunk.data])
    if not len(solid):
        return starts, ends, np.zeros(len(ends), np.uint64), np.zeros(len(ends), bool), bounds
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    full = first <= last
    a = np.where(full, solid[np.minimum(first, len(solid) - 1)], starts)
    b = np.where(full, solid[np.maximum(last, 0)] + 1, starts)
    points = np.concatenate([[0], np.cumsum(BEGINS[chunk.data])])
    return starts, ends, span_hashes(chunk.data, a, b), points[b] - points[a] >= min_chars, bounds


def _keys(min_chars: int, parts: int, n_batches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's distinct long keys, and the batch that its partition falls in."""
        number = TaskContext.get().partitionId() * n_batches // parts
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                _, _, hashes, long, bounds = _lines(chunk, min_chars)
                row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[long]
                key = hashes[long].view(np.int64)
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                ids = batch.column("id")[chunk.rows].take(pa.array(row[new]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(key[new]), pa.array(np.full(len(ids), number, np.int32))], names=["id", "line", "batch"])

    return run


def _without(min_chars: int, gone_name: str, lines_name: str, dropped_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without the lines whose hashes are in the row's own list, in place of the texts."""
        for batch in batches:
            at = batch.schema.get_field_index("text")
            lists = batch.column(gone_name)
            texts, n_lines, n_dropped = [], [], []
            for chunk in chunks(batch.column(at)):
                raw = batch.column(at)[chunk.rows].cast(pa.binary()).to_pylist()
                starts, ends, hashes, long, bounds = _lines(chunk, min_chars)
                for i in range(len(bounds) - 1):
                    lo, hi = int(bounds[i]), int(bounds[i + 1])
                    whole = raw[i]
                    n_lines.append(hi - lo)
                    gone = lists[chunk.rows.start + i]
                    if not gone.is_valid:
                        texts.append(whole if whole is not None else b"")
                        n_dropped.append(0)
                        continue
                    drop = long[lo:hi] & np.isin(hashes[lo:hi].view(np.int64), gone.values.to_numpy())
                    a, b = starts[lo:hi][~drop] - chunk.starts[i], ends[lo:hi][~drop] - chunk.starts[i]
                    texts.append(b"\n".join([whole[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]))
                    n_dropped.append(int(drop.sum()))
            columns = [c for k, c in zip(batch.schema.names, batch.columns, strict=True) if k not in ("text", gone_name)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*[k for k in batch.schema.names if k not in ("text", gone_name)], "text", lines_name, dropped_name])

    return run


class LineIndex:
    """Levelled sorted runs of line hashes in the folder that all executors share."""

    def __init__(self, fanout: int = FANOUT) -> None:
        self.fanout, self.buckets = fanout, 0
        self.levels: list[list[DataFrame]] = []
        self.batches: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch (id, line: a document's distinct keys) of documents not added before. Returns the lines that no
        earlier batch had: line, n_docs, last_id."""
        self._compact()
        self.buckets = self.buckets or partitions(batch.sparkSession)
        own, known = batch.groupBy("line").agg(F.count("*").alias("n_docs"), F.max("id").alias("last_id")), F.lit(False)
        for k, run in enumerate(self.runs()):
            own = own.join(run.select("line", F.lit(True).alias(f"in_{k}")).hint("merge"), "line", "left")
            known = known | F.col(f"in_{k}").isNotNull()
        # one job for both sides of the anti-join
        self.batches.append(stored_sorted(own.select("line", "n_docs", "last_id", known.alias("known")), "line", self.buckets))
        new = self.batches[-1].where("not known").drop("known")
        self.levels = self.levels or [[]]
        self.levels[0].append(new)
        return new

    def _compact(self) -> None:
        """Merge the runs of a full level into one of the next; a level that this fills is merged along with it."""
        if not self.levels or len(self.levels[0]) < self.fanout:
            return
        old, k = [], 0
        while k < len(self.levels) and len(self.levels[k]) + bool(old) >= self.fanout:
            old, self.levels[k], k = old + self.levels[k], [], k + 1
        if k == len(self.levels):
            self.levels.append([])
        self.levels[k].append(stored_sorted(_total(old), "line", self.buckets))
        for x in old:
            drop_stored(x)  # not a batch's own table, which holds its repeats

    def often(self, min_docs: int) -> DataFrame:
        """Lines in at least ``min_docs`` documents: line, last_id."""
        repeats = [batch.where("known").drop("known") for batch in self.batches[1:]]
        return _total([*self.runs(), *repeats]).where(F.col("n_docs") >= min_docs).select("line", "last_id")

    def drop(self) -> None:
        for table in [*self.runs(), *self.batches]:
            drop_stored(table)


def _total(tables: list[DataFrame]) -> DataFrame:
    """Tables of lines as one, with a shuffle of their entries."""
    return reduce(DataFrame.union, tables).groupBy("line").agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and n_lines and n_dropped beside all other columns.

    A key found in ``min_docs`` documents or more loses all its lines but those in the largest doc_id that holds it.
    Null or empty text counts as one empty line and comes back empty. Rows without a doc_id neither count nor lose
    lines. Rows that share a doc_id are one document for the count and are each cut alike. n_lines and n_dropped get
    an underscore where ``docs`` has such columns; any other columns may stand beside. An empty table gives no rows.

    The input's partitions go through the index in ``batches`` batches, more if these would be over BATCH_PARTS each;
    where a doc_id is repeated, or there are fewer partitions than batches, batches are taken by the hash of doc_id.
    """
    n_lines, n_dropped, gone_name, id_name, lines_name, dropped_name = free_name(docs, "n_lines", "n_dropped", "_gone", "_id", "_lines", "_dropped")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("doc_id is not null and text is not null")
    parts = max(1, texts.rdd.getNumPartitions())
    batches = max(batches, -(-parts // BATCH_PARTS))
    keys = texts.mapInArrow(tidy(_keys(min_chars, parts, batches)), "id long, line long, batch int")
    repeated = _repeats(docs)
    if repeated or parts < batches:
        keys = keys.select("id", "line", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(batches)).cast("int").alias("batch"))
        keys = keys.distinct() if repeated else keys
    keys = stored(keys, ["batch"])
    index = LineIndex()
    for k in range(batches):
        index.add(keys.where(F.col("batch") == k).select("id", "line"))
    often = stored(index.often(min_docs))
    index.drop()
    # stored sides: a very frequent line is one that Spark may split in the join
    gone = keys.select("id", "line").join(small_or_shuffled(often, stored_rows(often)), "line").where("id != last_id")
    gone = stored(gone.groupBy(F.struct(F.lit(False).alias("none"), F.col("id")).alias(id_name)).agg(F.collect_list("line").alias(gone_name)))
    # rows without a doc_id meet nothing, and not all in one task
    known = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("id"))
    rows = docs.withColumn(id_name, known).join(small_or_shuffled(gone, _longs(gone, gone_name)), id_name, "left").drop(id_name)
    # the text column is replaced in place by the function; it may stand anywhere
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    out = rows.mapInArrow(tidy(_without(min_chars, gone_name, lines_name, dropped_name)), ", ".join([*schema, f"text string, `{lines_name}` long, `{dropped_name}` long"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(lines_name).alias(n_lines), F.col(dropped_name).alias(n_dropped))


def _repeats(docs: DataFrame) -> bool:
    """Whether some doc_id stands in more than one row."""
    ids = docs.select("doc_id").where("doc_id is not null")
    return ids.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def _longs(gone: DataFrame, lists: str) -> int:
    """Numbers in the table of lists: what a broadcast of it would hold."""
    return gone.agg(F.coalesce(F.sum(F.size(lists) + 1), F.lit(0))).first()[0]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
