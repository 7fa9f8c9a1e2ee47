"""Language identification with bit-sliced Bloom filters of n-grams.

Training counts the 4-byte grams (letters and blanks) of each language's documents; a gram belongs to a language if it
makes up a fixed share of the language's grams, so a language has at most 1 / share grams whatever the corpus. One
Bloom filter serves all languages: each slot holds a bit for each language, and the AND of a gram's slots is the mask
of all languages that have it. A document's masks are counted by language, the counts are corrected by the language's
false-positive rate (its slots' fill to the power of the hashes), and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.llm.shared import drop_stored, stored
from trialgrid.llm.textbytes import Chunk, chunks, mix

#: A gram is a language's own from this share of its grams; slots for each (language, gram), and hashes of a gram.
MIN_SHARE, SLOTS_EACH, HASHES = 4e-5, 16, 3
#: Grams that a training task holds before it sums them up.
HELD = 1 << 23

_CLASS = np.full(256, 32, np.uint8)  # anything but letters is a blank
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def _grams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """4-byte grams of a chunk with two letter bytes or more, and their texts' numbers. None spans two texts."""
    data = _CLASS[chunk.data].astype(np.uint32)
    if len(data) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    code = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    letter = (data != 32).astype(np.uint8)
    good = (letter[:-3] + letter[1:-2] + letter[2:-1] + letter[3:]) >= 2
    for end in chunk.ends[:-1].tolist():  # a gram may take in the blank after a text, not the next text
        good[max(0, end - 2) : end + 1] = False
    row = np.repeat(np.arange(len(chunk.starts)), chunk.ends - chunk.starts + 1)[: len(code)]
    return code[good], row[good]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each language's grams in one partition."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
        gram, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(gram, kind="stable")
        gram, n = gram[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        return gram[first], np.add.reduceat(n, first)

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for chunk in chunks(batch.column("text")):
            gram, row = _grams(chunk)
            of = langs[chunk.rows]
            for lang in set(of.tolist()):
                own, n = np.unique(gram[(of == lang)[row]], return_counts=True)
                if len(own):
                    held.setdefault(lang, []).append((own, n))
                    size += len(own)
            if size > HELD:
                held = {lang: [summed(parts)] for lang, parts in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > HELD // 2:  # many languages: pass on what there is
                    yield from _rows({lang: p[0] for lang, p in held.items()})
                    held, size = {}, 0
    yield from _rows({lang: summed(parts) for lang, parts in held.items()})


def _rows(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, (gram, n) in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


@dataclass
class LanguageFilter:
    """Bit-sliced Bloom filter: slices[i][slot] has a bit for each of languages 8i..8i+7."""

    languages: list[str]
    usual: int  # the language with most training text, for texts without known grams
    slices: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def of(cls, grams: pd.DataFrame, sizes: pd.DataFrame) -> LanguageFilter:
        languages = sorted(sizes["lang"])
        place = {lang: i for i, lang in enumerate(languages)}
        n_slots = 1 << max(10, int(np.ceil(np.log2(SLOTS_EACH * max(1, len(grams))))))
        slices = np.zeros((-(-max(1, len(languages)) // 8), n_slots), np.uint8)
        at, gram = grams["lang"].map(place).to_numpy(np.int64), grams["gram"].to_numpy(np.uint64)
        for slot in _slots(gram, n_slots):
            np.bitwise_or.at(slices, (at // 8, slot), (1 << (at % 8)).astype(np.uint8))
        fill = np.array([np.count_nonzero(slices[i // 8] >> (i % 8) & 1) for i in range(len(languages))]) / n_slots
        usual = place[sizes.sort_values(["n", "lang"], ascending=[False, True])["lang"].iloc[0]] if languages else -1
        return cls(languages, usual, slices, fill**HASHES)

    def counts(self, gram: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
        """By text and language, how many grams the language's filter contains."""
        slots = list(_slots(gram.astype(np.uint64), self.slices.shape[1]))
        out = []
        for part in self.slices:
            mask = part[slots[0]]
            for slot in slots[1:]:
                mask = mask & part[slot]
            by_mask = np.bincount(row * 256 + mask, minlength=n_rows * 256).reshape(n_rows, 256)
            out.append(by_mask @ _BITS)
        return np.concatenate(out, 1)[:, : len(self.languages)]

    def decide(self, counts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = counts / np.maximum(n, 1)[:, None]
        share = np.maximum(0, (share - self.false_rate) / np.maximum(1e-9, 1 - self.false_rate))
        best, total = share.argmax(1), share.sum(1)
        found = total > 0
        return np.where(found, best, self.usual), np.where(found, share.max(1) / np.where(found, total, 1), 0.0)


_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def _slots(gram: np.ndarray, n_slots: int) -> Iterator[np.ndarray]:
    h = mix(gram + np.uint64(0x632BE59BD9B4E019))
    for k in range(HASHES):
        yield (h >> np.uint64(21 * k) & np.uint64(n_slots - 1)).astype(np.int64)


def train(docs: DataFrame) -> LanguageFilter:
    """Learn from ``text`` and ``lang`` of all rows whose lang is not null.

    What reaches the driver is bounded: a row per language and at most 1 / MIN_SHARE grams of each.
    """
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stored(counts)
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    own = counts.join(F.broadcast(sizes.withColumnRenamed("n", "total")), "lang").where(F.col("n") >= F.col("total") * MIN_SHARE).select("lang", "gram")
    learned = LanguageFilter.of(own.toPandas(), sizes.toPandas())
    drop_stored(counts)
    return learned


def _predicted(learned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageFilter = learned.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                n_rows = len(chunk.starts)
                gram, row = _grams(chunk)
                n = np.bincount(row, minlength=n_rows)
                best, score = np.full(n_rows, -1), np.zeros(n_rows)
                if model.languages:
                    best, score = model.decide(model.counts(gram, row, n_rows), n)
                ascii_ = np.concatenate([[0], np.cumsum((chunk.data >= 97) & (chunk.data <= 122))])
                plain = ascii_[chunk.ends] > ascii_[chunk.starts]
                for i in np.flatnonzero(~plain).tolist():
                    text = chunk.data[chunk.starts[i] : chunk.ends[i]].tobytes().decode("utf-8", "replace")
                    if not any(map(str.isalpha, text)):
                        best[i], score[i] = -1, 0.0
                yield pa.RecordBatch.from_arrays([*[c[chunk.rows] for c in batch.columns[1:]], pa.array(names[best], pa.string()), pa.array(score)], names=[*batch.schema.names[1:], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, learned: LanguageFilter, keep: list[Column]) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score. Only ``text`` is looked at.

    ``und``, score 0: null text or one without a letter. A text whose grams no language has gets the language with most
    training text and score 0. Without any learned language all are ``und``. The filter is broadcast; its size is
    bounded by the number of languages.
    """
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), *keep)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]], "lang_pred string", "score double"])
    return rows.mapInArrow(_predicted(docs.sparkSession.sparkContext.broadcast(learned)), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    learned = train(docs.where(third != 1))
    return predict(docs, learned, [F.col("doc_id"), F.coalesce(third == 1, F.lit(False)).alias("held_out")])
