"""Findings of round 4: disk of the n-gram join (F1)."""

import time

import numpy as np
import pyarrow as pa


def _batch(texts):
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})


def test_a_signature_takes_ten_bytes():
    from trialgrid.llm import op3_ngram_join as op3
    from trialgrid.llm.textbytes import chunks, shingles

    batch, n = _batch([" ".join(f"w{i}x{k}" for k in range(20 + 40 * (i % 9))) for i in range(90)]), 0
    for chunk in chunks(batch.column("text")):
        tokens, bounds = shingles(chunk, op3.SHINGLE)
        n += len(op3._signatures(tokens, bounds)[0])
    rows = [row for out in op3._packed_signatures(7)(iter([batch])) for row in out.to_pylist()]
    assert n and sum(len(row[c]) for row in rows for c in ("sig", "own", "spare")) <= 10 * n


def test_shuffle_files_end_with_the_job_that_writes_a_table(spark):
    from trialgrid.llm.shared import drop_stored, stored, stored_sorted

    files = lambda: {f.name for f in map(_File, _seq(spark)) if f.name.startswith("shuffle_")}
    for write in (stored, lambda df: stored_sorted(df, "id", 2)):
        before = files()
        out = write(spark.range(1000).repartition(7))
        end = time.time() + 10
        while files() - before and time.time() < end:
            time.sleep(0.1)
        assert not files() - before
        assert out.count() == 1000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
        drop_stored(out)


class _File:
    def __init__(self, file):
        self.name = file.getName()


def _seq(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [files.apply(i) for i in range(files.size())]


def test_sets_of_one_short_id_meet(spark):
    """Two similar sets whose ids agree in the bits that go with signatures are linked, and so are those like them."""
    from trialgrid.llm import op3_ngram_join as op3

    words = " ".join(f"w{k}" for k in range(30))
    ids, n = [], 250_000
    for at in range(0, n, 50_000):
        ids += [i for out in op3._document_sets(iter([_batch([f"{words} v{i}" for i in range(at, at + 50_000)])])) for i in out.column("set_id").to_pylist()]
    short = np.array(ids).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    order = np.argsort(short, kind="stable")
    same = np.flatnonzero(short[order][1:] == short[order][:-1])
    assert same.size  # some seven of 250,000
    twins = [(int(order[k]), int(order[k + 1])) for k in same[:3]]
    for others in (0, 1, 9):  # alone, in a small bucket, in a large one
        for x, y in twins:
            texts = [f"{words} v{x}", f"{words} v{y}", *[f"{words} o{k}" for k in range(others)], "another text of a few words only"]
            got = {r.doc_id: r.component_id for r in op3.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
            assert got == {i: 0 for i in range(len(texts) - 1)} | {len(texts) - 1: len(texts) - 1}
