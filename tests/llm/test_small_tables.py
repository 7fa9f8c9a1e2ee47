"""Round 3, op3_ngram_join on many partitions: tables of few rows are written by few tasks, and a task's end is cheap."""

import gc
import weakref
from contextlib import contextmanager

import pyarrow as pa


@contextmanager
def _many_partitions(spark, n=48):
    wanted = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _files_of(monkeypatch, module):
    made, write = [], module.stored

    def seen(df, *a, **b):
        out = write(df, *a, **b)
        made.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(module, "stored", seen)
    return made


def test_components_of_few_links_are_few_files(spark, monkeypatch):
    from trialgrid.llm import components as module

    links = [(i, i + 1) for i in range(0, 100)] + [(500, k) for k in range(501, 560)]
    with _many_partitions(spark):
        made = _files_of(monkeypatch, module)
        got = {r.node: r.root for r in module.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(101)}) == 1 and len({got[k] for k in range(500, 560)}) == 1 and got[0] != got[500] and len(got) == 161
    assert len(made) > 3 and max(made[1:]) == 1  # the first one's rows aren't counted before


def test_files_follow_the_bound(spark, monkeypatch):
    from trialgrid.llm import shared

    monkeypatch.setattr(shared, "FILE_ROWS", 100)
    with _many_partitions(spark):
        rows = spark.range(1000).selectExpr("id * 7 as id").groupBy("id").count()
        for most, files in ((None, 48), (1000, 10), (0, 1), (1_000_000, 48)):  # a large bound leaves all partitions
            out = shared.stored(rows, most=most)
            assert len(out.inputFiles()) == files and out.count() == 1000 == shared.stored_rows(out)


def test_ngram_join_on_many_partitions(spark, monkeypatch):
    """Near copies in a chain: the classes of few partitions, and no table of their components is dealt out."""
    from trialgrid.llm import components as module
    from trialgrid.llm.op3_ngram_join import similar_components

    rows = []
    for k in range(40):
        own = [f"w{i}" for i in range(150)]
        for j in range(k % 20):
            own[(j * 5) % 150] = f"v{j}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, similar_components(docs).drop("set_id").collect()))
    made = _files_of(monkeypatch, module)
    with _many_partitions(spark, 24):
        assert sorted(map(tuple, similar_components(docs).drop("set_id").collect())) == want
    assert made and max(made) == 1


def test_a_task_leaves_no_garbage_and_skips_what_was_there(spark):
    from trialgrid.llm.shared import tidy

    def frozen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gc.get_freeze_count()] * batch.num_rows, pa.int64())], names=["frozen"])

    got = spark.range(4, numPartitions=1).mapInArrow(tidy(frozen), "frozen long").collect()
    assert len(got) == 4 and min(r.frozen for r in got) > 0

    def after(batches):
        refs = []

        class Node:
            pass

        def run(inner):
            for batch in inner:
                node = Node()
                node.self = node
                refs.append(weakref.ref(node))
                del node
                yield batch

        n = sum(b.num_rows for b in tidy(run)(batches))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sum(r() is not None for r in refs)])], names=["n", "left"])

    got = spark.range(4, numPartitions=1).mapInArrow(after, "n long, left long").collect()
    assert [(r.n, r.left) for r in got] == [(4, 0)]
