"""Findings of round 3: line dedup with levels by default (F7)."""

import random


def _docs(spark, n=60, parts=8):
    rng = random.Random(7)
    lines = [f"a line that stands in several documents {k}" for k in range(40)]
    rows = [(i, "\n".join(rng.sample(lines, 6) + [f"an own line of the document {i}", "short"])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), dict(rows)


def _want(rows):
    held = {}
    for i, text in rows.items():
        for x in set(text.split("\n")):
            held.setdefault(x, set()).add(i)
    last = {x: max(ids) for x, ids in held.items() if len(x) >= 20 and len(ids) >= 3}
    return {i: "\n".join(x for x in text.split("\n") if last.get(x, i) == i) for i, text in rows.items()}


def test_line_dedup_merges_levels_by_default(spark, monkeypatch):
    from trialgrid.llm import op8_line_dedup as op8

    made = []

    class Seen(op8.LineIndex):
        def drop(self):
            made.append([[run.count() for run in level] for level in self.levels])
            made.append(sum(batch.where("known").count() > 0 for batch in self.batches))
            super().drop()

    monkeypatch.setattr(op8, "LineIndex", Seen)
    for parts in (8, 1):  # fewer partitions than batches, too
        docs, rows = _docs(spark, parts=parts)
        got = {r.doc_id: r.text for r in op8.drop_lines(docs).collect()}
        assert got == _want(rows)
        levels, repeats = made[-2:]
        assert len(levels) >= 3 and levels[2] and levels[2][0] > 0 and repeats >= 3
        lines = {x for text in rows.values() for x in text.split("\n") if len(x) >= 20}
        assert sum(map(sum, levels)) == len(lines)  # a line is in one run only


def test_batches_meet_runs_without_moving_them(spark, monkeypatch):
    from trialgrid.llm import op8_line_dedup as op8

    plans, write = [], op8.stored_sorted

    def seen(df, key, buckets):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, key, buckets)

    monkeypatch.setattr(op8, "stored_sorted", seen)
    index, held = op8.LineIndex(), {}
    for k in range(6):
        rows = [(10 * k + i, (i * 7 + k) % 25) for i in range(10)]
        for doc, line in rows:
            held.setdefault(line, []).append(doc)
        index.add(spark.createDataFrame(rows, "id long, line long"))
    joins = [p for p in plans if "SortMergeJoin" in p]
    assert len(joins) == 5 and all(p.count("Exchange") == 1 for p in joins)  # the batch's own lines only
    assert {r.line: r.last_id for r in index.often(3).collect()} == {x: max(ids) for x, ids in held.items() if len(ids) >= 3}
    index.drop()
