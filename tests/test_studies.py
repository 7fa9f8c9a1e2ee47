"""Design checks and study tables by hand: literals, levels, balance, coverage, re-scored values, memberships, verdicts."""

import math

from pyspark.sql import functions as F

from trialgrid.functions.special import binom_tail
from trialgrid.operators import studies as st
from trialgrid.sources.tables import read_keyed


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_literal_tables(spark):
    text = st.literal_table(spark, "\n a , 1.5\n\nb,x\n", "name string, t double")
    assert rows(text, "name", "t") == [("a", 1.5), ("b", None)]
    assert rows(st.literal_table(spark, {"a": 1}, "k string, v int"), "k", "v") == [("a", 1)]


def test_sibling_paths(spark):
    df = spark.createDataFrame([("/r/a.wav", "/r"), ("/r/a.wav.txt", ""), ("b.wav", "/r"), (None, "/r")], "p string, root string")
    got = df.select(st.sibling_path(F.col("p"), F.col("root"), (".wav", ".TextGrid")).alias("x")).collect()
    assert [r.x for r in got] == ["/a.TextGrid", "/r/a.wav.txt", "b.TextGrid", None]


def test_labels_of_codes(spark):
    df = spark.createDataFrame([(-1, 1, "x"), (0, 1, "y"), (None, None, "z")], "a int, b int, r string")
    got = st.code_labels(df, {"a": {-1: "l", 1: "h"}, "b": {1: "w"}}, "arrow", "r")
    assert rows(got, "r", "a_label", "arrow") == [("x", "l", "l→w (x)"), ("y", None, "w (y)"), ("z", None, " (z)")]


def test_balance(spark):
    df = spark.createDataFrame([("a", -1.0), ("a", 1.0), ("b", -1.0), ("b", 0.5), (None, 0.5)], "pair string, cue double")
    got = {(r.scope, r.pair): (r.spans, r.balanced) for r in st.balance_report(df, ["cue"], "pair").collect()}
    assert got == {("all", None): (True, True), ("group", "a"): (True, True), ("group", "b"): (False, False), ("group", None): (False, False)}
    assert st.balance_report(df.where("false"), ["cue"], "pair").count() == 0


def test_levels(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1), ("b", 4), ("c", 0), ("c", 1), ("d", None)], "g string, step int")
    got = rows(st.level_report(df, ["g"], "step"), "g", "missing", "contiguous")
    assert got == [("a", [], True), ("b", [2, 3], False), ("c", [], False), ("d", [], False)]


def test_coverage_and_rescoring(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "s int"), spark.createDataFrame([(2,), (3,)], "s int")
    assert rows(st.coverage_report({"x": a, "y": b}, "s"), "s", "tables", "complete") == [(1, ["x"], False), (2, ["x", "y"], True), (3, ["y"], False)]
    old = spark.createDataFrame([(1, 0.5), (2, 0.6), (3, None), (4, 0.1), (5, None)], "k int, v double")
    new = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, None), (5, 0.2), (6, 0.3)], "k int, v double")
    assert rows(st.rescored_report(old, new, ["k"], "v"), "k", "status") == [(1, "same"), (2, "differs"), (3, "same"), (4, "only stored"), (5, "differs"), (6, "only again")]


def test_unique_variance_and_memberships(spark):
    fits = [(1, 0, None, 1.0), (1, 1, None, 2.0), (1, 0, "p", 4.0), (1, 1, "p", 3.0), (1, 0, "q", 0.0), (2, 0, "p", 1.0)]
    got = st.unique_variance(spark.createDataFrame(fits, "site int, fold int, block string, score double"), ["site"], "fold", "block", "score")
    assert rows(got, "site", "block", "unique_variance", "n_folds", "share") == [(1, "p", 2.0, 2, 1.0), (1, "q", -1.0, 1, 0.0)]
    assert rows(st.responsive_sites(got, ["site"], 0.5), "site", "unique_variance") == [(1, 2.0)]
    members = spark.createDataFrame([("s", 1, 0), ("s", 2, 1), ("t", 3, 1)], "subject string, site int, cluster int")
    chosen = spark.createDataFrame([("s", 1, "p"), ("s", 9, "p")], "subject string, site int, block string")
    only = spark.createDataFrame([(2,), (2,), (3,)], "site int")
    out = st.membership_rows(chosen, "block", members, "cluster", ["site"], "subject", {"all": None, "some": only})
    assert rows(out, "cluster", "column") == [(0, "all"), (0, "p"), (1, "all"), (1, "some")]


def test_study_verdicts(spark):
    df = spark.createDataFrame([(0.01, 0.5), (0.01, 0.04), (0.2, 0.1), (0.07, 0.5), (None, 0.5), (0.0, 0.5)], "p double, c double")
    got = df.select(st.study_verdict("p", "c").alias("v"), st.log_study("p", "c", math.log(0.05), math.log(0.1)).alias("l")).collect()
    assert [r.v for r in got] == ["kept", "control significant", "control as good", "not significant", "untested", "kept"]
    assert [r.l for r in got] == [True, False, False, False, None, None]
    best = st.best_window(spark.createDataFrame([(1, 2, 0.1, 0.3), (1, 1, 0.1, 0.2), (2, 1, None, 0.1)], "site int, w int, p double, c double"), ["site"], "w", "p", "c")
    assert rows(best, "site", "w", "least_p", "least_c") == [(1, 1, 0.1, 0.2)]


def test_measure_filter_reaches_the_scan(spark, tmp_path):
    for subject in ("a", "b"):
        one = spark.createDataFrame([(1, "x", 0.1), (1, "y", 0.2), (2, None, 0.3)], "site int, measure string, score double")
        one.write.parquet(f"{tmp_path}/{subject}/outcomes.parquet")
    found = st.measure_of(read_keyed(spark, f"{tmp_path}/*/outcomes.parquet", {"subject": "([ab])/outcomes"}), "y")
    assert rows(found, "subject", "site", "score") == [("a", 1, 0.2), ("b", 1, 0.2)]
    assert "EqualTo(measure,y)" in found._jdf.queryExecution().executedPlan().toString()


def test_relation_and_congruency(spark):
    early = spark.createDataFrame([(1, 1), (2, 1), (3, -1), (4, 0), (5, None)], "k int, early_polarity int")
    late = spark.createDataFrame([(1, 1), (2, -1), (3, -1), (4, 1), (5, 1)], "k int, late_polarity int")
    relation = st.preference_relation(early, late, ["k"], {-1: "d", 1: "n"})
    assert rows(relation, "early_selectivity", "late_selectivity", "n") == [("d", "d", 1), ("d", "n", 0), ("n", "d", 1), ("n", "n", 1)]
    assert rows(st.congruency_counts(relation), "congruent", "incongruent") == [(2, 1)]
    assert abs(binom_tail(2, 3) - 0.5) < 1e-12
    assert rows(st.congruency_counts(st.preference_relation(early.where("false"), late, ["k"], {-1: "d"})), "congruent", "incongruent") == [(0, 0)]


def test_many_positive(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, None), (2, 1.0, -1.0, None), (3, 1.0, 1.0, -5.0)], "k int, a double, b double, c double")
    assert rows(st.many_positive(df, ["a", "b", "c"]), "k", "n_positive", "row_mean") == [(1, 2, 1.5), (3, 2, -1.0)]


def test_items_with_data(spark):
    items = spark.createDataFrame([("a", 0), ("a", 2), ("b", 0), ("c", 0)], "s string, i int")
    assert rows(st.with_data(items, spark.createDataFrame([("a", 2), ("b", 0)], "s string, n_channels int"), "s", "i"), "s", "i") == [("a", 0)]
