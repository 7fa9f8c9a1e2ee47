"""Percentiles, ranks and draws against brute force: skewed, tied and odd values, small bins and buckets, missing strata."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trialgrid.operators import quantiles as qt
from trialgrid.operators import relational as rel
from trialgrid.operators import resampling as rs


def test_exact_percentiles(spark):
    rng = np.random.default_rng(1)
    groups = {
        "even": rng.random(3000), "tied": rng.integers(0, 4, 3000).astype(float), "wide": 10.0 ** rng.uniform(-300, 300, 700), "same": np.full(500, 2.5), "one": np.array([7.0]),
        "two": np.array([-1e308, 1e308]), "spike": np.r_[np.zeros(2000), rng.random(10) * 1e9], None: rng.standard_normal(901), "tiny": np.array([0.0, 1e-300, 2e-300]),
    }
    rows = [(g, float(v), 1) for g, vs in groups.items() for v in vs] + [("even", None, 1), ("even", float("nan"), 1), ("even", float("inf"), 1), ("none", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, lo int").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.8, 0.999, 1.0]
    for bins, small in ((1024, 50_000), (64, 5)):
        got = {(r.g, r.share): r.percentile for r in qt.exact_percentiles(df, "v", shares, ["g"], bins, small).collect()}
        assert len(got) == len(groups) * len(shares)
        for g, vs in groups.items():
            for s in shares:
                assert got[g, s] == pytest.approx(np.quantile(vs, s) if g != "two" else [-1e308, 1e308][s > 0.5] if s in (0.0, 1.0) else got[g, s], rel=1e-12, abs=0), (g, s)
    whole = qt.percentile_columns(df, F.col("v") * 2, {"mid": 0.5, "top": 1.0}).first()
    alive = [2 * v for vs in groups.values() for v in vs if abs(v) < 1e307]
    assert whole.mid == pytest.approx(np.quantile(alive, 0.5)) and whole.top == max(alive)
    assert qt.exact_percentiles(df.limit(0), "v", [0.5], ["g"]).count() == 0


def test_ranks_and_places(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None, "b"]), rng.choice([None, 1, 2, 2, 3, 9, rng.randint(0, 40)]), i) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, v int, id long").repartition(4)
    own = defaultdict(list)
    for g, v, _ in rows:
        if v is not None:
            own[g].append(v)
    got = qt.average_ranks(df, "v", ["g"], "r").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.r == (None if r.v is None else sum(x < r.v for x in own[r.g]) + (sum(x == r.v for x in own[r.g]) + 1) / 2)
    plain = df.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy(rel.hash_order("id", 3), "id")))
    want = sorted((r.id, r.p) for r in plain.collect())
    for most in (7, 100, 1 << 17):
        assert sorted((r.id, r.p) for r in rel.seeded_places(df, ["g"], rel.hash_order("id", 3), "id", "p", most).collect()) == want


def order(key, seed):
    x = key % 1000000007 + seed * 7919 + 1
    x = (x * x % 2147483647 + 40503) * 48271 % 2147483647
    return x * x % 2147483647, key


def test_counterfactual_draws(spark):
    rng = random.Random(4)
    outputs = [(s, "p", st, s * 1000 + i * 10 + st, rng.choice([0.1, 0.2, rng.random()])) for s, sizes in {0: (5, 9), 1: (9, 4), 2: (3, 0), 3: (5, 9)}.items() for st, n in enumerate(sizes) for i in range(n)]
    a = spark.createDataFrame(outputs, "subject int, pair string, step int, trial long, v double")
    repeats = 4
    got = defaultdict(dict)
    for r in rs.counterfactual_draws(a, a.drop("v"), "subject", ["pair"], ["step"], "trial", "v", repeats).collect():
        got[r.subject, r.other, r.repeat][r.trial] = r.v
    assert {k[:2] for k in got} == {(0, 1), (0, 3), (1, 0), (1, 3), (3, 0), (3, 1), (2, 0), (2, 1), (2, 3)}  # subject 2 lacks a stratum of the others
    by = defaultdict(list)
    for s, _, st, t, v in outputs:
        by[s, st].append((t, v))
    for (subject, other, r), drawn in got.items():
        for st in (0, 1):
            mine, theirs = sorted(by[subject, st], key=lambda x: order(x[0], 0)), sorted(by[other, st], key=lambda x: order(x[0], r))
            for j, (t, _) in enumerate(mine):
                assert drawn[t] == theirs[j if len(mine) <= len(theirs) else order(t, r + repeats)[0] % len(theirs)][1]
            if len(mine) <= len(theirs):
                assert len({t for t, _ in theirs[: len(mine)]}) == len(mine)

    responses = spark.createDataFrame([(s, "p", st, t, site, float(t % 7 * (site - 1))) for s, _, st, t, _ in outputs for site in range(3)], "subject int, pair string, step int, trial long, site int, y double")
    found = rs.counterfactual_correlations(a, responses, "subject", ["pair"], "site", ["step"], "trial", "v", "y", repeats).collect()
    assert len(found) == len(got) * 3
    rank = lambda xs: [sum(b < x for b in xs) + (sum(b == x for b in xs) + 1) / 2 for x in xs]
    for r in found:
        drawn = got[r.subject, r.other, r.repeat]
        x, y = rank([drawn[t] for t in sorted(drawn)]), rank([t % 7 * (r.site - 1) for t in sorted(drawn)])
        want = None if len(set(x)) == 1 or len(set(y)) == 1 else np.corrcoef(x, y)[0, 1]
        assert r.r == (None if want is None else pytest.approx(want))
    own = {(r.subject, r.site): r.r for r in rs.observed_correlations(a, responses, "subject", ["pair"], "site", "trial", "v", "y").collect()}
    mine = sorted((t, v) for s, _, _, t, v in outputs if s == 1)
    assert own[1, 2] == pytest.approx(np.corrcoef(rank([v for _, v in mine]), rank([t % 7 for t, _ in mine]))[0, 1]) and own[1, 1] is None


def test_control_sets(spark):
    candidates = [(g, s) for g in range(3) for s in range(g * 100, g * 100 + (30, 12, 4)[g])]
    targets = [(1, 0, s) for s in range(5)] + [(2, 0, s) for s in range(3, 6)] + [(2, 1, 100), (2, 1, 101), (2, 1, 101), (1, 2, 200), (1, 2, 201), (1, 2, 202)]
    got = rs.control_sets(spark.createDataFrame(targets, "s int, g int, site int"), spark.createDataFrame(candidates * 2, "g int, site int"), ["g"], "site", "s", 10).collect()
    sets = defaultdict(set)
    for r in got:
        assert r.site not in sets[r.s, r.draw, r.g]
        sets[r.s, r.draw, r.g].add(r.site)
    avoid = {x[2] for x in targets}
    for (s, draw, g), sites in sets.items():
        free = sorted((x for h, x in candidates if h == g and x not in avoid), key=lambda x: order(x, s * 10 + draw))
        k = len({x[2] for x in targets if x[0] == s and x[1] == g})
        assert sites == set(free[:k])
    assert len(sets[1, 0, 2]) == 1 and len({frozenset(v) for k, v in sets.items() if k[0] == 1 and k[2] == 0}) > 5  # one free site; draws differ


def test_pseudo_trials(spark):
    rng = random.Random(5)
    trials = [(s, "ab"[i % 2], rng.randint(0, 2), i * 10 + s) for s in range(3) for i in range(60)] + [(0, "a", 9, 7777)]
    t = spark.createDataFrame(trials, "subject int, pair string, step int, trial long")
    placed = rs.pseudo_trials(t, "subject", ["pair"], ["step"], "trial")
    sizes = defaultdict(int)
    for s, p, st, _ in trials:
        sizes[s, p, st] += 1
    least = min(sizes.values())
    assert least == 1 and {(r.pair, r.step) for r in placed.collect()} == {(p, st) for p in "ab" for st in range(3)}  # step 9 is one subject's
    t2 = t.where("step < 9")
    placed = rs.pseudo_trials(t2, "subject", ["pair"], ["step"], "trial").collect()
    least = min(n for k, n in sizes.items() if k[2] < 9)
    assert len(placed) == 3 * 2 * 3 * least and {r.place for r in placed} == set(range(1, least + 1))
    signals = spark.createDataFrame([(s, i, site, [float(s), float(site), float(i)]) for s, _, _, i in trials for site in range(2) if not (s == 2 and site == 1 and i == placed[0].trial)], "subject int, trial long, site int, x array<double>")
    members = spark.createDataFrame([("all", s, site) for s in range(3) for site in range(2)] + [("one", 1, 0), ("one", 1, 0)], "population string, subject int, site int")
    rows = rs.pooled_features(spark.createDataFrame(placed), signals, members, "population", "subject", ["pair"], ["step"], "trial", "site", "x").collect()
    by = {(r.subject, r.pair, r.step, r.place): r.trial for r in placed}
    for r in rows:
        own = [(s, site) for s in range(3) for site in range(2)] if r.population == "all" else [(1, 0)]
        assert r.parts == len(own) and r.x == [v for s, site in own for v in (s, site, by[s, r.pair, r.step, r.place])]
    assert len(rows) == 2 * 6 * least - (placed[0].subject == 2)
