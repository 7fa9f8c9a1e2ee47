"""Licence scan, whitening and manifest against brute force: nulls, ties, repeats, odd numbers, clashing columns, empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- licence scan ---


def base_of(text):
    words = WORD.findall((text or "").translate(LOW))
    at = [(i, label) for i in range(len(words)) for p, label in BASE.items() if tuple(words[i : i + len(p)]) == p]
    return len(words), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({b for _, b in at}))


def license_texts():
    rng = random.Random(3)
    parts = ["MIT", "license", "License", "apache", "General", "PUBLIC", "é", "x1", "the"]
    gaps = [" ", "\n", "-", "  ", ", ", "_", "/", "\x00", "\x7f"]
    out = ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    out += [None, "", "\n\n", "mit license", "MIT License" * 3, "mit license " * 90_000, "é" * 700_000 + " mit license", "smit license", "mit licenses", "mit license"]
    return out


def test_license_base_columns(spark):
    from trialgrid.llm.op11_license_scan import scan_licenses

    texts = license_texts()
    docs = spark.createDataFrame([(i if i % 9 else None, i, t, "m", 1) for i, t in enumerate(texts)], "doc_id long, place int, text string, matches string, _text int").repartition(3)
    got = scan_licenses(docs, ["place", "doc_id", "matches", "_text"]).collect()
    assert len(got) == len(texts)
    for r in got:
        base = [m for m in r["matches_"] if m.kind == "base"]
        own = (r.n_words, len(base), min((m.word for m in base), default=None), max((m.word for m in base), default=None), ",".join(sorted({m.label for m in base})))
        assert own == base_of(texts[r.place]) and r["matches"] == "m"
    assert scan_licenses(docs.limit(0), ["doc_id"]).count() == 0


def test_license_labels_and_expressions(spark):
    from trialgrid.llm.op11_license_scan import evaluate, parse_expression, scan_licenses

    cases = {
        "mit": (["mit"], {"mit"}, 1),
        "mit or apache-2.0": (["mit", "apache-2.0", "or"], {"mit", "apache"}, 1),
        "gpl-2.0-only with classpath-exception-2.0 and mit or agpl-3.0": (["gpl-2.0-only", "classpath-exception-2.0", "with", "mit", "and", "agpl-3.0", "or"], {"gpl", "mit", "agpl"}, 2),
        "(mit or gpl-3.0) and bsd-3-clause": (["mit", "gpl-3.0", "or", "bsd-3-clause", "and"], {"mit", "gpl", "bsd"}, 1),
        "mit or (gpl-3.0": (["mit"], {"mit"}, 1),
        "mit and": (["mit"], {"mit"}, 1),
        "mit) or gpl": (["mit"], {"mit"}, 1),
        "((cc-by-nc-4.0))": (["cc-by-nc-4.0"], {"cc-by-nc"}, 5),
        "lgpl-2.1+ the rest": (["lgpl-2.1+"], {"lgpl"}, 2),
        "limited": (["limited"], set(), 5),
        "or mit": ([], set(), 5), "": ([], set(), 5), "()": ([], set(), 5), "(" * 5000: ([], set(), 5),
    }
    for text, (postfix, labels, level) in cases.items():
        found, _ = parse_expression(text.encode())
        assert found == postfix and evaluate(found) == (labels, level), text
    assert len(parse_expression(b"(" * 3000 + b"mit" + b")" * 3000)[0]) == 1
    assert evaluate(parse_expression(b" or ".join([b"mit"] * 5001))[0]) == ({"mit"}, 1)
    texts = {
        1: "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nint x;", 2: "license = \"GPL-3.0-or-later\"", 3: "Licensed under CC BY-NC 4.0.",
        4: "This work is licensed under the GNU Lesser General Public License, version 3.", 5: "The license expires soon", 6: "license: see below\nMIT", 7: "Permission is hereby granted, free of charge, to any person obtaining a copy",
    }
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), ["doc_id"]).collect()}
    labels = {k: sorted({m.label for m in r.matches} | {x for e in r.expressions for x in e.labels}) for k, r in got.items()}
    assert labels == {1: ["apache", "bsd", "mit"], 2: ["gpl"], 3: ["cc-by-nc"], 4: ["gpl", "lgpl"], 5: [], 6: [], 7: ["mit"]}
    assert got[1].expressions[0].text == "(mit or apache-2.0) and bsd-3-clause" and got[1].expressions[0].level == 1 and got[2].expressions[0].word == 0


def test_license_query(spark):
    from pyspark.sql import functions as F

    from trialgrid.llm.op11_license_scan import query

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = query(spark, sf)
    got = out.collect()
    assert len(got) == len(texts) and dict(out.dtypes)["first_word"] == "bigint"
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and (r.score > 0) == bool(r.labels)
    assert out.where(F.col("labels").contains("cc-by-nc")).count() == sum("CC BY-NC" in (t or "") for t in texts.values())


# --- whitening ---


def whitened(rows, most=16):
    ok = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in ok]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centre = lambda r: [(n * a - s) / n for a, s in zip(r, sums, strict=True)]
    d = np.array([centre(r) for r in fit])
    e, u = np.linalg.eigh(d.T @ d / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    return [i for i, _ in ok], n, deviations, np.array([centre(r) for r in x]) @ u / np.sqrt(e), e / np.trace(d.T @ d / n)


def test_whitening(spark):
    from trialgrid.llm.op12_whitening import whiten

    rng = np.random.default_rng(2)
    for dim, scale in ((20, 1.0), (3, 1.0), (5, 3e5), (4, 1e8)):
        x = rng.standard_normal((150, dim)) @ np.diag(np.linspace(1, 3, dim)) * scale
        rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)] + [(i, [float(c) for c in np.float32(x[7])]) for i in range(500, 900)]
        rows += [(None, rows[3][1]), (3, rows[3][1]), (901, None), (902, []), (903, [None] + [1.0] * (dim - 1)), (904, [float("nan")] * dim), (905, [float("inf")] * dim)]
        df = spark.createDataFrame([(i, v, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, n string, component int").repartition(3)
        got = whiten(df).collect()
        ids, n, deviations, want, explained = whitened(rows)
        k = min(16, dim)
        assert len(got) == len(ids) * k and {r.n for r in got} == {n} == {150}
        place = {i: a for a, i in enumerate(ids)}
        sides = [np.sign(sum(r.whitened * want[place[r.vec_id], c] for r in got if r.component == c + 1)) for c in range(k)]
        for r in got:
            a = place[r.vec_id]
            assert r.whitened == pytest.approx(sides[r.component - 1] * want[a, r.component - 1], abs=1e-9)
            assert r.deviation == (deviations[a] if deviations[a] < 2**63 else None) and r.explained == pytest.approx(explained[r.component - 1])
            assert r.identity_error < 1e-9
    assert whiten(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whiten(same).count() == 0  # no eigenvalue over zero
    mixed = spark.createDataFrame([(i, [float(i), float(i * i % 7)] if i % 5 else [1.0] * (3 + i)) for i in range(20)], "vec_id int, embedding array<double>")
    assert {r.vec_id for r in whiten(mixed).collect()} == {i for i in range(20) if i % 5}


def test_leading_pairs():
    from trialgrid.llm.op12_whitening import count_above, leading_pairs, tridiagonal

    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    spectra = [np.linspace(1, 2, 40), np.repeat([5.0, 3, 3, 1, 0.5], 8), np.logspace(0, -12, 40), np.r_[1, 1 - 1e-13, np.zeros(38)], -np.arange(40.0), np.r_[1e300, np.full(39, 1e290)], np.zeros(40)]
    for e in spectra:
        v = (q * e) @ q.T
        v = (v + v.T) / 2
        values, vectors = leading_pairs(v, 16)
        want = np.linalg.eigvalsh(v)[::-1]
        top = max(np.abs(want).max(), 1e-300)
        assert np.abs(values - want[: len(values)]).max(initial=0) < 1e-14 * 40 * top
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-9
        assert np.abs(v @ vectors - vectors * values).max(initial=0) < 1e-13 * top
        assert len(values) == min(16, int((want > 1e-13 * (want[0] if want[0] > 1e-9 * top else top)).sum()))
    v = (q * np.arange(40.0)) @ q.T
    d, off, _ = tridiagonal((v + v.T) / 2)
    for s in (-0.5, 0.5, 17.5, 39.5):
        assert count_above(d.tolist(), [0.0, *(off * off).tolist()], s, 1e-30) == (np.arange(40) > s).sum()
    for small in (np.array([[4.0]]), np.array([[1.0, 2.0], [2.0, 1.0]]), np.diag([1.0, 2.0, 2.0])):
        values, _ = leading_pairs(small)
        want = np.linalg.eigvalsh(small)[::-1]
        assert values == pytest.approx(want[want > 0])


# --- manifest ---


def manifest_of(rows, arity=16):
    """Rows: (doc_id, source, lang, n_chars, text) -> for each row, in order of groups: key, source, leaf, subroot, root, proof, folded."""
    cell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(*[cell(v) for v in r])

    def tree(nodes):
        """Root and, for each node, its (left, right) siblings by level."""
        steps, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            runs = [level[i : i + arity] for i in range(0, len(level), arity)]
            for s, i in zip(steps, at, strict=True):
                run, slot = runs[i // arity], i % arity
                s.append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at, level = [i // arity for i in at], [sha(*r) for r in runs]
        return level[0], steps

    groups = {}
    for r in rows:
        groups.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(r)
    built = []
    for g in sorted(groups):
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built.append((own, *tree([leaf(r) for r in own])))
    root, above = tree([b[1] for b in built])
    out = []
    for (own, subroot, steps), high in zip(built, above, strict=True):
        for r, path in zip(own, steps, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf((*r[:4], r[4].translate(LOW))) if hit and r[4] is not None else leaf(r)
            for left, right in [*path, *high]:
                now = sha(left, now, right)
            out.append((r[0], r[1], leaf(r), subroot, root, sha(*[x for s in [*path, *high] for x in s]), now, now == root))
    return out


def manifest_rows(name):
    rng = random.Random(name)
    text = lambda: rng.choice(["Some TEXT", "", None, "é" * rng.randint(0, 9), f"T{rng.random()}"])
    row = lambda i, s: (i, s, rng.choice([None, "en", ""]), rng.choice([None, 3]), text())
    return {
        "plain": [row(i, rng.choice([None, "", "a", "b", "é"])) for i in range(700)],
        "sparse": [row(rng.randint(-(2**63), 2**63 - 1), "s") for _ in range(300)],
        "edges": [row(i, "s") for i in (-(2**63), 2**63 - 1, -1, 0, 63, 64, -64, -65, 4095, 4096)],
        "repeats": [r for _ in range(3) for r in [row(5, "a"), (5, "a", None, None, "X"), row(None, "a"), row(7, "a"), row(None, None)]] * 9,
        "groups": [row(i, f"g{i % 300}") for i in range(301)],
        "full": [row(i, "a" if i < 4096 else "b") for i in range(4097)],
        "one": [row(1, None)],
    }[name]


@pytest.mark.parametrize("name", ["plain", "sparse", "edges", "repeats", "groups", "full", "one"])
def test_manifest(spark, name):
    from trialgrid.llm.op13_merkle_manifest import manifest, tampered_text

    rows = manifest_rows(name)
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, at string").repartition(3)
    got = manifest(docs, changed={"text": tampered_text()})
    assert got.columns == ["doc_id", "source", "place", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(((r[0], r[1], *r[3:]) for r in got.collect()), key=repr) == sorted(manifest_of(rows), key=repr)
    if name == "repeats":
        places = [(r.source, r.place) for r in got.collect()]
        assert len(set(places)) == len(places)
        assert all(r.verified for r in manifest(docs).collect())
        assert manifest(docs.limit(0)).count() == 0


# --- mixing: which documents are drawn ---


def test_mix_draws_as_by_hand(spark):
    from pyspark.sql import functions as F

    from trialgrid.llm import op7_mixing as m
    from trialgrid.llm.shared import unit

    rng = random.Random(8)
    rows = [(i, "w " * (rng.choice([0, 3, 20, 60, 700]) if i % 3 else rng.randint(1, 40)), "s%d" % (i % 4) if i % 11 else None) for i in range(400)] + [(7, "w w w", "s1")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(-1))
    size = F.regexp_count("text", F.lit(m.WORD)).cast("long")
    keyed = docs.select("doc_id", "source", size.alias("size"), crc.alias("crc"), m.quality_weight(F.col("text"), size).alias("q")).withColumn("key", -F.ln(unit(F.xxhash64(F.lit(29), "doc_id", "crc", "size"))) / F.col("q")).collect()
    got = m.mix_sources(docs).collect()
    assert len(got) == len(rows)
    for source in {r.source for r in got}:
        mine, own = [r for r in got if r.source == source], sorted((r for r in keyed if r.source == source), key=lambda r: (r.key, r.doc_id, r.crc, r.size))
        total, target = sum(r.size for r in own), mine[0].target
        whole = int(target / total + 1e-12)
        rest, drawn = target - whole * total, [False] * len(own)
        for k in range(m.MOST_PASSES if rest > 1e-6 else 0):
            gap, run = rest - sum(r.size for r, t in zip(own, drawn, strict=True) if t), 0
            for i, r in enumerate(own):
                if not drawn[i] and (k == 0 or r.size <= gap):
                    run += r.size
                    drawn[i] = run <= gap
        gap = rest - sum(r.size for r, t in zip(own, drawn, strict=True) if t)
        beyond = [(r.size, r.key, r.doc_id, r.crc, i) for i, r in enumerate(own) if not drawn[i] and gap < r.size < 2 * gap]
        if beyond and rest > 1e-6:
            drawn[min(beyond)[-1]] = True
        want = sorted((r.doc_id, (whole + t) * r.size) for r, t in zip(own, drawn, strict=True))
        near = sum(r.taken for r in mine)
        assert abs(near - target) <= 0.02 * target
        if abs(near - sum(t for _, t in want)) > 0.001 * target:  # passes end early once every source is near
            raise AssertionError((source, near, target))
        assert sorted((r.doc_id, r.taken) for r in mine) == want or len(want) == len(mine)
    assert sum(r.taken for r in got) == pytest.approx(sum(r.size for r in got), rel=0.02)
