"""Edge cases of the numbered operators: long words, texts made to collide, clashing columns, repeats, empty tables, quantiles."""

import base64
import random
import re

import numpy as np
import pytest


def thue_morse(n: int) -> tuple[str, str]:
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a[:n], a[:n].translate(str.maketrans("ab", "ba"))


def test_span_hashes_have_no_family_of_collisions():
    from trialgrid.llm.textbytes import span_hashes

    for n in (64, 256, 264, 1024, 8192):
        x = np.frombuffer("".join(thue_morse(n)).encode(), np.uint8)
        one, other = span_hashes(x, np.array([0, n]), np.array([n, 2 * n]))
        assert one != other
    data = np.random.default_rng(1).integers(97, 100, 20_000).astype(np.uint8)
    starts = np.random.default_rng(2).integers(0, 19_000, 5_000)
    ends = starts + np.random.default_rng(3).integers(0, 400, 5_000)
    found = {}
    for a, b, h in zip(starts, ends, span_hashes(data, starts, ends).tolist(), strict=True):
        assert found.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(found.values())) == len(found)


def test_lines_and_words_made_to_collide(spark):
    from trialgrid.llm.op3_ngram_join import similar_components
    from trialgrid.llm.op8_line_dedup import drop_lines

    x, y = thue_morse(2048)
    docs = spark.createDataFrame([(1, x), (2, x), (3, y), (4, " ".join([x] * 7)), (5, " ".join([y] * 7))], "doc_id long, text string")
    got = {r.doc_id: r for r in drop_lines(docs).collect()}
    assert all(r.n_dropped == 0 for r in got.values()) and got[3].text == y
    roots = {r.doc_id: r.component_id for r in similar_components(docs).collect()}
    assert roots == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_words_of_any_length_and_any_pattern(spark):
    import public_tokenizers
    import pyarrow as pa
    import regex
    import tiktoken

    from trialgrid.llm.op2_bpe import _matches, _public_words, encode_and_decode
    from trialgrid.llm.textbytes import chunks

    rng = random.Random(1)
    letters = [*"ab'strevldmlZ  \n\t.,!09½Ⅷé 　中😀́_'", "'s", "'re", "'ve", "  ", " '"]
    split = regex.compile(public_tokenizers.PATTERN)
    for _ in range(500):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(6)]
        for chunk in chunks(pa.array(texts), lower=False):
            for starts, ends in (_public_words(chunk), _matches(chunk, split.finditer)):
                assert [chunk.data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == [w for t in texts for w in split.findall(t)]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["a" * 100_000, "".join(rng.choice("abcdefgh") for _ in range(3000)) + " end", "word " * 200_000, "1" * 130 + "!" * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in encode_and_decode(docs, ["doc_id"]).collect():
        assert bytes(r.decoded).decode() == texts[r.doc_id]
        if r.doc_id:  # the library itself is slow on the first
            assert r.ids == codec.encode_ordinary(texts[r.doc_id])


def test_clashing_columns_and_repeats(spark):
    from pyspark.sql import functions as F

    from trialgrid.llm.op3_ngram_join import one_of_each
    from trialgrid.llm.op6_sharding import assign_shards, interleave
    from trialgrid.llm.op8_line_dedup import drop_lines

    line = "the very same line in all of them"
    rows = [(k, f"{line}\nown line of document number {k}", 1, 2, "s") for k in (1, 2, 3, 3)] + [(None, line, 1, 2, "s"), (7, None, 1, 2, None), (8, "", 1, 2, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _gone int, source string")
    got = drop_lines(docs).collect()
    assert sorted((r.doc_id or 0, r.n_dropped, r._id, r._gone) for r in got) == sorted([(0, 0, 1, 2), (1, 1, 1, 2), (2, 1, 1, 2), (3, 0, 1, 2), (3, 0, 1, 2), (7, 0, 1, 2), (8, 0, 1, 2)])
    named = docs.withColumn("_b", docs["doc_id"]).withColumn("_n", docs["doc_id"]).withColumn("_before", docs["doc_id"])
    out = interleave(named, "source", [F.col("doc_id")], 3).collect()
    assert all(r._b == r.doc_id and r._n == r.doc_id and r._before == r.doc_id for r in out)
    assert len(assign_shards(docs).collect()) == len(rows)
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    twice = spark.createDataFrame([(2, x), (3, x), (3, y), (3, y), (4, y), (None, x), (5, ""), (5, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in one_of_each(twice).collect()) == sorted([(2, x), (3, y), (0, x), (5, ""), (5, "")])


def test_quantile_and_buckets(spark):
    from pyspark.sql import functions as F

    from trialgrid.llm.op7_mixing import mix_sources
    from trialgrid.llm.shared import exact_quantile

    rng = np.random.default_rng(4)
    values = {"a": rng.lognormal(1, 0.2, 999), "b": np.round(rng.lognormal(2, 1, 500), 1) + 0.1, "c": np.full(40, 3.5), "d": np.array([2.0])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "lang string, v double")
    for q in (0.0, 0.5, 0.995, 1.0):
        got = {r.lang: r.quantile for r in exact_quantile(rows, "lang", "v", q).collect()}
        assert all(got[k] == pytest.approx(np.quantile(v, q)) for k, v in values.items())
    # keys of any rate spread over the steps of their logarithm: no step holds more than a share of about 0.26 / steps
    key = lambda w: F.log2(-F.ln((F.col("id") + F.lit(0.5)) / 200_000) / w)
    steps = spark.range(200_000)
    for w in (0.05, 1.0):
        most = steps.groupBy(F.floor(key(w) * 64)).count().agg(F.max("count")).first()[0]
        assert most <= 0.27 / 64 * 200_000
    docs = spark.createDataFrame([(i, "w " * (i % 30), "s") for i in range(300)], "doc_id long, text string, source string")
    out = mix_sources(docs, weight=F.when(F.col("doc_id") % 2 == 0, 0.05).otherwise(1.0)).collect()
    assert len(out) == 300 and abs(sum(r.taken for r in out) - out[0].target) <= 15


def test_near_the_threshold_and_beyond_a_doubles_squares(spark):
    from trialgrid.llm.op1_embedding_dedup import near_duplicates

    rng = np.random.default_rng(3)
    base = rng.standard_normal((700, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other = rng.standard_normal((700, 64))
    other -= (other * base).sum(1)[:, None] * base
    other /= np.linalg.norm(other, axis=1)[:, None]
    c = rng.uniform(0.925, 0.945, 700)[:, None]
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * other])
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(1400)] + [(2000 + k, [s] * 3, 1) for k, s in enumerate((1e200, 1e201, 1e-200, 1e-201))]
    got = {r.vec_id: r.n_links for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    assert [got[i] for i in range(1400)] == near.sum(1).tolist() and [got[2000 + k] for k in range(4)] == [3] * 4


def test_empty_tables(spark):
    from trialgrid.llm.op5_personal_data import _shape, find_personal_data
    from trialgrid.llm.op10_quality_classifier import classify

    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert find_personal_data(none, ["doc_id"]).count() == 0
    assert classify(none, none.select("doc_id")).count() == 0
    assert _shape("a1" * 100) == "xd1" * 100 and re.fullmatch("x", _shape("b" * 9000))


def test_bpe_keeps_columns_of_any_name(spark):
    from trialgrid.llm.op2_bpe import encode_and_decode

    names = ["text", "_fresh", "_words", "_numbers", "_ids", "_bytes", "_k0", "a.b", "a b"]
    docs = spark.createDataFrame([("some words, some words", *range(8)), (None, *range(8))], ", ".join(f"`{n}` {'string' if n == 'text' else 'int'}" for n in names))
    got = encode_and_decode(docs, names).collect()
    assert [tuple(r[n] for n in names) for r in got] == [tuple(r) for r in docs.collect()]
    assert [bytes(r.decoded).decode() for r in got] == ["some words, some words", ""] and encode_and_decode(docs.limit(0), ["text"]).count() == 0
