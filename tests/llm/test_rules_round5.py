"""Quality rules: the counts behind the histograms on odd texts, one split of a text; memory of the tokenizer's workers."""

import re
import tracemalloc

from trialgrid.llm import op9_quality_rules as op9


def test_histograms_by_brute_force(spark):
    base = "the and of to in a it is on as the The THE the,the é the the\tthe\x0bthe\x0cthe\rthe\nthe  the"
    texts = [base + " x" * k + " #1 $2 (A-B) 'q' \U0001f600 é " + "\n \n\n" * (k % 3) for k in range(40)] + [None, "", " \n\t ", "the", " ", "\x00 \x1c"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    ref = spark.createDataFrame([("en", ["the", "of", "a", "é"])], "_lang string, _ref array<string>")
    out = op9.features(docs, ref)
    for r in out.collect():
        t = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = lambda kind: len(re.findall(kind, t))  # noqa: B023, E731
        own = [n("[A-Z]"), n("[0-9]"), n(r"[.,;:!?'\"()-]"), n(r"[^\x00-\x7F]"), n(r"[#*$%&|<>]"), len(t) - sum(map(len, words))]
        found = [words.count(w) for w in ("the", "of", "a", "é")]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r._hc == [*own, sum(map(len, words)) - sum(own[:5])] and r._hw == [*found, len(words) - sum(found)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "regexp_count" not in plan and plan.count(" replace(") == 0


def test_kinds_of_characters_in_little_memory():
    """The table of character kinds is made without a list of all characters, which took some 80 MB of each worker."""
    from trialgrid.llm import op2_bpe

    op2_bpe._kinds()  # modules are loaded
    tracemalloc.start()
    kinds = op2_bpe._kinds.__wrapped__()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6 and [int(kinds[ord(c)]) for c in "aé5 \n.\U00020000"] == [1, 1, 2, 3, 3, 0, 1]
