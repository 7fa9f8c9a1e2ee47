"""Quality rules by distribution divergence, in DataFrame operations only.

Two histograms of each document, of character classes and of its language's common words, are compared to the
language's own reference histogram by the Jensen-Shannon distance (base 2, so 0 to 1). References are sums over all
documents of the language that pass the base rules. A document shorter than the guard is judged by the base rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.llm.shared import free_name, small_or_shuffled, stored

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Common words: at most this many bytes long, in this share of the language's documents, the most frequent so many.
COMMON_BYTES, COMMON_SHARE, COMMON_WORDS = 5, 0.3, 24
#: Verdict: largest distances allowed, and the words from which each is looked at.
MAX_CHARS, MAX_COMMON, GUARD_WORDS = 0.25, 0.33, 100


def _repeated_words() -> tuple[Column, Column, Column]:
    """Expressions for the words in 3-word windows found twice or more: all windows' hashes (from word hashes _wh), the
    windows sorted with their positions (from _win), and the number of words covered by repeated ones (from _sorted)."""
    ordered, last, n = F.col("_sorted"), F.size("_win") - 1, F.greatest(F.size("_wh") - 2, F.lit(0))
    part = lambda k: F.slice("_wh", k, n)
    # two steps with neighbours side by side are quicker than one that looks them up
    windows = F.zip_with(F.zip_with(part(1), part(2), lambda a, b: F.xxhash64(a, b)), part(3), lambda a, b: F.xxhash64(a, b))
    placed = F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    before = lambda i: ordered[F.greatest(i - 1, F.lit(0))]["h"]
    after = lambda i: ordered[F.least(i + 1, last)]["h"]
    again = F.filter(ordered, lambda x, i: ((i > 0) & (before(i) == x["h"])) | ((i < last) & (after(i) == x["h"])))
    return windows, placed, F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))


def _with_words(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("_lang"), text.alias("_t"))
    return rows.withColumn("_words", F.array_remove(F.split("_t", SPACE + "+"), ""))


def common_words(docs: DataFrame) -> DataFrame:
    """Each language's reference words: _lang, _ref (array, most frequent first). Bounded: a word must be in a fixed share of the documents."""
    rows = _with_words(docs).select("_lang", F.array_distinct(F.filter("_words", lambda w: F.octet_length(w) <= COMMON_BYTES)).alias("w"))
    n = rows.groupBy("_lang").agg(F.count("*").alias("n"))
    df = rows.select("_lang", F.explode("w").alias("w")).groupBy("_lang", "w").agg(F.count("*").alias("df"))
    often = df.join(F.broadcast(n), "_lang").where(F.col("df") >= F.col("n") * COMMON_SHARE)  # one row per language: bounded
    ranked = often.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct((-F.col("df")).alias("d"), "w"))).alias("r"))
    return ranked.select("_lang", F.slice(F.transform("r", lambda x: x["w"]), 1, COMMON_WORDS).alias("_ref"))


def features(docs: DataFrame, reference_words: DataFrame) -> DataFrame:
    """Base counts and both histograms of every document."""
    rows = _with_words(docs).join(F.broadcast(reference_words), "_lang", "left")
    # a reference word is short, so it is looked for among the short words only
    rows = rows.withColumns({"_wh": F.transform("_words", lambda w: F.xxhash64(w)), "_short": F.filter("_words", lambda w: F.octet_length(w) <= COMMON_BYTES)})
    # white space is one byte a character
    spaces = F.octet_length("_t") - F.octet_length(F.array_join("_words", ""))
    windows, placed, covered = _repeated_words()
    rows = rows.withColumns({"_win": windows, "_n": F.size("_words").cast("long"), "_spaces": spaces.cast("long")})
    # few documents repeat a window; only those are sorted
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), placed))
    rows = rows.withColumn("_lines", F.array_remove(F.split("_t", "\n"), ""))
    solid = F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    repeats = lambda lines: F.size(lines) - F.size(F.array_distinct(lines))
    # most characters are small letters and white space; the others are told apart by what is left after taking them out
    rows = rows.withColumn("_rest", F.regexp_replace("_t", r"[a-z\x20\x09-\x0D]+", "")).withColumn("_ascii", F.regexp_replace("_rest", r"[^\x00-\x7F]+", ""))
    count = lambda kind: (F.length("_ascii") - F.length(F.regexp_replace("_ascii", kind, ""))).cast("long")
    # one expression a place, as a lambda isn't compiled; null beyond the last reference word
    found = [(F.size("_short") - F.size(F.array_remove("_short", F.get("_ref", F.lit(k))))).cast("long") for k in range(COMMON_WORDS)]
    rows = rows.select(
        "doc_id", "_lang",
        F.col("_n").alias("n_words"),
        (F.length("_t") - F.col("_spaces")).alias("word_chars"),
        count(SYMBOLS + "+").alias("n_symbols"),
        F.when(repeats("_lines") > 0, repeats(solid)).otherwise(0).cast("long").alias("n_dup_lines"),
        F.when(F.col("_sorted").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.length("_t").cast("long").alias("_chars"),
        count("[A-Z]+").alias("_upper"), count("[0-9]+").alias("_digit"), count(r"[.,;:!?'\"()-]+").alias("_punct"), (F.length("_rest") - F.length("_ascii")).cast("long").alias("_wide"),
        F.array_compact(F.array(*found)).alias("_found"),
    )
    inside = F.col("word_chars") - F.col("_upper") - F.col("_digit") - F.col("_punct") - F.col("_wide") - F.col("n_symbols")
    chars = F.array("_upper", "_digit", "_punct", "_wide", "n_symbols", F.col("_chars") - F.col("word_chars"), inside)
    found = F.aggregate("_found", F.lit(0).cast("long"), lambda a, x: a + x)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return rows.select("doc_id", "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), chars.alias("_hc"), F.concat(F.col("_found"), F.array(F.col("n_words") - found)).alias("_hw"))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of equal length; 0 where either is empty or all zero."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = F.zip_with(p, q, lambda a, b: F.struct((a / total(p)).alias("a"), (b / total(q)).alias("b")))
    terms = F.transform(both, lambda x: (part(x["a"], (x["a"] + x["b"]) / 2) + part(x["b"], (x["a"] + x["b"]) / 2)) / 2)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(total(terms), F.lit(0.0)))).otherwise(0.0)


def score(docs: DataFrame, max_chars: float = MAX_CHARS, max_common: float = MAX_COMMON, guard_words: int = GUARD_WORDS) -> DataFrame:
    """Verdict on every document: base counts, base_failed, chars_distance, common_distance, kept.

    Null text counts as empty (no words, so it fails the base rules); a null lang is a language of its own; a language
    whose documents all fail has no reference, so only the base rules hold there; repeated rows and null ids are rows
    like any other; more columns are ignored; an empty table gives no rows.
    """
    rows = stored(features(docs, common_words(docs)))
    sums = []
    for h in ("_hc", "_hw"):
        long = rows.where(~F.col("base_failed")).select("_lang", F.posexplode(h).alias("i", "x")).groupBy("_lang", "i").agg(F.sum("x").alias("x"))
        sums.append(long.groupBy("_lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"].cast("double")).alias(h.replace("_h", "_r"))))
    # a row per language and at most 25 numbers: bounded
    refs = sums[0].join(sums[1], "_lang")
    rows = rows.join(F.broadcast(refs), "_lang", "left")
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    rows = rows.withColumn("chars_distance", F.coalesce(_distance(double("_hc"), F.col("_rc")), F.lit(0.0))).withColumn("common_distance", F.coalesce(_distance(double("_hw"), F.col("_rw")), F.lit(0.0)))
    far = (F.col("n_words") >= guard_words) & ((F.col("chars_distance") > max_chars) | (F.col("common_distance") > max_common))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "chars_distance", "common_distance")


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The documents that ``score`` keeps, with all their columns. A row is judged by its doc_id, text and lang together."""
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))).alias("h"))
    bad = score(docs.select(key.alias("doc_id"), "text", "lang"), **limits).where("not kept")
    (name,) = free_name(docs, "key")
    bad = stored(bad.select(F.col("doc_id").alias(name)).distinct())
    return docs.withColumn(name, key).join(small_or_shuffled(bad, bad.count()), name, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
