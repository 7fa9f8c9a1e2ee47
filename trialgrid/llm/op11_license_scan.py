"""Licence scan: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser reads licence expressions.

A task works on bounded chunks of whole texts. A chunk's words (runs of ASCII letters and digits and of all code points
from U+0080 on, A-Z lower-cased) are written with one space between and a line feed between texts, so one pass of the
automaton finds every phrase, overlapping ones too, whatever stood between the words. After an identifier tag
(``SPDX-License-Identifier:``, ``license = "..."``) the text itself is read on to the end of its line and parsed as an
expression of licence identifiers with ``or``, ``and``, ``with`` and parentheses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.llm.shared import free_name
from trialgrid.llm.textbytes import Chunk, chunks, spread

#: Base phrases and their labels (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notice phrases of the method and their labels; a phrase that stands inside a longer one found is no match of its own.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the mit": "mit",
    "licensed under the apache": "apache",
    "apache software license": "apache",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "bsd license": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu general public license": "gpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "dedicated to the public domain": "public-domain",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "licensed under cc by": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nd": "cc-by-nd",
    "licensed under cc by nc sa": "cc-by-nc-sa",
    "licensed under cc by nc nd": "cc-by-nc-nd",
    "licensed under cc0": "cc0",
}

#: Words of a tag that an expression follows. The short one needs ``:`` or ``=`` behind it.
TAGS = ["spdx license identifier", "license", "licence", "licenses", "licences"]

#: Beginnings of identifiers, their label, and how far the licence binds: 0 public domain, 1 notice only, 2 the changed
#: file, 3 the whole work, 4 also over a network, 5 no free use. The longest beginning counts.
IDENTIFIERS = {
    "0bsd": ("bsd", 0), "cc0": ("cc0", 0), "unlicense": ("unlicense", 0), "public-domain": ("public-domain", 0), "publicdomain": ("public-domain", 0),
    "mit": ("mit", 1), "apache": ("apache", 1), "bsd": ("bsd", 1), "isc": ("isc", 1), "zlib": ("zlib", 1), "bsl-1": ("bsl", 1), "python": ("python", 1), "psf": ("python", 1), "cc-by": ("cc-by", 1),
    "lgpl": ("lgpl", 2), "mpl": ("mpl", 2), "epl": ("epl", 2), "cddl": ("cddl", 2),
    "gpl": ("gpl", 3), "cc-by-sa": ("cc-by-sa", 3), "eupl": ("eupl", 3), "agpl": ("agpl", 4), "sspl": ("sspl", 4),
    "cc-by-nc": ("cc-by-nc", 5), "cc-by-nd": ("cc-by-nd", 5), "cc-by-nc-sa": ("cc-by-nc-sa", 5), "cc-by-nc-nd": ("cc-by-nc-nd", 5), "proprietary": ("proprietary", 5), "busl": ("busl", 5),
}

#: Trust in one finding of each kind; ``score`` is one less the product of what is left.
TRUST = {"tag": 0.9, "notice": 0.6, "base": 0.5}

UNKNOWN_LEVEL = 5

_TOKEN = re.compile(rb"[ \t]*([()]|[a-z0-9][a-z0-9.+:-]*)")
_AFTER_TAG = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"'\[]?")
_BINDS = {"or": 1, "and": 2, "with": 3}
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def identified(name: str) -> tuple[str | None, int]:
    """Label and level of an identifier; no label if no known licence begins like it."""
    for size in range(len(name), 0, -1):
        if name[:size] in IDENTIFIERS and (size == len(name) or name[size] in "-+." or name[size].isdigit()):
            return IDENTIFIERS[name[:size]]
    return None, UNKNOWN_LEVEL


def parse_expression(data: bytes, at: int = 0) -> tuple[list[str], int]:
    """The expression that begins at ``at`` (lower-cased bytes), in postfix order, and where it ends.

    Shunting-yard: identifiers go out at once, operators wait on a stack while what binds stronger (``with`` over ``and``
    over ``or``) or stands in parentheses comes first. Reading ends at the line's end or where no expression can go on;
    an operator or open parenthesis with nothing behind it is not part of it. No expression: an empty list.
    """
    out: list[str] = []
    waiting: list[str] = []
    whole, held, stop = 0, [], at  # of the longest expression so far
    needs, depth = True, 0
    while token := _TOKEN.match(data, at):
        word = token[1].decode()
        if needs and word == "(":
            waiting.append(word)
            depth += 1
        elif needs and word not in _BINDS and word != ")":
            word = word.rstrip(".:-")
            out.append(word)
            needs = False
        elif not needs and word in _BINDS:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[word]:
                out.append(waiting.pop())
            waiting.append(word)
            needs = True
        elif not needs and word == ")" and depth:
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
        else:
            break
        at = token.end()
        if not needs and not depth:
            whole, held, stop = len(out), waiting[:], at
    return out[:whole] + held[::-1], stop


def evaluate(postfix: list[str]) -> tuple[set[str], int]:
    """Labels and level of an expression: of ``or`` the least binding side may be chosen, ``and`` binds as its strictest side,
    and an exception (``with``) takes one level off a licence that binds more than the changed file."""
    stack: list[tuple[set[str], int]] = []
    for word in postfix:
        if word not in _BINDS:
            label, level = identified(word)
            stack.append(({label} if label else set(), level))
            continue
        right, left = stack.pop(), stack.pop()
        if word == "with":
            stack.append((left[0], left[1] - 1 if 3 <= left[1] <= 4 else left[1]))
        else:
            stack.append((left[0] | right[0], min(left[1], right[1]) if word == "or" else max(left[1], right[1])))
    return stack[0] if stack else (set(), UNKNOWN_LEVEL)


def automaton() -> ahocorasick.Automaton:
    """Of all phrases, each between two separators: kind, label and number of words."""
    out = ahocorasick.Automaton()
    both = {w: ("base", label) for w, label in BASE.items()} | {w: ("notice", label) for w, label in NOTICES.items()} | {w: ("tag", "") for w in TAGS}
    for words, (kind, label) in both.items():
        out.add_word(f" {words} ", (kind, label, len(words.split(" "))))
    out.make_automaton()
    return out


def _words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the chunk's words, and the number of each text's first word, with one more at the end."""
    inside = _IS_WORD[chunk.data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]  # the chunk ends in a line feed, so every word ends
    return starts, ends, np.append(np.searchsorted(starts, chunk.starts), len(starts))


def find(chunk: Chunk, finder: ahocorasick.Automaton) -> tuple[np.ndarray, list[list[tuple]], list[list[tuple]]]:
    """For each text of a chunk: number of words, phrases found (first word, words, kind, label) and expressions
    (first word, text, postfix, labels, level)."""
    starts, ends, firsts = _words(chunk)
    n = np.diff(firsts)
    phrases: list[list[tuple]] = [[] for _ in n]
    expressions: list[list[tuple]] = [[] for _ in n]
    if not len(starts):
        return n, phrases, expressions
    # " w w w \n w w \n": a space before each text's words and one after each word, a line feed between texts
    lengths = ends - starts
    text_of = np.repeat(np.arange(len(n)), n)
    new = np.concatenate([[0], np.diff(text_of)]) > 0  # the first word of a text behind another
    places = np.cumsum(lengths + 1) - lengths + 2 * np.cumsum(new)  # after the leading space
    line = np.full(places[-1] + lengths[-1] + 1, 32, np.uint8)
    line[places[new] - 2] = 10
    line[spread(places, lengths)] = chunk.data[spread(starts, lengths)]
    found: list[tuple] = []
    for end, (kind, label, size) in finder.iter(line.tobytes().decode("latin-1")):
        found.append((end, size, kind, label))
    if not found:
        return n, phrases, expressions
    last = np.searchsorted(places, [f[0] for f in found], "right") - 1  # the phrase's last word stands before its last separator
    data = None
    for (_, size, kind, label), w in zip(found, last.tolist(), strict=True):
        doc, at = int(text_of[w]), w - size + 1
        if kind != "tag":
            phrases[doc].append((at - int(firsts[doc]), size, kind, label))
            continue
        if data is None:
            data = chunk.data.tobytes()
        begin = _AFTER_TAG.match(data, int(ends[w]))
        if not begin:
            continue
        postfix, stop = parse_expression(data, begin.end())
        labels, level = evaluate(postfix)
        if labels:  # at least one licence that is known
            expressions[doc].append((at - int(firsts[doc]), data[begin.end() : stop].decode(), postfix, sorted(labels), level))
    return n, [longest(sorted(p)) for p in phrases], expressions


def longest(phrases: list[tuple]) -> list[tuple]:
    """Phrases by first word, without notices that stand inside another phrase of the method; base phrases all stay."""
    out, covered = [], -1
    for at, size, kind, label in sorted(phrases, key=lambda p: (p[0], -p[1])):
        if kind == "notice":
            if at + size <= covered:
                continue
            covered = at + size
        out.append((at, size, kind, label))
    return out


MATCHES = "array<struct<word:long,words:int,kind:string,label:string>>"
EXPRESSIONS = "array<struct<word:long,text:string,postfix:array<string>,labels:array<string>,level:int>>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = automaton()
    match = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int32()), ("kind", pa.string()), ("label", pa.string())]))
    texts = pa.list_(pa.string())
    expression = pa.list_(pa.struct([("word", pa.int64()), ("text", pa.string()), ("postfix", texts), ("labels", texts), ("level", pa.int32())]))
    for batch in batches:
        for chunk in chunks(batch.column(0)):
            n, phrases, expressions = find(chunk, finder)
            columns = [
                pa.array(n, pa.int64()),
                pa.array([[dict(zip(("word", "words", "kind", "label"), p, strict=True)) for p in own] for own in phrases], match),
                pa.array([[dict(zip(("word", "text", "postfix", "labels", "level"), e, strict=True)) for e in own] for own in expressions], expression),
            ]
            kept = [c.slice(chunk.rows.start, chunk.rows.stop - chunk.rows.start) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*batch.schema.names[1:], *[f"_r{i}" for i in range(3)]])


def scan_licenses(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs``, n_words, matches and expressions.

    matches: first word (from 0), number of words, kind (``base`` or ``notice``) and label, in the order of the text, all
    places, overlapping ones too, but no notice within another. expressions: the tag's first word, the expression's text,
    its postfix form, sorted labels and level (see IDENTIFIERS); tags with no known licence are not there.
    Null text counts as empty: no word, empty lists. Repeated rows and null ids are rows like any other; kept columns may
    have any name, results get an underscore where they clash. An empty table gives no rows.
    """
    names = free_name(docs.select(*[F.col(f"`{c}`") for c in keep]), "n_words", "matches", "expressions")
    text = free_name(docs.select(*[F.col(f"`{c}`") for c in keep]), "_text")[0]
    rows = docs.select(F.coalesce("text", F.lit("")).alias(text), *[F.col(f"`{c}`") for c in keep])
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    return rows.mapInArrow(_renamed(names), ", ".join([*kept, f"`{names[0]}` long, `{names[1]}` {MATCHES}, `{names[2]}` {EXPRESSIONS}"]))


def _renamed(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _scanned(batches):
            yield batch.rename_columns([*batch.schema.names[:-3], *names])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base and method labels, and a score: one less the product of the doubt that each distinct finding leaves."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    base = F.filter("matches", lambda m: m["kind"] == "base")
    at = F.transform(base, lambda m: m["word"])
    written = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    of = lambda ms: F.transform(ms, lambda m: m["label"])
    tags = F.flatten(F.transform("expressions", lambda e: e["labels"]))
    findings = F.array_distinct(F.concat(F.transform("matches", lambda m: F.struct(m["kind"].alias("kind"), m["label"].alias("label"))), F.transform(tags, lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("label")))))
    left = lambda kind: F.coalesce(*[F.when(kind == k, F.lit(1 - t)) for k, t in TRUST.items()])
    score = F.lit(1.0) - F.aggregate(findings, F.lit(1.0), lambda acc, f: acc * left(f["kind"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        written(of(base)).alias("base_labels"), written(F.concat(of(F.col("matches")), tags)).alias("labels"), score.alias("score"),
        F.array_min(F.transform("expressions", lambda e: e["level"])).alias("least_level"), F.array_max(F.transform("expressions", lambda e: e["level"])).alias("strictest_level"),
    )
