"""Personal data by fixed patterns and a linear-chain conditional random field.

The patterns give the base spans. The CRF looks at words by their shape (classes of characters with run lengths, of the
word and its neighbours, and checks such as Luhn's) and adds what the patterns miss: phone numbers without a plus sign,
IPv6 addresses, card numbers grouped by dots, mail addresses on hosts without a dot. It is trained on a small labelled
table that a rule makes, and decoded by Viterbi in numpy batches.

Only words with a digit or an at sign may carry a label; all others are outside by constraint. So a text's chain falls
into runs of such words with a known state on both sides, and decoding the runs is decoding the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.llm.shared import WORD

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
SPANS = "array<struct<kind string, start int, end int, base boolean>>"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match never ends within a run of digits, so looking behind changes nothing but the time for long runs
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(WORD)
_SOME = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, by kind, then start."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        # the part before the sign reaches back over allowed characters, but not into the last match or over another sign
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((0, start, done := found.end()))
        at = text.find("@", max(at + 1, done))
    if _SOME.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split("."))]
        out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def _shape(word: str) -> str:
    """Character classes with run lengths: 555-5526 is d3-d4, Abc1 is Xxd1. Runs over 4 digits fall into two classes."""
    out, i = [], 0
    while i < len(word):
        c, j = word[i], i + 1
        kind = "d" if c in "0123456789" else "X" if c.isupper() else "x" if c.isalpha() else c
        while j < len(word) and ("d" if word[j] in "0123456789" else "X" if word[j].isupper() else "x" if word[j].isalpha() else word[j]) == kind:
            j += 1
        n = j - i
        out.append(kind + (str(n) if n <= 4 else "m" if n <= 9 else "l") if kind == "d" else kind)
        i = j
    return "".join(out)


_EDGE = ".,;:!?#*$%&|<>\"'[]{}"


def _features(words: list[str], at: int) -> list[str]:
    """Feature names of words[at]."""
    word = words[at].strip(_EDGE)
    digits = _digits(word)
    near = [_shape(words[i].strip(_EDGE)) if 0 <= i < len(words) and _SOME.search(words[i]) else "w" for i in (at - 1, at + 1)]
    shape = _shape(word)
    parts, octets = word.split(":"), word.split(".")
    dotted = len(octets) == 4 and all(re.fullmatch("[0-9]{1,18}", p) for p in octets)
    return [
        "b", f"s={shape}", f"p={near[0]}|{shape}", f"n={shape}|{near[1]}", f"n={min(len(digits), 20)}", f"at={word.count('@')}", f"dot={min(word.count('.'), 4)}",
        f"v6={len(parts) >= 3 and all(len(p) <= 4 and re.fullmatch('[0-9a-fA-F]*', p) is not None for p in parts)}",
        f"v4={dotted and ('in range' if all(int(p) <= 255 for p in octets) else 'out of range')}",
        f"luhn={16 <= len(digits) <= 19 and luhn(digits)}", f"long={len(digits) >= 16}", f"hex={len(word) >= 16 and re.fullmatch('[0-9a-fA-F]+', word) is not None}",
    ]


def labelled_lines(n: int = 700, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The labelled table: n lines of words with a tag each. Carriers are random words; half of the lines hold an item
    of one of the kinds, the others numbers that are none (versions, dates, prices, hashes, numbers that fail Luhn)."""
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    w = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéüñ"), rng.integers(1, 9)))
    hexa = lambda k: "".join(rng.choice(list("0123456789abcdef"), k))

    def card(good: bool) -> str:
        while luhn(x := d(16)) != good:
            pass
        return x

    octet = lambda: str(rng.integers(0, 256))
    groups = lambda x, sep: sep.join(x[i : i + 4] for i in range(0, 16, 4))
    items = [
        lambda: ("email", [f"{w()}.{d(2)}@{w()}{d(1)}.example.com"]), lambda: ("email", [f"{w()}@{w()}"]), lambda: ("email", [f"{w()}_{w()}@{w()}.org"]),
        lambda: ("ip", [".".join(octet() for _ in range(4))]), lambda: ("ip", [":".join(hexa(4) for _ in range(8))]), lambda: ("ip", [f"{hexa(4)}:{hexa(3)}::{hexa(4)}"]),
        lambda: ("card", [card(True)]), lambda: ("card", [groups(card(True), ".")]),
        lambda: ("phone", [f"+{d(1)}", f"({d(3)})", f"{d(3)}-{d(4)}"]), lambda: ("phone", [f"({d(3)})", f"{d(3)}-{d(4)}"]), lambda: ("phone", [f"{d(3)}-{d(3)}-{d(4)}"]), lambda: ("phone", [f"+{d(2)}", d(3), d(3), d(4)]),
    ]
    others = [
        lambda: [".".join(str(x) for x in rng.permutation([rng.integers(256, 1000), *rng.integers(0, 1000, 3)]))],
        lambda: [f"{d(1)}.{d(1)}"], lambda: [f"{d(1)}.{d(1)}."], lambda: [f"{d(1)}."], lambda: [f"{d(1)}.{d(1)}.{d(2)}"], lambda: [f"{d(4)}-{d(2)}-{d(2)}"], lambda: [card(False)], lambda: [f"({d(4)})"], lambda: [f"{d(2)}%"],
        lambda: [f'"{hexa(40)}"'], lambda: [hexa(32)], lambda: [d(int(rng.integers(1, 9)))], lambda: [f"{w()}{d(2)}"], lambda: [f"${d(3)}.{d(2)}"], lambda: groups(card(bool(rng.integers(2))), " ").split(), lambda: [f"{d(2)}:{d(2)}"], lambda: [f"{d(2)}:{d(2)}:{d(2)}"], lambda: ["@"], lambda: [f"({d(3)})"], lambda: [f"{d(3)}-{d(4)}"], lambda: [f"+{d(1)}"], lambda: [d(10)], lambda: [f"{d(4)}-{d(4)}"],
    ]
    out = []
    for _ in range(n):
        words, tags = [], []
        for _ in range(int(rng.integers(1, 4))):
            k = int(rng.integers(1, 4))
            words += [w() for _ in range(k)]
            tags += ["O"] * k
            if rng.random() < 0.5:
                kind, item = items[rng.integers(len(items))]()
                tags += [f"{'B' if i == 0 else 'I'}-{kind}" for i in range(len(item))]
            else:
                item = others[rng.integers(len(others))]()
                tags += ["O"] * len(item)
            end = str(rng.choice(["", "", "", ".", ",", "!!", "###"]))
            words += [*item[:-1], item[-1] + end]
        out.append(([*words, w()], [*tags, "O"]))
    return out


@dataclass
class Chain:
    """A linear-chain CRF: weights[feature][tag], moves[tag][tag]; a run begins and ends next to an outside word."""

    names: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, words: list[str], at: int) -> np.ndarray:
        known = [self.names[f] for f in _features(words, at) if f in self.names]
        return self.weights[known].sum(0)

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over runs of emissions, all runs of a length at once."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(runs)
        by: dict[int, list[int]] = {}
        for i, run in enumerate(runs):
            by.setdefault(len(run), []).append(i)
        for length, which in by.items():
            e = np.stack([runs[i] for i in which])
            best, back = self.moves[0] + e[:, 0], []
            for t in range(1, length):
                through = best[:, :, None] + self.moves
                back.append(through.argmax(1))
                best = through.max(1) + e[:, t]
            tag = (best + self.moves[:, 0]).argmax(1)
            path = [tag]
            for b in reversed(back):
                path.append(tag := b[np.arange(len(tag)), tag])
            for i, tags in zip(which, np.stack(path[::-1], 1), strict=True):
                out[i] = tags
        return out


def _allowed() -> np.ndarray:
    """Moves that the tags allow: I-k only after B-k or I-k."""
    ok = np.ones((len(TAGS), len(TAGS)), bool)
    for i, a in enumerate(TAGS):
        for j, b in enumerate(TAGS):
            if b[0] == "I" and (a == "O" or a[2:] != b[2:]):
                ok[i, j] = False
    return ok


def train(lines: list[tuple[list[str], list[str]]], steps: int = 70, rate: float = 0.2, ridge: float = 1e-3) -> Chain:
    """Fit by Adam on the mean conditional log-likelihood of the runs of labelled lines, less a ridge penalty."""
    runs, golds = [], []
    for words, tags in lines:
        may = [bool(_SOME.search(x)) for x in words]
        at = 0
        while at < len(words):
            to = at
            while to < len(words) and may[to]:
                to += 1
            if to > at:
                runs.append([_features(words, i) for i in range(at, to)])
                golds.append([TAGS.index(t) for t in tags[at:to]])
            at = to + 1
    counts: dict[str, int] = {}
    for run in runs:
        for features in run:
            for f in features:
                counts[f] = counts.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= 2))}
    k, n_max, n_feat = len(TAGS), max(map(len, runs)), len(runs[0][0])
    ids = np.full((len(runs), n_max, n_feat), len(names))
    gold, real = np.zeros((len(runs), n_max), int), np.zeros((len(runs), n_max), bool)
    for i, (run, tags) in enumerate(zip(runs, golds, strict=True)):
        for t, features in enumerate(run):
            ids[i, t] = [names.get(f, len(names)) for f in features]
            gold[i, t], real[i, t] = tags[t], True
    closed = np.where(_allowed(), 0.0, -1e4)
    w, m = np.zeros((len(names) + 1, k)), np.zeros((k, k))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, m)]
    last = real.sum(1) - 1
    rows = np.arange(len(runs))
    for step in range(1, steps + 1):
        moves = m + closed
        e = w[ids].sum(2)
        alpha = np.zeros((n_max, len(runs), k))
        alpha[0] = moves[0] + e[:, 0]
        for t in range(1, n_max):
            alpha[t] = np.where(real[:, t, None], _logsum(alpha[t - 1][:, :, None] + moves, 1) + e[:, t], alpha[t - 1])
        total = _logsum(alpha[-1] + moves[:, 0], 1)
        beta = np.broadcast_to(moves[:, 0], (len(runs), k)).copy()
        dw, dm = np.zeros_like(w), np.zeros_like(m)
        for t in range(n_max - 1, -1, -1):
            p = np.exp(alpha[t] + beta - total[:, None]) * real[:, t, None]
            p[rows, gold[:, t]] -= real[:, t]
            np.add.at(dw, ids[:, t], p[:, None, :])
            if t == 0:
                dm[0] += p.sum(0)
                break
            pair = np.exp(alpha[t - 1][:, :, None] + moves + (e[:, t] + beta)[:, None, :] - total[:, None, None]) * real[:, t, None, None]
            dm += pair.sum(0)
            np.subtract.at(dm, (gold[:, t - 1][real[:, t]], gold[:, t][real[:, t]]), 1)
            beta = np.where(real[:, t, None], _logsum(moves + (e[:, t] + beta)[:, None, :], 2), beta)
        end = np.exp(alpha[-1] + moves[:, 0] - total[:, None])
        dm[:, 0] += end.sum(0)
        np.subtract.at(dm, (gold[rows, last], 0), 1)
        for x, g, s in ((w, dw, state[0]), (m, dm, state[1])):
            g = g / len(runs) + ridge * x
            s[0] += 0.1 * (g - s[0])
            s[1] += 0.01 * (g * g - s[1])
            x -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
        w[-1] = 0  # unseen features
    return Chain(names, w[:-1], m + closed)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def chain_spans(texts: list[str], chain: Chain) -> list[list[tuple[int, int, int]]]:
    """(kind number, start, end) that the CRF finds in each text, trimmed of punctuation at the edges."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs, places = [], []
    for n, text in enumerate(texts):
        at = 0
        while found := _SOME.search(text, at):
            # the words around the next digit or sign: from two words before to the end of the run, and one after
            begin = found.start()
            while begin and not text[begin - 1].isspace():
                begin -= 1
            spans, near, at = [], [], begin
            for m in _WORD.finditer(text, begin):
                near.append(m)
                if not _SOME.search(m.group()):
                    break
                spans.append(m.span())
                at = m.end()
            if not spans:  # can't be, but for a blank that only isspace() knows
                at = found.end()
                continue
            words = [m.group() for m in near]
            runs.append(np.stack([chain.emissions(words, i) for i in range(len(spans))]))
            places.append((n, spans))
    for (n, spans), tags in zip(places, chain.decode(runs), strict=True):
        i = 0
        while i < len(tags):
            if tags[i] and TAGS[tags[i]][0] == "B":
                j = i + 1
                while j < len(tags) and TAGS[tags[j]] == "I" + TAGS[tags[i]][1:]:
                    j += 1
                start, end = spans[i][0], spans[j - 1][1]
                while start < end and texts[n][start] in _EDGE:
                    start += 1
                while end > start and texts[n][end - 1] in _EDGE:
                    end -= 1
                if end > start:
                    out[n].append((KINDS.index(TAGS[tags[i]][2:]), start, end))
                i = j
            else:
                i += 1
    return out


def _marked(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = model.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            base = [base_spans(t) if t else [] for t in texts]
            some = [i for i, t in enumerate(texts) if t and _SOME.search(t)]
            added: dict[int, list] = dict(zip(some, chain_spans([texts[i] for i in some], chain), strict=True))
            rows = []
            for i, own in enumerate(base):
                free = [s for s in added.get(i, []) if all(s[2] <= b[1] or s[1] >= b[2] for b in own)]
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": at} for k, a, b, at in sorted([*[(*s, True) for s in own], *[(*s, False) for s in free]])])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, kind)], names=[*batch.schema.names[1:], "spans"])

    return run


def find_personal_data(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and ``spans``: kind, start, end (code points, end exclusive), base; by kind, then start.

    Null text counts as empty. Added spans never overlap base spans. Repeated rows and null ids are rows like any other.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(labelled_lines()))  # some thousand weights
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), *[F.col(c) for c in keep])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]], f"spans {SPANS}"])
    return rows.mapInArrow(_marked(model), schema)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    of = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(of, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
