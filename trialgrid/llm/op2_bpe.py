"""Byte-level BPE encoding and decoding.

Words (matches of the tokenizer's pattern) are found and numbered by task; each distinct word of a task goes through
Spark higher-order functions once, as an array of bytes: a fold merges, step by step, the adjacent pair of the lowest
rank until no pair is in the vocabulary. Ranks come from a literal rank map without search. Decoding a word folds the
pieces of its ids into one byte array; texts are put together from their words. Nothing is shuffled: the three steps run
one after the other in the same task, and tasks are made large enough that few words are met in many of them.

Words are told apart by 64-bit hashes; each chunk's words are put together again and compared with its text, so two
words of one hash can't pass for each other. A task's word numbers start anew when its words hold so many bytes, which
bounds its memory whatever the partition's size. A fold over a word takes time with the square of its length, so a word
of more than LONG_WORD bytes is merged with a heap of ranked pairs before, and its pieces go on as words.
"""

from __future__ import annotations

import base64
import heapq
import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.llm.shared import tidy
from trialgrid.llm.textbytes import BEGINS, Chunk, cells, chunks, span_hashes, spread

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of distinct words after which a task begins new numbers, words that a task puts together at once, bytes of a
#: word that is merged with a heap, bytes of input that a task should have at least.
MOST_BYTES, AT_ONCE, LONG_WORD, TASK_BYTES = 24 << 20, 1 << 16, 128, 64 << 20
#: Ids take so many bits; a rank above all ranks.
ID_BITS, NO_RANK = 20, 1 << 20
ID = 1 << ID_BITS


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """The rank file, by default the public one that ``public_tokenizers`` places."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


class RankMap:
    """The vocabulary as literals.

    A pair of ids whose byte arrays make up a piece of the vocabulary has that piece's rank, which is its id too. The
    pairs' table is one row for each first id and one column for each second, nearly empty; its rows are laid over each
    other in one array, each moved so that entries don't meet, and each entry names its row.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        rows: dict[int, dict[int, int]] = {}
        pieces = [""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = base64.b64encode(piece).decode()
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    rows.setdefault(a, {})[b] = rank
        move, row, rank = _overlaid(rows, len(pieces))
        # the optimiser folds each into a constant
        literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
        self.for_encoding = F.struct(
            literal(move, "array<int>").alias("move"), literal([ranks[bytes([b])] for b in range(256)], "array<bigint>").alias("bytes"),
            # what the fold keeps of an id before another: the pair's rank, then the id, in one number that sorts by rank
            literal([r * ID + a if a >= 0 else -1 for a, r in zip(row, rank, strict=True)], "array<bigint>").alias("state"), literal([NO_RANK * ID + a for a in range(len(pieces))], "array<bigint>").alias("alone"),
        )
        self.for_decoding = F.struct(literal(pieces, "array<binary>").alias("pieces"))
        #: Pieces that merging doesn't lead to, as few vocabularies have; such a word is one id all the same.
        self.unmerged = {piece: rank for piece, rank in ranks.items() if len(piece) > 1 and not _reached(piece, ranks)}

    def encode(self, words: Column) -> Column:
        """Ids of each word. The literals are bound once, so that they stand once in the plan and in a task."""
        return F.element_at(F.transform(F.array(self.for_encoding), lambda bound: F.transform(words, Literals(bound).encode)), 1)

    def decode(self, ids: Column) -> Column:
        """Bytes of each word's ids."""
        return F.element_at(F.transform(F.array(self.for_decoding), lambda bound: F.transform(ids, Literals(bound).decode)), 1)


def _overlaid(rows: dict[int, dict[int, int]], n: int) -> tuple[list[int], list[int], list[int]]:
    """Each row's move, and the array's entries: their rows (-1: free) and values. Long rows are placed first.

    Places taken are bits of one long integer; shifted by each column and united, it shows all moves that don't fit.
    """
    taken, move, entries = 0, [0] * n, {}
    for a, row in sorted(rows.items(), key=lambda item: (-len(item[1]), item[0])):
        bad = own = 0
        for b in row:
            bad |= taken >> b
            own |= 1 << b
        move[a] = (~bad & (bad + 1)).bit_length() - 1  # the lowest bit not set
        taken |= own << move[a]
        entries |= {move[a] + b: (a, value) for b, value in row.items()}
    placed = [entries.get(i, (-1, 0)) for i in range(taken.bit_length())]
    return move, [a for a, _ in placed], [value for _, value in placed]


def _reached(piece: bytes, ranks: dict[bytes, int]) -> bool:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, len(ranks) * 2), i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)))
        if rank >= len(ranks) * 2:
            return False
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


class Literals:
    """Expressions over bound literals of a ``RankMap``."""

    def __init__(self, bound: Column) -> None:
        self.bound = bound

    def _state(self, a: Column, b: Column) -> Column:
        """The fold's number for id a before id b (null: the end). Little arithmetic, as the fold isn't compiled."""
        found = F.get(self.bound["state"], F.get(self.bound["move"], a.cast("int")) + b.cast("int"))
        return F.when(found.bitwiseAND(F.lit(ID - 1)) == a, found).otherwise(F.get(self.bound["alone"], a.cast("int")))

    def encode(self, word: Column) -> Column:
        """Ids of a word, an array of its byte values (or of one negative number, see ``_numbered``): merge the first
        pair of the lowest rank, again and again."""
        single = F.transform(word, lambda b: F.when(b < 0, (F.lit(-1) - b).cast("bigint")).otherwise(F.get(self.bound["bytes"], b)))
        begin = F.zip_with(single, F.slice(single, 2, F.size(word)), self._state)
        # the inner fold over one place only binds it
        merge = lambda state, _: F.aggregate(F.array(F.array_position(state, F.array_min(state)).cast("int")), state, self._merged)
        end = lambda state: F.transform(state, lambda x: x.bitwiseAND(F.lit(ID - 1)).cast("int"))
        return F.when(F.size(word) == 1, F.transform(single, lambda x: x.cast("int"))).otherwise(F.aggregate(F.slice(word, 2, F.size(word)), begin, merge, end))

    def _merged(self, state: Column, at: Column) -> Column:
        """The state with the pair at a place made one id; only its pairs with both neighbours are looked up. Arrays are
        joined by ``flatten``, which is quicker than ``concat`` here."""
        ident = lambda x: x.bitwiseAND(F.lit(ID - 1))
        least = F.get(state, at - 1)
        new = F.shiftright(least, ID_BITS)  # a pair's rank is the id of what it makes
        one, rest = self._state(new, ident(F.get(state, at + 1))), F.slice(state, at + 2, F.size(state))
        with_left = F.flatten(F.array(F.slice(state, 1, at - 2), F.array(self._state(ident(F.get(state, at - 2)), new), one), rest))
        return F.when(least >= F.lit(NO_RANK * ID), state).when(at > 1, with_left).otherwise(F.flatten(F.array(F.array(one), rest)))

    def decode(self, ids: Column) -> Column:
        """The byte array of ids: their pieces, concatenated."""
        return F.aggregate(ids, F.lit(b""), lambda done, i: F.concat(done, F.get(self.bound["pieces"], i)))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each code point: 1 letter, 2 number, 3 white space, 0 anything else."""
    import regex

    # decoded at once: a list of all characters would take some 80 MB of each worker
    every, out = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass"), np.zeros(0x110000, np.uint8)
    for kind, pattern in enumerate((r"\p{L}+", r"\p{N}+", r"\s+"), 1):
        for found in regex.finditer(pattern, every):
            out[found.start() : found.end()] = kind
    return out


LETTER, SPACE, END = 1, 3, 4


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points that begin at these places."""
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = data[at].astype(np.int32)
    for size, least, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        own = np.flatnonzero((data[at] >= least) & (data[at] < (0xE0, 0xF0, 0xF8)[size - 2]))
        value = padded[at[own]].astype(np.int32) & mask
        for k in range(1, size):
            value = value << 6 | padded[at[own] + k] & 0x3F
        out[own] = value
    return out


def _public_words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches of the public pattern: contractions after an apostrophe; runs of letters, of numbers
    or of other signs, with one blank before them; white space, less its last character before anything else."""
    data = chunk.data
    at = np.flatnonzero(BEGINS[data])
    point = _code_points(data, at)
    kind = _kinds()[point]
    kind[np.searchsorted(at, chunk.ends)] = END
    first = np.ones(len(at), bool)
    first[1:] = kind[1:] != kind[:-1]
    first |= kind == END
    after = np.flatnonzero((kind[1:] < SPACE) & (kind[:-1] == SPACE)) + 1
    first[after - 1] = True
    first[after[point[after - 1] == 32]] = False
    quote = np.flatnonzero(first & (point == 39))
    quote = quote[kind[np.minimum(quote + 1, len(at) - 1)] == LETTER]
    if len(quote):
        low, high = point[quote + 1], np.where(kind[quote + 2] == LETTER, point[quote + 2], 0)
        size = np.isin(low, [ord(c) for c in "stmd"]).astype(np.int64)
        for a, b in ("re", "ve", "ll"):
            size[(low == ord(a)) & (high == ord(b))] = 2
        quote, size = quote[size > 0], size[size > 0]
        first[quote + 1] = False
        rest = quote + 1 + size
        first[rest[kind[rest] == LETTER]] = True
    edge = np.flatnonzero(first)
    word = kind[edge] != END
    return at[edge[word]], at[edge[1:][word[:-1]]]


def _matches(chunk: Chunk, split) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the non-empty matches of any pattern."""
    starts, ends = [], []
    for a, b in zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
        text = chunk.data[a:b].tobytes().decode()
        byte = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]) + a
        found = [m.span() for m in split(text) if m.end() > m.start()]
        starts.append(byte[[x for x, _ in found]])
        ends.append(byte[[y for _, y in found]])
    return np.concatenate(starts).astype(np.int64), np.concatenate(ends).astype(np.int64)


def _long_pieces(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Sizes of the pieces a long word is merged into: the pair of the lowest rank, the first of equal ones, is merged again and again."""
    end, last = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))  # by the start of a piece: its end, the start of the one before
    heap = []

    def look(a: int) -> None:
        b = end[a]
        if b < len(word) and (rank := ranks.get(word[a : end[b]])) is not None:
            heap.append((rank, a, b, end[b])) if not ready else heapq.heappush(heap, (rank, a, b, end[b]))

    ready = False
    for a in range(len(word)):
        look(a)
    heapq.heapify(heap)
    ready = True
    gone = bytearray(len(word))
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if gone[a] or end[a] != b or gone[b] or end[b] != c:
            continue
        end[a], gone[b] = c, 1
        if c < len(word):
            last[c] = a
        look(a)
        if a:
            look(last[a])
    return [end[a] - a for a in range(len(word)) if not gone[a]]


class _Pile:
    """A numpy array that grows at its end."""

    def __init__(self, dtype: type) -> None:
        self.room, self.n = np.empty(1 << 10, dtype), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            grown = np.empty(max(self.n + len(more), 2 * len(self.room)), self.room.dtype)
            grown[: self.n] = self.held
            self.room = grown
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def held(self) -> np.ndarray:
        return self.room[: self.n]


class _Spans:
    """Numbered spans of values, laid one after the other."""

    def __init__(self, dtype: type) -> None:
        self.values, self.ends = _Pile(dtype), _Pile(np.int64)

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.ends.add(self.values.n + np.cumsum(lengths))
        self.values.add(values)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these spans, one after the other, and their lengths."""
        ends = self.ends.held[numbers]
        starts = np.where(numbers > 0, self.ends.held[numbers - 1], 0)
        return self.values.held[spread(starts, ends - starts)], ends - starts


class SameHash(Exception):
    """Two words of a task have one hash; another seed tells them apart."""


class _Words:
    """The distinct words a task has met since it began new numbers."""

    def __init__(self, seed: int) -> None:
        self.seed, self.spans = seed, _Spans(np.uint8)
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def number(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each span, and which of the spans are the new words, in the order of their numbers."""
        key, first, which = np.unique(span_hashes(data, starts, ends, self.seed), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, key)
        known = np.zeros(len(key), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == key[inside]
        number = np.empty(len(key), np.int64)
        number[known] = self.numbers[at[known]]
        new = first[~known]
        number[~known] = np.arange(len(new)) + self.spans.ends.n
        self.hashes, self.numbers = np.insert(self.hashes, at[~known], key[~known]), np.insert(self.numbers, at[~known], number[~known])
        length = ends[new] - starts[new]
        self.spans.add(data[spread(starts[new], length)], length)
        number = number[which]
        if not np.array_equal(self.spans.take(number)[0], data[spread(starts, ends - starts)]):
            raise SameHash
        return number, new


def _numbered(pattern: str | None, ranks: dict[bytes, int], unmerged: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as numbers of their words; a word that the task hasn't met since ``fresh`` comes along with the first row
        of its chunk, as an array of bytes. A word that merging doesn't lead to goes as the negative of its id less one."""
        if pattern is not None:
            import regex

            split = regex.compile(pattern).finditer
        odd = {len(w) for w in unmerged}
        known = _Words(0)
        for batch in batches:
            for chunk in chunks(batch.column("text"), lower=False, most=1 << 19):
                data = chunk.data
                starts, ends = _public_words(chunk) if pattern is None else _matches(chunk, split)
                long = np.flatnonzero(ends - starts > LONG_WORD)
                if len(long):
                    sizes = [_long_pieces(data[a:b].tobytes(), ranks) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
                    at = np.repeat(starts[long], [len(x) for x in sizes]) + np.concatenate([np.cumsum([0, *x[:-1]]) for x in sizes])
                    to = at + np.concatenate(sizes)
                    starts, ends = np.sort(np.concatenate([np.delete(starts, long), at])), np.sort(np.concatenate([np.delete(ends, long), to]))
                fresh = known.spans.values.n + 16 * known.spans.ends.n > MOST_BYTES
                if fresh:
                    known = _Words(0)
                while True:
                    try:
                        number, new = known.number(data, starts, ends)
                        break
                    except SameHash:
                        known, fresh = _Words(known.seed + 1), True
                length = ends[new] - starts[new]
                flat = data[spread(starts[new], length)].astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                if odd:
                    spans = zip(starts[new].tolist(), ends[new].tolist(), strict=True)
                    patches = {i: unmerged[w] for i, (a, b) in enumerate(spans) if b - a in odd and (w := data[a:b].tobytes()) in unmerged}
                    for i, value in patches.items():
                        flat[offsets[i]] = -1 - value
                    keep = np.ones(len(flat), bool)
                    for i in patches:
                        keep[offsets[i] + 1 : offsets[i + 1]] = False
                    flat, offsets = flat[keep], np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int32)
                rows = len(chunk.starts)
                words = pa.ListArray.from_arrays(pa.array([0] + [len(new)] * rows, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                cut = np.searchsorted(starts, np.append(chunk.starts, len(data)))
                own = [number[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([fresh] + [False] * (rows - 1)), words, pa.array(own, pa.binary()), *[c[chunk.rows] for c in batch.columns[1:]]], names=["_fresh", "_words", "_numbers", *batch.schema.names[1:]])

    return run


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and decoded bytes of each text from those of its words."""
    ids, decoded = _Spans(np.int32), _Spans(np.uint8)
    for batch in batches:
        fresh = np.flatnonzero(batch.column("_fresh").to_numpy(zero_copy_only=False)).tolist()
        cuts = sorted({0, *fresh, batch.num_rows})
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(begin, end - begin)
            if begin in fresh:
                ids, decoded = _Spans(np.int32), _Spans(np.uint8)
            new_ids, new_bytes = part.column("_ids").flatten(), part.column("_bytes").flatten()
            if len(new_ids):
                ids.add(new_ids.flatten().to_numpy(), pc.list_value_length(new_ids).to_numpy().astype(np.int64))
                flat, bounds = cells(new_bytes)
                decoded.add(flat[bounds[0] : bounds[-1]], np.diff(bounds))
            flat, bounds = cells(part.column("_numbers"))
            flat, bounds = flat[bounds[0] : bounds[-1]].view(np.int32), (bounds - bounds[0]) // 4
            at = 0
            while at < part.num_rows:
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + AT_ONCE, "right")) - 1)
                numbers = flat[bounds[at] : bounds[to]].astype(np.int64)
                last = bounds[at : to + 1] - bounds[at]
                (own, n_ids), (text, n_bytes) = ids.take(numbers), decoded.take(numbers)
                edges = [np.concatenate([[0], np.cumsum(k)])[last].astype(np.int32) for k in (n_ids, n_bytes)]
                tokens = pa.ListArray.from_arrays(pa.array(edges[0]), pa.array(own))
                whole = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(edges[1]), pa.py_buffer(text)])
                yield pa.RecordBatch.from_arrays([*[c.slice(at, to - at) for c in part.columns[4:]], tokens, whole], names=[*batch.schema.names[4:], "ids", "decoded"])
                at = to


def _in_large_tasks(docs: DataFrame) -> DataFrame:
    """``docs`` in tasks of some TASK_BYTES where its scan has smaller ones, in whole rounds of the cluster's cores."""
    spark = docs.sparkSession
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    size = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(split))
    cores, have = max(1, spark.sparkContext.defaultParallelism), docs.rdd.getNumPartitions()
    want = math.ceil(have / max(1, TASK_BYTES // size) / cores) * cores
    return docs.coalesce(want) if want < have else docs


def encode_and_decode(docs: DataFrame, keep: list[str], path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``keep`` columns of ``docs``, ids (array<int>) of the whole text, and decoded (binary): the ids turned back into bytes.

    As the tiktoken library encodes ordinary text: each match of ``pattern`` (default: the public one) by itself, no
    special tokens. Null text counts as empty: no ids, no bytes. A text or word of any length is encoded whole. Repeated rows and null ids are rows like any other; an empty table gives no rows.
    The names of ``keep`` may be any but ids and decoded.
    """
    import public_tokenizers

    if pattern == public_tokenizers.PATTERN:
        pattern = None
    pieces = read_ranks(path)
    ranks = RankMap(pieces)
    # kept columns have numbers inside, so that no name clashes
    rows = _in_large_tasks(docs.select(F.coalesce("text", F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]))
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    names = [f"_k{i}" for i in range(len(keep))]
    words = rows.mapInArrow(tidy(_numbered(pattern, pieces, ranks.unmerged)), ", ".join(["_fresh boolean, _words array<array<int>>, _numbers binary", *kept]))
    coded = words.select("_fresh", "_numbers", ranks.encode(F.col("_words")).alias("_ids"), *names)
    coded = coded.select("_fresh", "_numbers", "_ids", ranks.decode(F.col("_ids")).alias("_bytes"), *names)
    coded = coded.mapInArrow(tidy(_assembled), ", ".join([*kept, "ids array<int>, decoded binary"]))
    return coded.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "ids", "decoded")


def digests(coded: DataFrame) -> list[Column]:
    """Columns n_tokens, ids_sha256 and decoded_sha256 of a result of ``encode_and_decode``."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return [F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return coded.select("doc_id", *digests(coded))
