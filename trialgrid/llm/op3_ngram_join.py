"""Exact Jaccard self-join of documents on word shingles by universe partitioning.

Shingle sets are grouped into size bands. For a band, sets that can reach the threshold differ in at most H tokens, so
if the token universe is cut by hash into more than H segments, two similar sets agree exactly in one segment at least
(pigeonhole); if a segment may differ in one token (a set's one-deletion neighbourhood is indexed beside it), it counts
twice. Both allocations are used:

* small bands: about H / 2 segments, each with its one-deletion neighbourhood;
* larger bands: more than H + 1 segments, so that a set has some to spare. Empty segments cost most (all sets share
  them) and are never indexed; a set left with too few adds its one-deletion neighbourhoods. A segment subset that
  many sets hold (a passage repeated over the corpus) is costly too: a set that has H + 1 others is done without it.
  Only sets that haven't, those of large groups of near copies, stay in such a bucket.

Candidates of small buckets are verified pair by pair. A large bucket has a centre; each set is first verified against
the centres of some of its large buckets. Large buckets whose sets this leaves in different components are verified in
blocks, all against all, without a row per pair.
Verification counts equal shingles, so a link below the threshold can't pass.

Shingles are 64-bit hashes; two given different ones agree with a chance of about 2 ** -64.

Signatures are most of what is shuffled, so each is sent as 32 bits of its hash and 32 bits of its set's id. Either may
agree by chance: that makes candidates more, never fewer, as a short id stands for all sets that have it, and sets that
share one are candidates of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialgrid.llm.components import components
from trialgrid.llm.shared import drop_stored, free_name, partitions, small_or_shuffled, stored, stored_rows, tidy
from trialgrid.llm.textbytes import chunks, mix, shingles

#: Threshold 4 / 5, and the words of a shingle.
SHINGLE = 5
#: Bands widen by (5 / 4) ** 2; up to this many differing tokens a band uses deletion neighbourhoods throughout.
BAND, SMALL_H = 1.5625, 20
#: A bucket of more sets than this isn't expanded into pairs; sets, or tokens, of a block that is verified all against all.
LARGE_BUCKET, BLOCK, BLOCK_TOKENS = 6, 384, 200_000
#: Entries that a task packs before it sends them, bits of a set's sketch at least, shingles of all sets for each part of
#: the signatures at most (a set has about a third as many signatures as shingles).
PACKED, SKETCH_BITS, PART_SHINGLES = 1 << 19, 512, 16 << 20
#: A set that can do without more segments than this counts as one that can do without so many.
MOST_SPARE = (1 << 15) - 1


@lru_cache(maxsize=None)
def _band_edges(most: int) -> tuple[int, ...]:
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return tuple(edges)


@lru_cache(maxsize=None)
def _scheme(low: int, high: int) -> tuple[int, bool, int]:
    """For pairs whose smaller set has low..high-1 tokens: most differing tokens, deletions throughout?, segments."""
    least = high - 1
    h = (least + least * 5 // 4) // 9
    if h <= SMALL_H:
        return h, True, (h + 2) // 2
    m = h + 1
    while True:
        empty = math.exp(-low / m)
        if m * (1 - empty) - 2 * math.sqrt(m * empty * (1 - empty)) >= 1.1 * (h + 1):
            return h, False, m
        m += 1 + m // 64


def _schemes_of(size: int) -> list[tuple[int, int, bool, int]]:
    """The schemes that a set of this size takes part in: (low edge, H for this size, deletions throughout?, segments)."""
    edges, least = _band_edges(size), -(-4 * size // 5)
    out = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        if low <= size and high - 1 >= least:
            _, small, m = _scheme(low, high)
            partner = size * 5 // 4 if size < high else high - 1  # the largest, or the smaller one, that it can meet here
            out.append((low, (size + partner) // 9, small, m))
    return out


def _signatures(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sets tokens[bounds[i]:bounds[i+1]] (sorted, distinct): signatures, their sets' numbers, and for each set
    how many segments it can do without, less one, -1 if none (over its schemes, as scheme-less minimum)."""
    sizes = np.diff(bounds)
    spare = np.full(len(sizes), np.iinfo(np.int32).max, np.int64)
    by: dict[tuple[int, bool, int], list[tuple[int, int]]] = {}
    for i, size in enumerate(sizes.tolist()):
        if size:
            for low, h, small, m in _schemes_of(size):
                by.setdefault((low, small, m), []).append((i, h))
    sigs, owners = [], []
    for (low, small, m), members in by.items():
        who = np.array([i for i, _ in members])
        need = np.array([h + 1 for _, h in members])
        n = sizes[who]
        at = np.repeat(bounds[who] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        own = tokens[at]
        row = np.repeat(np.arange(len(who)), n)
        # tokens are sorted, so a segment is a range of the hash space
        segment = ((own >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        key = row * m + segment.astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        mixed = mix(own ^ np.uint64(0x51ED270B0A1F39C1))
        sums = np.add.reduceat(mixed, first)
        count = np.diff(np.append(first, len(key)))
        kind = mix(np.arange(m, dtype=np.uint64) + np.uint64(low << 24))  # a segment of a scheme
        seg_row, seg_no = key[first] // m, key[first] % m
        sigs.append(mix(sums + kind[seg_no]))
        owners.append(who[seg_row])
        filled = np.bincount(seg_row, minlength=len(who))
        left = filled - need
        np.minimum.at(spare, who, np.where(left < 0, -1, left) if not small else -1)
        if small:
            gone = np.ones(len(who) * m, bool)
            gone[key[first]] = False
            gone = np.flatnonzero(gone)
            sigs.append(mix(kind[gone % m]))  # an empty segment
            owners.append(who[gone // m])
            drop = np.ones(len(key), bool)
        else:
            drop = np.repeat((left < 0)[seg_row], count) & np.repeat(count >= 2, count)
            if (poor := np.flatnonzero((left < 0) & (filled + np.bincount(seg_row, count >= 2, len(who)) < need))).size:
                gone = np.ones((len(who), m), bool)
                gone[seg_row, seg_no] = False
                a, b = np.nonzero(gone[poor])
                sigs.append(mix(kind[b]))
                owners.append(who[poor[a]])
                drop |= np.isin(row, poor)
        if drop.any():
            rest = np.repeat(sums, count)[drop] - mixed[drop]
            sigs.append(mix(rest + kind[np.repeat(seg_no, count)[drop]]))
            owners.append(who[row[drop]])
    empty = np.zeros(0, np.uint64)
    return np.concatenate(sigs) if sigs else empty, np.concatenate(owners) if owners else empty.astype(np.int64), spare


def _set_ids(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, as a signed number."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _short(set_id: str) -> Column:
    """The 32 bits of a set's id that go with its signatures."""
    return F.col(set_id).bitwiseAND(F.lit(0xFFFFFFFF))


def _sketches(tokens: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """Parity of the tokens that fall on each bit, as 64-bit numbers. Two sets' sketches differ in at most as many bits as
    the sets differ in tokens, so sketches can rule a pair out for certain. Their length is SKETCH_BITS, doubled until
    it is 0.64 times the set's size; a sketch folds to half its length by exclusive or of its halves."""
    size = np.diff(bounds)
    bits = SKETCH_BITS << np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) * 0.64 / SKETCH_BITS))).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    at = np.repeat(base[:-1], size) + (tokens & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array((base // 64).astype(np.int32)), pa.array(np.packbits(odd).view(np.int64)))


def _folded(sketch: str, other: str) -> Column:
    """``sketch``, folded once if it is longer than ``other``. Sizes that can be similar differ by one doubling at most."""
    half = (F.size(sketch) / 2).cast("int")
    return F.when(F.size(sketch) > F.size(other), F.zip_with(F.slice(sketch, 1, half), F.slice(sketch, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(sketch))


def _document_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            tokens, bounds = shingles(chunk, SHINGLE)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[chunk.rows], pa.array(np.diff(bounds)), pa.array(_set_ids(tokens, bounds)), _sketches(tokens, bounds)], names=["doc_id", "n_shingles", "set_id", "sketch"])


def _packed_signatures(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            sig, own, spare = (np.concatenate(x) for x in zip(*held, strict=True))
            part = (sig >> np.uint64(40)) % np.uint64(n_parts)
            order = np.argsort(part, kind="stable")
            sig, own, spare, part = sig[order], own[order], spare[order], part[order]
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            end = np.append(cut[1:], len(part))
            rows = [(int(part[a]), sig[a:b].astype(np.uint32).tobytes(), own[a:b].tobytes(), spare[a:b].tobytes()) for a, b in zip(cut, end, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "sig", "own", "spare"])

        for batch in batches:
            for chunk in chunks(batch.column("text")):
                tokens, bounds = shingles(chunk, SHINGLE)
                ids = _set_ids(tokens, bounds)
                _, once = np.unique(ids, return_index=True)  # copies within the chunk count once
                once.sort()
                sizes = np.diff(bounds)[once]
                at = np.repeat(bounds[once] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                sig, owner, spare = _signatures(tokens[at], np.concatenate([[0], np.cumsum(sizes)]))
                # signatures of a set that agree in their short forms will count once: it can do without so many less
                short = np.sort(owner.astype(np.uint64) << np.uint64(32) | sig & np.uint64(0xFFFFFFFF))
                met = np.bincount((short[1:][short[1:] == short[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(once))
                spare = np.maximum(np.minimum(spare, MOST_SPARE) - met, -1).astype(np.int16)
                held.append((sig, ids[once].view(np.uint64).astype(np.uint32)[owner], spare[owner]))
                n += len(sig)
                if n >= PACKED:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


_FOUND = "kind int, a long, b long, n int, members binary"


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets that share a signature, by short ids: kind 0, pairs a, b of small buckets; kind 1, a large bucket's members,
    with n signatures; kind 2, sets a are in n large buckets and can do without b."""
    parts: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            parts.setdefault(row["part"], []).append((np.frombuffer(row["sig"], np.uint32), np.frombuffer(row["own"], np.uint32), np.frombuffer(row["spare"], np.int16)))
    while parts:
        sig, own, spare = (np.concatenate(x) for x in zip(*parts.popitem()[1], strict=True))
        both = sig.astype(np.uint64) << np.uint64(32) | own
        order = np.argsort(both)
        both, spare = both[order], spare[order]
        twice = np.zeros(len(both), bool)
        same = both[1:] >> np.uint64(32) == both[:-1] >> np.uint64(32)
        twice[1:] |= same
        twice[:-1] |= same
        both, spare = both[twice], spare[twice]  # signatures of one set only are done
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, int)
        spare = np.minimum.reduceat(spare, new) if len(new) else spare
        sig, own = (both[new] >> np.uint64(32)).astype(np.uint32), both[new].astype(np.uint32)
        cut = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, int)
        size = np.diff(np.append(cut, len(sig)))
        pairs = []
        for k in range(2, LARGE_BUCKET + 1):
            at = cut[size == k]
            for i in range(k):
                for j in range(i + 1, k):
                    pairs.append(np.stack([own[at + i], own[at + j]], 1))
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.uint32)
        lists: dict[bytes, int] = {}
        often: list[np.ndarray] = []
        for a, k in zip(cut[size > LARGE_BUCKET].tolist(), size[size > LARGE_BUCKET].tolist(), strict=True):
            members = own[a : a + k].tobytes()
            lists[members] = lists.get(members, 0) + 1
            often.append(np.arange(a, a + k))
        if len(pairs):
            yield _found(0, a=pairs[:, 0], b=pairs[:, 1])
        if lists:
            yield _found(1, n=list(lists.values()), members=list(lists))
            at = np.concatenate(often)
            who, which, n = np.unique(own[at], return_inverse=True, return_counts=True)
            least = np.full(len(who), MOST_SPARE, np.int16)
            np.minimum.at(least, which, spare[at])
            yield _found(2, a=who, n=n, b=least)


def _found(kind: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    types = {"a": pa.int64(), "b": pa.int64(), "n": pa.int32(), "members": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *[pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()]], names=["kind", *types])


def _list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for members in batch.column("members").to_pylist():
            own = np.frombuffer(members, np.uint32)
            name = int(mix(own.astype(np.uint64)).sum(dtype=np.uint64).view(np.int64)) if len(own) else 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), name)), pa.array(np.full(len(own), len(own))), pa.array(own.astype(np.int64))], names=["list", "size", "short"])


def _wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The token sets of wanted documents."""
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            tokens, bounds = shingles(chunk, SHINGLE)
            blobs = [tokens[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(_set_ids(tokens, bounds)), pa.array(np.diff(bounds)), pa.array(blobs, pa.binary())], names=["set_id", "n", "tokens"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose token sets reach the threshold, from rows a, ta, b, tb."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
            both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
            both.sort(kind="stable")
            inner = int((both[1:] == both[:-1]).sum())
            keep.append(100 * inner >= 80 * (len(both) - inner))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from incidence matrices over the tokens that occur on both sides, in slices."""
    fx, fy = np.concatenate(x), np.concatenate(y)
    rx, ry = np.repeat(np.arange(len(x)), [len(t) for t in x]), np.repeat(np.arange(len(y)), [len(t) for t in y])
    common = np.intersect1d(fx, fy)
    out = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(common), 8192):
        part = common[at : at + 8192]
        sides = []
        for flat, row, n in ((fx, rx, len(x)), (fy, ry, len(y))):
            col = np.searchsorted(part, flat)
            col[col == len(part)] = 0
            hit = part[col] == flat
            m = np.zeros((n, len(part)), np.float32)
            m[row[hit], col[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _forest(left: np.ndarray, right: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all links connect: for each left one its first partner, and what joins those."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (p := root.setdefault(v, v)) != v:
            root[v] = root[p]
            v = p
        return v

    out = []
    for i, j in np.argwhere(hit).tolist():
        a, b = find(int(left[i])), find(int(right[j]))
        if a != b:
            root[a] = b
            out.append((int(left[i]), int(right[j])))
    return out


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of sets, or within one, as a spanning forest. Rows: two blocks' ids and packed sets."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            ids, sets = [], []
            for side in ("x", "y"):
                ids.append(np.array([s["set_id"] for s in row[side]], np.int64))
                sets.append([np.frombuffer(s["tokens"], np.uint64) for s in row[side]])
            inner = _overlaps(*sets)
            n = np.array([len(t) for t in sets[0]])[:, None] + np.array([len(t) for t in sets[1]])[None, :]
            out += _forest(*ids, (100 * inner >= 80 * (n - inner)) & (ids[0][:, None] != ids[1][None, :]))
        ab = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])


def similar_components(docs: DataFrame) -> DataFrame:
    """Component of each document under Jaccard >= 0.8 of 5-word shingle sets: doc_id, n_shingles, component_id, set_id.

    One row per row of ``docs``; copies share a set, which takes part once. Null text counts as empty; a document
    without words links with nothing (component: itself). Rows with a null doc_id are kept with a null component; a text
    that only they have links with nothing. Rows of a repeated doc_id are rows of their own. More columns of ``docs``
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sets = stored(text.mapInArrow(tidy(_document_sets), "doc_id long, n_shingles long, set_id long, sketch array<long>"))
    shingles_ = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    n_parts = max(partitions(spark), -(-shingles_ // PART_SHINGLES))
    # one row a set with a document's id: copies are met here once, summed in each task first
    every = stored(sets.where("doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("n"), F.any_value("sketch").alias("sketch")))
    packed = text.select("text").mapInArrow(tidy(_packed_signatures(n_parts)), "part int, sig binary, own binary, spare binary")
    found = stored(packed.repartition(n_parts, "part").mapInArrow(tidy(_buckets), _FOUND))
    pairs = found.where("kind = 0").select("a", "b")
    # a set in more large buckets than it can do without stays in them
    inside = found.where("kind = 2").groupBy(F.col("a").alias("short")).agg(F.sum("n").alias("n"), F.min("b").alias("spare")).where("n > spare").select("short", "n")
    inside = inside.join(every.select(_short("set_id").alias("short"), "set_id"), "short")
    lists = found.where("kind = 1").mapInArrow(tidy(_list_members), "list long, size long, short long").distinct()
    lists = stored(lists.join(inside, "short").drop("short"))
    centre = lists.groupBy("list").agg(F.max(F.struct("n", "set_id"))["set_id"].alias("centre"))
    # a set meets the centres of four of its large buckets at most, whatever their number: centres repeat, and the
    # buckets that stay open are verified below
    size = F.struct("size", "list")
    some = lists.groupBy("set_id").agg(F.array_distinct(F.array(F.max(size)["list"], F.min(size)["list"], F.max("list"), F.min("list"))).alias("list"))
    stars = some.select("set_id", F.explode("list").alias("list"))
    stars = stars.join(centre, "list").where("set_id != centre").select(_short("set_id").alias("a"), _short("centre").alias("b"))
    # sets with one short id are one in the buckets, so they meet here
    twins = every.groupBy(_short("set_id").alias("a")).count().where("count > 1").select("a", F.col("a").alias("b"))
    pairs = stored(pairs.union(stars).union(twins).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    drop_stored(found)

    # sizes and sketches alone rule most false pairs out before any set moves; a short id stands for all sets that have it
    ends = pairs.select(F.col("a").alias("short")).union(pairs.select("b")).distinct()
    known = stored(every.withColumn("short", _short("set_id")).join(ends, "short"))
    x = known.select(F.col("short").alias("a"), F.col("set_id").alias("p"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    y = known.select(F.col("short").alias("b"), F.col("set_id").alias("q"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    apart = F.aggregate(F.zip_with(_folded("sa", "sb"), _folded("sb", "sa"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, k: total + k)
    near = pairs.join(x, "a").join(y, "b").where("a != b or p < q").where("5 * least(na, nb) >= 4 * greatest(na, nb)").where(apart * 9 <= F.col("na") + F.col("nb"))
    near = stored(near.select(F.col("p").alias("a"), F.col("q").alias("b")), most=stored_rows(pairs))
    drop_stored(pairs)

    # the token sets that verification needs, each from one of its documents
    ends = near.select(F.col("a").alias("set_id")).union(near.select("b")).union(lists.select("set_id")).distinct()
    wanted = stored(known.join(ends, "set_id").select("doc_id"), most=stored_rows(known))
    drop_stored(known)
    one = text.join(small_or_shuffled(wanted, stored_rows(wanted)), "doc_id")
    tokens = stored(one.select("text").mapInArrow(tidy(_wanted_sets), "set_id long, n long, tokens binary"))
    x, y = tokens.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta")), tokens.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb"))
    links = stored(near.join(x, "a").join(y, "b").select("a", "ta", "b", "tb").mapInArrow(tidy(_similar), "a long, b long"))
    drop_stored(wanted)
    drop_stored(near)
    group = components(links, stored_rows(links))

    # large buckets whose sets are still in different components: all of their cluster against each other, in blocks
    rest = lists.join(group.toDF("set_id", "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    open_ = rest.groupBy("list").agg(F.min("root").alias("r"), F.max("root").alias("q")).where("r != q").select("list")
    rest = stored(rest.join(open_, "list").select("list", "set_id", "root"), most=stored_rows(lists))
    if n := stored_rows(rest):
        cluster = components(rest.join(centre, "list").select(F.col("set_id").alias("a"), F.col("centre").alias("b")), n)
        rest_sets = stored(rest.select("set_id", "root").distinct().join(cluster.toDF("set_id", "cluster"), "set_id"), most=n)
        # the links found before are in ``group``: a node and its root
        more = stored(_verified_blocks(rest_sets, tokens))
        group = components(group.toDF("a", "b").union(more), stored_rows(group) + stored_rows(more))

    root = every.select("set_id", "doc_id", "n").join(group.toDF("set_id", "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = root.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    least = stored(root.join(least, "root").select("set_id", "least"), most=stored_rows(every))
    drop_stored(tokens)
    drop_stored(every)
    out = sets.drop("sketch").join(least, "set_id", "left")  # both sides stored: Spark may split a set with very many documents
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "set_id")


def _verified_blocks(members: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links among the sets of each cluster, less those inside a component found already. ``members``: set_id, root, cluster.

    A component's sets fill blocks of their own where they are many, so that two blocks of one component needn't meet.
    """
    size = members.groupBy("cluster", "root").agg(F.count("*").alias("k")).withColumn("own", F.col("k") >= BLOCK // 4)
    parts = members.join(size, ["cluster", "root"]).withColumn("side", F.when(F.col("own"), F.col("root")).otherwise(F.lit(0)))
    parts = parts.join(tokens.select("set_id", "n"), "set_id")
    total = parts.groupBy("cluster", "side").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_TOKENS))).cast("int").alias("blocks"))
    parts = parts.join(total, ["cluster", "side"]).withColumn("block", F.pmod(F.xxhash64(F.lit(5), "set_id"), F.col("blocks")).cast("int"))
    packed = parts.join(tokens.select("set_id", "tokens"), "set_id").groupBy("cluster", "side", "own", "block").agg(F.collect_list(F.struct("set_id", "tokens")).alias("sets"))
    packed = stored(packed.withColumn("key", F.struct("side", "own", "block")))
    x, y = packed.select("cluster", F.col("key").alias("kx"), F.col("sets").alias("x")), packed.select("cluster", F.col("key").alias("ky"), F.col("sets").alias("y"))
    names = packed.select("cluster", "key")
    meet = names.toDF("cluster", "kx").join(names.toDF("cluster", "ky"), "cluster").where("kx <= ky and not (kx.own and ky.own and kx.side = ky.side)")
    return meet.repartition(partitions(members.sparkSession), "cluster", "kx", "ky").join(x, ["cluster", "kx"]).join(y, ["cluster", "ky"]).select("x", "y").mapInArrow(tidy(_block_links), "a long, b long")


def _with_set_id(schema_names: list[str], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                ids = _set_ids(*shingles(chunk, SHINGLE))
                yield pa.RecordBatch.from_arrays([*[c[chunk.rows] for c in batch.columns], pa.array(ids)], names=[*schema_names, name])

    return run


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with the smallest doc_id of each component, with all their columns; rows without a doc_id stay.

    A row goes if its own set's component has a smaller doc_id; of rows with one doc_id and one component, that with the
    least set stays, once.
    """
    found = stored(similar_components(docs).where("doc_id is not null and n_shingles > 0"))
    gone = found.where("doc_id != component_id").select("doc_id", "set_id").distinct()
    if not found.groupBy("doc_id").count().where("count > 1").limit(1).count():
        gone = stored(gone.select("doc_id"))  # a doc_id is one row: its set needn't be found again
        return docs.join(small_or_shuffled(gone, stored_rows(gone)), "doc_id", "left_anti").select(*docs.columns)
    set_id, rank = free_name(docs, "set_id", "rank")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], f"`{set_id}` long"])
    rows = docs.mapInArrow(tidy(_with_set_id(docs.columns, set_id)), schema)
    gone = stored(gone.toDF("doc_id", set_id))
    rows = rows.join(small_or_shuffled(gone, stored_rows(gone)), ["doc_id", set_id], "left_anti")
    # of equal doc_ids in one component only the least set stays, and of its rows one
    mine = found.where("doc_id = component_id").groupBy("doc_id", "component_id").agg(F.min("set_id").alias("least")).select("doc_id", "least")
    rows = rows.join(mine, "doc_id", "left")
    keep = F.col("doc_id").isNull() | F.col("least").isNull() | (F.col("least") == F.col(set_id))
    rows = rows.where(keep)
    one = Window.partitionBy("doc_id", set_id).orderBy(F.xxhash64(*[c for c in docs.columns if c != "doc_id"]))
    alone = rows.where(F.col("doc_id").isNotNull()).withColumn(rank, F.row_number().over(one)).where((F.col(rank) == 1) | F.col("least").isNull())
    return alone.select(*docs.columns).union(rows.where("doc_id is null").select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("set_id")
