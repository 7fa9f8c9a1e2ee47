"""Whole texts as flat byte arrays: numpy helpers that run inside Spark tasks, on bounded chunks of an Arrow batch.

A chunk joins some whole texts with a newline after each. A text longer than the chunk size is a chunk of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

#: ASCII white space, A-Z lower-casing, and bytes that begin a code point.
IS_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BEGINS = (np.arange(256) & 0xC0) != 0x80

#: Spans over this many bytes are hashed one by one.
LONG_SPAN = 256
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@dataclass
class Chunk:
    rows: slice  # of the batch
    data: np.ndarray  # uint8, lower-cased A-Z
    starts: np.ndarray  # of each text
    ends: np.ndarray  # data[ends[i]] is the newline after text i


def cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column, without copying. A null has no bytes."""
    column = column.cast(pa.binary()) if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else column.cast(pa.large_binary())
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets.astype(np.int64)


def chunks(texts: pa.Array, lower: bool = True, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a batch's texts (null: empty) into chunks."""
    data, offsets = cells(texts.fill_null("") if texts.null_count else texts)
    at = 0
    while at < len(texts):
        # text i and its newline end at offsets[i + 1] + i + 1
        to = max(at + 1, int(np.searchsorted(offsets[1:] + np.arange(1, len(offsets)), offsets[at] + at + most, "right")))
        ends = offsets[at + 1 : to + 1] - offsets[at] + np.arange(to - at)
        own = np.full(offsets[to] - offsets[at] + to - at, 10, np.uint8)
        if to - at == 1:
            own[:-1] = data[offsets[at] : offsets[to]]
        else:
            rest = np.ones(len(own), bool)
            rest[ends] = False
            own[rest] = data[offsets[at] : offsets[to]]
        yield Chunk(slice(at, to), LOWER[own] if lower else own, np.concatenate([[0], ends[:-1] + 1]), ends)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lengths[i] - 1, one span after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes; equal bytes give equal hashes wherever they stand.

    A chain over blocks of 8 bytes that mixes all bits after each, for long spans BLAKE2. Neither is linear in the bytes,
    so no family of texts collides by its form; two given different spans agree with a chance of about 2 ** -64.
    """
    n = (ends - starts).astype(np.int64)
    out = mix(n.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 ^ seed))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    live = np.flatnonzero((n > 0) & (n <= LONG_SPAN))
    at, left, own = starts[live], n[live], out[live]
    while len(live):
        own = mix(own ^ (blocks[at] & _LOW_BYTES[np.minimum(left, 8)]))
        on = left > 8
        out[live[~on]] = own[~on]
        live, at, left, own = live[on], at[on] + 8, left[on] - 8, own[on]
    for i in np.flatnonzero(n > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def word_spans(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a chunk, and at [i]:[i+1] the words of its text i."""
    space = IS_SPACE[chunk.data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]  # the chunk ends in a newline, so every word ends
    bounds = np.append(np.searchsorted(starts, chunk.starts), len(starts))
    return starts, ends, bounds


def shingles(chunk: Chunk, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text, one after the other, and their bounds.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    starts, ends, bounds = word_spans(chunk)
    words = span_hashes(chunk.data, starts, ends)
    n = np.diff(bounds)
    full = np.zeros(0, np.uint64)
    if len(words) >= k:
        full = words[: len(words) - k + 1].copy()
        for j in range(1, k):
            full *= np.uint64(0xD6E8FEB86659FD93)
            full += words[j : len(words) - k + 1 + j]
        full = mix(full)
    out, sizes = [], np.zeros(len(n), np.int64)
    for i, (at, m) in enumerate(zip(bounds[:-1].tolist(), n.tolist(), strict=True)):
        if m >= k:
            own = np.sort(full[at : at + m - k + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif m:
            value = m  # the number of words, so that it can't equal a full shingle's hash but by chance
            for w in words[at : at + m].tolist():
                value = (value * 0xA0761D6478BD642F + w) % (1 << 64)
            own = mix(np.array([value], np.uint64))
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])
