"""Vectorised word scanning and hashing over the raw UTF-8 of Arrow string columns.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]``.  Every separator is a single
ASCII byte, so cutting the UTF-8 bytes gives the same words as cutting the text.
Null texts count as empty.  Nothing here copies a text more than once, and the
temporary arrays are bounded by ``SEGMENT`` bytes (or by the longest single word).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text hashed at once.
SEGMENT = 1 << 18
#: Bytes of text that an operator takes from an Arrow batch at once.
SLICE_BYTES = 2 << 20

_MASK = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def as_binary(column: pa.Array) -> pa.Array:
    """The column as 32-bit-offset binary, nulls as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.binary())
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.string() if pa.types.is_large_string(column.type) else pa.binary())
    if column.type != pa.binary():
        column = column.cast(pa.binary())
    return pc.fill_null(column, b"") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the concatenated bytes and n + 1 offsets that start at 0."""
    column = as_binary(column)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batch with about ``limit`` bytes of text, one row at least."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words; ``first[d]`` is the index of document d's first word."""
    word = ~SEPARATOR[data]
    before = np.empty_like(word)
    after = np.empty_like(word)
    if len(word):
        before[0] = False
        before[1:] = word[:-1]
        after[-1] = False
        after[:-1] = word[1:]
        inner = offs[1:-1]
        inner = inner[(inner > 0) & (inner < len(word))]
        before[inner] = False
        after[inner - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat, at): all words joined by one space, one more space at the end, and where each word starts in it."""
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - (sizes + 1)
    flat = np.full(int(at[-1] + sizes[-1] + 1) if len(at) else 0, 0x20, np.uint8)
    is_word = np.ones(len(flat), bool)
    is_word[at + sizes] = False
    flat[is_word] = data[~SEPARATOR[data]]
    return flat, at


def digests(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, 2) 64-bit halves of the 128-bit BLAKE2b digest of each span."""
    view, out = memoryview(flat), np.empty((len(begin), 2), np.uint64)
    for i in range(0, len(begin), 1 << 16):
        spans = zip(begin[i : i + (1 << 16)].tolist(), end[i : i + (1 << 16)].tolist())
        part = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in spans])
        out[i : i + (1 << 16)] = np.frombuffer(part, "<u8").reshape(-1, 2)
    return out


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n."""
    have = _tables.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(12, int(n + 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0] = 1
            k = 1
            while k < size:  # doubling: p[k:2k] = p[:k] * b**k
                p[k : 2 * k] = p[:k] * np.uint64(pow(b, k, 1 << 64))
                k *= 2
            out.append(p)
        have = _tables[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that sums of hashes have no structure left."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, side="right")))
        base, top = int(starts[i]), int(ends[j - 1])
        power, inverse = powers(_BASES[0], top - base)
        sums = np.empty(top - base + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data[base:top].astype(np.uint64) + np.uint64(1)) * power[: top - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


def hash_windows(words: np.ndarray, width: int, which: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` words; ``which`` (1 or 2) picks independent hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(_BASES[which], len(words))
    sums = np.empty(len(words) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(mix(words + np.uint64(_BASES[which - 1])) * power[: len(words)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * inverse[:n])
