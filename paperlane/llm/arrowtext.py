"""Array arithmetic over the bytes of Arrow string columns, for use inside Spark tasks.

A word is a run of bytes other than space and TAB..CR, A-Z lower-cased; all functions take the
flat UTF-8 buffer of a few rows and the rows' offsets. Rows are taken in slices of some megabytes,
so that the temporary arrays stay small whatever the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, np.uint64), np.ones(0, np.uint64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64) of a string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()) if col.type not in (pa.large_string(), pa.large_binary()) else col
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    if len(offs) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(buf: np.ndarray, offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes (or one row), with their bytes and offsets."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers = both[0], both[1]
    return _powers


def spans_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over random byte values, then mixed with the length."""
    n = len(buf)
    power, inverse = _pow(max(n, SLICE_BYTES) + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[buf] * power[:n], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _MULT)


def word_spans(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the index of its first word (one more at the end). ``space`` marks the bytes between words."""
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~space[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offs[(offs > 0) & (offs < len(buf))]  # words never cross rows
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offs)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and the index of each row's first word."""
    low = LOWER[buf]
    start, end, at = word_spans(low, offs)
    return spans_hash(low, start, end), at


def shingles(word: np.ndarray, at: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; with 1..k-1 words one of all of them."""
    n = len(word)
    h = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        h = h * _MULT + word[j : j + len(h)]
    h = mix(h)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            s = np.sort(h[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            one = np.zeros(1, np.uint64)
            for w in word[a:b]:
                one = one * _MULT + w
            out.append(mix(one + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def binaries(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """An Arrow binary array of consecutive pieces of ``data``; ``offs`` counts its items. One array holds 2 GiB at most."""
    data = np.ascontiguousarray(data)
    if len(offs) and int(offs[-1]) * data.itemsize >= 1 << 31:
        raise OverflowError("a group's rows exceed 2 GiB; deal them into more groups")
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((offs * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces data[start:start+size] one after another, and their offsets."""
    offset = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    return data[np.repeat(start - offset[:-1], size) + np.arange(offset[-1])], offset


def distinct_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of every distinct byte span, and for each span the number of its own one there. Hashes only propose; bytes decide."""
    _, where, back = np.unique(spans_hash(buf, start, end), return_index=True, return_inverse=True)
    size, mate = end - start, where[back]
    if (size == size[mate]).all() and (gathered(buf, start, size)[0] == gathered(buf, start[mate], size)[0]).all():
        return where, back
    raw, known, where, back = buf.tobytes(), {}, [], []  # two spans share a hash
    for i, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
        k = known.setdefault(raw[a:b], len(known))
        if k == len(where):
            where.append(i)
        back.append(k)
    return np.array(where, np.int64), np.array(back, np.int64)


def scatter(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts items by bucket, and each bucket's offset in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=n))))
