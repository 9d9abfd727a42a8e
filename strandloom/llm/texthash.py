"""Vectorised word and shingle hashes over Arrow string columns.

Words are runs of bytes other than blank and 0x09-0x0D, after lower-casing A-Z.  A word's
hash is a 64-bit sum of random byte values times random weights, one for each place in the
word (so that no pattern of bytes makes two words meet, as it does with powers of one base),
taken from prefix sums over the whole buffer: its cost is a few array passes, not one call a
word.  Where the identity of words matters, ``exact_groups`` and ``same_bytes`` compare the
bytes of words of one hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at a time.
SLICE_BYTES = 1_000_000

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, (1 << 64) - 1, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SEP = np.zeros(256, bool)
_SEP[[32, *range(9, 14)]] = True
_ORDER = _rng.integers(1, 1 << 63, 6, dtype=np.uint64) * U(2) + U(1)
_places = [np.zeros(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _weights(n: int) -> np.ndarray:
    """Random weights of the first n places of a word, the same in every process."""
    if len(_places[0]) < n:
        _places[0] = mix((np.arange(max(n, 2 * len(_places[0]), 1024), dtype=np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))
    return _places[0]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column, null as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right"))
        to = min(n, max(at + 1, to - 1))
        yield at, to
        at = to


def joined(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the spans' elements, one span after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as an Arrow column, A-Z in lower case."""
    size = end - start
    flat = _LOWER[data[joined(start, size)]]
    offsets = np.concatenate([[0], np.cumsum(size)])
    if len(flat) < 1 << 31:
        return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat))
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(flat))


def span_hashes(part: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, the same wherever it lies; A-Z count as a-z.  Spans are in
    order and do not overlap."""
    n = len(part)
    if not len(start):
        return np.zeros(0, np.uint64)
    place = np.zeros(n, np.int64)
    place[start[start < n]] = start[start < n]
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(n), place, out=place)
    # bytes between spans have a place too, which may be high: any weight will do for them
    longest = int((end - start).max())
    np.minimum(place, max(longest - 1, 0), out=place)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[part] * _weights(longest)[place], out=sums[1:])
    return mix(sums[end] - sums[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def _eight(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes (fewer if ``left`` is less) from each place, in lower case."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        on = np.flatnonzero(left > k)
        if not len(on):
            break
        out[on] |= _LOWER[data[at[on] + k]].astype(np.uint64) << U(8 * k)
    return out


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, o_start: np.ndarray, o_end: np.ndarray) -> np.ndarray:
    """Whether each span of ``data`` has the bytes of its span of ``other``; A-Z count as a-z."""
    size = end - start
    same = size == o_end - o_start
    at, step = np.flatnonzero(same), 0
    while len(at):
        if step == 256:  # few words are as long: compare them whole
            for i in at:
                a, b = data[start[i] + step : end[i]], other[o_start[i] + step : o_end[i]]
                same[i] = bool((_LOWER[a] == _LOWER[b]).all())
            break
        left = size[at] - step
        same[at] &= _eight(data, start[at] + step, left) == _eight(other, o_start[at] + step, left)
        at, step = at[same[at] & (left > 8)], step + 8
    return same


def exact_groups(h: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, inverse) of spans that are equal byte by byte (A-Z as a-z): the first span of each
    group, in order of hashes, and each span's group.  ``h`` are hashes of the spans."""
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    own = first[inverse]
    rest = np.flatnonzero(own != np.arange(len(h)))
    wrong = rest[~same_bytes(data, start[rest], end[rest], data, start[own[rest]], end[own[rest]])]
    if len(wrong):
        more: dict[bytes, int] = {}
        for i in wrong:
            inverse[i] = more.setdefault(_LOWER[data[start[i] : end[i]]].tobytes(), len(first) + len(more))
        firsts = np.full(len(more), len(h), np.int64)
        np.minimum.at(firsts, inverse[wrong] - len(first), wrong)
        first = np.concatenate([first, firsts])
    return first, inverse


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of every word; start and end index ``data``."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    part = data[lo:hi]
    n = len(part)
    if not n:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    word = ~_SEP[part]
    edges = (offsets - lo).astype(np.int64)
    first = np.zeros(n + 1, bool)
    first[edges] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:n]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    h = span_hashes(part, start, end)
    row = np.searchsorted(edges, start, "right") - 1
    return h, row, start + lo, end + lo


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes: runs of ``size`` words, or the whole
    sequence as one where there are fewer; empty without words."""
    h, row, _, _ = words(offsets, data)
    n = len(offsets) - 1
    counts = np.bincount(row, minlength=n)
    at = np.concatenate([[0], np.cumsum(counts)])
    runs = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        runs += h[k : k + len(runs)] * _ORDER[k]
    runs = mix(runs)
    out = []
    for i in range(n):
        a, m = at[i], counts[i]
        if m >= size:
            out.append(np.unique(runs[a : a + m - size + 1]))
        elif m:
            out.append(mix((h[a : a + m] * _ORDER[:m]).sum(keepdims=True) + np.full(1, m, np.uint64) * _ORDER[5]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
