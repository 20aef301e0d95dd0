"""Vectorised byte kernels over Arrow string columns.

Every function works on one *slice*: the UTF-8 bytes of some consecutive
texts of an Arrow batch, with the offsets at which each text begins and ends.
Slices are cut by size, so a batch of very long texts does not multiply the
memory of a task; a text longer than the limit is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Small enough that a slice's arrays stay in a core's cache.
SLICE_BYTES = 1 << 18
SLICE_TEXTS = 1 << 14

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


class Slice(NamedTuple):
    """Texts ``first`` .. ``first + len(offsets) - 2`` of a batch."""

    first: int
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than there are texts


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of at most ``limit`` bytes and ``SLICE_TEXTS`` texts; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, i + SLICE_TEXTS, max(i + 1, j))
        yield Slice(i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = np.asarray(x, dtype=_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(_BASE)) | _U(1)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
        if size > 4 * SLICE_BYTES:  # not kept: one very long text
            return _powers.pop("up"), _powers.pop("down")
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums of the bytes, and the powers that undo a shift."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_byte_values()[data] * up[: len(data)], out=sums[1:])
    return sums, down


def range_hash(hashed: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end), which may overlap: equal
    bytes, equal hashes. Being polynomials, they collide on texts made for it,
    so they only bring together what is compared later."""
    sums, down = hashed
    return mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(_U))


#: Places in a word that have a table of their own.
_PLACES = 64


@lru_cache(maxsize=1)
def _place_values() -> np.ndarray:
    """A random value for each byte at each of the first places of a word."""
    return mix(np.arange(1, _PLACES * 256 + 1, dtype=_U) * _U(_BASE))


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges that do not overlap and stand in order.

    Each byte at each place adds a value of its own, so that no structure of
    the words makes hashes collide.
    """
    if not len(starts):
        return np.zeros(0, dtype=_U)
    place = np.zeros(len(data), dtype=np.int64)
    place[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(place)
    spot = (place << 8) | data
    values = np.zeros(len(data) + 1, dtype=_U)
    values[:-1] = _place_values()[np.minimum(spot, _PLACES * 256 - 1)]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        values[far] = mix((spot[far] + 1).astype(_U) * _U(_BASE))
    edges = np.empty(2 * len(starts), dtype=np.int64)
    edges[::2], edges[1::2] = starts, ends
    return mix(np.add.reduceat(values, edges)[::2] ^ (ends - starts).astype(_U))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Bytes of words that end at ASCII white space.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words of letters, digits and everything beyond ASCII, after lower-casing.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text where its words begin
    in these arrays (one more entry than texts). No word spans two texts."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = table[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def window_hash(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hashes of all runs of ``size`` entries."""
    count = len(word_hashes) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=_U)
    total = np.zeros(count, dtype=_U)
    for k in range(size):
        total *= _U(_BASE)
        total += word_hashes[k : k + count]
    return mix(total ^ _U(size))


def window_owner(first: np.ndarray, size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the windows of ``size`` words that stay in one text, and
    the number of that text, given where each text's words begin."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(max(0, count - size + 1))
    fits = text[at] == text[at + size - 1] if len(at) else np.zeros(0, dtype=bool)
    at = at[fits]
    return at, text[at]


def shingles(part: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every run of ``size`` words (ended by white
    space, A-Z lower-cased). Fewer words than that, but not none, are one run."""
    data = lower_ascii(part.data)
    starts, ends, first = words(data, part.offsets, NOT_SPACE)
    hashes = word_hash(data, starts, ends)
    runs = window_hash(hashes, size)
    at, text = window_owner(first, size, len(hashes))
    n = np.diff(first)
    texts, values = [text], [runs[at]]
    for k in range(1, size):
        few = np.flatnonzero(n == k)
        if len(few):
            texts.append(few)
            values.append(window_hash(hashes, k)[first[few]])
    return np.concatenate(texts), np.concatenate(values)
