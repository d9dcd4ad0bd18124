"""Vectorised word and shingle hashing over Arrow string columns.

A whole batch is hashed in a handful of NumPy passes over its UTF-8 bytes; no
Python object is made per word. Words are maximal runs of bytes outside
``0x20, 0x09-0x0D``, after ASCII lower-casing; UTF-8 continuation bytes never
fall in that set, so the byte view equals the character view.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated UTF-8 bytes of a string column and its int64 offsets (nulls are empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


#: Bytes that separate words, and A-Z to a-z.
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def split_words(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes outside ``space`` that stays within one text."""
    inside = ~space[raw]
    first = inside.copy()
    first[1:] &= space[raw[:-1]]
    begins = offsets[:-1][offsets[:-1] < len(raw)]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span ``raw[start:end]``; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for lo, hi in _blocks(starts, ends):
            a, b = starts[lo], ends[hi - 1]
            up, down = _powers(b - a + 1)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum((raw[a:b].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
            s, e = starts[lo:hi] - a, ends[lo:hi] - a
            out[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, first word of each text plus the total)."""
    raw, offsets = text_bytes(column)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = split_words(raw, offsets)
    return hash_spans(_LOWER[raw] if lower else raw, starts, ends), np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of ``width`` words from each word on, across text borders too."""
    n = max(len(words) - width + 1, 0)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            h = (h + words[j : j + n]) * _MULTIPLIER
            h ^= h >> np.uint64(29)
    return mix(h)


_MULTIPLIER = np.uint64(0xFF51AFD7ED558CCD)


def _blocks(starts: np.ndarray, ends: np.ndarray, size: int = 1 << 18):
    lo = 0
    while lo < len(starts):
        hi = max(int(np.searchsorted(ends, starts[lo] + size, side="right")), lo + 1)
        yield lo, hi
        lo = hi


def shingles(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle in order, repeats included, first of each text plus the total).

    A text with fewer than ``width`` words, but some, is one shingle of all its
    words; a text without words has none.
    """
    words, at = word_hashes(column)
    counts = np.diff(at)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    place = np.repeat(at[:-1] - bounds[:-1], sizes) + np.arange(bounds[-1])
    grams = gram_hashes(words, width)
    out = np.zeros(bounds[-1], np.uint64)
    full = np.repeat(counts >= width, sizes)
    out[full] = grams[place[full]]
    for t in np.flatnonzero((counts > 0) & (counts < width)):
        out[bounds[t]] = gram_hashes(words[at[t] : at[t + 1]], int(counts[t]))[0]
    return out, bounds


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    values, bounds = shingles(column, width)
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
