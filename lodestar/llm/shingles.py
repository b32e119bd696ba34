"""Sets of hashed word shingles of whole texts, many documents at a time, in numpy."""

from __future__ import annotations

import numpy as np

from .common import U64, RangeHash, byte_codes, mix64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CODES = byte_codes(10)[_LOWER]  # A-Z count as a-z
_ORDER = [U64(2 * x + 1) for x in (0x4F1BBCDCBFA53E0A, 0x1B873593CC9E2D51, 0x27D4EB2F165667C5, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85)]


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+`` of joined texts; no word crosses texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text its different shingles of ``size`` words as sorted 64-bit hashes.

    A text of fewer words has its whole sequence as its one shingle; one without
    words has none.
    """
    start, end = word_ranges(data, offsets)
    words = RangeHash(_CODES[data]).of(start, end) if len(start) else np.zeros(0, U64)
    cut = np.searchsorted(start, offsets)  # the words of text i are cut[i]:cut[i+1]
    n = max(0, len(words) - size + 1)
    joined = np.zeros(n, U64)
    for k in range(size):
        joined = mix64(joined * _ORDER[1] + words[k : k + n] * _ORDER[0])
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(joined[a : b - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif b > a:
            h = np.array([b - a], U64) * _ORDER[2]
            for w in words[a:b]:
                h = mix64(h * _ORDER[1] + w)
            out.append(h)
        else:
            out.append(np.zeros(0, U64))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Fast similarity sketches: one value a bin and set; two sets agree in a bin with probability their Jaccard similarity.

    Round i < bins puts every element into a hashed bin; round i >= bins puts
    every element into bin i - bins. A bin keeps the least value of the first
    round that reaches it. A set takes part until all its bins are filled, so
    each bin is filled after 2 * bins rounds at most and after a few rounds for
    most sets. An empty set keeps the highest value in all bins.
    """
    full = U64(2**64 - 1)
    out = np.full((len(sets), bins), full)
    flat = out.reshape(-1)
    item = np.concatenate(sets) if sets else np.zeros(0, U64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * bins):
        if not len(item):
            break
        h = mix64(item + U64(((i + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        bin_ = ((h >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64) if i < bins else np.full(len(item), i - bins)
        at = owner * bins + bin_
        value = (U64(i) << U64(52)) | ((h * U64(0xD6E8FEB86659FD93)) >> U64(12))
        if i:
            free = flat[at] == full
            np.minimum.at(flat, at[free], value[free])
        else:
            np.minimum.at(flat, at, value)
        if i < 2 or i % 4 == 0 or len(item) < 4096:
            open_ = (out == full).any(axis=1)[owner]
            if not open_.all():
                item, owner = item[open_], owner[open_]
    return out


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of equally many bins."""
    rows = sketch.shape[1] // bands
    out = np.empty((len(sketch), bands), U64)
    for b in range(bands):
        h = np.full(len(sketch), U64((b + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        for r in range(rows):
            h = mix64(h * _ORDER[1] + sketch[:, b * rows + r])
        out[:, b] = h
    return out
