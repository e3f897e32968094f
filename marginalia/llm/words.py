"""Words and shingles of whole Arrow columns as 64-bit numbers, without a loop over words.

A word is a run of bytes other than blanks (space, tab to carriage return), A-Z lower-cased. Its
hash is a polynomial over its bytes, taken from a running sum over the column's buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = _BYTE[_LOWER]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of text that are worked on at once; a longer text is taken alone.
CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every bit of a 64-bit number over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of about ``CHUNK`` bytes. Null is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~_BLANK, stems: tuple[int, ...] = ()
) -> tuple:
    """(hash of each word, number of words before each text and in all).

    ``inside`` says which bytes make up words. With ``stems`` there is a third part: for each of
    these lengths (number, hash of the first so many bytes) of the words that are longer.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        return (*none, [(np.zeros(0, np.int64), none[0])] * len(stems)) if stems else none
    inside = inside[data]
    first = np.zeros(n + 1, bool)  # a text's first byte begins a word even without a blank before
    first[offsets] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | first[:n]))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | first[1:])) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:n], out=sums[1:])
    begun, base = sums[starts], down[starts]
    hashes, bounds = mixed((sums[ends] - begun) * base), np.searchsorted(starts, offsets)
    if not stems:
        return hashes, bounds
    beginnings = []
    for length in stems:
        at = np.flatnonzero(ends - starts > length)
        beginnings.append((at, mixed((sums[starts[at] + length] - begun[at]) * base[at])))
    return hashes, bounds, beginnings


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text; with fewer words the whole sequence is one,
    and without words there is none."""
    joined = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
    for j in range(k):
        joined = mixed(joined + hashes[j : j + len(joined)] + np.uint64(2 * j + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            yield np.unique(joined[a : b - k + 1])
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for h in hashes[a:b]:
                whole = mixed(whole * np.uint64(_BASE) + h)
            yield whole
        else:
            yield np.zeros(0, np.uint64)
