"""Word and shingle hashes of Arrow text columns, computed on whole byte buffers.

Words are maximal runs of bytes other than space and ``\\t \\n \\v \\f \\r``; A-Z
are lower-cased. Both rules are ASCII only, so they can be applied to UTF-8
bytes as they are. A word's hash is a polynomial over its bytes modulo 2**64
(prefix sums times the inverse power of its start), then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SHINGLE_WORDS = 5

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Letters, digits and bytes of wider characters; all else separates.
_SIGN = np.ones(256, dtype=bool)
_SIGN[48:58] = _SIGN[65:91] = _SIGN[97:123] = _SIGN[128:] = False
_STEP = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(64)], dtype=_U)
_powers = {_BASE: np.ones(1, dtype=_U), _INVERSE: np.ones(1, dtype=_U)}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        grown = np.full(n, base, dtype=_U)
        grown[0] = 1
        _powers[base] = np.cumprod(grown, dtype=_U)
    return _powers[base][:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), offsets


def _hash_words(data: np.ndarray, cuts: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of the words of ``data``; no word crosses a cut."""
    low = _LOWER[data]
    inside = ~gaps[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((low.astype(_U) + _U(1)) * _power(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts]), starts, ends


def _pieces(data: np.ndarray, chunk: int, gaps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut one long text into pieces of about ``chunk`` bytes that end at white space."""
    at = 0
    while at < len(data):
        end = min(at + chunk, len(data))
        while end < len(data) and not gaps[data[end]]:
            window = data[end : end + chunk]
            gap = np.flatnonzero(gaps[window])
            end += int(gap[0]) if len(gap) else len(window)
        yield at, end
        at = end


def hashed_words(column: pa.Array, chunk: int = CHUNK_BYTES, spans: bool = False, letters: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple | None]]:
    """Runs of rows as (first row, row after the last, word hashes, word offsets
    of those rows, (starts, ends) in bytes from each row's start or None).

    A run holds about ``chunk`` bytes; one longer text makes a run of its own.
    ``letters``: signs separate words as white space does.
    """
    gaps = _SIGN if letters else _SPACE
    data, offsets = text_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        after = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk, side="right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[after])
        if after == row + 1 and hi - lo > chunk:
            parts = [(a, *_hash_words(data[lo + a : lo + b], np.zeros(0, np.int64), gaps)) for a, b in _pieces(data[lo:hi], chunk, gaps)]
            hashes = np.concatenate([p[1] for p in parts])
            starts = np.concatenate([p[2] + p[0] for p in parts])
            ends = np.concatenate([p[3] + p[0] for p in parts])
            bounds = np.array([0, len(hashes)])
        else:
            cuts = (offsets[row : after + 1] - lo).astype(np.int64)
            hashes, starts, ends = _hash_words(data[lo:hi], cuts, gaps) if hi > lo else (np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))
            bounds = np.searchsorted(starts, cuts)
            if spans:
                base = np.repeat(cuts[:-1], np.diff(bounds))
                starts, ends = starts - base, ends - base
        yield row, after, hashes, bounds, (starts, ends) if spans else None
        row = after


def shingles(hashes: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the ``width`` words at each position; of all words, if there are fewer."""
    width = min(width, len(hashes))
    if not width:
        return np.zeros(0, _U)
    n = len(hashes) - width + 1
    total = np.zeros(n, _U)
    for i in range(width):
        total += hashes[i : i + n] * _STEP[i]
    return mix(total + _U(width))


def shingle_sets(column: pa.Array, width: int = SHINGLE_WORDS, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """Each row's number and the sorted hashes of its distinct shingles."""
    for row, after, hashes, bounds, _ in hashed_words(column, chunk):
        whole = shingles(hashes, width) if len(hashes) >= width else None
        for i in range(row, after):
            lo, hi = int(bounds[i - row]), int(bounds[i - row + 1])
            own = whole[lo : hi - width + 1] if whole is not None and hi - lo >= width else shingles(hashes[lo:hi], width)
            yield i, np.unique(own)
