"""Hashes of words and word shingles over Arrow text columns, in numpy.

Words are the runs of bytes other than ASCII white space. Texts are worked on in
slices of a few megabytes, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 21
PIECE = 1 << 20

# 0 for white space, 1 for all other bytes; and with ASCII symbols as a kind of their own.
_KIND = np.ones(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_SYMBOLS = _KIND.copy()
_SYMBOLS[[x for x in range(128) if _KIND[x] and not chr(x).isalnum()]] = 2
_SPACE = _KIND == 0
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_PLACES = [np.uint64(x) for x in (
    0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, _INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes, one row at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(end, n)
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, symbols: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, A-Z in lower case, and the first word of each row.

    With ``symbols``, runs of ASCII symbols are words of their own.
    """
    kinds = _SYMBOLS if symbols else _KIND
    starts, hashes = [], []
    at, total = int(offsets[0]), int(offsets[-1])
    while at < total:
        end = min(at + PIECE, total)
        if end < total:  # cut behind white space or between rows
            row = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            cut = max(row, at + int(gaps[-1]) + 1 if len(gaps) else at)
            if cut <= at:  # a word longer than a piece
                cut = int(offsets[np.searchsorted(offsets, end, "left")])
                ahead = end
                while ahead < cut:
                    gaps = np.flatnonzero(_SPACE[data[ahead:min(ahead + PIECE, cut)]])
                    if len(gaps):
                        cut = ahead + int(gaps[0])
                        break
                    ahead += PIECE
            end = cut
        piece = data[at:end]
        kind = kinds[piece]
        inside = kind > 0
        change = kind[1:] != kind[:-1]
        edge = np.zeros(len(piece) + 1, bool)
        here = offsets[(offsets >= at) & (offsets < end)] - at
        edge[here] = True
        edge[0] = edge[-1] = True
        first = inside.copy()
        first[1:] &= change | edge[1:-1]
        last = inside.copy()
        last[:-1] &= change | edge[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power_tables(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_LOWER[piece] * up[:len(piece)], out=sums[1:])
        hashes.append(mixed((sums[e] - sums[s]) * down[s]))
        starts.append(s + at)
        at = end
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    begins = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(begins, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a shorter text is one shingle, none without words."""
    words, rows = word_hashes(data, offsets)
    n, places = len(words), np.array([_PLACES[k % 5] for k in range(width)], np.uint64)
    if n >= width:
        runs = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            runs += words[k:n - width + 1 + k] * places[k] + np.uint64(k * k)
        runs = mixed(runs)
    out = []
    for a, b in zip(rows[:-1], rows[1:]):
        if b - a >= width:
            out.append(np.unique(runs[a:b - width + 1]))
        elif b > a:
            short = np.sum(words[a:b] * places[:b - a], keepdims=True) + np.uint64(int(b - a) << 40)
            out.append(mixed(short, 77))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
