"""Word tables of Arrow text columns by whole-array numpy steps over UTF-8 bytes.

Runs inside Spark tasks. A chunk of documents is one byte array; words are maximal runs of word
bytes, hashed by a polynomial over their lower-cased bytes (prefix sums modulo 2**64).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a step holds some dozens of bytes for each.
CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of words made of digits, letters and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of words that end at ASCII white space only.
NONSPACE = np.ones(256, bool)
NONSPACE[0x20] = NONSPACE[0x09:0x0E] = False

_tables: dict[str, np.ndarray] = {}


def _powers(n: int, base: np.uint64, key: str) -> np.ndarray:
    if key not in _tables or len(_tables[key]) < n:
        with np.errstate(over="ignore"):
            full = np.full(max(n, 1), base, np.uint64)
            full[0] = 1
            _tables[key] = np.multiply.accumulate(full)
    return _tables[key]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit hash."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of a chunk: byte ``start``/``end``, ``hash``; document d owns words first[d]:first[d+1]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    def prefix_hash(self, which: np.ndarray, length: int) -> np.ndarray:
        """Hash of the first ``length`` bytes of the words ``which`` (all at least that long)."""
        at = self.start[which]
        with np.errstate(over="ignore"):
            return mix(_placed(self.sums[at + length] - self.sums[at], at) + np.uint64(length))


def _placed(value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Polynomial sums moved from their start to a common place."""
    power = _powers(CHUNK + 1, _P, "power")
    near = start <= CHUNK
    value[near] *= power[CHUNK - start[near]]
    if not near.all():  # a document longer than a chunk
        far = start[~near] - CHUNK
        value[~near] *= _powers(int(far.max()) + 1, _PINV, "inverse")[far]
    return value


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if off else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents of about ``size`` bytes."""
    data, offsets = text_buffers(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Words of the chunk, ``kind`` telling word bytes; no word crosses from one document to the next."""
    inside = kind[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges] = False
        after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    with np.errstate(over="ignore"):
        power = _powers(max(n, CHUNK) + 1, _P, "power")
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        value = _placed(sums[end] - sums[start], start)
    return Words(data, offsets, start, end, mix(value), np.searchsorted(start, offsets), sums)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans start:end, by their exact bytes."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(max(len(data), CHUNK) + 1, _P, "power")[: len(data)], out=sums[1:])
        return mix(_placed(sums[end] - sums[start], start) + (end - start).astype(np.uint64))


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte position (length n + 1)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within consecutive runs of the given lengths."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths)
