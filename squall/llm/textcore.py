"""Vectorised tokenising and hashing over Arrow string columns.

Works on the UTF-8 buffer of an Arrow array, so no Python object is made per
word.  Hashes depend on bytes only and agree on every executor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACES = b" \t\n\x0b\x0c\r"


def _table(kind: str) -> bytes:
    """Byte map: separators to a space; the rest to itself or to lower case."""
    out = bytearray(range(256))
    for c in range(256):
        if kind == "alnum":  # words of letters, digits and all non-ASCII
            if 65 <= c <= 90:
                out[c] = c + 32
            elif c < 128 and not (48 <= c <= 57 or 97 <= c <= 122):
                out[c] = 32
        else:  # words between ASCII white space
            if c in _SPACES:
                out[c] = 32
            elif kind == "space_lower" and 65 <= c <= 90:
                out[c] = c + 32
    return bytes(out)


TABLES = {k: _table(k) for k in ("alnum", "space", "space_lower")}

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _BASES[which]
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            both.append(np.cumprod(a, dtype=np.uint64))
        have = _POWERS[which] = tuple(both)
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low and high bits are usable alike."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _window(values: np.ndarray, first: np.ndarray, last: np.ndarray, which: int) -> np.ndarray:
    up, down = powers(len(values) + 1, which)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=total[1:])
    return (total[last] - total[first]) * down[first]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each span of bytes."""
    h = _window(data.astype(np.uint64) + np.uint64(1), start, end, which)
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


#: Text bytes of a slice: the arrays that are made of each take about 50 times as much, in every Python worker.
SLICE_BYTES = 1 << 19


def slices(column: pa.Array, most_bytes: int = SLICE_BYTES):
    """(first, last) row ranges of at most so many bytes, one row at least."""
    offsets = text_buffers(column)[1]
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def text_buffers(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The UTF-8 bytes and the row offsets of a string array; nulls are empty."""
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column = column.cast(pa.string())
        width = np.int32
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    if len(column) == 0:
        return memoryview(b""), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return memoryview(data if data is not None else b""), offsets


class Words:
    """Words of several texts: byte spans, and where each text's words begin.

    raw: the untouched bytes; seen: the bytes after the table; start, end: byte
    spans; at: word index at which each text starts, with the total at its end.
    """

    def __init__(self, column: pa.Array, kind: str):
        data, offsets = text_buffers(column)
        base = int(offsets[0])
        self.raw = bytes(data[base : int(offsets[-1])])
        self.offsets = offsets - base
        self.seen = self.raw.translate(TABLES[kind])
        self.bytes = np.frombuffer(self.seen, dtype=np.uint8)
        n = len(self.bytes)
        inside = np.zeros(n + 2, dtype=bool)
        np.not_equal(self.bytes, 32, out=inside[1 : n + 1])
        begins = inside[1 : n + 1] & ~inside[:n]
        ends = inside[1 : n + 1] & ~inside[2:]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begins[cut] = inside[cut + 1]
        ends[cut - 1] = inside[cut]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.at = np.searchsorted(self.start, self.offsets)

    def hashes(self, which: int = 0) -> np.ndarray:
        return span_hashes(self.bytes, self.start, self.end, which)

    def word(self, i: int) -> bytes:
        return self.seen[self.start[i] : self.end[i]]

    def span(self, i: int, n: int) -> bytes:
        """n words from word i on, joined by one space."""
        return b" ".join(self.word(k) for k in range(i, i + n))


def grams(hashes: np.ndarray, at: np.ndarray, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words that stay inside one text, and their first word."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.arange(total - n + 1)
    ok = np.ones(len(first), dtype=bool)
    for cut in at[1:-1]:  # windows that would cross into the next text
        ok[max(0, cut - n + 1) : cut] = False
    first = first[ok]
    return mix(_window(hashes, first, first + n, which) + np.uint64(n)), first


def per_text(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
