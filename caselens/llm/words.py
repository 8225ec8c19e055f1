"""Arrow text columns as numpy: words, their hashes, and 64-bit mixing.

A word is a run of bytes other than space and U+0009 to U+000D; A-Z are lower-cased, every other character is kept. Null counts
as empty text. Hashes are 64 bits wide: two different words or shingles of one document share one with a chance below 2^-40.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, kept per worker."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + (1 << 16))
        for name, base in (("up", BASE), ("down", INVERSE)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows together, and the offset at which each begins (one more than rows)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, at: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``size`` bytes; a longer row is a run of its own."""
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_spans(data: np.ndarray, at: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes outside ``blank``; runs end with their row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~blank[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    first[begins] = solid[begins]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = at[1:][at[:-1] < at[1:]] - 1
    last[ends] = solid[ends]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(at, start, side="right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: a polynomial from prefix sums, with the span's place divided out.

    Spans are in order and don't overlap. They are hashed in stretches of at most ``CHUNK`` bytes; a longer span in parts.
    """
    out = np.zeros(len(start), dtype=np.uint64)
    first = 0
    while first < len(start):
        at = int(start[first])
        last = max(first + 1, int(np.searchsorted(end, at + CHUNK, side="right")))
        stop = int(end[last - 1])
        if stop - at <= CHUNK:
            up, down = powers(stop - at + 1)
            total = np.zeros(stop - at + 1, dtype=np.uint64)
            np.cumsum(BYTE_CODE[data[at:stop]] * up[:-1], out=total[1:])
            a, b = start[first:last] - at, end[first:last] - at
            out[first:last] = (total[b] - total[a]) * down[a]
        else:
            up, _ = powers(CHUNK)
            value, shift = 0, 1
            for k in range(at, stop, CHUNK):
                part = data[k : min(k + CHUNK, stop)]
                value = (value + shift * int(np.sum(BYTE_CODE[part] * up[: len(part)], dtype=np.uint64))) & MASK
                shift = shift * pow(BASE, len(part), 1 << 64) & MASK
            out[first] = value
        first = last
    return mix(out + (end - start).astype(np.uint64))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of lower-cased text, in order."""
    low = LOWER[data]
    start, end, row = word_spans(low, at)
    return (span_hashes(low, start, end) if len(start) else np.zeros(0, np.uint64)), row


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``width`` words; a row with fewer words has one shingle of all of them."""
    counts = np.bincount(row, minlength=rows)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.zeros(len(hashes), dtype=np.uint64)
    n = len(hashes)
    for i in range(min(width, n)):
        out[: n - i] = out[: n - i] * np.uint64(0xA24BAED4963EE407 | 1) + hashes[i:]
    left = firsts[row] + counts[row] - np.arange(n)
    keep = left >= width
    full, full_row = mix(out[keep]), row[keep]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = []
        for r in short:
            x = 0
            for h in hashes[firsts[r] : firsts[r] + counts[r]].tolist():
                x = (x * 0xC2B2AE3D27D4EB4F + h) & MASK
            whole.append(x ^ int(counts[r]))
        full = np.concatenate([full, mix(np.array(whole, dtype=np.uint64))])
        full_row = np.concatenate([full_row, short])
    return full, full_row


def row_sets(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted within the row, and the offset at which each row begins."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[fresh], row[fresh]
    return values, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int64)


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each segment (wrapping for whole numbers); empty segments give 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[at[1:]] - total[at[:-1]]
