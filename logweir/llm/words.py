"""Words and word windows of whole Arrow text columns as 64-bit hashes, without Python strings.

A word is a longest run of bytes other than the space and the bytes 9 to 13. All separators are
ASCII, so that UTF-8 can be read bytewise. Two different words share a hash with a chance of
about 2^-64.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPARK_WORD = r"[^\x20\x09-\x0D]+"
SPARK_SEPARATORS = r"[\x20\x09-\x0D]+"
_BLOCK = 1 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_WRAP = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, start: int = 1) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix(np.arange(start, start + n, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


_BYTE = seeds(256, 1000)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK, base & _WRAP, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWER = _powers(_BASE)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls read as empty."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all words, and where each text's words begin in that list."""
    word = ~_SEPARATOR[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    start[edges] = word[edges]
    begin = np.flatnonzero(start)
    return begin, np.searchsorted(begin, offsets)


def word_hashes(data: np.ndarray, begin: np.ndarray, lower: bool) -> np.ndarray:
    """A hash per word; memory beyond the result is bounded by the block and the longest word."""
    out = np.empty(len(begin), dtype=np.uint64)
    table = (_LOWER_BYTE if lower else _BYTE).copy()
    table[_SEPARATOR] = 0
    i = 0
    while i < len(begin):
        first = begin[i]
        j = int(np.searchsorted(begin, first + _BLOCK, side="right")) - 1
        stop = begin[j] if j > i else (begin[i + 1] if i + 1 < len(begin) else len(data))
        if j <= i:
            out[i] = _long_word(data[first:stop], table)
            i += 1
            continue
        if begin[-1] + _BLOCK > len(data) and len(data) - first <= _BLOCK:
            j, stop = len(begin), len(data)
        values = table[data[first:stop]]
        values *= _POWER[: len(values)]
        at = begin[i:j] - first
        out[i:j] = np.add.reduceat(values, at) * _INVERSE[at]
        i = j
    return mix(out)


def _long_word(piece: np.ndarray, table: np.ndarray) -> np.uint64:
    total, scale = 0, 1
    for lo in range(0, len(piece), _BLOCK):
        part = table[piece[lo: lo + _BLOCK]]
        part = part * _POWER[: len(part)]
        total += scale * int(np.add.reduce(part))
        scale = scale * pow(_BASE, len(part), 1 << 64) & _WRAP
    return np.uint64(total & _WRAP)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; the whole sequence as one when it is shorter."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    factor = seeds(width, 7)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        total += words[k: n - width + 1 + k] * factor[k]
    return mix(total + np.uint64(width))


def texts_as_words(column: pa.Array, lower: bool) -> Iterator[np.ndarray]:
    """The word hashes of each text of a column."""
    data, offsets = text_buffers(column)
    begin, at = word_starts(data, offsets)
    hashes = word_hashes(data, begin, lower)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        yield hashes[lo:hi]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` of up to a block of numbers, from differences of one running sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _POWER[: len(values)], out=total[1:])
    out = total[width:] - total[:-width]
    out *= _INVERSE[: len(out)]
    return mix(out + np.uint64(width))


def small_batches(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes, so that what a task makes of one stays small."""
    for batch in batches:
        each = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for k in range(0, batch.num_rows, each):
            yield batch.slice(k, each)
