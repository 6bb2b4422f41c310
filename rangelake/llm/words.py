"""Words of whole texts as positions and 64-bit hashes, computed over Arrow buffers with numpy.

Separators are single ASCII bytes in every contract used here, so UTF-8 bytes can be cut without decoding.
Texts are handled as one flat byte array with document offsets; null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time, so that the eight-fold wider intermediate arrays stay small.
HASH_BYTES = 1 << 20
#: Texts handled at a time by operators that work batch-wise.
SLICE_BYTES = 4 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_STEP = _U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BYTES = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _STEP) | _U(1)


def _table(characters: str, keep: bool) -> np.ndarray:
    out = np.full(256, not keep)
    out[[ord(c) for c in characters]] = keep
    return out


#: Bytes of words `[^\x20\x09-\x0D]+`.
PLAIN = _table(" \t\n\x0b\x0c\r", False)
#: Bytes of lower-cased words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = _table("0123456789abcdefghijklmnopqrstuvwxyz", True) | (np.arange(256) >= 128)
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n+1 document offsets of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if binary else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of up to ``most`` bytes together, or of one longer document."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def cut(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word and, per document, the index of its first word (n+1 values)."""
    inside = table[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[edges] = inside[edges]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, _U(base), np.uint64)
            steps[0] = 1
            _POW[k] = np.multiply.accumulate(steps)
    return _POW[0][:n], _POW[1]


_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: a polynomial over random byte values, finalised. Spans are sorted and disjoint."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, starts[first] + HASH_BYTES, "right")), first + 1)
        low, high = int(starts[first]), int(ends[last - 1])
        up, down = _powers(max(high - low, HASH_BYTES))
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTES[data[low:high]] * up[: high - low], out=total[1:])
        s = starts[first:last] - low
        out[first:last] = (total[ends[first:last] - low] - total[s]) * down[s]
        first = last
    return mix(out)


def window_hashes(h: np.ndarray, doc_words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word index and document of every run of ``n`` words inside a document."""
    counts = np.maximum(np.diff(doc_words) - n + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(len(docs)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(doc_words[:-1], counts)
    out = np.zeros(len(first), np.uint64)
    for k in range(n):
        out = (out + h[first + k]) * _STEP
        out ^= out >> _U(29)
    return mix(out), first, docs


def characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points in each span of UTF-8."""
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return heads[ends] - heads[starts]


def rolling_hashes(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words, also across documents; the i-th starts at word i."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    values = mix(h + _U(salt) * _STEP) if salt else h
    out = np.empty(len(h) - n + 1, np.uint64)
    for low in range(0, len(out), HASH_BYTES):
        high = min(low + HASH_BYTES, len(out))
        up, down = _powers(HASH_BYTES + n)
        total = np.zeros(high - low + n, np.uint64)
        np.cumsum(values[low : high + n - 1] * up[: high - low + n - 1], out=total[1:])
        out[low:high] = (total[n:] - total[:-n]) * down[: high - low]
    return mix(out)


def runs_of(mask: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of the runs of true values; a true value of ``breaks`` begins a new run."""
    begin = mask.copy()
    begin[1:] &= ~mask[:-1] if breaks is None else ~mask[:-1] | breaks[1:]
    end = mask.copy()
    end[:-1] &= ~mask[1:] if breaks is None else ~mask[1:] | breaks[1:]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1
