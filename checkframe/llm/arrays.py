"""Columnar text helpers used inside Arrow tasks.

A batch of documents is handled as one byte buffer plus offsets, so words are
found and hashed with a few numpy passes instead of one Python call a word.
Words are runs of bytes other than space and ``\\x09-\\x0D``; lower-casing maps
``A-Z`` only.  Work is cut into slices of at most ``SLICE_BYTES`` of text, so the
temporary arrays stay bounded whatever the batch holds (one longer document is a
slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits."""
    x = np.asarray(x, dtype=_U).copy()
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def stream64(seed: int, n: int) -> np.ndarray:
    """The first ``n`` values of a fixed pseudo-random sequence."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15))


_BYTE_KEY = stream64(11, 256) | _U(1)
_POS_KEY = stream64(29, 1024) | _U(1)


def _pos_key(n: int) -> np.ndarray:
    global _POS_KEY
    if n > len(_POS_KEY):
        _POS_KEY = stream64(29, 1 << (n - 1).bit_length()) | _U(1)
    return _POS_KEY


@dataclass
class Words:
    """Words of a slice: hash, document row, first byte and byte length of each."""

    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    #: first word of each document, with one more entry at the end
    first: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Yield ``(rows, bytes, offsets)`` for runs of rows with at most ``limit`` bytes of text; null counts as empty."""
    if batch.num_rows == 0:
        return
    text = batch.column(batch.schema.get_field_index(column))
    text = pc.fill_null(text.cast(pa.large_binary()), b"")
    offs = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(text):
        end = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(text))
        yield batch.slice(at, end - at), data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Find and hash the words of a slice."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, offsets, np.zeros(0, dtype=_U), none, none, none, np.zeros(len(offsets), dtype=np.int64))
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    sizes = np.diff(offsets)
    heads = offsets[:-1][sizes > 0]
    begins[heads] = inside[heads]
    tails = offsets[1:][sizes > 0] - 1
    ends[tails] = inside[tails]
    start = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - start
    first = np.searchsorted(start, offsets, side="left")
    doc = np.repeat(np.arange(len(sizes)), np.diff(first))
    if len(start) == 0:
        return Words(data, offsets, np.zeros(0, dtype=_U), doc, start, length, first)
    low = (LOWER if lower else SAME)[data[inside]]
    at = np.cumsum(length) - length
    pos = np.arange(len(low)) - np.repeat(at, length)
    with np.errstate(over="ignore"):
        value = _BYTE_KEY[low] * _pos_key(int(length.max()))[pos]
        hashes = mix64(np.add.reduceat(value, at) + length.astype(_U) * _U(0xD6E8FEB86659FD93))
    return Words(data, offsets, hashes, doc, start, length, first)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, document row)`` of every run of ``n`` words, repeats included; a document of fewer words gives its whole sequence once."""
    counts = np.diff(w.first)
    if len(w.hashes) == 0:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    keys = stream64(71, n + 1) | _U(1)
    total = len(w.hashes)
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, total - n + 1), dtype=_U)
        for k in range(n):
            full += w.hashes[k : k + len(full)] * keys[k]
        ok = w.doc[: len(full)] == w.doc[n - 1 : n - 1 + len(full)] if len(full) else np.zeros(0, dtype=bool)
        out, doc = [mix64(full[ok])], [w.doc[: len(full)][ok]]
        short = np.flatnonzero((counts > 0) & (counts < n))
        for k in range(1, n):
            rows = short[counts[short] == k]
            if len(rows):
                h = np.zeros(len(rows), dtype=_U)
                for j in range(k):
                    h += w.hashes[w.first[rows] + j] * keys[j]
                out.append(mix64(h + _U(k) * keys[n]))
                doc.append(rows)
    return np.concatenate(out), np.concatenate(doc)


def distinct(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(document row, hash)`` pairs, in that order."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    if len(h) == 0:
        return h, d
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[keep], d[keep]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each run ``first[i]:first[i + 1]``; empty runs give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]
