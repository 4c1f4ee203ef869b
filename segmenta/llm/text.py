"""Array kernels over whole Arrow batches of text: bytes, word hashes and word windows without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Word separators: space and the ASCII controls 9 to 13.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, *range(9, 14)]] = True
_MULTIPLIER = U64(0x9E3779B97F4A7C15)
_powers = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit words."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, U64), np.full(max(n, 1024), _MULTIPLIER)]))
    return _powers


def byte_columns(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text begins; null counts as empty."""
    flat = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(flat) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Row ranges of about ``size`` bytes of text, so that memory follows the longest text and not the batch."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the first word of every text (with the total at the end)."""
    keep = ~SEPARATOR[data]
    at = np.flatnonzero(keep)
    if not len(at):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = edge[at]
    begins[0] = True
    begins[1:] |= at[1:] != at[:-1] + 1
    first = np.flatnonzero(begins)
    lengths = np.diff(np.append(first, len(at)))
    inside = np.arange(len(at)) - np.repeat(first, lengths)
    h = np.add.reduceat((data[at].astype(U64) + U64(1)) * powers(int(lengths.max()) + 1)[inside], first)
    return mix(h + lengths.astype(U64) * U64(0xD6E8FEB86659FD93)), np.searchsorted(at[first], offsets)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, by its first word, over text ends as well."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = words[:n].copy()
    for k in range(1, size):
        h *= U64(0xFF51AFD7ED558CCD)
        h += words[k : n + k]
        h ^= h >> U64(29)
    return mix(h)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of a text's word shingles; a text of fewer words has one shingle of all of them, an empty one none."""
    return windows(words, size) if len(words) >= size else windows(words, len(words)) if len(words) else words
