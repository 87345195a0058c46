"""Arrow batches as flat byte arrays: word boundaries, hashes and shingles for many documents at once.

Every Python operator of this folder works on slices of half a megabyte, so its memory follows
SLICE_BYTES and the longest single document, never the partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 500_000
_M = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_M, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; a null has no bytes."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents of at most `limit` bytes together; a longer one comes alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1), np.uint64)
        have[1:] = np.uint64(base)
        _powers[base] = have = np.multiply.accumulate(have)
    return have


class Words:
    """The words of a slice of documents: start and end byte, document and hash of each.

    `table` maps a byte to 0 (between words) or a positive value (equal for bytes that count as equal).
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.n_docs = len(offsets) - 1
        value = table[raw]
        inside = value > 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(raw)]
        begins[cuts] = inside[cuts]
        self.starts = np.flatnonzero(begins)
        #: words of document d are first[d] to first[d + 1]
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        if len(self.starts):
            weighed = value.astype(np.uint64) * powers(_M, len(raw))[: len(raw)]
            self.hash = mix(np.add.reduceat(weighed, self.starts) * powers(_INVERSE, len(raw))[self.starts])
        else:
            self.hash = np.zeros(0, np.uint64)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document of each run of `size` words; a document of fewer words, but not none, has one."""
        n = len(self.hash)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        acc, k = self.hash.copy(), max(n - size + 1, 0)
        acc = acc[:k]
        for j in range(1, size):
            acc = mix(acc * np.uint64(3) + self.hash[j : j + k])
        whole = self.doc[:k] == self.doc[n - k :] if k else np.zeros(0, bool)
        h, d = acc[whole], self.doc[:k][whole]
        short = np.flatnonzero((self.counts > 0) & (self.counts < size))
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for j in range(size - 1):
                has = self.counts[short] > j
                own[has] = mix(own[has] * np.uint64(5) + self.hash[self.first[short[has]] + j] + np.uint64(j + 1))
            h, d = np.concatenate([h, own]), np.concatenate([d, short])
            order = np.argsort(d, kind="stable")
            h, d = h[order], d[order]
        return h, d


def byte_table(separators: bytes | range | list, lower: bool = True) -> np.ndarray:
    """For Words: separators give 0, all other bytes their value plus 1, A-Z as a-z."""
    table = np.arange(1, 257, dtype=np.uint16)
    if lower:
        table[65:91] = table[97:123]
    table[list(separators)] = 0
    return table


#: words are [^\x20\x09-\x0D]+
SPACED = byte_table([0x20, *range(0x09, 0x0E)])
#: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
ALNUM = byte_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def distinct_sets(h: np.ndarray, d: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes per document, one after another, and their n_docs + 1 offsets."""
    at = np.searchsorted(d, np.arange(n_docs + 1))
    parts = [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]
    counts = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]]; 0 for an empty run."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def crc32_of(doc_id: int | None) -> int:
    """crc32 of an id as text; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
