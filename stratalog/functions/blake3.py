"""BLAKE3 of byte strings and of files of any size: the compression of many chunks at once in numpy.

A content is cut into chunks of 1 KiB, whose values are joined in pairs, level by level; one that is left over goes up
as it is. A file is read in pieces of 2 ** PIECE chunks, each of which is a full subtree and leaves one value.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

CHUNK, BLOCK, PIECE = 1024, 64, 10

# Fixed values of the function: its start, the order of words after a round, and the flags of a block.
START = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
FIRST, LAST, PARENT, ROOT = 1, 2, 4, 8
#: the words that each half of a round mixes: columns, then diagonals
_MIXED = [((0, 1, 2, 3), (4, 5, 6, 7), (8, 9, 10, 11), (12, 13, 14, 15)), ((0, 1, 2, 3), (5, 6, 7, 4), (10, 11, 8, 9), (15, 12, 13, 14))]


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(values: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """values [8, n] and words [16, n] of n blocks -> the next values [8, n]. A half round's four mixings are done together."""
    n = values.shape[1]
    v = np.empty((16, n), np.uint32)
    v[:8], v[8:12] = values, START[:4, None]
    v[12], v[13], v[14], v[15] = counter & 0xFFFFFFFF, counter >> 32, length, flags
    for _ in range(7):
        for half, (a, b, c, d) in enumerate(_MIXED):
            for step, (first, second) in enumerate(((16, 12), (8, 7))):
                m = words[8 * half + step : 8 * half + 8 : 2]
                a, b, c, d = list(a), list(b), list(c), list(d)
                v[a] += v[b] + m
                v[d] = _turned(v[d] ^ v[a], first)
                v[c] += v[d]
                v[b] = _turned(v[b] ^ v[c], second)
        words = words[ORDER]
    return v[:8] ^ v[8:]


def _chunks(data: bytes, first: int, alone: bool) -> np.ndarray:
    """The values [8, n] of data's chunks, the first of which has number `first`; `alone`: it is the whole content, of one chunk."""
    n = max(1, -(-len(data) // CHUNK))
    padded = np.zeros(n * CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    words = padded.view("<u4").reshape(n, CHUNK // BLOCK, 16)
    size = np.full(n, CHUNK, np.int64)
    size[-1] = len(data) - (n - 1) * CHUNK
    blocks = np.maximum(1, -(-size // BLOCK))
    counter = np.arange(first, first + n, dtype=np.uint64)
    values = np.repeat(START[:, None], n, 1)
    for j in range(CHUNK // BLOCK):
        on = np.flatnonzero(blocks > j)
        if not len(on):
            break
        flags = np.where(j == 0, FIRST, 0) + np.where(blocks[on] == j + 1, LAST + ROOT * alone, 0)
        values[:, on] = _compress(values[:, on], words[on, j].T, counter[on], np.minimum(size[on] - j * BLOCK, BLOCK), flags)
    return values


def _joined(values: np.ndarray, root: bool) -> np.ndarray:
    """One value [8, 1] of values [8, n] in order; with `root`, that of the whole content."""
    while (n := values.shape[1]) > 1:
        pairs = n // 2
        words = np.concatenate([values[:, 0 : 2 * pairs : 2], values[:, 1 : 2 * pairs : 2]])
        flags = np.full(pairs, PARENT + ROOT * (root and n == 2))
        up = _compress(np.repeat(START[:, None], pairs, 1), words, np.zeros(pairs, np.uint64), np.full(pairs, BLOCK), flags)
        values = np.concatenate([up, values[:, 2 * pairs :]], 1)
    return values


def hexdigest(pieces: Iterable[bytes]) -> str:
    """Of a content that comes in pieces of any length."""
    done, k = [], 0
    for piece, last in _even(pieces):
        whole = last and k == 0
        values = _chunks(piece, k << PIECE, whole and len(piece) <= CHUNK)
        done.append(_joined(values, whole))
        k += 1
    return _joined(np.concatenate(done, 1), True)[:, 0].astype("<u4").tobytes().hex()


def _even(pieces: Iterable[bytes]) -> Iterator[tuple[bytes, bool]]:
    """Pieces of 2 ** PIECE chunks, and whether each is the last; the last is shorter, but empty only if all is."""
    held, size = bytearray(), CHUNK << PIECE
    for p in pieces:
        held += p
        while len(held) > size:
            yield bytes(held[:size]), False
            del held[:size]
    yield bytes(held), True


@pandas_udf(T.StringType())
def content_hash(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else hexdigest([c]))
