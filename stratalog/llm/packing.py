"""Packing token sequences into bins: best fit decreasing, then swap-based local search.

Documents are encoded whole, closed by an end id and cut into pieces only if longer than a bin (the first
piece takes the remainder, the others fill a bin each). A piece that fills a bin is one. The others are
numbered as they are written, and dealt by a hash of that number to groups of about GROUP, packed in parallel, so rows
that repeat are spread like any others.

Within a group the search takes the least filled bin and moves its pieces into other underfull bins,
exchanges one for a shorter one, or for two shorter ones. Bins without a step are tried again after later
steps, until none has one. Each step raises the sum of squared fills, so it ends; it stops early when there
are no more bins than the pieces' total needs.

Defined cases: null and empty texts are the end id alone; rows with equal ids are packed as separate
documents; a null id is kept as null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.shared import small_batches, written
from stratalog.llm.tokens import encoder

CAPACITY, END_ID, GROUP = 1024, 2, 8192


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and place, a number of its own."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        own, place = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for b in batches:
            ids, row, piece, start, length, crc = b.column("doc_id"), [], [], [], [], []
            for i, text in enumerate(b.column("text")):
                values = np.append(own.values(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                n = len(values)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                raw = memoryview(values.tobytes())
                for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i), piece.append(k), start.append(x), length.append(y - x), crc.append(zlib.crc32(raw[4 * x : 4 * y]))
            yield pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "place": pa.array(np.arange(place, place + len(row)))})
            place += len(row)

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, place long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes; longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit s: some bin has s free
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = open_ >> n
        if fits:
            s = n + (fits & -fits).bit_length() - 1
            b = free[s].pop()
            if not free[s]:
                open_ &= ~(1 << s)
        else:
            s, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if s > n:
            free[s - n].append(b)
            open_ |= 1 << (s - n)
    return bins


def local_search(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Fewer bins, or as many, by moves and exchanges that raise the squared fill."""
    least = -(-sum(lengths) // capacity)
    bins = [list(b) for b in bins]
    size = np.array(lengths, np.int64)
    fill = np.array([size[b].sum() for b in bins], np.int64)
    count, stuck = len(bins), np.zeros(len(bins), bool)
    own: dict[int, tuple] = {}  # of a bin: its pieces, and the pairs of them

    def held(b: int) -> tuple:
        if b not in own:
            i = np.array(bins[b], np.int64)
            x, y = np.triu_indices(len(i), 1)
            own[b] = i, i[x], i[y]
        return own[b]

    def put(i: int, a: int, b: int) -> None:
        bins[a].remove(i)
        bins[b].append(i)
        fill[a] -= size[i]
        fill[b] += size[i]
        own.pop(a, None), own.pop(b, None)

    view, moved = None, False
    while count > least:
        if view is None:
            under = np.flatnonzero((fill < capacity) & (fill > 0))
            parts = [held(int(b)) for b in under]
            one, first, second = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
            in_one, in_two = (np.repeat(np.arange(len(under)), [len(p[k]) for p in parts]) for k in (0, 1))
            slack, l_one, l_two = capacity - fill[under], size[one], size[first] + size[second]
            s_one, s_two = slack[in_one], slack[in_two]
            view = True
        tries = np.flatnonzero(~stuck[under])
        if not len(tries) and moved:  # steps since may help those that had none
            stuck[:], moved = False, False
            tries = np.arange(len(under))
        if not len(tries) or len(under) < 2:
            break
        k = int(tries[np.argmax(slack[tries])])
        a, fuller = int(under[k]), slack <= slack[k]
        fuller[k] = False
        f_one, f_two = fuller[in_one], fuller[in_two]
        for i in sorted(bins[a], key=lambda i: -lengths[i]):
            n = lengths[i]
            fits = np.flatnonzero(fuller & (slack >= n))
            if len(fits):
                put(i, a, int(under[fits[np.argmin(slack[fits])]]))
                break
            gain = np.where(f_one & (l_one < n) & (n - l_one <= s_one), n - l_one, 0)
            if gain.max(initial=0) > 0:
                j = int(np.argmax(gain))
                b = int(under[in_one[j]])
                put(i, a, b), put(int(one[j]), b, a)
                break
            gain = np.where(f_two & (l_two < n) & (n - l_two <= s_two), n - l_two, 0)
            if gain.max(initial=0) > 0:
                j = int(np.argmax(gain))
                b = int(under[in_two[j]])
                put(i, a, b), put(int(first[j]), b, a), put(int(second[j]), b, a)
                break
        else:
            stuck[a] = True
            continue
        view, moved = None, True
        count -= not bins[a]
    return [b for b in bins if b]


def packed(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(lengths, best_fit(lengths, capacity), capacity)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and its sequence_id and offset there."""
    cut = written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    full = cut.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("place")).withColumn("offset", F.lit(0).cast("long")).drop("place")
    rest = cut.filter(F.col("length") < capacity)
    groups = max(1, round(rest.count() / group))
    dealt = rest.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(groups))).drop("place")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = frame.length.to_numpy()
        bins = packed(lengths.tolist(), capacity)
        order = np.array([i for b in bins for i in b], np.int64)
        seq = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        own = lengths[order]
        ends = np.cumsum(own)
        base = np.zeros(len(bins), np.int64)
        base[1:] = ends[np.cumsum([len(b) for b in bins])[:-1] - 1] if len(bins) > 1 else 0
        out = frame.iloc[order]
        return out.assign(sequence_id=out.part * (1 << 32) + seq, offset=ends - own - base[seq]).drop(columns="part")

    found = dealt.groupBy("part").applyInPandas(run, f"doc_id {dict(cut.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return full.unionByName(found)
