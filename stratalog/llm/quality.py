"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax.

Features of a whole text: each word between white space, each pair of neighbouring words, and the character n-grams of
each word with its borders. A word pair, next to each other or up to GAPS places apart, whose two words are one word
is besides a feature whichever word it is, with a bucket for each distance that no other feature shares: hashed pairs
can't learn from the repetition of some words that of others.
All are hashed into BUCKETS vectors of DIM numbers, learned with the output layer by stochastic gradient
descent in numpy on the driver. Since the output is linear in the average, scoring needs one number per
bucket: a text's score is the logistic of the mean of its features' numbers.

Bounds of the sample that is learned from: TRAIN_DOCS labelled rows, picked by a hash of their id, whole, and fewer where
they would exceed TRAIN_BYTES together. All other rows are only scored.

Defined cases: null and empty texts have no features and get the score of the bias alone; without labels
all scores are 0.5; rows whose id or label is null are not learned from; labels above 0 count as 1; of rows
that share an id the text that sorts first is learned from, with the id's largest label. Ids may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.batches import Words, byte_table, mix, segment_sum, slices, utf8
from stratalog.llm.shared import give_back, small_batches

BUCKETS, DIM, EPOCHS, RATE = 1 << 18, 12, 5, 4.0
TRAIN_DOCS, TRAIN_BYTES, THRESHOLD, SEED = 5000, 48_000_000, 0.3, 11
GRAMS, GAPS, CHUNK = (1, 3, 4), 3, 100
_CASED = byte_table([0x20, *range(0x09, 0x0E)], lower=False)


def features(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of buckets in the order of the documents, and the offsets of each document's."""
    n_docs, mask = len(offsets) - 1, np.uint64(BUCKETS - 1)
    words = Words(raw, offsets, _CASED)
    yield (words.hash & mask).astype(np.int64), words.first
    for gap in range(1, GAPS + 1):
        same = words.doc[gap:] == words.doc[:-gap]
        if gap == 1:
            pair = mix(words.hash[:-1] * np.uint64(3) + words.hash[1:])
            kept = np.append(0, np.cumsum(same))
            yield (pair[same] & mask).astype(np.int64), kept[np.minimum(words.first, len(same))]
        again = same & (words.hash[gap:] == words.hash[:-gap])
        kept = np.append(0, np.cumsum(again))
        yield np.full(int(kept[-1]), BUCKETS + gap - 1, np.int64), kept[np.minimum(words.first, len(again))]
    # characters, with a space for each byte between words
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[offsets]
    inside = (points >= 256) | (_CASED[np.minimum(points, 255)] > 0)
    points = np.where(inside, points, 32).astype(np.uint32)
    for n in GRAMS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        code, ok = np.full(m, n, np.uint32), np.ones(m, bool)
        for j in range(n):
            code = (code ^ points[j : j + m]) * np.uint32(0x01000193)
            if 0 < j < n - 1 or n == 1:
                ok &= inside[j : j + m]
        crosses = begins[1:-1]
        for j in range(1, n):  # a gram does not run into the next document
            at = crosses - j
            ok[at[(at >= 0) & (at < m)]] = False
        kept = np.append(0, np.cumsum(ok))
        code = (code[ok] * np.uint32(0x9E3779B1)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))
        yield code.astype(np.int64), kept[np.minimum(begins, m)]


class Classifier:
    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def scores(self, column: pa.Array) -> np.ndarray:
        raw, offsets = utf8(column)
        out = np.full(len(offsets) - 1, self.bias)
        for a, b in slices(offsets):
            total, count = np.zeros(b - a), np.zeros(b - a)
            for ids, at in features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                total += segment_sum(self.table[ids], at)
                count += np.diff(at)
            out[a:b] += total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def weighed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The different features of each text and their shares."""
    raw, offsets = utf8(pa.array(texts, pa.large_string()))
    for a, b in slices(offsets):
        blocks = list(features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        for d in range(b - a):
            ids, n = np.unique(np.concatenate([x[at[d] : at[d + 1]] for x, at in blocks]), return_counts=True)
            yield ids, (n / max(1, n.sum())).astype(np.float32)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE) -> Classifier:
    """Plain stochastic gradient descent, one document a step, the rate falling to nothing. The features of CHUNK documents are
    held at a time, and found again in each epoch."""
    if not texts:
        return Classifier(np.zeros(BUCKETS + GAPS), 0.0)
    rng = np.random.default_rng(SEED)
    every = rng.permutation(len(texts))
    chunks = [every[k : k + CHUNK] for k in range(0, len(every), CHUNK)]
    y = np.array(labels) > 0
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + GAPS, DIM)).astype(np.float32)
    output = rng.uniform(-1 / DIM, 1 / DIM, (DIM, 2)).astype(np.float32)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = np.log([1 - share, share]).astype(np.float32)
    step, steps = 0, epochs * len(texts)
    for _ in range(epochs):
        for c in rng.permutation(len(chunks)):
            chunk = rng.permutation(chunks[c])
            for d, (ids, weight) in zip(chunk, weighed([texts[d] for d in chunk])):
                now = rate * (1 - step / steps)
                step += 1
                rows = vectors[ids]
                mean = weight @ rows
                out = mean @ output + bias
                p = np.exp(out - out.max())
                p /= p.sum()
                p[int(y[d])] -= 1
                back = output @ p
                output -= 0.1 * now * np.outer(mean, p)
                bias -= 0.01 * now * p
                # a feature's own rate: the gradient is its share of the text, so rare ones are lifted by the root
                vectors[ids] = rows - (now * np.sqrt(weight))[:, None] * back
    return Classifier((vectors @ (output[:, 1] - output[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, learn: str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Classifier:
    """A classifier from the labelled rows of docs for which the SQL condition `learn` on id_col holds."""
    rows = labels.filter(f"({learn}) and {id_col} is not null and {label_col} is not null")
    rows = rows.groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).alias("y")).withColumn("h", F.xxhash64(F.col("i").cast("string")))
    n = rows.count()
    part = F.pmod("h", F.lit(1_000_003)) < int(1_000_003 * min(1.0, 1.2 * train_docs / max(n, 1))) + 1
    picked = rows.filter(part).limit(2 * train_docs)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter(F.col("t") != "")
    # lengths first, so that no more text than the bound comes to the driver; rows that share an id count once
    sizes = texts.select("i", F.octet_length("t").alias("n")).join(F.broadcast(picked), "i").groupBy("i", "h", "y").agg(F.max("n").alias("n")).collect()  # 2 * train_docs at most
    chosen, size = [], 0
    for r in sorted(sizes, key=lambda r: (r.h, str(r.i))):
        if len(chosen) < train_docs and size + r.n <= train_bytes:
            size += r.n
            chosen.append((r.i, r.h, r.y))
    if not chosen:
        return train([], [])
    wanted = docs.sparkSession.createDataFrame(chosen, f"i {dict(labels.dtypes)[id_col]}, h long, y {dict(labels.dtypes)[label_col]}")
    got = texts.join(F.broadcast(wanted), "i").groupBy("i", "h", "y").agg(F.min("t").alias("t")).collect()
    order = {(r.t, int(r.y)): None for r in sorted(got, key=lambda r: (r.h, r.t))}  # equal texts once a label
    del got
    model = train([t for t, _ in order], [y for _, y in order])
    del order
    give_back()
    return model


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: the id, score (0 to 1) and predicted (1 from threshold on)."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            s = model.value.scores(b.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32))})

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")


def keep_good(docs: DataFrame, model: Classifier, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, whatever their columns, that score threshold or more."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches, at=docs.columns.index(text_col)):
        for b in batches:
            yield b.filter(pa.array(model.value.scores(b.column(at)) >= threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)
