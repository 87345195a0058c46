"""Maximum inner product search: score-aware anisotropic product quantisation, four-bit scans, exact rerank.

A vector is cut into subspaces of DIMS numbers, each replaced by one of 16 codewords. Codebooks and codes
minimise the residual with its part parallel to the vector weighed ETA times (that part is what disturbs
large inner products), by coordinate descent over subspaces and a weighted least-squares update of the
codewords. They are learned from a bounded sample (SAMPLE vectors, picked by a hash of the id); every row
is indexed. Two neighbouring codes form a byte, so a query needs one table of 256 partial products for
every two subspaces and one look-up in it per vector.

Queries and vectors are packed into blocks, every block of queries meets every block of vectors of the same
length. A block holds equal vectors once, with all their ids. A meeting scores exactly, in double precision, all vectors of its
RERANK best products by the codes; those that the codes don't tell apart, such as near copies, count as one there, and
copies and ties are told apart by their ids. With `exact` it goes on to every other one whose
product by the codes, with the most that its residual can add, reaches the k-th row so far; then nothing of the result is lost to
the codes, but most vectors are scored where residuals are long. A
query's results of all meetings are merged by rank. Work is the product of both, memory that of two blocks; a vector is
sent once for every QUERY_BLOCK queries.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without
an id, take no part as query or candidate; a candidate with the query's own id isn't one; repeated ids are
candidates each; vectors of different lengths don't meet; fewer than k candidates give as many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.shared import written

DIMS, CODES, ETA, SAMPLE, ROUNDS = 2, 16, 4.0, 8192, 6
BLOCK, QUERY_BLOCK, RERANK = 8192, 8192, 100
#: tasks that meetings are dealt to at most; one goes through its meetings one after another
MOST_TASKS = 10_000


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    own = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null and size(v) > 0")
    return own.filter("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)").withColumn("dim", F.size("v"))


class Quantiser:
    def __init__(self, sample: np.ndarray, eta: float = ETA, rounds: int = ROUNDS, seed: int = 5):
        self.dim, self.eta = sample.shape[1], eta
        self.parts = -(-self.dim // (2 * DIMS)) * 2  # an even number, padded with zeros
        rng = np.random.default_rng(seed)
        x = self._cut(sample)
        self.books = x[rng.integers(0, len(x), CODES)].transpose(1, 0, 2).copy()  # parts x codes x DIMS
        self.books += rng.normal(0, 1e-3, self.books.shape) * x.std()
        unit = self._cut(sample / np.linalg.norm(sample, axis=1, keepdims=True))
        for r in range(rounds):
            codes = self.encode(sample, passes=1 if r else 0)
            self._update(x, unit, codes)

    def _cut(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.parts * DIMS))
        out[:, : self.dim] = x
        return out.reshape(len(x), self.parts, DIMS)

    def encode(self, vectors: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes by least squared residual, then coordinate descent on the anisotropic loss."""
        x = self._cut(vectors)
        unit = self._cut(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
        near = [((x[:, m, None] - self.books[m]) ** 2).sum(2) for m in range(self.parts)]
        codes = np.stack([n.argmin(1) for n in near], 1)
        if passes:
            along = [x[:, m, None] - self.books[m] for m in range(self.parts)]
            along = [(a * unit[:, m, None]).sum(2) for m, a in enumerate(along)]
            row = np.arange(len(x))
            total = sum(along[m][row, codes[:, m]] for m in range(self.parts))
            for _ in range(passes):
                for m in range(self.parts):
                    rest = total - along[m][row, codes[:, m]]
                    codes[:, m] = (near[m] + (self.eta - 1) * (rest[:, None] + along[m]) ** 2).argmin(1)
                    total = rest + along[m][row, codes[:, m]]
        return codes.astype(np.uint8)

    def _update(self, x: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> None:
        row = np.arange(len(x))
        along = [((x[:, m] - self.books[m][codes[:, m]]) * unit[:, m]).sum(1) for m in range(self.parts)]
        total = sum(along)
        for m in range(self.parts):
            rest = total - along[m]
            u, v, c = unit[:, m], x[:, m], codes[:, m]
            outer = u[:, :, None] * u[:, None, :] * (self.eta - 1) + np.eye(DIMS)
            right = v + (self.eta - 1) * u * (rest + (v * u).sum(1))[:, None]
            left_sum, right_sum = np.zeros((CODES, DIMS, DIMS)), np.zeros((CODES, DIMS))
            np.add.at(left_sum, c, outer)
            np.add.at(right_sum, c, right)
            used = np.bincount(c, minlength=CODES) > 0
            self.books[m][used] = np.linalg.solve(left_sum[used], right_sum[used][:, :, None])[:, :, 0]
            along[m] = ((v - self.books[m][codes[row, m]]) * u).sum(1)
            total = rest + along[m]

    def error(self, vectors: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """For each vector, by how much of a query's length scan() can be too low at most, with its rounding."""
        near = self.books[np.arange(self.parts), codes]
        left = np.sqrt(((self._cut(vectors) - near) ** 2).sum((1, 2)))
        return left + (self.parts + 4) * 1.2e-7 * np.sqrt((near**2).sum((1, 2)))

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes a byte, one row per pair of subspaces."""
        return np.ascontiguousarray((codes[:, 0::2] | codes[:, 1::2] << 4).T)

    def scan(self, query: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of a query with the codewords of packed codes."""
        q = self._cut(query[None])[0]
        part = np.einsum("mcd,md->mc", self.books, q)
        table = (part[1::2, :, None] + part[0::2, None, :]).reshape(len(codes), 256).astype(np.float32)
        out = table[0].take(codes[0])
        for t, c in zip(table[1:], codes[1:]):
            out += t.take(c)
        return out


def fit(rows: DataFrame, sample: int = SAMPLE) -> dict[int, Quantiser]:
    """A quantiser for each length of vector in the sample; rows as from usable()."""
    n = rows.count()
    picked = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, 1.2 * sample / max(n, 1))) + 1).limit(2 * sample)
    by: dict[int, list] = {}
    for r in picked.orderBy("id").collect():  # at most 2 * sample rows
        by.setdefault(len(r.v), []).append(r.v)
    return {d: Quantiser(np.array(v)) for d, v in by.items()}


def _blocks(rows: DataFrame, size: int, quantisers, name: str) -> DataFrame:
    """(dim, block, ids, counts, vectors, codes, errors): rows packed by a hash of their id. Where quantisers are
    given, equal vectors are one, with counts of their ids, which follow one another in order, and have codes."""
    n = max(1, -(-rows.count() // size))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, block = key[0].as_py(), key[1].as_py()
        ids, vectors = [], []
        for b in batches:
            ids.append(b.column("id").to_numpy(zero_copy_only=False))
            vectors.append(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        ids, vectors = np.concatenate(ids), np.concatenate(vectors)
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        counts, codes, errors, own = np.ones(len(ids), np.int64), b"", b"", None
        if quantisers:
            vectors, which, counts = np.unique(vectors, axis=0, return_inverse=True, return_counts=True)
            ids = ids[np.argsort(which.reshape(-1), kind="stable")]
            own = quantisers.value.get(dim)
        if own:
            found = own.encode(vectors)
            codes, errors = own.packed(found).tobytes(), own.error(vectors, found).astype("<f8").tobytes()
        yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int64()), "ids": [ids.astype("<i8").tobytes()], "counts": [counts.astype("<i8").tobytes()], "vectors": [vectors.astype("<f8").tobytes()], "codes": [codes], "errors": [errors]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("long"))
    return written(dealt.groupBy("dim", "block").applyInArrow(run, "dim int, block long, ids binary, counts binary, vectors binary, codes binary, errors binary"), name)


def best_of(query: np.ndarray, query_id: int, k: int, rerank: int, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, quantiser: Quantiser | None, codes: np.ndarray | None, errors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and products of a block's k best rows for a query, by product and then id; with errors, all that the codes can't exclude are
    scored."""
    begins = np.cumsum(counts) - counts
    same = np.flatnonzero(ids == query_id)
    free = counts - np.bincount(np.searchsorted(begins, same, "right") - 1, minlength=len(counts)) if len(same) else counts
    # row by row, so that equal vectors have equal products in all blocks
    exact = lambda at: (vectors[at] * query).sum(1)

    def bar(at: np.ndarray, products: np.ndarray) -> float:
        """The product of the k-th row."""
        order = np.argsort(-products)
        rows = np.cumsum(free[at[order]])
        return products[order[np.searchsorted(rows, k)]] if len(rows) and rows[-1] >= k else -np.inf

    most = rerank + len(same)
    if quantiser and len(vectors) > most:
        by_code, n = quantiser.scan(query, codes), most
        at = np.argpartition(by_code, -n)[-n:]
        if errors is None:
            while True:
                at = np.flatnonzero(by_code >= by_code[at].min())
                if n == len(by_code) or len(np.unique(by_code[at])) >= most:
                    break
                n = min(2 * max(n, len(at)), len(by_code))
                at = np.argpartition(by_code, -n)[-n:]
        products = exact(at)
        if errors is not None:
            able = ~(by_code + np.sqrt(query @ query) * errors < bar(at, products))
            able[at] = False
            more = np.flatnonzero(able)
            at, products = np.append(at, more), np.append(products, exact(more))
    else:
        at = np.arange(len(vectors))
        products = exact(at)
    good = products >= bar(at, products)
    at, products = at[good], products[good]
    n = np.minimum(counts[at], k + len(same))  # ids are in order, so further copies can't be among the k
    place = np.repeat(begins[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
    found, products = ids[place], np.repeat(products, n)
    found, products = found[found != query_id], products[found != query_id]
    best = np.lexsort((found, -products))[:k]
    return found[best], products[best]


def search(rows: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int = RERANK, exact: bool = True) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for rows where the SQL condition is_query on `id` holds: as by brute force, or, without `exact`, of what
    the codes bring up."""
    own = usable(rows, id_col, vec_col)
    quantisers = own.sparkSession.sparkContext.broadcast(fit(own))
    data = _blocks(own, BLOCK, quantisers, "index")
    asked = _blocks(own.filter(is_query), QUERY_BLOCK, None, "queries").select("dim", "block", "ids", "vectors")
    n = (asked.agg(F.max("block")).first()[0] or 0) + 1
    # a block of vectors goes once to each block of queries of its length
    meet = data.select("dim", *(F.col(c).alias(f"d_{c}") for c in ("ids", "counts", "vectors", "codes", "errors")), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block"))
    both = meet.join(asked, ["dim", "block"]).select("dim", "d_ids", "d_counts", "d_vectors", "d_codes", "d_errors", "ids", "vectors").repartition(max(1, min(n * data.count(), MOST_TASKS)))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                dim, own = r["dim"], quantisers.value.get(r["dim"])
                ids, vectors = np.frombuffer(r["d_ids"], "<i8"), np.frombuffer(r["d_vectors"], "<f8").reshape(-1, dim)
                q_ids, queries = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vectors"], "<f8").reshape(-1, dim)
                counts, errors = np.frombuffer(r["d_counts"], "<i8"), np.frombuffer(r["d_errors"], "<f8")
                codes = np.frombuffer(r["d_codes"], np.uint8).reshape(-1, len(vectors)) if own else None
                out = []
                for i, q in zip(q_ids, queries):
                    best, products = best_of(q, i, k, rerank, ids, counts, vectors, own, codes, errors if exact else None)
                    out.append((np.full(len(best), i), best, products))
                q, v, s = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
