"""Near-duplicates: fast similarity sketching, banding, exact verification, connected components.

A document's set holds its distinct word shingles. Sketching deals the set's members into `bins` in
rounds: in each of the first `bins` rounds every member falls into a hashed bin and a bin that was empty
keeps the smallest value of the round; in as many further rounds every member falls into one given bin,
so that every coordinate fills, of whatever size the set. Agreement of coordinates estimates the Jaccard
similarity with concentration bounds.

1. Equal sets, by a digest of all their members, form a class (one aggregation); only each class's smallest id goes
   on. An id may stand for several sets, so a set is known by its id and its digest.
2. Bands of coordinates are hashed to buckets. Each id is compared with the smallest id of its buckets.
3. Buckets that still hold several components are searched inside. Sketches are compared in memory; only
   pairs across components that agree on enough coordinates (seven standard deviations below the threshold's
   mean) go on. From buckets of up to SMALL members they are emitted and verified by a join. Larger buckets
   carry the full sets along and verify in place, so only links leave them; a pair is looked at in the first
   bucket that it shares, and not at all once a link has joined its components there. Large buckets are dealt
   out in pairs of blocks, so none lands whole in a task, and rows that one component has already joined don't
   meet again. No cap skips a pair.
Every link is verified on the full sets: 100 * |A and B| >= percent * |A or B|.

Defined cases: null and empty texts and those without words have the empty set and link with nothing;
a text of fewer words than a shingle has one shingle; rows with equal ids count as one document that has
the links of each row; a row whose id is null links with nothing, has no component and is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.batches import SPACED, Words, distinct_sets, mix, slices, utf8
from stratalog.llm.components import components
from stratalog.llm.shared import discard, salted_join, written

BINS, ROWS = 128, 4
SHINGLE, PERCENT = 5, 80
#: ids up to which a lookup table is broadcast (8 bytes each); more are joined by shuffle
BROADCAST_IDS = 1_000_000
SMALL, BLOCK = 64, 512
_EMPTY = np.uint32(0xFFFFFFFF)
PAIR = "a long, ha long, b long, hb long"


def sketch(values: np.ndarray, offsets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """n x bins coordinates of n sets of 64-bit members; those of an empty set are all _EMPTY."""
    n = len(offsets) - 1
    out = np.full(n * bins, _EMPTY, np.uint32)
    filled = np.zeros(n * bins, bool)
    size = np.diff(offsets)
    live = np.flatnonzero(size > 0)
    member = np.repeat(np.arange(n), size)
    values = values[: len(member)]
    for r in range(2 * bins):
        if not len(live):
            break
        x = mix(values ^ mix(np.array([r + 1], np.uint64)))
        v = np.minimum((x >> np.uint64(32)).astype(np.uint32), _EMPTY - np.uint32(1))
        at = member * bins + ((x % np.uint64(bins)).astype(np.int64) if r < bins else r - bins)
        free = ~filled[at]
        at, v = at[free], v[free]
        np.minimum.at(out, at, v)
        filled[at] = True
        full = filled.reshape(n, bins)[live].all(1)
        if full.any():
            live = live[~full]
            keep = np.zeros(n, bool)
            keep[live] = True
            keep = keep[member]
            values, member = values[keep], member[keep]
    return out.reshape(n, bins)


def sets_of(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    words = Words(raw, offsets, SPACED)
    return distinct_sets(*words.shingles(shingle), words.n_docs)


def digests_of(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two numbers for each set, a cryptographic digest of all its sorted members."""
    data = values.tobytes()
    own = b"".join(hashlib.blake2b(data[8 * p : 8 * q], digest_size=16).digest() for p, q in zip(at, at[1:]))
    return np.frombuffer(own, "<i8").reshape(-1, 2)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: id, n (set size), h and h2 (digest of the whole set), mini (a byte per coordinate), bands (bucket keys)."""

    def run(batches):
        for b in batches:
            raw, offsets = utf8(b.column(1))
            for x, y in slices(offsets):
                values, at = sets_of(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], shingle)
                coords, digests = sketch(values, at), digests_of(values, at)
                wide = coords.astype(np.uint64).reshape(y - x, BINS // ROWS, ROWS)
                key = np.broadcast_to(np.arange(BINS // ROWS, dtype=np.uint64), wide.shape[:2])
                for j in range(ROWS):
                    key = mix(key * np.uint64(7) + wide[:, :, j] + np.uint64(1))
                yield pa.RecordBatch.from_pydict({
                    "id": b.column(0).slice(x, y - x).cast(pa.int64()), "n": pa.array(np.diff(at), pa.int64()),
                    "h": pa.array(digests[:, 0]), "h2": pa.array(digests[:, 1]),
                    "mini": pa.FixedSizeBinaryArray.from_buffers(pa.binary(BINS), y - x, [None, pa.py_buffer((coords & np.uint32(255)).astype(np.uint8).tobytes())]).cast(pa.binary()),
                    "bands": pa.ListArray.from_arrays(pa.array(np.arange(y - x + 1) * (BINS // ROWS), pa.int32()), pa.array(key.reshape(-1).view(np.int64))),
                })

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, h long, h2 long, mini binary, bands array<bigint>")


def least_agreement(percent: int) -> int:
    p = percent / 100
    return int(BINS * p - 7 * (BINS * p * (1 - p)) ** 0.5)


def _looked_up(ids: DataFrame) -> DataFrame:
    """ids, broadcast where they are few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _ends(pairs: DataFrame, of: DataFrame, names: dict[str, str]) -> DataFrame:
    """pairs(a, ha, b, hb), written, with columns of both ends, each known by id and h. One end may be in any share of
    the pairs, so both joins are salted."""
    key = lambda i, h: F.struct(F.col(i).alias("i"), F.col(h).alias("h"))
    for end in "ab":
        own = of.select(key("id", "h").alias("_key"), *(F.col(c).alias(f"{new}{end}") for c, new in names.items()))
        pairs = salted_join(pairs.withColumn("_key", key(end, f"h{end}")), own, "_key", F.xxhash64("a", "ha", "b", "hb")).drop("_key")
    return pairs


def _likely(pairs: DataFrame, minis: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and sketches allow a link."""
    both = _ends(pairs, minis, {"n": "n", "mini": "m"})
    both = both.filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "ha", "b", "hb", "ma", "mb")

    def run(batches, least=least_agreement(percent)):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (4, 5))
            yield b.select(["a", "ha", "b", "hb"]).filter(pa.array((x == y).sum(1) >= least))

    return both.mapInArrow(run, PAIR)


def _once(sets: DataFrame, again: DataFrame) -> DataFrame:
    """sets(id, h, ...), one row for each id and h; only the ids in `again` may have more."""
    again = _looked_up(again)
    return sets.join(again, "id", "left_anti").unionByName(sets.join(again, "id", "left_semi").dropDuplicates(["id", "h"]))


def _verified(pairs: DataFrame, texts: DataFrame, again: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (written table) that are links by their full sets, and the written sets that they are read from."""
    ends = pairs.selectExpr("explode(array(struct(a id, ha h), struct(b id, hb h))) e").select("e.*").distinct()
    own = texts.join(_looked_up(ends.select("id").distinct()), "id", "left_semi")
    own = written(_sets(own, shingle).join(_looked_up(ends), ["id", "h"], "left_semi"), "sets")
    both = _ends(pairs, _once(own, again), {"members": "s"}).select("a", "b", "sa", "sb")

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("sa"), b.column("sb"))):
                u, v = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                same = len(np.intersect1d(u, v, assume_unique=True))
                keep[i] = len(u) > 0 and 100 * same >= percent * (len(u) + len(v) - same)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long").distinct(), own


def _parts(batches, names: list[str]):
    """Rows sorted by key and part as numpy columns, whole parts at a time; binary columns become lists."""
    held = None
    for b in _with_end(batches):
        if b is not None:
            cols = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
            held = cols if held is None else {c: np.concatenate([held[c], cols[c]]) for c in cols}
            if not len(held["key"]):
                continue
            # the last part may go on in the next batch
            same = (held["key"] == held["key"][-1]) & (held["part"] == held["part"][-1])
            if same[0]:
                continue
            end = int(np.flatnonzero(~same)[-1]) + 1
            now, held = {c: v[:end] for c, v in held.items()}, {c: v[end:] for c, v in held.items()}
        else:
            now, held = held, None
        if now is not None and len(now["key"]):
            yield now


def _with_end(batches):
    yield from batches
    yield None


def _bytes(column: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def _pairs_inside(members: DataFrame, percent: int) -> DataFrame:
    """members(key, id, h, n, root, mini) of small buckets: pairs across roots that may link."""

    def run(batches, least=least_agreement(percent)):
        for now in _parts(batches, ["key", "part", "id", "h", "n", "root", "mini"]):
            key, ids, h, n, root, mini = (now[c] for c in ("key", "id", "h", "n", "root", "mini"))
            mini = _bytes(mini)
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(begin, len(key)))
            left = (size - 1).repeat(size) - (np.arange(len(key)) - begin.repeat(size))  # rows of the bucket still to come
            step, at, out = 1, np.flatnonzero(left > 0), []
            while len(at):  # every row with the one `step` places on, all buckets at once
                to = at + step
                ok = (root[at] != root[to]) & (100 * np.minimum(n[at], n[to]) >= percent * np.maximum(n[at], n[to]))
                x, y = at[ok], to[ok]
                ok = (mini[x] == mini[y]).sum(1) >= least
                out.append((x[ok], y[ok]))
                step += 1
                at = at[left[at] >= step]
            x, y = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            x, y = np.where(ids[x] >= ids[y], x, y), np.where(ids[x] >= ids[y], y, x)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in (("a", ids[x]), ("ha", h[x]), ("b", ids[y]), ("hb", h[y]))})

    own = members.repartition("key").sortWithinPartitions("key").select("key", F.lit(0).cast("long").alias("part"), "id", "h", "n", "root", "mini")
    return own.mapInArrow(run, PAIR).distinct()


def _links_inside(parts: DataFrame, percent: int) -> DataFrame:
    """parts(key, part, side, id, n, root, mini, bands, members) of large buckets: links across roots, verified."""

    def run(batches, least=least_agreement(percent)):
        names = ["key", "part", "side", "id", "n", "root", "mini", "bands", "members"]
        for now in _parts(batches, names):
            cut = np.flatnonzero(np.append(True, (now["key"][1:] != now["key"][:-1]) | (now["part"][1:] != now["part"][:-1])))
            for a, b in zip(cut, np.append(cut[1:], len(now["key"]))):
                found = list(_search_part({c: v[a:b] for c, v in now.items()}, percent, least))
                yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    own = parts.repartition("key", "part").sortWithinPartitions("key", "part")
    return own.select("key", "part", "side", "id", "n", "root", "mini", "bands", "members").mapInArrow(run, "a long, b long").distinct()


def _search_part(rows: dict, percent: int, least: int):
    key, side, ids, n, root = rows["key"][0], rows["side"], rows["id"], rows["n"], rows["root"].copy()
    mini, bands, sets = _bytes(rows["mini"]), np.stack(rows["bands"]), [np.frombuffer(m, np.uint64) for m in rows["members"]]
    two = bool((side == 1).any())
    band = int(np.flatnonzero(bands[0] == key)[0])
    for i in range(len(ids) - 1):
        j = np.arange(i + 1, len(ids))
        ok = (root[j] != root[i]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        if two:
            ok &= side[j] != side[i]
        j = j[ok]
        if not len(j):
            continue
        j = j[(mini[j] == mini[i]).sum(1) >= least]
        if len(j) and band:
            j = j[~(bands[j, :band] == bands[i, :band]).any(1)]  # else an earlier bucket holds both
        if not len(j):
            continue
        flat = np.concatenate([sets[k] for k in j])
        at = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
        same = np.add.reduceat(sets[i][at] == flat, np.append(0, np.cumsum(n[j])[:-1]), dtype=np.int64)
        for k in j[100 * same >= percent * (n[i] + n[j] - same)]:
            if root[k] != root[i]:
                root[root == root[k]] = root[i]
                yield max(ids[i], ids[k]), min(ids[i], ids[k])


def _dealt(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members(key, count, id, h, root) of open buckets in parts, so that any two members of different roots meet in one.

    The root with most rows of a bucket is its body; two rows of the body needn't meet. What is not body is cut into
    blocks of about BLOCK rows, and so is the body: a part is one block, or two of which one at least isn't body. So
    where nearly all rows are linked already, each is sent once for each block of the few others."""
    roots = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"))
    body = roots.groupBy("key").agg(F.max("rows").alias("in_body"), F.max_by("root", "rows").alias("body"), F.sum("rows").alias("all"))
    blocks = F.ceil((F.col("all") - F.col("in_body")) / BLOCK).cast("int")
    body = written(body.select("key", "body", blocks.alias("rest"), F.ceil(F.col("in_body") / BLOCK).cast("int").alias("own")), "bodies")
    known = members.join(_looked_up(body), "key").withColumn("in_body", F.col("root") == F.col("body"))
    block = F.when(F.col("in_body"), F.col("rest") + F.pmod(F.xxhash64("id", "h"), "own")).otherwise(F.pmod(F.xxhash64("id", "h"), "rest")).cast("int")
    known = known.withColumn("block", block)
    last = F.when(F.col("in_body"), F.col("rest") - 1).otherwise(F.col("rest") + F.col("own") - 1)
    parts = known.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return parts.withColumn("part", low.cast("long") * F.lit(1 << 32) + high).withColumn("side", F.when(F.col("block") == low, 0).otherwise(1)).drop("body", "rest", "own", "in_body", "block", "other"), body


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures of all rows, classes(h, h2, n, rep), roots(node, root) of the classes' representatives)."""
    spark = docs.sparkSession
    sig = written(signatures(docs, id_col, text_col, shingle), "signatures")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    live = sig.filter("n > 0 and id is not null")
    classes = written(live.groupBy("h", "h2", "n").agg(F.min("id").alias("rep")), "classes")
    # rows of one id that hold several sets: the id links the representatives of these
    again = written(live.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("id"), "again")
    own = live.select("id", "h", "h2", "n").join(_looked_up(again), "id", "left_semi").distinct()
    own = own.join(classes, ["h", "h2", "n"]).selectExpr("id a", "rep b").filter("a <> b")
    # from here on a set is known by its smallest id and h
    reps = live.join(classes.withColumnRenamed("rep", "id"), ["id", "h", "h2", "n"], "left_semi")
    minis = written(_once(reps.select("id", "h", "n", "mini", "bands"), again), "sketches")
    members = minis.select("id", "h", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count("id").alias("count"), F.min("id").alias("pivot"), F.min_by("h", "id").alias("ph")).filter("count > 1")
    shared = written(members.join(sizes, "key"), "buckets")

    star = shared.groupBy("id", "h").agg(F.min("pivot").alias("b"), F.min_by("ph", "pivot").alias("hb")).filter("id <> b").selectExpr("id a", "h ha", "b", "hb")
    star = written(star, "star")
    tried = written(_likely(star, minis, percent), "likely")
    linked, first = _verified(tried, texts, again, shingle, percent)
    found = written(linked.unionByName(own), "links")
    roots = components(found)
    now = written(shared.drop("pivot", "ph").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    open_ = now.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("key")
    inside = written(now.join(open_, "key", "left_semi"), "open")
    pairs = _pairs_inside(inside.filter(f"count <= {SMALL}").join(minis.select("id", "h", "n", "mini"), ["id", "h"]), percent)
    pairs = written(pairs.join(tried, ["a", "ha", "b", "hb"], "left_anti"), "likely")
    small, second = _verified(pairs, texts, again, shingle, percent)
    large = inside.filter(f"count > {SMALL}")
    sets = written(_sets(texts.join(_looked_up(large.select("id").distinct()), "id", "left_semi"), shingle), "sets")
    parts, bodies = _dealt(large)
    large = _links_inside(parts.join(minis, ["id", "h"]).join(_once(sets, again), ["id", "h"]), percent)
    more = written(small.unionByName(large).unionByName(roots.selectExpr("node a", "root b")), "links")
    final = components(more)
    discard(spark, shared, star, tried, found, roots, now, inside, pairs, more, minis, again, sets, first, second, bodies)
    return sig, classes, final


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, h, members): the sorted hashes of each text's shingles, and the first number of their digest."""

    def run(batches):
        for b in batches:
            raw, offsets = utf8(b.column("text"))
            for x, y in slices(offsets):
                values, at = sets_of(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], shingle)
                data = values.tobytes()
                yield pa.RecordBatch.from_pydict({"id": b.column("id").slice(x, y - x), "h": pa.array(digests_of(values, at)[:, 0]), "members": pa.array([data[8 * p : 8 * q] for p, q in zip(at, at[1:])], pa.binary())})

    return texts.select("id", "text").mapInArrow(run, "id long, h long, members binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links), kept (it is its own)."""
    sig, classes, roots = links(docs, id_col, text_col, shingle, percent)
    own = sig.select("id", "n", "h", "h2").join(classes, ["h", "h2", "n"], "left")
    to = own.select("id", "n", F.coalesce("rep", "id").alias("rep")).join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "rep"))
    return to.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, whatever their columns, without those whose component has a smaller id; of rows that repeat
    both id and text, one stays."""
    gone = near_duplicates(docs, id_col, text_col, shingle, percent).filter("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(_looked_up(written(gone, "gone")), id_col, "left_anti").select(*docs.columns)
    again = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(id_col)
    if not (again := written(again, "again")).limit(1).count():
        return kept
    once = kept.join(again, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(again, id_col, "left_anti").unionByName(once).select(*docs.columns)
