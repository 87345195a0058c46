"""Chat formatting, nearest neighbours, shards, components and the pipeline."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given
from hypothesis import strategies as st

import public_tokenizers

from stratalog.llm import chat, nearest, shards
from stratalog.llm.components import components
from stratalog.llm.tokens import token_bytes

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@example([("<|>", "<|>"), ("<\\|>|>", "\\"), ("|>", "<|end|>")])
@given(st.lists(st.tuples(st.text(alphabet="a<|>\\end/ \n", max_size=12), st.text(alphabet="a<|>\\end/ \n", max_size=20)), max_size=5))
def test_chat_round_trip(turns):
    assert chat.parse("".join(chat.render(r, t) for r, t in turns)) == turns


@pytest.mark.parametrize(("leaves", "chars", "nodes"), [(500, 1_000_000, 200_000), (3, 1_000_000, 200_000), (2, 60, 0), (1, 1, 200_000)])
def test_chat_trees(spark, monkeypatch, leaves, chars, nodes):
    monkeypatch.setattr(chat, "PART_LEAVES", leaves)
    monkeypatch.setattr(chat, "PART_CHARS", chars)
    monkeypatch.setattr(chat, "BROADCAST_NODES", nodes)
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|end|>"), (2, 0, "user", "hi"), (2, 1, "assistant", "<|end|>"), (2, 2, "user", None), (3, 0, None, "\\<|"), (None, 0, "assistant", "x"), (4, 5, "assistant", "b"), (4, 5, "assistant", "b"), (4, 1, "assistant", "a")]
    rows += [(100 + k, 0, "user", "hi") for k in range(20)]
    rows += [(200 + k, t, r, x) for k in range(12) for t, r, x in ((0, "user", "hi"), (1, "assistant", f"é {k % 3} <|endoftext|>"), (2, "endoftext", "日本 " * (k % 4)), (3, "assistant", f"🙂{k // 2}"))]
    rows += [(300, t, "assistant", f"t{t}") for t in range(30)]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, node string")
    written = chat.trees(table, TOKENIZER)
    trees, decoded = written.collect(), token_bytes(TOKENIZER)
    got = {r.conv_id: r for r in chat.read_back(written, TOKENIZER).collect()}
    assert len(got) == len({r[0] for r in rows})
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == c))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == digest("".join(f"{r}\n{x}\n" for _, r, x in own))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), digest(loss))
        assert got[c].formatted_chars == sum(len(chat.render(r, x)) for _, r, x in own)
    text = lambda t, a, b: b"".join(decoded[i] for i in t.ids[a:b]).decode()
    trunks = {t.root: {n.node: n for n in t.nodes} for t in trees if t.part == 0}
    for t in trees:
        for k, n in enumerate(t.nodes):  # spans tile the ids, parents come first, positions count from the root
            assert n.start == (t.nodes[k - 1].stop if k else 0) and n.parent < k
            up = n if n.parent < 0 else t.nodes[n.parent]
            while up.parent >= 0:
                up = t.nodes[up.parent]
            hung = trunks[t.root][up.link] if up.link else None
            assert n.position == sum(b - a for a, b in zip(n.attends[::2], n.attends[1::2])) + (hung.position + hung.stop - hung.start if hung else 0)
            assert t.positions[n.start : n.stop] == list(range(n.position, n.position + n.stop - n.start))
            # the mask is the text of an assistant turn, and nothing else
            (role, said), mask = chat.parse(text(t, n.start, n.stop))[0], text(t, n.loss_start, n.loss_stop)
            assert role == n.role and chat.unescape(mask) == (said if role == "assistant" else "")
        assert not t.nodes or t.nodes[-1].stop == len(t.ids)
    assert len({n.node for t in trees for n in t.nodes}) == sum(len(t.nodes) for t in trees)  # every shared turn stands once
    prefixes = {tuple((r or "", x or "") for _, _, r, x in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))[:n]) for c in {r[0] for r in rows} for n in range(1, 31)}
    assert sum(len(t.nodes) for t in trees) == len(prefixes)
    assert chat.read_back(chat.trees(table.limit(0), TOKENIZER), TOKENIZER).count() == 0
    assert (max(t.parts for t in trees) > 1) == (leaves < 500)


def test_nearest_finds_the_largest_products(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (600, 10))
    x[5] = x[4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, []), (1040, [0.0] * 10), (1060, [math.nan] + [1.0] * 9), (1080, [None] + [1.0] * 9), (None, [1.0] * 10), (1100, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = nearest.search(table, "id % 20 = 0").collect()
    assert {g.query_id for g in got} == {*range(0, 600, 20)}
    hit = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:20]
        own = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [k for k, *_ in own] == list(range(1, 21))
        assert all(b == pytest.approx(s[v], rel=1e-12) for _, v, b in own) and own == sorted(own, key=lambda o: (-o[2], o[1]))
        hit += len({v for _, v, _ in own} & set(best.tolist()))
    assert hit >= 0.9 * 20 * 30
    few = nearest.search(spark.createDataFrame([(0, [1.0]), (20, [2.0]), (3, [2.0])], "vec_id long, embedding array<float>"), "id % 20 = 0").collect()
    assert sorted((g.query_id, g.rank, g.vec_id) for g in few) == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    assert nearest.search(table.limit(0), "id % 20 = 0").count() == 0


def test_nearest_keeps_ties_and_neighbours_beside_copies(spark):
    r = np.random.default_rng(6)
    x = r.normal(0, 1, (1500, 16))
    x[r.permutation(1500)[:500]] = x[7]  # copies
    near = r.permutation(1500)[:400]
    x[near] = x[9] + r.normal(0, 1e-6, (400, 16))  # all of one code
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for g in nearest.search(table, "id % 50 = 0 or id in (7, 9)", rerank=30).collect():
        got.setdefault(g.query_id, []).append((g.rank, g.vec_id))
    for q in (*range(0, 1500, 50), 7, 9):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        assert [v for _, v in sorted(got[q])] == np.lexsort((np.arange(1500), -s))[:20].tolist(), q


@pytest.mark.parametrize("exact", [False, True])
def test_recall_of_the_codes(exact):
    """100 of 3000 vectors are scored exactly; with `exact` the result is that of brute force."""
    r = np.random.default_rng(12)
    x = r.normal(0, 1, (3000, 32))
    quantiser = nearest.Quantiser(x[:1000])
    codes = quantiser.encode(x)
    packed, errors, one = quantiser.packed(codes), quantiser.error(x, codes), np.ones(3000, np.int64)
    hit = 0
    for q in range(0, 3000, 100):
        order = np.lexsort((np.arange(3000), -(x * x[q]).sum(1)))
        best = order[order != q][:20].tolist()
        own, _ = nearest.best_of(x[q], q, 20, 100, np.arange(3000), one, x, quantiser, packed, errors if exact else None)
        hit += len(set(best) & set(own.tolist()))
        assert not exact or own.tolist() == best
    assert hit >= 0.95 * 20 * 30


def test_recall_of_the_codes_over_blocks_with_copies(spark, monkeypatch):
    """Many blocks; a third of the rows are copies of one vector, a quarter near copies of another, more of these than are scored for other vectors."""
    monkeypatch.setattr(nearest, "BLOCK", 700)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 16)
    monkeypatch.setattr(nearest, "MOST_TASKS", 5)
    r = np.random.default_rng(6)
    x = r.normal(0, 1, (4000, 24))
    x[r.permutation(4000)[:1300]] = x[7]
    near = r.permutation(4000)[:1000]
    x[near] = x[9] + r.normal(0, 1e-6, (1000, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for g in nearest.search(table, "id % 50 = 0 or id in (7, 9)", exact=False).collect():
        got.setdefault(g.query_id, []).append((g.rank, g.vec_id))
    hit = 0
    for q in (*range(0, 4000, 50), 7, 9):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(4000), -s))[:20].tolist()
        own = [v for _, v in sorted(got[q])]
        assert len(own) == 20
        hit += len(set(own) & set(best))
    assert hit >= 0.98 * 20 * 82


def test_recall_over_several_blocks(spark, monkeypatch):
    """Many blocks of vectors and of queries, so that their results are merged; copies over several blocks."""
    monkeypatch.setattr(nearest, "BLOCK", 128)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 7)
    r = np.random.default_rng(3)
    x = r.normal(0, 1, (1200, 24))
    x[r.permutation(1200)[:60]] = x[40]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for g in nearest.search(table, "id % 20 = 0").collect():
        got.setdefault(g.query_id, []).append((g.rank, g.vec_id))
    assert len(got) == 60
    for q in range(0, 1200, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1200), -s))[:20].tolist()
        own = [v for _, v in sorted(got[q])]
        assert len(own) == 20 and len(set(own) & set(best)) >= 18, q  # 0.9 for each query


def test_shards_keep_columns_of_any_name(spark, tmp_path):
    """Also those that compaction might use itself; each row keeps the version that added it."""
    at = shards.ShardedTable(spark, str(tmp_path / "t"), fan=2)
    for k in range(3):
        at.append(spark.createDataFrame([(k, f"mine{k}", f"by{k}", f"m{k}", f"d{k}")], "doc_id long, _file string, _by string, _metadata string, `a.b ``c` string").coalesce(1))
    at.compact()
    assert len(at.manifest()["files"]) < 3
    assert sorted(tuple(r) for r in at.read(lineage=True).collect()) == [(k, f"mine{k}", f"by{k}", f"m{k}", f"d{k}", k + 1) for k in range(3)]


def test_shards_compact_without_loss(spark, tmp_path, docs):
    table = docs([None, "", "a", "a", *[f"text {i} " * 50 for i in range(400)]], [None, 1, 1, 2, *range(10, 410)])
    at, rows = shards.sharded(table, str(tmp_path / "t"), arrivals=6, target_bytes=1 << 20)
    assert sorted(map(str, rows.drop(shards.ADDED).collect())) == sorted(map(str, table.collect()))
    assert {(r.doc_id, r[shards.ADDED]) for r in rows.collect()} == {(r.doc_id, 1 + (r.doc_id or 0) % 6) for r in table.collect()}
    files = at.manifest()["files"]
    assert len(files) == 1 and at.versions() == [at.manifest()["version"]]
    before = at.manifest()["version"]
    for k in range(4):
        at.append(table.limit(3))
    assert len(at.manifest()["files"]) >= 5
    at.compact()
    assert len(at.manifest()["files"]) < 4 and at.manifest()["version"] > before
    assert at.read().count() == 404 + 12
    assert at.read(before).count() == 404  # an older version stays readable until it is vacuumed
    at.vacuum()
    assert at.versions() == [at.manifest()["version"]] and at.read().count() == 416
    none = shards.ShardedTable(spark, str(tmp_path / "e"))
    none.append(table.limit(0))
    none.compact()
    assert none.read().count() == 0


def test_a_version_is_taken_once(spark, tmp_path, docs):
    a, b = (shards.ShardedTable(spark, str(tmp_path / "c")) for _ in range(2))
    a.append(docs(["x"]))
    late = []

    def change(old, version):
        if not late:  # another writer commits between reading and publishing
            late.append(b.append(docs(["y"])))
        return old

    assert a._commit(change) == 3 and late == [2] and a.read().count() == 2


def test_publishing_is_contended(spark, tmp_path, docs):
    """The step that gives a version its name, by many at once: one gets each number, and no row is lost."""
    from concurrent.futures import ThreadPoolExecutor

    a = shards.ShardedTable(spark, str(tmp_path / "c"))
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda k: a.append(docs([f"x{k}"])), range(16)))
    assert sorted(got) == list(range(1, 17)) and {r.text for r in a.read().collect()} == {f"x{k}" for k in range(16)}
    assert {(r.text, r[shards.ADDED]) for r in a.read(lineage=True).collect()} == {(f"x{k}", v) for k, v in enumerate(got)}
    final, names = a._path("manifest/v%010d.json" % 99), [a._path(f"manifest/.t{k}") for k in range(8)]
    for n in names:
        a._fs.create(n, False).close()
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda n: a._publish(n, final), names)) == 1


def test_lost_races_and_failed_writes_leave_nothing(spark, tmp_path, docs):
    import os

    a, b = (shards.ShardedTable(spark, str(tmp_path / "c"), fan=2) for _ in range(2))
    for k in range(4):
        a.append(docs([f"x{k}"]))
    real = a._written

    def late(df):  # another writer compacts while this one merges
        out = real(df)
        a._written = real
        b.compact()
        return out

    a._written = late
    a.compact()
    assert a.versions() == [1, 2, 3, 4, 5] and {r.text for r in a.read().collect()} == {f"x{k}" for k in range(4)}
    a._written(docs(["orphan"]).coalesce(1))  # a write that is never committed
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "c" / "data") for f in fs if f.endswith(".parquet")}
    a.vacuum()
    assert len(files()) == 2  # within the grace period it stays
    a.vacuum(grace_seconds=-10)
    assert len(files()) == 1 == len(a.manifest()["files"]) and a.read().count() == 4


def test_components(spark):
    edges = [(1, 2), (3, 2), (4, 3), (9, 8), (7, 7), *[(k, k + 1) for k in range(20, 40)]]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(2, 1), (3, 1), (4, 1), (9, 8), *[(k, 20) for k in range(21, 41)]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    assert [k for k, _ in p.STAGES] == ["language_id", "quality_classifier", "near_dedup", "decontamination", "best_fit_packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        assert docs.count() <= n
        n = docs.count()
    packed = p.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count() > 50


def _plain_pipeline(rows: list, labels: list, bench: list, models) -> list[int]:
    """The first four stages over rows (doc_id, text, ...), one after another, each document by itself or against all others."""
    judge, scores = models(None)
    kept = [r for r in rows if (lambda found: found[0][0] != "und" and found[2][0] <= 4.0)(judge.judge([r.text]))]
    quality_scores = scores(kept)
    kept = [r for r, s in zip(kept, quality_scores) if s >= 0.3]
    words = [re.findall(r"[^\x20\x09-\x0d]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)})) for r in kept]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    root = list(range(len(kept)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(kept)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                if kept[x].doc_id > kept[y].doc_id:
                    x, y = y, x
                root[y] = x
    kept = [r for i, r in enumerate(kept) if find(i) == i]
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {tuple(w[i : i + 10]) for t in bench if (w := split(t)) for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    dirty = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    return [r.doc_id for r in kept if not dirty(split(r.text))]


def test_pipeline_equals_a_plain_one(spark):
    import corpus_pipeline as p
    import public_tokenizers
    from stratalog.llm import language, quality
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs, labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))

    def models(_):
        judge = language.fit(docs, "crc32(cast(doc_id as string)) % 4 <> 2")

        def scores(kept):
            own = spark.createDataFrame(kept, docs.schema)
            model = quality.fit(own, labels, "crc32(cast(doc_id as string)) % 5 <> 0")
            return [model.scores(pa.array([r.text], pa.string()))[0] for r in kept]

        return judge, scores

    want = _plain_pipeline(docs.collect(), labels.collect(), [r.text for r in bench.collect()], models)
    packed = p.run(spark, sf).collect()
    assert sorted({r.doc_id for r in packed}) == sorted(want)
    tokenizer, texts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {r.doc_id: r.text for r in docs.collect()}
    lengths, bins = {}, {}
    for r in packed:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert lengths == {d: len(tokenizer.encode(texts[d], add_special_tokens=False).ids) + 1 for d in want}
    for own in bins.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:])) and sum(n for _, n in own) <= 1024
    assert len(bins) <= -(-sum(lengths.values()) // 1024) + 1


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        (df.limit(0) if t == "documents" else df).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_queries_agree_with_sql(spark):
    from stratalog.llm import queries
    from tests.oracle import differences

    for name, sql in queries.oracle_sql().items():
        assert not differences(spark, queries.queries()[name], sql, "/root/testdata/sf0.001")
