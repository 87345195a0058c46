"""Committed tables, keyed state, groups dealt over all tasks, journals and hashes, against plain versions."""

import json
import os
import random
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from stratalog.functions import blake3, names
from stratalog.operators import collisions, identity, ranges, similarity, streams
from stratalog.plans import executor, snapshots
from stratalog.plans.catalog import Catalog
from stratalog.plans.store import Store
from stratalog.scratch import save
from stratalog.sources import previews
from stratalog.streaming import keyed, progressive

# the store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, x long, y string")


def test_changes_appear_together(spark, store):
    store.begin().append("a", _rows(spark, ("1", 1, "p"), ("2", 2, None))).append("b", _rows(spark, ("1", 9, "q"))).commit()
    change = store.begin().append("a", _rows(spark, ("3", 3, "r"))).delete("b", spark.createDataFrame([("1",)], "id string"))
    assert store.read("a").count() == 2 and store.read("b").count() == 1  # written, not committed
    assert change.commit() == 2
    assert sorted(r.id for r in store.read("a").collect()) == ["1", "2", "3"] and store.read("b").count() == 0
    assert store.read("a", version=1).count() == 2 and store.read("b", version=1).count() == 1
    with pytest.raises(LookupError):
        store.read("none")


def test_writers_that_die_leave_nothing(spark, store, monkeypatch):
    store.begin().append("a", _rows(spark, ("1", 1, "p"))).commit()
    with monkeypatch.context() as m:
        m.setattr(Store, "_named", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.begin().append("a", _rows(spark, ("2", 2, "q"))).append("b", _rows(spark, ("2", 2, "q"))).commit()
    assert [r.id for r in store.read("a").collect()] == ["1"] and store.versions() == [1]
    with pytest.raises(LookupError):
        store.read("b")
    left = lambda: len(os.listdir(f"{store.root}/data/a"))
    assert left() == 2
    store.vacuum(grace_seconds=3600)
    assert left() == 2
    store.vacuum(grace_seconds=-1)
    assert left() == 1 and store.read("a").count() == 1


def test_racing_writers_get_ids_of_their_own(spark, tmp_path):
    root = str(tmp_path / "store")
    outcome = lambda k: spark.createDataFrame([(i, f"/o{k}/{i}") for i in (30, 10, 20)], "ordinal long, path string")
    changes = [Store(spark, root).begin().append("items", outcome(k), {"record_id": f"r{k}"}, "id", ["ordinal"]) for k in range(4)]
    barrier, done = threading.Barrier(4), []

    def commit(c):
        barrier.wait()
        done.append(c.commit())

    threads = [threading.Thread(target=commit, args=(c,)) for c in changes]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(done) == [1, 2, 3, 4]
    rows = Store(spark, root).read("items").orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, 13))
    for k in range(0, 12, 3):  # each writer's in input order, next to each other
        assert [r.ordinal for r in rows[k : k + 3]] == [10, 20, 30] and len({r.path[:3] for r in rows[k : k + 3]}) == 1


def test_merged_on_read_and_compacted(spark, store):
    """Updates and deletes hold for rows of earlier commits only, the latest per column; the same after compaction, also with changes committed meanwhile."""
    keys = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    store.begin().append("a", _rows(spark, ("1", 1, "p"), ("2", 2, "p"), ("3", 3, "p"), (None, 4, "p")), {"t": "u"}).commit()
    store.begin().update("a", ["id"], spark.createDataFrame([("1", 10, "n1"), ("2", None, "n1")], "id string, x long, y string")).commit()
    store.begin().update("a", ["id"], spark.createDataFrame([("1", "n2"), ("9", "n2")], "id string, y string")).commit()
    store.begin().delete("a", keys("3", None)).append("a", _rows(spark, ("3", 33, "late"), ("1", 11, "late"))).commit()
    want = [(None, 4, "p"), ("1", 10, "n2"), ("1", 11, "late"), ("2", None, "n1"), ("3", 33, "late")]
    got = lambda v=None: sorted(map(tuple, store.read("a", v).collect()), key=str)
    assert got() == sorted(want, key=str)
    files = set(os.listdir(f"{store.root}/data/a"))
    own = Store(spark, store.root)
    first = own._merged
    meanwhile = []

    def merged(*a):
        if not meanwhile:
            meanwhile.append(store.begin().update("a", ["id"], spark.createDataFrame([("2", "x")], "id string, y string")).delete("a", keys("3")).commit())
        return first(*a)

    own._merged = merged
    assert own.compact("a") == 6
    want = [(None, 4, "p"), ("1", 10, "n2"), ("1", 11, "late"), ("2", None, "x")]
    assert got() == sorted(want, key=str)
    t = store.manifest()["tables"]["a"]
    assert len(t["rows"]) == 2 and len(t["deletes"]) == len(t["updates"]) == 1
    assert files <= set(os.listdir(f"{store.root}/data/a"))  # nothing was rewritten in place
    store.compact("a")
    assert got() == sorted(want, key=str) and not store.manifest()["tables"]["a"]["deletes"]
    assert got(4) == sorted([(None, 4, "p"), ("1", 10, "n2"), ("1", 11, "late"), ("2", None, "n1"), ("3", 33, "late")], key=str)


def test_columns_are_added_and_not_changed(spark, store):
    store.begin().append("a", _rows(spark, ("1", 1, "p"))).commit()
    store.begin().append("a", spark.createDataFrame([("2", 2.5)], "id string, z double")).commit()
    assert sorted(map(tuple, store.read("a").collect())) == [("1", 1, "p", None), ("2", None, None, 2.5)]
    with pytest.raises(TypeError):
        store.begin().append("a", spark.createDataFrame([(1,)], "id long")).commit()
    with pytest.raises(ValueError):
        store.begin().append("a", spark.createDataFrame([(1,)], "__entry long"))


def test_purge_touches_no_files_of_snapshots(spark, store):
    catalog = Catalog(store)
    entries = lambda *paths: spark.createDataFrame([("h" + p, p, 1, 5, None, "active") for p in paths], "hash string, file_path string, file_size long, mtime long, ctime long, status string")
    for i, r in enumerate(["1e1", "10", "007", "2024-01-01"]):
        catalog.save_snapshot(r, f"n{r}", i, ["/a"], entries("a", "b", r))
    before = {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, ns in os.walk(f"{store.root}/data/hash_entries") for n in ns}
    items = spark.createDataFrame([("a", "/x/a", True, None, None, 3), ("b", "/x/b", False, "MOVE_FAILED", "no", 4)], "src_path string, dst_path string, success boolean, error_code string, error_message string, size long")
    catalog.save_move("m", "t", 9, "/x", items)
    after = {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, ns in os.walk(f"{store.root}/data/hash_entries") for n in ns}
    assert before.items() <= after.items()
    assert [(r.record_id, r.entry_count) for r in catalog.snapshots().collect()] == [("2024-01-01", 2), ("007", 2), ("10", 2), ("1e1", 2)]
    assert sorted(r.file_path for r in catalog.load_snapshot("10").collect()) == ["10", "b"] and {r.ctime for r in catalog.load_snapshot("10").collect()} == {5}
    (report,) = store.read("move_reports").collect()
    assert (report.total_selected, report.total_success, report.released_bytes) == (2, 1, 3) and store.read("move_report_items").count() == 2
    catalog.rename_snapshot("007", " x ")
    catalog.delete_snapshot("1e1")
    assert {(r.record_id, r.record_name) for r in catalog.snapshots().collect()} == {("2024-01-01", "n2024-01-01"), ("007", "x"), ("10", "n10")}
    assert {r.record_id for r in store.read("hash_entries").collect()} == {"2024-01-01", "007", "10"}
    for bad, error in ((lambda: catalog.rename_snapshot("007", " "), ValueError), (lambda: catalog.rename_snapshot("1e1", "y"), LookupError), (lambda: catalog.save_snapshot("10", "", 0, [], entries("z")), ValueError)):
        with pytest.raises(error):
            bad()


def test_snapshot_ids_stay_text(spark, tmp_path):
    """Also in folders by record."""
    rows = [("1e1", "a"), ("10", "b"), ("007", "c"), ("2024-01-01", "d")]
    snapshots.save(spark, str(tmp_path), spark.createDataFrame([(r,) for r, _ in rows], "record_id string"), spark.createDataFrame(rows, "record_id string, hash string"))
    records, entries = snapshots.read(spark, str(tmp_path))
    assert sorted((r.record_id, r.hash) for r in entries.collect()) == sorted(rows)
    assert [r.hash for r in entries.filter("record_id = '10'").collect()] == ["b"]


# keyed state


def test_keyed_groups(spark, tmp_path):
    """A trigger needs nothing of earlier ones but the state: their files and emissions are gone when the query goes on."""
    at = str(tmp_path)
    schema = "id long, k string, t long"
    r, rows, emitted = random.Random(4), [], []

    def arrive(n: int, part: list[tuple]) -> None:
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{at}/in/{n}")

    def go_on() -> None:
        found = keyed.touched(progressive.read(spark, f"{at}/in/*", schema, 1), ["k"], "id", ["t"], least=3)
        keyed.start(found, keyed.changes_into(f"{at}/out"), f"{at}/state").awaitTermination()

    for n in range(3):
        part = [(n * 100 + i, r.choice("abcdef") if r.random() < 0.9 else None, r.choice([None, *range(50)])) for i in range(12)]
        part += [(1000 + n, f"lone{n}", 1)] + r.sample(rows, min(len(rows), 6))  # some come again
        rows += [p for p in part if p not in rows]
        arrive(n, part)
        if n:
            os.rename(f"{at}/in/{n - 1}", f"{at}/gone{n}")
        go_on()
        emitted += [tuple(x) + (n,) for x in spark.read.parquet(f"{at}/out").collect() if x.batch == n]
        groups = {}
        for i, k, t in rows:
            groups.setdefault(k, []).append((t is None, t, i))
        want = {k: (len(g), min(g)[2]) for k, g in groups.items() if len(g) >= 3}
        touched = {p[1] for p in part if p in rows}
        got = {x.k: (x.n, x.kept) for x in keyed.headers(spark, f"{at}/out", ["k"]).collect()}
        assert got == want and {x.k for x in keyed.headers(spark, f"{at}/out", ["k"], n).collect()} <= touched
        members = [(x.id, x.k, x.t) for x in keyed.members(spark, f"{at}/out", ["k"]).collect()]
        assert sorted(members, key=str) == sorted((p for p in rows if p[1] in want), key=str)
    # every member once, however many triggers
    ids = [x[4] for x in emitted if x[0] == keyed.MEMBER]
    assert len(ids) == len(set(ids))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != keyed.PROVIDER


def test_keyed_trigger_run_again(spark, tmp_path):
    """A sink that fails after it has written leaves the state as before the trigger; the trigger replaces what it had emitted."""
    at, schema = str(tmp_path), "id long, k string"
    for n in range(3):
        spark.createDataFrame([(n * 2, "a"), (n * 2 + 1, "b")], schema).coalesce(1).write.parquet(f"{at}/in/{n}")
    sink, fails = keyed.changes_into(f"{at}/out"), [True]

    def once(batch, number):
        sink(batch, number)
        if number == 1 and fails:
            fails.clear()
            raise RuntimeError("lost")

    def go_on():
        found = keyed.touched(progressive.read(spark, f"{at}/in/*", schema, 1), ["k"], "id", ["id"], newest=True)
        return keyed.start(found, once, f"{at}/state")

    with pytest.raises(Exception):
        go_on().awaitTermination()
    go_on().awaitTermination()
    assert {(x.k, x.n, x.kept) for x in keyed.headers(spark, f"{at}/out", ["k"]).collect()} == {("a", 3, 4), ("b", 3, 5)}
    assert sorted(x.id for x in keyed.members(spark, f"{at}/out", ["k"]).collect()) == list(range(6))


def test_tasks_wait_and_end(spark, tmp_path):
    """A paused task's trigger waits; a cancelled one's isn't carried out and comes again. A name is active until its end."""
    task = progressive.Task.start("t")
    with pytest.raises(ValueError):
        progressive.Task.start("t")
    seen, through = [], threading.Event()
    sink = task.guarded(lambda batch, number: (seen.append(number), through.set()))
    sink(None, 0)
    task.pause()
    through.clear()
    t = threading.Thread(target=sink, args=(None, 1))
    t.start()
    assert not through.wait(0.3) and seen == [0]
    task.resume()
    t.join(5)
    assert seen == [0, 1]
    task.pause(), task.cancel(), task.resume()
    assert task.state == "cancelled"  # for good
    with pytest.raises(progressive.Cancelled):
        sink(None, 2)
    assert progressive.Task.find("t") is task
    task.end()
    assert progressive.Task.find("t") is None and progressive.Task.start("t").name == "t"
    progressive.Task.find("t").end()
    assert progressive.Task.start().name != progressive.Task.start().name


# trees


def test_tree_by_rounds(spark, tmp_path):
    """A folder with many folders below it and a deep chain give the rows of the plain walk; unreadable folders are kept, several roots apart."""
    for k in range(60):
        os.makedirs(tmp_path / f"a/w{k}/x")
        (tmp_path / f"a/w{k}/x/f").write_text("1" * k)
    deep = tmp_path / "b"
    for k in range(25):
        deep = deep / f"d{k}"
    os.makedirs(deep)
    (deep / ".hidden").write_text("h")
    os.symlink(tmp_path / "a", tmp_path / "b/link")
    from stratalog.sources import fswalk

    roots = [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "none")]
    rows = lambda df: sorted((r.path, r.is_dir, r.readable, r.size, r.mtime, r.root, r.error) for r in df.collect())
    want = rows(fswalk.walk(spark, roots))
    for budget in (7, 1000):
        assert [str(x) for x in rows(fswalk.walk_wide(spark, roots, save, budget=budget))] == [str(x) for x in want]
    assert fswalk.walk_wide(spark, [str(tmp_path / "none")], save).count() == 0


def test_tree_stream_reads_files_once(spark, tmp_path):
    """Files that come between triggers, also old ones moved in, and after a restart; a few a trigger."""
    from stratalog.sources import fswalk

    at, out = tmp_path / "t", str(tmp_path / "out")
    os.makedirs(at / "s")

    def go_on(**options) -> None:
        stream = fswalk.stream(spark, [str(at)], settle_ms=1, **options).select("path", "size")
        progressive.start(stream, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "state"), "append").awaitTermination()

    for k in range(5):
        (at / f"s/{k}").write_text("x" * k)
    go_on()
    (tmp_path / "old").write_text("old")
    os.utime(tmp_path / "old", (5, 5))
    os.rename(tmp_path / "old", at / "old")
    go_on()
    for k in range(5, 12):
        (at / f"s/{k}").write_text("x" * k)
    for _ in range(4):
        go_on(files_per_trigger=2)
    got = [os.path.basename(r.path) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(["old", *map(str, range(12))])


def test_clusters_as_files_come(spark, tmp_path):
    """Equal to the sequential rule in the order of arrival, over triggers of random, chained and equal signatures."""
    from stratalog.streaming import clusters

    r = random.Random(9)
    x, own = r.getrandbits(64), []
    for i in range(90):
        x ^= sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        own.append((i, [_signed(x if r.random() < 0.7 else 77)]))
    r.shuffle(own)
    sink = clusters.clusters_into(str(tmp_path), 7, 64, ["place"], save)
    for n in range(3):
        batch = spark.createDataFrame([(place, name, words) for place, (name, words) in enumerate(own[n * 30 : n * 30 + 30])], "place long, name long, words array<long>")
        sink(batch, n)
        if n == 1:
            sink(batch, n)  # run again
    got = {x.name: (x.head, x.head_distance, x.ordinal) for x in clusters.clustered(spark, str(tmp_path)).collect()}
    files = spark.createDataFrame([(i, w, 1) for i, (_, w) in enumerate(own)], "ordinal long, words array<long>, g int")
    order = {o: i for i, o in enumerate(sorted(v[2] for v in got.values()))}
    want = {own[x.ordinal][0]: (x.head, x.head_distance, x.ordinal) for x in similarity.exact_leaders(files, 7, "g").collect()}
    assert {k: (order[h], d, order[o]) for k, (h, d, o) in got.items()} == want


# collisions


def _sequential(requests: list[str], existing: list[str]) -> list[str]:
    taken, free = {e.lower() for e in existing}, {}
    return [collisions.resolved(t, taken, free)[0] if t is not None else None for t in requests]


def _resolve(spark, requests, existing, hot):
    df = spark.createDataFrame(list(enumerate(requests)), "ordinal long, target string").repartition(3)
    disk = spark.createDataFrame([(e,) for e in existing], "path string")
    rows = collisions.resolve(df, disk, hot=hot).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(len(requests)))
    assert all(r.conflict == (r.target is not None and r.new_path != r.target) for r in rows)
    return [r.new_path for r in rows]


@pytest.mark.parametrize("seed", range(6))
def test_large_families_equal_the_sequential_rule(spark, seed):
    """Nested numbers, natural requests before and after their turn, disk, any case, odd numbers, several families and folders, nulls."""
    r = random.Random(seed)

    def name() -> str | None:
        if r.random() < 0.05:
            return None
        out = r.choice(["x", "x", "X", "x (2) (1)", " (1)", "v1.0"])
        for _ in range(r.choice([0, 0, 0, 1, 1, 2, 3])):
            out += f" ({r.choice([1, 1, 2, 2, 3, 4, 5, 6, 7, 9, 12, '01', 0, 10**20])})"
        return r.choice(["/d/", "/d/", "/D/", "/e/"]) + out + r.choice([".zip", ".zip", ".ZIP", "", "."])

    requests = [name() for _ in range(r.choice([60, 250]))]
    existing = [n for n in (name() for _ in range(40)) if n]
    want = _sequential(requests, existing)
    assert _resolve(spark, requests, existing, 0) == want


def test_natural_numbers_against_their_turn(spark):
    """One target, of which half the requests are for numbers below it: whether a number is skipped depends on those skipped before."""
    r = random.Random(8)
    requests = [f"/d/a ({r.randint(1, 150)})" if r.random() < 0.5 else "/d/a" for _ in range(400)]
    existing = [f"/d/a ({k})" for k in range(1, 200, 9)]
    assert _resolve(spark, requests, existing, 5) == _sequential(requests, existing)


def test_small_and_large_families_together(spark):
    requests = ["/d/a.b"] * 50 + ["/d/c.b", None, "/d/C.b", "/d/c (1).b"] * 3
    want = _sequential(requests, ["/D/A (3).B"])
    assert _resolve(spark, requests, ["/D/A (3).B"], 20) == want == _resolve(spark, requests, ["/D/A (3).B"], 10**6)
    empty = spark.createDataFrame([], "ordinal long, target string")
    assert collisions.resolve(empty).count() == 0


def test_one_family_over_all_tasks(spark):
    """No partition of what is written has more than a few times its share."""
    sizes = []

    def watched(df, name="table"):
        out = save(df)
        if "_range" in out.columns:
            sizes.append([x["count"] for x in out.groupBy("_range").count().collect()])
        return out

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    both = spark.range(20_000).select(F.lit("k").alias("key"), F.col("id").alias("at"))
    got = ranges.running_sum(both, ["key"], ["at"], F.lit(1), watched, "n")
    assert got.filter("n <> at + 1").count() == 0
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes[0]) == 4 and max(sizes[0]) < 2 * 20_000 / 4


# running values


def test_rate_slots_over_ranges(spark):
    r = random.Random(3)
    for interval in (7, 0, 100):
        times = sorted(r.randint(0, 3000) if r.random() < 0.7 else 500 for _ in range(300))
        at, want = None, []
        for t in times:
            at = t if at is None or interval <= 0 else max(at + interval, t)
            want.append(at)
        df = spark.createDataFrame(list(enumerate(times)), "i long, t long").repartition(5)
        got = streams.rate_slots(df, interval, "t", ["t", "i"], save=save).orderBy("i").collect()
        assert [x.slot for x in got] == want


def test_running_sums_of_groups(spark):
    r = random.Random(5)
    rows = [(r.choice("aaaaab"), r.choice("xy"), i, r.randint(-3, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "a string, b string, i long, v long")
    got = {x.i: (x.s, x.w) for x in ranges.running_sum(df, ["a", "b"], ["i"], F.col("v"), save, "s", "w").collect()}
    sums, whole = {}, {}
    for a, b, _, v in rows:
        whole[a, b] = whole.get((a, b), 0) + v
    for a, b, i, v in rows:
        sums[a, b] = sums.get((a, b), 0) + v
        assert got[i] == (sums[a, b], whole[a, b])
    assert ranges.running_sum(df.limit(0), ["a"], ["i"], F.col("v"), save, "s").count() == 0


# similarity


def _leaders(spark, signatures, distance, bits, **more):
    files = spark.createDataFrame([(i, s) for i, s in enumerate(signatures)], "ordinal long, words array<long>")
    got = sorted((x.ordinal, x.head, x.head_distance) for x in similarity.leaders(files, distance, bits, save, **more).collect())
    want = sorted((x.ordinal, x.head, x.head_distance) for x in similarity.exact_leaders(files.withColumn("g", F.lit(1)), distance, "g").collect())
    assert got == want


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("kind", ["random", "chained", "constant", "hot", "wide"])
def test_leaders_over_classes(spark, kind):
    r = random.Random(11)
    flip = lambda x, n, low=0, high=64: x ^ sum(1 << b for b in r.sample(range(low, high), n))
    if kind == "random":
        base = [r.getrandbits(64) for _ in range(12)]
        own = [[_signed(flip(r.choice(base), r.randint(0, 9)))] for _ in range(150)]
    elif kind == "chained":
        own, x = [], r.getrandbits(64)
        for _ in range(120):
            own.append([_signed(x)])
            x = flip(x, r.randint(0, 4))
        r.shuffle(own)
    elif kind == "constant":
        own = [[5]] * 100 + [[_signed(flip(0, r.randint(0, 5)))] for _ in range(60)]
    elif kind == "hot":  # one band alike in all, the rest random or near
        own = [[_signed((r.getrandbits(48) << 16) | 0xABCD)] for _ in range(100)] + [[_signed((flip(7 << 20, r.randint(0, 6), 16, 64)) & ~0xFFFF | 0xABCD)] for _ in range(50)]
    else:
        base = [[r.getrandbits(64) for _ in range(4)] for _ in range(6)]
        own = [[_signed(flip(w, r.randint(0, 9))) for w in r.choice(base)] for _ in range(30)]
    distance, bits = (25, 256) if kind == "wide" else (7, 64)
    if kind != "wide":
        _leaders(spark, own, distance, bits, hot=3, sweeps=1)
    _leaders(spark, own, distance, bits)


def test_equal_signatures_make_no_pairs(spark):
    files = spark.range(3000).select(F.col("id").alias("ordinal"), F.array(F.lit(7).cast("long")).alias("words"))
    assert similarity.near_classes(similarity._classes(files), 7, 64, save).count() == 0
    assert similarity.leaders(files, 7, 64, save).filter("head <> 0 or head_distance <> 0").count() == 0
    # many that are near each other: taken by the first of them before pairs are made
    near = spark.range(600).select(F.col("id").alias("ordinal"), F.expr("array(shiftleft(1L, cast(id % 60 as int)) | shiftleft(1L, cast(id % 59 as int)))").alias("words"))
    written = []

    def counted(df, name="table"):
        out = save(df)
        written.append((out.columns, out.count()))
        return out

    assert similarity.leaders(near, 7, 64, counted, hot=20).filter("head <> 0").count() == 0
    assert max(n for c, n in written if "gap" in c) == 0


# outcomes kept in a journal


def test_journal_of_tasks_run_twice(spark, tmp_path, monkeypatch):
    """Move, delete, remove and rewrite, run again whole, and after a loss between the deed and its note, give the same outcomes."""
    at = tmp_path / "t"
    for name in ("m1", "m2", "d1", "d2"):
        (at / name).parent.mkdir(exist_ok=True)
        (at / name).write_text(name)
    (at / "r1").mkdir(), (at / "full").mkdir(), (at / "full/x").write_text("x")
    with zipfile.ZipFile(at / "z.zip", "w") as z:
        z.writestr("manifest.xml", "old"), z.writestr("b", "kept")
    path = lambda n: str(at / n)
    plans = {
        executor.move: [(0, path("m1"), path("to/m1")), (1, path("m2"), path("to/m2")), (2, path("none"), path("to/none")), (3, path("d1"), "")],
        executor.delete: [(4, path("d2"), ""), (5, path("none"), "")],
        executor.remove_dir: [(6, path("r1"), ""), (7, path("full"), ""), (8, path("none"), "")],
        lambda old, new: executor.rewrite_archive(old, "MANIFEST.xml", b"new"): [(9, path("z.zip"), ""), (10, path("none.zip"), "")],
    }
    journal = executor.Journal(str(tmp_path / "journal"))
    lost = lambda self, pair, ok, error: (_ for _ in ()).throw(KeyboardInterrupt())
    for action, rows in plans.items():
        df = spark.createDataFrame(rows, "ordinal long, old_path string, new_path string")
        # the first two are carried out, their outcome is never noted
        for row in rows[:2]:
            journal.begin(row)
            executor._carried_out(row[1], row[2], action, False)
        first = executor.carry_out(df, action, journal.folder).orderBy("ordinal").collect()
        again = executor.carry_out(df, action, journal.folder).orderBy("ordinal").collect()
        assert first == again
        assert {r.ordinal: r.success for r in first} == {r[0]: "none" not in r[1] and "full" not in r[1] for r in rows}, first
    assert sorted(os.listdir(at)) == ["full", "to", "z.zip"] and sorted(os.listdir(at / "to")) == ["m1", "m2"]
    assert zipfile.ZipFile(at / "z.zip").read("manifest.xml") == b"new" and zipfile.ZipFile(at / "z.zip").read("b") == b"kept"
    with monkeypatch.context() as m:  # without a note nothing is lost, either
        m.setattr(executor.Journal, "end", lost)
        with pytest.raises(KeyboardInterrupt):
            executor.Journal(journal.folder).end((0,), True, None)


def test_waves_remove_children_first(spark, tmp_path):
    dirs = [os.path.join(str(tmp_path), *("abcd"[: k + 1])) for k in range(4)] + [str(tmp_path / f"a/x{k}") for k in range(30)]
    for d in dirs:
        os.makedirs(d, exist_ok=True)
    plan = spark.createDataFrame([(i, d, "", d.count("/")) for i, d in enumerate(dirs)], "ordinal long, old_path string, new_path string, depth int").repartition(7)
    got = executor.in_waves(plan, executor.remove_dir, save)
    assert got.filter("success").count() == len(dirs) and not os.path.exists(tmp_path / "a")
    assert executor.in_waves(plan.limit(0), executor.remove_dir, save).count() == 0


# hashes, texts, headers


def test_blake3_vectors(spark, tmp_path):
    """Published vectors: byte i is i % 251."""
    want = {
        0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
        1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
        2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a", 102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
    }
    data = lambda n: bytes(i % 251 for i in range(n))
    assert {n: blake3.hexdigest([data(n)]) for n in want} == want
    df = spark.createDataFrame([(n, data(n)) for n in want] + [(-1, None)], "n long, c binary")
    assert {r[0]: r[1] for r in df.select("n", blake3.content_hash("c")).collect()} == want | {-1: None}
    # several MiB, in pieces of any size, and the tree of exact and odd numbers of pieces
    for n in (1 << 20, (1 << 20) + 1, 3 << 20, 5 * (1 << 20) + 1000):
        whole = blake3.hexdigest([(x := bytes(range(251)) * (n // 251 + 1))[:n]])
        assert whole == blake3.hexdigest(x[:n][i : i + 333_333] for i in range(0, n, 333_333))
    from stratalog.sources import fswalk

    for n in want:
        (tmp_path / str(n)).write_bytes(data(n))
    got = fswalk.hashed(fswalk.walk(spark, [str(tmp_path)]), "blake3").collect()
    assert {int(os.path.basename(r.path)): r.hash for r in got} == want


def test_preview_is_cut_as_read(spark):
    """Cut before the character at the limit; what is not cut off shows as it is, with bad bytes replaced."""
    rows = ["é" * 1000, "a" + "é" * 1000, "x" * 1024, "x" * 1025, "€" * 341 + "ab"]
    raw = [r.encode() for r in rows] + [b"ab\xc3", b"\x80" * 1100, b"ab\xffcd" * 300, None, b"", "€".encode()[:2], b"x" * 1023 + "€".encode()]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(raw)], "i long, c binary").select("i", previews.preview("c", 1).alias("p")).select("i", "p.*").orderBy("i").collect()
    for r, c in zip(got, raw):
        if c is None:
            assert (r.content, r.size, r.truncated) == (None, None, None)
            continue
        end = len(c)
        if len(c) > 1024:
            end = next(k for k in range(1024, -1, -1) if k == 0 or c[k] & 0xC0 != 0x80)
        assert (r.content, r.size, r.truncated) == (c[:end].decode(errors="replace"), end, len(c) > 1024)
    assert got[5].content == "ab�" and got[6].size == 0 and got[11].size == 1023


def test_blank_beside_dots_stays(spark):
    texts = ["... a", "a ...", " .. a \t b. ", "...", "  ", "a.b", ". x .", "a:b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(names.folder_name("t")).collect()]
    assert got == [" a", "a ", " a b", "", "", "a.b", " x ", "a-b"]


def test_version_headers_in_order_of_versions(spark):
    """Ties in version go by time, then path."""
    rows = [("g", "a", "2.0", 5, "/z"), ("g", "a", "2.0", 3, "/a"), ("g", "a", "1.0", 9, "/b"), ("h", "a", "1", 1, "/q"), ("h", "a", "2", 1, "/y"), ("h", "a", "2", 1, "/x")]
    files = spark.createDataFrame(rows, "guid string, author string, version string, mtime long, file_path string")
    found = identity.grouped(files, identity.VERSIONS).withColumn("selected", F.lit(False))
    titles = {r.group_id[0]: r.title for r in identity.headers(found, by_version=True).collect()}
    assert titles["g"].endswith("2.0 · z") and titles["h"].endswith("2 · x")
    assert json.dumps(sorted(titles)) == '["g", "h"]'
