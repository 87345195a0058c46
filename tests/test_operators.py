"""Operators against sequential versions in plain Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.operators import collisions, dedup, filters, identity, lookups, similarity, streams, trees
from stratalog.plans import oplog, renames, snapshots
from stratalog.scratch import save


def sequential(requests, existing):
    taken, out = {e.lower() for e in existing}, []
    for t in requests:
        folder, name = t.rsplit("/", 1)
        dot = name.rfind(".")
        stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        new, i = t, 0
        while new.lower() in taken:
            i += 1
            new = f"{folder}/{stem} ({i}){ext}"
        taken.add(new.lower())
        out.append((new, i > 0))
    return out


NAME = st.builds(lambda s, n, e: s + n + e, st.sampled_from(["a", "A", "b.c", ".x"]), st.sampled_from(["", " (1)", " (2)", " (1) (1)"]), st.sampled_from(["", ".zip", ".Z"]))


@settings(max_examples=12, deadline=None)
@given(st.lists(NAME, min_size=1, max_size=40), st.lists(NAME, max_size=8))
def test_collisions(spark, requests, existing):
    requests, existing = [f"/d/{n}" for n in requests], [f"/d/{n}" for n in existing]
    df = spark.createDataFrame(list(enumerate(requests)), "ordinal long, target string")
    disk = spark.createDataFrame([(e,) for e in existing], "path string")
    got = collisions.resolve(df, disk).orderBy("ordinal").collect()
    assert [(r.new_path, r.conflict) for r in got] == sequential(requests, existing)


def test_collision_vectors(spark):
    ask = lambda names, disk: [(r.new_path, r.conflict) for r in collisions.resolve(spark.createDataFrame(list(enumerate(names)), "ordinal long, target string"), spark.createDataFrame([(d,) for d in disk], "path string")).orderBy("ordinal").collect()]
    assert ask(["/d/same.zipmod"] * 3, []) == [("/d/same.zipmod", False), ("/d/same (1).zipmod", True), ("/d/same (2).zipmod", True)]
    assert ask(["/d/same.zipmod"], ["/d/same.zipmod", "/d/same (1).zipmod"]) == [("/d/same (2).zipmod", True)]


def history_frame(spark):
    current = [("h1", "/a", 10, 3), ("h1", "/b", 10, 2), ("h2", "/c", 10, 1), ("h3", "/d", 10, 1)]
    history = [("h2", "/c", 10, 1, "active"), ("h4", "/e", 10, 1, "active"), ("h4", "/f", 10, 2, "active"), ("h3", "/g", 10, 1, "moved")]
    return spark.createDataFrame(current, "hash string, path string, size long, ctime long"), spark.createDataFrame(history, "hash string, path string, size long, ctime long, status string")


@pytest.mark.parametrize(
    ("config", "want"),
    [
        (dedup.DedupConfig(), {"h1", "h2"}),
        (dedup.DedupConfig(use_history=True, history_only=True), {"h2"}),
        (dedup.DedupConfig(use_history=True, include_history=True), {"h1", "h2", "h4"}),
        (dedup.DedupConfig(use_history=True, exclude_self_history=True), {"h1"}),
    ],
)
def test_history_rules(spark, config, want):
    out = dedup.duplicates(dedup.with_history(*history_frame(spark), config), config).collect()
    assert {r.hash for r in out} == want
    assert {r.group_id for r in out} == {f"G{k:05d}" for k in range(1, len(want) + 1)}
    if config.use_history:
        assert all(r.selected == (not r.from_history) for r in out if r.hash in ("h2", "h4"))


def test_keep_rules_and_selection(spark):
    current, _ = history_frame(spark)
    files = current.withColumn("from_history", F.lit(False))
    old = dedup.duplicates(files)
    assert {r.path for r in old.filter("selected").collect()} == {"/a"}
    assert {r.path for r in dedup.duplicates(files, dedup.DedupConfig(keep="newest")).filter("selected").collect()} == {"/b"}
    assert {r.path for r in dedup.keep_only(old, "/a").filter("selected").collect()} == {"/b"}
    assert dedup.select_folder(old, "/").filter("selected").count() == 2
    assert dedup.same_size(spark.createDataFrame([(1,), (2,), (2,)], "size long")).count() == 2
    moved = spark.createDataFrame([("/A",)], "path string")
    assert dedup.without(old, moved).count() == 2 and dedup.without(old, moved, fold_case=True).count() == 0
    assert dedup.search_groups(old, " B ").count() == 1


def test_identity_groups(spark):
    rows = [("/1", "g", "a", "1.0", 5), ("/2", "g", "a", "1.00", 5), ("/3", "g", "a", "1.0", 9), ("/4", "x", "a", "1", 1)]
    files = spark.createDataFrame(rows, "file_path string, guid string, author string, version string, mtime long")
    dup = identity.keep_duplicates(identity.grouped(files, identity.DUPLICATES))
    assert {(r.file_path, r.selected) for r in dup.collect()} == {("/1", True), ("/3", False)}
    ver = identity.keep_versions(identity.grouped(files, identity.VERSIONS))
    assert {(r.file_path, r.selected, r.latest_version) for r in ver.collect()} == {("/1", True, "1.00"), ("/2", False, "1.00"), ("/3", True, "1.00")}
    assert {r.file_path for r in identity.keep_versions(identity.grouped(files, identity.VERSIONS), newest=False).filter("not selected").collect()} == {"/1", "/3"}


@pytest.mark.parametrize("distance", [6, 9])
def test_leaders_equal_the_sequential_rule(spark, distance):
    r = random.Random(distance)
    heads = [r.getrandbits(64) for _ in range(6)]
    words = [h ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 8))) for h in heads for _ in range(15)]
    r.shuffle(words)
    files = spark.createDataFrame([(i, [w - (1 << 64) if w >> 63 else w], "g") for i, w in enumerate(words)], "ordinal long, words array<bigint>, g string")
    exact = {tuple(x) for x in similarity.exact_leaders(files, distance, "g").select("ordinal", "head", "head_distance").collect()}
    rounds = {tuple(x) for x in similarity.leaders(files, distance, 64, save).select("ordinal", "head", "head_distance").collect()}
    first, want = [], set()
    for i, w in enumerate(words):
        h = next((h for h in first if (words[h] ^ w).bit_count() <= distance), i)
        first += [i] * (h == i)
        want.add((i, h, (words[h] ^ w).bit_count()))
    assert exact == rounds == want
    assert all(0 <= g.similarity <= 100 for g in similarity.groups(similarity.leaders(files, distance, 64, save), 64).collect())


def test_trees(spark):
    roots = spark.createDataFrame([("C:\\a", 0, True), ("c:/A/", 1, True), ("C:/a/b", 2, True), ("C:/ab", 3, True), ("D:/x", 4, False)], "path string, ordinal long, ok boolean")
    got = {r.ordinal: r.status for r in trees.normalize_roots(roots, ok_col="ok").collect()}
    assert got == {0: "kept", 1: "duplicate", 2: "covered", 3: "kept", 4: "inaccessible"}
    files = spark.createDataFrame([("/r/a/x.txt",), ("/r/ab/y.txt",), ("/R/A/z.txt",), ("/q/w.txt",), ("/q/w.txt",)], "path string")
    tops = spark.createDataFrame([("/r",), ("/r/a",)], "root string")
    assert sorted((r.path, r.root, r.relative) for r in trees.longest_root(files, tops).filter("root is not null").collect()) == [("/R/A/z.txt", "/r/a", ""), ("/r/a/x.txt", "/r/a", ""), ("/r/ab/y.txt", "/r", "ab")]
    assert trees.longest_root(files, tops).count() == 5
    assert trees.select_below(files, spark.createDataFrame([("/R/a",)], "path string")).count() == 2
    tree = [("/t", True, True), ("/t/e", True, True), ("/t/e/f", True, True), ("/t/u", True, False), ("/t/d", True, True), ("/t/d/x", False, True)]
    df = spark.createDataFrame([(*t, "/t") for t in tree], "path string, is_dir boolean, readable boolean, root string")
    assert [r.path for r in trees.empty_dirs(df).orderBy(F.desc("depth")).collect()] == ["/t/e/f", "/t/e"]
    assert trees.empty_dirs(df.filter("path in ('/t', '/t/e')"), include_roots=True).count() == 2


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=30), st.integers(0, 12))
def test_rate_slots(spark, times, interval):
    times = sorted(times)
    df = spark.createDataFrame(list(enumerate(times)), "i long, t long")
    got = [r.slot for r in streams.rate_slots(df, interval, "t", ["i"]).orderBy("i").collect()]
    want, at = [], None
    for t in times:
        at = t if at is None or interval <= 0 else max(at + interval, t)
        want.append(at)
    assert got == want


def test_running_values(spark):
    e = spark.createDataFrame([(i, "a" if i % 2 else "b", i * 10) for i in range(10)], "seq long, k string, v long")
    assert [r.seq for r in streams.ring(e, 3).collect()] == [9, 8, 7]
    assert {r.percent for r in streams.progress(e, "k", ["seq"]).collect()} == {20.0, 40.0, 60.0, 80.0, 100.0}
    new = spark.createDataFrame([(8, "b", -1)], "seq long, k string, v long")
    assert {(r.k, r.v) for r in streams.upsert(e, new, "k", "seq").collect()} == {("a", 90), ("b", -1)}
    assert streams.first_per_group(e, "k", ["seq"], 2).count() == 4 and streams.page(e, ["seq"], 8).count() == 2
    assert streams.search(e, " A ", ["seq", "k"]).count() == 5


def test_filters_and_lookups(spark):
    f = spark.createDataFrame([("a.PNG", ["Abc"], None), ("b", ["x"], "bad"), ("c.txt", None, None)], "path string, games array<string>, error string")
    assert [r.path for r in f.filter(filters.has_extension("path", [".png"])).collect()] == ["a.PNG"]
    assert f.filter(filters.has_extension("path", [])).count() == 3
    assert filters.scan_summary(f, F.coalesce(filters.keyword("games", " aBC "), F.lit(False))).first()[:] == (1, 3, 1)
    with pytest.raises(ValueError):
        filters.keyword("games", " ")
    with pytest.raises(ValueError):
        filters.of_kind(f, "nonsense")
    rows = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, None)], "i int, pid string")
    results = spark.createDataFrame([("p", "old", 1), ("p", None, 2)], "pid string, error string, arrival long")
    out = lookups.join_back(rows, results)
    assert sorted(r.status for r in out.collect()) == ["ok", "ok", "pending", "pending"]
    assert lookups.state_counts(out).first()[:] == (4, 2, 0) and lookups.requests(rows).count() == 2


def test_plans(spark):
    files = spark.createDataFrame([("/m/[a] g-1.zipmod", "g", "a", "1", None), ("/m/x.zip", "g", "a", "1", None), ("/m/bad.zip", "", "", "", "no manifest")], "old_path string, guid string, author string, version string, error string")
    disk = spark.createDataFrame([("/m/[a] g-1.zipmod",)], "path string")
    plan = {r.old_path: (r.new_path, r.conflict, r.warn) for r in renames.rename_plan(files, disk).collect()}
    assert plan == {"/m/x.zip": ("/m/[a] g-1 (1).zipmod", True, None), "/m/bad.zip": ("/m/bad.zip", False, "no manifest")}
    assert renames.executable(renames.rename_plan(files, disk)).count() == 1
    with pytest.raises(ValueError):
        renames.suffix_plan(files, " ")
    moves = spark.createDataFrame([(0, "/s/a/x", 5, True, True), (1, "/s/b/x", 6, True, True), (2, "/s/n", 1, False, True), (3, "/s/m", 1, True, False)], "ordinal long, src_path string, size long, found boolean, readable boolean")
    out = renames.with_failures(renames.move_plan(moves, "/out"), spark.createDataFrame([("/s/b/x", "disk full")], "src_path string, error_message string"))
    assert {(r.ordinal, r.dst_path, r.error_code) for r in out.collect()} == {(0, "/out/x", None), (1, "/out/x (1)", "MOVE_FAILED"), (2, None, "NOT_FOUND"), (3, None, "META_FAILED")}
    assert snapshots.move_report(out).first()[:] == (4, 1, 3, 5)
    roots = spark.createDataFrame([("/s",)], "root string")
    assert {r.dst_path for r in renames.move_plan(moves.limit(2), "/out", roots=roots).collect()} == {"/out/a/x", "/out/b/x"}
    tags = spark.createDataFrame([(0, "/i/1.png", "a/b"), (1, "/i/2.png", "...")], "ordinal long, old_path string, tag string")
    assert [r.new_path for r in renames.tag_move_plan(tags, "/o").collect()] == ["/o/a-b/1.png"]
    assert renames.backup_plan(tags, "r", None).first().new_path == ""
    assert spark.range(1).select(renames.target_dir(F.lit(" "), F.lit("/set"), F.lit("/def"), F.lit("t1"))).first()[0] == "/set/t1"


def test_operation_log(spark):
    outcome = spark.createDataFrame([(0, "/a", "/b", True, None), (1, "/c", "/d", False, "denied"), (2, "/e", "/f", True, None)], "ordinal long, old_path string, new_path string, success boolean, error string")
    record, items = oplog.logged(outcome, "r1", "suffix_change", "n", None, ["/x"], 100, first_id=5)
    assert record.first().extra == "" and [r.id for r in items.orderBy("id").collect()] == [5, 6, 7]
    assert oplog.apply_totals(items).first()[:] == (3, 2, 1)
    assert oplog.summaries(record, items).first().success_items == 2
    present = spark.createDataFrame([("/b",)], "path string")
    assert oplog.rollback_check(items, present).first()[:] == (2, 1, 1)
    taken = spark.createDataFrame([("/a",)], "path string")
    with pytest.raises(ValueError):
        oplog.rollback_plan(items, present, taken)
    with pytest.raises(ValueError):
        oplog.rollback_plan(items, present, taken, enabled=False)
    plan = oplog.rollback_plan(items, present, taken, force=True)
    assert {(r.id, r.action, r.restore_path, r.message) for r in plan.collect()} == {(5, "restore", "/a (1)", "restored to /a (1)"), (7, "skip", None, "SKIPPED_NOT_FOUND")}
    events = oplog.rollback_events(plan, spark.createDataFrame([], "id long, error string"), 200)
    after = {r.id: r for r in oplog.with_events(items, events).collect()}
    assert after[5].rollback_success and after[5].rollback_error == "restored to /a (1)" and after[6].rollback_success is None and not after[7].rollback_success
    assert oplog.renamed(record, "r1", " new ").first().record_name == "new"
    with pytest.raises(ValueError):
        oplog.renamed(record, "r1", " ")
    with pytest.raises(LookupError):
        oplog.renamed(record, "zz", "x")
    assert [d.count() for d in oplog.without_records(record, items, ["r1"])] == [0, 0]
    assert oplog.with_status(record, "r1", "rolled_back").first().rollback_status == "rolled_back"
    states = spark.createDataFrame([("r", "success", 2), ("q", "success", 1), ("q", "failed", 1)], "record_id string, status string, n_items long")
    assert {(r.record_id, r.rollback_status, r.coverage) for r in oplog.rollback_totals(states, ["record_id"]).collect()} == {("r", "rolled_back", False), ("q", "partially_rolled_back", False)}
    dirs = oplog.empty_dir_rollback(items, spark.createDataFrame([("/a", False)], "path string, is_dir boolean"), spark.createDataFrame([("/",), ("/a",)], "path string"))
    assert {(r.old_path, r.action) for r in dirs.collect()} >= {("/a", "blocked")}


def test_snapshots(spark, tmp_path):
    record = spark.createDataFrame([("r1", "n", 5, ["/x"])], "record_id string, record_name string, created_at long, source_paths array<string>")
    entries = spark.createDataFrame([("r1", "h", "/p", 1, 7, None, "active"), ("r1", "g", "/q", 1, 7, 3, "moved")], "record_id string, hash string, file_path string, file_size long, mtime long, ctime long, status string")
    snapshots.save(spark, str(tmp_path), record, entries)
    back = spark.read.parquet(str(tmp_path / "entries"))
    assert snapshots.listed(record, back).first().entry_count == 2
    assert {(r.file_path, r.ctime) for r in snapshots.loaded(back, "r1").collect()} == {("/p", 7), ("/q", 3)}
    assert [r.hash for r in snapshots.active_hashes(record, back).collect()] == ["h"]
    assert snapshots.purged(back, spark.createDataFrame([("/p",)], "src_path string")).count() == 1
    assert snapshots.latest(record.limit(0)).count() == 0 and snapshots.estimate(back.withColumn("size", F.lit(None).cast("long"))).first()[:] == (2, 0)
