"""Queries whose operators commit tables together, keep state between triggers, or deal one group over all tasks; each with its SQL."""

from __future__ import annotations

import os
import threading

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from stratalog.functions import paths, values
from stratalog.operators import collisions, dedup, identity, similarity, streams, trees
from stratalog.plans import executor, oplog, renames
from stratalog.plans.catalog import OP_ITEMS, Catalog
from stratalog.plans.store import Store
from stratalog.queries import _LEADERS, _PAGES, _VERSION_SQL, DISTANCE, _documents, _items, _page_paths, _signatures, _t, query
from stratalog.scratch import folder, mounted, save
from stratalog.sources import archives, fswalk, images
from stratalog.tree_queries import _FILES, _below, _files, _tree, _zips

# groups by keyed state


@query("""WITH g AS (SELECT user_id, event_type, count(*) AS n, arg_min(event_id, CAST(epoch_us(ts) AS HUGEINT) * 1000000 + event_id) AS kept FROM events GROUP BY ALL HAVING count(*) >= 2)
SELECT user_id, event_type, event_id, n, kept FROM events JOIN g USING (user_id, event_type)""")
def stream_keyed_groups(spark, sf_dir):
    """Events come in five files, the earliest last, a part of them twice; then the query is started again for one more. Every trigger adds its own to the state."""
    from stratalog.streaming import keyed, progressive

    at, keys = folder(spark, "keyed"), ["user_id", "event_type"]
    events = _t(spark, sf_dir, "events").select(*keys, "event_id", "ts")
    k = F.col("event_id") % 4

    def arrive(part) -> None:
        part.coalesce(1).write.mode("append").parquet(f"{at}/in")

    def go_on() -> None:
        found = keyed.touched(progressive.read(spark, f"{at}/in", events.schema, 1), keys, "event_id", ["ts"])
        keyed.start(found, keyed.changes_into(f"{at}/out"), f"{at}/state").awaitTermination()

    for part in (events.filter(k == 3), events.filter(k == 2), events.filter((k == 2) | (k == 1))):
        arrive(part)
    go_on()
    arrive(events.filter((k == 0) | (k == 3)))
    go_on()
    return keyed.members(spark, f"{at}/out", keys).drop("ts").join(keyed.headers(spark, f"{at}/out", keys), keys)


_IN_TURN = _LEADERS.replace("row_number() OVER (ORDER BY vec_id) AS i", "row_number() OVER (ORDER BY vec_id % 3, vec_id) AS i")


@query(_IN_TURN + "SELECT ordinal AS vec_id, head, head_distance FROM r WHERE ordinal IS NOT NULL")
def stream_clusters(spark, sf_dir):
    """Signatures come in three files; a trigger's files are decided against the heads of those before."""
    from stratalog.streaming import clusters, progressive

    at = folder(spark, "clusters")
    files = save(_signatures(spark, sf_dir).withColumnRenamed("ordinal", "vec_id"))
    for k in range(3):
        files.filter(F.col("vec_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{at}/in")
    sink = clusters.clusters_into(f"{at}/out", DISTANCE, 64, ["vec_id"], save)
    progressive.start(progressive.read(spark, f"{at}/in", files.schema, 1), sink, f"{at}/state", "append").awaitTermination()
    done = clusters.clustered(spark, f"{at}/out")
    names_ = done.select(F.col("ordinal").alias("head"), F.col("vec_id").alias("name"))
    return done.join(names_, "head").select("vec_id", F.col("name").alias("head"), "head_distance")


# trees


@query("WITH " + _FILES + """ SELECT path, false AS is_dir, CAST(size AS BIGINT) AS size FROM f UNION ALL SELECT DISTINCT dir, true, NULL FROM f
UNION ALL SELECT DISTINCT host, true, NULL FROM f UNION ALL SELECT '', true, NULL""")
def tree_rounds(spark, sf_dir):
    """A tree listed by rounds, few folders a task."""
    at = _tree(spark, sf_dir)
    return _below(fswalk.walk_wide(spark, [at, at + "/missing"], save, budget=20), at).select("path", "is_dir", "size")


@query("WITH " + _FILES + " SELECT path, CAST(size AS BIGINT) AS size, CAST(1 AS BIGINT) AS times FROM f UNION ALL SELECT 'later/' || nationkey, 0, 1 FROM (SELECT n_nationkey AS nationkey FROM nation)")
def tree_stream(spark, sf_dir):
    """Files of a tree as a stream, some of them there when the query goes on only, moved in from elsewhere with the times they had."""
    from stratalog.streaming import progressive

    at, to = _tree(spark, sf_dir), folder(spark, "seen")
    later = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("name"))

    def place(frames):
        for f in frames:
            os.makedirs(f"{at}/later", exist_ok=True)
            for n in f.name:
                open(f"{at}-{n}", "w").close()
                os.utime(f"{at}-{n}", (1, 1))
                os.rename(f"{at}-{n}", f"{at}/later/{n}")
            yield pd.DataFrame({"n": [len(f)]})

    def go_on() -> None:
        found = fswalk.stream(spark, [at], settle_ms=1).select("path", "size")
        progressive.start(found, lambda b, n: b.write.mode("overwrite").parquet(f"{to}/out/batch={n}"), f"{to}/state", "append").awaitTermination()

    go_on()
    later.mapInPandas(place, "n long").agg(F.sum("n")).first()
    go_on()
    go_on()
    return _below(spark.read.parquet(f"{to}/out"), at).groupBy("path").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("times"))


# progress, pauses and large groups


@query("""WITH b AS (SELECT event_id % 3 AS batch, count(*) AS rows FROM events GROUP BY 1), t AS (SELECT count(*) AS total FROM events)
SELECT batch, rows, CAST(sum(rows) OVER (ORDER BY batch) AS BIGINT) AS processed, total, round(sum(rows) OVER (ORDER BY batch) * 100.0 / total, 6) AS percent FROM b, t""")
def stream_progress(spark, sf_dir):
    """Three files, a trigger each; what each trigger has read and what is done by then."""
    from stratalog.streaming import progressive

    at = folder(spark, "progress")
    events = _t(spark, sf_dir, "events").select("event_id")
    for k in range(3):
        events.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{at}/in")
    sink = progressive.reporting(lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}"), f"{at}/progress")
    progressive.start(progressive.read(spark, f"{at}/in", events.schema, 1), sink, f"{at}/state", "append").awaitTermination()
    return progressive.progress(spark, f"{at}/progress", events.count()).withColumn("percent", F.round("percent", 6))


@query("SELECT event_id, event_id % 3 AS batch FROM events")
def stream_paused(spark, sf_dir):
    """A task is paused before its second trigger and goes on when it is resumed; it is cancelled before its third, and a new one does that."""
    from stratalog.streaming import progressive

    at = folder(spark, "paused")
    events = _t(spark, sf_dir, "events").select("event_id")
    for k in range(3):
        events.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{at}/in")

    def go_on(after: dict) -> None:
        task = progressive.Task.start()

        def sink(batch, number):
            batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")
            after.get(number, lambda t: None)(task)

        q = progressive.start(progressive.read(spark, f"{at}/in", events.schema, 1), task.guarded(sink), f"{at}/state", "append")
        try:
            q.awaitTermination()
        except StreamingQueryException:
            if task.state != "cancelled":
                raise
        finally:
            task.end()

    def rest(task) -> None:
        task.pause()
        threading.Timer(0.5, task.resume).start()

    go_on({0: rest, 1: lambda task: task.cancel()})
    go_on({})
    return spark.read.parquet(f"{at}/out").select("event_id", F.col("batch").cast("long").alias("batch"))


@query("""WITH f AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) DESC, lpad(CAST(event_id AS VARCHAR), 12, '0')) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, n AS n_files, k AS rank, k > 1 AS selected, k <> n AS oldest_selected FROM f WHERE n > 1""")
def dedup_large_groups(spark, sf_dir):
    """A handful of groups that hold all events, ranked over ranges; and by identity, all but the oldest."""
    path = F.lpad(F.col("event_id").cast("string"), 12, "0")
    events = _t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("hash"), path.alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ctime"), F.lit(False).alias("from_history"))
    found = dedup.duplicates(events, dedup.DedupConfig(keep="newest"), save)
    files = events.select("event_id", F.col("hash").alias("group_id"), F.col("path").alias("file_path"), F.col("ctime").alias("mtime"))
    oldest = identity.keep_duplicates(files, newest=False, save=save).select("event_id", F.col("selected").alias("oldest_selected"))
    return found.join(oldest, "event_id").select("event_id", "n_files", "rank", "selected", "oldest_selected")


# files that are deleted and archives that are rewritten


@query("WITH " + _FILES + """ SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id % 5 <> 0 END AS success, NOT (page_id % 2 = 0 AND page_id % 5 <> 0) AS there FROM f""")
def files_deleted(spark, sf_dir):
    """Half of a tree's files are deleted, some that aren't there; the plan is carried out twice over one journal, then the tree is read."""
    at = _tree(spark, sf_dir)
    k = F.col("page_id")
    own = _files(spark, sf_dir).select("page_id", "path")
    plan = own.filter(k % 2 == 0).select(k.alias("ordinal"), F.concat(F.lit(at + "/"), F.when(k % 5 == 0, F.lit("none")).otherwise(F.col("path"))).alias("old_path"), F.lit("").alias("new_path"))
    save(executor.carry_out(plan, journal=f"{at}-journal"))
    done = save(executor.carry_out(plan, journal=f"{at}-journal")).select(F.col("ordinal").alias("page_id"), "success")
    left = _below(fswalk.files(fswalk.walk(spark, [at])), at).select("path", F.lit(True).alias("there"))
    return own.join(done, "page_id", "left").join(left, "path", "left").select("page_id", "success", F.coalesce("there", F.lit(False)).alias("there"))


#: archives that a task writes, rewrites or reads
_ARCHIVES = 2000


@query("""SELECT p_partkey, p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AS success, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 0 OR p_partkey % 5 = 1 THEN '' ELSE 'g' || p_partkey % 5 END AS games,
    CASE WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 0 THEN '' ELSE p_type END AS guid FROM part""")
def archives_rewritten(spark, sf_dir):
    """Archives on disk, of which one game's tag is taken out of the manifest; then they are read again, all else as it was."""
    at = mounted(spark, "zips")

    def put(frames):
        os.makedirs(at, exist_ok=True)
        for f in frames:
            for k, content in zip(f.p_partkey, f.content):
                with open(f"{at}/{k}.zip", "wb") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(f)]})

    def without_game(old: str, new: str) -> None:
        entry = archives.read_entry(open(old, "rb").read())
        executor.rewrite_archive(old, archives.ENTRY, entry.replace(b"<game>g1</game>", b""))

    part = _t(spark, sf_dir, "part")
    tasks = part.count() // _ARCHIVES + 1
    zips = _zips(spark, sf_dir, tasks)
    zips.mapInPandas(put, "n long").agg(F.sum("n")).first()
    plan = part.select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit(at + "/"), F.col("p_partkey").cast("string"), F.lit(".zip")).alias("old_path"), F.lit("").alias("new_path"))
    done = save(executor.carry_out(plan, without_game, journal=f"{at}-journal", tasks=tasks))
    # tasks open what they are dealt; listing the folder would be the driver's
    found = archives.with_manifest_at(done.repartition(tasks, "ordinal"), "old_path")
    return found.select(F.col("ordinal").alias("p_partkey"), "success", F.array_join("games", "|").alias("games"), "guid")


# tables that are committed together

_IDS = ["1e1", "10", "007", "2024-01-01", "gone"]


@query("""WITH d AS (SELECT doc_id, sha256(text) AS hash, CAST(doc_id AS VARCHAR) AS path, ['1e1', '10', '007', '2024-01-01', 'gone'][1 + doc_id % 5] AS record_id FROM documents),
e AS (SELECT record_id, doc_id, hash FROM d WHERE record_id <> 'gone' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0))
SELECT record_id, CASE WHEN record_id = '10' THEN 'new name' ELSE 'snapshot ' || record_id END AS record_name, count(*) OVER (PARTITION BY record_id) AS entry_count, hash, doc_id,
    (SELECT count(*) FILTER (toxic = 0) FROM labels JOIN documents USING (doc_id)) AS total_success, (SELECT count(*) FROM labels JOIN documents USING (doc_id)) AS total_selected FROM e""")
def catalog_snapshots(spark, sf_dir):
    """Five snapshots, with ids that look like numbers and dates; a move takes paths out of all of them, one is renamed, one deleted."""
    catalog = Catalog(Store(spark, folder(spark, "catalog")))
    docs = _documents(spark, sf_dir).select("doc_id", "hash", F.col("path").alias("file_path"), F.col("size").alias("file_size"), F.col("ctime").alias("mtime"), F.lit(None).cast("long").alias("ctime"), F.lit("active").alias("status"))
    for i, record_id in enumerate(_IDS):
        catalog.save_snapshot(record_id, f"snapshot {record_id}", i, ["/a"], docs.filter(F.col("doc_id") % 5 == i))
    labels = _t(spark, sf_dir, "labels").join(docs.select("doc_id", "file_size"), "doc_id")
    items = labels.select(F.col("doc_id").cast("string").alias("src_path"), F.lit("/x").alias("dst_path"), (F.col("toxic") == 0).alias("success"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_message"), F.col("file_size").alias("size"))
    catalog.save_move("m1", "t1", 9, "/x", items)
    catalog.rename_snapshot("10", " new name ")
    catalog.delete_snapshot("gone")
    own = [catalog.load_snapshot(r).select("record_id", "hash", "file_path") for r in _IDS[:-1]]
    entries = own[0]
    for more in own[1:]:
        entries = entries.unionByName(more)
    reports = catalog.store.read("move_reports").select("total_success", "total_selected")
    found = entries.join(catalog.snapshots().select("record_id", "record_name", "entry_count"), "record_id").join(F.broadcast(reports))
    return found.select("record_id", "record_name", "entry_count", "hash", F.col("file_path").cast("long").alias("doc_id"), "total_success", "total_selected")


@query("""WITH i AS (SELECT o_orderkey, o_orderpriority, o_orderkey % 3 AS r, row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) AS k, o_orderkey % 7 <> 0 AS ok FROM orders),
n AS (SELECT count(*) FILTER (r = 0) AS n0, count(*) FILTER (r IN (0, 1)) AS n1 FROM i)
SELECT CASE r WHEN 0 THEN k ELSE n1 + k END AS id, 'r' || r AS record_id, o_orderkey AS ordinal, ok AS apply_success,
    CASE WHEN r = 0 AND ok THEN o_orderkey % 2 = 0 END AS rollback_success, CASE WHEN r = 0 AND ok AND o_orderkey % 2 <> 0 THEN 'busy' END AS rollback_error,
    CASE r WHEN 0 THEN 'partially_rolled_back' ELSE 'applied' END AS rollback_status, CASE r WHEN 0 THEN 'first' ELSE 'log 2' END AS record_name,
    count(*) OVER (PARTITION BY r) AS total_items, count(*) FILTER (ok) OVER (PARTITION BY r) AS success_items FROM i, n WHERE r <> 1""")
def catalog_log(spark, sf_dir):
    """Three records with items, whose ids count up over all of them; one is rolled back and renamed, one deleted with its items."""
    catalog = Catalog(Store(spark, folder(spark, "catalog")))
    k = F.col("o_orderkey")
    outcome = _t(spark, sf_dir, "orders").select(k.alias("ordinal"), F.concat(F.lit("/a/"), k.cast("string")).alias("old_path"), F.lit("/b").alias("new_path"), (k % 7 != 0).alias("success"), F.when(k % 7 == 0, "denied").alias("error"))
    for r in range(3):
        catalog.log(outcome.filter(F.col("ordinal") % 3 == r), f"r{r}", "mod_op", f"log {r}", None, ["/a"], r)
    items = catalog.items("r0")
    key = F.substring("old_path", 4, 20).cast("long")
    events = items.filter("apply_success").select("id", (key % 2 == 0).alias("rollback_success"), F.when(key % 2 != 0, "busy").alias("rollback_error"), F.lit(9).cast("long").alias("updated_at"))
    catalog.rolled_back("r0", events)
    catalog.rename_operation("r0", "first")
    catalog.delete_operations(["r1"])
    found = catalog.store.read(OP_ITEMS).join(catalog.operations().select("record_id", "rollback_status", "record_name", "total_items", "success_items"), "record_id")
    return found.select("id", "record_id", "ordinal", "apply_success", "rollback_success", "rollback_error", "rollback_status", "record_name", "total_items", "success_items")


# one group over all tasks


@query("""WITH q AS (SELECT l_orderkey * 10 + l_linenumber AS ordinal, row_number() OVER (ORDER BY l_orderkey * 10 + l_linenumber) - 1 AS k FROM lineitem),
a AS (SELECT ordinal, CASE WHEN k = 0 THEN 0 ELSE k + (k - 1) // 6 END AS i FROM q), m AS (SELECT max(i) AS most FROM a), l AS (SELECT max(ordinal) AS last FROM q),
b AS (SELECT last + o_orderkey AS ordinal, o_orderkey AS n FROM orders, l)
SELECT ordinal, CASE WHEN i = 0 THEN '/out/F.zip' ELSE '/out/F (' || i || ').zip' END AS new_path, i > 0 AS conflict FROM a
UNION ALL SELECT ordinal, CASE WHEN n > 0 AND (n % 7 = 0 AND n <= 700000 OR n <= most) THEN '/out/f (' || n || ') (1).zip' ELSE '/out/f (' || n || ').zip' END, n > 0 AND (n % 7 = 0 AND n <= 700000 OR n <= most) FROM b, m
UNION ALL SELECT -1 - event_id, NULL, false FROM events""")
def collision_family(spark, sf_dir):
    """All rows of lineitem want one name, below which disk has every seventh number; then each order wants a numbered name of the same family. Events want
    nothing."""
    own = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.lit("/out/F.zip").alias("target"))
    last = own.agg(F.max("ordinal").alias("last"))
    later = _t(spark, sf_dir, "orders").join(F.broadcast(last)).select((F.col("last") + F.col("o_orderkey")).alias("ordinal"), F.concat(F.lit("/out/f ("), F.col("o_orderkey").cast("string"), F.lit(").zip")).alias("target"))
    none = _t(spark, sf_dir, "events").select((-1 - F.col("event_id")).alias("ordinal"), F.lit(None).cast("string").alias("target"))
    # the name's rows get numbers up to rows - 1 and those that disk has between; below the last of them disk has every seventh
    k = max(own.count() - 1, 0)
    disk = spark.range(1, max(100_000, (k + max(k - 1, 0) // 6) // 7) + 1).select(F.concat(F.lit("/OUT/f ("), (F.col("id") * 7).cast("string"), F.lit(").zip")).alias("path"))
    return collisions.resolve(own.unionByName(later).unionByName(none), disk, hot=1000).select("ordinal", "new_path", "conflict")


@query("""WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (ORDER BY floor(epoch(ts)), event_id) - 1 AS i FROM events)
SELECT event_id, CAST(i * 260 + max(t - i * 260) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS slot FROM e""")
def rate_schedule_all(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("event_id", values.file_seconds("ts").alias("t"))
    return streams.rate_slots(events, 260, "t", ["t", "event_id"], save=save).select("event_id", "slot")


@query("""SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS processed, count(*) OVER (PARTITION BY event_type) AS total,
    round(row_number() OVER (PARTITION BY event_type ORDER BY event_id) * 100.0 / count(*) OVER (PARTITION BY event_type), 6) AS percent FROM events""")
def progress_large(spark, sf_dir):
    out = streams.progress(_t(spark, sf_dir, "events"), "event_type", ["event_id"], save)
    return out.select("event_id", "processed", "total", F.round("percent", 6).alias("percent"))


# every vector stands for its embedding's signs at 0 to 15, the others are those of vec_id % 40
_COPIES = f"""WITH RECURSIVE b AS (SELECT a.vec_id, CAST(array_to_string(list_transform(range(64), lambda i: CASE WHEN (CASE WHEN i < 16 AND a.vec_id % 10 = 0 THEN a.embedding[i + 1] ELSE c.embedding[i + 1] END) > 0 THEN '1' ELSE '0' END), '') AS BIT) AS s
    FROM embeddings a JOIN embeddings c ON c.vec_id = a.vec_id % 40),
o AS (SELECT vec_id, s, row_number() OVER (ORDER BY vec_id) AS i FROM b),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(v BIGINT, s BIT)[]) AS heads, CAST(NULL AS BIGINT) AS ordinal, CAST(NULL AS BIGINT) AS head, CAST(NULL AS BIGINT) AS head_distance
    UNION ALL SELECT o.i, CASE WHEN m IS NULL THEN list_append(r.heads, {{'v': o.vec_id, 's': o.s}}) ELSE r.heads END, o.vec_id, coalesce(m.v, o.vec_id), coalesce(bit_count(xor(m.s, o.s)), 0)
    FROM r JOIN o ON o.i = r.i + 1, LATERAL (SELECT list_filter(r.heads, lambda h: bit_count(xor(h.s, o.s)) <= {DISTANCE})[1] AS m))
SELECT ordinal, head, head_distance FROM r WHERE ordinal IS NOT NULL"""


@query(_COPIES)
def leader_copies(spark, sf_dir):
    """Signatures of which many are equal or share most of their bits: bands are swept and divided."""
    own = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    first = own.select((F.col("vec_id")).alias("first"), F.col("embedding").alias("theirs")).filter("first < 40")
    both = own.withColumn("first", F.col("vec_id") % 40).join(first, "first")
    signs = F.transform("theirs", lambda x, i: F.when((i < 16) & (F.col("vec_id") % 10 == 0), F.get("embedding", i)).otherwise(x))
    files = both.select(F.col("vec_id").alias("ordinal"), values.sign_words(signs).alias("words"))
    return similarity.leaders(files, DISTANCE, 64, save, hot=4, sweeps=2).select("ordinal", "head", "head_distance")


# what the operators leave, in full


@query("WITH " + _VERSION_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY version_key DESC, p_partkey % 3 DESC, CAST(p_partkey AS VARCHAR)) AS rank FROM v WHERE group_id IN (SELECT group_id FROM g)),
s AS (SELECT *, rank % 4 IN (1, 2) AS selected FROM r)
SELECT group_id, coalesce(nullif(split_part(group_id, chr(31), 2), ''), 'unknown') || ' · 最新 ' || arg_min(version, rank) || ' · ' || count(*) || ' 个文件 · 保留：' ||
    coalesce(arg_min(version || ' · ' || p_partkey, rank) FILTER (NOT selected), '（未指定）') AS title FROM s GROUP BY group_id""")
def version_headers(spark, sf_dir):
    """Headers of version groups in which the first two files of each four are selected; times tie within a version."""
    c = F.col
    tail = F.when(c("p_partkey") % 7 == 0, ".0").when(c("p_partkey") % 5 == 0, "-rc1").otherwise("")
    version = F.concat(c("p_size").cast("string"), F.lit("."), F.floor("p_retailprice").cast("long").cast("string"), tail)
    files = _t(spark, sf_dir, "part").select("p_partkey", c("p_brand").alias("guid"), c("p_type").alias("author"), version.alias("version"), (c("p_partkey") % 3).alias("mtime"), c("p_partkey").cast("string").alias("file_path"))
    found = identity.grouped(files, identity.VERSIONS)
    return identity.headers(found.withColumn("selected", (c("rank") % 4).isin(1, 2)), by_version=True)


@query("WITH " + _VERSION_SQL + "SELECT p_partkey, version_key <> min(version_key) OVER (PARTITION BY group_id) AS selected FROM v WHERE group_id IN (SELECT group_id FROM g)")
def identity_oldest(spark, sf_dir):
    c = F.col
    tail = F.when(c("p_partkey") % 7 == 0, ".0").when(c("p_partkey") % 5 == 0, "-rc1").otherwise("")
    version = F.concat(c("p_size").cast("string"), F.lit("."), F.floor("p_retailprice").cast("long").cast("string"), tail)
    files = _t(spark, sf_dir, "part").select("p_partkey", c("p_brand").alias("guid"), c("p_type").alias("author"), version.alias("version"), c("p_partkey").alias("mtime"), c("p_partkey").cast("string").alias("file_path"))
    return identity.keep_versions(identity.grouped(files, identity.VERSIONS), newest=False).select("p_partkey", "selected")


@query(_LEADERS + """SELECT head, count(*) AS n_files, CAST(round(100 - max(head_distance) * 100.0 / 64) AS INT) AS similarity
FROM r WHERE ordinal IS NOT NULL GROUP BY head HAVING count(*) > 1 AND round(100 - max(head_distance) * 100.0 / 64) >= 94""")
def similar_groups(spark, sf_dir):
    found = similarity.groups(similarity.leaders(_signatures(spark, sf_dir), DISTANCE, 64, save), 64)
    return similarity.at_least(found, 94).select("head", "n_files", "similarity")


@query("WITH " + _PAGES + """, d AS (SELECT DISTINCT host AS path FROM p UNION SELECT DISTINCT dir FROM p)
SELECT '/w/' || path AS path, row_number() OVER (ORDER BY len(string_split(path, '/')) DESC, '/w/' || path) AS place FROM d""")
def dirs_deepest_first(spark, sf_dir):
    pages = _page_paths(spark, sf_dir)
    dirs = pages.select("dir").union(pages.select("host")).distinct().select(F.concat(F.lit("/w/"), "dir").alias("path"))
    found = trees.deepest_first(dirs.withColumn("depth", paths.depth("path")))
    return streams.numbered(found, [F.desc("depth"), "path"], save, 1, "place").select("path", "place")


@query("""SELECT user_id, bool_and(value > 0) AND count(*) > 0 AS all_above, bool_or(value > 100) AS any_above, false AS none FROM events GROUP BY user_id""")
def every_and_any(spark, sf_dir):
    own = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("value").alias("v"))
    nothing = F.filter("v", lambda x: F.lit(False))
    return own.select("user_id", values.every(F.col("v"), lambda x: x > 0).alias("all_above"), F.exists("v", lambda x: x > 100).alias("any_above"), values.every(nothing, lambda x: x > 0).alias("none"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS record_id, l_linestatus = 'O' AS apply_success FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3 OFFSET 4)""")
def record_items_left(spark, sf_dir):
    """Of a record that is deleted the items go, too."""
    records = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"))
    gone = [r.record_id for r in streams.page(records, ["record_id"], 4, 3).collect()]
    _, items = oplog.without_records(records, _items(spark, sf_dir), gone)
    return items.select("id", "record_id", "apply_success")


@query("WITH " + _PAGES + """, s AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'NOT_FOUND' WHEN page_id % 11 = 0 THEN 'META_FAILED' WHEN page_id % 5 = 0 THEN 'MOVE_FAILED' END AS error_code,
    CASE WHEN page_id % 5 = 0 THEN 'disk ' || page_id END AS error_message FROM p)
SELECT page_id, error_code, error_message, error_code IS NULL AS success FROM s""")
def moves_failed(spark, sf_dir):
    pages = _page_paths(spark, sf_dir)
    files = pages.select("page_id", F.concat(F.lit("/s/"), F.col("page_id").cast("string")).alias("src_path"), F.lit(1).alias("size"), (F.col("page_id") % 7 != 0).alias("found"), (F.col("page_id") % 11 != 0).alias("readable"))
    failed = pages.filter("page_id % 5 = 0").select(F.concat(F.lit("/s/"), F.col("page_id").cast("string")).alias("src_path"), F.concat(F.lit("disk "), F.col("page_id").cast("string")).alias("error_message"))
    return renames.with_failures(renames.move_plan(files, "/out", order_col="page_id"), failed).select("page_id", "error_code", "error_message", "success")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 255 ELSE 0 END) AS x FROM embeddings)
SELECT vec_id, array_to_string(list_transform(range(16), lambda i: CASE WHEN i // 4 * 5 + i % 4 + 2 <= 64 AND x[i // 4 * 5 + i % 4 + 2] > x[i // 4 * 5 + i % 4 + 1] THEN '1' ELSE '0' END), '') AS dhash,
    array_to_string(list_transform(range(8), lambda i: CASE WHEN x[i // 4 * 5 + i % 4 + 2] > x[i // 4 * 5 + i % 4 + 1] THEN '1' ELSE '0' END), '') ||
    array_to_string(list_transform(range(8), lambda i: CASE WHEN x[20 + (i // 4 + 1) * 4 + i % 4 + 1] > x[20 + i // 4 * 4 + i % 4 + 1] THEN '1' ELSE '0' END), '') AS phash FROM e""")
def gradient_hashes(spark, sf_dir):
    """Images that are their own grids: 4 x 5 pixels for `dhash`, and rows and columns of such sizes for each half of `phash`."""
    white = lambda x: F.when(x > 0, "FF").otherwise("00")
    pixels = lambda a, n: F.unhex(F.array_join(F.transform(F.slice("embedding", a, n), white), ""))
    own = _t(spark, sf_dir, "embeddings")
    image = lambda data, h, w: own.select("vec_id", F.lit(h).alias("height"), F.lit(w).alias("width"), F.lit(1).alias("n_channels"), data.alias("data"))
    bits = F.substring(F.lpad(F.bin(F.get("words", 0)), 64, "0"), 1, 16)
    dhash = images.hashed(image(pixels(1, 20), 4, 5), "dhash", 4).select("vec_id", bits.alias("dhash"))
    # the half by rows sees two rows of five, the half by columns three rows of four: an image for each, of which the other half is left out
    rows = images.hashed(image(pixels(1, 10), 2, 5), "phash", 4).select("vec_id", F.substring(bits, 1, 8).alias("rows"))
    columns = images.hashed(image(pixels(21, 12), 3, 4), "unknown", 4).select("vec_id", F.substring(bits, 9, 8).alias("columns"))
    return dhash.join(rows, "vec_id").join(columns, "vec_id").select("vec_id", "dhash", F.concat("rows", "columns").alias("phash"))


# locale order


@query("""WITH t AS (SELECT p_partkey, unnest([p_brand, lower(p_type), 'é' || p_name, 'Z' || p_name, 'e' || p_name]) AS tag FROM part)
SELECT p_partkey, string_agg(tag, '|' ORDER BY tag COLLATE en, tag) AS shown FROM t GROUP BY p_partkey""")
def tags_by_locale(spark, sf_dir):
    c = F.col
    none = F.create_map().cast("map<string,string>")
    tags = F.array("p_brand", F.lower("p_type"), F.concat(F.lit("é"), c("p_name")), F.concat(F.lit("Z"), c("p_name")), F.concat(F.lit("e"), c("p_name")))
    shown = values.display_tags(tags, none, none, F.array().cast("array<string>"), F.lit(False), "en")
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(shown, lambda p: p["display"]), "|").alias("shown"))


@query("""WITH g AS (SELECT DISTINCT CASE user_id % 4 WHEN 0 THEN upper(event_type) WHEN 1 THEN 'é' || event_type WHEN 2 THEN 'E' || event_type ELSE event_type END || user_id AS group_id FROM events)
SELECT group_id, row_number() OVER (ORDER BY group_id COLLATE en, group_id) AS place FROM g""")
def groups_by_locale(spark, sf_dir):
    kind, user = F.col("event_type"), F.col("user_id")
    name = F.when(user % 4 == 0, F.upper(kind)).when(user % 4 == 1, F.concat(F.lit("é"), kind)).when(user % 4 == 2, F.concat(F.lit("E"), kind)).otherwise(kind)
    groups = _t(spark, sf_dir, "events").select(F.concat(name, user.cast("string")).alias("group_id")).distinct()
    return streams.numbered(identity.listed(groups, "en"), [F.collate("group_id", "en"), "group_id"], save, 1, "place")


# folders removed in waves, with a journal


@query("WITH " + _PAGES + """, d AS (SELECT DISTINCT dir FROM p UNION SELECT DISTINCT host FROM p), b AS (SELECT DISTINCT dir FROM p WHERE page_id % 10 = 0)
SELECT dir AS path, NOT EXISTS (SELECT 1 FROM b WHERE b.dir = d.dir OR starts_with(b.dir, d.dir || '/')) AS success FROM d""")
def dirs_removed(spark, sf_dir):
    """Some folders of a tree hold a file. All are removed, deepest first, and again: the journal gives the outcomes of the first time."""
    at = mounted(spark, "dirs")
    pages = _page_paths(spark, sf_dir)
    full = lambda c: F.concat(F.lit(at + "/"), F.col(c))
    dirs = pages.select("dir").union(pages.select("host")).distinct()
    plan = save(dirs.select(F.xxhash64("dir").alias("ordinal"), full("dir").alias("old_path"), F.lit("").alias("new_path"), paths.depth("dir").alias("depth")))

    def fill(frames):
        for f in frames:
            for p, full_of in zip(f.path, f.full_of):
                os.makedirs(p, exist_ok=True)
                if full_of:
                    open(f"{p}/x", "w").close()
            yield pd.DataFrame({"n": [len(f)]})

    held = pages.groupBy("dir").agg(F.max(F.col("page_id") % 10 == 0).alias("full_of"))
    held.select(full("dir").alias("path"), "full_of").mapInPandas(fill, "n long").agg(F.sum("n")).first()
    first = executor.in_waves(plan, executor.remove_dir, save, journal=f"{at}/../{os.path.basename(at)}-journal")
    again = executor.in_waves(plan, executor.remove_dir, save, journal=f"{at}/../{os.path.basename(at)}-journal")
    both = first.select("old_path", "success").join(again.select("old_path", F.col("success").alias("again")), "old_path")
    return both.filter("success = again").select(F.substring("old_path", len(at) + 2, 10_000).alias("path"), "success")
