"""Tables that change together: every commit is one version of all of them.

Rows, deletes and updates are written as immutable Parquet files, each write an entry. A version is one JSON manifest that
names the entries of every table; it is written under a temporary name and published by a step that fails if the number is
taken (a hard link on a local file system, a rename that doesn't overwrite on HDFS and its like; others are refused). So a
reader sees all changes of a commit or none, a writer that dies leaves files that no version names, and of two writers one
finds the number taken and publishes its entries again on top of the other's.

Changes are merged on read by the number of the commit that brought them, an entry's `seq`: a delete takes the rows of earlier
commits that have its key, an update replaces columns in them, the latest per column. So no commit rewrites the files of
another. Ids that a table generates are a file's place plus what the table had counted when the file was committed,
so racing writers never share one. compact() writes a table as it stands and keeps later changes apart.

The manifest is read by the driver: about 150 bytes an entry, so compact() before a table has some 100,000 of them. Entries
are told apart by a column of their files, names that begin with __ are the store's own and are refused. Null keys match nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.operators.streams import numbered
from stratalog.scratch import save

#: entries in a broadcast at once, some 60 bytes each; more are joined by shuffle
BROADCAST_ENTRIES = 200_000
GRACE_SECONDS = 86_400.0
ENTRY, SEQ, FIRST, PLACE = "__entry", "__seq", "__first", "__place"
_EMPTY = {"schema": {"type": "struct", "fields": []}, "id": None, "next": 1, "rows": [], "deletes": [], "updates": []}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # versions

    def versions(self) -> list[int]:
        at = self._path("versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[1:11]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            have = self.versions()
            if not have:
                return {"version": 0, "tables": {}}
            version = have[-1]
        stream = self._fs.open(self._path("versions/v%010d.json" % version))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Whether the manifest became its version; false if another writer took the number."""
        temporary, final = self._path(f"versions/.{uuid.uuid4().hex}"), self._path("versions/v%010d.json" % manifest["version"])
        out = self._fs.create(temporary, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        try:
            self._named(temporary, final)
            return True
        except Exception:
            if self._fs.exists(final):
                return False
            raise
        finally:
            self._fs.delete(temporary, False)

    def _named(self, temporary, final) -> None:
        """Gives a file its name if nothing has that."""
        jvm, gateway, scheme = self._jvm, self.spark.sparkContext._gateway, self._fs.getScheme()
        if scheme == "file":
            none = gateway.new_array(jvm.java.lang.String, 0)
            at = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), none) for p in (final, temporary)]
            jvm.java.nio.file.Files.createLink(*at)
        elif scheme in ("hdfs", "viewfs", "webhdfs", "abfs", "abfss"):
            options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(temporary, final, options)
        else:
            raise ValueError(f"no way is known to take a version's name once on {scheme}")

    def begin(self) -> Change:
        return Change(self)

    # reading

    def _entries(self, table: str, entries: list[dict], schema: T.StructType) -> DataFrame:
        """Rows of entries with the number of the commit that brought each."""
        whole = T.StructType([*schema.fields, T.StructField(ENTRY, T.StringType())])
        rows = self.spark.read.schema(whole).parquet(*[f"{self.root}/data/{table}/{e['entry']}" for e in entries])
        known = self.spark.createDataFrame([(e["entry"], e["seq"], e.get("first")) for e in entries], f"{ENTRY} string, {SEQ} long, {FIRST} long")
        return rows.join(F.broadcast(known) if len(entries) <= BROADCAST_ENTRIES else known, ENTRY).drop(ENTRY)

    def read(self, table: str, version: int | None = None, tags: dict[str, str] | None = None) -> DataFrame:
        """The rows of a table as a version has it. With `tags`, only entries that were appended under them, or under none of
        their names, are opened; the caller filters rows."""
        manifest = self.manifest(version)
        if table not in manifest["tables"]:
            raise LookupError(table)
        return self._merged(table, manifest["tables"][table], tags).drop(SEQ)

    def _merged(self, table: str, t: dict, tags: dict[str, str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(t["schema"])
        entries = [e for e in t["rows"] if all(e["tags"].get(k, v) == v for k, v in (tags or {}).items())]
        if not entries:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(SEQ, T.LongType())]))
        rows = self._entries(table, entries, T.StructType([*schema.fields, T.StructField(PLACE, T.LongType())]) if t["id"] else schema)
        if t["id"]:
            rows = rows.withColumn(t["id"], F.coalesce(F.col(FIRST) + F.col(PLACE), F.col(t["id"]))).drop(PLACE)
        rows, least = rows.drop(FIRST), min(e["seq"] for e in entries)
        kind = {f.name: f for f in schema.fields}
        for keys, own in _grouped([d for d in t["deletes"] if d["seq"] > least], "keys"):
            gone = self._entries(table, own, T.StructType([kind[k] for k in keys])).groupBy(*keys).agg(F.max(SEQ).alias("__gone"))
            rows = rows.join(gone, list(keys), "left").filter(F.col("__gone").isNull() | (F.col(SEQ) >= F.col("__gone"))).drop("__gone")
        news: dict[str, list] = {}
        for i, ((keys, columns), own) in enumerate(_grouped([u for u in t["updates"] if u["seq"] > least], "keys", "columns")):
            change = self._entries(table, own, T.StructType([kind[k] for k in (*keys, *columns)])).groupBy(*keys).agg(F.max(F.struct(SEQ, *columns)).alias(f"__new{i}"))
            rows = rows.join(change, list(keys), "left")
            for c in columns:
                at = F.col(f"__new{i}")
                news.setdefault(c, []).append(F.when(at[SEQ] > F.col(SEQ), F.struct(at[SEQ].alias("s"), at[c].alias("v"))))
        latest = {c: found[0] if len(found) == 1 else F.array_max(F.array(*found)) for c, found in news.items()}
        rows = rows.withColumns({c: F.when(x.isNotNull(), x["v"]).otherwise(F.col(c)) for c, x in latest.items()}) if latest else rows
        return rows.select(*[f.name for f in schema.fields], SEQ)

    # upkeep

    def compact(self, table: str) -> int | None:
        """Writes a table's rows as they stand, as one entry a set of tags. Changes that were committed meanwhile stay, and hold for the new files; None if
        another compaction was first."""
        base = self.manifest()
        t = base["tables"][table]
        sets = {json.dumps(e["tags"], sort_keys=True) for e in t["rows"]}
        done = []
        for tags in sorted(sets):
            own = {**t, "rows": [e for e in t["rows"] if json.dumps(e["tags"], sort_keys=True) == tags]}
            done.append({"entry": self._written(table, self._merged(table, own).drop(SEQ)), "seq": base["version"], "first": None, "tags": json.loads(tags)})
        old = {e["entry"] for kind in ("rows", "deletes", "updates") for e in t[kind]}

        def change(tables: dict, version: int) -> bool:
            now = tables[table]
            if not old <= {e["entry"] for kind in ("rows", "deletes", "updates") for e in now[kind]}:
                return False
            for kind in ("rows", "deletes", "updates"):
                now[kind] = [e for e in now[kind] if e["entry"] not in old]
            now["rows"] = done + now["rows"]
            return True

        return self._commit(change)

    def vacuum(self, keep: int = 1, grace_seconds: float = GRACE_SECONDS) -> None:
        """Drops all but the last `keep` versions, and deletes the entries older than the grace period that no version left names."""
        versions = self.versions()
        named = {f"{t}/{e['entry']}" for v in versions[-keep:] for t, own in self.manifest(v)["tables"].items() for kind in ("rows", "deletes", "updates") for e in own[kind]}
        before = (time.time() - grace_seconds) * 1000
        for v in versions[:-keep]:
            self._fs.delete(self._path("versions/v%010d.json" % v), False)
        for t in self._fs.listStatus(self._path("data")) if self._fs.exists(self._path("data")) else []:
            for e in self._fs.listStatus(t.getPath()):
                if f"{t.getPath().getName()}/{e.getPath().getName()}" not in named and e.getModificationTime() < before:
                    self._fs.delete(e.getPath(), True)

    # writing

    def _written(self, table: str, df: DataFrame) -> str:
        own = [c for c in df.columns if c.startswith("__") and c != PLACE]
        if own:
            raise ValueError(f"names of the store itself: {own}")
        entry = uuid.uuid4().hex
        df.withColumn(ENTRY, F.lit(entry)).write.parquet(f"{self.root}/data/{table}/{entry}")
        return entry

    def _commit(self, change: Callable[[dict, int], bool]) -> int | None:
        """Publishes what change(tables, number) makes of the latest version; again, if another writer was first. Where change
        gives false, nothing is published."""
        while True:
            manifest = self.manifest()
            manifest["version"] += 1
            if not change(manifest["tables"], manifest["version"]):
                return None
            if self._publish(manifest):
                return manifest["version"]


class Change:
    """Changes of any tables, written as they are made and committed together."""

    def __init__(self, store: Store):
        self.store, self._steps = store, []

    def append(self, table: str, df: DataFrame, tags: dict[str, str] | None = None, id_col: str | None = None, order: list[str] | None = None) -> Change:
        """Adds rows. With id_col the table gives them ids, counting up by `order`."""
        schema, n = df.schema.jsonValue(), None
        if id_col:
            df = numbered(df, order, save, 0, PLACE).withColumn(id_col, F.lit(None).cast("long"))
            schema = df.drop(PLACE).schema.jsonValue()
        entry = self.store._written(table, df)
        if id_col:
            n = self.store.spark.read.parquet(f"{self.store.root}/data/{table}/{entry}").count()

        def step(tables: dict, version: int) -> None:
            t = tables.setdefault(table, json.loads(json.dumps(_EMPTY)))
            known = {f["name"]: f for f in t["schema"]["fields"]}
            for f in schema["fields"]:
                if f["name"] in known and known[f["name"]]["type"] != f["type"]:
                    raise TypeError(f"{table}.{f['name']} is {known[f['name']]['type']}, not {f['type']}")
                if f["name"] not in known:
                    t["schema"]["fields"].append(f | {"nullable": True})
            first = None
            if id_col:
                t["id"], first, t["next"] = id_col, t["next"], t["next"] + n
            t["rows"].append({"entry": entry, "seq": version, "first": first, "tags": tags or {}})

        self._steps.append(step)
        return self

    def delete(self, table: str, keys: DataFrame) -> Change:
        """Takes away the rows of earlier commits that equal a row of `keys` in its columns."""
        entry, names = self.store._written(table, keys.distinct()), keys.columns
        self._steps.append(lambda tables, version: tables[table]["deletes"].append({"entry": entry, "seq": version, "keys": names}))
        return self

    def update(self, table: str, keys: list[str], df: DataFrame) -> Change:
        """Replaces df's other columns in the rows of earlier commits that have its keys."""
        entry, columns = self.store._written(table, df), [c for c in df.columns if c not in keys]
        self._steps.append(lambda tables, version: tables[table]["updates"].append({"entry": entry, "seq": version, "keys": keys, "columns": columns}))
        return self

    def drop(self, table: str, tags: dict[str, str]) -> Change:
        """Takes away all rows that were appended under these tags, without reading any."""

        def step(tables: dict, version: int) -> None:
            if table in tables:
                tables[table]["rows"] = [e for e in tables[table]["rows"] if not all(e["tags"].get(k) == v for k, v in tags.items())]

        self._steps.append(step)
        return self

    def commit(self, check: Callable[[dict], None] | None = None) -> int:
        """The version that has all changes. check(tables of the version before) may raise, and is asked again if another writer was first."""

        def change(tables: dict, version: int) -> bool:
            if check:
                check(tables)
            for step in self._steps:
                step(tables, version)
            return True

        return self.store._commit(change)


def _grouped(entries: list[dict], *by: str) -> list[tuple]:
    """Entries by what they have under `by`: [(value or values, entries)]."""
    out: dict[tuple, list[dict]] = {}
    for e in entries:
        out.setdefault(tuple(tuple(e[k]) for k in by), []).append(e)
    return [(k if len(by) > 1 else k[0], own) for k, own in out.items()]
