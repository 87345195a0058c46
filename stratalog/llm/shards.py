"""Size-tiered compaction of an append-only table with a versioned manifest, DataFrame operations only.

append() writes a batch as small immutable files and commits them. compact() sorts the live files into
tiers (each up to FAN times the size of the one below); a tier that holds FAN files or more is merged into
files of about the target size by reading its files in a few larger partitions, without a shuffle. Files at
or near the target stay as they are.

A version is one JSON file `manifest/v%010d.json` with all live files and what version added each. It is written under a
temporary name and then published by a step that fails if the number is taken: a hard link on a local file system, a
rename that doesn't overwrite on HDFS and its like; other file systems are refused. So readers always see a whole version, and of two writers one retries. Data files carry a fresh name and are
never changed. vacuum() deletes files that no kept version names: old versions' files, and, once they are older than a
grace period, what failed writes and lost races have left. A task that is run again writes under Spark's committer;
files of a failed attempt are never in a manifest.

Each row has a version that added it: the manifest tells it of a file as appended, and compaction writes it into the column ADDED
of what it merges, so it outlives any number of merges; read(lineage=True) shows it.

Defined cases: an empty batch commits a version without new files; null and repeated rows are kept as they
are; columns may have any names but ADDED; reading a table without versions is an error.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES, FAN, NEAR = 64 << 20, 4, 0.6
ADDED = "_added_version"
#: files named in a broadcast at once, about 150 bytes each; more are joined by shuffle
BROADCAST_FILES = 200_000
#: what no version names may belong to a writer at work for as long
GRACE_SECONDS = 86_400.0


class ShardedTable:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan: int = FAN):
        self.spark, self.root, self.target, self.fan = spark, root.rstrip("/"), target_bytes, fan
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        at = self._path("manifest")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[1:11]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        stream = self._fs.open(self._path("manifest/v%010d.json" % version))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, temporary, final) -> bool:
        """Gives a written file its final name; false if that is taken."""
        jvm, scheme = self._jvm, self._fs.getScheme()
        if scheme == "file":
            names = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (final, temporary)]
            step = lambda: jvm.java.nio.file.Files.createLink(*names)
        elif scheme in ("hdfs", "viewfs", "webhdfs", "abfs", "abfss"):
            options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
            step = lambda: context.rename(temporary, final, options)
        else:
            raise ValueError(f"no way is known to take a version's name once on {scheme}")
        try:
            step()
        except Exception:
            if self._fs.exists(final):
                return False
            raise
        return True

    def _commit(self, change) -> int | None:
        """Writes change(the latest manifest, the next number) as the next version; tries again if another writer was first.
        Where change gives None, nothing is written."""
        while True:
            have = self.versions()
            version = (have[-1] if have else 0) + 1
            new = change(self.manifest(have[-1]) if have else {"schema": None, "files": []}, version)
            if new is None:
                return None
            temporary, final = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path("manifest/v%010d.json" % version)
            out = self._fs.create(temporary, False)
            out.write(json.dumps(new | {"version": version}).encode())
            out.close()
            try:
                if self._publish(temporary, final):
                    return version
            finally:
                self._fs.delete(temporary, False)

    def _written(self, df: DataFrame) -> list[dict]:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return self._files(name)

    def _files(self, name: str) -> list[dict]:
        files = [(f.getPath().getName(), f.getLen()) for f in self._fs.listStatus(self._path(name))]
        return [{"file": f"{name}/{n}", "bytes": b} for n, b in sorted(files) if n.endswith(".parquet")]

    def _added(self, files: list[dict], schema: str) -> int:
        return self._commit(lambda old, version: old | {"schema": json.loads(schema), "files": old["files"] + [f | {"added": version} for f in files]})

    def append(self, df: DataFrame) -> int:
        """Commits df's rows as new small files."""
        return self._added(self._written(df), df.schema.json())

    def append_arrivals(self, df: DataFrame, arrival, n: int) -> list[int]:
        """Commits df's rows as n arrivals, by the integer column `arrival` (0 to n - 1), after one pass over df."""
        name, key = f"data/{uuid.uuid4().hex}", f"_arrival_{uuid.uuid4().hex[:8]}"
        df.withColumn(key, arrival).write.partitionBy(key).parquet(f"{self.root}/{name}")
        out = []
        for k in range(n):
            own = f"{name}/{key}={k}"
            out.append(self._added(self._files(own) if self._fs.exists(self._path(own)) else [], df.schema.json()))
        return out

    def tier(self, size: int) -> int:
        return max(0, math.ceil(math.log(max(size, 1) / 65536, self.fan)))

    def full_tiers(self, files: list[dict]) -> list[list[dict]]:
        """The tiers, smallest first, that hold FAN files or more below NEAR of the target."""
        tiers: dict[int, list[dict]] = {}
        for f in files:
            if f["bytes"] < NEAR * self.target:
                tiers.setdefault(self.tier(f["bytes"]), []).append(f)
        return [tiers[k] for k in sorted(tiers) if len(tiers[k]) >= self.fan]

    def compact(self) -> int:
        """Merges tiers until none is full; the latest version."""
        while True:
            now = self.manifest()
            # neighbouring full tiers merge in one pass, as their result would be merged again
            run = [f for tier in self.full_tiers(now["files"]) for f in tier]
            if not run:
                return now["version"]
            n = max(1, round(sum(f["bytes"] for f in run) / self.target))
            merged = self._written(self._read(run, now["schema"], True).coalesce(n))
            gone = {f["file"] for f in run}

            def change(old: dict, version: int) -> dict | None:
                if not gone <= {f["file"] for f in old["files"]}:
                    return None  # another writer merged some of them first
                return old | {"files": [f for f in old["files"] if f["file"] not in gone] + [f | {"added": None} for f in merged]}

            if self._commit(change) is None:
                for f in merged:
                    self._fs.delete(self._path(f["file"]), False)

    def vacuum(self, keep: int = 1, grace_seconds: float = GRACE_SECONDS) -> None:
        """Drops all but the last `keep` versions and deletes the files that only they name, and those older than the grace
        period that no version names."""
        versions = self.versions()
        live = {f["file"] for v in versions[-keep:] for f in self.manifest(v)["files"]}
        named = set(live)
        for v in versions[:-keep]:
            for f in self.manifest(v)["files"]:
                named.add(f["file"])
                if f["file"] not in live:
                    self._fs.delete(self._path(f["file"]), False)
            self._fs.delete(self._path("manifest/v%010d.json" % v), False)
        if not self._fs.exists(self._path("data")):
            return
        before, found = (time.time() - grace_seconds) * 1000, self._fs.listFiles(self._path("data"), True)
        while found.hasNext():
            f = found.next()
            name = self._relative(f.getPath().toString())
            if name not in named and f.getModificationTime() < before:
                self._fs.delete(f.getPath(), False)

    @staticmethod
    def _relative(path: str) -> str:
        return "data/" + path.rsplit("/data/", 1)[1]

    def _read(self, files: list[dict], schema: dict, lineage: bool = False) -> DataFrame:
        kind = T.StructType.fromJson(schema)
        whole = T.StructType([*kind.fields, T.StructField(ADDED, T.LongType())])
        if not files:
            return self.spark.createDataFrame([], whole if lineage else kind)
        if not lineage:
            return self.spark.read.schema(kind).parquet(*[f"{self.root}/{f['file']}" for f in files])
        rows = self.spark.read.schema(whole).parquet(*[f"{self.root}/{f['file']}" for f in files])
        # names that no column of the table has; metadataColumn also finds the file where a column is called _metadata
        file, by = f"_file_{uuid.uuid4().hex}", f"_by_{uuid.uuid4().hex}"
        added = self.spark.createDataFrame([(f["file"], f["added"]) for f in files], f"{file} string, {by} long")
        at = rows.metadataColumn("_metadata")["file_path"]
        rows = rows.withColumn(file, F.concat(F.lit("data/"), F.regexp_extract(F.url_decode(at), "^.*/data/(.*)$", 1)))
        rows = rows.join(F.broadcast(added) if len(files) <= BROADCAST_FILES else added, file, "left")
        return rows.select(*[_quoted(c) for c in kind.fieldNames()], F.coalesce(ADDED, by).alias(ADDED))

    def read(self, version: int | None = None, lineage: bool = False) -> DataFrame:
        """The rows of a version; with `lineage`, what version added each."""
        m = self.manifest(version)
        return self._read(m["files"], m["schema"], lineage)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sharded(docs: DataFrame, root: str, arrivals: int = 8, id_col: str = "doc_id", target_bytes: int = TARGET_BYTES) -> tuple[ShardedTable, DataFrame]:
    """docs dealt to arrivals by their (whole-number) id, appended, compacted and read back with the version that added each row."""
    at = ShardedTable(docs.sparkSession, root, target_bytes)
    at.append_arrivals(docs, F.coalesce(F.pmod(F.col(id_col), F.lit(arrivals)), F.lit(0)).cast("int"), arrivals)
    at.compact()
    at.vacuum()
    return at, at.read(lineage=True)
