"""A data source for directory trees: files and directories with sizes and times, hidden ones included.

    spark.dataSource.register(TreeSource)
    spark.read.format("tree").option("roots", json.dumps([...])).load()

Options: roots (JSON array), recursive (true), on_bad_root (skip or fail), fan_out (levels below a root that
become partitions of their own, 1). Entries that can't be listed are rows with readable false; symbolic links
are files. Rows have the columns of schema.SCAN_FILE; ordinal counts within a partition.

walk_wide() lists by rounds: what a task doesn't get to within its budget of folders is dealt to all tasks in the next.

    spark.readStream.format("tree").option("roots", json.dumps([...])).load()

gives files as they come, by the time at which their entry last changed, which a move into the tree sets, too, and nothing can set
back. A trigger reads those between two such times, the later of them `settle_ms` (2000) before it: what
comes at the same tick is then all there. A file that changes later comes again. With `files_per_trigger` the offset is the time and
path of the last file of so many, for which the driver lists the tree; without, tasks alone do.
"""

from __future__ import annotations

import functools
import json
import os
import stat
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from stratalog.functions import names, values
from stratalog.operators import filters
from stratalog.schema import SCAN_FILE


class _Part(InputPartition):
    def __init__(self, root: str, top: str, depth: int):
        self.root, self.top, self.depth = root, top, depth  # depth: levels below top to list; -1 for all


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options.get("roots", "[]"))
        self.recursive = options.get("recursive", "true").lower() != "false"
        self.fail = options.get("on_bad_root", "skip") == "fail"
        self.fan_out = int(options.get("fan_out", "1"))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for root in self.roots:
            if not os.path.isdir(root):
                if self.fail:
                    raise ValueError(f"not a directory: {root}")
                continue
            if not self.recursive:
                out.append(_Part(root, root, 0))
                continue
            level = [root]
            for _ in range(self.fan_out):
                below = []
                for top in level:
                    out.append(_Part(root, top, 0))
                    try:
                        with os.scandir(top) as entries:
                            below += [e.path for e in entries if e.is_dir(follow_symlinks=False)]
                    except OSError:
                        pass
                level = sorted(below)
            out += [_Part(root, top, -1) for top in level]
        return out or [_Part("", "", -2)]

    def read(self, part: _Part):
        if part.depth == -2:
            return
        ordinal, stack = 0, [part.top]
        if part.top == part.root:
            yield self._row(part.root, part.root, ordinal, True)
            ordinal += 1
        while stack:
            at = stack.pop()
            try:
                with os.scandir(at) as found:
                    entries = sorted(found, key=lambda e: e.name)
            except OSError:
                continue  # its own row says that it isn't readable
            for e in entries:
                own_dir = e.is_dir(follow_symlinks=False)
                yield self._row(part.root, e.path, ordinal, own_dir)
                ordinal += 1
                if own_dir and part.depth == -1:
                    stack.append(e.path)

    @staticmethod
    def _row(root: str, path: str, ordinal: int, is_dir: bool) -> tuple:
        try:
            s = os.lstat(path)
            readable = os.access(path, os.R_OK | os.X_OK) if is_dir else True
            created = int(getattr(s, "st_birthtime", s.st_ctime))
            is_dir = is_dir and not stat.S_ISLNK(s.st_mode)
            return path, is_dir, readable, None if is_dir else s.st_size, int(s.st_mtime), created or int(s.st_mtime), root, ordinal, None
        except OSError as e:
            return path, is_dir, False, None, 0, 0, root, ordinal, str(e)


class _Span(InputPartition):
    def __init__(self, part: _Part, start: dict, end: dict):
        self.part, self.start, self.end = part, start, end


class TreeStream(DataSourceStreamReader):
    """Offsets are {time (nanoseconds), path}; a trigger has the files after one and up to another."""

    def __init__(self, options: dict):
        self.tree = TreeReader(options)
        self.settle = int(options.get("settle_ms", "2000")) * 1_000_000
        self.most = int(options.get("files_per_trigger", "0"))
        self.at: dict = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        # past the last path of that time
        until = {"time": time.time_ns() - self.settle, "path": chr(0x10FFFF)}
        if self.most:
            files = sorted((t, r[0]) for p in self.tree.partitions() for t, r in self._files(p) if _after(t, r[0], self.at) and not _after(t, r[0], until))
            if not files:
                return self.at
            last = files[: self.most][-1]
            until = {"time": last[0], "path": last[1]}
        self.at = until
        return until

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # a query that goes on begins where it was
        self.at = max(self.at, end, key=lambda o: (o["time"], o["path"]))
        return [_Span(p, start, end) for p in self.tree.partitions()]

    def _files(self, part: _Part) -> Iterator[tuple[int, tuple]]:
        for row in self.tree.read(part):
            if not row[1] and row[2]:
                try:
                    yield os.lstat(row[0]).st_ctime_ns, row
                except OSError:
                    continue  # gone meanwhile

    def read(self, span: _Span):
        for t, row in self._files(span.part):
            if _after(t, row[0], span.start) and not _after(t, row[0], span.end):
                yield row

    def commit(self, end: dict) -> None:
        pass


def _after(t: int, path: str, offset: dict) -> bool:
    return (t, path) > (offset["time"], offset["path"])


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCAN_FILE

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(self.options)


def walk(spark: SparkSession, roots: list[str], recursive: bool = True, on_bad_root: str = "skip") -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("roots", json.dumps(roots)).option("recursive", str(recursive).lower()).option("on_bad_root", on_bad_root).load()


def walk_wide(spark: SparkSession, roots: list[str], save: Callable[[DataFrame], DataFrame], budget: int = 2000) -> DataFrame:
    """walk() for trees of any shape. A task lists at most `budget` folders a round; those that it has found and not listed are dealt
    to tasks anew, `budget` to each. save(df) -> df writes a table."""

    def run(frames):
        left, ordinal = budget, 0
        for f in frames:
            for root, top in zip(f.root, f.path):
                rows, stack = [], [top]
                if top == root and left > 0:  # listed now, so not dealt again
                    rows.append((*TreeReader._row(root, root, ordinal, True), False))
                    ordinal += 1
                while stack and left > 0:
                    left -= 1
                    at = stack.pop()
                    for row in TreeReader({}).read(_Part(root, at, 0)) if at != root else _children(root):
                        rows.append((*row[:7], ordinal, row[8], False))
                        ordinal += 1
                        if row[1]:
                            stack.append(row[0])
                    if len(rows) >= 10_000:
                        yield _frame(rows)
                        rows = []
                rows += [(at, True, True, None, 0, 0, root, 0, None, True) for at in stack]
                yield _frame(rows)

    open_ = spark.createDataFrame([(r, r) for r in roots if os.path.isdir(r)], "root string, path string")
    rounds = []
    while n := open_.count():
        found = save(open_.repartition(max(1, min(-(-n // budget), 100_000)), "path").mapInPandas(run, SCAN_FILE + ", _open boolean"))
        rounds.append(found.filter("not _open").drop("_open"))
        open_ = found.filter("_open").select("root", "path")
    return functools.reduce(DataFrame.unionByName, rounds) if rounds else spark.createDataFrame([], SCAN_FILE)


def _children(root: str) -> Iterator[tuple]:
    """A root's entries without its own row."""
    rows = TreeReader({}).read(_Part(root, root, 0))
    next(rows)
    return rows


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names_ = [c.split()[0] for c in SCAN_FILE.split(", ")] + ["_open"]
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(names_, zip(*rows))} if rows else {c: pd.Series(dtype=object) for c in names_})


def stream(spark: SparkSession, roots: list[str], **options: object) -> DataFrame:
    """Files of trees as they come; options as above."""
    spark.dataSource.register(TreeSource)
    return spark.readStream.format("tree").options(roots=json.dumps(roots), **options).load()


def files(tree: DataFrame) -> DataFrame:
    """The files that could be read, a missing ctime as mtime."""
    return tree.filter("not is_dir and error is null").withColumn("ctime", values.created_or_changed("ctime", "mtime"))


def images(tree: DataFrame, extensions: list[str], least_kib: int = 0) -> DataFrame:
    return files(tree).filter(filters.has_extension("path", extensions) & filters.at_least("size", least_kib))


def archives(tree: DataFrame) -> DataFrame:
    return files(tree).filter(names.is_archive("path"))


def tagged(tree: DataFrame, extensions: list[str]) -> DataFrame:
    """Images whose name holds an id (pid), each path once whatever its case."""
    own = files(tree).filter(filters.has_extension("path", extensions))
    own = own.withColumn("file_name", F.element_at(F.split("path", r"[/\\]"), -1)).withColumn("pid", names.digit_id("file_name")).filter("pid is not null")
    return filters.distinct_ignoring_case(own, "path", "path")


def hashed(tree: DataFrame, kind: str = "sha256") -> DataFrame:
    """files with the SHA-256 or BLAKE3 (`blake3`) of their content, read in pieces of 1 MiB; those that can't be read have an error."""
    import hashlib

    import pandas as pd

    from stratalog.functions.blake3 import hexdigest

    def digest(pieces) -> str:
        if kind == "blake3":
            return hexdigest(pieces)
        h = hashlib.new(kind)
        for p in pieces:
            h.update(p)
        return h.hexdigest()

    def run(frames):
        for f in frames:
            out, errors = [], []
            for p in f.path:
                try:
                    with open(p, "rb") as s:
                        out.append(digest(iter(lambda: s.read(1 << 20), b"")))  # noqa: B023
                    errors.append(None)
                except OSError as e:
                    out.append(None), errors.append(str(e))
            yield f.assign(hash=pd.Series(out, f.index, dtype=object), error=pd.Series(errors, f.index, dtype=object))

    own = files(tree)
    return own.mapInPandas(run, SCAN_FILE + ", hash string")
