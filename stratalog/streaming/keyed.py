"""Groups that grow as files come, from keyed state: a trigger reads its own rows and the state of the groups they touch, no history.

The state of a group is how many members it has, which of them is kept, and its members while they are too few to be a group. So
every member is emitted once: those that were held back when the group gets its least size, later ones as they come. A trigger
also emits a header of every group it touched. The members of touched groups, in full, are members() of the headers'
keys. Members are told apart by an id, one that comes again changes nothing; order of arrival doesn't matter, the kept member is
the first by `order` and id of all.

State lies in RocksDB at the query's checkpoint and changes with its triggers: a trigger that is run again starts from
the state before it and replaces what it had emitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stratalog.streaming import progressive

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HEADER, MEMBER = "header", "member"


class _Group(StatefulProcessor):
    def __init__(self, keys: list[str], columns: list[str], order: list[str], id_col: str, least: int, newest: bool, kept: T.StructType, held: T.StructType):
        self.keys, self.columns, self.order, self.id_col, self.least, self.newest, self.kept_type, self.held_type = keys, columns, order, id_col, least, newest, kept, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", self.kept_type)
        self.held = handle.getListState("held", self.held_type)
        self.row = Row("kind", "n", "kept", *self.keys, *self.columns)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = self.kept.get() if self.kept.exists() else None
        n, best = (state[0], tuple(state[1:])) if state else (0, None)
        waiting = [tuple(r) for r in self.held.get()] if 0 < n < self.least else []
        before, none = len(waiting), (None,) * len(self.columns)
        for r in rows:
            n += 1
            own = tuple(r[c] for c in (*self.order, self.id_col))
            if best is None or self._rank(own) < self._rank(best):
                best = own
            values = tuple(r[c] for c in self.columns)
            if n < self.least:
                waiting.append(values)
                continue
            for w in waiting:
                yield self.row(MEMBER, None, None, *key, *w)
            waiting = []
            yield self.row(MEMBER, None, None, *key, *values)
        if n >= self.least:
            if before:
                self.held.clear()
            yield self.row(HEADER, n, best[-1], *key, *none)
        elif len(waiting) > before:
            self.held.put(waiting)
        self.kept.update((n, *best))

    def _rank(self, own: tuple) -> tuple:
        """Sorts by order, the newest first if that is kept, nulls last, then by id."""
        *order, name = own
        parts = [(x is None, x) for x in order]
        if self.newest:
            parts = [(x is None, _Reversed(x)) for x in order]
        return (*parts, (name is None, name))

    def close(self) -> None:
        pass


class _Reversed:
    def __init__(self, x):
        self.x = x

    def __lt__(self, other) -> bool:
        return other.x < self.x

    def __eq__(self, other) -> bool:
        return other.x == self.x


def touched(stream: DataFrame, keys: list[str], id_col: str, order: list[str], least: int = 2, newest: bool = False) -> DataFrame:
    """Changes of groups, trigger by trigger, for append mode: rows of kind `header` with the group's number of members `n` and the
    id of the `kept` one, and of kind `member` with the stream's columns. Of rows without an id one counts."""
    schema = stream.schema
    columns = [c for c in stream.columns if c not in keys]
    nullable = lambda c: T.StructField(c, schema[c].dataType, True)
    kept = T.StructType([T.StructField("n", T.LongType()), *[T.StructField(f"o{i}", schema[c].dataType) for i, c in enumerate(order)], T.StructField("id", schema[id_col].dataType)])
    held = T.StructType([nullable(c) for c in columns])
    out = T.StructType([T.StructField("kind", T.StringType()), T.StructField("n", T.LongType()), T.StructField("kept", schema[id_col].dataType), *map(nullable, keys), *held.fields])
    known = {"kind", "n", "kept"} & {*stream.columns}
    if known:
        raise ValueError(f"columns that the changes have themselves: {sorted(known)}")
    processor = _Group(keys, columns, order, id_col, least, newest, kept, held)
    once = stream.dropDuplicates([id_col])
    return once.groupBy(*keys).transformWithState(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="None")


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """As progressive.start(), with the state in RocksDB, which keyed state needs; the session's own setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, PROVIDER)
    try:
        return progressive.start(df, sink, checkpoint, "append", every)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def changes_into(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each trigger's changes under its number; a trigger that is run again replaces its own."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def headers(spark: SparkSession, path: str, keys: list[str], since: int = 0) -> DataFrame:
    """The groups that were touched since a trigger, as they stand: keys, n and kept."""
    rows = spark.read.parquet(path).filter((F.col("kind") == HEADER) & (F.col("batch") >= since))
    return rows.groupBy(*keys).agg(F.max_by(F.struct("n", "kept"), "batch").alias("g")).select(*keys, "g.*")


def members(spark: SparkSession, path: str, keys: list[str], of: DataFrame | None = None) -> DataFrame:
    """The members of all groups, or of those in `of`."""
    rows = spark.read.parquet(path).filter(F.col("kind") == MEMBER).drop("kind", "n", "kept", "batch")
    return rows if of is None else rows.join(of.select(*keys).distinct(), keys, "left_semi")
