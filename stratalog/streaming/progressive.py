"""Progressive results over file streams: touched groups, latest values, logs, progress, control."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 256) -> DataFrame:
    """Parquet files as they come; files_per_trigger is the back pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def touched_groups(stream: DataFrame, keys: list[str], having: Column | None = None, id_col: str = "event_id") -> DataFrame:
    """Counts per key for update mode: each trigger emits the groups it touched, as they stand: their number of rows, and the
    smallest and largest id. For their members see members_into()."""
    out = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))
    return out.filter(having) if having is not None else out


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", every: str | None = None) -> StreamingQuery:
    """Micro-batches to sink(batch, number); all there is now, or for ever at an interval such as 250 milliseconds.
    The end of an all-there-is query is the stream's `done`."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def latest_into(path: str, key: str, order_col: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends each batch's last row per key under the batch's number (a repeated batch replaces
    itself); read with latest()."""

    def sink(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order_col).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def members_into(path: str, keys: list[str], least: int = 2) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch's rows and emits the groups it touched with all their members so far, where they have at least
    `least`. A batch that comes again replaces itself. Emissions are read with latest_members()."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        rows = spark.read.schema(batch.schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows").filter(F.col("batch") <= number).drop("batch")
        touched = spark.read.schema(batch.schema).parquet(f"{path}/rows/batch={number}").select(*keys).distinct()
        full = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*keys)
        rows.join(touched.join(full, keys, "left_semi"), keys, "left_semi").write.mode("overwrite").parquet(f"{path}/groups/batch={number}")

    return sink


def latest_members(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of every group the members of its last emission."""
    rows = spark.read.parquet(f"{path}/groups")
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "batch"], "left_semi").drop("batch")


def latest(spark: SparkSession, path: str, key: str, order_col: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(order_col, "batch")).alias("r")).select("r.*").drop("batch")


def capped(log: DataFrame, cap: int = 3000) -> DataFrame:
    """The newest rows of a log that a sink has written."""
    return log.orderBy(F.desc("seq")).limit(cap)


class Progress(StreamingQueryListener):
    """Calls emit(name, batch, rows) after every trigger and emit(name, -1, 0) at the end."""

    def __init__(self, emit: Callable[[str | None, int, int], None]):
        self.emit, self.names = emit, {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.emit(p.name, p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.emit(self.names.pop(str(event.id), None), -1, 0)


def reporting(sink: Callable[[DataFrame, int], None], path: str) -> Callable[[DataFrame, int], None]:
    """sink, and a row of progress for each trigger: its number and rows. A trigger that is run again replaces its own."""

    def run(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        batch.agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def progress(spark: SparkSession, path: str, total: int) -> DataFrame:
    """Per trigger batch, rows, processed so far, total and percent (0 where total is). One row a trigger, so one task sorts them."""
    rows = spark.read.parquet(path)
    done = F.sum("rows").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))
    percent = F.when(F.lit(total) > 0, F.col("processed") / total * 100).otherwise(F.lit(0.0))
    return rows.select(F.col("batch").cast("long").alias("batch"), "rows", done.alias("processed")).withColumn("total", F.lit(total).cast("long")).withColumn("percent", percent)


class Cancelled(Exception):
    """Raised before a trigger of a task that was cancelled."""


class Task:
    """A task that can be paused between two triggers, goes on where it was, and can be cancelled for good. A name is active from
    start() to end(), whether or not it was cancelled; the caller may choose it."""

    _active: dict[str, Task] = {}
    _lock = threading.Lock()

    def __init__(self, name: str):
        self.name, self.state, self._changed = name, "running", threading.Condition()

    @classmethod
    def start(cls, name: str | None = None) -> Task:
        task = cls(name or uuid.uuid4().hex)
        with cls._lock:
            if task.name in cls._active:
                raise ValueError(f"{task.name} is active")
            cls._active[task.name] = task
        return task

    @classmethod
    def find(cls, name: str) -> Task | None:
        return cls._active.get(name)

    def end(self) -> None:
        with self._lock:
            self._active.pop(self.name, None)

    def _become(self, state: str) -> None:
        with self._changed:
            if self.state != "cancelled":
                self.state = state
            self._changed.notify_all()

    def pause(self) -> None:
        self._become("paused")

    def resume(self) -> None:
        self._become("running")

    def cancel(self) -> None:
        self._become("cancelled")

    def gate(self) -> None:
        """Waits while the task is paused."""
        with self._changed:
            self._changed.wait_for(lambda: self.state != "paused")
            if self.state == "cancelled":
                raise Cancelled(self.name)

    def guarded(self, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """sink, once the task lets a trigger through. A cancelled one isn't carried out, so the checkpoint has it still to come."""

        def run(batch: DataFrame, number: int) -> None:
            self.gate()
            sink(batch, number)

        return run


def is_active(spark: SparkSession, name: str) -> bool:
    return any(q.name == name for q in spark.streams.active)


def cancel(spark: SparkSession, name: str) -> bool:
    """Stops the named query; its checkpoint lets a new start go on where it was (pause and resume)."""
    found = [q for q in spark.streams.active if q.name == name]
    for q in found:
        q.stop()
    return bool(found)
