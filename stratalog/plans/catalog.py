"""Hash snapshots, move reports and the operation log as one store, so that what belongs together is committed together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.plans import oplog, snapshots
from stratalog.plans.store import Store

#: the tables
RECORDS, ENTRIES, REPORTS, REPORT_ITEMS, OP_RECORDS, OP_ITEMS = "hash_records", "hash_entries", "move_reports", "move_report_items", "op_records", "op_items"


class Catalog:
    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def _one(self, **values_: object) -> DataFrame:
        """A row; lists are arrays of strings."""
        col = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v).cast("long") if type(v) is int else F.lit(v)
        return self.spark.range(1).select(*[col(v).alias(k) for k, v in values_.items()])

    # snapshots

    def _known(self, kind: str, record_id: str):
        """A check that a record is there, asked of the version a commit goes on."""

        def check(tables: dict) -> None:
            if not any(e["tags"].get("record_id") == record_id for e in tables.get(kind, {"rows": []})["rows"]):
                raise LookupError(record_id)

        return check

    def _new(self, kind: str, record_id: str):
        def check(tables: dict) -> None:
            if any(e["tags"].get("record_id") == record_id for e in tables.get(kind, {"rows": []})["rows"]):
                raise ValueError(f"{record_id} is there already")

        return check

    def save_snapshot(self, record_id: str, name: str, created_at: int, sources: list[str], entries: DataFrame) -> int:
        """entries(hash, file_path, file_size, mtime, ctime, status) and their record."""
        tags = {"record_id": record_id}
        own = entries.withColumn("record_id", F.lit(record_id))
        change = self.store.begin().append(ENTRIES, own, tags)
        change.append(RECORDS, self._one(record_id=record_id, record_name=name, created_at=created_at, source_paths=sources), tags)
        return change.commit(self._new(RECORDS, record_id))

    def snapshots(self, version: int | None = None) -> DataFrame:
        """Records, latest first, with the number of their entries."""
        return snapshots.listed(self.store.read(RECORDS, version), self.store.read(ENTRIES, version))

    def load_snapshot(self, record_id: str, version: int | None = None) -> DataFrame:
        """A record's entries, from its own files; a missing ctime reads as mtime."""
        return snapshots.loaded(self.store.read(ENTRIES, version, {"record_id": record_id}), record_id)

    def rename_snapshot(self, record_id: str, name: str) -> int:
        """ValueError for a blank name, LookupError for an unknown record."""
        return self._rename(RECORDS, record_id, name)

    def _rename(self, kind: str, record_id: str, name: str) -> int:
        if not (name := name.strip()):
            raise ValueError("the name is empty")
        return self.store.begin().update(kind, ["record_id"], self._one(record_id=record_id, record_name=name)).commit(self._known(kind, record_id))

    def delete_snapshot(self, record_id: str) -> int:
        """The record goes with its entries; no file is read."""
        tags = {"record_id": record_id}
        return self.store.begin().drop(RECORDS, tags).drop(ENTRIES, tags).commit(self._known(RECORDS, record_id))

    def save_move(self, report_id: str, task_id: str, created_at: int, target_dir: str, items: DataFrame) -> int:
        """items(src_path, dst_path, success, error_code, error_message, size): the report with its totals and items, and what was moved leaves every snapshot."""
        tags = {"report_id": report_id}
        totals = snapshots.move_report(items).select(
            F.lit(report_id).alias("report_id"), F.lit(task_id).alias("task_id"), F.lit(created_at).cast("long").alias("created_at"), F.lit(target_dir).alias("target_dir"), "total_selected", "total_success", "total_failed", "released_bytes"
        )
        change = self.store.begin().append(REPORTS, totals, tags).append(REPORT_ITEMS, items.withColumn("report_id", F.lit(report_id)), tags)
        moved = items.filter("success").select(F.col("src_path").alias("file_path"))
        if ENTRIES in self.store.manifest()["tables"]:
            change.delete(ENTRIES, moved)
        return change.commit()

    # the operation log

    def log(self, outcome: DataFrame, record_id: str, domain: str, name: str, extra: str | None, sources: list[str], at: int, rollback_enabled: bool = True) -> int:
        """outcome(ordinal, old_path, new_path, success, error) as a record and its items, which get ids in the order of `ordinal`."""
        record = oplog.record_of(self.spark, record_id, domain, name, extra, sources, at, rollback_enabled)
        items = oplog.items_of(outcome, record_id, at)
        tags = {"record_id": record_id}
        change = self.store.begin().append(OP_ITEMS, items, tags, id_col="id", order=["ordinal"]).append(OP_RECORDS, record, tags)
        return change.commit(self._new(OP_RECORDS, record_id))

    def operations(self, version: int | None = None) -> DataFrame:
        """Records of all ages in one shape, latest first, with the numbers of their items."""
        found = oplog.summaries(self.store.read(OP_RECORDS, version), self.store.read(OP_ITEMS, version))
        return oplog.described(found).orderBy(F.desc("created_at"), "record_id")

    def items(self, record_id: str, version: int | None = None) -> DataFrame:
        """A record's items by id, from its own files."""
        own = self.store.read(OP_ITEMS, version, {"record_id": record_id})
        return own.filter(F.col("record_id") == record_id).drop("ordinal").orderBy("id")

    def rolled_back(self, record_id: str, events: DataFrame) -> int:
        """events(id, rollback_success, rollback_error, updated_at): the items' results and the record's new status in one commit."""
        status = F.when(F.col("rollback_success"), "success").when(F.col("rollback_error") == "SKIPPED_NOT_FOUND", "skipped_missing").otherwise("failed")
        totals = oplog.rollback_totals(events.select(F.lit(record_id).alias("record_id"), status.alias("status")), ["record_id"])
        change = self.store.begin().update(OP_ITEMS, ["id"], events.select("id", "rollback_success", "rollback_error", "updated_at"))
        return change.update(OP_RECORDS, ["record_id"], totals.select("record_id", "rollback_status")).commit(self._known(OP_RECORDS, record_id))

    def rename_operation(self, record_id: str, name: str) -> int:
        return self._rename(OP_RECORDS, record_id, name)

    def delete_operations(self, record_ids: list[str]) -> int:
        """Records go with their items, all in one commit."""
        change = self.store.begin()
        for r in record_ids:
            change.drop(OP_RECORDS, {"record_id": r}).drop(OP_ITEMS, {"record_id": r})
        return change.commit()

