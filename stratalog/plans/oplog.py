"""The operation log: records and items of applied plans, rollback planning, and its state.

Items are immutable; a rollback appends item events, and the latest event of an item counts. Ids and times
are parameters, so the same call gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators.collisions import resolve
from stratalog.operators.streams import numbered
from stratalog.operators.trees import select_below
from stratalog.scratch import save


def record_of(spark: SparkSession, record_id: str, domain: str, name: str, extra: str | None, sources: list[str], at: int, rollback_enabled: bool = True) -> DataFrame:
    """The record of an applied plan."""
    return spark.range(1).select(
        F.lit(record_id).alias("record_id"), F.lit(domain).alias("domain"), F.lit(name).alias("record_name"), F.coalesce(F.lit(extra).cast("string"), F.lit("")).alias("extra"),
        F.array(*[F.lit(s) for s in sources]).cast("array<string>").alias("source_paths"), F.lit(at).cast("long").alias("created_at"), F.lit("applied").alias("rollback_status"), F.lit(rollback_enabled).alias("rollback_enabled"),
    )


def items_of(outcome: DataFrame, record_id: str, at: int) -> DataFrame:
    """The items of outcome(ordinal, old_path, new_path, success, error), without their ids."""
    return outcome.select(
        "ordinal", F.lit(record_id).alias("record_id"), "old_path", "new_path", F.col("success").alias("apply_success"), F.col("error").alias("apply_error"),
        F.lit(None).cast("boolean").alias("rollback_success"), F.lit(None).cast("string").alias("rollback_error"), F.lit(at).cast("long").alias("updated_at"),
    )


def logged(outcome: DataFrame, record_id: str, domain: str, name: str, extra: str | None, sources: list[str], at: int, first_id: int = 1, rollback_enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(record, items) of outcome(ordinal, old_path, new_path, success, error); ids count up in input order."""
    items = numbered(items_of(outcome, record_id, at), ["ordinal"], save, first_id, "id")
    return record_of(outcome.sparkSession, record_id, domain, name, extra, sources, at, rollback_enabled), items.select(F.col("id").cast("long").alias("id"), *[c for c in items.columns if c not in ("id", "ordinal")])


def summaries(records: DataFrame, items: DataFrame, key: str = "record_id", success: Column | None = None) -> DataFrame:
    """records with total_items and success_items, 0 where there are none; sort by created_at desc, key to list."""
    ok = F.col("apply_success") if success is None else success
    counts = items.groupBy(key).agg(F.count(F.lit(1)).alias("total_items"), F.count_if(ok).alias("success_items"))
    return records.join(counts, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_items", "success_items")})


def apply_totals(items: DataFrame) -> DataFrame:
    ok = F.col("apply_success")
    return items.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))


def chosen(items: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Applied items, of the ids given if any."""
    own = items.filter("apply_success")
    return own if ids is None else own.join(ids.select("id").distinct(), "id", "left_semi")


def rollback_check(items: DataFrame, present: DataFrame, ids: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """total_selected, existing and missing of what a rollback would move; present(path) is what there is now."""
    here = present.select(F.col("path").alias("new_path")).distinct().withColumn("_here", F.lit(True))
    own = chosen(items, ids).join(here, "new_path", "left").withColumn("_here", F.coalesce("_here", F.lit(False)))
    return own.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total_selected"), F.count_if("_here").alias("existing"), F.count_if(~F.col("_here")).alias("missing"))


def rollback_plan(items: DataFrame, present: DataFrame, existing: DataFrame, enabled: bool = True, force: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """Per chosen item: action restore or skip, its restore_path (beside what has its old path now) and message.
    Refused (ValueError) where the record can't be rolled back, or files are missing and it isn't forced."""
    if not enabled:
        raise ValueError("the record can't be rolled back")
    here = present.select(F.col("path").alias("new_path")).distinct().withColumn("_here", F.lit(True))
    own = chosen(items, ids).join(here, "new_path", "left")
    if not force and own.filter("_here is null").limit(1).count():
        raise ValueError("files are missing; force the rollback to skip them")
    own = own.withColumn("target", F.when(F.col("_here"), F.col("old_path")))
    own = own.withColumnRenamed("new_path", "moved_path")
    out = resolve(own, existing, order_col="id").withColumnRenamed("new_path", "restore_path").withColumnRenamed("moved_path", "new_path")
    message = F.when(F.col("_here").isNull(), "SKIPPED_NOT_FOUND").when(F.col("conflict"), F.concat(F.lit("restored to "), F.col("restore_path")))
    return out.withColumn("action", F.when(F.col("_here"), "restore").otherwise("skip")).withColumn("message", message).drop("_here", "target", "conflict")


def rollback_events(plan: DataFrame, failed: DataFrame, at: int) -> DataFrame:
    """Item events after a plan was carried out: failed(id, error). A note of a changed place stays in
    rollback_error of a success."""
    out = plan.join(failed.select("id", F.col("error").alias("_e")), "id", "left")
    ok = (F.col("action") == "restore") & F.col("_e").isNull()
    return out.select("id", "record_id", ok.alias("rollback_success"), F.coalesce("_e", "message").alias("rollback_error"), F.lit(at).cast("long").alias("updated_at"))


def with_item_ids(plan: DataFrame, items: DataFrame) -> DataFrame:
    """Plan rows with the id of the item that has their old path."""
    return plan.join(items.select("old_path", "id"), "old_path", "left")


def status_of(success: Column, failed: Column, skipped: Column) -> Column:
    return F.when((success > 0) & (failed == 0) & (skipped == 0), "rolled_back").when(success > 0, "partially_rolled_back").otherwise("applied")


def rollback_totals(results: DataFrame, by: list[str]) -> DataFrame:
    """results(status success, failed or skipped_missing): totals, the record's new status, and coverage: whether
    all of the record's items (column n_items, if there is one) took part."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = results.groupBy(*by).agg(F.count(F.lit(1)).alias("total_selected"), count("success"), count("failed"), count("skipped_missing"), *([F.max("n_items").alias("n_items")] if "n_items" in results.columns else []))
    out = out.withColumn("rollback_status", status_of(F.col("success"), F.col("failed"), F.col("skipped_missing")))
    return out.withColumn("coverage", F.col("total_selected") == F.col("n_items")).drop("n_items") if "n_items" in out.columns else out


def with_events(items: DataFrame, events: DataFrame) -> DataFrame:
    """items as their latest events leave them."""
    last = events.groupBy("id").agg(F.max_by(F.struct("rollback_success", "rollback_error", "updated_at"), "updated_at").alias("_l"))
    out = items.join(last, "id", "left")
    return out.withColumns({c: F.when(F.col("_l").isNotNull(), F.col(f"_l.{c}")).otherwise(F.col(c)) for c in ("rollback_success", "rollback_error", "updated_at")}).drop("_l")


def with_status(records: DataFrame, record_id: str, status: str) -> DataFrame:
    return records.withColumn("rollback_status", F.when(F.col("record_id") == record_id, status).otherwise(F.col("rollback_status")))


def without_records(records: DataFrame, items: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables without the records: items are removed explicitly."""
    gone = F.col("record_id").isin(ids)
    return records.filter(~gone), items.filter(~gone)


def renamed(records: DataFrame, record_id: str, name: str) -> DataFrame:
    """ValueError for a blank name, LookupError for an unknown record."""
    if not (name := name.strip()):
        raise ValueError("the name is empty")
    if not records.filter(F.col("record_id") == record_id).limit(1).count():
        raise LookupError(record_id)
    return records.withColumn("record_name", F.when(F.col("record_id") == record_id, name).otherwise(F.col("record_name")))


def described(records: DataFrame) -> DataFrame:
    """Records of any domain and age in one shape: a missing extra is empty, rollback is enabled by default."""
    return records.withColumn("extra", F.coalesce("extra", F.lit(""))).withColumn("rollback_enabled", F.coalesce("rollback_enabled", F.lit(True)))


def empty_dir_rollback(items: DataFrame, present: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Directories to make again, outermost first; present(path, is_dir): a file in the place blocks. A selected
    directory selects what lay below it."""
    own = items.filter("apply_success")
    if selected is not None:
        own = select_below(own.withColumn("path", F.col("old_path")), selected).drop("path")
    here = present.groupBy(F.col("path").alias("old_path")).agg(F.max(~F.col("is_dir")).alias("_file"), F.lit(True).alias("_here"))
    out = own.join(here, "old_path", "left")
    action = F.when(F.coalesce("_file", F.lit(False)), "blocked").when(F.col("_here"), "present").otherwise("create")
    return out.withColumn("action", action).withColumn("depth", F.size(F.split("old_path", "[/\\\\]"))).drop("_file", "_here")
