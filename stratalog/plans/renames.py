"""Plans as data: rename by identity, change of suffix, organise by bracket, move, backup. Nothing touches
a disk here. A plan is made for all files and resolved before a selection is taken from it, so numbers stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import names, paths
from stratalog.operators.collisions import resolve
from stratalog.operators.trees import longest_root


def rename_plan(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """files(old_path, guid, version, author, error): by path order, each to its identity's name in its folder.
    Files already named so (numbers aside) are left out; unreadable ones keep their path and carry a warning."""
    name = paths.basename("old_path")
    base = names.identity_name("guid", "author", "version")
    fine = F.col("error").isNull()
    named = (F.lower(F.coalesce(names.suffix(name), F.lit(""))) == names.ARCHIVE_EXTENSION) & (names.without_number(names.stem(name)) == base)
    own = files.filter(~(fine & named)).withColumn("target", F.when(fine, paths.join(paths.parent("old_path"), F.concat(base, F.lit(names.ARCHIVE_EXTENSION)))))
    return resolve(own, existing, order_col="old_path").withColumn("new_path", F.coalesce("new_path", "old_path")).withColumnRenamed("error", "warn").drop("target")


def suffix_plan(files: DataFrame, suffix: str, existing: DataFrame | None = None, order_col: str = "ordinal") -> DataFrame:
    """files(old_path): the same stem with another suffix; files that have it already are left out."""
    s = suffix.strip()
    if not s:
        raise ValueError("the suffix is empty")
    s = s if s.startswith(".") else f".{s}"
    target = paths.join(paths.parent("old_path"), F.concat(names.stem(paths.basename("old_path")), F.lit(s)))
    own = files.withColumn("target", target).filter(F.col("target") != paths.slashed("old_path"))
    return resolve(own, existing, order_col=order_col).drop("target")


def organize_plan(files: DataFrame, existing: DataFrame | None = None, order_col: str = "ordinal") -> DataFrame:
    """files(old_path, root): into the folder of root that the name's first bracket says."""
    name = paths.basename("old_path")
    own = files.withColumn("folder_name", F.trim(names.bracketed(name))).filter("folder_name <> ''")
    folder = paths.join(F.col("root"), F.col("folder_name"))
    own = own.filter(paths.parent("old_path") != folder).withColumn("target", paths.join(folder, name))
    return resolve(own, existing, order_col=order_col).drop("target")


def executable(plan: DataFrame) -> DataFrame:
    """What can be carried out: without a warning, to another path."""
    warn = F.col("warn").isNull() if "warn" in plan.columns else F.lit(True)
    return plan.filter(warn & (F.col("old_path") != F.col("new_path")))


def target_dir(argument: Column, setting: Column, default: Column, task_id: Column) -> Column:
    """The first of the three that isn't blank, and below it the task's id."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return paths.join(F.coalesce(full(argument), full(setting), default), task_id)


def move_plan(files: DataFrame, target: str, existing: DataFrame | None = None, roots: DataFrame | None = None, order_col: str = "ordinal", suffixed: bool = True) -> DataFrame:
    """files(src_path, size, found, readable): error_code NOT_FOUND, META_FAILED or BAD_FILE_NAME, or a target below
    `target`, with the folders below a file's longest root where roots are given. Not suffixed: see resolve()."""
    name = paths.basename("src_path")
    code = F.when(~F.col("found"), "NOT_FOUND").when(~F.col("readable"), "META_FAILED").when(F.coalesce(name, F.lit("")).isin("", ".", ".."), "BAD_FILE_NAME")
    own = files.withColumn("error_code", code)
    own = longest_root(own, roots, "src_path") if roots is not None else own.withColumn("relative", F.lit(None).cast("string"))
    own = own.withColumn("target", F.when(F.col("error_code").isNull(), paths.join(F.lit(target), F.col("relative"), name)))
    return resolve(own, existing, order_col=order_col, suffixed=suffixed).withColumnRenamed("new_path", "dst_path").drop("target", "relative", "root")


def with_failures(plan: DataFrame, failed: DataFrame) -> DataFrame:
    """A move plan after it was carried out: failed(src_path, error_message) become MOVE_FAILED; success is set."""
    out = plan.join(failed.select("src_path", F.col("error_message").alias("_m")), "src_path", "left")
    code = F.when(F.col("error_code").isNotNull(), F.col("error_code")).when(F.col("_m").isNotNull(), "MOVE_FAILED")
    return out.withColumn("error_code", code).withColumn("error_message", F.col("_m")).withColumn("success", F.col("error_code").isNull()).drop("_m")


def backup_plan(files: DataFrame, record_id: str, backup_root: str | None, roots: DataFrame | None = None, existing: DataFrame | None = None, order_col: str = "ordinal", suffixed: bool = True) -> DataFrame:
    """files(old_path): to backup_root/record_id/folders/name; with no backup root new_path is empty, a real delete.
    Not suffixed: see resolve()."""
    if backup_root is None:
        return files.withColumn("new_path", F.lit("")).withColumn("conflict", F.lit(False))
    name = F.coalesce(F.nullif(paths.basename("old_path"), F.lit("")), F.lit("unknown.zipmod"))
    own = longest_root(files, roots, "old_path") if roots is not None else files.withColumn("relative", F.lit(None).cast("string"))
    own = own.withColumn("target", paths.join(F.lit(backup_root), F.lit(record_id), F.col("relative"), name))
    return resolve(own, existing, order_col=order_col, suffixed=suffixed).drop("target", "relative", "root")


def tag_move_plan(files: DataFrame, out_dir: str, existing: DataFrame | None = None, order_col: str = "ordinal") -> DataFrame:
    """files(old_path, tag): to out_dir/tag as a folder/name; tags that clean to nothing are left out."""
    own = files.withColumn("_folder", names.folder_name("tag")).filter("_folder <> ''")
    own = own.withColumn("target", paths.join(F.lit(out_dir), F.col("_folder"), paths.basename("old_path"))).drop("_folder")
    return resolve(own, existing, order_col=order_col).drop("target")
