"""Carrying out plans on a mounted file system. Nothing else in the library changes a disk, and nothing here
runs unless it is called. Failures are rows; a plan is never stopped by one."""

from __future__ import annotations

import errno
import functools
import hashlib
import json
import os
import shutil
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.schema import OUTCOME


def move(old: str, new: str) -> None:
    """Rename; across devices copy, then delete, taking the copy back if the delete fails."""
    try:
        os.rename(old, new)
    except OSError as e:
        if e.errno != errno.EXDEV and getattr(e, "winerror", None) != 17:
            raise
        shutil.copy2(old, new)
        try:
            os.remove(old)
        except OSError:
            os.remove(new)
            raise


def delete(old: str, new: str) -> None:
    os.remove(old)


def remove_dir(old: str, new: str) -> None:
    os.rmdir(old)


def make_dir(old: str, new: str) -> None:
    os.makedirs(old, exist_ok=True)


def rewrite_archive(path: str, entry: str, content: bytes) -> None:
    """The archive with one entry's content replaced, others as they are, through a temporary sibling."""
    sibling = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with zipfile.ZipFile(path) as old, zipfile.ZipFile(sibling, "w") as new:
            for info in old.infolist():
                own = info.filename.lower() == entry.lower()
                new.writestr(info, content if own else old.read(info), compress_type=info.compress_type)
        os.replace(sibling, path)
    finally:
        if os.path.exists(sibling):
            os.remove(sibling)


class Journal:
    """What became of each pair, as files of a folder on the same file systems: one is written before a pair is carried out, one
    with its outcome after. A pair that has an outcome is not carried out again; of one that has only begun the disk tells
    whether it was done."""

    def __init__(self, folder: str):
        self.folder = folder

    def _file(self, pair: tuple, kind: str) -> str:
        name = hashlib.sha256(json.dumps([str(x) for x in pair]).encode()).hexdigest()
        return f"{self.folder}/{name[:2]}/{name}.{kind}"

    def _write(self, at: str, content: object) -> None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        sibling = f"{at}.{uuid.uuid4().hex}"
        with open(sibling, "w", encoding="utf-8") as out:
            json.dump(content, out)
            out.flush()
            os.fsync(out.fileno())
        os.replace(sibling, at)

    def outcome(self, pair: tuple) -> list | None:
        try:
            with open(self._file(pair, "done"), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def begun(self, pair: tuple) -> bool:
        """Whether the pair has begun, with its old path there."""
        try:
            with open(self._file(pair, "begun"), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return False

    def begin(self, pair: tuple) -> None:
        self._write(self._file(pair, "begun"), os.path.lexists(pair[1]))

    def end(self, pair: tuple, ok: bool, error: str | None) -> None:
        self._write(self._file(pair, "done"), [ok, error])


def _is_done(action, old: str, new: str) -> bool:
    """Whether an action that has begun shows on disk. One that can be repeated as it is never does."""
    if action is move and new:
        return os.path.lexists(new) and not os.path.lexists(old)
    return action in (delete, remove_dir) and not os.path.lexists(old)


def _carried_out(old: str, new: str, action, begun: bool) -> tuple[bool, str | None]:
    action = delete if action is move and not new else action
    try:
        # a plan's targets are free when it is made, so a move whose old path is gone and whose new path is there is done
        if (begun or action is move) and _is_done(action, old, new):
            return True, None
        if action is move:
            os.makedirs(os.path.dirname(new), exist_ok=True)
        action(old, new)
        return True, None
    except (OSError, LookupError, ValueError, zipfile.BadZipFile) as e:
        return False, str(e)


def carry_out(plan: DataFrame, action=move, journal: str | None = None, tasks: int | None = None) -> DataFrame:
    """plan(ordinal, old_path, new_path) with success and error of each row. An empty new_path deletes where action is move. With a
    journal's folder a task that is run again, or a plan that is gone on with after its driver was lost, repeats nothing and gives the outcomes of the
    first time; without one, collect or write the result once: only moves are known as done.
    A plan is a few bytes a row but its deeds take long: with `tasks` it is dealt out to so many."""

    def run(frames):
        kept = Journal(journal) if journal else None
        for f in frames:
            ok, errors = [], []
            for pair in zip(f.ordinal, f.old_path, f.new_path):
                known = kept.outcome(pair) if kept else None
                if known is None:
                    begun = bool(kept and kept.begun(pair))
                    if kept and not begun:
                        kept.begin(pair)
                    known = _carried_out(pair[1], pair[2], action, begun)
                    if kept:
                        kept.end(pair, *known)
                ok.append(known[0]), errors.append(known[1])
            yield f.assign(success=ok, error=errors)[["ordinal", "old_path", "new_path", "success", "error"]]

    own = plan.select("ordinal", "old_path", "new_path")
    return (own.repartition(tasks, "ordinal") if tasks else own).mapInPandas(run, OUTCOME)


def in_waves(plan: DataFrame, action, save: Callable[[DataFrame], DataFrame], depth_col: str = "depth", journal: str | None = None) -> DataFrame:
    """carry_out() of the deepest paths first, all of a depth before the next, however the rows are dealt: folders are removed
    after those inside them. save(df) -> df writes a table. There are as many jobs as depths."""
    depths = sorted((r[0] for r in plan.select(depth_col).distinct().collect()), reverse=True)
    waves = [save(carry_out(plan.filter(F.col(depth_col) == d), action, journal)) for d in depths]
    return functools.reduce(DataFrame.unionByName, waves) if waves else plan.sparkSession.createDataFrame([], OUTCOME)
