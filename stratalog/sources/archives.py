"""Zip archives and the identity manifests inside them, in any of three encodings."""

from __future__ import annotations

import io
import zipfile
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from stratalog.schema import MANIFEST

ENTRY = "manifest.xml"
#: The encodings that are tried, in order.
ENCODINGS = ("utf-8", "gbk", "shift_jis")
FIELDS = ("guid", "version", "author")
#: schema.MANIFEST as a type: workers import this module without a session, which DDL would need
_MANIFEST = T.StructType([*(T.StructField(f, T.StringType()) for f in FIELDS), T.StructField("games", T.ArrayType(T.StringType())), T.StructField("encoding", T.StringType()), T.StructField("error", T.StringType())])
_LISTING = T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.LongType()), T.StructField("is_dir", T.BooleanType()), T.StructField("modified_at", T.StringType()), T.StructField("truncated", T.BooleanType())])


def parse_manifest(text: str) -> dict:
    """First non-blank guid, version and author at any depth and all non-blank games; only the text directly
    after a start tag counts. Malformed XML raises."""
    found: dict = {f: "" for f in FIELDS} | {"games": []}
    tag, buffer = [None], []

    def close() -> None:
        value = "".join(buffer).strip()
        buffer.clear()
        if tag[0] and value:
            if tag[0] == "game":
                found["games"].append(value)
            elif tag[0] in FIELDS and not found[tag[0]]:
                found[tag[0]] = value
        tag[0] = None

    def start(name, _):
        close()
        tag[0] = name

    parser = expat.ParserCreate()
    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: close()
    parser.CharacterDataHandler = buffer.append
    # the declared encoding is for the bytes, which are decoded by now
    body = text.lstrip("﻿")
    if body.startswith("<?xml") and "?>" in body:
        body = body[body.index("?>") + 2 :]
    parser.Parse(body.encode("utf-8"), True)
    return found


def decode_manifest(raw: bytes) -> dict:
    """The reading with the most of the three fields; a later encoding has to beat an earlier one. An error of a
    reading that was needed is the result's error."""
    best, best_score = None, -1
    for encoding in ENCODINGS:
        try:
            text = raw.decode(encoding)
        except UnicodeDecodeError:
            continue
        try:
            found = parse_manifest(text)
        except expat.ExpatError as e:
            return _failed(f"malformed manifest: {e}")
        score = sum(bool(found[f]) for f in FIELDS)
        if score > best_score:
            best, best_score = found | {"encoding": encoding, "error": None}, score
        if best_score == len(FIELDS):
            break
    return best or _failed("unknown encoding")


def _failed(error: str) -> dict:
    return {f: "" for f in FIELDS} | {"games": [], "encoding": None, "error": error}


def read_entry(archive: bytes, name: str = ENTRY) -> bytes:
    """The first entry at the archive's root of that name, any case. KeyError where there is none."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        for info in z.infolist():
            if info.filename.lower() == name.lower():
                return z.read(info)
    raise KeyError(name)


def manifest_of(archive: bytes | None) -> dict:
    try:
        return decode_manifest(read_entry(archive or b""))
    except KeyError:
        return _failed("no manifest")
    except (zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError, EOFError) as e:
        return _failed(f"unreadable archive: {e}")


@pandas_udf(_MANIFEST)
def archive_manifest(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([manifest_of(c) for c in content], columns=[*FIELDS, "games", "encoding", "error"])


@pandas_udf(_MANIFEST)
def xml_manifest(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_manifest(c) if c is not None else _failed("no manifest") for c in content], columns=[*FIELDS, "games", "encoding", "error"])


def with_manifest(files: DataFrame, content: Column | str = "content") -> DataFrame:
    """files with guid, version, author, games, encoding and error; content isn't carried on."""
    out = files.withColumn("_m", archive_manifest(content))
    return out.select(*[c for c in files.columns if c != "content"], "_m.*")


def with_manifest_at(files: DataFrame, path_col: str = "path") -> DataFrame:
    """The same for files on a mounted file system: only the manifest is read from each archive."""

    def run(frames):
        for f in frames:
            found = []
            for p in f[path_col]:
                try:
                    with zipfile.ZipFile(p) as z:
                        info = next(i for i in z.infolist() if i.filename.lower() == ENTRY)
                        found.append(decode_manifest(z.read(info)))
                except StopIteration:
                    found.append(_failed("no manifest"))
                except (zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError, EOFError) as e:
                    found.append(_failed(f"unreadable archive: {e}"))
            yield pd.concat([f.reset_index(drop=True).drop(columns=["error"], errors="ignore"), pd.DataFrame(found, columns=[*FIELDS, "games", "encoding", "error"])], axis=1)

    own = files.drop("error")
    kinds = ", ".join(f"`{k}` {t}" for k, t in own.dtypes)
    return own.mapInPandas(run, f"{kinds}, {MANIFEST}")


def strict_text(content: Column | str) -> Column:
    """UTF-8 text, null if any byte isn't."""
    c = F.col(content) if isinstance(content, str) else content
    return F.try_validate_utf8(c.cast("string"))


@udtf(returnType=_LISTING)
class ArchiveListing:
    """The first `limit` entries of an archive; truncated says there are more."""

    def eval(self, content: bytes, limit: int = 5000):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                entries = z.infolist()
        except (zipfile.BadZipFile, TypeError):
            return
        for i in entries[:limit]:
            y, mo, d, h, mi, s = i.date_time
            ok = 1 <= mo <= 12 and 1 <= d <= 31 and h < 24 and mi < 60 and s < 60
            yield i.filename, i.file_size, i.is_dir(), f"{y:04}-{mo:02}-{d:02} {h:02}:{mi:02}:{s:02}" if ok else "", len(entries) > limit
