"""WARC archives of gzip members, one record each, written by tasks and read back in byte ranges.

write() gives every row a record: the whole payload in a `response`, or a `revisit` without it where another row of an equal
payload is the response. A task writes its rows to archives of about `target_bytes` in a shared folder, under fresh names, and
returns their names; the list is a written table, so an archive of a task that failed or ran twice is in no list.

read() cuts every archive into ranges. A task looks for gzip's magic bytes in its range, takes a place for a member's beginning
if a gzip header and then a WARC header decode there, and owns the records that begin inside; the last one may end beyond. A member
is decoded to its end, where the next one begins. Inside a member may lie bytes that look like one; what lies
in another record is dropped in the end, by the places of all records of an archive (settled()). What is found there but
doesn't decode to its end has an error and no digest.

Folders are opened through pyarrow (local ones, also with file:, hdfs:, s3: and what else it knows); others are refused.

Defined cases: a null payload is empty, a null URI has no field; a URI with control characters or blanks at its ends stands percent-encoded and,
as it is, in a field of its own; the response among rows of equal payloads is that of the smallest id, null ids last, and of repeated ids one; payloads smaller
than `least_bytes` are all responses; an empty table gives an empty list of archives; other columns, of whatever names,
are not written. Payloads are equal if their SHA-256 and length are. A record is held as a whole by the task that writes or reads it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.llm.shared import discard, salted_join, shared_dir, small_batches, written

TARGET_BYTES, SPLIT_BYTES, DATE = 256 << 20, 32 << 20, "2024-01-01T00:00:00Z"
#: classes of equal payloads named in a broadcast, about 100 bytes each; more are joined by shuffle
BROADCAST_CLASSES = 100_000
_BLOCK, _HEAD = 1 << 20, 1 << 16
MAGIC = b"\x1f\x8b\x08"
#: fixed values of the format
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVES = "file string, bytes long, records long"
RECORDS = "file string, offset long, end long, page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"


def opened(path: str):
    """The pyarrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + urllib.parse.unquote(path[5:].lstrip("/"))
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    """SHA-1 in base32, as WARC has it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri_fields(uri: str | None) -> list[str]:
    if uri is None:
        return []
    if uri and uri.isprintable() and " " not in uri:
        return [f"WARC-Target-URI: {uri}"]
    return [f"WARC-Target-URI: {urllib.parse.quote(uri, safe=':/?#[]@!$&()*+,;=%~')}", f"Exact-Target-URI: {base64.b64encode(uri.encode()).decode()}"]


def _record_id(page: int | None, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{sha}')}>"


def record(page: int | None, uri: str | None, sha: str, size: int, payload: bytes | None, head: int | None = None, date: str = DATE, unique: str = "") -> bytes:
    """A record as a gzip member; without a payload it is a revisit, which refers to page `head`. sha and size are those of the
    payload; `unique` tells apart records of one id and payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {_record_id(page, sha + unique)}", *_uri_fields(uri), f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{sha}"]
    if page is not None:
        fields.append(f"Page-ID: {page}")
    if payload is None:
        fields += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_record_id(head, sha)}"]
        if head is not None:
            fields.append(f"Refers-To-Page-ID: {head}")
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload or b'')}", "", ""]
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join((out.compress("\r\n".join(fields).encode() + http), out.compress(payload or b""), out.compress(b"\r\n\r\n"), out.flush()))


def _writer(folder: str, target_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(folder)
        stream, name, size, n, done = None, "", 0, 0, []

        def close() -> None:
            stream.close()
            done.append({"file": f"{folder}/{name}", "bytes": size, "records": n})

        for b in batches:
            for page, uri, sha, length, payload, grouped, head in zip(*(b.column(c).to_pylist() for c in ("page_id", "uri", "sha1", "bytes", "payload", "grouped", "head"))):
                if stream is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = fs.open_output_stream(f"{at}/{name}", compression=None)
                # the head of a class has an id that follows from page and payload alone, so others can refer to it
                unique = "" if grouped and payload is not None else f"/{name}/{size}"
                member = record(page, uri, base64.b32encode(bytes.fromhex(sha)).decode(), length, payload, head, date, unique)
                stream.write(member)
                size, n = size + len(member), n + 1
                if size >= target_bytes:
                    close()
                    stream = None
        if stream is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return run


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0, target_bytes: int = TARGET_BYTES, date: str = DATE, broadcast_classes: int = BROADCAST_CLASSES) -> DataFrame:
    """Writes all rows to archives below `folder` (default: one in the shared folder); ARCHIVES, as a written table."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = (folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}").rstrip("/")
    fs, at = opened(folder)
    fs.create_dir(at, recursive=True)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    own = own.withColumns({"bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "_class": F.concat(F.sha2("payload", 256), F.lit("/"), F.octet_length("payload").cast("string"))})
    # of each class of equal payloads the first row by id and URI (null last), and how many rows are like it
    rows = own.filter(F.col("bytes") >= least_bytes).groupBy("_class", "page_id", "uri").agg(F.count(F.lit(1)).alias("k"))
    first = F.min(F.struct(F.isnull("page_id"), F.col("page_id").alias("head"), F.isnull("uri"), F.col("uri").alias("head_uri"), F.col("k").alias("alike"))).alias("first")
    classes = rows.groupBy("_class").agg(first, F.sum("k").alias("k")).filter("k > 1").select("_class", "first.head", "first.head_uri", "first.alike", F.lit(True).alias("grouped"))
    classes = written(classes, "payload_classes")
    n, most = classes.agg(F.count(F.lit(1)), F.max("alike")).first()
    met = own.join(F.broadcast(classes), "_class", "left") if n <= broadcast_classes else salted_join(own, classes, "_class", F.struct("page_id", "uri"), "left")
    is_head = F.expr("page_id <=> head and uri <=> head_uri")
    met = met.withColumn("grouped", F.coalesce("grouped", F.lit(False)))
    columns = ["page_id", "uri", "sha1", "bytes", "payload", "grouped", "head"]
    out = met.withColumn("payload", F.when(~F.col("grouped") | is_head, F.col("payload")))
    if n and most > 1:
        # rows alike in all: one of them is the response
        alike = met.filter(F.col("grouped") & is_head & (F.col("alike") > 1)).groupBy("_class", "page_id", "uri", "sha1", "bytes", "grouped", "head", "alike").agg(F.first("payload").alias("payload"))
        again = alike.drop("payload").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(alike - 2) div 1000")))).repartition("_class", "part")
        again = again.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("least(1000, alike - 1 - part * 1000)")))).withColumn("payload", F.lit(None).cast("binary"))
        out = out.filter(~(F.col("grouped") & is_head & (F.col("alike") > 1))).select(columns).unionByName(alike.select(columns)).unionByName(again.select(columns))
    archives = written(out.select(columns).mapInArrow(_writer(folder, target_bytes, date), ARCHIVES), "archives")
    discard(spark, classes)
    return archives


def remove(archives: DataFrame) -> None:
    """Deletes archives, with the folders they lie in."""
    for (folder,) in archives.select(F.regexp_extract("file", "^(.*)/[^/]*$", 1)).distinct().toLocalIterator():
        fs, at = opened(folder)
        fs.delete_dir(at)


class _Member:
    """The record of a gzip member, decoded step by step from chunks of the archive."""

    def __init__(self):
        self.inflate, self.text, self.head, self.body = zlib.decompressobj(31), bytearray(), None, 0

    def feed(self, chunk: bytes) -> None:
        """zlib.error or ValueError if it isn't a record."""
        self.text += self.inflate.decompress(chunk)
        if self.head is None:
            stop = self.text.find(b"\r\n\r\n")
            if not self.text.startswith(b"WARC/"[: len(self.text)]) or (stop < 0 and len(self.text) > _HEAD):
                raise ValueError("no WARC header")
            if stop >= 0:
                self.head, self.body = _fields(bytes(self.text[:stop])), stop + 4
                if not self.head.get("content-length", "").isdigit() or "warc-type" not in self.head:
                    raise ValueError("no WARC header")


    def salvage(self, chunk: bytes) -> None:
        """The header, if what comes before an error has it all."""
        inflate, text = zlib.decompressobj(31), b""
        try:
            while chunk and b"\r\n\r\n" not in text:
                text, chunk = text + inflate.decompress(chunk, 64), inflate.unconsumed_tail
        except zlib.error:
            pass
        fields = _fields(text[: text.find(b"\r\n\r\n")]) if text.startswith(b"WARC/") and b"\r\n\r\n" in text else {}
        self.head = fields if "warc-type" in fields else None


def _fields(head: bytes) -> dict[str, str]:
    """Field values by lower-case names; the first of a name counts, a folded line goes on with the one before."""
    out: dict[str, str] = {}
    for line in re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def _id(value: str | None) -> int | None:
    return int(value) if value is not None and re.fullmatch(r"-?\d+", value) else None


def _row(file: str, offset: int, end: int, member: _Member, keep: bool) -> dict:
    """A decoded member as a row of RECORDS."""
    head = member.head
    out = {"file": file, "offset": offset, "end": end, "page_id": _id(head.get("page-id")), "record_type": head["warc-type"], "refers_to": _id(head.get("refers-to-page-id")), "error": None}
    exact = head.get("exact-target-uri")
    out["uri"] = base64.b64decode(exact).decode() if exact is not None else head.get("warc-target-uri")
    said, (kind, _, sha) = int(head["content-length"]), head.get("warc-payload-digest", "").partition(":")
    block = memoryview(member.text)[member.body : member.body + said]
    if len(block) < said or member.text[member.body + said :] != b"\r\n\r\n":
        return out | {"error": "the block has not the length that the header tells", "payload": None, "payload_bytes": None, "payload_digest": None}
    payload, told = block, None
    if "application/http" in head.get("content-type", ""):
        stop = member.text.find(b"\r\n\r\n", member.body, member.body + said)
        if stop >= 0:
            told = _id(_fields(bytes(member.text[member.body : stop])).get("content-length"))
            payload = block[stop + 4 - member.body :]
    if head["warc-type"] == "revisit":  # its payload is that of the record it refers to
        return out | {"payload": None, "payload_bytes": told, "payload_digest": sha if kind == "sha1" else None}
    found = digest(payload)
    if kind == "sha1" and sha != found:
        out["error"] = "the payload has not the digest that the header tells"
    return out | {"payload": bytes(payload) if keep else None, "payload_bytes": len(payload), "payload_digest": found}


class _Blocks:
    """An archive read in blocks, the last of them held."""

    def __init__(self, stream):
        self.stream, self.size, self.begin, self.held = stream, stream.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if not self.begin <= at <= at + n <= self.begin + len(self.held):
            self.stream.seek(at)
            self.begin, self.held = at, self.stream.read(max(n, _BLOCK))
        return self.held[at - self.begin : at - self.begin + n]


def _decoded(blocks: _Blocks, at: int) -> tuple[_Member | None, int, str | None]:
    """The member that begins at a place: (record, its end, None), or (None, at, None) if none does, or (a record's header, how
    far it was read, what is wrong with it)."""
    member, place, n = _Member(), at, 1 << 13
    while True:
        chunk = blocks.read(place, n)
        try:
            member.feed(chunk)
        except (zlib.error, ValueError) as e:
            if member.head is None:
                member.salvage(blocks.read(at, 1 << 13))
            return (None, at, None) if member.head is None else (member, place, f"broken member: {e}")
        place, n = place + len(chunk), min(2 * n, _BLOCK)
        if member.inflate.eof:
            return (member, place - len(member.inflate.unused_data), None) if member.head else (None, at, None)
        if not chunk:
            return (None, at, None) if member.head is None else (member, place, "the archive ends inside")


def records_of(file: str, start: int, stop: int, keep: bool = False) -> Iterator[dict]:
    """Rows of RECORDS for the members that begin in [start, stop) of an archive."""
    fs, path = opened(file)
    with fs.open_input_file(path) as stream:
        blocks, at = _Blocks(stream), start
        stop = min(stop, blocks.size)
        while at < stop:
            if blocks.read(at, len(MAGIC)) != MAGIC:
                # magic that begins inside may end beyond
                hit = blocks.read(at, min(_BLOCK, stop - at) + len(MAGIC) - 1).find(MAGIC)
                at += hit if hit >= 0 else min(_BLOCK, stop - at)
                continue
            member, end, error = _decoded(blocks, at)
            if member is None or error:
                if member is not None:
                    yield {"file": file, "offset": at, "end": end, "record_type": member.head["warc-type"], "page_id": _id(member.head.get("page-id")), "error": error}
                at += 1
                continue
            yield _row(file, at, end, member, keep)
            at = end


def _reader(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
        rows, held = [], 0
        for b in batches:
            for file, start, stop in zip(*(b.column(c).to_pylist() for c in ("file", "start", "stop"))):
                for row in records_of(file, start, stop, keep):
                    rows.append(row)
                    held += 200 + len(row.get("payload") or b"")
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def splits(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, start and stop of ranges of `split_bytes`, the last of a file shorter."""
    starts = F.expr(f"explode(sequence(0L, greatest(bytes - 1, 0L), {split_bytes}L))")
    return archives.select("file", "bytes", starts.alias("start")).select("file", "start", F.least(F.col("start") + split_bytes, "bytes").alias("stop"))


def read(archives: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = False) -> DataFrame:
    """RECORDS of archives(file, bytes), ranges dealt over tasks. With `payload`, responses have theirs."""
    own = splits(archives, split_bytes)
    n = max(1, min(own.count(), 100_000))
    return own.repartition(n, "file", "start").mapInArrow(_reader(payload), RECORDS)


def settled(records: DataFrame) -> DataFrame:
    """records without those that lie inside another one of the same archive."""
    before = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.max(F.when(F.col("error").isNull(), F.col("end"))).over(before)
    return records.withColumn("_before", whole).filter("_before is null or offset >= _before").drop("_before")
