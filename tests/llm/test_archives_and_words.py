"""WARC archives, divergence of sources and spelling variants against SQL, plain versions and odd input."""

import gzip
import hashlib
import itertools
import random
import re
import uuid
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalog.llm import divergence, oracle, queries, spelling, warc
from tests.oracle import rows_of

SF = "/root/testdata/sf0.001"


# archives

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("broadcast_classes", [100_000, 0])
def test_round_trip(spark, tmp_path, broadcast_classes):
    """Nulls, empty and long payloads, odd URIs, equal payloads under one id and several, rows alike in all; by ranges of any size."""
    long = "".join(random.Random(1).choice("abc é\r\n") for _ in range(700_000))
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "v", "a"), (2, None, "a"), (None, " x\r\nWARC-Type: no", "a"), (None, "q", "z"), (None, None, "z"), (5, "", None), (6, "ü y", ""), (7, "l", long), (8, "m", "\r\n\r\n")]
    rows += [(9, "w", "rep")] * 2500
    pages = spark.createDataFrame([(*r, "x", 0) for r in rows], PAGES + ", payload string, bytes int").repartition(5)
    archives = warc.write(pages, str(tmp_path / "w"), target_bytes=20_000, broadcast_classes=broadcast_classes)
    assert archives.count() > 3 and archives.agg(F.sum("records")).first()[0] == len(rows)
    seen = None
    for split in (20_000, 1_000_000) if broadcast_classes else (50_000,):
        got = warc.settled(warc.read(archives, split, payload=True)).collect()
        assert not [r for r in got if r.error]
        plain = sorted(((r.page_id, r.uri, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in got), key=str)
        assert seen in (None, plain)
        seen = plain
    assert sorted(((r[0], r[1]) for r in rows), key=str) == sorted(((r[0], r[1]) for r in seen), key=str)
    first = [r for r in seen if r[2] == "response"]
    by_text = {(r[2] or "").encode() for r in rows}
    assert sorted(r[6] for r in first) == sorted(by_text)  # one response for each payload
    assert {(r[6], r[0]) for r in first} == {(b"a", 1), (b"z", None), (b"", 5), (long.encode(), 7), (b"\r\n\r\n", 8), (b"rep", 9)}
    assert {(r[0], r[3]) for r in seen if r[2] == "revisit"} == {(1, 1), (2, 1), (None, 1), (None, None), (6, 5), (9, 9)}
    whole = {(r[0], r[1]): (r[2] or "").encode() for r in rows}
    assert all(r[4] == len(whole[r[:2]]) and r[5] == warc.digest(whole[r[:2]]) for r in seen)


def test_small_payloads_are_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], PAGES)
    got = warc.read(warc.write(pages, str(tmp_path), least_bytes=3)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_empty_table(spark, tmp_path):
    archives = warc.write(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert archives.count() == 0 and warc.settled(warc.read(archives)).count() == 0


def test_archives_are_gzip_and_warc(spark, tmp_path):
    """Another reader, of the whole file, finds the same records."""
    pages = spark.createDataFrame([(k, f"http://h/{k}", "text %d" % (k % 7)) for k in range(50)], PAGES).coalesce(1)
    (file,) = [r.file for r in warc.write(pages, str(tmp_path)).collect()]
    text = gzip.open(file).read()
    parts = re.findall(rb"WARC/1\.1\r\n(.*?)\r\n\r\n(.*?)\r\n\r\n(?=WARC/|$)", text, re.S)
    assert len(parts) == 50 and sum(b"WARC-Type: response" in h for h, _ in parts) == 7
    ids = {re.search(rb"WARC-Record-ID: (\S+)", h)[1] for h, _ in parts}
    assert len(ids) == 50 and {m[1] for h, _ in parts if (m := re.search(rb"WARC-Refers-To: (\S+)", h))} <= ids
    for head, block in parts:
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(block)


def _stored(payload: bytes) -> bytes:
    """A record whose payload stands uncompressed in its member."""
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    out = zlib.compressobj(0, zlib.DEFLATED, 31)
    return out.compress(b"WARC/1.0\r\nWARC-Type: response\r\nPage-ID: 1\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n") + out.flush()


def test_members_inside_members(spark, tmp_path):
    """A payload that holds whole members, and bytes that only begin like one, is one record wherever the ranges are cut."""
    inner = warc.record(2, "i", warc.digest(b"inner"), 5, b"inner")
    outer = _stored(b"x" * 50 + inner + b"\x1f\x8b\x08" + b"y" * 30 + inner[:40] + b"\x1f\x8b\x08\x00")
    last = warc.record(3, "l", warc.digest(b"last"), 4, b"last")
    (tmp_path / "a.warc.gz").write_bytes(outer + last + outer)
    archives = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), 2 * len(outer) + len(last))], "file string, bytes long")
    for split in (100, 10_000):
        got = sorted((r.offset, r.page_id) for r in warc.settled(warc.read(archives, split)).collect())
        assert got == [(0, 1), (len(outer), 3), (len(outer) + len(last), 1)]
    # every cut in two: each record is owned once
    for cut in range(0, len(outer) + 3):
        owned = [r["offset"] for part in ((0, cut), (cut, 10**9)) for r in warc.records_of(str(tmp_path / "a.warc.gz"), *part) if r["offset"] in (0, len(outer), len(outer) + len(last))]
        assert sorted(owned) == [0, len(outer), len(outer) + len(last)]


def test_broken_archives(tmp_path):
    good = warc.record(1, "u", warc.digest(b"one"), 3, b"one")
    wrong = warc.record(2, "u", warc.digest(b"two"), 3, b"one")
    short = zlib.compressobj(6, zlib.DEFLATED, 31)
    short = short.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nfew") + short.flush()
    bent = bytearray(good)
    bent[-8] ^= 1  # the checksum
    (tmp_path / "x").write_bytes(b"noise\x1f\x8b\x08" + good + wrong + short + bytes(bent) + good + good[:-20])
    got = list(warc.records_of(str(tmp_path / "x"), 0, 10**9))
    assert [(r["page_id"], bool(r["error"])) for r in got] == [(1, False), (2, True), (None, True), (1, True), (1, False), (1, True)]
    (tmp_path / "e").write_bytes(b"")
    assert list(warc.records_of(str(tmp_path / "e"), 0, 10)) == []
    with pytest.raises(Exception):
        warc.opened("nosuch://x/y")


def test_long_records_across_blocks(spark, tmp_path):
    """Records beyond blocks of the archive and beyond ranges."""
    r = random.Random(3)
    pages = spark.createDataFrame([(k, "u", "".join(map(str, r.choices(range(10**6), k=600_000))) if k % 3 == 0 else f"s{k}") for k in range(7)], PAGES).coalesce(1)
    archives = warc.write(pages, str(tmp_path))
    assert archives.first().bytes > 4 << 20
    got = {x.page_id: x.payload_digest for x in warc.read(archives, 300_000).collect()}
    assert got == {x.page_id: warc.digest(x.html.encode()) for x in pages.collect()}
    assert hashlib.sha1(b"").hexdigest() == "da39a3ee5e6b4b0d3255bfef95601890afd80709" and warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


# divergence


def _by_sql(rows: list[tuple]) -> list[tuple]:
    con = duckdb.connect()
    documents = pa.table({k: pa.array([r[i] for r in rows], pa.string()) for i, k in enumerate(("text", "lang", "source"))})
    con.register("documents", documents)
    cur = con.execute(oracle.SQL["op12_divergence"])
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def _audited(spark, rows: list[tuple], **more):
    table = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], "text string, lang string, source string, term string, part string, n int, p int").repartition(3)
    df = divergence.audit(table, **more)
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


@pytest.mark.parametrize("limit", [divergence.LIMIT, 50])
def test_divergence_equals_sql(spark, limit):
    """Nulls, empty texts, groups and languages without terms, repeated rows, ties, letters beyond ASCII, one hot source."""
    r = random.Random(5)
    words = ["The", "the", "Über", "über", "naïve", "x1y", "don't", "日本", "a", "b", "c", "d", "É", "é"]
    rows = [(" ".join(r.choices(words, weights=range(1, 15), k=r.randint(0, 30))), r.choice(["en", "en", "de", None, ""]), r.choice(["s0"] * 5 + ["s1", "s2", "ü", None])) for _ in range(400)]
    rows += rows[:50] + [(None, "en", "s9"), ("", "xx", "s0"), (None, "xx", "s1"), (None, None, None), ("rare", "yy", "s0"), ("1 2 3 \x00 \x7f", "en", "s8")] + [("alpha beta", "zz", s) for s in "abcd" for _ in range(3)]
    assert _audited(spark, rows, limit=limit) == _by_sql(rows)


def test_divergence_of_an_empty_table_and_long_text(spark):
    assert _audited(spark, []) == _by_sql([])
    long = " ".join(random.Random(2).choices(["ab", "Cd", "éf", "gh9i", "j"], k=900_000))
    assert len(long) < divergence._TEXT_BYTES
    rows = [(long, "en", "a"), ((long + " ") * 3 + "zé" * 3_000_000, "en", "b")] + [("ab cd éf gh", "en", s) for s in "ab" * 6]
    assert _audited(spark, rows) == _by_sql(rows)


# spelling


def _plain(rows: list[tuple], least: int = 5) -> list[tuple]:
    """The rule word by word, over all pairs of words."""
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in count.items() if len(w) >= least and k >= 3}

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = [], {}
    beside = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if near(a, b):
            beside[a].append(b), beside[b].append(a)
    for w in n:
        if beside[w]:
            best = min(beside[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(beside[w]), n[form[w]] if w in form else None))
    return sorted(out)


def _variants(spark, rows: list[tuple], **more) -> list[tuple]:
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, word string, n int, root string")
    df = spelling.variants(table, misspelt=97, **more)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("piece", [spelling.PIECE, 3])
def test_spelling_equals_all_pairs(spark, piece):
    """Short alphabets, so words have many near ones, ties and chains; nulls, empty texts, repeated rows and ids; groups in many pieces."""
    r = random.Random(7)
    words = ["".join(r.choice("aabé") for _ in range(r.randint(4, 8))) for _ in range(150)] + ["straße", "STRASSE", "Àccent", "àccent", "colour", "color", "colours", "aaaaa", "aaaaaa", "aaaa", "ababa", "babab"]
    rows = [(k % 40, " ".join(r.choices(words, weights=[1 + (7 * j) % 50 for j in range(len(words))], k=40)) + ("," if k % 2 else ".9x")) for k in range(120)]
    rows += rows[:30] + [(None, rows[0][1])] * 3 + [(5, None), (6, ""), (None, None)]
    want = _plain(rows)
    assert _variants(spark, rows, piece=piece) == want
    assert any(x[1] and x[2] != x[1] for x in want) and any(x[1] is None and x[4] for x in want)


def test_spelling_of_the_small_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    assert _variants(spark, rows) == _plain(rows)
    whole = queries.queries()["op13_spelling"](spark, SF)
    n = {w: k for w, k in spelling.words(spark.read.parquet(f"{SF}/documents.parquet"), 97).collect() if len(w) >= 5 and k >= 3}
    assert {r.word: r.n for r in whole.collect()} == n


def test_spelling_of_empty_tables_and_long_texts(spark):
    assert _variants(spark, []) == []
    assert _variants(spark, [(1, "one"), (2, None)]) == []
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(5, 7))) for _ in range(300)]
    rows = [(1, " ".join(r.choices(words, k=300_000))), (2, "z" * 50_000 + " zzzzzy" * 3 + " zzzzzz" * 9), (3, ("y" * 3000 + " ") * 3 + ("y" * 2999 + " ") * 6)]
    assert _variants(spark, rows) == _plain(rows)


def test_one_edit():
    words = ["".join(x) for k in range(5) for x in itertools.product("ab", repeat=k)]
    for a, b in itertools.product(words, words):
        around = {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in ("a", "b", "")} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "ab"}
        assert spelling._one_edit(a, b) == (b in around and a != b), (a, b)


def test_bad_parameters(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    for more in ({"least_length": 3}, {"factor": 1}):
        with pytest.raises(ValueError):
            spelling.variants(docs, **more)
    assert uuid.UUID(warc._record_id(1, "a").removeprefix("<urn:uuid:").removesuffix(">"))
