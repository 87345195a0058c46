"""Directory trees, archives, images, previews, streams and the executor on temporary folders."""

import io
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.operators import trees
from stratalog.plans import executor
from stratalog.sources import archives, fswalk, images, previews
from stratalog.streaming import progressive


@pytest.fixture
def tree(tmp_path):
    for d in ("full", "empty/inner", "hidden", "_under", "locked"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "full/a.PNG").write_bytes(b"1" * 2048)
    (tmp_path / "full/12345678_p0.png").write_bytes(b"2")
    (tmp_path / "hidden/.dot").write_text("x")
    (tmp_path / "_under/x.ZIPMOD").write_text("y")
    (tmp_path / "[odd] name.zip").write_text("")
    os.symlink(tmp_path / "full", tmp_path / "empty/link")
    return tmp_path


def test_walk(spark, tree):
    rows = fswalk.walk(spark, [str(tree), str(tree / "missing")]).collect()
    got = {r.path[len(str(tree)) + 1 :]: r for r in rows}
    assert len(rows) == len(got) and {"", "full", "empty/inner", "hidden/.dot", "_under/x.ZIPMOD", "[odd] name.zip", "empty/link"} <= {*got}
    assert got["empty/inner"].is_dir and not got["empty/link"].is_dir and got["full/a.PNG"].size == 2048
    df = fswalk.walk(spark, [str(tree)])
    assert fswalk.archives(df).count() == 2 and fswalk.images(df, ["png"], 1).count() == 1
    assert [r.pid for r in fswalk.tagged(df, ["png"]).collect()] == ["12345678"]
    assert {os.path.basename(r.path) for r in trees.empty_dirs(df).collect()} == {"inner", "locked"}
    assert fswalk.walk(spark, [str(tree)], recursive=False).filter("not is_dir").count() == 1
    assert fswalk.hashed(df).filter("hash is not null").count() >= 5
    assert fswalk.walk(spark, []).count() == 0
    with pytest.raises(Exception, match="not a directory"):
        fswalk.walk(spark, [str(tree / "missing")], on_bad_root="fail").count()


MANIFEST = '<manifest schema-ver="1"><guid>com.leisehg.AndreaDoria</guid><name>n</name><version>1.0</version><author>{}</author><description>d</description></manifest>'


@pytest.mark.parametrize(("encoding", "author"), [("gbk", "作者测试"), ("shift_jis", "ｱ"), ("utf-8", "é")])
def test_encodings(encoding, author):
    found = archives.decode_manifest(MANIFEST.format(author).encode(encoding))
    assert (found["guid"], found["version"], found["author"], found["error"]) == ("com.leisehg.AndreaDoria", "1.0", author, None)


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries:
            z.writestr(name, text)
    return out.getvalue()


def test_archives(spark):
    good = MANIFEST.format("a").replace("<name>", "<x><game> G </game><game/></x><name>")
    rows = [zipped([("Manifest.XML", good)]), zipped([("sub/manifest.xml", good)]), b"junk", zipped([("manifest.xml", "<open>")]), None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, content binary")
    got = [r for r in archives.with_manifest(df).orderBy("i").collect()]
    assert (got[0].guid, got[0].games, got[0].error) == ("com.leisehg.AndreaDoria", ["G"], None)
    assert got[1].error == "no manifest" and "unreadable" in got[2].error and "malformed" in got[3].error and got[4].error
    spark.udtf.register("archive_listing", archives.ArchiveListing)
    df.createOrReplaceTempView("zips")
    listed = spark.sql("select z.* from zips, lateral archive_listing(content, 1) z").collect()
    assert len(listed) == 3 and not any(r.truncated for r in listed)
    assert [r[0] for r in spark.createDataFrame([(b"ok",), (b"\xff",)], "c binary").select(archives.strict_text("c")).collect()] == ["ok", None]


def test_archives_on_disk(spark, tmp_path):
    (tmp_path / "a.zipmod").write_bytes(zipped([("manifest.xml", MANIFEST.format("a")), ("x", "y")]))
    (tmp_path / "b.zip").write_text("no")
    found = {r.path[-5:]: r for r in archives.with_manifest_at(fswalk.archives(fswalk.walk(spark, [str(tmp_path)]))).collect()}
    assert found["ipmod"].author == "a" and found["b.zip"].error
    executor.rewrite_archive(str(tmp_path / "a.zipmod"), "manifest.xml", MANIFEST.format("new").encode())
    with zipfile.ZipFile(tmp_path / "a.zipmod") as z:
        assert b"new" in z.read("manifest.xml") and z.read("x") == b"y" and len(os.listdir(tmp_path)) == 2


def test_signatures():
    r = np.random.default_rng(0)
    grey = r.uniform(0, 255, (40, 60)).cumsum(1)
    for kind in (*images.KINDS, "unknown"):
        words = images.signature(grey, kind, 16)
        assert len(words) == 4
        near = images.signature(np.repeat(np.repeat(grey, 2, 0), 2, 1), kind, 16)
        assert sum((int(a) ^ int(b)).bit_count() if (int(a) ^ int(b)) >= 0 else ((int(a) ^ int(b)) & (2**64 - 1)).bit_count() for a, b in zip(words, near)) <= 12
        assert images.decoded(images.encoded(words.tolist())) == words.tolist()
    with pytest.raises(ValueError):
        images.decoded("abc")


def test_image_source(spark):
    px = np.zeros((20, 30, 3), np.uint8)
    px[:, 15:] = 200
    df = spark.createDataFrame([("a", 20, 30, 3, px.tobytes()), ("b", 2, 2, 1, bytes(4))], "path string, height int, width int, n_channels int, data binary")
    got = images.hashed(df, "ahash", 8, least_width=10, least_height=10).collect()
    assert [r.path for r in got] == ["a"] and (got[0].words[0] & (2**64 - 1)).bit_count() == 32


def test_previews(spark):
    text = "é" * 1000
    df = spark.createDataFrame([(text.encode(),), (b"a\xffb",), (None,)], "c binary")
    got = [r[0] for r in df.select(previews.text_preview("c", 1)).collect()]
    assert got == ["é" * 512, "a\ufffdb", None]
    odd = spark.createDataFrame([(b"a" + text.encode(),)], "c binary").select(previews.text_preview("c", 1)).first()[0]
    assert odd == "a" + "é" * 511
    kinds = previews.dispatch(spark.createDataFrame([("a.TXT",), ("b.png",), ("c.zip",), ("d",)], "path string"))
    assert [r.preview for r in kinds.collect()] == ["text", "image", "archive", "unsupported"]
    row = spark.createDataFrame([('["a"]', "junk", None)], "l string, m string, n int")
    s = previews.settings(row, ["l"], ["m"], {"n": 4}).first()
    assert (s.l, s.m, s.n) == (["a"], {}, 4)


def test_executor(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    plan = spark.createDataFrame([(0, str(tmp_path / "a"), str(tmp_path / "sub/b")), (1, str(tmp_path / "none"), str(tmp_path / "c"))], "ordinal long, old_path string, new_path string").coalesce(1)
    got = executor.carry_out(plan).orderBy("ordinal").collect()
    assert [r.success for r in got] == [True, False] and got[1].error and (tmp_path / "sub/b").read_text() == "1"


def test_streams(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k * 2 + i, "a" if i else "b") for i in range(2)], "event_id long, k string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = progressive.read(spark, str(tmp_path / "in/*"), "event_id long, k string", files_per_trigger=1)
    seen = []
    spark.streams.addListener(listener := progressive.Progress(lambda name, batch, rows: seen.append(batch)))
    q = progressive.start(progressive.touched_groups(stream, ["k"]), progressive.latest_into(str(tmp_path / "out"), "k", "n"), str(tmp_path / "state"))
    q.awaitTermination()
    spark.streams.removeListener(listener)
    assert {(r.k, r.n, r.last_id) for r in progressive.latest(spark, str(tmp_path / "out"), "k", "n").collect()} == {("a", 3, 5), ("b", 3, 4)}
    assert not progressive.is_active(spark, "nothing") and not progressive.cancel(spark, "nothing")
    log = spark.range(10).select(F.col("id").alias("seq"))
    assert [r.seq for r in progressive.capped(log, 2).collect()] == [9, 8]
