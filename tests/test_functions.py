"""Scalar expressions against fixed vectors and plain-Python rules."""

import re
from functools import cmp_to_key

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.functions import names, paths, values, versions


def each(spark, inputs, expr, schema="x string"):
    """expr(column) of each input, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, {schema}")
    return [r[0] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_digit_id(spark):
    got = each(spark, ["144285190_p0.png", "99349202.jpg", "2025_99349202_p0.png", "123_short.png", "1234567890_p0.png"], names.digit_id)
    assert got == ["144285190", "99349202", "99349202", None, None]


def test_url(spark):
    assert each(spark, ["http://h/x", "http://h/x/"], lambda c: paths.url(c, F.lit("12345678"))) == ["http://h/x/12345678"] * 2


def test_folder_names(spark):
    assert each(spark, [" コイカツ! ", "a/b:c", "...", "  a   b  "], names.folder_name) == ["コイカツ!", "a-b-c", "", "a b"]


def test_stems_and_suffixes(spark):
    inputs = [".gitignore", "a.", "..", "x.tar.gz", "plain", ""]
    assert each(spark, inputs, names.stem) == [".gitignore", "a", ".", "x.tar", "plain", ""]
    assert each(spark, inputs, names.suffix) == [None, ".", ".", ".gz", None, None]
    assert each(spark, ["txt", " .txt ", "", "  "], names.normal_suffix) == [".txt", ".txt", "", ""]


def test_brackets_and_numbers(spark):
    assert each(spark, ["[]a[b]", "[a", "x[b]c]", "a]b[c]"], names.bracketed) == [None, None, "b", "c"]
    assert each(spark, ["x (1)", "x ()", "x (1) (2)", "(1)", "x (١)"], names.without_number) == ["x", "x ()", "x (1)", "(1)", "x (١)"]
    assert each(spark, ['a\\b/c:d*e?f"g<h>i|j'], names.sanitized) == ["a-b-c-d-e-f-g-h-i-j"]


def test_identity_names(spark):
    rows = [("g", "a", "1"), ("【x】 y", "a", ""), ("", "", None), (" g ", None, " 1/2 "), ("a/b", "c:d", "v")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g string, a string, v string")
    got = [r.n for r in df.select("i", names.identity_name("g", "a", "v").alias("n")).orderBy("i").collect()]
    assert got == ["[a] g-1", "[x] y", "[unknown] unknown", "[unknown] g-1/2", "[c-d] a-b-v"]


def test_paths(spark):
    assert each(spark, ["\\\\?\\C:\\a", "\\\\?\\UNC\\srv\\s", "C:\\a"], paths.friendly) == ["C:\\a", "\\\\srv\\s", "C:\\a"]
    assert each(spark, ["C:\\a", "\\\\srv\\s", "rel"], paths.extended) == ["\\\\?\\C:\\a", "\\\\?\\UNC\\srv\\s", "rel"]
    assert each(spark, ["/a/b/c", "a"], paths.ancestors) == [["/a", "/a/b"], []]
    df = spark.createDataFrame([("/foo/x", "/foo/"), ("/foobar", "/foo"), ("/FOO", "/foo"), ("C:\\A\\b", "c:/a")], "p string, t string")
    assert [tuple(r) for r in df.select(paths.same_or_below("p", "t"), paths.below("p", "t"), paths.relative_to("p", "t")).collect()] == [(True, True, ""), (False, False, None), (True, False, None), (True, True, "")]


def compare(a, b):
    """The rule in plain Python."""
    split = lambda v: [p for p in re.split(r"[^\w]|_", v.lower()) if p]
    x, y = split(a), split(b)
    for i in range(max(len(x), len(y))):
        p, q = (v[i] if i < len(v) else "0" for v in (x, y))
        number = lambda s: int(s) if re.fullmatch("[0-9]+", s) and int(s) < 1 << 64 else None
        m, n = number(p), number(q)
        if m is not None and n is not None:
            if m != n:
                return -1 if m < n else 1
        elif (m is None) != (n is None):
            return -1 if m is None else 1
        elif p != q:
            return -1 if p.encode() < q.encode() else 1
    return (a.encode() > b.encode()) - (a.encode() < b.encode())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="0129aZ.-v", max_size=7), min_size=2, max_size=40, unique=True))
def test_version_order(spark, found):
    found = [*{*found, "1", "1.0", "1.00", "1.a", "v2", "2-rc1", "", "18446744073709551615", "18446744073709551616", "01"}]
    df = spark.createDataFrame([(0, v) for v in found], "g int, version string")
    got = [r.version for r in versions.with_key(df, "version", ["g"]).orderBy("version_key").collect()]
    assert got == sorted(found, key=cmp_to_key(compare))


def test_bits(spark):
    df = spark.createDataFrame([([-1, 0], [0, 1]), ([1], [1, 2])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in df.select(values.hamming("a", "b")).collect()] == [65, None]
    v = spark.createDataFrame([([-1.0] * 63 + [1.0, 2.0],)], "v array<double>")
    assert v.select(values.sign_words("v")).first()[0] == [-(1 << 63), 1]
    assert spark.range(1).select(values.allowed_distance(values.hash_bits(16), F.lit(90)), values.similarity(F.lit(25), F.lit(256)), values.similarity(F.lit(0), F.lit(0)), values.hash_bits(2)).first()[:] == (25, 90, 100, 16)


def test_times_and_sizes(spark):
    assert each(spark, [0, None, 86400], values.time_text, "x long") == ["-", "-", "1970-01-02 00:00:00"]
    assert each(spark, [0, 1023, 1536, 1 << 21, 5 << 40], values.size_text, "x long") == ["0 B", "1023 B", "1.50 KB", "2.00 MB", "5120.00 GB"]
    date, time = (44 << 9) | (2 << 5) | 29, (13 << 11) | (5 << 5) | 7
    df = spark.createDataFrame([(date, time), (0, 0)], "d int, t int")
    assert [r[0] for r in df.select(values.dos_time("d", "t")).collect()] == ["2024-02-29 13:05:14", ""]


def test_payload(spark):
    good = '{"error":false,"body":{"tags":{"tags":[{"tag":"a","translation":{"en":" A "}},{"tag":"b"},{"tag":"c","translation":{"en":" "}},{"tag":" "},{"tag":"a","translation":{"en":"Z"}}]}}}'
    got = each(spark, [good, '{"error":true,"message":"no"}', '{"error":true}', '{"body":{}}', "junk", None], values.payload)
    assert (got[0].tags, got[0].translations, got[0].error) == (["a", "b", "c", "a"], {"a": "Z"}, None)
    assert [g.error for g in got[1:]] == ["no", "request failed", "no tags", "no tags", "no tags"] and got[1].tags is None


def test_imports(spark):
    assert each(spark, ['["a"," b","a"]', '{"tags":["x"]}', "a; b，c\nb"], values.imported_list) == [["a", "b"], ["x"], ["a", "b", "c"]]
    assert each(spark, ['{"a":"1"}', '{"translations":{"b":"2"}}', "# no\na=1\nb\t2\nc,3\na=4\nbad"], values.imported_pairs) == [{"a": "1"}, {"b": "2"}, {"a": "4", "b": "2", "c": "3"}]
    assert each(spark, ["PNG, .jpg；gif  png"], values.extension_list) == [["png", "jpg", "gif"]]
    assert each(spark, ["[1", '["a"]', None], values.text_list) == [[], ["a"], []]
