"""How far the sources of a language differ in their words, counted by DuckDB in shards of terms.

Terms are runs of ASCII letters and of all code points beyond ASCII, A-Z lower-cased. Each task counts its own documents
with SQL; the counts are dealt by a hash of language and term, so a shard has all counts of its terms, sums them,
and keeps the terms that stand in enough documents of their language. With the totals of all shards a shard finds, again
by SQL, partial sums over its terms for each pair of sources that share one, and its best terms of each source; Spark
adds and ranks them.

Of V kept terms most stand in few sources, so a pair's sum over all V is not taken term by term: with f(p, q) the distance of
two rates and 0 for a term that a source lacks, sum f(p, q) = sum over s's terms of f(p, q0) + sum over t's terms of
f(p0, q) + sum over shared terms of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) + (V - terms of s - terms of t) f(p0, q0).
The first two need only how often each rate occurs in a source, the third is the shards' sum. All of it is in whole numbers.

Defined cases: null text, lang and source are empty texts; a document is a row, so repeated rows and ids count each; ties
of value go by the item's UTF-8 bytes; a language without kept terms has value 0 for each pair and no terms; an
empty table gives no rows; other columns, of whatever names, are not read. A text of more than _TEXT_BYTES is counted in pieces, cut between
terms. A task holds LIMIT counts, a shard
what Spark's partition holds, both in a DuckDB of MEMORY that spills to a folder of the task, deleted at its end.
"""

from __future__ import annotations

import contextlib
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.batches import slices, utf8
from stratalog.llm.shared import discard, salted_join, small_batches, written

LEAST_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: counts that a task gathers before it passes them on, and the memory of its DuckDB
LIMIT, MEMORY = 1_000_000, "300MB"
_TEXT_BYTES = 4_000_000
_ROWS = 20_000

#: bytes of a term stay, A-Z as a-z; all others part terms
_KEEP = np.full(256, 0x20, np.uint8)
_KEEP[0x61:0x7B] = np.arange(0x61, 0x7B)
_KEEP[0x41:0x5B] = np.arange(0x61, 0x7B)
_KEEP[0x80:] = np.arange(0x80, 0x100)

_PARTIAL = "lang string, source string, term string, n long, docs long"
_KEPT = "lang string, source string, term string, n long, n_lang long, first long"
_FOUND = "part string, lang string, source string, item string, value long"


@contextlib.contextmanager
def _database(memory: str):
    import duckdb

    at = tempfile.mkdtemp(prefix="shard-")
    con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": at, "preserve_insertion_order": False})
    try:
        yield con
    finally:
        con.close()
        shutil.rmtree(at, ignore_errors=True)


def _batches(con, sql: str) -> Iterator[pa.RecordBatch]:
    yield from con.sql(sql).to_arrow_reader(_ROWS)


def _pieces(text: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about a quarter of _TEXT_BYTES, cut between terms."""
    a = 0
    while a < len(text):
        b = min(a + _TEXT_BYTES // 4, len(text))
        while b < len(text) and text[b] != 0x20:
            b += 1
        yield text[a:b]
        a = b


def _texts(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(raw[offsets[0] : offsets[-1]]))


def _long(con, text: np.ndarray, lang: str, source: str) -> int:
    """Counts of one long text; how many."""
    con.execute("CREATE OR REPLACE TABLE parts (term VARCHAR, n BIGINT)")
    for piece in _pieces(text):
        con.register("docs", pa.table({"text": _texts(piece, np.array([0, len(piece)], np.int64))}))
        con.execute("INSERT INTO parts SELECT term, count(*) FROM (SELECT unnest(string_split(text, ' ')) AS term FROM docs) WHERE term <> '' GROUP BY ALL")
        con.unregister("docs")
    n = con.execute("INSERT INTO own SELECT ?, ?, term, sum(n), 1 FROM parts GROUP BY term", [lang, source]).fetchone()[0]
    con.execute("DROP TABLE parts")
    return n


def _counted(limit: int, memory: str):
    """Counts of a task's documents: rows of _PARTIAL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database(memory) as con:
            con.execute("CREATE TABLE own (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
            summed, held = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM own GROUP BY ALL", 0
            for b in batches:
                raw, offsets = utf8(b.column("text"))
                for x, y in slices(offsets, _TEXT_BYTES):
                    kept, own = _KEEP[raw[offsets[x] : offsets[y]]], offsets[x : y + 1] - offsets[x]
                    if len(kept) > _TEXT_BYTES:  # one text
                        held += _long(con, kept, b.column("lang")[x].as_py(), b.column("source")[x].as_py())
                    else:
                        docs = pa.table({"d": np.arange(y - x), "lang": b.column("lang")[x:y], "source": b.column("source")[x:y], "text": _texts(kept, own)})
                        con.register("docs", docs)
                        held += con.execute("""
                            INSERT INTO own SELECT lang, source, term, sum(n), count(*) FROM (
                                SELECT d, term, count(*) AS n FROM (SELECT d, unnest(string_split(text, ' ')) AS term FROM docs) WHERE term <> '' GROUP BY ALL
                            ) JOIN docs USING (d) GROUP BY ALL""").fetchone()[0]
                        con.unregister("docs")
                    if held > limit:
                        yield from _batches(con, summed)
                        con.execute("DELETE FROM own")
                        held = 0
            yield from _batches(con, summed)

    return run


def _loaded(con, batches: Iterator[pa.RecordBatch], columns: str) -> None:
    con.execute(f"CREATE TABLE own ({columns})")
    for b in batches:
        con.register("b", pa.Table.from_batches([b]))
        con.execute("INSERT INTO own SELECT * FROM b")
        con.unregister("b")


def _kept(least_docs: int, memory: str):
    """A shard's counts, summed: rows of _KEPT of the terms in at least `least_docs` documents of their language. `first` is 1 in one row of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database(memory) as con:
            _loaded(con, batches, "lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT")
            yield from _batches(con, f"""
                WITH t AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n_lang, min(source) AS least FROM own GROUP BY ALL HAVING sum(docs) >= {least_docs}),
                s AS (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n FROM own GROUP BY ALL)
                SELECT lang, source, term, n, n_lang, CAST(source = least AS BIGINT) AS first FROM s JOIN t USING (lang, term)""")

    return run


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) // (({p}) + ({q})))"


def _compared(top: int, memory: str):
    """Of a shard's terms: for pairs of sources that share some the correction of the sums (source before item), and each source's best terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database(memory) as con:
            _loaded(con, batches, "lang VARCHAR, source VARCHAR, term VARCHAR, p BIGINT, p0 BIGINT, q BIGINT")
            yield from _batches(con, f"""
                SELECT 'pair' AS part, a.lang, a.source, b.source AS item,
                    CAST(sum({_f("a.p", "b.p")} - {_f("a.p", "b.p0")} - {_f("a.p0", "b.p")} + {_f("a.p0", "b.p0")}) AS BIGINT) AS value
                FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL""")
            yield from _batches(con, f"""
                SELECT 'term' AS part, lang, source, term AS item, {_f("p", "q")} AS value FROM own WHERE p > q
                QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {_f("p", "q")} DESC, term) <= {top}""")

    return run


def _rate(n: str, total: str) -> str:
    """1 + floor(UNIT * (n + 2) / total), exact."""
    return f"1 + (cast({UNIT} as decimal(12,0)) * cast({n} + 2 as decimal(20,0))) div cast({total} as decimal(20,0))"


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, limit: int = LIMIT, memory: str = MEMORY) -> DataFrame:
    """lang, source, part, item, value and rank: in part `pair` the other sources of the language by distance, in part
    `term` the `top` terms that the source uses more than its language does."""
    spark = docs.sparkSession
    small_batches(spark)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias
    own = docs.select(named(lang)("lang"), named(source)("source"), named(text)("text"))
    partial = own.mapInArrow(_counted(limit, memory), _PARTIAL)
    kept = written(partial.repartition("lang", "term").mapInArrow(_kept(least_docs, memory), _KEPT), "kept_terms")

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("first").alias("v"))
    groups = own.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs.select("lang", "v", F.col("n_lang").alias("total_lang")), "lang", "left")
    groups = groups.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "terms", "v", "total_lang")}).withColumn("total", F.expr("n + 2 * v"))
    # null where a language has no term
    groups = written(groups.withColumn("p0", F.expr(f"if(v > 0, {_rate('0', 'total')}, null)")), "groups")

    keyed = kept.withColumn("g", F.struct("lang", "source")).withColumnRenamed("n", "count")
    totals = groups.select(F.struct("lang", "source").alias("g"), "total", F.expr("total_lang + 2 * v").alias("all_lang"), "p0")
    rates = salted_join(keyed, totals, "g", F.col("term"), least=100_000)
    rates = written(rates.select("lang", "source", "term", F.expr(_rate("count", "total")).alias("p"), "p0", F.expr(_rate("n_lang", "all_lang")).alias("q")), "rates")
    found = written(rates.repartition("lang", "term").mapInArrow(_compared(top, memory), _FOUND), "found")

    f = lambda p, q: F.expr(f"coalesce((({p} - {q}) * ({p} - {q})) div ({p} + {q}), 0)")
    # each rate of a source and how often, and one row for what neither source of a pair has
    often = rates.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k")).withColumn("terms", F.lit(None).cast("long"))
    often = written(often.unionByName(groups.select("lang", "source", F.col("p0").alias("p"), F.lit(0).cast("long").alias("k"), "terms")), "often")
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q"), F.col("terms").alias("theirs"), "v")
    met = salted_join(often, others, "lang", F.struct("source", "p")).filter("source <> item")
    neither = F.when(F.col("terms").isNotNull() & (F.col("source") < F.col("item")), (F.col("v") - F.col("terms") - F.col("theirs")) * f("p", "q"))
    met = met.select("lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"), F.coalesce(neither, F.col("k") * f("p", "q")).alias("value"))
    pairs = met.unionByName(found.filter("part = 'pair'").select("lang", F.col("source").alias("a"), F.col("item").alias("b"), "value")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s")
    pairs = pairs.select("lang", both, "value").select(F.lit("pair").alias("part"), "lang", "s.source", "s.item", "value")

    out = pairs.unionByName(found.filter("part = 'term'"))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    ranked = written(ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank"), "divergence")
    discard(spark, kept, groups, rates, found, often)
    return ranked
