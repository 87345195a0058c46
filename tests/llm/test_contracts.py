"""The queries as they are called: columns, types, held-out rows, whole tables; and tables that are empty, odd or long."""

import random
import zlib

import public_tokenizers
import pytest

from stratalog.llm import decontaminate, language, lm_score, near_dup, packing, quality, queries, token_counts

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = {
    "op1_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op3_nearest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op4_near_dup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_token_counts": {"doc_id": "bigint", "n_tokens": "bigint"},
    "op6_pack": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op9_shards": {"doc_id": "bigint", "added_version": "bigint", "tiers_settled": "boolean"},
    "op10_lm_score": {"doc_id": "bigint", "n_tokens": "bigint", "background_loss": "double", "target_loss": "double", "score": "double"},
    "op11_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op12_divergence": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    "op13_spelling": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query_keeps_its_contract(spark, name):
    df = queries.queries()[name](spark, SF)
    types = dict(df.dtypes)
    assert {c: types[c] for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    if "doc_id" in types:
        assert {r.doc_id for r in rows} == {*docs}  # whole tables
    if name != "op6_pack" and "doc_id" in types:
        assert len(rows) == len(docs)
    crc = lambda i: zlib.crc32(str(i).encode())
    if name == "op1_quality":
        assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
        labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
        held = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
        assert held and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.8 * len(held)
    if name == "op7_language":
        assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
        held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
        assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    if name == "op3_nearest":
        assert {r.query_id % 20 for r in rows} == {0} and all(r.query_id != r.vec_id for r in rows)
    if name == "op6_pack":
        bins = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(bins) <= -(-sum(r.length for r in rows) // 1024) + 1
    if name == "op10_lm_score":
        assert all(r.score == pytest.approx(r.target_loss - r.background_loss) for r in rows if r.n_tokens)


def test_learning_ignores_held_out_labels(spark, docs):
    """Other labels and languages of held-out rows change nothing."""
    r = random.Random(1)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "%%%", "ööö"]) for _ in range(20)) for _ in range(80)]
    table = docs(texts)
    learn = "crc32(cast(doc_id as string)) % 5 <> 0"
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    two = [spark.createDataFrame([(i, (i % 2) ^ (k if held(i) else 0)) for i in range(80)], "doc_id long, quality int") for k in (0, 1)]
    a, b = (quality.fit(table, labels, learn) for labels in two)
    assert (a.table == b.table).all() and a.bias == b.bias
    langs = [table.withColumn("lang", __import__("pyspark").sql.functions.expr(f"case when {learn} then cast(doc_id % 2 as string) else '{k}' end")) for k in "xy"]
    a, b = (language.fit(t, learn) for t in langs)
    assert a.names == b.names == ["0", "1"] and (a.to == b.to).all()


def test_empty_tables(spark, docs):
    none, ids = docs([]), spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert quality.score(none, quality.fit(none, ids, "true")).count() == 0
    assert near_dup.keep_one(none).count() == 0
    assert token_counts.count_tokens(none, TOKENIZER).count() == 0
    assert packing.pack(none, TOKENIZER).count() == 0
    assert language.identify(none, language.fit(none, "true")).count() == 0
    assert language.keep_languages(docs(["a"]), language.fit(none, "true")).count() == 0
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.drop_contaminated(docs(["a"]), bench).count() == 1
    assert lm_score.cross_entropy_difference(none, ids).count() == 0


def test_clashing_columns_ties_and_repeated_rows(spark):
    """Extra columns named like those that operators add or use inside; all rows stand twice, with null ids among them."""
    names = ["id", "h", "n", "text2", "part", "slice", "place", "sequence_id", "offset", "score", "predicted", "lang_pred", "n_words", "kept", "root", "key", "rep", "is_target", "background", "excess_bits"]
    texts = ["one two three four five six", "one two three four five six", None, "", "ab cd"]
    rows = [(i, t, "en", "s", 1, *names) for i, t in zip([1, 2, 3, None, 5], texts)] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(1, 1, "x"), (5, 0, "y"), (5, 0, "y")], "doc_id long, quality int, text string")
    bench = spark.createDataFrame([(7, "three four five", "z"), (7, "three four five", "z")], "item_id long, text string, doc_id string")
    scores = quality.score(table, quality.fit(table, labels, "true")).collect()
    assert len(scores) == 10 and len({(r.doc_id, r.score) for r in scores}) == 5
    assert quality.keep_good(table, quality.fit(table, labels, "true"), threshold=0.0).columns == table.columns
    found = near_dup.near_duplicates(table).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in found) == sorted(str(x) for x in [(1, 1), (2, 1), (3, 3), (None, None), (5, 5)] * 2)
    assert near_dup.keep_one(table).columns == table.columns
    assert token_counts.count_tokens(table, TOKENIZER).count() == 10 == packing.pack(table, TOKENIZER).count()
    model = language.fit(table, "true")
    assert {r.lang_pred for r in language.identify(table, model).collect()} == {"en", "und"}
    assert language.keep_languages(table, model).columns == table.columns
    hits = decontaminate.report(decontaminate.matches(table, bench)).collect()
    assert sorted(r.n_hit for r in hits) == [0] * 6 + [3] * 4 and {r.n_items for r in hits} == {0, 1}
    assert decontaminate.drop_contaminated(table, bench).columns == table.columns
    assert lm_score.cross_entropy_difference(table, labels).count() == 10


def test_ties_go_to_the_smaller_name():
    model = language.Languages({"b": ["xyz xyz"], "a": ["xyz xyz"]})
    assert model.judge(["xyz"])[0] == ["a"]


def test_texts_beyond_a_batch(spark):
    """One text of nine megabytes, beyond slices and Arrow batches, among short ones."""
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    long = " ".join(r.choice(words) for _ in range(1_400_000))
    assert len(long) > 9_000_000
    table = spark.createDataFrame([(1, "a short text", "en"), (2, long, "en"), (3, long, "en"), (4, "another one", "en")], "doc_id long, text string, lang string")
    n = long.count(" ") + 1
    some = long.split(" ")
    bench = spark.createDataFrame([(1, " ".join(some[700_000:700_030]))], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.score(table, quality.fit(table, labels, "true")).count() == 4
    hits = {x.doc_id: x for x in decontaminate.matches(table, bench).collect()}
    assert hits[2].n_words == n and [700_000, 700_030] in [hits[2].spans[k : k + 2] for k in range(0, len(hits[2].spans), 2)] and hits[2].match_words == 30 and hits[1].spans == []
    found = {x.doc_id: x for x in near_dup.near_duplicates(table).collect()}
    assert found[3].component_id == 2 and found[2].n_shingles == len({tuple(some[k : k + 5]) for k in range(n - 4)})
    assert {x.lang_pred for x in language.identify(table, language.fit(table, "doc_id <> 3")).collect()} == {"en"}
    lm = {x.doc_id: x for x in lm_score.cross_entropy_difference(table, labels.filter("quality = 1")).collect()}
    assert lm[2].n_tokens == n and lm[2].background_loss == pytest.approx(lm[3].background_loss)
    pieces = packing.pack(table, TOKENIZER).groupBy("doc_id").agg({"length": "sum"}).collect()
    tokens = {x.doc_id: x.n_tokens for x in token_counts.count_tokens(table, TOKENIZER).collect()}
    assert {x.doc_id: x[1] - 1 for x in pieces} == tokens and tokens[2] > n
