"""The opN_ queries: thin projections of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.shared import table

TOKENIZER = "byte_bpe_50k.json"
#: the same vocabulary as ranks, and its one special token
RANKS, SPECIAL = "byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256}


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm import quality as m

    docs = table(spark, sf_dir, "documents")
    found = m.score(docs, m.fit(docs, table(spark, sf_dir, "labels"), "crc32(cast(doc_id as string)) % 5 <> 0"))
    return found.select("doc_id", F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)").alias("held_out"), "score", "predicted")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stratalog.llm import chat as m

    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("select conv_id, turn, role, '</s>[INST] ok [/INST]' text from values (-7L, 0L, 'user'), (-7L, 1L, 'assistant') as t(conv_id, turn, role)")
    tokenizer = public_tokenizers.path(TOKENIZER)
    return m.read_back(m.trees(own.unionByName(more), tokenizer), tokenizer)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm import nearest as m

    return m.search(table(spark, sf_dir, "embeddings"), "id % 20 = 0", exact=False)


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm import near_dup as m

    return m.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stratalog.llm import token_counts as m

    return m.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), pattern=public_tokenizers.PATTERN, special=SPECIAL)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from stratalog.llm import packing as m

    return m.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm import language as m

    docs = table(spark, sf_dir, "documents")
    found = m.identify(docs, m.fit(docs, "crc32(cast(doc_id as string)) % 4 <> 2"))
    return found.select("doc_id", F.expr("coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)").alias("held_out"), "lang_pred", "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm import decontaminate as m

    return m.report(m.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from stratalog.llm import shards as m
    from stratalog.llm.shared import shared_dir

    at, rows = m.sharded(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    settled = not at.full_tiers(at.manifest()["files"])
    return rows.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("text_bytes"), F.md5("text").alias("text_md5"), F.col(m.ADDED).alias("added_version"), F.lit(settled).alias("tiers_settled"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm import lm_score as m

    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").filter("quality > 0").select("doc_id")
    return m.cross_entropy_difference(docs, good)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm import warc as m
    from stratalog.llm.shared import discard, written

    archives = m.write(table(spark, sf_dir, "pages"))
    records = m.settled(m.read(archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    out = written(records, "warc_records")
    m.remove(archives)
    discard(spark, archives)
    return out


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm import divergence as m

    return m.audit(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm import spelling as m

    return m.variants(table(spark, sf_dir, "documents"), misspelt=97)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from stratalog.llm import oracle

    return oracle.SQL
