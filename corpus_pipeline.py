"""From raw documents to packed training sequences in five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns rows with the columns of documents, the last one packed
pieces. What a stage returns is written as Parquet and read again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import decontaminate, language, near_dup, packing, quality
from stratalog.llm.shared import discard, table, written

TOKENIZER = "byte_bpe_50k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those unlike every language that `lang` names."""
    return language.keep_languages(docs, language.fit(docs, "crc32(cast(doc_id as string)) % 4 <> 2"))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that score below 0.3."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels"), "crc32(cast(doc_id as string)) % 5 <> 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a similarity of 0.8 on shingles of five words."""
    return near_dup.keep_one(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of what is left into sequences of 1024."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_text),
    ("best_fit_packing", pack_sequences),
]

#: SQL expresses neither the learned stages nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = written(out, name)
            discard(spark, docs)  # what the stage before had written
        docs = out
    return docs
