"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes what its predecessor kept, written as Parquet and read again. All stages but the last
return the columns of ``documents``; their decisions take effect by dropping rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernbase.llm.bpe import round_trip
from fernbase.llm.common import Written, table
from fernbase.llm.decontaminate import clean_documents
from fernbase.llm.exact_dedup import keep_first_copies
from fernbase.llm.quality import accepted
from fernbase.llm.simhash import one_of_each_group

#: SQL cannot express the classifier, the components or the encoder; tests/llm holds the run against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for blanks one stays."""
    return keep_first_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose SimHash fingerprints link, one stays."""
    return one_of_each_group(docs, size=3, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"), window=13)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``: a row for each that is left, none for an empty table. What the
    stages say of nulls, empty and very long texts, ties and repeated rows holds for all of them together; extra
    columns travel along as far as the last stage, which reads the id and the text. A stage's table is
    deleted when the next one has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written = Written(docs, f"pipeline-{name}")
            if before:
                before.drop()
            docs, before = written.df, written
    return docs
