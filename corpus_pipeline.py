"""The corpus pipeline: quality rules, near duplicates, secrets, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; what it returns
is written as Parquet and read again as the next one's docs.

Defined cases, of all stages: null texts count as empty; very long texts are taken whole; rows that are
repeated are treated alike, each as a row, but for the near duplicates, of which one stays; an empty
table gives no rows; further columns stay as they are, whatever their names (packing returns columns
of its own).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillstream.llm.common import free, scope, scratch, table
from quillstream.llm.jaccard import deduplicate
from quillstream.llm.mixing import mix_sources
from quillstream.llm.packing import pack_documents
from quillstream.llm.quality import retain
from quillstream.llm.secrets import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go; null and empty texts have no words and go."""
    return retain(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: the one with the smallest id. Texts without words are like no other and stay."""
    return deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found spans are masked; all documents stay, null texts as they are."""
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one without words has size 0 and goes by its source's rate; a null source is one of its own."""
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its place in a sequence; a null or empty text is one piece that has the end id alone."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packing),
]

#: Learned rules, tokens and packing are beyond SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. What a stage was given is removed when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with scope():
            given, docs = docs, scratch(stage(spark, docs, sf_dir), keep=True)
        free(given)
