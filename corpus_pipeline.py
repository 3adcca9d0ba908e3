"""The corpus pipeline: quality rules, near duplicates, secrets, mixture and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's documents. All but the last return the columns of `documents`:

1. quality_rules: rejected documents go; frequent lines go from the others.
2. near_duplicates: of each group of linked documents the one with the smallest doc_id stays.
3. secret_scan: secrets are masked; every document stays.
4. source_mix: the mixture by source, a row for each pass that takes words of a document.
5. packing: a row for each piece with its sequence and place there.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.jaccard import one_of_each_group
from plumbline.llm.mixing import mixed_documents
from plumbline.llm.packing import pack_documents
from plumbline.llm.quality import clean_documents
from plumbline.llm.secrets import masked_documents
from plumbline.llm.storage import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return masked_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, Scratch(spark), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: SQL can express neither the search nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
