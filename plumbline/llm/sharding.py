"""Contiguous shards of nearly equal bytes: global prefix sums cut at equal targets.

DataFrame functions only. Texts are measured where they are read; what moves is a narrow row for
each document. Nulls: a null text has no bytes; a null doc_id comes first. Repeated rows are rows of
their own. An empty table gives an empty result. Extra columns are not read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .prefix import prefix_sums
from .storage import Scratch

SHARDS = 8


def contiguous_shards(df: DataFrame, shards: int, size: str, order: list[str]) -> DataFrame:
    """Add `shard` and `slot` (gapless from 0 in each shard) to rows of positive long `size`.

    A row belongs to the shard whose equal share of all bytes holds the row's middle, so a shard
    differs from its share by less than the largest row. Sizes times twice the shards must fit a long.
    """
    scratch = Scratch(df.sparkSession)
    placed = scratch.save(
        prefix_sums(df, order, size, scratch).withColumn(
            "shard",
            F.expr(f"cast(least({shards - 1}, (2 * start + {size}) * {shards} div (2 * total)) as int)"),
        )
    )
    first = placed.groupBy("shard").agg(F.min("position").alias("_first"))
    return placed.join(first, "shard").select(
        *df.columns, "shard", (F.col("position") - F.col("_first")).alias("slot")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64("text").alias("_text"),
    )
    return contiguous_shards(docs, SHARDS, "size", ["doc_id", "text_crc32", "size", "_text"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

