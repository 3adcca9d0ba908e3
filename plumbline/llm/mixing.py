"""Mixing sources to target weights over fixed-length blocks of words.

DataFrame functions only. The words of a source, in document order, are packed into blocks of
`block_words`. A source's target becomes a quota of block slots. The counts of each output shard are
multinomial draws without replacement from all quotas: a pseudorandom order of all source labels is
cut into shards of `shard_slots`. (Free draws would drift from the targets by the root of the counts
and could take a block a third time.) The k-th slot of a source maps through the source's
pseudorandom permutation of block indices, a new one for each pass over the source, and the block is
joined by its index. Hashes are keyed by a seed, so reruns agree.

Nulls: the null source is a source of its own, last in order; a null or empty text has no words, is
never taken and keeps taken = 0. Repeated rows are documents of their own. Empty tables give empty
results. A document with a long text lies in many blocks; nothing is cut off.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .prefix import prefix_sums
from .records import field, from_struct, in_struct
from .storage import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2  # times its source's size that a target may reach
BLOCK_WORDS = 256
SHARD_SLOTS = 4096
SEED = 20
#: Between a blank and the word after it: the parts are words with the blanks that follow them.
WORD_STARTS = r"(?<=[ \t-\r])(?=[^ \t-\r])"


def source_key(source: Column) -> Column:
    """A key without nulls that sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def _draw(seed: int, *columns: str) -> Column:
    """A pseudorandom text to order by, the same in every engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Add `target` to a table (key, source_size): shares by weight, none above `most` sizes.

    One row per source. Sorted by cap over weight, the sources that reach their cap are a prefix, and
    the level of the others is the greatest quotient of what is left by the weights that are left.
    """
    by_key = Window.partitionBy().orderBy("key")
    values = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.select(
        "key",
        "source_size",
        F.element_at(values, (F.row_number().over(by_key) - 1) % len(weights) + 1).alias("_w"),
        (F.col("source_size") * float(most)).alias("_cap"),
    )
    by_ratio = Window.partitionBy().orderBy(F.col("_cap") / F.col("_w"), "key")
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    later = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    left = share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))
    leveled = rows.withColumn("_level", left / F.sum("_w").over(later))
    return leveled.select(
        "key",
        "source_size",
        F.least("_cap", F.col("_w") * F.max("_level").over(all_rows)).alias("target"),
    )


def mix(
    docs: DataFrame,
    scratch: Scratch,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mix rows (key, size, order columns `doc_id`, `_text`) and return three tables:

    * rows: the input with `position` (number in its source), `source_size`, `target`;
    * pieces: (key, position, start, block, first_word, end_word), where each document lies in the blocks;
    * slots: (shard, slot, key, block, pass), the blocks that the mixture takes, in output order.
    """
    starts = scratch.save(prefix_sums(docs, ["doc_id", "_text"], "size", scratch, ["key"]))
    sizes = starts.groupBy("key").agg(F.sum("size").alias("source_size"))
    quotas = scratch.save(
        targets(sizes, weights, share, most)
        .withColumn("blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
        .withColumn(
            "quota",
            F.when(F.col("source_size") == 0, F.lit(0))
            .otherwise(
                F.least(
                    F.col("blocks") * most,
                    F.round(F.col("target") * F.col("blocks") / F.col("source_size")),
                )
            )
            .cast("long"),
        )
    )
    rows = starts.drop("total", "rows").join(quotas.drop("blocks", "quota"), "key")
    pieces = (
        starts.where("size > 0")
        .select(
            "key",
            "position",
            "start",
            "size",
            F.explode(
                F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")
            ).alias("block"),
        )
        .select(
            "key",
            "position",
            "start",
            "block",
            F.greatest(F.lit(0), F.col("block") * block_words - F.col("start")).alias("first_word"),
            F.least("size", (F.col("block") + 1) * block_words - F.col("start")).alias("end_word"),
        )
    )
    # A block begins in the document that holds its first word: one row for each block.
    begun = pieces.where(F.col("start") + F.col("first_word") == F.col("block") * block_words)
    passes = begun.select(
        "key",
        "block",
        F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass"),
    ).withColumn("_order", _draw(seed, "key", "pass", "block"))
    permuted = prefix_sums(
        passes.withColumn("_one", F.lit(1)), ["_order", "block"], "_one", scratch, ["key", "pass"]
    )
    taken = (
        permuted.join(quotas.select("key", "blocks", "quota"), "key")
        .withColumn("k", F.col("pass") * F.col("blocks") + F.col("position"))
        .where("k < quota")
        .select("key", "block", "pass", "k", _draw(seed + 1, "key", "k").alias("_order"))
    )
    slots = prefix_sums(taken.withColumn("_one", F.lit(1)), ["_order", "key", "k"], "_one", scratch).select(
        F.expr(f"position div {shard_slots}").alias("shard"),
        F.expr(f"position % {shard_slots}").alias("slot"),
        "key",
        "block",
        "pass",
    )
    return rows, pieces, slots


def narrow(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        source_key(F.col("source")).alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("_text"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    rows, pieces, slots = mix(narrow(spark.read.parquet(f"{sf_dir}/documents.parquet")), scratch)
    times = slots.groupBy("key", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = (
        pieces.join(times, ["key", "block"])
        .groupBy("key", "position")
        .agg(F.sum((F.col("end_word") - F.col("first_word")) * F.col("times")).alias("taken"))
    )
    return rows.join(taken, ["key", "position"], "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mixture as documents with the columns of `docs`: for each pass that takes words of a
    document, a row with those words, blanks between them kept; whole if the pass takes all."""
    scratch = Scratch(docs.sparkSession)
    rows, pieces, slots = mix(narrow(docs), scratch)
    copy = Window.partitionBy("doc_id", "key", "_text").orderBy("position")
    numbered = rows.where("size > 0").select(
        "key", "position", "size", "doc_id", "_text", F.row_number().over(copy).alias("copy")
    )
    spans = (
        pieces.join(slots.select("key", "block", "pass"), ["key", "block"])
        .groupBy("key", "position", "pass")
        .agg(
            F.array_sort(F.collect_list(F.struct("first_word", "end_word"))).alias("spans"),
            F.sum(F.col("end_word") - F.col("first_word")).alias("words"),
        )
        .join(numbered, ["key", "position"])
        .select(
            "doc_id", "key", F.col("_text").alias("text_hash"), "copy", "spans", (F.col("words") == F.col("size")).alias("whole")
        )
    )
    # Rows of one text are told apart by what else they hold; rows equal in all are interchangeable.
    again = Window.partitionBy("id", "source_key", "hash").orderBy(F.xxhash64("row"))
    texts = in_struct(docs).select(
        "row",
        field("doc_id").alias("id"),
        source_key(field("source")).alias("source_key"),
        F.xxhash64(field("text")).alias("hash"),
    ).withColumn("number", F.row_number().over(again))
    same = (
        F.col("id").eqNullSafe(F.col("doc_id"))
        & (F.col("source_key") == F.col("key"))
        & (F.col("hash") == F.col("text_hash"))
        & (F.col("number") == F.col("copy"))
    )
    words = F.split(F.regexp_replace(field("text"), r"^[ \t-\r]+", ""), WORD_STARTS)
    cut = F.array_join(
        F.flatten(
            F.transform(
                "spans",
                lambda s: F.slice(
                    "all_words", (s["first_word"] + 1).cast("int"), (s["end_word"] - s["first_word"]).cast("int")
                ),
            )
        ),
        "",
    )
    joined = texts.join(spans, same).select("row", "spans", "whole", F.when(~F.col("whole"), words).alias("all_words"))
    taken = joined.select("row", F.when(F.col("whole"), field("text")).otherwise(cut).alias("text"))
    return from_struct(taken, docs, F.col("text"))
