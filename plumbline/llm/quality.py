"""Quality rules: frequent lines of a host, found across documents, and the documents they deplete.

Lines are normalised (A-Z lower-cased, words joined by one blank) and hashed. A line's frequency is
the number of documents (rows) of a host that hold it, each counted once however often it repeats the
line. A line in more than `MAX_DOCUMENTS` documents of a host is removed from all of them but the first
(the smallest doc_id, with its copies), so that what is repeated stays once. A document that loses
more than half of its words is depleted and rejected. Texts that are equal are measured once; their
number of documents is carried along.

Nulls: a null text has no words and fails the base rules; a null host is a host of its own; a null
doc_id comes last. Repeated rows are documents of their own and get the same verdict. Extra columns
pass through, whatever their names.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import field, from_struct, in_struct, struct_schema
from .storage import Scratch
from .words import SLICE_BYTES, text_slices

MAX_DOCUMENTS = 10
LEAST_WORDS = 50
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_LOWER = {c: c + 32 for c in range(65, 91)}

MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
ROW_SCHEMA = f"doc_id bigint, host string, text_hash bigint, {MEASURES}, line_hashes array<bigint>, line_words array<int>"


def repeat_words(words: list[str], width: int = 3) -> int:
    """Words inside windows of `width` words that occur twice or more."""
    if len(words) <= width:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    windows = ids[: len(ids) - width + 1]
    for k in range(1, width):
        # Window numbers stay below the number of words, so the products stay small.
        _, windows = np.unique(windows, return_inverse=True)
        windows = windows * len(number) + ids[k : len(ids) - width + 1 + k]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[which] > 1
    if not again.any():
        return 0
    inside = np.zeros(len(ids), bool)
    for k in range(width):
        inside[k : len(again) + k] |= again
    return int(inside.sum())


def line_hash(line: str) -> int | None:
    words = _WORD.findall(line)
    if not words:
        return None
    return xxhash.xxh64_intdigest(" ".join(words).translate(_LOWER)) - (1 << 63)


def measure(text: str | None):
    """The base measures, and the distinct normalised lines with their numbers of words in the text."""
    text = text or ""
    seen, dup, lines, words = set(), 0, {}, []
    for line in text.split("\n"):
        own = _WORD.findall(line)
        if not own:
            continue
        dup += line in seen
        seen.add(line)
        key = xxhash.xxh64_intdigest(" ".join(own).translate(_LOWER)) - (1 << 63)
        lines[key] = lines.get(key, 0) + len(own)
        words += own
    chars = sum(map(len, words))
    return len(words), chars, len(_SYMBOL.findall(text)), dup, repeat_words(words), list(lines), list(lines.values())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
    for batch in text_slices(batches, 3, SLICE_BYTES):
        found = list(zip(*map(measure, batch.column(3).to_pylist()))) or [()] * 7
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), *[pa.array(c, k) for c, k in zip(found, kinds)]],
            ["doc_id", "host", "text_hash", *[m.split()[0] for m in MEASURES.split(", ")], "line_hashes", "line_words"],
        )


def verdicts(
    docs: DataFrame, host: str, scratch: Scratch, most: int = MAX_DOCUMENTS
) -> tuple[DataFrame, DataFrame]:
    """Measures of each row with `removed` (hashes of its lines to remove), `removed_words`,
    `base_failed` and `kept`; and the table of frequent lines (host_line, documents, first_text)."""
    rows = scratch.save(
        docs.select(
            F.col("doc_id").cast("bigint"),
            F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("n")).alias("host"),
            F.xxhash64("text").alias("text_hash"),
            "text",
        ).mapInArrow(_rows, ROW_SCHEMA)
    )
    key = ["host", "text_hash"]
    texts = rows.groupBy(*key).agg(
        F.min("doc_id").alias("doc_id"),
        F.count(F.lit(1)).alias("copies"),
        F.first("line_hashes").alias("line_hashes"),
        F.first("line_words").alias("line_words"),
    )
    lines = texts.select(
        *key,
        F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"),
        "copies",
        F.explode(F.arrays_zip("line_hashes", "line_words")).alias("line"),
    ).select(
        *key, F.xxhash64("host", "line.line_hashes").alias("host_line"), "doc_id", "copies", "line.line_hashes", "line.line_words"
    )
    frequent = (
        lines.groupBy("host_line")
        .agg(
            F.sum("copies").alias("documents"),
            F.min(F.struct("doc_id", "text_hash"))["text_hash"].alias("first_text"),
        )
        .where(F.col("documents") > most)
    )
    losses = (
        lines.join(frequent, "host_line")
        .where(F.col("text_hash") != F.col("first_text"))
        .groupBy(*key)
        .agg(F.collect_list("line_hashes").alias("removed"), F.sum("line_words").alias("removed_words"))
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = (
        rows.drop("line_hashes", "line_words")
        .join(losses, key, "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (2 * F.col("removed_words") <= F.col("n_words")))
    )
    return judged, frequent


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged, _ = verdicts(docs, "source", Scratch(spark))
    measures = [m.split()[0] for m in MEASURES.split(", ")]
    return judged.select("doc_id", *measures, "base_failed", "kept", "removed_words")


def clean_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that are kept, without the lines that are removed; columns of `docs`."""
    judged, _ = verdicts(docs, host, Scratch(docs.sparkSession))
    good = judged.where("kept").select("host", "text_hash", "removed").dropDuplicates(["host", "text_hash"])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1, SLICE_BYTES):
            texts = []
            for text, removed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if removed:
                    gone = set(removed)
                    text = "\n".join([x for x in text.split("\n") if line_hash(x) not in gone])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    keyed = in_struct(docs).select(
        "row",
        F.coalesce(F.concat(F.lit("h"), field(host).cast("string")), F.lit("n")).alias("host"),
        F.xxhash64(field("text")).alias("text_hash"),
    )
    joined = keyed.join(good, ["host", "text_hash"]).select("row", field("text").alias("text"), "removed")
    return from_struct(joined.mapInArrow(strip, struct_schema(docs, "text string")), docs, F.col("text"))
