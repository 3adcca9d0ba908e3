"""Question tables: raw rows of the two supported shapes to one canonical form.

Canonical columns: qid, question, options ARRAY<STRUCT<label, text>>, gold_letter, dataset.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scalars import keyed_hash, prediction_error, stripped
from .scan import hashed_parts


def from_truthful(
    rows: DataFrame, shuffle_options: bool = False, shuffle_seed: int | None = None
) -> DataFrame:
    """Rows (qid, question, mc1_targets{choices, labels}); the first label 1 marks the gold option.

    With `shuffle_options` the texts are permuted per question while the letters stay, and the gold
    letter follows its text.
    """
    choices, labels = F.col("mc1_targets.choices"), F.col("mc1_targets.labels")
    position = F.array_position(labels, 1)
    correct = F.when(position > 0, position - 1).otherwise(
        F.raise_error(F.concat(F.lit("no correct choice in question "), "qid"))
    )
    seed = 0 if shuffle_seed is None else int(shuffle_seed)

    def entry(text: Column, i: Column) -> Column:
        key = keyed_hash(["qid", i], seed) if shuffle_options else i.cast("bigint")
        return F.struct(key.alias("key"), i.alias("from"), text.alias("text"))

    arranged = F.array_sort(F.transform(choices, entry))
    moved = rows.withColumn("_arranged", arranged).withColumn("_correct", correct)
    return moved.select(
        F.col("qid").cast("string").alias("qid"),
        "question",
        F.transform(
            "_arranged",
            lambda e, i: F.struct(tx.letter_at(i).alias("label"), e.getField("text").alias("text")),
        ).alias("options"),
        tx.letter_at(
            F.array_position(
                F.transform("_arranged", lambda e: e.getField("from").cast("bigint")),
                F.col("_correct").cast("bigint"),
            )
            - 1
        ).alias("gold_letter"),
        F.lit("truthfulqa").alias("dataset"),
    )


def from_open(rows: DataFrame) -> DataFrame:
    """Rows (qid, options[{label, text}], passage, question, answerKey, dataset)."""

    def optional(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    passage = F.coalesce(optional("passage"), F.lit("-"))
    lead = F.when(passage.isin("", "-"), "").otherwise(F.concat(passage, F.lit("\n\n")))
    return rows.select(
        F.col("qid").cast("string").alias("qid"),
        F.concat(lead, "question").alias("question"),
        F.transform(
            "options",
            lambda o: F.struct(
                F.upper(stripped(o.getField("label"))).alias("label"),
                o.getField("text").alias("text"),
            ),
        ).alias("options"),
        F.nullif(F.upper(stripped(optional("answerKey"))), F.lit("")).alias("gold_letter"),
        F.coalesce(optional("dataset"), F.lit("open_llm")).alias("dataset"),
    )


def explode_options(mcq: DataFrame) -> DataFrame:
    """One row per option with its position."""
    rest = [c for c in mcq.columns if c != "options"]
    return mcq.select(*rest, F.posexplode("options").alias("pos", "_o")).select(
        *rest, "pos", F.upper("_o.label").alias("letter"), F.col("_o.text").alias("text")
    )


def with_ordinal(
    rows: DataFrame, file: str = "_file", row_index: str = "_row", name: str = "qid"
) -> DataFrame:
    """Replace (file, row index) by the row ordinal over all files in path order, as text.

    Only one count per file is gathered, so the rows themselves are not shuffled.
    """
    before = (
        Window.partitionBy(F.lit(0)).orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        rows.groupBy(file)
        .agg((F.max(row_index) + 1).alias("_n"))
        .select(file, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    rest = [c for c in rows.columns if c not in (file, row_index)]
    ordinal = (F.col(row_index) + F.col("_before")).cast("string").alias(name)
    return rows.join(offsets, file).select(ordinal, *rest)


def sample(
    rows: DataFrame, size: int | None, ids: Sequence[str] = ("qid",), seed: int | None = 1337
) -> DataFrame:
    """Exactly `size` rows without replacement, or all rows when there are not more."""
    if size is None:
        return rows
    parts = hashed_parts(rows, ids, seed or 0, [], counts=[size])
    return parts.where("_part = 0").select(*rows.columns)


def prompts(mcq: DataFrame, style: tx.PromptStyle = tx.PromptStyle()) -> DataFrame:
    """Per question: options text, question-only prompt, full prompt, bare prompt and lengths."""
    block = tx.options_text("options")
    full = tx.full_prompt("question", block, style)
    only = tx.question_prompt("question", style)
    return mcq.select(
        "qid",
        block.alias("options_text"),
        only.alias("q_prompt"),
        F.length(only).alias("q_prompt_len"),
        full.alias("prompt"),
        F.length(full).alias("prompt_len"),
        tx.bare_prompt("question", block, style).alias("bare_prompt"),
    )


def option_prompts(mcq: DataFrame, style: tx.PromptStyle = tx.PromptStyle()) -> DataFrame:
    """Per option: response text and the three prompts that are not conditioned on the question."""
    long = explode_options(mcq.withColumn("_block", tx.options_text("options")))
    plain = tx.answer_prompt(style)
    listed = tx.answer_prompt_with_options("_block", style)
    response = tx.response_text("letter", "text")
    return long.select(
        "qid",
        "letter",
        response.alias("response"),
        tx.option_line("letter", "text").alias("option_line"),
        plain.alias("uncond_prompt"),
        F.length(plain).alias("uncond_prompt_len"),
        tx.with_letter(plain, F.col("letter")).alias("uncond_letter"),
        tx.with_text(plain, response).alias("uncond_text"),
        tx.with_letter(listed, F.col("letter")).alias("uncond_letter_options"),
    )


def label_predictions(
    rows: DataFrame, response: str = "response", gold: str = "gold"
) -> DataFrame:
    """Add the letter parsed from a response and whether it contradicts the gold letter."""
    parsed = rows.withColumn("pred_letter", tx.parsed_letter(response, gold))
    return parsed.withColumn("is_hallucination", prediction_error("pred_letter", gold))


