"""Text expressions: labels, prompts, letter parsing, path slugs."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import ColumnLike, col, stripped

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class PromptStyle:
    """The fixed wording of a prompt. These strings are fixed values."""

    system: str = "You are a helpful, factual assistant."
    question_label: str = "Question:"
    options_label: str = "Options:"
    answer_label: str = "Answer:"


def letter_at(index: ColumnLike) -> Column:
    """Letter of a zero-based position. A position beyond Z is an error: letters are option keys."""
    place = col(index).cast("int")
    beyond = F.raise_error(F.lit("a question has more than 26 options"))
    return F.when(place >= len(LETTERS), beyond).otherwise(
        F.substring(F.lit(LETTERS), place + 1, F.lit(1))
    )


def clean_label(label: ColumnLike) -> Column:
    """Label trimmed and upper-cased; an empty or missing label reads as A."""
    return F.upper(stripped(F.coalesce(F.nullif(col(label), F.lit("")), F.lit("A"))))


def option_line(label: ColumnLike, text: ColumnLike) -> Column:
    return F.concat(clean_label(label), F.lit(") "), col(text))


def response_text(label: ColumnLike, text: ColumnLike) -> Column:
    return F.concat(col(label), F.lit(") "), col(text))


def options_block(labels: ColumnLike, texts: ColumnLike) -> Column:
    """One normalised line per option, cut to the shorter of the two arrays."""
    n = F.least(F.size(col(labels)), F.size(col(texts)))
    return F.array_join(
        F.zip_with(F.slice(col(labels), 1, n), F.slice(col(texts), 1, n), option_line), "\n"
    )


def options_text(options: ColumnLike) -> Column:
    """One line per option with the label as it stands."""
    return F.array_join(
        F.transform(
            col(options), lambda o: response_text(o.getField("label"), o.getField("text"))
        ),
        "\n",
    )


def option_labels(options: ColumnLike) -> Column:
    return F.transform(col(options), lambda o: F.upper(o.getField("label")))


def _prompt(style: PromptStyle, *lines: Column) -> Column:
    return F.concat(F.lit(style.system + "\n\n"), F.concat_ws("\n", *lines))


def question_prompt(question: ColumnLike, style: PromptStyle = PromptStyle()) -> Column:
    return _prompt(
        style,
        F.concat(F.lit(style.question_label + " "), col(question)),
        F.lit(style.answer_label),
    )


def full_prompt(
    question: ColumnLike, block: ColumnLike, style: PromptStyle = PromptStyle()
) -> Column:
    return F.concat(F.lit(style.system + "\n\n"), bare_prompt(question, block, style))


def bare_prompt(
    question: ColumnLike, block: ColumnLike, style: PromptStyle = PromptStyle()
) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit(style.question_label + " "), col(question)),
        F.lit(style.options_label),
        col(block),
        F.lit(style.answer_label),
    )


def answer_prompt(style: PromptStyle = PromptStyle()) -> Column:
    """Prompt without question and options."""
    return _prompt(style, F.lit(style.answer_label))


def answer_prompt_with_options(block: ColumnLike, style: PromptStyle = PromptStyle()) -> Column:
    return _prompt(style, F.lit(style.options_label), col(block), F.lit(style.answer_label))


def with_letter(prompt: Column, label: ColumnLike) -> Column:
    return F.concat(prompt, F.lit(" "), clean_label(label), F.lit(")"))


def with_text(prompt: Column, text: ColumnLike) -> Column:
    return F.concat(prompt, F.lit(" "), F.coalesce(col(text), F.lit("")))


def parsed_letter(response: ColumnLike, gold: ColumnLike) -> Column:
    """Leading letter of 'b) ...' in upper case, else the gold letter, else A."""
    found = F.upper(
        F.regexp_extract(F.coalesce(col(response), F.lit("")), r"^\s*([A-Za-z])\s*\)", 1)
    )
    return F.coalesce(
        F.nullif(found, F.lit("")), F.nullif(col(gold), F.lit("")), F.lit("A")
    )


def slug(text: ColumnLike) -> Column:
    """File-system tag: other characters become '-', runs shrink to one, ends are stripped."""
    dashed = F.regexp_replace(F.trim(col(text)), r"[^A-Za-z0-9_.-]+", "-")
    return F.regexp_replace(F.regexp_replace(dashed, "-{2,}", "-"), "^-+|-+$", "")


def run_tag(dataset: ColumnLike, model_id: ColumnLike) -> Column:
    return F.concat(
        slug(dataset), F.lit("__"), slug(F.element_at(F.split(col(model_id), "/"), -1))
    )
