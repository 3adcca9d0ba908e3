"""Evidence from recorded logits: trace(keys, step, logits ARRAY<DOUBLE>[, target_id]).

A logit vector is reduced next to where it is read. Only a few numbers per step are shuffled, never
the vectors, and the aggregates over steps merge on the map side.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import total
from ..functions.scalars import finite, let, stripped
from ..functions.vectorised import logit_summary

VOTES = 16
VOTE_SEED = 1234
LOG_FLOOR = 1e-8
EMPTY_BUCKET = -1e9
MAX_LETTERS = 26
# Length columns of an evidence row -> columns of the trace.
LENGTHS = {
    "llmc_prompt_len": "prompt_len",
    "llmc_total_len": "total_len",
    "llmc_resp_len": "resp_len",
}


def step_statistics(trace: DataFrame, logits: str = "logits") -> DataFrame:
    """Replace the logits by entropy, margin, largest probability and, with a `target_id` column,
    the log-probability of the target. A step without its target is an error."""
    rest = [c for c in trace.columns if c != logits]
    summed = trace.withColumn("_s", logit_summary(logits))
    columns = [
        finite(F.col(f"_s.{name}")).alias(name) for name in ("entropy", "margin", "maxprob")
    ]
    if "target_id" in trace.columns:
        columns.append(target_logprob(logits, F.col("_s.logsumexp")).alias("logprob"))
    return summed.select(*rest, *columns)


def target_logprob(logits: str, logsumexp: Column, target: str = "target_id") -> Column:
    """An id that is missing or outside the vector is an error."""
    known = (F.col(target) >= 0) & (F.col(target) < F.size(logits))
    checked = F.when(known, F.col(target)).otherwise(
        F.raise_error(F.lit("a step has no target id inside its logits"))
    )
    return F.get(F.col(logits), checked.cast("int")) - logsumexp


def mean_nll(trace: DataFrame, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """Mean negative log-likelihood of the targets in trace(keys, step, logits, target_id).

    A step without a target is left out, as the shorter sequence decides. A key with a target
    outside its vector, with a value that is not finite, or without any target gets NULL. Vectors
    are reduced where they are read; one number per step is aggregated.
    """
    target = F.col("target_id").cast("int")
    values = trace.select(
        *keys,
        target.isNotNull().alias("_paired"),
        (F.get("logits", target) - logit_summary("logits").getField("logsumexp")).alias("_lp"),
    )
    lost = F.count_if(F.col("_paired") & F.col("_lp").isNull())
    mean = -F.avg(F.when(F.col("_paired"), F.col("_lp")))
    return values.groupBy(*keys).agg(F.when(lost == 0, finite(mean)).alias("nll"))


def aggregate_values(
    df: DataFrame,
    value: str,
    stats: Sequence[str] = ("mean", "min", "max", "std"),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Mean, min, max, population std of a column; unknown statistics are ignored."""
    known = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop}
    chosen = [known[s](value).alias(s) for s in stats if s in known]
    return df.groupBy(*keys).agg(*(chosen or [F.count(F.lit(1)).alias("n")]))


def letter_probabilities(
    logits: str, letter_ids: Mapping[str, int], summary: Column
) -> dict[str, Column]:
    """Softmax probability of each letter's token id; an id outside the vector gives NULL."""
    peak, mass = summary.getField("peak"), summary.getField("total")
    values = F.col(logits)
    return {
        letter: F.exp(F.get(values, F.lit(int(i))) - peak) / mass
        for letter, i in letter_ids.items()
    }


def feature_rows(
    examples: DataFrame, trace: DataFrame, letter_ids: Mapping[str, int], key: str = "qid"
) -> DataFrame:
    """One row per example (qid, dataset, gold_letter) from its logits.

    Means ignore non-finite steps; the letter columns need a last step that is finite throughout.
    An example without steps keeps T = 0 and NULLs. The first letter of the map wins ties.
    """
    steps = trace.select(key, "step", "logits", logit_summary("logits").alias("_s"))
    probabilities = letter_probabilities("logits", letter_ids, F.col("_s"))
    small = steps.select(
        key,
        "step",
        F.size("logits").alias("_v"),
        *[finite(F.col(f"_s.{n}")).alias(n) for n in ("entropy", "margin", "maxprob")],
        *[F.when(F.col("_s.finite"), p).alias(f"p_{letter}") for letter, p in probabilities.items()],
    )
    last = F.max_by(
        F.struct("_v", "entropy", "maxprob", *[f"p_{letter}" for letter in letter_ids]), "step"
    )
    grouped = small.groupBy(key).agg(
        F.count(F.lit(1)).alias("T"),
        F.avg("entropy").alias("ent_mean"),
        F.stddev_pop("entropy").alias("ent_std"),
        F.avg("margin").alias("margin_mean"),
        F.avg("maxprob").alias("maxprob_mean"),
        last.alias("_last"),
    )
    best = F.greatest(*[F.col(f"p_{letter}") for letter in letter_ids], F.lit(-1.0))
    predicted = F.lit("")
    for letter in reversed(list(letter_ids)):
        predicted = F.when(
            (F.col(f"p_{letter}") == best) & (best >= 0), F.lit(letter)
        ).otherwise(predicted)
    gold = F.upper(stripped(F.coalesce("gold_letter", F.lit(""))))
    wide = (
        examples.select(key, "dataset", "gold_letter")
        .join(grouped, key, "left")
        .select(
            key,
            "dataset",
            "gold_letter",
            F.coalesce("T", F.lit(0)).cast("int").alias("T"),
            F.coalesce("_last._v", F.lit(0)).alias("V"),
            "ent_mean",
            "ent_std",
            "margin_mean",
            "maxprob_mean",
            F.col("_last.entropy").alias("last_entropy"),
            F.col("_last.maxprob").alias("last_maxprob"),
            *[F.col(f"_last.p_{letter}").alias(f"p_{letter}") for letter in letter_ids],
        )
    )
    return (
        wide.withColumn("pred_letter", predicted)
        .withColumn(
            "is_error",
            F.when(
                (F.col("pred_letter") != "") & (gold != ""), (F.col("pred_letter") != gold)
            ).cast("int"),
        )
        .drop("gold_letter")
    )


# ---- spans of a response --------------------------------------------------------------------


def response_region(trace: DataFrame) -> DataFrame:
    """Keep the positions that predict response tokens and number them from 0 as `step`.

    The logits at position t predict token t + 1, so the region is prompt_len - 1 .. total_len - 2.
    A response without tokens is an error. All bounds are columns of the row itself.
    """
    start = F.greatest(F.col("prompt_len") - 1, F.lit(0))
    length = F.col("total_len") - F.col("prompt_len")
    inside = (F.col("pos") >= start) & (F.col("pos") <= F.col("total_len") - 2)
    checked = F.when(length > 0, inside).otherwise(
        F.raise_error(F.lit("empty response region")).cast("boolean")
    )
    return (
        trace.where(checked)
        .withColumn("resp_len", length)
        .withColumn("step", (F.col("pos") - start).cast("int"))
    )


def span_bounds(view: str, span: str | int = "first") -> tuple[Column, Column]:
    """(first step, length) of the scored span of a response.

    View `letter` starts at the choice letter, `content` after the 'X) ' prefix of `prefix_len`
    tokens. A span is `first`, `all`, or a number of tokens, and has at least one token.
    """
    if view not in ("letter", "content"):
        raise ValueError(f"unknown view: {view}")
    if isinstance(span, str) and span not in ("first", "all"):
        raise ValueError(f"unknown span: {span}")
    if not isinstance(span, str) and span <= 0:
        raise ValueError("a span needs a positive number of tokens")
    length = F.col("resp_len")
    if view == "letter":
        start = F.lit(0)
    else:
        start = F.least(F.col("prefix_len"), F.greatest(length - 1, F.lit(0)))
    if span == "first":
        wanted = F.lit(1)
    elif span == "all":
        wanted = length - start
    else:
        wanted = F.lit(int(span))
    return start, F.greatest(F.lit(1), F.least(wanted, length - start))


def option_evidence(
    trace: DataFrame,
    view: str,
    span: str | int = "first",
    keys: Sequence[str] = ("qid", "letter"),
    options: DataFrame | None = None,
) -> DataFrame:
    """Cross-entropy with and without the question, their difference (PMI), and span entropy.

    `trace` holds response steps of both passes (`role` = cond / uncond) with target_id, resp_len,
    prefix_len and optionally `avail_len`, the steps an unconditional pass really has. One shuffle:
    both roles are aggregated together. With `options`, keys without any step get NULLs and span 0.
    """
    start, length = span_bounds(view, span)
    available = F.col("avail_len") if "avail_len" in trace.columns else F.col("resp_len")
    room = available - start
    length = F.when(F.col("role") == "uncond", F.least(length, F.greatest(room, F.lit(1))))\
        .otherwise(length)
    inside = (F.col("step") >= start) & (F.col("step") < start + length)
    reachable = (F.col("role") == "cond") | (room > 0)
    # The lengths of the conditional pass go with its evidence, where the trace has them.
    lengths = {n: c for n, c in LENGTHS.items() if c in trace.columns}
    summed = trace.where(inside & reachable).select(
        *keys, "role", "logits", "target_id", *lengths.values(), logit_summary("logits").alias("_s")
    )
    scored = summed.select(
        *keys,
        "role",
        *lengths.values(),
        (-target_logprob("logits", F.col("_s.logsumexp"))).alias("_nll"),
        F.when(F.col("role") == "cond", F.col("_s.clamped_entropy")).alias("_entropy"),
    )
    cond = F.col("role") == "cond"
    prefix = f"llmc_{view}_"
    grouped = scored.groupBy(*keys).agg(
        finite(F.avg(F.when(cond, F.col("_nll")))).alias(f"{prefix}ce_cond"),
        finite(F.avg(F.when(~cond, F.col("_nll")))).alias(f"{prefix}ce_uncond"),
        F.avg("_entropy").alias("_entropy"),
        F.count_if(cond).alias(f"{prefix}span_len"),
        *[F.max(F.when(cond, F.col(source))).alias(name) for name, source in lengths.items()],
    )
    result = grouped.select(
        *keys,
        f"{prefix}ce_cond",
        f"{prefix}ce_uncond",
        (F.col(f"{prefix}ce_uncond") - F.col(f"{prefix}ce_cond")).alias(f"{prefix}ce_logpmi"),
        F.when(F.col(f"{prefix}ce_cond").isNotNull(), F.col("_entropy")).alias(
            f"{prefix}logit_entropy_mean"
        ),
        f"{prefix}span_len",
        *lengths,
    )
    if options is not None:
        result = options.select(*keys).join(result, list(keys), "left").withColumn(
            f"{prefix}span_len", F.coalesce(f"{prefix}span_len", F.lit(0))
        )
    return with_evidence_aliases(result, view)


def with_evidence_aliases(evidence: DataFrame, view: str) -> DataFrame:
    """Repeat the three cross-entropies under their older names `e_<view>_*`."""
    return evidence.select(
        "*",
        *[
            F.col(f"llmc_{view}_{name}").alias(f"e_{view}_{name}")
            for name in ("ce_logpmi", "ce_cond", "ce_uncond")
        ],
    )


# ---- letter distribution of the last step ---------------------------------------------------


def letter_buckets(variants: DataFrame) -> DataFrame:
    """(letter, ids): sorted distinct first token ids over the spellings of a letter.

    Input (letter, token_ids ARRAY<INT>); the set is bounded by the vocabulary.
    """
    return (
        variants.where(F.size("token_ids") > 0)
        .groupBy("letter")
        .agg(F.sort_array(F.collect_set(F.get("token_ids", F.lit(0)))).alias("ids"))
    )


def bucket_literals(buckets: DataFrame) -> dict[str, list[int]]:
    """The bucket table of at most 26 letters as plain values for `letter_evidence`."""
    rows = buckets.limit(MAX_LETTERS + 1).collect()
    if len(rows) > MAX_LETTERS:
        raise ValueError("a bucket table has one row per letter, at most 26")
    return {r["letter"]: list(r["ids"]) for r in rows}


def _uniform_draws(votes: int, seed: int) -> list[float]:
    return [float(u) for u in np.random.default_rng(seed).random(votes)]


def _uniform_indices(votes: int, seed: int) -> list[list[int]]:
    """For each number of letters, the draws used when no letter has any mass."""
    return [
        [int(i) for i in np.random.default_rng(seed).integers(0, n, votes)]
        for n in range(1, MAX_LETTERS + 1)
    ]


def _literal(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def letter_evidence(
    last: DataFrame,
    buckets: Mapping[str, Sequence[int]],
    temperature: float = 1.0,
    votes: int = VOTES,
    seed: int = VOTE_SEED,
) -> DataFrame:
    """Letter distribution and its statistics from the last-step logits of a question.

    Input (qid, letters ARRAY<STRING>, logits[, gen_text]). A letter's mass is the softmax mass of
    its token ids; without any mass, the first character of `gen_text` decides. Everything is
    computed inside the row.
    """
    table = F.create_map(
        *[
            item
            for letter, ids in buckets.items()
            for item in (F.lit(letter), _literal(ids).cast("array<int>"))
        ]
    )
    heat = max(float(temperature), 1e-8)
    generated = (
        F.upper(F.substring(stripped("gen_text"), 1, 1))
        if "gen_text" in last.columns
        else F.lit("")
    )

    def measure(letter: Column, source: Column) -> Column:
        ids = F.coalesce(F.try_element_at(table, letter), F.array().cast("array<int>"))

        def read(found: Column) -> Column:
            raw = F.transform(found, lambda i: F.get(source.getField("raw"), i))
            top = F.array_max(raw)
            mass = total(
                F.transform(
                    found,
                    lambda i: F.exp(
                        F.get(source.getField("raw"), i) / F.lit(heat) - source.getField("peak")
                    )
                    / source.getField("total"),
                )
            )
            spread = F.aggregate(raw, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
            return F.struct(
                letter.alias("letter"),
                mass.alias("mass"),
                F.coalesce(top, F.lit(EMPTY_BUCKET)).alias("top"),
                F.coalesce(top + F.ln(spread), F.lit(EMPTY_BUCKET)).alias("lse"),
                F.size(found).alias("ids"),
            )

        return let(ids, read)

    measured = (
        last.withColumn("_sum", logit_summary("logits", heat))
        .withColumn(
            "_source",
            F.struct(
                F.col("logits").alias("raw"),
                F.col("_sum.peak").alias("peak"),
                F.col("_sum.total").alias("total"),
            ),
        )
        .withColumn(
            "_letters",
            let(
                F.col("_source"),
                lambda s: F.transform("letters", lambda letter: measure(letter, s)),
            ),
        )
        .drop("_source", "_sum", "logits")
    )
    masses = F.transform("_letters", lambda e: e.getField("mass"))
    n = F.size("letters")
    slot = F.array_position("letters", generated)
    with_p = (
        measured.withColumn("_total", total(masses))
        .withColumn(
            "_raw_p",
            F.transform(
                masses,
                lambda m: F.when(F.col("_total") > 0, F.try_divide(m, "_total")).otherwise(0.0),
            ),
        )
        .withColumn(
            "fcm_letter_probs",
            F.when(F.col("_total") > 0, F.col("_raw_p")).otherwise(
                F.transform("letters", lambda letter, i: (i + 1 == slot).cast("double"))
            ),
        )
        .withColumn(
            "fcm_mass_on_letters",
            F.when(F.col("_total") > 0, F.col("_total")).otherwise((slot > 0).cast("double")),
        )
    )
    p = F.col("fcm_letter_probs")

    def cumulative(values: Column) -> Column:
        running = F.aggregate(
            values,
            F.array().cast("array<double>"),
            lambda acc, v: F.concat(
                acc, F.array(v + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))
            ),
        )
        return let(
            running,
            lambda r: F.transform(
                r, lambda v: F.try_divide(v, F.try_element_at(r, F.lit(-1)))
            ),
        )

    drawn = let(
        cumulative(p),
        lambda cdf: F.transform(
            _literal(_uniform_draws(votes, seed)), lambda u: F.size(F.filter(cdf, lambda c: c <= u))
        ),
    )
    blind = F.when(
        n > MAX_LETTERS, F.raise_error(F.lit("a question has more than 26 letters"))
    ).otherwise(F.get(F.array(*[_literal(row) for row in _uniform_indices(votes, seed)]), n - 1))
    voted = with_p.withColumn(
        "_draws", F.when(F.col("fcm_mass_on_letters") > 0, drawn).otherwise(blind)
    ).withColumn(
        "_votes",
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.size(F.filter("_draws", lambda d: d == i)) / F.lit(float(max(1, votes))),
        ),
    )

    def floored_entropy(values: Column) -> Column:
        return F.greatest(
            F.lit(0.0),
            -F.aggregate(
                values, F.lit(0.0), lambda acc, v: acc + v * F.ln(v + F.lit(LOG_FLOOR))
            ),
        )

    def ordered(field: str) -> Column:
        return F.sort_array(F.transform("_letters", lambda e: e.getField(field)), asc=False)

    ranked = (
        voted.withColumn("_p", F.sort_array(p, asc=False))
        .withColumn("_top", ordered("top"))
        .withColumn("_lse", ordered("lse"))
    )
    first, second = F.lit(0), F.lit(1)
    best = F.array_position(p, F.get("_p", first))
    predicted = F.get(
        "letters", F.when(F.col("fcm_mass_on_letters") > 0, best - 1).otherwise(0).cast("int")
    )
    rest = [c for c in last.columns if c not in ("logits", "gen_text", "letters")]
    return ranked.select(
        *rest,
        F.upper(predicted).alias("pred_letter"),
        "letters",
        "fcm_letter_probs",
        "fcm_mass_on_letters",
        F.coalesce(F.get("_p", first), F.lit(0.0)).alias("fcm_letter_p_top1"),
        F.coalesce(F.get("_p", second), F.lit(0.0)).alias("fcm_letter_p_top2"),
        (
            F.coalesce(F.get("_p", first), F.lit(0.0))
            - F.coalesce(F.get("_p", second), F.lit(0.0))
        ).alias("fcm_letter_margin"),
        floored_entropy(p).alias("fcm_letter_entropy"),
        F.array_max("_votes").alias("fcm_vote_top_share"),
        floored_entropy(F.col("_votes")).alias("fcm_vote_entropy"),
        F.get("_top", first).alias("fcm_letter_logit_top1"),
        F.get("_top", second).alias("fcm_letter_logit_top2"),
        (F.get("_top", first) - F.get("_top", second)).alias("fcm_letter_logit_margin"),
        F.get("_lse", first).alias("fcm_letter_lse_top1"),
        F.get("_lse", second).alias("fcm_letter_lse_top2"),
        (F.get("_lse", first) - F.get("_lse", second)).alias("fcm_letter_lse_margin"),
        F.size(F.filter("_letters", lambda e: e.getField("ids") > 0)).alias(
            "fcm_letters_with_bucket"
        ),
        (
            1.0 - F.aggregate("_raw_p", F.lit(0.0), lambda acc, v: acc + v * v)
        ).alias("fcm_letter_simpson"),
    )
