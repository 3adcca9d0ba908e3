"""From recorded traces to one record per question: the link between evidence and option table."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import prediction_error
from .mcq import explode_options
from .options import centre, latest_per_option
from .trace import LENGTHS, letter_evidence, option_evidence
from .vectors import sequence_features, step_series

# Metrics of an option that a record keeps under `<letter>_<metric>`.
CENTRED = {
    "llmc_content_ce_logpmi": "llmc_content_ce_logpmi",
    "llmc_letter_ce_logpmi": "llmc_letter_ce_logpmi",
}


def question_records(
    mcq: DataFrame,
    trace: DataFrame,
    last: DataFrame,
    buckets: Mapping[str, Sequence[int]],
    states: DataFrame | None = None,
    attention: DataFrame | None = None,
    keys: Sequence[str] = ("qid",),
) -> DataFrame:
    """Records for `option_table`, one per question.

    mcq(keys, dataset, gold_letter, options), trace(keys, letter, role, step, logits, target_id,
    resp_len, prefix_len: response steps of both passes), last(keys, letters, logits[, gen_text]),
    states(keys, letter, step, layer, vec), attention(keys, letter, step, weights, prompt_len).
    Letter and content evidence, vector dynamics and centred PMI are joined by (keys, letter), the
    letter distribution by the question. Readings of an option are merged first, so a question is a
    group of at most 26 rows. What was not recorded is absent from the record's map.
    """
    keys = list(keys)
    on = [*keys, "letter"]
    rest = ["dataset", "gold_letter"]
    options = latest_per_option(explode_options(mcq).select(*on, *rest, "pos"), on, ["pos"])
    joined = options
    for view, span in (("letter", "first"), ("content", "all")):
        evidence = option_evidence(trace, view, span, on)
        joined = joined.join(evidence.drop(*set(evidence.columns) & set(LENGTHS) & set(joined.columns)), on, "left")
    if states is not None:
        vectors = sequence_features(step_series(states, attention, keys=on), on)
        joined = joined.join(vectors.drop("icrp_pool_vec"), on, "left")
    centred = centre(joined, CENTRED, keys)
    gaps = [f"{name}_gap_top1_top2" for name in CENTRED.values()]
    metrics = [c for c in centred.columns if c not in (*on, *rest, "pos", *gaps)]
    entries = F.filter(
        F.array(
            *[
                F.struct(
                    F.concat("letter", F.lit(f"_{m}")).alias("key"),
                    F.col(m).cast("double").alias("value"),
                )
                for m in metrics
            ]
        ),
        lambda e: e.getField("value").isNotNull(),
    )
    grouped = centred.withColumn("_entries", entries).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in rest],
        F.map_from_entries(F.flatten(F.collect_list("_entries"))).alias("metrics"),
        *[F.first(g).alias(g) for g in gaps],
    )
    distribution = letter_evidence(last, buckets).withColumnRenamed("letters", "fcm_prob_letters")
    record = grouped.join(distribution, keys, "left")
    found = F.array_compact(
        F.zip_with(
            "fcm_prob_letters",
            "fcm_letter_probs",
            lambda letter, p: F.when(p.isNotNull(), F.struct(letter.alias("key"), p.alias("value"))),
        )
    )
    predicted = F.coalesce("pred_letter", F.lit(""))
    return record.withColumns(
        {
            "model_pred": predicted,
            "fcm_letter_prob_map": F.map_from_entries(found),
            "is_hallucination": prediction_error(predicted, "gold_letter"),
        }
    )
