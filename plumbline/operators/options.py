"""Option table: one row per (question, letter), from records or from long readings.

A question has at most 26 letters, and `latest_per_option` merges repeated readings of a letter
with a mergeable aggregate before anything is grouped by question. So every window by question
below works on at most 26 rows, however the raw readings are distributed.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import top2_gap
from ..functions.scalars import finite, let, stripped

DEFAULT_LETTERS = ("A", "B", "C", "D")

# Output metric -> record keys (without the letter prefix), first present one wins.
METRIC_ALIASES: dict[str, tuple[str, ...]] = {
    "pmil": ("llmc_letter_ce_logpmi", "pmil"),
    "pmic": ("llmc_content_ce_logpmi", "pmic"),
    "e_letter": ("llmc_letter_ce_cond", "llmc_letter_logit_entropy_mean", "e_letter"),
    "e_content": ("llmc_content_logit_entropy_mean", "e_content"),
    "icrp_reliable": ("icrp_reliable",),
    "icrp_prompt_mass_mean": ("icrp_prompt_mass_mean", "icrp_pmass"),
    "icrp_pool_attn_cons": ("icrp_pool_attn_cons", "icrp_attn"),
    "icrp_time_delta_mean": ("icrp_time_delta_mean",),
    "icrp_layer_delta_mean": ("icrp_layer_delta_mean",),
    "icrp_interlayer_cos_mean": ("icrp_interlayer_cos_mean",),
    "icrp_temporal_cos_mean": ("icrp_temporal_cos_mean",),
    "icrp_resp_len": ("icrp_resp_len",),
}
# Columns that repeat another metric under an older name.
REPEATED_METRICS: dict[str, str] = {
    "icrp_rel": "icrp_reliable",
    "icrp_pmass": "icrp_prompt_mass_mean",
    "icrp_attn": "icrp_pool_attn_cons",
}
# Ranked metric -> True when the smallest value ranks first.
RANKED_ASCENDING: dict[str, bool] = {
    "pmil": False,
    "pmic": False,
    "e_letter": True,
    "e_content": True,
    "icrp_reliable": False,
    "fcm_prob": False,
}
SCORE_WEIGHTS = {"pmic": 0.6, "pmil": 0.4}


def latest_per_option(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep, per key, the reading that is last in `order`, as a later record entry replaces an
    earlier one. `max` merges on the map side, so a hot key leaves each task as a single row."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    last = F.max(F.struct(*order, *rest)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*df.columns)


def pivot_to_records(
    options: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("qid",)
) -> DataFrame:
    """Long options to one record per question: `metrics` is a map '<LETTER>_<metric>' -> value."""
    entries = F.array(
        *[
            F.struct(F.concat("letter", F.lit(f"_{m}")).alias("k"), F.col(m).alias("v"))
            for m in metrics
        ]
    )
    return (
        options.groupBy(*keys)
        .agg(F.flatten(F.collect_list(entries)).alias("_entries"))
        .select(*keys, F.map_from_entries("_entries").alias("metrics"))
    )


def record_letters(
    metrics: str = "metrics",
    probability_map: str = "fcm_letter_prob_map",
    probability_letters: str = "fcm_prob_letters",
) -> Column:
    """Letters of a record: metric prefixes in alphabet order, then map keys, then the list."""
    none = F.array().cast("array<string>")
    prefixed = F.array_sort(
        F.transform(
            F.filter(F.map_keys(metrics), lambda k: k.rlike("^[A-Z]_")),
            lambda k: F.substring(k, F.lit(1), F.lit(1)),
        )
    )
    upper = [
        F.transform(source, F.upper)
        for source in (F.map_keys(probability_map), F.col(probability_letters))
    ]
    found = F.array_distinct(F.concat(*[F.coalesce(a, none) for a in (prefixed, *upper)]))
    known = F.filter(found, lambda letter: letter.rlike("^[A-Z]$"))
    return let(
        known,
        lambda k: F.when(
            F.size(k) == 0, F.array(*[F.lit(letter) for letter in DEFAULT_LETTERS])
        ).otherwise(k),
    )


def letter_probability(letter: Column, position: Column) -> Column:
    """Probability of a letter: by map key, else by the aligned name list, else by position.

    A key with a NULL value and a letter absent from an aligned list do not fall through.
    """
    table, names, values = (
        F.col(c) for c in ("fcm_letter_prob_map", "fcm_prob_letters", "fcm_letter_probs")
    )
    in_map = F.coalesce(
        F.exists(F.map_keys(table), lambda k: F.upper(k) == letter), F.lit(False)
    )
    by_map = F.element_at(
        F.transform(
            F.filter(F.map_entries(table), lambda e: F.upper(e.getField("key")) == letter),
            lambda e: e.getField("value"),
        ),
        1,
    )
    aligned = F.coalesce(F.size(names) == F.size(values), F.lit(False)) & values.isNotNull()
    slot = F.array_position(F.transform(names, F.upper), letter)
    return let(
        F.when(in_map, by_map)
        .when(aligned, F.when(slot > 0, F.get(values, (slot - 1).cast("int"))))
        .otherwise(F.get(values, position)),
        finite,
    )


def _min_rank(values: Column, own: Column, ascending: bool) -> Column:
    """1 + number of better values; NULL for a NULL value."""
    better = (lambda v: v < own) if ascending else (lambda v: v > own)
    return F.when(own.isNotNull(), 1 + F.size(F.filter(values, better)))


def option_table(records: DataFrame) -> DataFrame:
    """Records to long options with metrics, ranks and the gold flag.

    Input, one record per qid: qid, dataset, gold_letter, model_pred, pred_letter, metrics (map),
    fcm_letter_probs, fcm_prob_letters, fcm_letter_prob_map. The letters are exploded before the
    metrics are looked up, because outside of lambdas the lookups are compiled. The ranks use the
    partitioning by question that the collapse needs as well, so both share one exchange.
    """
    answer = F.coalesce(F.nullif(F.col("model_pred"), F.lit("")), "pred_letter", F.lit(""))
    exploded = records.select(
        "*",
        F.upper(stripped(F.coalesce("gold_letter", F.lit("")))).alias("gold"),
        F.upper(stripped(answer)).alias("vanilla"),
        F.posexplode(record_letters()).alias("_position", "letter"),
    )
    found = {
        name: F.coalesce(
            *[F.try_element_at("metrics", F.concat("letter", F.lit(f"_{s}"))) for s in suffixes]
        )
        for name, suffixes in METRIC_ALIASES.items()
    }
    looked_up = exploded.select(
        "qid",
        "dataset",
        "letter",
        "gold",
        "vanilla",
        *[finite(value).alias(name) for name, value in found.items()],
        letter_probability(F.col("letter"), F.col("_position")).alias("fcm_prob"),
    )
    return add_ranks(looked_up).select(
        "*",
        *[F.col(source).alias(name) for name, source in REPEATED_METRICS.items()],
        gold_flag().alias("y_opt"),
    )


def require_rows(options: DataFrame) -> DataFrame:
    """Raise when an option table has no row at all."""
    if options.isEmpty():
        raise ValueError("no option rows: the record table is empty")
    return options


def gold_flag(letter: str = "letter", gold: str = "gold") -> Column:
    return (F.upper(letter) == F.upper(F.coalesce(gold, F.lit("")))).cast("int")


def add_ranks(
    options: DataFrame,
    ranked: Mapping[str, bool] | None = None,
    keys: Sequence[str] = ("qid",),
) -> DataFrame:
    """Min-rank of each metric inside the question, for options that are already long.

    The metric values of a question (at most 26) are gathered by one unordered window, which needs
    a single sort for all metrics instead of one per metric.
    """
    ranked = RANKED_ASCENDING if ranked is None else ranked
    window = Window.partitionBy(*keys)
    gathered = options.select(
        "*", *[F.collect_list(m).over(window).alias(f"_all_{m}") for m in ranked]
    )
    return gathered.select(
        *options.columns,
        *[
            _min_rank(F.col(f"_all_{m}"), F.col(m), ascending).alias(f"{m}_rank")
            for m, ascending in ranked.items()
        ],
    )


def centre(
    options: DataFrame, metrics: Mapping[str, str], keys: Sequence[str] = ("qid",)
) -> DataFrame:
    """Add, for each entry metric -> name, the value minus the question mean as `<name>_ctr` and
    the top1-top2 gap of the centred values as `<name>_gap_top1_top2`."""
    window = Window.partitionBy(*keys)
    centred = options.select(
        "*",
        *[
            (F.col(m) - F.coalesce(F.avg(m).over(window), F.lit(0.0))).alias(f"{name}_ctr")
            for m, name in metrics.items()
        ],
    )
    return centred.select(
        "*",
        *[
            top2_gap(F.collect_list(f"{name}_ctr").over(window)).alias(
                f"{name}_gap_top1_top2"
            )
            for name in metrics.values()
        ],
    )


def synthesise_probability(
    options: DataFrame, keys: Sequence[str] = ("qid",), name: str = "p_opt"
) -> DataFrame:
    """Option probability from letter probabilities, else from a softmax of the evidence score,
    else uniform. All windows share one partitioning and one sort."""
    window = Window.partitionBy(*keys)
    stats = options.select(
        "*",
        F.count("fcm_prob").over(window).alias("_fcm_n"),
        F.sum(F.coalesce("fcm_prob", F.lit(0.0))).over(window).alias("_fcm_mass"),
        F.count(F.lit(1)).over(window).alias("_n"),
        *[F.median(m).over(window).alias(f"_mid_{m}") for m in SCORE_WEIGHTS],
    )
    score = sum(
        (F.coalesce(m, f"_mid_{m}") * weight for m, weight in SCORE_WEIGHTS.items()), F.lit(0.0)
    )
    peaked = stats.withColumn("_score", score).withColumn(
        "_peak", F.max("_score").over(window)
    )
    powered = peaked.withColumn("_e", F.exp(F.col("_score") - F.col("_peak"))).withColumn(
        "_e_sum", F.sum("_e").over(window)
    )
    probability = (
        F.when(
            (F.col("_fcm_n") > 0) & (F.col("_fcm_mass") > 0),
            F.coalesce("fcm_prob", F.lit(0.0)) / F.col("_fcm_mass"),
        )
        .when(F.col("_e_sum") > 0, F.col("_e") / F.col("_e_sum"))
        .otherwise(1.0 / F.col("_n"))
    )
    return powered.select(
        *[c for c in options.columns if c != name], probability.alias(name)
    )


def renormalise(
    options: DataFrame, keys: Sequence[str] = ("qid",), name: str = "p_opt"
) -> DataFrame:
    """Scale a probability to sum one per question; a question without mass becomes NULL."""
    window = Window.partitionBy(*keys)
    value = F.coalesce(finite(F.col(name).cast("double")), F.lit(0.0))
    return (
        options.withColumn(name, value)
        .withColumn("_mass", F.sum(name).over(window))
        .withColumn(name, F.when(F.col("_mass") > 0, F.col(name) / F.col("_mass")))
        .drop("_mass")
    )


def with_probability(options: DataFrame, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """Use a supplied `p_opt` unless it is absent or NULL in the whole table; then renormalise."""
    supplied = "p_opt" in options.columns and not options.where(
        finite(F.col("p_opt").cast("double")).isNotNull()
    ).isEmpty()
    return renormalise(options if supplied else synthesise_probability(options, keys), keys)
