"""Collapse an option table to one feature row per question.

The windows of the probability step and the final aggregation share the partitioning by question:
one exchange and one sort in all. Order statistics come from the at most 26 values of a question.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import sorted_gini, top2_gap
from ..functions.scalars import finite, stripped
from .options import with_probability

# Delta feature -> (source columns in order of preference, sign).
DELTAS: dict[str, tuple[tuple[str, ...], int]] = {
    "pmil": (("pmil",), 1),
    "pmic": (("pmic",), 1),
    "icrp_rel": (("icrp_rel", "icrp_reliable"), 1),
    "e_letter": (("e_letter",), -1),
    "e_content": (("e_content",), -1),
    "fcm_prob": (("fcm_prob",), 1),
}
COVERAGE_FLOOR = 0.05


def first_present(options: DataFrame, names: Sequence[str]) -> Column:
    """The first of the named columns that the table has, as a finite double, else NULL."""
    for name in names:
        if name in options.columns:
            return finite(F.col(name).cast("double"))
    return F.lit(None).cast("double")


def collapse(
    options: DataFrame, keys: Sequence[str] = ("qid",), carry: Sequence[str] = ()
) -> DataFrame:
    """One row per question; `carry` names columns that are constant inside a question.

    Input: unique (keys, letter) with gold, vanilla and any of the metrics; a missing metric column
    reads as NULL. An `opt_ix` column fixes the option order, by default the alphabet does.
    """
    keys = list(keys)
    for needed in ("fcm_prob", "pmic", "pmil"):
        if needed not in options.columns:
            options = options.withColumn(needed, F.lit(None).cast("double"))
    order = F.col("opt_ix") if "opt_ix" in options.columns else F.ascii("letter")
    window = Window.partitionBy(*keys)
    letter = F.upper("letter")

    sources = {name: first_present(options, columns) for name, (columns, _) in DELTAS.items()}
    rows = with_probability(options, keys).select(
        *keys,
        *carry,
        letter.alias("letter"),
        order.alias("_ix"),
        "gold",
        "vanilla",
        F.col("p_opt").alias("_p"),
        *[source.alias(f"_m_{name}") for name, source in sources.items()],
    )
    is_chosen = F.col("letter") == F.upper(stripped(F.coalesce("vanilla", F.lit(""))))
    ranked = {"p": "_p", "pmic": "_m_pmic", "pmil": "_m_pmil"}
    rows = rows.withColumn("_chosen", F.coalesce(is_chosen, F.lit(False))).select(
        "*",
        *[
            F.max(F.when(F.col("_chosen"), F.col(c))).over(window).alias(f"_own_{name}")
            for name, c in ranked.items()
        ],
        F.sum("_m_fcm_prob").over(window).alias("_fcm_mass"),
    )

    def rank_of_chosen(name: str) -> Column:
        own = F.first(f"_own_{name}")
        better = F.count_if(F.col(ranked[name]) > F.col(f"_own_{name}"))
        return F.when(own.isNotNull(), (1 + better).cast("double"))

    def entropy(value: Column) -> Column:
        return -F.sum(F.when(value > 0, value * F.ln(value)).otherwise(F.when(value == 0, 0.0)))

    def delta(name: str, sign: int) -> Column:
        value = F.col(f"_m_{name}")
        gap = F.max(F.when(F.col("_chosen"), value)) - F.max(
            F.when(~F.col("_chosen"), value)
        )
        return gap if sign > 0 else -gap

    fcm = F.col("_m_fcm_prob")
    clean = lambda c: F.upper(stripped(F.coalesce(c, F.lit(""))))
    grouped = rows.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carry],
        clean(F.min_by("gold", "_ix")).alias("gold"),
        clean(F.min_by("vanilla", "_ix")).alias("chosen"),
        F.max(F.when(F.col("_chosen"), F.col("_p"))).alias("p_opt_chosen"),
        F.sort_array(F.collect_list("_p"), asc=False).alias("_ps"),
        rank_of_chosen("p").alias("p_opt_rank_chosen"),
        F.max_by("letter", F.struct("_p", -F.col("_ix"))).alias("opt_top_letter"),
        *[
            delta(name, sign).alias(f"delta_{name}_chosen_vs_othermax")
            for name, (_, sign) in DELTAS.items()
        ],
        entropy(F.col("_p")).alias("p_opt_entropy"),
        top2_gap(F.collect_list("_m_pmic")).alias("pmic_gap_top1_top2"),
        top2_gap(F.collect_list("_m_pmil")).alias("pmil_gap_top1_top2"),
        rank_of_chosen("pmic").alias("pmic_rank_chosen"),
        rank_of_chosen("pmil").alias("pmil_rank_chosen"),
        F.when(
            F.max("_fcm_mass") > 0, entropy(F.try_divide(fcm, "_fcm_mass"))
        ).alias("fcm_entropy"),
        sorted_gini(F.collect_list(fcm)).alias("fcm_gini"),
        F.when(
            F.count(fcm) > 0, F.count_if(fcm > COVERAGE_FLOOR).cast("double")
        ).alias("fcm_letters_coverage"),
        (F.sum(fcm) - F.max(fcm)).alias("fcm_mass_gap"),
        F.coalesce(
            F.max_by(
                "letter", F.when(fcm.isNotNull(), F.struct(fcm, F.col("_p"), -F.col("_ix")))
            ),
            F.lit(""),
        ).alias("fcm_top_letter"),
    )
    top, second = F.get("_ps", F.lit(0)), F.get("_ps", F.lit(1))
    ordered = [
        *keys, *carry, "gold", "chosen", "p_opt_chosen", "p_opt_top", "p_opt_second",
        "p_opt_gap", "p_opt_rank_chosen", "opt_top_letter",
        *[f"delta_{name}_chosen_vs_othermax" for name in DELTAS],
        "p_opt_entropy", "p_opt_gini", "pmic_gap_top1_top2", "pmil_gap_top1_top2",
        "pmic_rank_chosen", "pmil_rank_chosen", "fcm_entropy", "fcm_gini",
        "fcm_letters_coverage", "fcm_mass_gap", "fcm_top_letter",
    ]
    return (
        grouped.withColumn("p_opt_top", top)
        .withColumn("p_opt_second", second)
        .withColumn("p_opt_gap", top - second)
        .withColumn("p_opt_gini", sorted_gini("_ps"))
        .select(*ordered)
    )
