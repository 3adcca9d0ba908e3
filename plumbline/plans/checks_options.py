"""Registered queries of the option table and of the collapse, each with its SQL text."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import to_number
from ..operators import options as opt
from ..operators.collapse import collapse
from . import fixtures
from .fixture_sql import COLLAPSED, OPTIONS, SYNTHESISED
from .rounding import q6, q6s, r6, r6s

DELTA_COLUMNS = [
    f"delta_{m}_chosen_vs_othermax"
    for m in ("pmil", "pmic", "icrp_rel", "e_letter", "e_content", "fcm_prob")
]


def option_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = opt.add_ranks(fixtures.options(spark, sf_dir)).withColumn("y_opt", opt.gold_flag())
    return ranked.select("qid", "letter", "y_opt", *[f"{m}_rank" for m in opt.RANKED_ASCENDING])


def _rank_sql(metric: str) -> str:
    order = "" if opt.RANKED_ASCENDING[metric] else "DESC"
    return (
        f"CASE WHEN {metric} IS NOT NULL THEN CAST(rank() OVER (PARTITION BY qid ORDER BY "
        f"{metric} {order} NULLS LAST) AS INT) END AS {metric}_rank"
    )


def option_from_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = opt.option_table(fixtures.records(spark, sf_dir))
    return table.select(
        "qid", "dataset", "letter", "gold", "vanilla", "y_opt",
        *r6s("pmil", "pmic", "e_letter", "e_content", "icrp_rel", "fcm_prob"),
        "pmil_rank", "e_letter_rank", "fcm_prob_rank",
    )


RECORD_SQL = f"""WITH {OPTIONS},
k AS (SELECT *, CAST(qid AS BIGINT) AS q, row_number() OVER (PARTITION BY qid ORDER BY letter) AS a
  FROM opt),
long AS (SELECT qid, dataset, letter, coalesce(gold, '') AS gold, vanilla,
  coalesce(pmil, pmic) AS pmil, pmic, coalesce(e_letter, e_content) AS e_letter,
  CASE WHEN e_content > 1.5 THEN NULL ELSE e_content END AS e_content, icrp_reliable AS icrp_rel,
  fcm_prob FROM k)
SELECT qid, dataset, letter, gold, vanilla,
  CAST(CASE WHEN letter = gold THEN 1 ELSE 0 END AS INT) AS y_opt,
  {q6s("pmil", "pmic", "e_letter", "e_content", "icrp_rel", "fcm_prob")},
  {_rank_sql("pmil")}, {_rank_sql("e_letter")}, {_rank_sql("fcm_prob")}
FROM long"""


def option_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter order of a record: metric prefixes first, then further names of the list."""
    records = fixtures.records(spark, sf_dir).withColumn(
        "fcm_prob_letters", F.array(F.lit("z"), F.lit("?"), F.lit("A"))
    )
    key = F.col("qid").cast("bigint")
    empty = F.create_map().cast("map<string,double>")
    records = records.withColumn(
        "metrics", F.when(key % 4 == 0, empty).otherwise(F.col("metrics"))
    ).withColumn(
        "fcm_prob_letters",
        F.when(key % 8 == 0, F.lit(None)).otherwise(F.col("fcm_prob_letters")),
    ).withColumn("fcm_letter_prob_map", F.lit(None).cast("map<string,double>"))
    return records.select("qid", F.array_join(opt.record_letters(), "").alias("letters"))


LETTERS_SQL = f"""WITH {OPTIONS},
g AS (SELECT qid, CAST(qid AS BIGINT) AS q, string_agg(letter, '' ORDER BY letter) AS s,
  max(CASE WHEN letter = 'A' THEN 1 ELSE 0 END) AS has_a,
  max(CASE WHEN letter = 'Z' THEN 1 ELSE 0 END) AS has_z FROM opt GROUP BY qid)
SELECT qid, CASE WHEN q % 8 = 0 THEN 'ABCD' WHEN q % 4 = 0 THEN 'ZA'
  ELSE s || CASE WHEN has_z = 1 THEN '' ELSE 'Z' END
    || CASE WHEN has_a = 1 THEN '' ELSE 'A' END END AS letters
FROM g"""


def option_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = opt.pivot_to_records(fixtures.options(spark, sf_dir), ["pmic", "e_content"])
    return records.select(
        "qid",
        F.size("metrics").alias("n_keys"),
        *[
            r6(F.try_element_at("metrics", F.lit(f"{letter}_{m}"))).alias(f"{letter}_{m}")
            for letter in "ABH"
            for m in ("pmic", "e_content")
        ],
    )


PIVOT_SQL = f"""WITH {OPTIONS} SELECT qid, CAST(count(*) * 2 AS INT) AS n_keys, """ + ", ".join(
    q6(f"max({m}) FILTER (letter = '{letter}')", f"{letter}_{m}")
    for letter in "ABH"
    for m in ("pmic", "e_content")
) + " FROM opt GROUP BY qid"


def option_centre_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    centred = opt.centre(
        fixtures.options(spark, sf_dir),
        {"pmic": "llmc_content_ce_logpmi", "pmil": "llmc_letter_ce_logpmi"},
    )
    return centred.select(
        "qid",
        "letter",
        *r6s(
            "llmc_content_ce_logpmi_ctr", "llmc_letter_ce_logpmi_ctr",
            "llmc_content_ce_logpmi_gap_top1_top2", "llmc_letter_ce_logpmi_gap_top1_top2",
        ),
    )


def _centre_sql(metric: str, name: str) -> str:
    c = f"c_{metric}"
    return (
        q6(c, f"{name}_ctr")
        + ", "
        + q6(
            f"CASE WHEN count({c}) OVER w = 1 THEN max({c}) OVER w ELSE "
            f"max(CASE WHEN r_{metric} = 1 THEN {c} END) OVER w - "
            f"max(CASE WHEN r_{metric} = 2 THEN {c} END) OVER w END",
            f"{name}_gap_top1_top2",
        )
    )


CENTRE_SQL = f"""WITH {OPTIONS}, c AS (SELECT qid, letter,
  pmic - avg(pmic) OVER (PARTITION BY qid) AS c_pmic,
  pmil - avg(pmil) OVER (PARTITION BY qid) AS c_pmil,
  row_number() OVER (PARTITION BY qid ORDER BY pmic DESC NULLS LAST, letter) AS r_pmic,
  row_number() OVER (PARTITION BY qid ORDER BY pmil DESC NULLS LAST, letter) AS r_pmil FROM opt)
SELECT qid, letter, {_centre_sql("pmic", "llmc_content_ce_logpmi")},
  {_centre_sql("pmil", "llmc_letter_ce_logpmi")}
FROM c WINDOW w AS (PARTITION BY qid)"""


def option_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = opt.synthesise_probability(fixtures.options(spark, sf_dir))
    return table.select("qid", "letter", *r6s("p_opt"))


def option_renormalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplied probability with NULLs and questions without mass."""
    table = opt.with_probability(
        fixtures.options(spark, sf_dir).withColumn("p_opt", F.col("fcm_prob") * 2.0)
    )
    return table.select("qid", "letter", *r6s("p_opt"))


RENORM_SQL = f"""WITH {OPTIONS}, s AS (SELECT qid, letter, coalesce(fcm_prob * 2e0, 0e0) AS v,
  sum(coalesce(fcm_prob * 2e0, 0e0)) OVER (PARTITION BY qid) AS t FROM opt)
SELECT qid, letter, {q6("CASE WHEN t > 0 THEN v / t END", "p_opt")} FROM s"""


def option_finite_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers arriving as text, among them NaN, infinities and words."""
    rows = fixtures.options(spark, sf_dir)
    code = F.col("qid").cast("bigint") % 7
    text = (
        F.when(code == 0, "NaN")
        .when(code == 1, "Infinity")
        .when(code == 2, "-Infinity")
        .when(code == 3, "n/a")
        .otherwise(F.col("qid"))
    )
    return rows.select("qid", "letter", to_number(text).alias("value"))


FINITE_SQL = f"""WITH {OPTIONS} SELECT qid, letter,
  CASE WHEN CAST(qid AS BIGINT) % 7 > 3 THEN CAST(qid AS DOUBLE) END AS value FROM opt"""


def _collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(fixtures.options(spark, sf_dir), carry=("dataset",))


TOP = ["p_opt_top", "p_opt_second", "p_opt_gap", "p_opt_chosen", "p_opt_rank_chosen"]
SHAPE = ["p_opt_entropy", "p_opt_gini", "pmic_gap_top1_top2", "pmil_gap_top1_top2",
         "pmic_rank_chosen", "pmil_rank_chosen"]
FCM = ["fcm_entropy", "fcm_gini", "fcm_letters_coverage", "fcm_mass_gap"]


def collapse_top_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collapsed(spark, sf_dir).select("qid", "gold", "chosen", "opt_top_letter", *r6s(*TOP))


def collapse_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collapsed(spark, sf_dir).select("qid", *r6s(*DELTA_COLUMNS))


def collapse_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collapsed(spark, sf_dir).select("qid", *r6s(*SHAPE))


def collapse_fcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collapsed(spark, sf_dir).select("qid", "fcm_top_letter", *r6s(*FCM))


def collapse_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collapsed(spark, sf_dir).select(
        "qid", "dataset", "gold", "chosen", "opt_top_letter", "fcm_top_letter",
        *r6s(*TOP, *DELTA_COLUMNS, *SHAPE, *FCM),
    )


def collapse_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only pmic and an alias column are present: the others read as NULL."""
    rows = fixtures.options(spark, sf_dir).select("qid", "letter", "gold", "vanilla", "pmic",
                                                  "icrp_reliable")
    return collapse(rows).select(
        "qid", *r6s("pmic_gap_top1_top2", "delta_icrp_rel_chosen_vs_othermax",
                    "delta_e_letter_chosen_vs_othermax", "pmil_gap_top1_top2"))


QUERIES = {
    f.__name__: f
    for f in (
        option_ranks, option_from_records, option_letters, option_pivot, option_centre_gap,
        option_probability, option_renormalise, option_finite_cast, collapse_top_gap,
        collapse_deltas, collapse_shape, collapse_fcm, collapse_full, collapse_missing_columns,
    )
}

ORACLES = {
    "option_ranks": f"WITH {OPTIONS} SELECT qid, letter, CAST(CASE WHEN letter = coalesce(gold, '')"
    " THEN 1 ELSE 0 END AS INT) AS y_opt, "
    + ", ".join(_rank_sql(m) for m in opt.RANKED_ASCENDING)
    + " FROM opt",
    "option_from_records": RECORD_SQL,
    "option_letters": LETTERS_SQL,
    "option_pivot": PIVOT_SQL,
    "option_centre_gap": CENTRE_SQL,
    "option_probability": f"WITH {SYNTHESISED} SELECT qid, letter, {q6('p0', 'p_opt')} FROM syn",
    "option_renormalise": RENORM_SQL,
    "option_finite_cast": FINITE_SQL,
    "collapse_top_gap": f"WITH {COLLAPSED} SELECT qid, gold, chosen, opt_top_letter, "
    f"{q6s(*TOP)} FROM col",
    "collapse_deltas": f"WITH {COLLAPSED} SELECT qid, {q6s(*DELTA_COLUMNS)} FROM col",
    "collapse_shape": f"WITH {COLLAPSED} SELECT qid, {q6s(*SHAPE)} FROM col",
    "collapse_fcm": f"WITH {COLLAPSED} SELECT qid, fcm_top_letter, {q6s(*FCM)} FROM col",
    "collapse_full": f"WITH {COLLAPSED} SELECT qid, dataset, gold, chosen, opt_top_letter, "
    f"fcm_top_letter, {q6s(*TOP, *DELTA_COLUMNS, *SHAPE, *FCM)} FROM col",
    "collapse_missing_columns": f"WITH {COLLAPSED} SELECT qid, "
    + q6s("pmic_gap_top1_top2", "delta_icrp_rel_chosen_vs_othermax")
    + ", CAST(NULL AS DOUBLE) AS delta_e_letter_chosen_vs_othermax, "
    "CAST(NULL AS DOUBLE) AS pmil_gap_top1_top2 FROM col",
}
