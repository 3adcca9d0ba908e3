"""The fixture views once more, as SQL text for the comparison engine."""
from __future__ import annotations

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"

LINES = """lines AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, ix ORDER BY l_partkey DESC,
      l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS rn
    FROM (SELECT *, CAST((l_linenumber - 1) + 7 * (l_partkey % 3) AS INT) AS ix FROM lineitem))
  WHERE rn = 1)"""

OPTIONS = (
    LINES
    + f""", opt AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS qid,
    CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset,
    substr({AZ}, ix + 1, 1) AS letter, ix,
    CASE WHEN l_orderkey % 41 = 0 THEN 'Y' ELSE substr({AZ}, first_value(ix) OVER (
      PARTITION BY l_orderkey ORDER BY (l_partkey * 31 + l_suppkey * 17) % 101 DESC, ix DESC) + 1,
      1) END AS vanilla,
    CASE WHEN l_orderkey % 53 = 0 THEN NULL WHEN l_orderkey % 9 = 0 THEN 'Z'
      ELSE substr({AZ}, first_value(ix) OVER (PARTITION BY l_orderkey
        ORDER BY (l_partkey * 13 + l_suppkey * 7 + l_orderkey) % 103 DESC, ix DESC) + 1, 1)
      END AS gold,
    CASE WHEN l_orderkey % 5 = 0 OR l_partkey % 13 = 0 THEN CAST(NULL AS DOUBLE)
      WHEN l_orderkey % 17 = 3 THEN 0e0 ELSE l_quantity / 5e1 END AS fcm_prob,
    CASE WHEN l_partkey % 11 = 0 THEN CAST(NULL AS DOUBLE)
      ELSE l_extendedprice / 1e5 - 5e-1 END AS pmic,
    CASE WHEN l_orderkey % 10 = 0 THEN CAST(NULL AS DOUBLE) ELSE l_tax * 1e1 - 4e-1 END AS pmil,
    CASE WHEN l_suppkey % 7 = 0 THEN CAST(NULL AS DOUBLE) ELSE l_discount * 2e1 END AS e_letter,
    l_extendedprice / (l_quantity * 1e3) AS e_content,
    CASE WHEN l_quantity >= 2.5e1 THEN 1e0 ELSE 0e0 END AS icrp_reliable
  FROM lines)"""
)

SYNTHESISED = (
    OPTIONS
    + """, m AS (
  SELECT *, count(fcm_prob) OVER w AS fn, sum(coalesce(fcm_prob, 0e0)) OVER w AS fs,
    median(pmic) OVER w AS mc, median(pmil) OVER w AS ml, count(*) OVER w AS n
  FROM opt WINDOW w AS (PARTITION BY qid)),
sc AS (SELECT *, 6e-1 * coalesce(pmic, mc) + 4e-1 * coalesce(pmil, ml) AS s FROM m),
ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY qid)) AS e FROM sc),
syn AS (
  SELECT *, CASE WHEN fn > 0 AND fs > 0 THEN coalesce(fcm_prob, 0e0) / fs
    WHEN sum(e) OVER (PARTITION BY qid) > 0 THEN e / sum(e) OVER (PARTITION BY qid)
    ELSE 1e0 / n END AS p0
  FROM ex)"""
)

POPT = (
    SYNTHESISED
    + """, po AS (
  SELECT *, CASE WHEN sum(p0) OVER (PARTITION BY qid) > 0
    THEN p0 / sum(p0) OVER (PARTITION BY qid) END AS p,
    coalesce(letter = upper(trim(vanilla)), FALSE) AS is_chosen
  FROM syn)"""
)

COLLAPSED = (
    POPT
    + """, rk AS (
  SELECT *,
    row_number() OVER (PARTITION BY qid ORDER BY p DESC NULLS LAST, ix) AS rn,
    rank() OVER (PARTITION BY qid ORDER BY p DESC NULLS LAST) AS p_rank,
    row_number() OVER (PARTITION BY qid, p IS NULL ORDER BY p, ix) AS asc_p,
    count(p) OVER (PARTITION BY qid) AS n_p, sum(p) OVER (PARTITION BY qid) AS s_p,
    rank() OVER (PARTITION BY qid ORDER BY pmic DESC NULLS LAST) AS pmic_r,
    rank() OVER (PARTITION BY qid ORDER BY pmil DESC NULLS LAST) AS pmil_r,
    row_number() OVER (PARTITION BY qid ORDER BY pmic DESC NULLS LAST, ix) AS pmic_o,
    row_number() OVER (PARTITION BY qid ORDER BY pmil DESC NULLS LAST, ix) AS pmil_o,
    row_number() OVER (PARTITION BY qid, fcm_prob IS NULL ORDER BY fcm_prob, ix) AS asc_f,
    row_number() OVER (PARTITION BY qid ORDER BY fcm_prob DESC NULLS LAST, p DESC NULLS LAST, ix)
      AS f_o,
    sum(fcm_prob) OVER (PARTITION BY qid) AS s_f
  FROM po),
col AS (
  SELECT qid, any_value(dataset) AS dataset,
    upper(trim(coalesce(max(gold), ''))) AS gold,
    upper(trim(coalesce(max(vanilla), ''))) AS chosen,
    max(p) FILTER (is_chosen) AS p_opt_chosen,
    max(p) FILTER (rn = 1) AS p_opt_top, max(p) FILTER (rn = 2) AS p_opt_second,
    max(p) FILTER (rn = 1) - max(p) FILTER (rn = 2) AS p_opt_gap,
    CAST(max(p_rank) FILTER (is_chosen AND p IS NOT NULL) AS DOUBLE) AS p_opt_rank_chosen,
    max(letter) FILTER (rn = 1) AS opt_top_letter,
    max(pmil) FILTER (is_chosen) - max(pmil) FILTER (NOT is_chosen)
      AS delta_pmil_chosen_vs_othermax,
    max(pmic) FILTER (is_chosen) - max(pmic) FILTER (NOT is_chosen)
      AS delta_pmic_chosen_vs_othermax,
    max(icrp_reliable) FILTER (is_chosen) - max(icrp_reliable) FILTER (NOT is_chosen)
      AS delta_icrp_rel_chosen_vs_othermax,
    max(e_letter) FILTER (NOT is_chosen) - max(e_letter) FILTER (is_chosen)
      AS delta_e_letter_chosen_vs_othermax,
    max(e_content) FILTER (NOT is_chosen) - max(e_content) FILTER (is_chosen)
      AS delta_e_content_chosen_vs_othermax,
    max(fcm_prob) FILTER (is_chosen) - max(fcm_prob) FILTER (NOT is_chosen)
      AS delta_fcm_prob_chosen_vs_othermax,
    -sum(CASE WHEN p > 0 THEN p * ln(p) WHEN p = 0 THEN 0e0 END) AS p_opt_entropy,
    (2e0 * sum(asc_p * p) FILTER (p IS NOT NULL) / any_value(s_p) - (any_value(n_p) + 1))
      / any_value(n_p) AS p_opt_gini,
    CASE WHEN count(pmic) > 1 THEN max(pmic) FILTER (pmic_o = 1) - max(pmic) FILTER (pmic_o = 2)
      ELSE max(pmic) END AS pmic_gap_top1_top2,
    CASE WHEN count(pmil) > 1 THEN max(pmil) FILTER (pmil_o = 1) - max(pmil) FILTER (pmil_o = 2)
      ELSE max(pmil) END AS pmil_gap_top1_top2,
    CAST(max(pmic_r) FILTER (is_chosen AND pmic IS NOT NULL) AS DOUBLE) AS pmic_rank_chosen,
    CAST(max(pmil_r) FILTER (is_chosen AND pmil IS NOT NULL) AS DOUBLE) AS pmil_rank_chosen,
    CASE WHEN any_value(s_f) > 0 THEN -sum(CASE WHEN fcm_prob > 0
      THEN fcm_prob / s_f * ln(fcm_prob / s_f) WHEN fcm_prob = 0 THEN 0e0 END) END AS fcm_entropy,
    CASE WHEN any_value(s_f) > 0 THEN (2e0 * sum(asc_f * fcm_prob / s_f)
      FILTER (fcm_prob IS NOT NULL) - (count(fcm_prob) + 1)) / count(fcm_prob) END AS fcm_gini,
    CASE WHEN count(fcm_prob) > 0 THEN CAST(count(*) FILTER (fcm_prob > 5e-2) AS DOUBLE) END
      AS fcm_letters_coverage,
    sum(fcm_prob) - max(fcm_prob) AS fcm_mass_gap,
    coalesce(max(letter) FILTER (f_o = 1 AND fcm_prob IS NOT NULL), '') AS fcm_top_letter
  FROM rk GROUP BY qid)"""
)

SCORED = """sc AS (
  SELECT event_id AS row_id, CASE WHEN event_id % 10 < 7 THEN 'calib' ELSE 'test' END AS split,
    CAST(CASE WHEN (event_id * 7919) % 1000 < floor(1e3 * (value / (value + 5e1))) THEN 1 ELSE 0
      END AS INT) AS y,
    CASE WHEN event_id % 499 = 0 THEN 1e0 ELSE round(1e2 * (value / (value + 5e1))) / 1e2 END
      AS p_err,
    CASE WHEN event_id % 97 = 0 THEN CAST(NULL AS DOUBLE) ELSE 5e1 / (value + 5e1) END
      AS p_opt_chosen,
    value / 1e2 AS p_opt_gap
  FROM events)"""

TEXTS = (
    LINES
    + """, texts AS (
  SELECT l_orderkey, ix, p_name AS text FROM lines JOIN part ON l_partkey = p_partkey),
mcq0 AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ix) - 1 AS pos,
    count(*) OVER (PARTITION BY l_orderkey) AS n,
    CAST(l_orderkey AS VARCHAR) AS qid FROM texts)"""
)


def logits(scale: str = "8e0") -> str:
    """embedding elements as doubles: (vec_id, i, v), i from 0."""
    return (
        "el AS (SELECT vec_id, CAST(i - 1 AS INT) AS i, CAST(embedding[i] AS DOUBLE) * "
        f"{scale} AS v FROM embeddings, range(1, 65) r(i))"
    )
