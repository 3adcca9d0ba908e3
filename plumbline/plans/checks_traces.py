"""Registered queries over recorded logits and vectors, each with its SQL text."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..operators import trace as tr
from ..operators import vectors as vec
from ..operators.collapse import collapse
from ..operators.options import option_table
from ..operators.question import question_records
from ..session import checkpointed
from . import fixtures
from .fixture_sql import AZ, logits
from .rounding import q6, q6s, r6, r6s

LETTER_IDS = {"A": 0, "B": 5, "C": 9, "D": 13, "E": 99}  # E lies outside the 64-wide vectors
BUCKETS = {"A": [0, 4, 8], "B": [1, 5], "C": [2, 6, 10, 14], "E": [3]}  # D has no token
QUESTION_LETTERS = ("A", "B", "C", "D", "E")

EL = logits()
# Trace with one broken element in some rows.
LAST = f"""{EL}, lt AS (SELECT vec_id, CAST(floor(vec_id / 8e0) AS BIGINT) AS q,
  CAST(CAST(floor(vec_id / 8e0) AS BIGINT) AS VARCHAR) AS qid, CAST(vec_id % 8 AS INT) AS step,
  CAST(vec_id * 7 % 64 AS INT) AS target_id, i,
  CASE WHEN i = 0 AND vec_id % 29 = 7 THEN CAST('nan' AS DOUBLE)
    WHEN i = 0 AND vec_id % 31 = 5 THEN CAST('-inf' AS DOUBLE) ELSE v END AS v FROM el)"""
PLAIN = f"""{EL}, pk AS (SELECT vec_id, max(v) AS m FROM el GROUP BY vec_id),
zs AS (SELECT vec_id, any_value(m) AS m, sum(exp(v - m)) AS z FROM el JOIN pk USING (vec_id)
  GROUP BY vec_id),
sp AS (SELECT el.vec_id, i, v, exp(v - m) / z AS p, v - m - ln(z) AS lp, m, z
  FROM el JOIN zs USING (vec_id)),
od AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS r FROM sp)"""


def _plain_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "embeddings").select(
        "vec_id",
        ((F.col("vec_id") * 7) % 64).cast("int").alias("target_id"),
        fixtures.scaled_logits().alias("logits"),
    )


def trace_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.arrays_zip(
        ar.softmax("logits").alias("p"), ar.log_softmax("logits").alias("lp")
    )
    rows = _plain_trace(spark, sf_dir).select("vec_id", F.posexplode(both).alias("i", "e"))
    return rows.select("vec_id", "i", r6("e.p").alias("p"), r6("e.lp").alias("lp"))


def trace_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tr.step_statistics(_plain_trace(spark, sf_dir))
    return rows.select("vec_id", *r6s("entropy", "margin", "maxprob", "logprob"))


STEPS_SQL = f"""WITH {PLAIN} SELECT vec_id, {q6("-sum(p * lp)", "entropy")},
  {q6("max(v) FILTER (r = 1) - max(v) FILTER (r = 2)", "margin")}, {q6("max(p)", "maxprob")},
  {q6("max(lp) FILTER (i = vec_id * 7 % 64)", "logprob")} FROM od GROUP BY vec_id"""


def trace_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = tr.step_statistics(_plain_trace(spark, sf_dir)).withColumn(
        "qid", F.floor(F.col("vec_id") / 8)
    )
    table = tr.aggregate_values(steps, "entropy", ("mean", "min", "max", "std", "mode"), ["qid"])
    return table.select("qid", *r6s("mean", "min", "max", "std"))


AGGREGATE_SQL = f"""WITH {PLAIN}, e AS (SELECT vec_id, -sum(p * lp) AS h FROM od GROUP BY vec_id)
SELECT CAST(floor(vec_id / 8e0) AS BIGINT) AS qid, {q6("avg(h)", "mean")}, {q6("min(h)", "min")},
  {q6("max(h)", "max")}, {q6("stddev_pop(h)", "std")} FROM e GROUP BY ALL"""


def trace_mean_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets stop before the logits do, so only the common steps count."""
    rows = fixtures.last_step_trace(spark, sf_dir)
    target = F.when(F.col("step") < 1 + F.col("q") % 7, F.col("target_id"))
    nll = tr.mean_nll(rows.withColumn("target_id", target))
    return nll.select("qid", *r6s("nll"))


NLL_SQL = f"""WITH {LAST}, st AS (SELECT qid, q, step, max(v) AS m,
    max(CASE WHEN isnan(v) THEN 1 ELSE 0 END) AS broken FROM lt GROUP BY qid, q, step),
lp AS (SELECT st.qid, st.q, st.step, CASE WHEN max(broken) = 1 THEN CAST('nan' AS DOUBLE) ELSE
    max(CASE WHEN i = target_id THEN v END) - any_value(m)
    - ln(sum(CASE WHEN broken = 1 THEN 1e0 ELSE exp(v - m) END)) END AS lp
  FROM lt JOIN st USING (qid, q, step) GROUP BY st.qid, st.q, st.step),
n AS (SELECT qid, -avg(lp) AS nll FROM lp WHERE step < 1 + q % 7 GROUP BY qid)
SELECT qid, {q6("CASE WHEN NOT isnan(nll) AND NOT isinf(nll) THEN nll END", "nll")} FROM n"""


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One example per question of the trace, and as many again without any step."""
    ids = fixtures.last_step_trace(spark, sf_dir).where(F.col("step") == 0).select("q")
    both = ids.unionByName(ids.select((F.col("q") + 1000000).alias("q")))
    return both.select(
        F.col("q").cast("string").alias("qid"),
        F.lit("toy").alias("dataset"),
        F.when(F.col("q") % 6 == 0, F.lit(None).cast("string"))
        .otherwise(F.lower(fixtures.letter_at(F.col("q") % 4)))
        .alias("gold_letter"),
    )


def trace_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tr.feature_rows(
        _examples(spark, sf_dir), fixtures.last_step_trace(spark, sf_dir), LETTER_IDS
    )
    return rows.select(
        "qid", "dataset", "T", "V", "pred_letter", "is_error",
        *r6s("ent_mean", "ent_std", "margin_mean", "maxprob_mean", "last_entropy", "last_maxprob",
             *[f"p_{letter}" for letter in LETTER_IDS]),
    )


_P = ", ".join(
    f"max(CASE WHEN step = 7 AND ok = 1 AND i = {i} THEN p END) AS p_{letter}"
    for letter, i in LETTER_IDS.items()
)
FEATURES_SQL = f"""WITH {LAST}, st AS (SELECT qid, step, max(v) AS m,
    min(CASE WHEN isnan(v) OR isinf(v) THEN 0 ELSE 1 END) AS ok,
    max(CASE WHEN isnan(v) THEN 1 ELSE 0 END) AS bad FROM lt GROUP BY qid, step),
zz AS (SELECT qid, step, any_value(m) AS m, any_value(ok) AS ok, any_value(bad) AS bad,
  sum(CASE WHEN bad = 1 THEN 1e0 ELSE exp(v - m) END) AS z FROM lt JOIN st USING (qid, step)
  GROUP BY qid, step),
pr AS (SELECT lt.*, ok, bad, CASE WHEN bad = 0 THEN exp(v - m) / z END AS p,
  row_number() OVER (PARTITION BY lt.qid, lt.step ORDER BY v DESC, i) AS r
  FROM lt JOIN zz ON lt.qid = zz.qid AND lt.step = zz.step),
h AS (SELECT qid, step, any_value(ok) AS ok,
  CASE WHEN any_value(ok) = 1 THEN -sum(CASE WHEN p > 0 THEN p * ln(p) END) END AS ent,
  CASE WHEN any_value(bad) = 0 THEN max(CASE WHEN r = 1 THEN v END)
    - max(CASE WHEN r = 2 THEN v END) END AS mar,
  max(p) AS mp FROM pr GROUP BY qid, step),
ag AS (SELECT qid, CAST(count(*) AS INT) AS T, avg(ent) AS ent_mean, stddev_pop(ent) AS ent_std,
  avg(mar) AS margin_mean, avg(mp) AS maxprob_mean, max(step) AS ls FROM h GROUP BY qid),
la AS (SELECT h.qid, ent AS last_entropy, mp AS last_maxprob FROM h JOIN ag ON h.qid = ag.qid
  AND h.step = ag.ls),
lp AS (SELECT qid, {_P.replace("step = 7", "step = ls")} FROM pr JOIN ag USING (qid) GROUP BY qid),
ex AS (SELECT q, CAST(q AS VARCHAR) AS qid FROM (SELECT DISTINCT q FROM lt UNION ALL
  SELECT DISTINCT q + 1000000 FROM lt)),
jn AS (SELECT ex.q, ex.qid, T, ent_mean, ent_std, margin_mean, maxprob_mean, last_entropy,
    last_maxprob, p_A, p_B, p_C, p_D, p_E,
    CASE WHEN q % 6 <> 0 THEN substr({AZ}, CAST(q % 4 AS INT) + 1, 1) END AS gold
  FROM ex LEFT JOIN ag ON ex.qid = ag.qid LEFT JOIN la ON ex.qid = la.qid
  LEFT JOIN lp ON ex.qid = lp.qid),
pd AS (SELECT *, CASE WHEN p_A IS NULL THEN '' WHEN p_A >= greatest(p_B, p_C, p_D) THEN 'A'
  WHEN p_B >= greatest(p_C, p_D) THEN 'B' WHEN p_C >= p_D THEN 'C' ELSE 'D' END AS pred_letter
  FROM jn)
SELECT qid, 'toy' AS dataset, coalesce(T, 0) AS T, CAST(CASE WHEN T IS NULL THEN 0 ELSE 64 END AS INT)
  AS V, pred_letter, CAST(CASE WHEN pred_letter <> '' AND gold IS NOT NULL THEN
    CASE WHEN pred_letter <> gold THEN 1 ELSE 0 END END AS INT) AS is_error,
  {q6s("ent_mean", "ent_std", "margin_mean", "maxprob_mean", "last_entropy", "last_maxprob",
       "p_A", "p_B", "p_C", "p_D", "p_E")} FROM pd"""


def _region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.response_region(fixtures.response_trace(spark, sf_dir))


REGION = f"""{PLAIN}, rt AS (SELECT vec_id, CAST(CAST(floor(vec_id / 40e0) AS BIGINT) AS VARCHAR)
    AS qid, substr({AZ}, CAST(vec_id // 10 % 4 AS INT) + 1, 1) AS letter,
  CASE WHEN vec_id // 5 % 2 = 0 THEN 'cond' ELSE 'uncond' END AS role,
  CAST(vec_id % 5 AS INT) AS pos, CAST((vec_id // 40 + vec_id // 10 % 4) % 3 AS INT) AS prompt_len
  FROM zs),
rg AS (SELECT *, 5 - prompt_len AS resp_len, pos - greatest(prompt_len - 1, 0) AS step FROM rt
  WHERE pos BETWEEN greatest(prompt_len - 1, 0) AND 3)"""


def trace_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _region(spark, sf_dir).select("qid", "letter", "role", "pos", "step", "resp_len")


def trace_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _region(spark, sf_dir)
    columns = []
    for view in ("letter", "content"):
        for span in ("first", "all", 2):
            start, length = tr.span_bounds(view, span)
            columns.append(start.cast("int").alias(f"{view}_{span}_start"))
            columns.append(length.cast("int").alias(f"{view}_{span}_len"))
    return rows.select("qid", "letter", "role", "step", *columns)


SPANS_SQL = f"""WITH {REGION} SELECT qid, letter, role, step, 0 AS letter_first_start, 1 AS letter_first_len,
  0 AS letter_all_start, resp_len AS letter_all_len, 0 AS letter_2_start,
  least(2, resp_len) AS letter_2_len,
  least(2, resp_len - 1) AS content_first_start, 1 AS content_first_len,
  least(2, resp_len - 1) AS content_all_start, resp_len - least(2, resp_len - 1) AS content_all_len,
  least(2, resp_len - 1) AS content_2_start, least(2, resp_len - least(2, resp_len - 1))
    AS content_2_len FROM rg"""


def _evidence(spark: SparkSession, sf_dir: str, view: str, span: str) -> DataFrame:
    region = _region(spark, sf_dir)
    keys = region.select("qid", "letter").distinct()
    options = keys.unionByName(keys.select("qid", F.lower("letter").alias("letter")))
    table = tr.option_evidence(region, view, span, options=options)
    plain = ["qid", "letter", f"llmc_{view}_span_len", *tr.LENGTHS]
    return table.select(*plain, *r6s(*[c for c in table.columns if c not in plain]))


def trace_letter_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir, "letter", "first")


def trace_content_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir, "content", "all")


def _evidence_sql(view: str, start: str, length: str) -> str:
    names = [f"llmc_{view}_{n}" for n in ("ce_cond", "ce_uncond", "ce_logpmi",
                                          "logit_entropy_mean")]
    aliases = [f"e_{view}_{n}" for n in ("ce_logpmi", "ce_cond", "ce_uncond")]
    return f"""WITH {REGION}, hs AS (SELECT vec_id, -sum(p * ln(greatest(p, 1e-10))) AS h,
  -max(CASE WHEN i = vec_id * 7 % 64 THEN lp END) AS nll FROM sp GROUP BY vec_id),
us AS (SELECT rg.*, h, nll FROM rg JOIN hs USING (vec_id)
  WHERE step >= {start} AND step < {start} + {length}),
ev AS (SELECT qid, letter, avg(nll) FILTER (role = 'cond') AS a, avg(nll) FILTER (role = 'uncond')
  AS b, avg(h) FILTER (role = 'cond') AS h, count(*) FILTER (role = 'cond') AS n,
  max(prompt_len) FILTER (role = 'cond') AS pl, max(resp_len) FILTER (role = 'cond') AS rl FROM us
  GROUP BY qid, letter),
ks AS (SELECT DISTINCT qid, letter FROM rg),
fu AS (SELECT ks.qid, ks.letter, a, b, h, coalesce(n, 0) AS n, pl, rl FROM ks LEFT JOIN ev USING (qid, letter)
  UNION ALL SELECT qid, lower(letter), NULL, NULL, NULL, 0, NULL, NULL FROM ks)
SELECT qid, letter, n AS llmc_{view}_span_len, pl AS llmc_prompt_len, pl + rl AS llmc_total_len, rl AS llmc_resp_len, {q6("a", names[0])}, {q6("b", names[1])},
  {q6("b - a", names[2])}, {q6("CASE WHEN a IS NOT NULL THEN h END", names[3])},
  {q6("b - a", aliases[0])}, {q6("a", aliases[1])}, {q6("b", aliases[2])} FROM fu"""


def trace_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of a letter as token id lists; only the first id of each counts."""
    variants = fixtures.table(spark, sf_dir, "part").select(
        fixtures.letter_at(F.col("p_partkey") % 26).alias("letter"),
        F.when(F.col("p_partkey") % 10 == 0, F.array().cast("array<int>"))
        .otherwise(F.array(F.col("p_size"), F.col("p_partkey").cast("int")))
        .alias("token_ids"),
    )
    buckets = tr.letter_buckets(variants)
    return buckets.select(
        "letter", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids")
    )


BUCKETS_SQL = f"""WITH d AS (SELECT DISTINCT substr({AZ}, CAST(p_partkey % 26 AS INT) + 1, 1)
  AS letter, p_size FROM part WHERE p_partkey % 10 <> 0)
SELECT letter, string_agg(CAST(p_size AS VARCHAR), ',' ORDER BY p_size) AS ids FROM d GROUP BY letter"""


def _last_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-step logits per vector; every seventh row has no mass on any letter."""
    rows = _plain_trace(spark, sf_dir)
    sunk = F.concat(
        F.transform(F.slice("logits", 1, 16), lambda v: F.lit(-1e6)), F.slice("logits", 17, 48)
    )
    spoken = F.when(F.col("vec_id") % 2 == 0, F.lit(" c) x")).otherwise(F.lit("?"))
    return rows.select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, sunk).otherwise(F.col("logits")).alias("logits"),
        F.array(*[F.lit(letter) for letter in QUESTION_LETTERS]).alias("letters"),
        spoken.alias("gen_text"),
    )


def _letter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.letter_evidence(_last_logits(spark, sf_dir), BUCKETS)


def letter_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _letter_table(spark, sf_dir)
    exploded = rows.select("vec_id", "fcm_mass_on_letters", F.inline(
        F.arrays_zip(F.col("letters").alias("letter"), F.col("fcm_letter_probs").alias("p"))))
    return exploded.select("vec_id", "letter", *r6s("fcm_mass_on_letters", "p"))


STATISTICS = ["fcm_letter_p_top1", "fcm_letter_p_top2", "fcm_letter_margin", "fcm_letter_entropy",
              "fcm_letter_simpson"]
RAW = ["fcm_letter_logit_top1", "fcm_letter_logit_top2", "fcm_letter_logit_margin",
       "fcm_letter_lse_top1", "fcm_letter_lse_top2", "fcm_letter_lse_margin"]
VOTED = ["fcm_vote_top_share", "fcm_vote_entropy"]


def letter_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letter_table(spark, sf_dir).select(
        "vec_id", "pred_letter", "fcm_letters_with_bucket", *r6s(*STATISTICS)
    )


def letter_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letter_table(spark, sf_dir).select("vec_id", *r6s(*VOTED))


def letter_raw_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letter_table(spark, sf_dir).select("vec_id", *r6s(*RAW))


_BUCKET_ROWS = ", ".join(
    f"('{letter}', {i})" for letter, ids in BUCKETS.items() for i in ids
)
_LETTER_ROWS = ", ".join(f"('{letter}', {k})" for k, letter in enumerate(QUESTION_LETTERS))
LETTERS_SQL = f"""WITH {EL}, bk(letter, i) AS (VALUES {_BUCKET_ROWS}),
ql(letter, k) AS (VALUES {_LETTER_ROWS}),
lg AS (SELECT vec_id, i, CASE WHEN vec_id % 7 = 0 AND i < 16 THEN -1e6 ELSE v END AS v FROM el),
mx AS (SELECT vec_id, max(v) AS m FROM lg GROUP BY vec_id),
dn AS (SELECT lg.vec_id, any_value(m) AS m, sum(exp(v - m)) AS z FROM lg JOIN mx USING (vec_id)
  GROUP BY lg.vec_id),
bl AS (SELECT lg.vec_id, bk.letter, v, m, z, max(v) OVER (PARTITION BY lg.vec_id, bk.letter) AS t
  FROM lg JOIN bk ON lg.i = bk.i JOIN dn ON lg.vec_id = dn.vec_id),
ms AS (SELECT vec_id, letter, sum(exp(v - m) / z) AS mass, max(v) AS top,
  any_value(t) + ln(sum(exp(v - t))) AS lse FROM bl GROUP BY vec_id, letter),
lm AS (SELECT dn.vec_id, ql.letter, k, coalesce(mass, 0e0) AS mass, coalesce(top, -1e9) AS top,
  coalesce(lse, -1e9) AS lse, sum(coalesce(mass, 0e0)) OVER (PARTITION BY dn.vec_id) AS tot
  FROM dn CROSS JOIN ql LEFT JOIN ms ON ms.vec_id = dn.vec_id AND ms.letter = ql.letter),
lf AS (SELECT *, CASE WHEN tot > 0 THEN mass / tot
    WHEN vec_id % 2 = 0 AND letter = 'C' THEN 1e0 ELSE 0e0 END AS p,
  CASE WHEN tot > 0 THEN mass / tot ELSE 0e0 END AS p0,
  CASE WHEN tot > 0 THEN tot WHEN vec_id % 2 = 0 THEN 1e0 ELSE 0e0 END AS mol FROM lm)"""
LETTER_STATS_SQL = f"""{LETTERS_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id
  ORDER BY p DESC, k) AS r FROM lf)
SELECT vec_id, CASE WHEN max(mol) > 0 THEN max(CASE WHEN r = 1 THEN letter END) ELSE 'A' END
  AS pred_letter, CAST(4 AS INT) AS fcm_letters_with_bucket,
  {q6("max(CASE WHEN r = 1 THEN p END)", STATISTICS[0])},
  {q6("max(CASE WHEN r = 2 THEN p END)", STATISTICS[1])},
  {q6("max(CASE WHEN r = 1 THEN p END) - max(CASE WHEN r = 2 THEN p END)", STATISTICS[2])},
  {q6("greatest(0e0, -sum(p * ln(p + 1e-8)))", STATISTICS[3])},
  {q6("1e0 - sum(p0 * p0)", STATISTICS[4])} FROM rk GROUP BY vec_id"""
LETTER_RAW_SQL = f"""{LETTERS_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id
  ORDER BY top DESC, k) AS r, row_number() OVER (PARTITION BY vec_id ORDER BY lse DESC, k) AS s
  FROM lf),
w AS (SELECT vec_id, max(CASE WHEN r = 1 THEN top END) AS a, max(CASE WHEN r = 2 THEN top END) AS b,
  max(CASE WHEN s = 1 THEN lse END) AS c, max(CASE WHEN s = 2 THEN lse END) AS d FROM rk
  GROUP BY vec_id)
SELECT vec_id, {q6("a", RAW[0])}, {q6("b", RAW[1])}, {q6("a - b", RAW[2])}, {q6("c", RAW[3])},
  {q6("d", RAW[4])}, {q6("c - d", RAW[5])} FROM w"""
_DRAWS = ", ".join(
    f"({n}, {u:.17e}, {blind})"
    for n, (u, blind) in enumerate(
        zip(
            np.random.default_rng(tr.VOTE_SEED).random(tr.VOTES),
            np.random.default_rng(tr.VOTE_SEED).integers(0, len(QUESTION_LETTERS), tr.VOTES),
        )
    )
)
VOTES_SQL = f"""{LETTERS_SQL}, dr(n, u, blind) AS (VALUES {_DRAWS}),
cd AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY k) / nullif(sum(p) OVER
  (PARTITION BY vec_id), 0e0) AS c FROM lf),
pk AS (SELECT vec_id, n, CASE WHEN max(mol) > 0 THEN count(*) FILTER (c <= u) ELSE any_value(blind)
  END AS k FROM cd, dr GROUP BY vec_id, n),
sh AS (SELECT lf.vec_id, lf.k, count(pk.n) / 1.6e1 AS v FROM lf LEFT JOIN pk
  ON lf.vec_id = pk.vec_id AND lf.k = pk.k GROUP BY lf.vec_id, lf.k)
SELECT vec_id, {q6("max(v)", VOTED[0])}, {q6("greatest(0e0, -sum(v * ln(v + 1e-8)))", VOTED[1])}
FROM sh GROUP BY vec_id"""


# ---- vectors --------------------------------------------------------------------------------

VECTORS = """sv AS (SELECT vec_id // 40 AS seq, CAST(vec_id // 5 % 8 AS INT) AS step,
  CAST(vec_id % 5 AS INT) AS layer, CAST(i AS INT) AS i, CAST(embedding[i] AS DOUBLE) AS v
  FROM embeddings, range(1, 65) r(i)),
ld AS (SELECT a.seq, a.step, a.layer, a.i, a.v - b.v AS d FROM sv a JOIN sv b ON a.seq = b.seq
  AND a.step = b.step AND a.i = b.i AND a.layer = b.layer + 1 WHERE b.layer >= 1),
ln AS (SELECT seq, step, layer, sqrt(sum(d * d)) AS n FROM ld GROUP BY ALL),
lc AS (SELECT a.seq, a.step, a.layer, sum(a.d * b.d) AS dp FROM ld a JOIN ld b ON a.seq = b.seq
  AND a.step = b.step AND a.i = b.i AND a.layer = b.layer + 1 GROUP BY ALL),
lcs AS (SELECT lc.seq, lc.step, avg(dp / (greatest(x.n, 1e-10) * greatest(y.n, 1e-10))) AS layer_cos
  FROM lc JOIN ln x ON x.seq = lc.seq AND x.step = lc.step AND x.layer = lc.layer
  JOIN ln y ON y.seq = lc.seq AND y.step = lc.step AND y.layer = lc.layer - 1 GROUP BY ALL),
lay AS (SELECT ln.seq, ln.step, avg(n) AS delta_tok, stddev_samp(n) AS delta_spread,
  any_value(layer_cos) AS layer_cos FROM ln LEFT JOIN lcs ON ln.seq = lcs.seq AND ln.step = lcs.step
  GROUP BY ln.seq, ln.step),
td AS (SELECT a.seq, a.step, a.i, a.v - b.v AS d FROM sv a JOIN sv b ON a.seq = b.seq AND a.i = b.i
  AND a.step = b.step + 1 AND a.layer = 4 AND b.layer = 4),
tn AS (SELECT seq, step, sqrt(sum(d * d)) AS n FROM td GROUP BY ALL),
tc AS (SELECT a.seq, a.step, sum(a.d * b.d) AS dp FROM td a JOIN td b ON a.seq = b.seq AND a.i = b.i
  AND a.step = b.step + 1 GROUP BY ALL),
tim AS (SELECT tn.seq, tn.step, tn.n AS delta_time,
  dp / (greatest(tn.n, 1e-10) * greatest(y.n, 1e-10)) AS time_cos FROM tn
  LEFT JOIN tc ON tc.seq = tn.seq AND tc.step = tn.step
  LEFT JOIN tn y ON y.seq = tn.seq AND y.step = tn.step - 1),
hm AS (SELECT seq, step, (i - 1) // 16 AS head, sum(abs(v) * 6e-1) AS m FROM sv
  WHERE layer = 4 AND (i - 1) % 16 < 6 + seq % 5 GROUP BY ALL),
att AS (SELECT seq, step, least(greatest(avg(m), 0e0), 1e0) AS prompt_mass FROM hm GROUP BY ALL),
ser AS (SELECT lay.seq, lay.step, delta_tok, delta_spread, layer_cos, delta_time, time_cos,
  prompt_mass FROM lay LEFT JOIN tim ON lay.seq = tim.seq AND lay.step = tim.step
  LEFT JOIN att ON att.seq = lay.seq AND att.step = lay.step)"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec.step_series(
        fixtures.states(spark, sf_dir), fixtures.attention(spark, sf_dir), n_layers=5
    )


def vector_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = fixtures.states(spark, sf_dir)
    rows = vec.layer_dynamics(states, vec.pick_layers(vec.count_layers(states)))
    return rows.select("seq", "step", *r6s("delta_tok", "delta_spread", "layer_cos"))


def vector_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vec.time_dynamics(fixtures.states(spark, sf_dir), 4)
    return rows.select("seq", "step", *r6s("delta_time", "time_cos"))


def vector_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vec.prompt_attention(fixtures.attention(spark, sf_dir))
    return rows.select("seq", "step", *r6s("prompt_mass"))


SEQUENCE = ["icrp_layer_delta_mean", "icrp_layer_delta_cv", "icrp_layer_delta_p95",
            "icrp_time_delta_mean", "icrp_time_delta_cv", "icrp_time_delta_p95",
            "icrp_interlayer_cos_mean", "icrp_temporal_cos_mean", "icrp_prompt_mass_mean",
            "icrp_pool_attn_cons"]


def vector_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vec.sequence_features(_series(spark, sf_dir))
    return rows.select("seq", "icrp_resp_len", "icrp_reliable", *r6s(*SEQUENCE))


def _cv(s: str) -> str:
    return f"stddev_pop({s}) / greatest(avg({s}), 1e-10)"


_R = ("(count(*) * covar_pop(delta_tok, prompt_mass)) / nullif(count(*) * "
      "sqrt(var_pop(delta_tok) * var_pop(prompt_mass)), 0e0)")
SEQUENCE_SQL = f"""WITH {VECTORS} SELECT seq, count(*) AS icrp_resp_len,
  CAST(CASE WHEN count(*) >= 5 THEN 1 ELSE 0 END AS INT) AS icrp_reliable,
  {q6("avg(delta_tok)", SEQUENCE[0])}, {q6(_cv("delta_tok"), SEQUENCE[1])},
  {q6("quantile_cont(delta_tok, 9.5e-1)", SEQUENCE[2])}, {q6("avg(delta_time)", SEQUENCE[3])},
  {q6(_cv("delta_time"), SEQUENCE[4])}, {q6("quantile_cont(delta_time, 9.5e-1)", SEQUENCE[5])},
  {q6("avg(layer_cos)", SEQUENCE[6])}, {q6("avg(time_cos)", SEQUENCE[7])},
  {q6("avg(prompt_mass)", SEQUENCE[8])},
  {q6(f"CASE WHEN count(prompt_mass) = count(*) THEN {_R} END", SEQUENCE[9])}
FROM ser GROUP BY seq"""


def vector_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vec.sequence_features(_series(spark, sf_dir))
    return rows.select("seq", F.posexplode("icrp_pool_vec").alias("i", "v")).select(
        "seq", "i", *r6s("v")
    )


POOL_SQL = f"WITH {VECTORS}, pl AS (" + " UNION ALL ".join(
    f"SELECT seq, CAST({3 * k + j} AS INT) AS i, {expr} AS v FROM ser GROUP BY seq"
    for k, s in enumerate(vec.SERIES)
    for j, expr in enumerate(
        (f"avg({s})", f"stddev_pop({s})", f"quantile_cont({s}, 9.5e-1)")
    )
) + f") SELECT seq, i, {q6('v')} FROM pl"


def _question_inputs(spark: SparkSession, sf_dir: str) -> dict:
    """Questions of the response trace; the states of four sequences belong to one question."""
    region = _region(spark, sf_dir)
    letter = F.substring(F.lit("ABCD"), (F.col("seq") % 4 + 1).cast("int"), F.lit(1))
    by_option = lambda df: df.withColumns(
        {"qid": F.floor(F.col("seq") / 4).cast("string"), "letter": letter}
    ).drop("seq")
    questions = region.groupBy("qid").agg(F.sort_array(F.collect_set("letter")).alias("letters"))
    mcq = questions.select(
        "qid",
        F.when(F.col("qid").cast("int") % 2 == 0, "even").otherwise("odd").alias("dataset"),
        F.col("letters")[0].alias("gold_letter"),
        F.transform(
            "letters", lambda x: F.struct(x.alias("label"), F.concat(F.lit("text "), x).alias("text"))
        ).alias("options"),
    )
    last = region.where("role = 'cond'").groupBy("qid").agg(
        F.max_by("logits", F.struct("step", "letter")).alias("logits")
    )
    return {
        "mcq": mcq,
        "trace": region,
        "last": last.join(questions, "qid"),
        "buckets": BUCKETS,
        "states": by_option(fixtures.states(spark, sf_dir)),
        "attention": by_option(fixtures.attention(spark, sf_dir)),
    }


def question_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From traces to the collapsed table: per question, how many options have each kind of evidence."""
    records = checkpointed(question_records(**_question_inputs(spark, sf_dir)))
    table = option_table(records)
    kinds = ("pmil", "pmic", "e_letter", "e_content", "icrp_layer_delta_mean", "fcm_prob")
    counts = table.groupBy("qid").agg(
        F.count(F.lit(1)).alias("options"), *[F.count(k).alias(f"with_{k}") for k in kinds]
    )
    collapsed = collapse(table, carry=("dataset",)).select(
        "qid", "dataset", "gold", F.col("pmil_gap_top1_top2").isNotNull().alias("has_gap")
    )
    return collapsed.join(counts, "qid")


COVERAGE_SQL = f"""WITH {REGION}, o AS (SELECT qid, letter,
  CAST(bool_or(role = 'cond') AND bool_or(role = 'uncond') AS INT) AS both_roles,
  CAST(bool_or(role = 'cond') AS INT) AS cond FROM rg GROUP BY qid, letter),
sq AS (SELECT DISTINCT CAST(CAST(floor(floor(vec_id / 40e0) / 4e0) AS BIGINT) AS VARCHAR) AS qid,
  substr('ABCD', CAST(vec_id // 40 % 4 AS INT) + 1, 1) AS letter FROM embeddings),
n AS (SELECT qid, count(*) AS options, CAST(sum(both_roles) AS BIGINT) AS pmi,
  CAST(sum(cond) AS BIGINT) AS cond, count(sq.letter) AS seqs FROM o LEFT JOIN sq USING (qid, letter) GROUP BY qid)
SELECT qid, CASE WHEN CAST(qid AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset,
  (SELECT min(letter) FROM o WHERE o.qid = n.qid) AS gold, pmi > 0 AS has_gap, options,
  pmi AS with_pmil, pmi AS with_pmic, cond AS with_e_letter, cond AS with_e_content,
  seqs AS with_icrp_layer_delta_mean, options AS with_fcm_prob FROM n"""

QUERIES = {
    f.__name__: f
    for f in (
        trace_softmax, trace_steps, trace_aggregate, trace_mean_nll, trace_features, trace_region,
        trace_spans, trace_letter_evidence, trace_content_evidence, trace_buckets,
        letter_distribution, letter_statistics, letter_votes, letter_raw_logits, vector_layers,
        vector_steps, vector_attention, vector_sequence, vector_pool, question_features,
    )
}

ORACLES = {
    "question_features": COVERAGE_SQL,
    "trace_softmax": f"WITH {PLAIN} SELECT vec_id, i, {q6s('p', 'lp')} FROM sp",
    "trace_steps": STEPS_SQL,
    "trace_aggregate": AGGREGATE_SQL,
    "trace_mean_nll": NLL_SQL,
    "trace_features": FEATURES_SQL,
    "trace_region": f"WITH {REGION} SELECT qid, letter, role, pos, CAST(step AS INT) AS step, "
    "resp_len FROM rg",
    "trace_spans": SPANS_SQL,
    "trace_letter_evidence": _evidence_sql("letter", "0", "1"),
    "trace_content_evidence": _evidence_sql(
        "content", "least(2, resp_len - 1)", "(resp_len - least(2, resp_len - 1))"
    ),
    "trace_buckets": BUCKETS_SQL,
    "letter_distribution": f"{LETTERS_SQL} SELECT vec_id, letter, "
    f"{q6('mol', 'fcm_mass_on_letters')}, {q6('p')} FROM lf",
    "letter_statistics": LETTER_STATS_SQL,
    "letter_votes": VOTES_SQL,
    "letter_raw_logits": LETTER_RAW_SQL,
    "vector_layers": f"WITH {VECTORS} SELECT seq, step, "
    f"{q6s('delta_tok', 'delta_spread', 'layer_cos')} FROM lay",
    "vector_steps": f"WITH {VECTORS}, st AS (SELECT DISTINCT seq, step FROM sv) SELECT st.seq, "
    f"st.step, {q6s('delta_time', 'time_cos')} FROM st LEFT JOIN tim ON st.seq = tim.seq "
    "AND st.step = tim.step",
    "vector_attention": f"WITH {VECTORS} SELECT seq, step, {q6('prompt_mass')} FROM att",
    "vector_sequence": SEQUENCE_SQL,
    "vector_pool": POOL_SQL,
}
