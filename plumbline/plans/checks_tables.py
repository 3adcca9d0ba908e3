"""Registered queries of sources, question tables, prompts, quality checks, splits and sinks."""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scalars import error_label
from ..operators import mcq, quality, splits
from ..operators.collapse import collapse
from ..operators.metrics import reliability_table
from ..session import checkpoint_dir, checkpointed
from ..sources import readers, sinks
from . import fixtures
from .fixture_sql import AZ, COLLAPSED, SCORED, TEXTS
from .rounding import q6, q6s, r6s

SEED = 2025
SAMPLE = 500


def _hash_sql(key: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || {key}), 1, 15) AS BIGINT)"


# ---- sources --------------------------------------------------------------------------------


def row_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "events").select(
        "event_id",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    return mcq.with_ordinal(rows)


def sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return mcq.sample(rows, SAMPLE, ["o_orderkey"], SEED)


def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions written as files and read back through the name of their source."""
    path = f"{checkpoint_dir(spark)}/source-{uuid.uuid4().hex}"
    fixtures.truthful_rows(spark, sf_dir).write.parquet(f"{path}/t")
    fixtures.open_rows(spark, sf_dir).write.json(f"{path}/o")
    first = readers.read_questions(spark, " TQA ", f"{path}/t")
    second = readers.read_questions(spark, "Open-LLM", f"{path}/o", file_format="json")
    return first.unionByName(second).select(
        "qid", "dataset", "gold_letter", F.size("options").alias("n_options")
    )


SOURCE_SQL = f"""WITH {TEXTS}
SELECT qid, 'truthfulqa' AS dataset, substr({AZ}, CAST(l_orderkey * 7 % n AS INT) + 1, 1)
  AS gold_letter, CAST(n AS INT) AS n_options FROM mcq0 WHERE pos = 0
UNION ALL SELECT qid, CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'open_llm' END,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE substr({AZ}, ix + 1, 1) END, CAST(n AS INT)
FROM mcq0 WHERE pos = l_orderkey % n"""


# ---- question tables ------------------------------------------------------------------------


def mcq_truthful(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mcq.from_truthful(fixtures.truthful_rows(spark, sf_dir))
    return rows.select(
        "qid", "question", "gold_letter", "dataset", tx.options_text("options").alias("options")
    )


TRUTHFUL_SQL = f"""WITH {TEXTS} SELECT qid, 'Which part of order ' || qid || '?' AS question,
  any_value(substr({AZ}, CAST(l_orderkey * 7 % n AS INT) + 1, 1)) AS gold_letter,
  'truthfulqa' AS dataset,
  string_agg(substr({AZ}, CAST(pos AS INT) + 1, 1) || ') ' || text, chr(10) ORDER BY pos) AS options
FROM mcq0 GROUP BY qid"""


def mcq_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mcq.from_truthful(fixtures.truthful_rows(spark, sf_dir), True, 7)
    return rows.select(
        "qid", "gold_letter", tx.options_text("options").alias("options")
    )


SHUFFLED_SQL = f"""WITH {TEXTS}, sh AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY
  {_hash_sql("qid || '|' || pos", 7)}, pos) - 1 AS place FROM mcq0)
SELECT qid, max(CASE WHEN pos = l_orderkey * 7 % n THEN substr({AZ}, CAST(place AS INT) + 1, 1) END)
  AS gold_letter,
  string_agg(substr({AZ}, CAST(place AS INT) + 1, 1) || ') ' || text, chr(10) ORDER BY place)
  AS options FROM sh GROUP BY qid"""


def _open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcq.from_open(fixtures.open_rows(spark, sf_dir))


OPEN = f"""{TEXTS}, op AS (SELECT *, substr({AZ}, ix + 1, 1) AS letter,
  CASE WHEN l_orderkey % 3 = 2 THEN 'Order ' || qid || chr(10) || chr(10) ELSE '' END
    || 'Which part of ' || qid || '?' AS question,
  CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'open_llm' END AS dataset,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN pos = l_orderkey % n THEN substr({AZ}, ix + 1, 1)
    END AS gl FROM mcq0),
oq AS (SELECT qid, any_value(question) AS question, any_value(dataset) AS dataset,
  max(gl) AS gold_letter,
  string_agg(letter || ') ' || text, chr(10) ORDER BY pos) AS block,
  string_agg(letter, '' ORDER BY pos) AS letters FROM op GROUP BY qid)"""


def mcq_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _open(spark, sf_dir).select(
        "qid", "question", "gold_letter", "dataset",
        F.array_join(tx.option_labels("options"), "").alias("labels"),
    )


def mcq_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcq.explode_options(_open(spark, sf_dir)).select("qid", "pos", "letter", "text")


def prompt_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcq.prompts(_open(spark, sf_dir))


SYSTEM = "'You are a helpful, factual assistant.' || chr(10) || chr(10)"
NL = "chr(10)"
_ONLY = f"{SYSTEM} || 'Question: ' || question || {NL} || 'Answer:'"
_BARE = (
    f"'Question: ' || question || {NL} || 'Options:' || {NL} || block || {NL} || 'Answer:'"
)
PROMPT_SQL = f"""WITH {OPEN}, p AS (SELECT qid, block AS options_text, {_ONLY} AS q_prompt,
  {SYSTEM} || {_BARE} AS prompt, {_BARE} AS bare_prompt FROM oq)
SELECT *, CAST(length(q_prompt) AS INT) AS q_prompt_len, CAST(length(prompt) AS INT) AS prompt_len
FROM p"""


def prompt_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcq.option_prompts(_open(spark, sf_dir))


OPTION_PROMPT_SQL = f"""WITH {OPEN}, p AS (SELECT qid, letter, letter || ') ' || text AS response,
  letter || ') ' || text AS option_line, {SYSTEM} || 'Answer:' AS uncond_prompt, block
  FROM op JOIN oq USING (qid))
SELECT qid, letter, response, option_line, uncond_prompt,
  CAST(length(uncond_prompt) AS INT) AS uncond_prompt_len,
  uncond_prompt || ' ' || letter || ')' AS uncond_letter,
  uncond_prompt || ' ' || response AS uncond_text,
  {SYSTEM} || 'Options:' || {NL} || block || {NL} || 'Answer: ' || letter || ')'
    AS uncond_letter_options FROM p"""

STYLE = tx.PromptStyle("Sistema.", "Pregunta:", "Opciones:", "Respuesta:")


def prompt_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.responses(spark, sf_dir)
    labels = F.array(F.lit(" b "), F.lit(""), F.col("gold"))
    texts = F.array(F.col("response"), F.lit("β"), F.lit("4"))
    return rows.select(
        "conv_id",
        "turn",
        tx.full_prompt("response", tx.options_block(labels, texts), STYLE).alias("prompt"),
        tx.with_letter(tx.answer_prompt(STYLE), F.col("gold")).alias("letter"),
        tx.with_text(tx.answer_prompt(STYLE), F.col("gold")).alias("text"),
    )


RESPONSES = f"""rs AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN ' ' ||
    lower(substr({AZ}, CAST((conv_id + turn) % 5 AS INT) + 1, 1)) || ' ) ' || text ELSE text END
    AS response,
  CASE WHEN conv_id % 4 = 0 THEN NULL WHEN conv_id % 4 = 1 THEN ''
    ELSE substr({AZ}, CAST(conv_id % 5 AS INT) + 1, 1) END AS gold FROM conversations)"""
_G = "coalesce(nullif(gold, ''), 'A')"
STYLE_SQL = f"""WITH {RESPONSES} SELECT conv_id, turn,
  'Sistema.' || {NL} || {NL} || 'Pregunta: ' || response || {NL} || 'Opciones:' || {NL} || 'B) '
    || response || {NL} || 'A) β' || {NL} || {_G} || ') 4' || {NL} || 'Respuesta:' AS prompt,
  'Sistema.' || {NL} || {NL} || 'Respuesta: ' || {_G} || ')' AS letter,
  'Sistema.' || {NL} || {NL} || 'Respuesta: ' || coalesce(gold, '') AS text FROM rs"""


def response_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mcq.label_predictions(fixtures.responses(spark, sf_dir))
    return rows.select(
        "conv_id", "turn", "pred_letter", "is_hallucination",
        error_label("pred_letter", "gold").alias("y"),
    )


LETTER_SQL = rf"""WITH {RESPONSES}, l AS (SELECT conv_id, turn, gold, coalesce(
  nullif(upper(regexp_extract(response, '^\s*([A-Za-z])\s*\)', 1)), ''), nullif(gold, ''), 'A') AS pl
  FROM rs)
SELECT conv_id, turn, pl AS pred_letter, CAST(CASE WHEN coalesce(gold, '') = '' THEN 0
    WHEN pl <> upper(gold) THEN 1 ELSE 0 END AS INT) AS is_hallucination,
  CAST(CASE WHEN pl <> upper(coalesce(gold, '')) THEN 1 ELSE 0 END AS INT) AS y FROM l"""


def path_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fixtures.table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", tx.slug("url").alias("slug"),
        tx.run_tag(F.lit(" Open LLM!"), F.col("url")).alias("tag"),
    )


def _slug_sql(text: str) -> str:
    dashed = f"regexp_replace(trim({text}), '[^A-Za-z0-9_.-]+', '-', 'g')"
    return f"trim(regexp_replace({dashed}, '-{{2,}}', '-', 'g'), '-')"


# ---- quality --------------------------------------------------------------------------------


def _collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(fixtures.options(spark, sf_dir), carry=("dataset",))


def feature_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.audit(_collapsed(spark, sf_dir))
    return report.select(
        *r6s(*[c for c in report.columns if c != "warnings"]),
        F.array_join("warnings", "; ").alias("warnings"),
    )


AUDIT_SQL = f"""WITH {COLLAPSED}, a AS (SELECT 0e0 AS llmc_letter_cov, 0e0 AS llmc_content_cov,
  avg(CASE WHEN pmil_gap_top1_top2 IS NULL THEN 0e0 ELSE 1e0 END) AS pmil_cov,
  avg(CASE WHEN pmic_gap_top1_top2 IS NULL THEN 0e0 ELSE 1e0 END) AS pmic_cov,
  avg(CASE WHEN delta_icrp_rel_chosen_vs_othermax IS NULL THEN 0e0 ELSE 1e0 END) AS icrp_cov,
  avg(CASE WHEN fcm_entropy IS NULL THEN 0e0 ELSE 1e0 END) AS fcm_cov,
  avg(CASE WHEN coalesce(p_opt_gap, 0e0) = 0e0 THEN 1e0 ELSE 0e0 END) AS popt_uniform_frac FROM col)
SELECT {q6s("llmc_letter_cov", "llmc_content_cov", "pmil_cov", "pmic_cov", "icrp_cov", "fcm_cov",
            "popt_uniform_frac")},
  concat_ws('; ', CASE WHEN llmc_letter_cov < 9e-1 THEN 'LLMCheck(letter) low' END,
    CASE WHEN llmc_content_cov < 5e-1 THEN 'LLMCheck(content) low' END,
    CASE WHEN pmil_cov < 9e-1 THEN 'PMI(letter) low' END,
    CASE WHEN pmic_cov < 5e-1 THEN 'PMI(content) low' END,
    CASE WHEN icrp_cov < 7e-1 THEN 'ICR probe low' END,
    CASE WHEN fcm_cov < 1e-1 THEN 'FCM coverage near zero' END,
    CASE WHEN popt_uniform_frac > 5e-1 THEN 'Option probs almost uniform' END) AS warnings FROM a"""

DESCRIBED = ["p_opt_top", "p_opt_chosen", "fcm_entropy", "pmic_gap_top1_top2"]


def feature_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = quality.describe(
        checkpointed(_collapsed(spark, sf_dir).select(*DESCRIBED)), DESCRIBED
    )
    return table.select("column", "count", *r6s("mean", "std", "min", "q25", "q50", "q75", "max"))


DESCRIBE_SQL = f"WITH {COLLAPSED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {q6(f'avg({c})', 'mean')}, "
    f"{q6(f'stddev_samp({c})', 'std')}, {q6(f'min({c})', 'min')}, "
    + ", ".join(q6(f"quantile_cont({c}, {q})", n)
                for n, q in (("q25", "2.5e-1"), ("q50", "5e-1"), ("q75", "7.5e-1")))
    + f", {q6(f'max({c})', 'max')} FROM col"
    for c in DESCRIBED
)


def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal for a table and for its rows and columns in another order, different after any change of a
    value, a row, a repetition, a name or a type."""
    rows = fixtures.table(spark, sf_dir, "orders")
    one = F.col("o_orderkey") == 1
    variants = {
        "as it is": rows,
        "moved": rows.select(*reversed(rows.columns)).repartition("o_custkey"),
        "value": rows.withColumn("o_totalprice", F.when(one, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))),
        "missing value": rows.withColumn("o_orderpriority", F.when(~one, F.col("o_orderpriority"))),
        "row less": rows.where(~one),
        "repeated row": rows.unionByName(rows.where(one)),
        "repeated twice": rows.unionByName(rows.where(one)).unionByName(rows.where(one)),
        "name": rows.withColumnRenamed("o_orderpriority", "priority"),
        "type": rows.withColumn("o_orderkey", F.col("o_orderkey").cast("string")),
    }
    parts = [quality.fingerprint(table).withColumn("variant", F.lit(name)) for name, table in variants.items()]
    prints = reduce(DataFrame.unionByName, parts)
    # One row for each variant; equal prints share a group.
    alike = Window.partitionBy("schema_hash", "rows", "xor", "total")
    return prints.select("variant", "rows", F.count(F.lit(1)).over(alike).alias("alike"))


def row_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "orders")
    return rows.select(
        "o_orderkey", quality.row_hash(["o_orderkey", "o_orderstatus"]).alias("hash")
    )


# ---- splits ---------------------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.scored(spark, sf_dir).select("row_id", "y")


def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(_labelled(spark, sf_dir), {"test": 0.3}, ["row_id"], seed=SEED)


def split_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(
        _labelled(spark, sf_dir), {"test": 0.2, "calib": 0.2}, ["row_id"], seed=SEED
    )


PLACED = f"""pl AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY
  {_hash_sql("row_id", SEED)}, row_id) AS position, count(*) OVER (PARTITION BY y) AS n FROM sc)"""


def split_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_folds(_labelled(spark, sf_dir), 5, ["row_id"], seed=SEED)


def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split_stratified(spark, sf_dir)
    test = parts.where(F.col("split") == "test")
    train = parts.where(F.col("split") == "train")
    both = splits.overlap(train, test, ["row_id"]).withColumn("pair", F.lit("train-test"))
    return both.unionByName(
        splits.overlap(parts, test, ["row_id"]).withColumn("pair", F.lit("all-test"))
    )


def permuted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpointed(
        _collapsed(spark, sf_dir).select(
            "qid", "chosen", "gold", error_label("chosen", "gold").alias("y")
        )
    )
    return splits.permute_labels(rows, seed=SEED)


PERMUTED_SQL = f"""WITH {COLLAPSED}, b AS (SELECT qid, chosen,
  CAST(CASE WHEN chosen <> gold THEN 1 ELSE 0 END AS INT) AS y FROM col),
a1 AS (SELECT qid, chosen, row_number() OVER (ORDER BY {_hash_sql("qid", SEED)}, qid) AS k FROM b),
a2 AS (SELECT y, row_number() OVER (ORDER BY {_hash_sql("qid", SEED + 1)}, qid) AS k FROM b)
SELECT qid, chosen, y, CASE WHEN y = 0 THEN chosen WHEN chosen <> 'A' THEN 'A' ELSE 'B' END AS gold
FROM a1 JOIN a2 USING (k)"""


# ---- sinks ----------------------------------------------------------------------------------


def sink_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/features-{uuid.uuid4().hex}"
    written = sinks.write_features(_collapsed(spark, sf_dir), path)
    back = spark.read.option("header", True).csv(written["features_csv"])
    return back.select(
        "qid", "chosen", *r6s(), *[
            (F.floor(F.col(c).cast("double") * 1e6 + 0.50123) / 1e6).alias(c) for c in DESCRIBED
        ]
    )


def sink_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/reliability-{uuid.uuid4().hex}"
    rows = fixtures.scored(spark, sf_dir).select("y", F.col("p_err").alias("p"))
    sinks.write_csv(reliability_table(rows), path)
    back = spark.read.option("header", True).csv(path)
    return back.agg(F.sum(F.col("n").cast("bigint")).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        row_ordinal, sample_exact, source_names, mcq_truthful, mcq_shuffled, mcq_open, mcq_explode,
        prompt_question, prompt_option, prompt_style, response_letter, path_slug, feature_audit,
        feature_describe, table_fingerprint, row_hashes, split_stratified, split_three_way,
        split_folds, split_overlap, permuted_labels, sink_features, sink_reliability,
    )
}

ORACLES = {
    "row_ordinal": "SELECT event_id, CAST(event_id AS VARCHAR) AS qid FROM events",
    "sample_exact": f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY "
    f"{_hash_sql('o_orderkey', SEED)}, o_orderkey LIMIT {SAMPLE}",
    "source_names": SOURCE_SQL,
    "mcq_truthful": TRUTHFUL_SQL,
    "mcq_shuffled": SHUFFLED_SQL,
    "mcq_open": f"WITH {OPEN} SELECT qid, question, gold_letter, dataset, letters AS labels FROM oq",
    "mcq_explode": f"WITH {OPEN} SELECT qid, CAST(pos AS INT) AS pos, letter, text FROM op",
    "prompt_question": PROMPT_SQL,
    "prompt_option": OPTION_PROMPT_SQL,
    "prompt_style": STYLE_SQL,
    "response_letter": LETTER_SQL,
    "path_slug": f"SELECT page_id, {_slug_sql('url')} AS slug, 'Open-LLM__' || "
    + _slug_sql("string_split(url, '/')[-1]")
    + " AS tag FROM pages",
    "feature_audit": AUDIT_SQL,
    "feature_describe": DESCRIBE_SQL,
    "table_fingerprint": "WITH v(variant, more, alike) AS (VALUES ('as it is', 0, 2), ('moved', 0, 2), "
    "('value', 0, 1), ('missing value', 0, 1), ('row less', -1, 1), ('repeated row', 1, 1), "
    "('repeated twice', 2, 1), ('name', 0, 1), ('type', 0, 1)), "
    "n AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey = 1) AS one FROM orders) "
    "SELECT variant, n + more * one AS rows, CAST(alike AS BIGINT) AS alike FROM v, n",
    "row_hashes": "SELECT o_orderkey, sha256(o_orderkey || chr(31) || o_orderstatus) AS hash "
    "FROM orders",
    "split_stratified": f"WITH {SCORED}, {PLACED} SELECT row_id, y, CASE WHEN position <= "
    "round_even(3e-1 * n, 0) THEN 'test' ELSE 'train' END AS split FROM pl",
    "split_three_way": f"WITH {SCORED}, {PLACED} SELECT row_id, y, CASE WHEN position <= "
    "round_even(2e-1 * n, 0) THEN 'test' WHEN position <= 2 * round_even(2e-1 * n, 0) "
    "THEN 'calib' ELSE 'train' END AS split FROM pl",
    "split_folds": f"WITH {SCORED}, {PLACED} SELECT row_id, y, CAST((position - 1) % 5 AS INT) "
    "AS fold FROM pl",
    "split_overlap": f"WITH {SCORED}, {PLACED} SELECT 'train-test' AS pair, CAST(0 AS BIGINT) "
    "AS shared UNION ALL SELECT 'all-test', count(*) FILTER (position <= round_even(3e-1 * n, 0)) "
    "FROM pl",
    "permuted_labels": PERMUTED_SQL,
    "sink_features": f"WITH {COLLAPSED} SELECT qid, chosen, {q6s(*DESCRIBED)} FROM col",
    "sink_reliability": f"WITH {SCORED} SELECT count(*) AS n FROM sc WHERE p_err < 1e0",
}
