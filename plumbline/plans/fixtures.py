"""Views over the driver's tables in the shapes the operators expect.

Every view reads whole tables. Groups are bounded by construction: an option row is one of at most
26 letters of a question, and repeated readings of one letter are merged by a mergeable aggregate.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import letter_at
from ..operators.options import latest_per_option



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _option_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (order, letter): the reading with the highest part, supplier, price wins."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        ((F.col("l_linenumber") - 1) + 7 * (F.col("l_partkey") % 3)).cast("int").alias("ix"),
    )
    return latest_per_option(
        lines,
        keys=("l_orderkey", "ix"),
        order=(
            "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"
        ),
    )


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long option table: key (qid, letter), two answers and six metrics with injected NULLs."""
    # The question key is made first, so that these windows share the exchange with later ones.
    rows = _option_lines(spark, sf_dir).withColumn("qid", F.col("l_orderkey").cast("string"))
    by_question = Window.partitionBy("qid")

    def pick(mix: Column) -> Column:
        return F.max(F.struct(mix.alias("mix"), F.col("ix").alias("ix"))).over(by_question)

    order, part, supplier = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    # One select, so that both are one window.
    picked = rows.select(
        "*",
        pick((part * 31 + supplier * 17) % 101).alias("v"),
        pick((part * 13 + supplier * 7 + order) % 103).alias("g"),
    )
    null = F.lit(None).cast("double")
    return picked.select(
        "qid",
        F.when(order % 2 == 0, "even").otherwise("odd").alias("dataset"),
        letter_at("ix").alias("letter"),
        F.when(order % 41 == 0, "Y").otherwise(letter_at(F.col("v.ix"))).alias("vanilla"),
        F.when(order % 53 == 0, F.lit(None).cast("string"))
        .when(order % 9 == 0, "Z")
        .otherwise(letter_at(F.col("g.ix")))
        .alias("gold"),
        F.when((order % 5 == 0) | (part % 13 == 0), null)
        .when(order % 17 == 3, 0.0)
        .otherwise(F.col("l_quantity") / 50.0)
        .alias("fcm_prob"),
        F.when(part % 11 == 0, null)
        .otherwise(F.col("l_extendedprice") / 100000.0 - 0.5)
        .alias("pmic"),
        F.when(order % 10 == 0, null).otherwise(F.col("l_tax") * 10.0 - 0.4).alias("pmil"),
        F.when(supplier % 7 == 0, null).otherwise(F.col("l_discount") * 20.0).alias("e_letter"),
        (F.col("l_extendedprice") / (F.col("l_quantity") * 1000.0)).alias("e_content"),
        F.when(F.col("l_quantity") >= 25.0, 1.0).otherwise(0.0).alias("icrp_reliable"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One option-prefixed record per question: a map of metrics and three forms of letter
    probabilities, so that every branch of the lookup occurs."""
    rows = options(spark, sf_dir)
    noisy = F.when(F.col("e_content") > 1.5, F.lit(float("nan"))).otherwise(F.col("e_content"))
    readings = {
        "llmc_letter_ce_logpmi": F.col("pmil"),
        "pmil": F.col("pmic"),
        "pmic": F.col("pmic"),
        "llmc_letter_ce_cond": F.col("e_letter"),
        "e_letter": F.col("e_content"),
        "llmc_content_logit_entropy_mean": noisy,
        "e_content": F.col("pmic"),
        "icrp_reliable": F.col("icrp_reliable"),
    }
    pairs = F.array(
        *[
            F.struct(F.concat("letter", F.lit(f"_{name}")).alias("k"), value.alias("v"))
            for name, value in readings.items()
        ]
    )
    entry = F.struct(
        "letter", "fcm_prob", F.filter(pairs, lambda e: e.getField("v").isNotNull()).alias("kv")
    )
    grouped = rows.groupBy("qid").agg(
        F.first("dataset").alias("dataset"),
        F.first("gold").alias("gold_letter"),
        F.first("vanilla").alias("model_pred"),
        F.array_sort(
            F.collect_list(entry),
            lambda a, b: F.when(a.getField("letter") < b.getField("letter"), -1).otherwise(1),
        ).alias("entries"),
    )
    key = F.col("qid").cast("bigint")
    entries = F.col("entries")
    probabilities = F.transform(entries, lambda e: e.getField("fcm_prob"))
    names = F.transform(entries, lambda e: e.getField("letter"))
    return grouped.select(
        "qid",
        "dataset",
        "gold_letter",
        F.when(key % 7 == 0, "").otherwise(F.lower("model_pred")).alias("model_pred"),
        F.when(key % 7 == 0, F.concat(F.lit(" "), "model_pred")).alias("pred_letter"),
        F.map_from_entries(
            F.flatten(F.transform(entries, lambda e: e.getField("kv")))
        ).alias("metrics"),
        F.when(key % 3 == 1, F.reverse(probabilities))
        .when(key % 3 == 2, probabilities)
        .alias("fcm_letter_probs"),
        F.when(key % 3 == 1, F.reverse(names)).alias("fcm_prob_letters"),
        F.when(key % 3 == 0, F.map_from_arrays(names, probabilities)).alias("fcm_letter_prob_map"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level predictions with ties, rows at p = 1 and missing confidences."""
    event, value = F.col("event_id"), F.col("value")
    share = value / (value + 50.0)
    return table(spark, sf_dir, "events").select(
        event.alias("row_id"),
        F.when(event % 10 < 7, "calib").otherwise("test").alias("split"),
        ((event * 7919) % 1000 < F.floor(1000.0 * share)).cast("int").alias("y"),
        F.when(event % 499 == 0, 1.0).otherwise(F.round(100.0 * share) / 100.0).alias("p_err"),
        F.when(event % 97 == 0, F.lit(None).cast("double"))
        .otherwise(50.0 / (value + 50.0))
        .alias("p_opt_chosen"),
        (value / 100.0).alias("p_opt_gap"),
    )


def option_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, ix, text): the part name is the text of an option."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return (
        _option_lines(spark, sf_dir)
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select("l_orderkey", "ix", F.col("p_name").alias("text"))
    )


def truthful_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw question rows with `mc1_targets{choices, labels}`, one per order."""
    return (
        option_texts(spark, sf_dir)
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct("ix", "text"))).alias("o"))
        .select(
            F.col("l_orderkey").cast("string").alias("qid"),
            F.concat(
                F.lit("Which part of order "), F.col("l_orderkey").cast("string"), F.lit("?")
            ).alias("question"),
            F.struct(
                F.transform("o", lambda e: e.getField("text")).alias("choices"),
                F.transform(
                    "o",
                    lambda e, i: (
                        i == F.pmod(F.col("l_orderkey") * 7, F.size("o"))
                    ).cast("int"),
                ).alias("labels"),
            ).alias("mc1_targets"),
        )
    )


def open_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw question rows with labelled options, a passage and an answer key, one per order."""
    key = F.col("l_orderkey")
    return (
        option_texts(spark, sf_dir)
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct("ix", "text"))).alias("o"))
        .select(
            key.cast("string").alias("qid"),
            F.transform(
                "o",
                lambda e: F.struct(
                    F.concat(F.lit(" "), F.lower(letter_at(e.getField("ix")))).alias("label"),
                    e.getField("text").alias("text"),
                ),
            ).alias("options"),
            F.when(key % 3 == 0, "-")
            .when(key % 3 == 1, "")
            .otherwise(F.concat(F.lit("Order "), key.cast("string")))
            .alias("passage"),
            F.concat(F.lit("Which part of "), key.cast("string"), F.lit("?")).alias("question"),
            F.when(key % 11 == 0, "  ")
            .otherwise(
                F.concat(F.lower(letter_at(F.get("o", F.pmod(key, F.size("o"))).getField("ix"))),
                         F.lit(" "))
            )
            .alias("answerKey"),
            F.when(key % 2 == 0, "even").alias("dataset"),
        )
    )


def scaled_logits(scale: float = 8.0) -> Column:
    return F.transform("embedding", lambda v: v.cast("double") * scale)


def last_step_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace(qid, step, logits): eight steps per question, some with a non-finite element."""
    vec = F.col("vec_id")
    plain = scaled_logits()
    broken = F.concat(F.array(F.lit(float("nan"))), F.slice(plain, 2, 63))
    infinite = F.concat(F.array(F.lit(float("-inf"))), F.slice(plain, 2, 63))
    return table(spark, sf_dir, "embeddings").select(
        F.floor(vec / 8).cast("bigint").alias("q"),
        F.floor(vec / 8).cast("string").alias("qid"),
        (vec % 8).cast("int").alias("step"),
        F.when(vec % 29 == 7, broken).when(vec % 31 == 5, infinite).otherwise(plain)
        .alias("logits"),
        ((vec * 7) % 64).cast("int").alias("target_id"),
    )


def response_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace(qid, letter, role, pos, logits, target_id, prompt_len, total_len, prefix_len): two
    forward passes per option, five absolute positions each."""
    vec = F.col("vec_id")
    question = F.floor(vec / 40)
    letter_ix = F.floor(vec / 10) % 4
    return table(spark, sf_dir, "embeddings").select(
        question.cast("string").alias("qid"),
        letter_at(letter_ix).alias("letter"),
        F.when(F.floor(vec / 5) % 2 == 0, "cond").otherwise("uncond").alias("role"),
        (vec % 5).cast("int").alias("pos"),
        scaled_logits().alias("logits"),
        ((vec * 7) % 64).cast("int").alias("target_id"),
        ((question + letter_ix) % 3).cast("int").alias("prompt_len"),
        F.lit(5).alias("total_len"),
        F.lit(2).alias("prefix_len"),
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """states(seq, step, layer, vec): five layers, eight steps per sequence."""
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(vec / 40).cast("bigint").alias("seq"),
        (F.floor(vec / 5) % 8).cast("int").alias("step"),
        (vec % 5).cast("int").alias("layer"),
        F.transform("embedding", lambda v: v.cast("double")).alias("vec"),
    )


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attention(seq, step, head, weights, prompt_len): four heads over 16 key positions, taken
    from the vectors of layer 4."""
    vec = F.col("vec_id")
    weights = F.transform("embedding", lambda v: F.abs(v.cast("double")) * 0.6)
    return (
        table(spark, sf_dir, "embeddings")
        .where(vec % 5 == 4)
        .select(
            F.floor(vec / 40).cast("bigint").alias("seq"),
            (F.floor(vec / 5) % 8).cast("int").alias("step"),
            F.posexplode(
                F.array(*[F.slice(weights, 16 * h + 1, 16) for h in range(4)])
            ).alias("head", "weights"),
            (F.lit(6) + F.floor(vec / 40) % 5).cast("int").alias("prompt_len"),
        )
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response texts, some opening with a letter such as ' b) '."""
    turn = F.col("turn")
    key = F.col("conv_id")
    letter = F.lower(letter_at((key + turn) % 5))
    return table(spark, sf_dir, "conversations").select(
        key.alias("conv_id"),
        turn.alias("turn"),
        F.when((key + turn) % 3 == 0, F.concat(F.lit(" "), letter, F.lit(" ) "), "text"))
        .otherwise(F.col("text"))
        .alias("response"),
        F.when(key % 4 == 0, F.lit(None).cast("string"))
        .when(key % 4 == 1, "")
        .otherwise(letter_at(key % 5))
        .alias("gold"),
    )
