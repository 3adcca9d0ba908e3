"""Option table, collapse, traces, vectors, prompts and question rows on small fixtures."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import arrays as ar
from plumbline.functions import text as tx
from plumbline.functions.vectorised import change_summary, logit_summary
from plumbline.operators import mcq, options as opt, trace as tr, vectors as vec
from plumbline.operators.collapse import collapse
from plumbline.sources import readers

RECORD = (
    "qid STRING, dataset STRING, gold_letter STRING, pred_letter STRING, model_pred STRING, "
    "metrics MAP<STRING, DOUBLE>, fcm_letter_probs ARRAY<DOUBLE>, fcm_prob_letters ARRAY<STRING>, "
    "fcm_letter_prob_map MAP<STRING, DOUBLE>"
)
VALUES = {
    "pmil": (0.1, 0.2, 0.9, 0.0), "pmic": (0.3, 0.4, 0.7, 0.4), "e_letter": (2.0, 1.2, 0.8, 1.5),
    "e_content": (2.5, 1.0, 0.7, 1.6), "icrp_reliable": (0.1, 0.2, 0.8, 0.3),
}
METRICS = {f"{letter}_{m}": v for m, vs in VALUES.items() for letter, v in zip("ABCD", vs)}


def record(spark, metrics=METRICS, probs=(0.1, 0.2, 0.6, 0.1), names=None, table=None, gold="C",
           pred="C", model=None):
    row = ("q0", "toy", gold, pred, model, metrics, list(probs) if probs else None, names, table)
    return spark.createDataFrame([row], RECORD)


def by_letter(df):
    return {r.letter: r for r in df.collect()}


def test_option_table_ranks_and_gold(spark):
    rows = by_letter(opt.option_table(record(spark)))
    assert list(rows) == list("ABCD")
    assert [rows[x].y_opt for x in "ABCD"] == [0, 0, 1, 0]
    assert (rows["C"].pmil_rank, rows["C"].e_letter_rank, rows["A"].e_letter_rank) == (1, 1, 4)
    assert (rows["B"].pmic_rank, rows["D"].pmic_rank) == (2, 2)
    assert rows["C"].fcm_prob == 0.6 and rows["C"].vanilla == "C"


def test_collapse_of_one_question(spark):
    row = collapse(opt.option_table(record(spark))).first()
    assert (row.p_opt_top, row.p_opt_second) == pytest.approx((0.6, 0.2))
    assert row.p_opt_gap == pytest.approx(0.4)
    assert (row.opt_top_letter, row.p_opt_rank_chosen, row.chosen, row.gold) == ("C", 1.0, "C", "C")
    assert row.delta_pmil_chosen_vs_othermax == pytest.approx(0.7)
    assert row.delta_e_letter_chosen_vs_othermax == pytest.approx(1.2)
    assert row.fcm_mass_gap == pytest.approx(0.4) and row.fcm_letters_coverage == 4.0


def test_supplied_probability_is_scaled(spark):
    rows = spark.createDataFrame(
        [("q", "A", "A", "B", 2.0), ("q", "B", "A", "B", 1.0)],
        "qid STRING, letter STRING, gold STRING, vanilla STRING, p_opt DOUBLE",
    )
    row = collapse(rows).first()
    assert (row.p_opt_top, row.p_opt_chosen) == pytest.approx((2 / 3, 1 / 3))
    assert row.p_opt_rank_chosen == 2.0 and row.opt_top_letter == "A"
    assert row.fcm_top_letter == "" and row.fcm_entropy is None and row.pmic_rank_chosen is None


def test_letter_sources(spark):
    only_map = by_letter(opt.option_table(
        record(spark, {}, None, None, {"b": 0.7, "C": 0.3}, pred="B")))
    assert list(only_map) == ["B", "C"] and only_map["B"].fcm_prob == 0.7
    named = by_letter(opt.option_table(record(spark, {}, (0.5, 0.3, 0.2), ["C", "A", "B"])))
    assert named["C"].fcm_prob == 0.5 and named["B"].fcm_prob == 0.2
    mapped = by_letter(opt.option_table(
        record(spark, METRICS, (0.9, 0.1), ["A", "B"], {"A": 0.1, "B": None, "C": 0.1})))
    # A NULL in the map and a letter missing from an aligned list do not fall through.
    assert mapped["A"].fcm_prob == 0.1 and mapped["B"].fcm_prob is None
    assert mapped["D"].fcm_prob is None
    nothing = by_letter(opt.option_table(record(spark, {}, None)))
    assert list(nothing) == list("ABCD")


def test_alias_and_nan(spark):
    metrics = {"A_llmc_letter_ce_logpmi": float("nan"), "A_pmil": 0.5, "B_pmil": 0.4}
    rows = by_letter(opt.option_table(record(spark, metrics, None)))
    # A present NaN stops the search and then reads as missing.
    assert rows["A"].pmil is None and rows["B"].pmil == 0.4
    with pytest.raises(ValueError):
        opt.require_rows(opt.option_table(record(spark).limit(0)))


def test_latest_reading_wins(spark):
    rows = spark.createDataFrame(
        [("q", "A", 1, 0.1), ("q", "A", 3, 0.3), ("q", "A", 2, 0.2), ("q", "B", 1, 0.9)],
        "qid STRING, letter STRING, at INT, v DOUBLE")
    got = {r.letter: r.v for r in opt.latest_per_option(rows, ["qid", "letter"], ["at"]).collect()}
    assert got == {"A": 0.3, "B": 0.9}


LOGITS = [[2.0, 1.0, 0.0, -1.0], [0.0, 0.0, 0.0, 0.0], [1.0, 3.0, 0.0, -2.0]]


def trace(spark, logits=LOGITS, targets=(0, 1, 1)):
    rows = [("q", i, x, t) for i, (x, t) in enumerate(zip(logits, targets))]
    return spark.createDataFrame(rows, "qid STRING, step INT, logits ARRAY<DOUBLE>, target_id INT")


def test_step_statistics(spark):
    rows = tr.step_statistics(trace(spark)).orderBy("step").collect()
    assert [r.logprob for r in rows] == pytest.approx(
        [-0.4401896985611953, -1.3862943611198906, -0.17551536261671444], abs=1e-12)
    assert [r.entropy for r in rows] == pytest.approx(
        [0.9475369639754255, math.log(4), 0.5561988261936499], abs=1e-12)
    assert [r.margin for r in rows] == [1.0, 0.0, 2.0]
    assert [r.maxprob for r in rows] == pytest.approx(
        [0.6439142598879724, 0.25, 0.8390245074625321], abs=1e-12)
    with pytest.raises(Exception, match="no target"):
        tr.step_statistics(trace(spark, targets=(0, None, 1))).collect()


def test_large_logits_and_short_vectors(spark):
    rows = tr.step_statistics(trace(spark, [[1000.0, 0.0], [5.0]], (0, 0))).orderBy("step").collect()
    assert rows[0].logprob == 0.0 and rows[0].entropy == pytest.approx(0.0)
    assert rows[1].margin is None and rows[1].maxprob == 1.0
    soft = trace(spark, [[], [0.0, 0.0]], (0, 0)).select(ar.softmax("logits").alias("p"))
    assert sorted(r.p for r in soft.collect()) == [[], [0.5, 0.5]]


def test_reductions_against_numpy(spark):
    """Ragged, empty, NULL and broken vectors in one batch."""
    rng = np.random.default_rng(5)
    vectors = [(rng.normal(size=n) * 9).tolist() for n in (1, 2, 7, 300)]
    vectors += [[], None, [1.0, float("nan")], [3.0, 3.0], [float("-inf"), 0.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "i INT, v ARRAY<DOUBLE>").coalesce(1)
    rows = {r.i: r.s for r in df.select("i", logit_summary("v", 2.0).alias("s")).collect()}
    for i, v in enumerate(vectors[:4]):
        x = np.array(v) / 2.0
        p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        assert rows[i].entropy == pytest.approx(-(p * np.log(p)).sum(), abs=1e-12)
        assert rows[i].clamped_entropy == pytest.approx(-(p * np.log(np.maximum(p, 1e-10))).sum())
        assert rows[i].maxprob == pytest.approx(p.max()) and rows[i].finite
        top = sorted(v)[-2:]
        assert math.isnan(rows[i].margin) if len(v) == 1 else rows[i].margin == pytest.approx(
            top[1] - top[0])
    assert rows[4].peak is None and rows[5].finite is None
    assert not rows[6].finite and math.isnan(rows[6].entropy)
    assert rows[7].margin == 0.0
    assert not rows[8].finite and rows[8].margin == 1.0 and math.isnan(rows[8].entropy)


def test_changes_against_numpy(spark):
    rng = np.random.default_rng(6)
    rows = [(i, *rng.normal(size=(3, 2 + i)).tolist()) for i in range(4)]
    rows += [(4, [1.0], [2.0], None), (5, [1.0], None, None), (6, [1.0], [1.0], [1.0])]
    df = spark.createDataFrame(rows, "i INT, a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, c ARRAY<DOUBLE>")
    got = {r.i: r.s for r in df.coalesce(1).select(
        "i", change_summary("a", "b", "c").alias("s")).collect()}
    for i, a, b, c in rows[:4]:
        d, e = np.subtract(a, b), np.subtract(b, c)
        assert got[i].norm == pytest.approx(np.linalg.norm(d))
        assert got[i].cosine == pytest.approx(d @ e / np.linalg.norm(d) / np.linalg.norm(e))
    assert got[4].norm == 1.0 and got[4].cosine is None
    assert got[5].norm is None and (got[6].norm, got[6].cosine) == (0.0, 0.0)


def features(spark, logits, gold, ids=None):
    examples = spark.createDataFrame([("q", "d", gold)], "qid STRING, dataset STRING, gold_letter STRING")
    ids = ids or {"A": 0, "B": 1, "C": 2, "D": 3}
    return tr.feature_rows(examples, trace(spark, logits, [0] * len(logits)), ids).first()


def test_feature_rows(spark):
    row = features(spark, LOGITS, "b")
    assert (row.T, row.V, row.pred_letter, row.is_error) == (3, 4, "B", 0)
    assert features(spark, LOGITS, "C").is_error == 1
    assert features(spark, LOGITS, None).is_error is None
    assert row.p_A + row.p_B + row.p_C + row.p_D == pytest.approx(1.0)
    assert features(spark, [[0.0] * 4], "A").pred_letter == "A"
    partial = features(spark, LOGITS, "A", {"A": 0, "Z": 9})
    assert partial.pred_letter == "A" and partial.p_Z is None


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_broken_last_step(spark, bad):
    row = features(spark, LOGITS[:2] + [[bad, 1.0, 0.0, 0.0]], "A")
    assert (row.pred_letter, row.is_error, row.p_A) == ("", None, None)
    assert row.ent_mean == pytest.approx((0.9475369639754255 + math.log(4)) / 2)
    empty = features(spark, [], "A")
    assert (empty.T, empty.V, empty.pred_letter, empty.ent_mean) == (0, 0, "", None)


def test_response_region_and_evidence(spark):
    rows = [("q", "A", role, pos, LOGITS[pos % 3], pos % 4, 2, 5, 2)
            for role in ("cond", "uncond") for pos in range(5)]
    table = spark.createDataFrame(
        rows, "qid STRING, letter STRING, role STRING, pos INT, logits ARRAY<DOUBLE>, "
        "target_id INT, prompt_len INT, total_len INT, prefix_len INT")
    region = tr.response_region(table)
    assert sorted(r.pos for r in region.where("role = 'cond'").collect()) == [1, 2, 3]
    row = tr.option_evidence(region, "letter").first()
    assert row.llmc_letter_ce_cond == pytest.approx(math.log(4))
    assert row.llmc_letter_ce_logpmi == pytest.approx(0.0) and row.llmc_letter_span_len == 1
    short = tr.option_evidence(region.withColumn("avail_len", F.lit(1)), "content", "all").first()
    assert short.llmc_content_ce_uncond is None and short.llmc_content_ce_logpmi is None
    with pytest.raises(Exception, match="empty response"):
        tr.response_region(table.withColumn("total_len", F.lit(2))).select("resp_len").collect()
    with pytest.raises(ValueError):
        tr.span_bounds("letter", 0)


def test_pearson_guard(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 3.0), (3.0, 6.0, 3.0)],
                               "x DOUBLE, y DOUBLE, z DOUBLE")
    row = df.agg(vec.guarded_pearson("x", "y").alias("a"), vec.guarded_pearson("x", "z").alias("b"))
    assert row.first().a == pytest.approx(1.0) and row.first().b is None


def test_layer_choice():
    assert vec.pick_layers(12) == [8, 9, 10, 11]
    assert vec.pick_layers(3, (-9, 1)) == [1, 2]
    assert vec.pick_layers(1, ()) == [0, 0]


def test_short_sequences(spark):
    rows = [("s", 0, layer, [float(layer), 1.0]) for layer in range(2)]
    states = spark.createDataFrame(rows, "seq STRING, step INT, layer INT, vec ARRAY<DOUBLE>")
    row = vec.sequence_features(vec.step_series(states)).first()
    assert row.icrp_resp_len == 1 and row.icrp_reliable == 0
    assert row.icrp_time_delta_mean is None and row.icrp_interlayer_cos_mean is None
    # Only the two series that always exist: three numbers each, the spread undefined.
    assert row.icrp_pool_vec[:3] == [1.0, 0.0, 1.0] and len(row.icrp_pool_vec) == 6
    assert all(math.isnan(v) for v in row.icrp_pool_vec[3:])


def test_gap_and_gini(spark):
    df = spark.createDataFrame([([5.0, 1.0, 1.0],), ([None, 2.0],), ([None],), ([0.0, 0.0],)],
                               "v ARRAY<DOUBLE>")
    rows = df.select(ar.top2_gap("v").alias("g"), ar.sorted_gini("v").alias("s")).collect()
    assert [r.g for r in rows] == [4.0, 2.0, None, 0.0]
    assert rows[1].s == pytest.approx(0.0) and rows[2].s is None and rows[3].s is None


def test_question_rows(spark):
    raw = spark.createDataFrame(
        [("0", "Q?", (["x", "y", "z"], [0, 1, 0]))],
        "qid STRING, question STRING, mc1_targets STRUCT<choices: ARRAY<STRING>, labels: ARRAY<INT>>")
    plain = mcq.from_truthful(raw).first()
    assert plain.gold_letter == "B" and [o.label for o in plain.options] == list("ABC")
    for seed in range(6):
        moved = mcq.from_truthful(raw, True, seed).first()
        assert sorted(o.text for o in moved.options) == ["x", "y", "z"]
        assert dict((o.label, o.text) for o in moved.options)[moved.gold_letter] == "y"
        assert moved == mcq.from_truthful(raw, True, seed).first()
    with pytest.raises(Exception, match="no correct choice"):
        mcq.from_truthful(
            raw.withColumn("mc1_targets", F.struct(
                F.array(F.lit("x")).alias("choices"), F.array(F.lit(0)).alias("labels")))).collect()


def test_prompts(spark):
    df = spark.createDataFrame([(" b ", "β", "Q", None)], "l STRING, t STRING, q STRING, n STRING")
    row = df.select(
        tx.option_line("l", "t").alias("line"), tx.option_line("n", "t").alias("empty"),
        tx.question_prompt("q").alias("only"), tx.with_text(tx.answer_prompt(), F.col("n")).alias("u"),
        tx.slug(F.lit("  a//b  c--")).alias("slug"),
    ).first()
    assert row.line == "B) β" and row.empty == "A) β"
    assert row.only == "You are a helpful, factual assistant.\n\nQuestion: Q\nAnswer:"
    assert row.u == "You are a helpful, factual assistant.\n\nAnswer: " and row.slug == "a-b-c"


def test_source_names():
    assert readers.pick_source(" TQA ") is readers.read_truthful
    assert readers.pick_source("openllm") is readers.read_open
    with pytest.raises(ValueError):
        readers.pick_source("other")
