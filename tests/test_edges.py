"""Legal but unusual input: missing labels and targets, white space, more than 26 letters."""
import json
import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import letter_at
from plumbline.operators import boosting, mcq, trace
from plumbline.operators.comparison import trapezoid_area
from plumbline.operators.metrics import ece
from plumbline.operators.scan import hashed_scan
from plumbline.operators.splits import stratified_split
from plumbline.sources import readers


def test_kept_rounds_are_those_of_the_least_validation_loss():
    losses = [5, 4, 4.5, 3, 3.2, 3.1, 2.9, 3.5]
    assert boosting.kept_rounds(losses, 100) == 7
    assert boosting.kept_rounds(losses, 2) == 4
    assert boosting.kept_rounds([1.0], 5) == 1


def test_rows_without_a_label_stay_in_splits(spark):
    rows = spark.createDataFrame([(str(i), None if i % 3 == 0 else i % 2) for i in range(300)], "qid string, y int")
    got = stratified_split(rows, {"test": 0.25, "val": 0.25}).groupBy("y", "split").count().collect()
    sizes = {None: 100, 0: 100, 1: 100}
    want = {(y, part): n // 4 for y, n in sizes.items() for part in ("test", "val")} | {(y, "train"): n // 2 for y, n in sizes.items()}
    assert {(r.y, r.split): r["count"] for r in got} == want
    ranked = hashed_scan(rows, ["qid"], 1337, ["y"])
    assert ranked.count() == 300 and ranked.where("y is null").agg(F.max("position")).first()[0] == 100


def test_split_equals_the_ranked_order(spark):
    rows = spark.createDataFrame([(str(i), i % 2) for i in range(999)], "qid string, y int")
    ranked = {r.qid: r for r in hashed_scan(rows, ["qid"], 5, ["y"]).collect()}
    for r in stratified_split(rows, {"a": 0.1, "b": 0.5}, seed=5).collect():
        place, size = ranked[r.qid].position, ranked[r.qid].stratum_size
        first, second = round(0.1 * size), round(0.1 * size) + round(0.5 * size)
        assert r.split == ("a" if place <= first else "b" if place <= second else "train")
    sample = mcq.sample(rows, 17, ["qid"], 3)
    want = {r.qid for r in hashed_scan(rows, ["qid"], 3).where("position <= 17").collect()}
    assert {r.qid for r in sample.collect()} == want and mcq.sample(rows, 5000).count() == 999


def test_more_than_26_letters_are_an_error(spark):
    assert spark.range(26).select(F.max(letter_at("id"))).first()[0] == "Z"
    with pytest.raises(Exception, match="26 options"):
        spark.range(28).select(F.max(letter_at("id"))).collect()


def test_targets_outside_the_vector(spark):
    rows = [("a", 0, [1.0, 2.0], 1), ("a", 1, [1.0, 2.0], 7), ("b", 0, [1.0, 2.0], 0), ("b", 1, [0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "qid string, step int, logits array<double>, target_id int")
    got = {r.qid: r.nll for r in trace.mean_nll(df).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.3132616875)
    with pytest.raises(Exception, match="no target id"):
        trace.step_statistics(df.where("qid = 'a'")).collect()


def test_generated_letter_after_a_line_feed(spark):
    last = spark.createDataFrame([("q", ["A", "B", "C"], [0.0] * 4, "\n\tc) x")], "qid string, letters array<string>, logits array<double>, gen_text string")
    row = trace.letter_evidence(last, {}).first()
    assert row.pred_letter == "C" and row.fcm_mass_on_letters == 1


def test_trapezoid_without_a_value(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, None), (2, 2.0, 1.0)], "i int, x double, y double")
    assert trapezoid_area(df, "x", "y", ["i"]).first().area is None


def test_unscored_rows_do_not_count(spark):
    df = spark.createDataFrame([(0.2, 0), (0.9, 1), (None, 1)], "p double, y int")
    assert ece(df).first().ece == pytest.approx((0.2 + 0.1) / 2)


def _exports(folder, kind):
    """Three files of records with blank lines, and their questions in path order."""
    want = []
    folder.mkdir()
    for f in range(3):
        out = ["question,mc1_targets"] if kind == "csv" else []
        for i in range(40 + 30 * f):
            text = f"Question {f} {i}, with é and a comma?"
            target = json.dumps({"choices": [f"a{i}", "b"], "labels": [1, 0]})
            if kind == "csv":
                quoted = target.replace('"', '""')
                out.append(f'"{text}","{quoted}"')
            else:
                out.append(json.dumps({"question": text, "mc1_targets": json.loads(target)}))
            want.append(text)
            if i % 17 == 3:
                out.append("  " if i % 2 else "")
        (folder / f"part-{f}.{kind}").write_text("\n".join(out) + "\n")
    return want


@pytest.mark.parametrize("kind", ["json", "csv"])
def test_ordinals_of_text_exports(spark, tmp_path, kind):
    want = _exports(tmp_path / "q", kind)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "2k", "301b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r.qid: r.question for r in readers.read_truthful(spark, str(tmp_path / "q"), kind).select("qid", "question").collect()}
            assert got == {str(i): q for i, q in enumerate(want)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    (tmp_path / "own.json").write_text('{"qid": "x7", "question": "a", "mc1_targets": {"choices": ["a", "b"], "labels": [1, 0]}}\n{"question": "b", "mc1_targets": {"choices": ["a", "b"], "labels": [1, 0]}}\n')
    rows = readers.read_truthful(spark, str(tmp_path / "own.json"), "json").collect()
    assert sorted(r.qid for r in rows) == ["1", "x7"] and all(len(r.options) == 2 for r in rows)
