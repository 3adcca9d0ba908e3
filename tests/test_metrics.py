"""Golden values and edge cases of the evaluation metrics."""
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.scalars import equal_width_bin, harmonic
from plumbline.operators import comparison as cmp
from plumbline.operators import metrics as met
from plumbline.operators import bootstrap as boot
from plumbline.operators.bootstrap import bootstrap_ci, keyed_cells, replicate_metrics, resampled_cells

Y = [0, 1, 0, 1, 0, 0, 1, 1, 0, 1]
P = [0.1, 0.8, 0.2, 0.7, 0.3, 0.4, 0.6, 0.9, 0.05, 0.55]


def scores(spark, y=Y, p=P):
    return spark.createDataFrame(
        [(i, int(a), None if b is None else float(b)) for i, (a, b) in enumerate(zip(y, p))],
        "row_id BIGINT, y INT, p DOUBLE",
    )


def summary(spark, y, p, targets=(0.8, 0.9999)):
    return met.curve_summary(met.risk_coverage(scores(spark, y, p)), targets=targets).first()


def test_ece_golden(spark):
    assert met.ece(scores(spark)).first().ece == pytest.approx(0.25, abs=1e-12)
    empty = met.ece(scores(spark).limit(0)).first().ece
    assert empty is None


def test_reliability_golden(spark):
    rows = met.reliability_table(scores(spark), bins=4).orderBy("p_lo").collect()
    assert [r.n for r in rows] == [3, 2, 3, 2]
    assert [r["p_mean(Perr)"] for r in rows] == pytest.approx([0.35 / 3, 0.35, 1.85 / 3, 0.85])
    assert [r.err_rate for r in rows] == [0.0, 0.0, 1.0, 1.0]


def test_curve_golden(spark):
    row = summary(spark, Y, P)
    assert row.aurc == pytest.approx(0.1521825396825397, abs=1e-12)
    assert row.auacc == pytest.approx(0.8478174603174603, abs=1e-12)
    assert (row[met.coverage_name(0.8)], row[met.coverage_name(0.9999)]) == (0.6, 0.5)
    curve = met.risk_coverage(scores(spark))
    assert curve.where(F.abs(F.col("risk") + F.col("acc") - 1) > 1e-12).count() == 0


@pytest.mark.parametrize("label, aurc", [(0, 0.0), (1, 1 - 1 / 16)])
def test_one_class_curve(spark, label, aurc):
    p = list(np.linspace(0.1, 0.9, 8))
    assert summary(spark, [label] * 8, p).aurc == pytest.approx(aurc, abs=1e-12)


def test_bins_at_edges(spark):
    values = [i / 15 for i in range(16)] + [0.0, 1.0, -0.1, 1.1, None, float("nan")]
    for bins in (3, 12, 15, 100):
        rows = spark.createDataFrame([(v,) for v in values], "p DOUBLE").select(
            "p", equal_width_bin("p", bins).alias("b"),
            equal_width_bin("p", bins, closed_last=True).alias("c"),
        ).collect()
        edges = np.arange(bins + 1) * (1.0 / bins)
        for r in rows:
            inside = r.p is not None and 0 <= r.p < 1
            expected = int(np.digitize(r.p, edges[:bins])) - 1 if inside else None
            assert r.b == expected
            assert r.c == (bins - 1 if r.p == 1.0 else expected)


def test_ranking_with_ties(spark):
    y, p = [0, 0, 1, 1, 1, 0], [0.1, 0.4, 0.4, 0.8, 0.4, 0.9]
    row = met.ranking_from_cells(met.score_cells(scores(spark, y, p))).first()
    pairs = [(a, b) for a, la in zip(p, y) if la for b, lb in zip(p, y) if not lb]
    assert row.auroc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))
    assert row.auprc == pytest.approx(0 * 0 + 1 / 3 * (1 / 2) + 2 / 3 * (3 / 5))
    one = met.ranking_from_cells(met.score_cells(scores(spark, [0, 0], [0.1, 0.2]))).first()
    assert (one.auroc, one.auprc) == (None, 0.0)


def test_nearest_threshold(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 40, 101) / 40
    targets = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
    taus = met.abstention_thresholds(scores(spark, [0] * 101, values), targets)
    for r in taus.collect():
        assert r.tau == np.quantile(values, 1.0 - r.target, method="nearest")


@pytest.mark.parametrize("missing", [None, float("nan")])
def test_no_threshold_where_a_score_is_missing(spark, missing):
    rows = [("a", 0, 0.1), ("a", 1, 0.4), ("b", 0, 0.2), ("b", 1, missing)]
    df = spark.createDataFrame(rows, "k STRING, y INT, p DOUBLE")
    got = {r.k: r.tau for r in met.abstention_thresholds(df, (0.5,), keys=["k"]).collect()}
    assert got == {"a": pytest.approx(0.1), "b": None}
    assert [r.tau for r in met.abstention_thresholds(df, (0.5,)).collect()] == [None]
    assert [r.tau for r in met.abstention_thresholds(df.where("k = 'a'"), (0.0,)).collect()] == [0.4]


def test_abstention_without_kept_rows(spark):
    taus = spark.createDataFrame([(0.5, 0.0), (0.1, 2.0)], "target DOUBLE, tau DOUBLE")
    rows = {r.target: r for r in met.abstention_metrics(
        scores(spark, Y + [1], P + [None]), taus).collect()}
    assert rows[0.5].coverage == 0.0 and rows[0.5].kept_error is None
    assert rows[0.5].abstention_recall == 1.0
    assert rows[0.1].coverage == 1.0 and rows[0.1].abstention_precision is None
    assert rows[0.1].kept_error == 0.5 and rows[0.1].unscored == 1


def test_trapezoid(spark):
    points = spark.createDataFrame([(i, i / 10, i / 10) for i in range(11)],
                                   "i INT, x DOUBLE, y DOUBLE")
    assert cmp.trapezoid_area(points, "x", "y", ["i"]).first().area == pytest.approx(0.5)
    broken = points.withColumn("x", F.when(F.col("i") == 4, float("inf")).otherwise(F.col("x")))
    assert cmp.trapezoid_area(broken, "x", "y", ["i"]).first().area is None


def test_baseline_fallbacks(spark):
    rows = spark.createDataFrame([(1, 0.2), (2, 0.6), (3, None)], "qid INT, p_opt_gap DOUBLE")
    values = {r.qid: r.confidence for r in cmp.baseline_confidence(rows).collect()}
    assert values[1] == 0.0 and values[2] == pytest.approx(1.0) and values[3] == pytest.approx(0.5)
    bare = cmp.baseline_confidence(rows.select("qid")).collect()
    assert [r.confidence for r in bare] == [0.0, 0.0, 0.0]


def test_harmonic_numbers(spark):
    ns = [0, 1, 2, 19, 20, 21, 1000, 10**6]
    rows = spark.createDataFrame([(n,) for n in ns], "n BIGINT").select("n", harmonic("n").alias("h"))
    for r in rows.collect():
        assert r.h == pytest.approx(math.fsum(1 / i for i in range(1, r.n + 1)), abs=1e-13)


def test_bootstrap(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(200), 2)
    y = (rng.random(200) < p).astype(int)
    table = scores(spark, y, p)
    first = bootstrap_ci(table, ("aurc", "auroc"), 30, 0.1, 7).collect()
    again = bootstrap_ci(table, ("aurc", "auroc"), 30, 0.1, 7).collect()
    assert first == again
    assert all(r.lo <= r.point <= r.hi for r in first)
    assert first[0].point == pytest.approx(summary(spark, y, p).aurc)
    cells = met.score_cells(table)
    sizes = resampled_cells(cells, 5, 7).groupBy("replicate").agg(
        F.sum("n0").alias("a"), F.sum("n1").alias("b")).collect()
    assert {(r.a, r.b) for r in sizes} == {(200 - y.sum(), y.sum())}


@pytest.mark.parametrize("ties", [False, True])
def test_replicate_metrics_equal_those_of_their_counts(spark, ties):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(300), 1 if ties else 6)
    cells = met.score_cells(scores(spark, (rng.random(300) < p).astype(int), p))
    drawn = resampled_cells(cells, 12, 5)
    want = {r.replicate: r for r in met.merge_metrics(
        [met.aurc_from_cells(drawn, ["replicate"]), met.ranking_from_cells(drawn, ["replicate"])], ["replicate"]).collect()}
    got = replicate_metrics(cells, 12, 5).collect()
    assert len(got) == 12
    for r in got:
        for m in ("aurc", "auacc", "auroc", "auprc"):
            assert r[m] == pytest.approx(want[r.replicate][m], rel=1e-9)


def test_intervals_agree_with_drawn_rows(spark):
    rng = np.random.default_rng(8)
    p = np.round(rng.random(400), 3)
    y = (rng.random(400) < 0.2 + 0.6 * p).astype(int)

    def auroc(yy, pp):
        a, b = pp[yy == 1], pp[yy == 0]
        return np.mean((a[:, None] > b) + 0.5 * (a[:, None] == b))

    sides = [np.flatnonzero(y == k) for k in (0, 1)]
    plain = []
    for _ in range(600):
        s = np.concatenate([rng.choice(i, len(i)) for i in sides])
        plain.append(auroc(y[s], p[s]))
    got = bootstrap_ci(scores(spark, y, p), ("auroc",), 1000, 0.1, 3).first()
    spread = np.std(plain)
    assert got.point == pytest.approx(auroc(y, p))
    assert abs(got.lo - np.quantile(plain, 0.05)) < 0.3 * spread and abs(got.hi - np.quantile(plain, 0.95)) < 0.3 * spread


def test_bootstrap_of_one_class_and_own_metric(spark):
    one = bootstrap_ci(scores(spark, [0] * 6, P[:6]), ("aurc",), 5).first()
    assert (one.lo, one.hi, one.point) == (None, None, 0.0)

    def mean_p(cells, keys):
        n = F.col("n0") + F.col("n1")
        return cells.groupBy(*keys).agg((F.sum(n * F.col("p")) / F.sum(n)).alias("mean_p"))

    own = bootstrap_ci(scores(spark), ("mean_p",), 20, builders={"mean_p": mean_p}).first()
    assert own.point == pytest.approx(np.mean(P)) and own.lo <= own.point <= own.hi


def test_keyed_resamples_are_named_by_md5(spark, monkeypatch):
    """Ties, several blocks of drawing rows, and more distinct scores than every task may know."""
    rng = np.random.default_rng(4)
    p, y = np.round(rng.random(90), 1), rng.integers(0, 2, 90)
    want = {}
    for b in range(6):
        for k in range(2):
            own = np.sort(p[y == k])
            for slot in range(len(own)):
                text = f"7|{b}|{k}|{slot}"
                at = int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % len(own)
                want.setdefault((b, own[at]), [0, 0])[k] += 1
    cells = met.score_cells(scores(spark, y, p)).cache()
    monkeypatch.setattr(boot, "DRAW_ROWS", 16)
    for most in (1 << 16, 3):
        monkeypatch.setattr(boot, "MOST_CELLS", most)
        got = {(r.replicate, r.p): [r.n0, r.n1] for r in keyed_cells(cells, 6, 7).collect()}
        assert got == want
    one = bootstrap_ci(scores(spark, [0] * 6, P[:6]), ("auroc",), 5, keyed=True).first()
    assert (one.lo, one.hi) == (None, None)


def test_bootstrap_query_returns_its_intervals(spark, tmp_path):
    from plumbline.plans.checks_metrics import ORACLES, bootstrap

    rows = [(k, float((k * 37) % 101)) for k in range(300)]
    spark.createDataFrame(rows, "event_id BIGINT, value DOUBLE").write.parquet(str(tmp_path / "events.parquet"))
    got = bootstrap(spark, str(tmp_path))
    assert {"lo", "hi", "point"} <= set(got.columns)
    assert "range(1000)" in ORACLES["bootstrap"]
    assert all(r.lo < r.hi for r in got.collect())


def test_abstention_against_single_targets(spark):
    """Equal thresholds, scores that equal one, rows without a score, a target without a threshold."""
    rng = np.random.default_rng(11)
    rows = [
        ("ab"[i % 7 == 0], int(rng.integers(0, 2)), None if i % 13 == 0 else round(float(rng.random()), 1))
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "k STRING, y INT, p DOUBLE")
    taus = [(0.1, 0.5), (0.2, 0.5), (0.3, 0.0), (0.4, 2.0), (0.5, 0.3), (0.6, None)]
    thresholds = spark.createDataFrame([(k, *t) for k in "ab" for t in taus], "k STRING, target DOUBLE, tau DOUBLE")
    for keys, table, source in (
        (["k"], thresholds, df), ([], thresholds.where("k = 'a'").drop("k"), df.where("k = 'a'"))
    ):
        got = met.abstention_metrics(source, table, keys=keys).collect()
        assert len(got) == len(taus) * (2 if keys else 1)
        for r in got:
            mine = [(y, p) for k, y, p in rows if k == (r.k if keys else "a")]
            known = [(y, p) for y, p in mine if p is not None] if r.tau is not None else []
            kept = [(y, p) for y, p in known if p < r.tau]
            held = [(y, p) for y, p in known if p >= r.tau]
            assert r.unscored == len(mine) - len(known)
            assert r.coverage == (pytest.approx(len(kept) / len(known)) if known else None)
            assert r.kept_error == (pytest.approx(np.mean([y for y, _ in kept])) if kept else None)
            assert r.brier_kept == (pytest.approx(np.mean([(p - y) ** 2 for y, p in kept])) if kept else None)
            assert r.abstention_precision == (pytest.approx(np.mean([y for y, _ in held])) if held else None)
