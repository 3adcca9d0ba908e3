"""Ordered scans against brute force, with one group that holds most of the rows."""
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import scan


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 6000
    key = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 200, n))
    frame = pd.DataFrame({
        "k": key, "v": np.round(rng.normal(size=n), 2), "i": np.arange(n),
        "w": rng.integers(0, 3, n),
    })
    return frame, spark.createDataFrame(frame)


def test_ordered_scan(skewed):
    frame, df = skewed
    got = scan.ordered_scan(df, ["v", "i"], ["k"], {"s": "w"}).toPandas().sort_values("i")
    ordered = frame.sort_values(["k", "v", "i"])
    ordered["rank"] = ordered.groupby("k").cumcount() + 1
    ordered["s"] = ordered.groupby("k")["w"].cumsum()
    ordered["rank_total"] = ordered.groupby("k")["k"].transform("size")
    ordered["s_total"] = ordered.groupby("k")["w"].transform("sum")
    ordered = ordered.sort_values("i")
    for c in ("rank", "s", "rank_total", "s_total"):
        assert (got[c].to_numpy() == ordered[c].to_numpy()).all(), c


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_running_sums_of_missing_values(spark, batch):
    """Numbers that are not there, NaN and text keys, and Arrow batches that end anywhere."""
    rng = np.random.default_rng(2)
    rows = [
        ("ab"[i % 2], float("nan") if i % 5 == 0 else float(i % 5), i,
         None if rng.random() < 0.5 or i < 40 else int(rng.integers(-9, 9)), float(rng.normal()))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "k STRING, x DOUBLE, i INT, w INT, v DOUBLE")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = scan.ordered_scan(df, ["i"], ["k", "x"], {"s": "w", "t": "v"}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    groups = {}
    for r in sorted(got, key=lambda r: r.i):
        groups.setdefault((r.k, repr(r.x)), []).append(r)
    for members in groups.values():
        known = [r.w for r in members if r.w is not None]
        for place, r in enumerate(members):
            upto = [m.w for m in members[: place + 1] if m.w is not None]
            assert (r["rank"], r.rank_total, r.s_total) == (place + 1, len(members), sum(known))
            assert r.s == (sum(upto) if upto else None)
            assert r.t == pytest.approx(sum(m.v for m in members[: place + 1]), abs=1e-12)


def test_scan_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k STRING, i INT, w INT")
    for keys in ([], ["k"]):
        got = scan.ordered_scan(df, ["i"], keys, {"s": "w"})
        assert got.columns == ["k", "i", "w", "rank", "rank_total", "s", "s_total"] and not got.count()


def test_rows_cross_one_exchange(spark, skewed, monkeypatch):
    _, df = skewed
    plans = []
    original = scan.checkpointed

    def spy(table):
        plans.append(table._jdf.queryExecution().executedPlan().toString())
        return original(table)

    monkeypatch.setattr(scan, "checkpointed", spy)
    for keys in ([], ["k"]):
        del plans[:]
        final = scan.ordered_scan(df, ["v", "i"], keys, {"s": "w"})
        final = final._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"[-:] Exchange rangepartitioning", plans[0])) == 1
        assert len(re.findall(r"[-:] Exchange\b", plans[0])) == 1
        # The rows meet the offsets where they are read: only those of the offsets lie below a broadcast.
        rows, offsets = final.split("BroadcastExchange")
        assert not re.search(r"[-:] Exchange\b", rows) and "SortMergeJoin" not in final


def test_hot_group_spreads(spark, skewed, monkeypatch):
    """The group with 70 % of the rows is cut at partition borders."""
    _, df = skewed
    seen = {}
    original = scan.checkpointed

    def spy(placed):
        table = original(placed)
        if not seen:  # the rows; the offsets come later
            seen["pieces"] = table.where("k = 0").select("_piece").distinct().count()
            seen["largest"] = table.groupBy("_piece").count().agg(F.max("count")).first()[0]
        return table

    monkeypatch.setattr(scan, "checkpointed", spy)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scan.ordered_scan(df, ["v", "i"], ["k"]).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen["pieces"] >= 4
    assert seen["largest"] < df.count() / 3


@pytest.mark.parametrize("nearest", [False, True])
def test_exact_quantiles(skewed, nearest):
    frame, df = skewed
    qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = scan.exact_quantiles(df, "v", qs, ["k"], nearest=nearest).toPandas().set_index("k")
    method = "nearest" if nearest else "linear"
    for k, group in frame.groupby("k"):
        for name, q in qs.items():
            assert got.loc[k, name] == pytest.approx(np.quantile(group["v"], q, method=method))


def test_hashed_scan(skewed):
    frame, df = skewed
    a = scan.hashed_scan(df, ["i"], 5, ["k"]).toPandas().sort_values("i")
    b = scan.hashed_scan(df.repartition(3), ["i"], 5, ["k"]).toPandas().sort_values("i")
    assert (a["position"].to_numpy() == b["position"].to_numpy()).all()
    for _, group in a.groupby("k"):
        assert sorted(group["position"]) == list(range(1, len(group) + 1))
        assert (group["stratum_size"] == len(group)).all()
    c = scan.hashed_scan(df, ["i"], 6, ["k"]).toPandas().sort_values("i")
    assert (a["position"].to_numpy() != c["position"].to_numpy()).any()


@pytest.mark.parametrize("block", [4, 7, 4096])
def test_neighbours(spark, block):
    rows = [("a", s, float(s * s)) for s in range(50) if s not in (7, 20, 21)] + [("b", 3, 1.0)]
    df = spark.createDataFrame(rows, "k STRING, step INT, v DOUBLE")
    got = scan.neighbours(df, "step", {"v1": ("v", 1), "v2": ("v", 2)}, ["k"], block).collect()
    known = {(k, s): v for k, s, v in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.v1 == known.get((r.k, r.step - 1))
        assert r.v2 == known.get((r.k, r.step - 2))
