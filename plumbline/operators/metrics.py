"""Evaluation metrics of a scored table.

A scored table has `y` (1 = error) and a probability column; further key columns (for example a
system or a replicate) evaluate several groups in one pass. All metrics but the risk-coverage curve
depend only on counts per distinct probability (`score_cells`), which combine on the map side.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import equal_width_bin, harmonic
from .scan import exact_quantiles, ordered_scan

ECE_BINS = 15
RELIABILITY_BINS = 12
ACCURACY_TARGETS = (0.80, 0.85, 0.90, 0.95)


def score_cells(df: DataFrame, p: str = "p", y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Correct (`n0`) and wrong (`n1`) rows per distinct probability; rows without one drop out."""
    return (
        df.where(F.col(p).isNotNull())
        .groupBy(*keys, F.col(p).alias("p"))
        .agg(F.count_if(F.col(y) == 0).alias("n0"), F.count_if(F.col(y) == 1).alias("n1"))
    )


def merge_metrics(frames: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Put one-row-per-key metric tables side by side without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


# ---- calibration ----------------------------------------------------------------------------


def bin_sums(
    df: DataFrame, p: str, y: str, bins: int, keys: Sequence[str] = (), closed_last: bool = False
) -> DataFrame:
    """n, sum of p and sum of y per key and equal-width bin; `bin` is NULL outside all bins.

    Rows without a score are left out, here as in every other metric."""
    return (
        df.where(F.col(p).isNotNull())
        .withColumn("bin", equal_width_bin(p, bins, closed_last))
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(p).alias("sum_p"),
            F.sum(y).cast("double").alias("sum_y"),
        )
    )


def ece_from_bins(sums: DataFrame, keys: Sequence[str] = (), name: str = "ece") -> DataFrame:
    """Weighted gap of mean probability and error rate; rows outside all bins count in N only."""
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("sum_y") - F.col("sum_p"))).otherwise(0.0)
    return sums.groupBy(*keys).agg(F.try_divide(F.sum(gap), F.sum("n")).alias(name))


def ece(
    df: DataFrame,
    p: str = "p",
    y: str = "y",
    bins: int = ECE_BINS,
    keys: Sequence[str] = (),
    closed_last: bool = False,
    name: str = "ece",
) -> DataFrame:
    return ece_from_bins(bin_sums(df, p, y, bins, keys, closed_last), keys, name)


def reliability_table(
    df: DataFrame,
    p: str = "p",
    y: str = "y",
    bins: int = RELIABILITY_BINS,
    keys: Sequence[str] = (),
    closed_last: bool = False,
) -> DataFrame:
    """Edges, size, mean probability and error rate of the non-empty bins."""
    width = F.lit(1.0 / bins)
    mean, rate = F.col("sum_p") / F.col("n"), F.col("sum_y") / F.col("n")
    return bin_sums(df, p, y, bins, keys, closed_last).where(F.col("bin").isNotNull()).select(
        *keys,
        (F.col("bin") * width).alias("p_lo"),
        F.when(F.col("bin") == bins - 1, 1.0).otherwise((F.col("bin") + 1) * width).alias("p_hi"),
        "n",
        mean.alias("p_mean(Perr)"),
        rate.alias("err_rate"),
        F.abs(mean - rate).alias("cal_error_abs"),
    )


def reliability_points(table: DataFrame) -> DataFrame:
    """Plot coordinates of a reliability table: bin centre, predicted and observed correctness."""
    return table.select(
        *[c for c in table.columns if c not in RELIABILITY_COLUMNS],
        (0.5 * (F.col("p_lo") + F.col("p_hi"))).alias("bin_centre"),
        (1.0 - F.col("`p_mean(Perr)`")).alias("predicted_correct"),
        (1.0 - F.col("err_rate")).alias("observed_correct"),
        "n",
    )


RELIABILITY_COLUMNS = ("p_lo", "p_hi", "n", "p_mean(Perr)", "err_rate", "cal_error_abs")


# ---- scalar metrics -------------------------------------------------------------------------


def brier_expr(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def brier(
    df: DataFrame, p: str = "p", y: str = "y", keys: Sequence[str] = (), name: str = "brier"
) -> DataFrame:
    return df.groupBy(*keys).agg(brier_expr(F.col(p), F.col(y)).alias(name))


def threshold_metrics(
    df: DataFrame,
    p: str = "p",
    y: str = "y",
    threshold: float = 0.5,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Confusion counts and accuracy when p >= threshold predicts an error."""
    wrong, flagged = F.col(y) == 1, F.col(p) >= threshold
    return df.groupBy(*keys).agg(
        F.lit(float(threshold)).alias("threshold"),
        F.count_if(~wrong & ~flagged).alias("tn"),
        F.count_if(~wrong & flagged).alias("fp"),
        F.count_if(wrong & ~flagged).alias("fn"),
        F.count_if(wrong & flagged).alias("tp"),
        F.avg((wrong == flagged).cast("double")).alias("accuracy"),
    )


def ranking_from_cells(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AUROC with averaged ties and step-wise average precision, from one ordered scan.

    AUROC is NULL when one class is absent; average precision is 0 without any error.
    """
    scanned = ordered_scan(cells, ["p"], keys, {"c0": "n0", "c1": "n1"})
    wrong, right = F.col("n1").cast("double"), F.col("n0").cast("double")
    all_wrong, all_right = F.col("c1_total").cast("double"), F.col("c0_total").cast("double")
    below = F.col("c0") - right
    wrong_above = all_wrong - F.col("c1") + wrong
    right_above = all_right - F.col("c0") + right
    pairs = F.sum(wrong * (below + 0.5 * right))
    precision = F.sum(wrong * F.try_divide(wrong_above, wrong_above + right_above))
    n1, n0 = F.max(all_wrong), F.max(all_right)
    return scanned.groupBy(*keys).agg(
        F.when((n1 > 0) & (n0 > 0), F.try_divide(pairs, n1 * n0)).alias("auroc"),
        F.coalesce(F.try_divide(precision, n1), F.lit(0.0)).alias("auprc"),
    )


def core_metrics(
    df: DataFrame,
    p: str = "p",
    y: str = "y",
    bins: int = ECE_BINS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """AUROC, AUPRC, Brier and ECE per key."""
    cells = score_cells(df, p, y, keys)
    return merge_metrics(
        [ranking_from_cells(cells, keys), brier(df, p, y, keys), ece(df, p, y, bins, keys)], keys
    )


# ---- risk-coverage curve --------------------------------------------------------------------


def risk_coverage(
    df: DataFrame, p: str = "p", y: str = "y", row_id: str = "row_id", keys: Sequence[str] = ()
) -> DataFrame:
    """Prefix curve over ascending p, ties in row order: rank, cov, risk, acc per row."""
    rows = df.where(F.col(p).isNotNull()).select(
        *keys, F.col(p).alias("p"), F.col(row_id).alias("row_id"), F.col(y).alias("y")
    )
    scanned = ordered_scan(rows, ["p", "row_id"], keys, {"errors": "y"})
    risk = F.col("errors").cast("double") / F.col("rank").cast("double")
    return scanned.select(
        *keys,
        "row_id",
        "rank",
        F.col("rank_total").alias("n"),
        (F.col("rank").cast("double") / F.col("rank_total").cast("double")).alias("cov"),
        risk.alias("risk"),
        (1.0 - risk).alias("acc"),
    )


def curve_summary(
    curve: DataFrame,
    keys: Sequence[str] = (),
    targets: Sequence[float] = ACCURACY_TARGETS,
) -> DataFrame:
    """AURC, AUACC and the coverage at each accuracy target, in one aggregate.

    Coverage steps are all 1/N, so the trapezoids from (0, 0) sum to (sum(risk) - last risk / 2) / N,
    and the area under accuracy, which starts at (0, 1), is one minus that.
    """
    n = F.max("n").cast("double")
    last = F.max(F.when(F.col("rank") == F.col("n"), F.col("risk")))
    aurc = F.try_divide(F.sum("risk") - last / 2.0, n)
    return curve.groupBy(*keys).agg(
        aurc.alias("aurc"),
        (1.0 - aurc).alias("auacc"),
        *[
            F.coalesce(F.max(F.when(F.col("acc") >= t, F.col("cov"))), F.lit(0.0)).alias(
                coverage_name(t)
            )
            for t in targets
        ],
    )


def coverage_name(target: float) -> str:
    return f"coverage_at_{round(target * 10000):05d}"


def coverage_at_accuracy(
    curve: DataFrame, targets: Sequence[float] = ACCURACY_TARGETS, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, target, coverage): the largest coverage whose accuracy reaches the target."""
    wide = curve_summary(curve, keys, targets)
    pairs = F.array(
        *[
            F.struct(F.lit(float(t)).alias("target"), F.col(coverage_name(t)).alias("coverage"))
            for t in targets
        ]
    )
    return wide.select(*keys, F.inline(pairs))


def aurc_from_cells(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AURC when the correct rows of a tie come before the wrong ones, from counts alone.

    Over a run of correct rows the prefix errors stay at c, so their risks sum to
    c * (H(after) - H(before)); over a run of wrong rows they sum to the run length minus
    (before - c) times the same difference. H is the harmonic number.
    """
    scanned = ordered_scan(cells, ["p"], keys, {"c0": "n0", "c1": "n1"})
    start = F.col("c0") - F.col("n0") + F.col("c1") - F.col("n1")
    middle, end = start + F.col("n0"), start + F.col("n0") + F.col("n1")
    before = (F.col("c1") - F.col("n1")).cast("double")
    risks = (
        before * (harmonic(middle) - harmonic(start))
        + F.col("n1")
        - (middle - before) * (harmonic(end) - harmonic(middle))
    )
    n = F.max(F.col("c0_total") + F.col("c1_total")).cast("double")
    last = F.max("c1_total") / n
    aurc = (F.sum(risks) - last / 2.0) / n
    return scanned.groupBy(*keys).agg(aurc.alias("aurc"), (1.0 - aurc).alias("auacc"))


# ---- thresholds and abstention --------------------------------------------------------------


def abstention_thresholds(
    df: DataFrame, targets: Sequence[float], p: str = "p", keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, target, tau): the actual score at position rint((n - 1) * (1 - target)).

    A group with a score that is missing or NaN has no position to speak of: its tau is NULL.
    """
    names = {f"tau_{i}": 1.0 - float(t) for i, t in enumerate(targets)}
    wide = exact_quantiles(df, p, names, keys, nearest=True)
    lacking = df.groupBy(*keys).agg(
        F.max(F.col(p).isNull() | F.isnan(F.col(p).cast("double"))).alias("_lacking")
    )
    if keys:
        wide = wide.join(lacking, list(keys))
    else:
        # One number: a join without a key would be a nested loop.
        wide = wide.withColumn("_lacking", F.lit(lacking.first()["_lacking"]).cast("boolean"))
    wide = wide.withColumns({name: F.when(~F.col("_lacking"), F.col(name)) for name in names})
    pairs = F.array(
        *[
            F.struct(F.lit(float(t)).alias("target"), F.col(f"tau_{i}").alias("tau"))
            for i, t in enumerate(targets)
        ]
    )
    return wide.select(*keys, F.inline(pairs))


def abstention_metrics(
    df: DataFrame,
    thresholds: DataFrame,
    p: str = "p",
    y: str = "y",
    bins: int = ECE_BINS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Metrics of answering below and abstaining from `tau` on, per key and target.

    `thresholds` has one row per key and target. A row is not copied for each target: it is counted by how
    many of its key's thresholds it reaches, and the few counts (level, bin) answer all targets. Rows
    without a score are left out of every count and reported as `unscored`, as is every row of a target
    without a threshold.
    """
    base = list(keys)
    targets = thresholds.groupBy(*base).agg(
        F.collect_list(F.struct("target", "tau")).alias("_targets")
    )
    # The thresholds that a score of exactly `tau` reaches, its own and equal ones included.
    reached = F.transform(
        "_targets",
        lambda t: F.struct(
            t["target"].alias("target"),
            t["tau"].alias("tau"),
            F.when(
                t["tau"].isNotNull(), F.size(F.filter("_targets", lambda o: o["tau"] <= t["tau"]))
            ).alias("_reach"),
        ),
    )
    row = None if base else targets.first()

    def with_targets(table: DataFrame) -> DataFrame:
        if base:
            # One row per key: the optimizer broadcasts what it measures to be small.
            return table.join(targets, base)
        # One row in all, a number per target: a join without a key would be a nested loop.
        fixed = row["_targets"] if row else []
        pairs = [F.struct(F.lit(t.target).alias("target"), F.lit(t.tau).alias("tau")) for t in fixed]
        return table.withColumn("_targets", F.array(*pairs).cast(targets.schema["_targets"].dataType))

    levelled = with_targets(df.select(*base, F.col(p).alias("_p"), F.col(y).alias("_y"))).withColumn(
        "_level",
        F.when(F.col("_p").isNotNull(), F.size(F.filter("_targets", lambda t: t["tau"] <= F.col("_p")))),
    )
    counted = (
        levelled.withColumn("_bin", equal_width_bin("_p", bins))
        .groupBy(*base, "_level", "_bin")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("_y").cast("double").alias("_wrong"),
            F.sum("_p").alias("_sum_p"),
            F.sum((F.col("_p") - F.col("_y")) * (F.col("_p") - F.col("_y"))).alias("_square"),
        )
    )
    amounts = ("_n", "_wrong", "_sum_p", "_square")
    group = [*base, "target", "tau"]
    sums = (
        with_targets(counted)
        .select(*base, "_level", "_bin", *amounts, F.inline(reached))
        .groupBy(*group, (F.col("_level") >= F.col("_reach")).alias("_abstain"), "_bin")
        .agg(*[F.sum(c).alias(c) for c in amounts])
    )

    def over(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("double")

    kept, held = ~F.col("_abstain"), F.col("_abstain")
    gap = F.when(
        F.col("_bin").isNotNull(), F.abs(F.col("_wrong") - F.col("_sum_p"))
    ).otherwise(0.0)
    totals = sums.groupBy(*group).agg(
        over(held, F.col("_wrong")).alias("tp"),
        over(held, F.col("_n") - F.col("_wrong")).alias("fp"),
        over(kept, F.col("_wrong")).alias("fn"),
        over(kept, F.col("_n") - F.col("_wrong")).alias("tn"),
        over(kept, F.col("_square")).alias("_square"),
        over(kept, gap).alias("_gap_kept"),
        over(held, gap).alias("_gap_held"),
        over(F.col("_abstain").isNull(), F.col("_n")).cast("bigint").alias("unscored"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n_kept, n_held, n_right = fn + tn, tp + fp, tn + fp
    n = n_kept + n_held
    coverage, kept_error = F.try_divide(n_kept, n), F.try_divide(fn, n_kept)
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return totals.select(
        *group,
        coverage.alias("coverage"),
        (1.0 - coverage).alias("abstain_rate"),
        (1.0 - kept_error).alias("selective_accuracy"),
        kept_error.alias("kept_error"),
        F.try_divide(tp + tn, n).alias("abstention_accuracy"),
        precision.alias("abstention_precision"),
        recall.alias("abstention_recall"),
        F.try_divide(2.0 * precision * recall, precision + recall).alias("abstention_f1"),
        F.try_divide(tn, n_right).alias("benign_answering_rate"),
        F.try_divide(fp, n_right).alias("over_conservativeness"),
        F.try_divide("_square", n_kept).alias("brier_kept"),
        F.try_divide("_gap_kept", n_kept).alias("abstain_ece_kept"),
        F.try_divide("_gap_held", n_held).alias("abstain_ece_abstained"),
        "unscored",
    )


SELECTIVE_COLUMNS: Mapping[str, str] = {
    "coverage": "coverage",
    "selective_accuracy": "selective_accuracy",
    "kept_error": "kept_error",
    "brier_kept": "brier_kept",
    "abstain_ece_kept": "ece_kept",
}


def selective_metrics(
    df: DataFrame,
    thresholds: DataFrame,
    p: str = "p",
    y: str = "y",
    bins: int = ECE_BINS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Coverage and quality of the kept rows only (p < tau)."""
    full = abstention_metrics(df, thresholds, p, y, bins, keys)
    return full.select(
        *keys,
        "target",
        "tau",
        *[F.col(source).alias(name) for source, name in SELECTIVE_COLUMNS.items()],
    )
