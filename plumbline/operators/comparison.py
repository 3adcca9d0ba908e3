"""Detector against baseline: confidence of the baseline, paired metrics, trapezoids."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite
from .metrics import (
    ACCURACY_TARGETS,
    ECE_BINS,
    abstention_thresholds,
    coverage_name,
    curve_summary,
    risk_coverage,
    selective_metrics,
)
from .scan import exact_quantiles, neighbours, ordered_scan

ABSTAIN_TARGETS = (0.05, 0.10, 0.20, 0.30, 0.40)
SPREAD_FLOOR = 1e-12
DETECTOR, BASELINE = "det", "base"


def _numeric(df: DataFrame, name: str) -> Column:
    return (
        finite(F.col(name).cast("double")) if name in df.columns else F.lit(None).cast("double")
    )


def baseline_confidence(df: DataFrame, name: str = "confidence") -> DataFrame:
    """Add the confidence that the chosen option is right: its probability, else the min-max scaled
    gap, else 0; missing values take the median and the result is clamped to [0, 1].

    Three scalars of the table fix the plan; they are read once.
    """
    source = df.withColumn("_c", _numeric(df, "p_opt_chosen")).withColumn(
        "_g", _numeric(df, "p_opt_gap")
    )
    facts = source.agg(
        F.count("_c").alias("n"), F.count("_g").alias("gaps"), F.count(F.lit(1)).alias("rows"),
        F.min("_g").alias("low"), F.max("_g").alias("high"),
    ).first()
    if facts.n > 0:
        value, known = F.col("_c"), facts.n
    elif facts.gaps > 0:
        spread = facts.high - facts.low + SPREAD_FLOOR
        value, known = (F.col("_g") - F.lit(facts.low)) / F.lit(spread), facts.gaps
    else:
        value, known = F.lit(0.0), facts.rows
    valued = source.withColumn("_v", value)
    if known < facts.rows:
        middle = exact_quantiles(valued, "_v", {"mid": 0.5}).first().mid
        valued = valued.withColumn("_v", F.coalesce("_v", F.lit(middle)))
    clamped = F.least(F.greatest(F.col("_v"), F.lit(0.0)), F.lit(1.0))
    return valued.select(*df.columns, clamped.alias(name))


def paired_systems(
    df: DataFrame, p: str = "p_err", y: str = "y", row_id: str = "row_id"
) -> DataFrame:
    """Long form (system, row_id, y, p): the detector score and 1 - baseline confidence."""
    both = baseline_confidence(df, "_confidence").select(
        F.col(row_id).alias("row_id"),
        F.col(y).alias("y"),
        F.array(
            F.struct(F.lit(DETECTOR).alias("system"), F.col(p).cast("double").alias("p")),
            F.struct(F.lit(BASELINE).alias("system"), (1.0 - F.col("_confidence")).alias("p")),
        ).alias("_systems"),
    )
    return both.select("row_id", "y", F.inline("_systems"))


def _side(column: str, system: str) -> Column:
    return F.max(F.when(F.col("system") == system, F.col(column)))


def abstention_comparison(
    test: DataFrame,
    calib: DataFrame,
    targets: Sequence[float] = ABSTAIN_TARGETS,
    bins: int = ECE_BINS,
) -> DataFrame:
    """One row per abstention target; thresholds come from `calib`, metrics from `test`.

    Both inputs are long (system, y, p).
    """
    taus = abstention_thresholds(calib, targets, "p", ["system"])
    kept = selective_metrics(test, taus, "p", "y", bins, ["system"])
    pairs = {
        "tau": "tau",
        "coverage": "coverage",
        "selective_acc": "selective_accuracy",
        "kept_err": "kept_error",
        "brier_kept": "brier_kept",
        "ece_kept": "ece_kept",
    }
    wide = kept.groupBy(F.col("target").alias("abstain_target")).agg(
        *[
            _side(column, system).alias(
                f"{name}_{system}" + ("(Perr)" if name == "ece_kept" else "")
            )
            for name, column in pairs.items()
            for system in (DETECTOR, BASELINE)
        ]
    )
    reduction = F.col("kept_err_base") - F.col("kept_err_det")
    return wide.select(
        "*",
        reduction.alias("abs_err_reduction"),
        (100.0 * (reduction / (F.col("kept_err_base") + SPREAD_FLOOR))).alias(
            "rel_err_reduction_%"
        ),
    )


def curve_comparison(
    systems: DataFrame, targets: Sequence[float] = ACCURACY_TARGETS
) -> DataFrame:
    """One row: AURC, AUACC and coverages of both systems, and the gain of the detector."""
    summary = curve_summary(
        risk_coverage(systems, "p", "y", "row_id", ["system"]), ["system"], targets
    )
    # A smaller area under risk is better; for all others a larger value is better.
    names = {"aurc": -1, "auacc": 1, **{coverage_name(t): 1 for t in targets}}
    wide = summary.groupBy().agg(
        *[
            _side(name, system).alias(f"{name}_{system}")
            for name in names
            for system in (DETECTOR, BASELINE)
        ]
    )
    return wide.select(
        "*",
        *[
            (sign * (F.col(f"{name}_det") - F.col(f"{name}_base"))).alias(f"gain_{name}")
            for name, sign in names.items()
        ],
    )


def trapezoid_area(
    df: DataFrame, x: str, y: str, order: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, area): trapezoids between consecutive points in `order`; a single point has area 0
    and a non-finite step in x or value of y makes the area NULL."""
    points = df.select(*keys, *order, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = ordered_scan(points, list(order), keys, rank="_rank")
    stepped = neighbours(ranked, "_rank", {"_x0": ("_x", 1), "_y0": ("_y", 1)}, keys)
    dx = finite(F.col("_x") - F.col("_x0"))
    inner = F.col("_rank") > 1
    area = F.sum(F.when(inner, dx * 0.5 * (F.col("_y") + F.col("_y0"))).otherwise(0.0))
    broken = (inner & dx.isNull()) | finite(F.col("_y")).isNull()
    return stepped.groupBy(*keys).agg(
        F.when(F.count_if(broken) == 0, area).alias("area")
    )
