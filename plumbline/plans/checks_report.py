"""Registered queries that read back whole files of the evaluation report."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as met
from ..session import checkpoint_dir
from . import fixtures
from .checks_metrics import (
    AREAS, COMPARE_SQL, COVERAGES, COVERED, DET, ECE_BINS, REL_BINS, SYSTEMS, TARGETS,
    _abstention, _bins, _curve_sql, _kept_sql, _side_sql, _tau_sql,
)
from .fixture_sql import SCORED
from .report import generate_report, selective_summary
from .rounding import q6, r6, r6s

BOTH = (("detector", "det"), ("vanilla", "base"))
CHANGED = {
    "ece_kept_det(Perr)": "ece_kept_det",
    "ece_kept_base(Perr)": "ece_kept_base",
    "rel_err_reduction_%": "rel_err_reduction_pct",
}


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/check-{uuid.uuid4().hex}"


def _report(spark: SparkSession, sf_dir: str, calibrated: bool = True, **options) -> str:
    """Write the report of the scored test rows; the folder and prefix of its files."""
    rows = fixtures.scored(spark, sf_dir).select(
        F.col("row_id").alias("qid"), "split", F.lit("A").alias("gold"),
        F.when(F.col("y") == 1, "B").otherwise("a").alias("chosen"), "p_err", "p_opt_chosen", "p_opt_gap",
    )
    calib = rows.where("split = 'calib'") if calibrated else None
    path = _folder(spark)
    generate_report(rows.where("split = 'test'"), path, "check", calib, **options)
    return f"{path}/check"


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def _long(pairs: list[tuple[str, Column]], *keys: str | Column) -> list[Column]:
    """Columns (keys, name, value) of a row for each pair."""
    return [*keys, F.inline(F.array(*[
        F.struct(F.lit(name).alias("name"), r6(value.cast("double")).alias("value")) for name, value in pairs
    ]))]


def report_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the predictions file."""
    table = _csv(spark, f"{_report(spark, sf_dir)}_predictions.csv")
    return table.select(
        F.col("qid").cast("bigint").alias("qid"), "gold", "chosen",
        r6(F.col("p_error").cast("double")).alias("p_error"), F.col("is_error").cast("int").alias("is_error"),
    )


PREDICTIONS_SQL = f"""WITH {SCORED} SELECT row_id AS qid, 'A' AS gold,
CASE WHEN y = 1 THEN 'B' ELSE 'a' END AS chosen, {q6("p_err", "p_error")}, y AS is_error
FROM sc WHERE split = 'test'"""


def report_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bin of the reliability file and of the plot data of both systems."""
    base = _report(spark, sf_dir)
    table = _csv(spark, f"{base}_reliability_bins_detector.csv")
    bins = table.select(
        *_long(
            [(name, F.col(f"`{name}`")) for name in met.RELIABILITY_COLUMNS if name != "p_lo"],
            F.lit("bins").alias("file"), r6(F.col("p_lo").cast("double")).alias("at"),
        )
    )
    for title, _ in BOTH:
        points = _csv(spark, f"{base}_reliability_{title}.csv")
        bins = bins.unionByName(points.select(
            *_long(
                [(name, F.col(name)) for name in ("predicted_correct", "observed_correct", "n")],
                F.lit(title).alias("file"), r6(F.col("bin_centre").cast("double")).alias("at"),
            )
        ))
    return bins


def _melt(source: str, file: str, at: str, pairs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT {file} AS file, {q6(at, 'at')}, '{name}' AS name, {q6(value, 'value')} FROM {source}"
        for name, value in pairs
    )


_LOW = f"bin * (1e0 / {REL_BINS})"
_HIGH = f"CASE WHEN bin = {REL_BINS - 1} THEN 1e0 ELSE (bin + 1) * (1e0 / {REL_BINS}) END"
RELIABILITY_SQL = f"""WITH {SYSTEMS}, te AS (SELECT * FROM sys WHERE split = 'test'),
a AS ({_bins(REL_BINS, "te", "system")}), b AS (SELECT * FROM a WHERE bin IS NOT NULL),
d AS (SELECT * FROM b WHERE system = 'det')
{_melt("d", "'bins'", _LOW, [("p_hi", _HIGH), ("n", "n"), ("p_mean(Perr)", "sp / n"), ("err_rate", "sy / n"),
                             ("cal_error_abs", "abs(sp / n - sy / n)")])} UNION ALL
{_melt("b", "CASE WHEN system = 'det' THEN 'detector' ELSE 'vanilla' END", f"5e-1 * ({_LOW} + {_HIGH})",
       [("predicted_correct", "1e0 - sp / n"), ("observed_correct", "1e0 - sy / n"), ("n", "n")])}"""


def report_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the abstention file, with thresholds of the calibration rows and, without them, of the
    test rows."""
    tables = []
    for calibrated in (True, False):
        table = _csv(spark, f"{_report(spark, sf_dir, calibrated)}_abstention_table.csv")
        table = table.select(*[F.col(f"`{c}`").cast("double").alias(CHANGED.get(c, c)) for c in table.columns])
        tables.append(table.select(
            F.lit(calibrated).alias("calibrated"), "abstain_target",
            *r6s(*[c for c in table.columns if c != "abstain_target"]),
        ))
    return tables[0].unionByName(tables[1])


_OF_CALIB = _tau_sql("sys", "system", "split = 'calib'")
assert _OF_CALIB in COMPARE_SQL
ABSTENTION_FILE_SQL = f"""SELECT TRUE AS calibrated, * FROM ({COMPARE_SQL}) UNION ALL
SELECT FALSE, * FROM ({COMPARE_SQL.replace(_OF_CALIB, _tau_sql("sys", "system", "split = 'test'"))})"""


def report_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the JSON document beside the core ones: curves, decisions at a threshold, the bootstrap's
    points (1 where the interval lies around one) and the notes."""
    base = _report(spark, sf_dir, compute_bootstrap=True, classification_threshold=0.4)
    decision = "STRUCT<threshold DOUBLE, accuracy DOUBLE, confusion_matrix ARRAY<ARRAY<DOUBLE>>>"
    schema = (
        "curves MAP<STRING, DOUBLE>, notes MAP<STRING, DOUBLE>, bootstrap_CIs MAP<STRING, STRUCT<lo DOUBLE, "
        f"hi DOUBLE, point DOUBLE>>, `binary_detector@thr` {decision}, `binary_vanilla@thr` {decision}"
    )
    read = spark.read.text(f"{base}_report.json").select(F.from_json("value", schema).alias("d")).select("d.*")
    parts = [
        read.select(F.lit(section).alias("section"), F.explode(section).alias("name", "value"))
        for section in ("curves", "notes")
    ]
    intervals = read.select(F.explode("bootstrap_CIs").alias("name", "ci"))
    around = F.col("ci.point").between(F.col("ci.lo"), F.col("ci.hi")) & (F.col("ci.lo") < F.col("ci.hi"))
    parts.append(intervals.select(F.lit("points").alias("section"), "name", F.col("ci.point").alias("value")))
    parts.append(intervals.select(F.lit("around").alias("section"), "name", around.cast("double").alias("value")))
    for title, _ in BOTH:
        of = F.col(f"`binary_{title}@thr`")
        cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
        pairs = [(name, of["confusion_matrix"][i][j]) for name, (i, j) in cells.items()]
        pairs += [(name, of[name]) for name in ("threshold", "accuracy")]
        parts.append(read.select(*_long(pairs, F.lit(title).alias("section"))))
    document = parts[0]
    for part in parts[1:]:
        document = document.unionByName(part)
    return document.select("section", "name", r6("value").alias("value"))


def _numbers(section: str, source: str, pairs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT {section} AS section, '{name}' AS name, {q6(value, 'value')} FROM {source}" for name, value in pairs
    )


def _curve_pairs() -> list[tuple[str, str]]:
    """Published names and what they are of both systems' rows."""
    pairs = []
    for column, title, gain, sign in [
        ("aurc", "AURC", "ΔAURC", "-1"), ("auacc", "AUACC", "ΔAUACC", "1"),
        *[(c, f"Coverage@Acc≥{t:.2f}", f"ΔCov@{t:.2f}", "1") for t, c in zip(TARGETS, COVERAGES)],
    ]:
        det, base = _side_sql(column, "det"), _side_sql(column, "base")
        pairs += [(f"{title}_det", det), (f"{title}_base", base), (gain, f"{sign} * ({det} - {base})")]
    return pairs


_RIGHT = "avg(CASE WHEN (y = 1) = (p >= 4e-1) THEN 1e0 ELSE 0e0 END)"
DOCUMENT_SQL = f"""WITH {SYSTEMS}, te AS (SELECT * FROM sys WHERE split = 'test'),
{_curve_sql("te", "system")}, s AS (SELECT system, {AREAS}, {COVERED} FROM tz GROUP BY system),
c AS (SELECT CASE WHEN system = 'det' THEN 'detector' ELSE 'vanilla' END AS title,
  count(*) FILTER (y = 0 AND p < 4e-1) AS tn, count(*) FILTER (y = 0 AND p >= 4e-1) AS fp,
  count(*) FILTER (y = 1 AND p < 4e-1) AS fn, count(*) FILTER (y = 1 AND p >= 4e-1) AS tp,
  4e-1 AS threshold, {_RIGHT} AS accuracy FROM te GROUP BY system)
{_numbers("'curves'", "s", _curve_pairs())} UNION ALL
{_numbers("title", "c", [(n, n) for n in ("tn", "fp", "fn", "tp", "threshold", "accuracy")])} UNION ALL
{_numbers("'points'", "s", [("AURC_det_CI", _side_sql("aurc", "det")), ("AUACC_det_CI", _side_sql("auacc", "det"))])}
UNION ALL {_numbers("'around'", "(SELECT 1)", [("AURC_det_CI", "1e0"), ("AUACC_det_CI", "1e0")])} UNION ALL
{_numbers("'notes'", "(SELECT 1)", [("ece_bins", f"{ECE_BINS}"), ("reliability_bins", f"{REL_BINS}"),
                                    ("classification_threshold", "4e-1")])}"""


def selective_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas and coverages of the selective summary, and its two files read back."""
    rows = fixtures.scored(spark, sf_dir).where("split = 'test'")
    curve = met.risk_coverage(rows, "p_err")
    abstention = _abstention(spark, sf_dir).withColumnRenamed("target", "abstain_frac_target")
    path = _folder(spark)
    numbers = selective_summary(curve, abstention, path)
    points = _csv(spark, f"{path}/risk_coverage.csv").agg(
        *_long([
            *[(name, F.lit(value)) for name, value in numbers.items()],
            ("points", F.count(F.lit(1))),
            *[(f"mean_{c}", F.avg(F.col(c).cast("double"))) for c in ("cov", "risk", "acc")],
        ])
    )
    table = _csv(spark, f"{path}/abstention_table.csv")
    shown = ("tau", "coverage", "abstention_f1", "over_conservativeness", "abstain_ece_kept")
    rows_of = table.select(
        F.concat(F.lit("target "), F.col("abstain_frac_target").cast("double").cast("string")).alias("target"),
        *[F.col(c).cast("double") for c in shown],
    )
    long = rows_of.select("target", *_long([(c, F.col(c)) for c in shown]))
    return points.select("name", "value").unionByName(
        long.select(F.concat_ws(" ", "target", "name").alias("name"), "value")
    )


_SHOWN = [
    ("tau", "tau"), ("coverage", "(fn + tn) / n"), ("abstention_f1", "2e0 * pr * re / nullif(pr + re, 0)"),
    ("over_conservativeness", "fp / nullif(tn + fp, 0)"), ("abstain_ece_kept", "ek"),
]
SELECTIVE_EXPORT_SQL = f"""WITH {DET}, te AS (SELECT * FROM det WHERE split = 'test'),
{_tau_sql("det", "split", "split = 'calib'")}, tt AS (SELECT target, tau FROM tau),
{_kept_sql("te", "split", "CROSS JOIN tt")},
j AS (SELECT cm.*, ek, tp + fp + fn + tn AS n, tp / nullif(tp + fp, 0) AS pr,
  tp / nullif(tp + fn, 0) AS re FROM cm JOIN xe USING (split, target)),
{_curve_sql("te")}, s AS (SELECT {AREAS}, {COVERED}, count(*) AS points, avg(cov) AS mean_cov,
  avg(risk) AS mean_risk, avg(acc) AS mean_acc FROM tz)
""" + " UNION ALL ".join(
    [
        f"SELECT '{name}' AS name, {q6(value, 'value')} FROM s"
        for name, value in [
            ("AURC", "aurc"), ("AUACC", "auacc"),
            *[(f"Coverage@Acc≥{t:.2f}", c) for t, c in zip(TARGETS, COVERAGES)],
            *[(c, c) for c in ("points", "mean_cov", "mean_risk", "mean_acc")],
        ]
    ]
    + [
        f"SELECT 'target ' || CAST(CAST(target AS DOUBLE) AS VARCHAR) || ' {name}', {q6(value, 'value')} FROM j"
        for name, value in _SHOWN
    ]
)

QUERIES = {
    f.__name__: f
    for f in (report_predictions, report_reliability, report_abstention, report_document, selective_export)
}

ORACLES = {
    "report_predictions": PREDICTIONS_SQL,
    "report_reliability": RELIABILITY_SQL,
    "report_abstention": ABSTENTION_FILE_SQL,
    "report_document": DOCUMENT_SQL,
    "selective_export": SELECTIVE_EXPORT_SQL,
}
