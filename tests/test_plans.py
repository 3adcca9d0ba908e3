"""Shape of the physical plans: exchanges, sorts, pruning, no nested loops, no Python workers."""
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.operators import metrics as met, options as opt, vectors as vec
from plumbline.operators.collapse import collapse
from plumbline.operators.scan import hashed_scan
from plumbline.plans import fixtures
from plumbline.session import checkpointed

SF_DIR = "/root/testdata/sf0.001"
# These fit models or write files when called; their plans only read results back.
EAGER = {
    "fit_detector", "score_saved_detector", "cross_validated_bag", "whole_run", "report_core",
    "report_predictions", "report_reliability", "report_abstention", "report_document", "selective_export",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(text, word):
    return len(re.findall(rf"[-:] {word}\b", text))


def test_collapse_has_one_exchange_and_one_sort(spark):
    rows = checkpointed(fixtures.options(spark, SF_DIR))
    text = plan(collapse(rows))
    assert count(text, "Exchange") == 1
    assert count(text, "Sort") == 1


def test_records_to_features_share_the_exchange(spark):
    records = checkpointed(fixtures.records(spark, SF_DIR))
    text = plan(collapse(opt.option_table(records)))
    assert count(text, "Exchange") == 1


def test_seeded_order_moves_rows_once(spark):
    rows = fixtures.table(spark, SF_DIR, "orders").select("o_orderkey", "o_orderstatus")
    text = plan(hashed_scan(rows, ["o_orderkey"], 1, ["o_orderstatus"]))
    # One exchange for the rows; two for the narrow counts (by piece, then by stratum) and at most
    # one to bring the offsets back to the pieces.
    assert count(text, "Exchange") <= 4
    assert "SinglePartition" not in text


def test_unused_layers_and_columns_are_not_read(spark, tmp_path):
    path = str(tmp_path / "states")
    fixtures.states(spark, SF_DIR).withColumn("extra", F.lit(1)).write.partitionBy("layer").parquet(path)
    text = plan(vec.layer_dynamics(spark.read.parquet(path), [3, 4]))
    assert re.search(r"PartitionFilters: \[.*layer#\d+ IN \(3,4\)", text)
    assert "extra" not in text.split("ReadSchema")[1].split("\n")[0]


def test_counts_combine_before_the_shuffle(spark):
    rows = fixtures.scored(spark, SF_DIR)
    text = plan(met.score_cells(rows, "p_err"))
    below = text.split("Exchange", 1)[1]
    assert "HashAggregate" in below and "partial_count" in below


def of_the_library(name):
    """Not of the training-data subpackage, whose tests are in a folder of their own."""
    return not re.match(r"op\d+_|pipeline$", name)


@pytest.mark.parametrize(
    "name", [n for n in entry.queries() if n not in EAGER and of_the_library(n)]
)
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    if not name.startswith(("trace_", "letter_", "vector_", "question_")):
        # Only wide arrays are reduced in Python workers, batch by batch.
        assert "ArrowEvalPython" not in text
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                 "MapInPandas", "FlatMapGroupsInPandas"):
        assert word not in text


def test_targets_are_answered_from_counts(spark):
    """The rows are counted once; only the counts are laid out by target."""
    rows = fixtures.scored(spark, SF_DIR).select("y", F.col("p_err").alias("p"), F.col("split").alias("k"))
    thresholds = spark.createDataFrame([("test", 0.1, 0.4), ("calib", 0.1, 0.4)], "k STRING, target DOUBLE, tau DOUBLE")
    text = plan(met.abstention_metrics(rows, thresholds, keys=["k"]))
    assert "Generate" in text
    assert "partial_count" in text.split("Generate", 1)[1]
