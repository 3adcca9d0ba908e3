"""Every registered query against its SQL text on the smallest tables."""
import os
import re

import pytest

import __spark_entry__ as entry
from compare import differences, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SLOW = {"cross_validated_bag", "score_saved_detector", "fit_detector", "whole_run"}
# The training-data subpackage has a test folder of its own.
QUERIES = {n: q for n, q in entry.queries().items() if not re.match(r"op\d+_|pipeline$", n)}
ORACLES = {n: s for n, s in entry.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_equals_sql(spark, con, name):
    message, rows = differences(QUERIES[name](spark, SF_DIR), con, ORACLES[name])
    assert message is None
    assert rows > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES and n not in SLOW])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_and_names(spark):
    assert set(ORACLES) <= set(QUERIES)
    assert entry.entry(spark).columns[0] == "qid"
