"""The entry module without a session, and refusals."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from tarnscope.operators import refusals as rf

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 200"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_a_reason_is_an_error_for_who_wants_clean_rows(spark):
    rows = spark.createDataFrame([(1, "red", None), (1, "nir", None), (2, "red", "shape differs"), (2, "nir", None)], "item int, layer string, reason string")
    from pyspark.sql import functions as F

    items = rf.native_items(rows, ["item"], F.col("layer"), F.col("reason"))
    got = {r["item"]: (r["assets"], r["problems"], r["refused"]) for r in items.collect()}
    assert got == {1: (2, [], None), 2: (2, ["red: shape differs"], "an asset has a different native grid")}
    assert rf.refuse(items.where("item = 1"), "refused", ["item"]).count() == 1
    with pytest.raises(Exception, match="an asset has a different native grid: 2"):
        rf.refuse(items, "refused", ["item"]).collect()


def test_attempts_must_be_exactly_as_expected(spark):
    names = "cohort string, configuration string"
    audit = spark.createDataFrame([("a", "x", 2, True, True), ("a", "y", 0, True, True), ("b", "x", 0, False, True), ("c", "x", 0, True, True), ("d", "x", 1, True, True), ("d", "x", 1, True, True)], names + ", overlaps int, complete boolean, agrees boolean")
    expected = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("d", "x")], names)
    rows = rf.replacement_attempts(audit, expected, ["cohort", "configuration"])
    got = {(r["cohort"], r["configuration"]): (r["action"], r["refused"]) for r in rows.collect()}
    assert got == {
        ("a", "x"): ("replace", None), ("a", "y"): ("keep", None), ("b", "x"): ("review", "incomplete without sleep"), ("b", "y"): ("review", "not audited"),
        ("c", "x"): ("review", "not expected"), ("d", "x"): ("review", "audited twice"),
    }
    assert rf.refuse(rows.where("cohort = 'a'"), "refused", ["cohort"]).count() == 2
    with pytest.raises(Exception, match="not audited: b y"):
        rf.refuse(rows.where("configuration = 'y'"), "refused", ["cohort", "configuration"]).collect()
