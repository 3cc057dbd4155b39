from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from fondaco.operators.orphans import earliest_delivery, orphan_references, reference_key

D = lambda day: dt(2024, 1, day)


def status(df):
    return {r.k: r.status for r in df.collect()}


def test_status_by_time(spark):
    parent = spark.createDataFrame([("a", D(1), None), ("b", D(1), D(3)), ("c", D(9), None), ("d", D(1), D(2)), ("d", D(4), None)], "pk string, f timestamp, t timestamp")
    child = spark.createDataFrame([("1", "a", D(5)), ("2", "b", D(5)), ("3", "c", D(5)), ("4", "x", D(5)), ("5", "d", D(3)), ("6", "d", D(4)), ("7", "b", D(1)), ("8", None, D(5)), ("9", "a", None), ("10", "b", D(3))], "k string, ref string, at timestamp")
    got = status(orphan_references(child, parent, [("ref", "pk")], "simple", "at", "f", "t"))
    assert got == {"2": "deleted", "3": "late", "4": "missing", "5": "deleted", "9": "late", "10": "deleted"}


@pytest.mark.parametrize("match,want", [("simple", {"2": "missing"}), ("partial", {"2": "missing", "4": "missing"}), ("full", {"2": "missing", "3": "malformed", "4": "malformed"})])
def test_null_masks(spark, match, want):
    parent = spark.createDataFrame([("a", 1), ("b", 2)], "p1 string, p2 int")
    child = spark.createDataFrame([("1", "a", 1), ("2", "a", 2), ("3", "a", None), ("4", None, 7), ("5", None, None)], "k string, c1 string, c2 int")
    assert status(orphan_references(child, parent, [("c1", "p1"), ("c2", "p2")], match)) == want


def test_empty_tables_and_clashing_columns(spark):
    schema = "k string, status string, ref string, at timestamp"
    parent = spark.createDataFrame([], schema)
    child = spark.createDataFrame([("1", "kept", "a", D(1)), ("1", "kept", "a", D(1))], schema)
    got = orphan_references(child.drop("status"), parent, [("ref", "ref")], "simple", "at", "at", None)
    assert [r.status for r in got.collect()] == ["missing", "missing"]
    assert orphan_references(parent.drop("status"), child, [("ref", "ref")]).count() == 0


def test_earliest_delivery_and_keys(spark):
    rows = spark.createDataFrame([("1", D(2), "late"), ("1", D(1), " RUN-1\t"), ("2", None, "x"), (None, D(1), "y"), ("3", D(1), "b"), ("3", D(1), "a")], "k string, at timestamp, ref string")
    got = {r.k: r.ref for r in earliest_delivery(rows, "k", "at", ["ref"]).collect()}
    assert got == {"1": " RUN-1\t", "2": "x", "3": "a"}
    keys = spark.createDataFrame([(" RUN-1\t",), ("  ",), (None,)], "r string").select(reference_key("r").alias("k")).collect()
    assert [r.k for r in keys] == ["run-1", None, None]
    with pytest.raises(ValueError):
        orphan_references(rows, rows, [("ref", "ref")], "loose")


def test_hot_reference(spark):
    child = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 3 == 0, "gone").otherwise("here").alias("ref"))
    parent = spark.createDataFrame([("here",)], "pk string")
    assert orphan_references(child, parent, [("ref", "pk")]).count() == 1000
