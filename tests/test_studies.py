"""Visits, folders, label names: nulls, ties and empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardloom.operators import relational as R


def test_visits_with_ties_and_nulls(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [(1, "a", day(3)), (2, "a", day(3)), (3, "a", day(9)), (4, "a", None), (5, "b", day(1)), (6, None, day(2))]
    frame = spark.createDataFrame(rows, "id int, patient string, date date")
    got = {r.id: (r.visit_number, r.days_from_first) for r in R.visits(frame, "patient", "date").collect()}
    # A row without a patient has no visits to be numbered among.
    assert got == {1: (1, 0), 2: (1, 0), 3: (2, 6), 4: (None, None), 5: (1, 0), 6: (None, None)}
    assert R.visits(frame.where("false"), "patient", "date").count() == 0


def test_folders(spark):
    expected = spark.createDataFrame([("x/1/a",), ("x/1/b",), ("x/2/a",), ("x/3/a",)], "path string")
    listing = spark.createDataFrame([("x/1/a", 4), ("x/1/b", 0), ("x/2/a", 0)], "path string, length long")
    assert {(r.folder, r.status) for r in R.folder_status(expected, listing, "path").collect()} == {("x/1", "ok"), ("x/2", "empty"), ("x/3", "missing")}


def test_files_that_cannot_be_read(spark):
    expected = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    files = spark.createDataFrame([(1, "ok"), (2, "bad"), (2, "ok"), (3, None)], "id int, content string")
    assert {r.id: r.status for r in R.file_status(expected, files, "id", F.col("content") == "ok").collect()} == {1: "ok", 2: "ok", 3: "unreadable", 4: "missing"}


def test_names_of_labels(spark):
    assert R.label_columns(["b c", "B a", "b_b"]) == ["B a", "b_b", "b c"]
    frame = spark.createDataFrame([(1, 2)], "old int, new int")
    assert R.renamed_labels(frame.drop("new"), {"old": "new", "absent": "x"}).columns == ["new"]
    with pytest.raises(ValueError):
        R.renamed_labels(frame, {"old": "new"})


def test_controls(spark):
    frame = spark.createDataFrame([("Normal ",), ("No Finding",), ("nodule",), (None,)], "finding string")
    assert [r.finding for r in R.keep_positives(frame, "finding").collect()] == ["nodule"]
