"""Rules of sources, numberings and resamples that no SQL twin covers: edges, and what must raise."""

import pytest
from pyspark.sql import functions as F

from wardloom.functions import clinical as C
from wardloom.functions import masks as M
from wardloom.operators import evaluation as E
from wardloom.operators import relational as R
from wardloom.sources import nested as N


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")


def values(df, c):
    return [r[0] for r in df.select("i", c.alias("v")).orderBy("i").select("v").collect()]


def test_ages_and_reports(spark):
    df = column(spark, ["85 or more", "90+", "20-Oct", "0", "n/a", None])
    assert values(df, C.age_words(F.col("c"))) == [85.0, 90.0, 10.0, None, None, None]
    df = column(spark, [None, "", "REPORT: x", " report __ ", "reported"])
    assert values(df, C.blank_report(F.col("c"))) == [True, True, False, True, False]


def test_planes(spark):
    df = column(spark, [[1, 0, 0, 0, 1, 0], [0, 1, 0, 0, 0, -1], [1, 0, 0, 0, 0, -1], [0] * 6, [1, 2], None], "array<int>")
    assert values(df, C.plane(F.col("c"))) == ["axial", "sagittal", "coronal", None, None, None]


def test_paths_that_leave_their_folder(spark):
    df = column(spark, ["a/b.c.png"])
    assert values(df, C.output_path(F.col("c"), ".nii")) == ["a/b.c.nii"]
    with pytest.raises(Exception, match="leaves its folder"):
        values(column(spark, ["a/../b.png"]), C.output_path(F.col("c"), ".nii"))


def test_lists(spark):
    df = column(spark, [" a ;; b", "", None])
    assert values(df, C.split_list(F.col("c"))) == [["a", "b"], [], None]
    df = column(spark, ["['a', \"b\"]", "[]", "[oops", None])
    assert values(df, C.list_text(F.col("c"))) == [["a", "b"], [], None, None]


def test_joins_that_raise(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError, match=r"places has no row for the key \(2,\)"):
        R.join_required(left, right, ["k"], "places")
    assert sorted(R.join_one_to_one(left, right, ["k"]).collect()) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError, match="left side"):
        R.join_one_to_one(left.union(left), right, ["k"])
    with pytest.raises(ValueError, match="2 rows"):
        R.join_one_to_one(left, right.union(right), ["k"])


def test_numbers_by_first_appearance(spark):
    rows = [(f"g{(i * 7) % 40}" if i % 9 else None, i) for i in range(300)]
    want = list(dict.fromkeys(g for g, _ in rows if g))
    got = R.number_groups(spark.createDataFrame(rows, "g string, p int"), "g", "p", 5).collect()
    assert [r.g for r in sorted(got, key=lambda r: r.number)] == want and sorted(r.number for r in got) == list(range(40))
    assert R.number_groups(spark.createDataFrame([], "g string, p int"), "g", "p").collect() == []


def test_balanced_folds_are_balanced(spark):
    rows = [(g,) for g in range(60) for _ in range(1 + g)]
    found = E.balanced_folds(spark.createDataFrame(rows, "g int"), "g", 4)
    sizes = [r.n for r in found.groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 60
    assert found.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()


def test_inner_validation(spark):
    df = spark.range(100).selectExpr("id", "id % 20 AS g")
    held = E.carve_val(df, "g", 0.1, 1).where("part = 'val'")
    assert held.select("g").distinct().count() == 2 and held.count() == 10
    assert E.carve_val(df, "g", 0.0).where("part = 'val'").isEmpty()
    assert E.carve_val(df.where("g = 3"), "g", 0.5).where("part = 'val'").isEmpty()


def test_smaller_training_sets_are_in_larger_ones(spark):
    got = E.training_sizes(spark.range(50), "id", [5, 20, 80, -1]).collect()
    sets = {n: {r.id for r in got if r.n_train == n} for n in (5, 20, 80, -1)}
    assert len(sets[5]) == 5 and sets[5] < sets[20] < sets[80] == sets[-1] and len(sets[-1]) == 50


def test_masks(spark):
    df = column(spark, ["1 3 3 2 9 2", "-1", "", None, "4 1"])
    assert values(df, M.area(M.union(M.runs(F.col("c"))))) == [6, 0, 0, 0, 1]
    box = values(df, M.bounds(M.union(M.runs(F.col("c"))), 4, 4))
    assert box[0] == [0.0, 1.0, 0.0, 0.75] and box[1] is None and box[4] == [0.75, 1.0, 0.0, 0.25]


def test_rows_of_nested_texts(spark):
    df = column(spark, ['[{"a": 1}, {"a": null}]', "[]", "{oops", None])
    assert sorted(N.annotation_rows(df, "c", "struct<a:int>").collect(), key=str) == [(0, 1), (0, None)]
    lists = spark.createDataFrame([(1, ["a"], [1, 2])], "i int, x array<string>, y array<int>")
    with pytest.raises(Exception, match="differ in length"):
        N.parallel_rows(lists, ["x", "y"]).collect()
    note = values(column(spark, ["Female 30 yrs\n left\n lung", "unknown", "", None]), N.clinical_note(F.col("c")))
    assert tuple(note[0]) == ("F", 30.0, "left lung") and tuple(note[1]) == tuple(note[2]) == tuple(note[3]) == (None, None, None)
