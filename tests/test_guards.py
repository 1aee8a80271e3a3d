"""Guards that run with the query: no job before it, and a broken rule stops it."""

import pytest
from pyspark.sql import functions as F

from wardloom.operators import guards as G
from wardloom.plans import harmonizer as H


def jobs(spark, f):
    spark.sparkContext.setJobGroup("guards", "guards")
    try:
        out = f()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup("guards"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, v string")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(1, "x"), (2, "y"), (9, "z")], "k int, w string")


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_joins(spark, left, right, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        nulls = right.unionByName(spark.createDataFrame([(None, "n"), (None, "m")], right.schema))
        twice = right.unionByName(spark.createDataFrame([(2, "q")], right.schema))
        known = left.where("k IS NOT NULL")
        assert rows(G.join_unique(left, nulls, ["k"])) == rows(left.join(right, ["k"]))
        assert rows(G.join_unique(left, nulls, ["k"], "left")) == rows(left.join(right, ["k"], "left"))
        assert rows(G.join_required(known, nulls, ["k"])) == rows(left.join(right, ["k"]))
        assert rows(G.join_one_to_one(left.dropDuplicates(["k"]).select("k"), right, ["k"])) == rows(left.dropDuplicates(["k"]).select("k").join(right, ["k"], "left"))
        for f in (G.join_unique, G.join_required, G.join_one_to_one):
            frame, n = jobs(spark, lambda f=f: f(known.dropDuplicates(["k"]), twice, ["k"], what="labels"))
            assert n == 0
            with pytest.raises(Exception, match=r"labels has 2 rows for the key \(2\)"):
                frame.collect()
        with pytest.raises(Exception, match=r"places has no row for the key \(null\)"):
            G.join_required(left, right, ["k"], "places").collect()
        with pytest.raises(Exception, match=r"places has no row for the key \(2\)"):
            G.join_required(known, right.where("k <> 2"), ["k"], "places").count()
        with pytest.raises(Exception, match=r"the left side of labels has 2 rows for the key \(2\)"):
            G.join_one_to_one(left, right, ["k"], "labels").collect()
        assert G.join_required(left.where("false"), right, ["k"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_and_values(spark, left):
    frame, n = jobs(spark, lambda: G.require_rows(left.where("k > 5"), "large keys"))
    assert n == 0
    with pytest.raises(Exception, match="large keys: 0 rows"):
        frame.collect()
    assert rows(G.require_rows(left, "keys")) == rows(left) and G.require_rows(left, "keys").count() == 4
    with pytest.raises(Exception, match="a row has no k"):
        G.require_known(left, "k").collect()
    assert G.require_known(left.where("k IS NOT NULL"), "k").count() == 3


def test_counts_while_the_query_runs(spark, left):
    missing, metrics = G.warnings(left, ["v", "report", "k", "v"])
    assert missing == ["column 'report' was asked for and is not there"]
    (frame, seen), n = jobs(spark, lambda: G.observed(left, **metrics))
    assert n == 0 and frame.where("v <> 'a'").count() == 3
    assert seen.get == {"n_rows": 4, "known_v": 4, "known_k": 3}
    frame, seen = G.observed(left.where("false"), largest=F.max("k"))
    assert frame.collect() == [] and seen.get == {"n_rows": 0, "largest": None}


def test_harmonize_starts_no_job(spark):
    source = spark.createDataFrame([("p1", "s1", "a.png"), ("p2", "s2", "b.png")], "p string, s string, f string")
    tables = [spark.createDataFrame([("s1", i), ("s2", i + 1)], f"s string, x{i} int") for i in range(4)]
    spec = H.Spec("four", F.col("p"), F.col("s"), F.col("f"), labels=("x0",), regressions=("x1",), extra=("x2", "x3"), joins=tuple(H.Join(t, ("s",)) for t in tables))
    frame, n = jobs(spark, lambda: H.harmonize(source, spec))
    assert n == 0 and rows(frame) == ["('p1', 's1', 'a.png', 0.0, 1, 2, 3)", "('p2', 's2', 'b.png', 1.0, 2, 3, 4)"]
    with pytest.raises(Exception, match="labels has 2 rows"):
        H.harmonize(source, H.Spec("two", F.col("p"), F.col("s"), F.col("f"), joins=(H.Join(tables[0].union(tables[0]), ("s",)),), extra=("x0",))).collect()
