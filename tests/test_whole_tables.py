"""Queries over whole tables: every row of the table is in the result."""

from pyspark.sql import functions as F

from wardloom.operators import relational as R
from wardloom.queries import QUERIES
from wardloom.queries.base import table


def test_all_draws_are_ranked(spark, sf_dir):
    got = {r.o_orderdate for r in QUERIES["wn10_ranks_of_all_draws"](spark, sf_dir).collect()}
    assert got == {r.o_orderdate for r in table(spark, sf_dir, "orders").collect()}


def test_all_segments_are_checked(spark, sf_dir):
    got = QUERIES["qg09_check_of_all"](spark, sf_dir).collect()
    customers = table(spark, sf_dir, "customer").collect()
    assert sorted(r.dataset for r in got) == sorted({r.c_mktsegment for r in customers}) and sum(r.n_rows for r in got) == len(customers)


def test_sorts_place_every_row(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").collect()
    want = sorted(orders, key=lambda r: (r.o_orderpriority, not r.o_totalprice > 200000, r.o_totalprice, r.o_orderkey))
    got = {r.o_orderkey: r.place for r in QUERIES["st03_mixed_sort_places"](spark, sf_dir).collect()}
    assert got == {r.o_orderkey: i for i, r in enumerate(want, 1)}
    for name, source in (("st04_nulls_last_places", "supplier"), ("st05_natural_sort_places", "part")):
        n = table(spark, sf_dir, source).count()
        assert sorted(r.place for r in QUERIES[name](spark, sf_dir).collect()) == list(range(1, n + 1))


def test_places_with_nulls_and_ties(spark):
    rows = [(i, None if i % 3 == 0 else i % 4, i // 5) for i in range(200)]
    frame = spark.createDataFrame(rows, "id int, k int, p int")
    got = {r.id: r.place for r in R.places(frame, [F.desc_nulls_last("k"), F.asc("p"), F.desc("id")], ["k"], "p", 4).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], -r[0]))
    assert got == {r[0]: i for i, r in enumerate(want, 1)}
    assert R.places(frame.where("false"), [F.asc("k"), F.asc("p")], ["k"], "p").count() == 0
