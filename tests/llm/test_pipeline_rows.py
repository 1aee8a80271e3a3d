"""The near-duplicate stage on repeated rows, null ids and ids of several texts: one row of each group stays."""

import corpus_pipeline
import pytest

A, B, C, D, E = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")


@pytest.mark.parametrize("shared", [False, True])
def test_one_row_of_each_group(spark, shared):
    rows = [(1, A, "x"), (2, A + " tail", "x"), (3, B, "y"), (3, B, "x"), (3, B, "y"), (None, C, "y"), (None, C, "x"), (None, C + " tail", "z"), (None, A, "z"), (None, None, "x"), (None, None, "x"), (4, None, "x"), (5, "", "x")]
    rows += [(6, D, "x"), (6, A, "x"), (6, E, "x"), (6, E, "x")] if shared else []
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, frame, "")
    assert got.columns == frame.columns
    got = [tuple(r) for r in got.collect()]
    assert len([r for r in got if r[1] and r[1].startswith("c0 ")]) == 1
    rest = [r for r in got if not (r[1] and r[1].startswith("c0 "))]
    want = [(1, A, "x"), (3, B, "x"), (None, None, "x"), (4, None, "x"), (5, "", "x")] + ([(6, D, "x"), (6, E, "x")] if shared else [])
    assert sorted(map(str, rest)) == sorted(map(str, want))
