"""Values that a weaker construction gets wrong: words that collide in polynomial hashes, repeated ids, very wide vectors."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardloom.llm import _words as W
from wardloom.llm import ann, jaccard, substring


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


LEFT, RIGHT = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_word_hashes_of_long_words(seed):
    texts = [f(n, *x) for n in (8, 64, 128, 512, 1024) for f in (thue_morse,) for x in (("a", "b"), ("b", "a"))] + ["a" * n for n in (1, 8, 9, 16, 17, 128, 129, 5000)]
    h = W.Texts(pa.array(texts)).words(W.separators("space")).hashes(seed)
    assert len(set(h.tolist())) == len(texts)


def test_window_hashes_of_regular_words():
    """Windows over two words, in the orders in which sums of powers cancel."""
    texts = [" ".join(thue_morse(8, "x", "y")), " ".join(thue_morse(8, "y", "x")), "x y x y x y x y", "x x x x y y y y"]
    w = W.Texts(pa.array(texts)).words(W.separators("space"))
    assert len(set(W.windows(w.hashes(), w.bounds, 8)[1].tolist())) == 4


def test_long_words_are_told_apart(spark):
    rest = " ".join(f"w{i}" for i in range(12))
    frame = spark.createDataFrame([(1, f"{LEFT} {rest}"), (2, f"{RIGHT} {rest}"), (3, f"{LEFT} {rest}"), (4, LEFT), (5, RIGHT), (6, LEFT)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.dedup(frame).collect()} == {1: 0, 2: 0, 3: 13, 4: 0, 5: 0, 6: 0}
    assert {r.doc_id: r.component_id for r in jaccard.join(frame, 3, 9, 10).where("doc_id > 3").collect()} == {4: 4, 5: 5, 6: 4}


def test_one_id_of_many_rows_is_dealt_apart(spark):
    """Rows without an id, or with one, are repeats of no row of that id, whatever chunks they fall into."""
    text = " ".join(f"w{i}" for i in range(20))
    frame = spark.createDataFrame([(1, text + f" {i}") for i in range(30)] + [(None, text + f" {i}") for i in range(30)] + [(2, text)], "doc_id long, text string")
    got = substring.dedup(frame, least_parts=5).collect()
    assert len(got) == 61 and sum(r.n_removed for r in got) == 20 == next(r.n_removed for r in got if r.doc_id == 2)


def nearest(frame, **options):
    out = defaultdict(list)
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, **options).collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def test_nearest_repeated_ids(spark):
    """Each row that is a query has its own list; repeated candidates are found as often as they stand."""
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 4.0]), (2, [1.0, 4.0]), (20, [0.0, 1.0])]
    frame = spark.createDataFrame([(*r, "q", 1) for r in rows], "vec_id long, embedding array<double>, query string, dim int")
    one, two = [(1, 1, 3.0), (2, 2, 1.0), (3, 2, 1.0)], [(1, 2, 4.0), (2, 2, 4.0), (3, 1, 1.0)]
    assert nearest(frame) == {20: sorted(one + two + two)}
    assert nearest(frame, query_rows=1, slice_rows=1, tile_rows=1, least_slices=4) == {20: sorted(one + two + two)}


def test_nearest_of_wide_doubles(spark):
    r = np.random.default_rng(8)
    vectors = r.normal(size=(60, 8)) * 10.0 ** r.integers(-160, 161, (60, 8))
    vectors[40:] = r.normal(size=(20, 8)) * 10.0 ** r.integers(-160, 161, (20, 1))
    got = nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"), k=10, tile_rows=16, least_slices=3)
    with np.errstate(over="ignore"):
        score = [[math.fsum(x) if all(map(math.isfinite, x := (a * b).tolist())) else sum(x) for b in vectors] for a in vectors]
    assert set(got) == {0, 20, 40}
    for q, found in got.items():
        want = sorted((i for i in range(60) if i != q), key=lambda i: (-score[q][i], i))[:10]
        assert [i for _, i, _ in found] == want
        assert all(math.isclose(s, score[q][i], rel_tol=1e-9) for _, i, s in found)
