"""Masks from pixels, stratified parts, files united by name, and places, first values and sections in hard cases."""

import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wardloom.functions import masks as M
from wardloom.functions import scalars as S
from wardloom.operators import relational as R
from wardloom.operators import stratify
from wardloom.sources import readers


@pytest.mark.parametrize("gaps", [False, True])
def test_masks_by_hand(spark, gaps):
    rng = random.Random(2)
    drawn = {k: sorted({p for _ in range(rng.randrange(12)) for s in [rng.randrange(150)] for p in range(s, s + rng.randrange(1, 40))}) for k in range(30)}
    drawn[30], drawn[31] = list(range(64)), [63, 64, 127, 128, 129]
    rows = [(k, p) for k, ps in drawn.items() for p in ps for _ in range(1 + p % 2)] + [(5, None), (None, 7), (99, 1)]
    keys = spark.createDataFrame([(k,) for k in (*drawn, None, 77)], "k int")
    pixels = spark.createDataFrame(rows, "k int, pixel int").repartition(3)
    drawn |= {None: [7], 77: []}
    got = {r.k: r.mask for r in M.encode(pixels, keys, ["k"], gaps=gaps, stretch=16).collect()}
    assert set(got) == set(drawn)
    for k, text in got.items():
        back, at, out = [int(x) for x in text.split()] if text != "-1" else [], 0, []
        for a, n in zip(back[::2], back[1::2], strict=True):
            at = at + a if gaps else a - 1
            assert n > 0 and (not out or at > out[-1] + 1)
            out += range(at, at + n)
            at += n
        assert out == drawn[k]
    decode = M.runs_of_gaps if gaps else M.runs
    frame = M.encode(pixels, keys, ["k"], gaps=gaps).select("k", decode(F.col("mask")).alias("runs"))
    assert {r.k: [p for x in r.runs for p in range(x["first"], x["last"] + 1)] for r in frame.collect()} == drawn
    assert M.encode(pixels.where("false"), keys.where("k = 77"), ["k"]).collect()[0].mask == "-1"


def test_pixels_are_packed_before_they_are_shuffled(spark):
    """What a mask of adjacent pixels sends on is a number for each 62 of them, not a row a pixel."""
    pixels = spark.range(0, 62 * 200, 1, 4).select(F.lit(1).alias("k"), F.col("id").alias("pixel"))
    frame = M.pixel_runs(pixels, ["k"])
    assert [tuple(r) for r in frame.collect()] == [(1, 0, 62 * 200 - 1)]
    exchanges, plans = [], [frame._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            p = p.executedPlan()
        if "QueryStage" in p.nodeName():
            p = p.plan()
        if p.nodeName() == "Exchange":
            exchanges.append(p.metrics().apply("shuffleRecordsWritten").value())
        plans += [p.children().apply(i) for i in range(p.children().size())]
    assert exchanges and max(exchanges) <= 210


def test_numbers_of_a_mask_are_read_once(spark):
    """A text of many runs: its numbers were once split again for every run."""
    text = " ".join(f"{3 * i + 1} 2" for i in range(20000))
    began = time.time()
    frame = spark.createDataFrame([(text,)], "t string").select(M.runs(F.col("t")).alias("r"), M.runs_of_gaps(F.lit("0 2 1 2")).alias("g"))
    row = frame.select(F.size("r").alias("n"), F.get("r", F.lit(19999)).alias("last"), "g").first()
    assert (row.n, tuple(row.last)) == (20000, (59997, 59998)) and [tuple(x) for x in row.g] == [(0, 1), (3, 4)]
    assert time.time() - began < 30
    got = spark.createDataFrame([("9 2 1 3 4 1 2 4 20 1",), ("-1",), (None,)], "t string").select(M.union(M.runs(F.col("t"))).alias("u")).collect()
    assert [[tuple(x) for x in r.u] for r in got] == [[(0, 4), (8, 9), (19, 19)], [], []]


def test_division_of_combinations():
    rng = random.Random(1)
    for _ in range(200):
        n_labels, k = rng.randrange(1, 7), rng.randrange(2, 6)
        counts = Counter()
        for _ in range(rng.randrange(1, 25)):
            counts[tuple(i for i in range(n_labels) if rng.random() < 0.35)] += rng.choice([1, 2, 3, 17, 500])
        shares = [rng.random() + 0.05 for _ in range(k)]
        out = stratify.divide(dict(counts), shares)
        assert all(sum(out[c]) == n and min(out[c]) >= 0 for c, n in counts.items())
        for x in [None, *range(n_labels)]:
            own = [c for c in counts if x is None or x in c]
            for p in range(k):
                assert abs(sum(out[c][p] for c in own) - sum(counts[c] for c in own) * shares[p] / sum(shares)) < 2
    assert stratify.divide({}, [1, 1]) == {}


def test_stratified(spark):
    rng = random.Random(4)
    rows = [(i, int(rng.random() < 0.02), 1 if rng.random() < 0.4 else None, int(rng.random() < 0.5), "x") for i in range(700)] + [(7, 1, 1, 1, "twice"), (None, 0, 0, 0, "none"), (None, 0, 0, 0, "none")]
    frame = spark.createDataFrame(rows, "id int, a int, b int, `c.d` int, place string").repartition(4)
    got = stratify.stratified(frame, "id", ["a", "b", "c.d"], [3, 1, 1]).collect()
    assert len(got) == len(rows) and sorted(str(tuple(r)[:-1]) for r in got) == sorted(map(str, rows))
    for i in range(1, 4):
        n = sum(r[i] == 1 for r in rows)
        for p, share in enumerate((0.6, 0.2, 0.2)):
            assert abs(sum(r[i] == 1 and r.part == p for r in got) - n * share) <= 1
    some = stratify.subsample(frame, "id", ["a", "b"], 70)
    assert some.count() == 70 and "part" not in some.columns
    assert stratify.stratified(frame.where("false"), "id", ["a"], [1, 1]).count() == 0
    again = stratify.stratified(frame.repartition(7), "id", ["a", "b", "c.d"], [3, 1, 1]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_csv_by_name(spark, tmp_path):
    path = str(tmp_path / "in")
    for i, (head, lines) in enumerate([("x,id", ["bx,2", "NA,3"]), ("id,x", ["4,dx"]), ("id,y,x", ['5,"a, b",ex', "6,,"]), ("id", [])]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.csv").write_text("\n".join([head, *lines]) + "\n")
    got = readers.csv_by_name(spark, path)
    assert got.columns == ["x", "id", "y"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [("bx", "2", None), (None, "3", None), ("dx", "4", None), ("ex", "5", "a, b"), (None, "6", None)]))
    typed = readers.csv_by_name(spark, path, "id long, y string, none double")
    assert sorted((r.id, r.y, r.none) for r in typed.where("id > 4").collect()) == [(5, "a, b", None), (6, None, None)]
    assert readers.csv_by_name(spark, path, columns=["id"]).count() == 5
    with pytest.raises(Exception, match="(?i)header"):
        readers.csv(spark, path).collect()
    (tmp_path / "in" / "9.csv").write_text("id,id\n1,2\n")
    with pytest.raises(ValueError, match="a column twice"):
        readers.csv_by_name(spark, path)


def test_places_of_nulls(spark):
    rows = [(i, None if i % 4 == 0 else (i * 7) % 50) for i in range(90)]
    frame = spark.createDataFrame(rows, "id int, p int")
    for order, key in ((F.asc_nulls_last("p"), lambda r: (r[1] is None, r[1] or 0, r[0])), (F.asc("p"), lambda r: (r[1] is not None, r[1] or 0, r[0]))):
        got = {r.id: r.place for r in R.places(frame, [order, F.asc("id")], [], "p", 8).collect()}
        assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=key), 1)}


def test_first_known(spark):
    rows = [(k, t, None if (t + (k or 0)) % 3 else f"v{t}") for k in (1, 2, None) for t in range(5)] + [(4, 0, None), (1, 0, "tie"), (5, None, "n")]
    frame = spark.createDataFrame(rows, "k int, t int, v string")
    want = defaultdict(list)
    for k, t, v in rows:
        if v is not None:
            want[k].append((t is not None, t or 0, v))
    got = R.first_known(frame, ["k"], ["t", "v"], "v", "first").collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"k", "t", "v", "first"}
    assert all(r.first == (min(want[r.k])[2] if want[r.k] else None) for r in got)
    assert R.first_known(frame.where("false"), ["k"], ["t"], "v", "first").count() == 0


@pytest.mark.parametrize("note, section, want", [
    ("TECHNIQUE: CT.\nFINDINGS:\n", "findings", ""), ("TECHNIQUE: CT.\nFINDINGS:\n", "both", ""), ("A: b\nIMPRESSION:\nCOMPARISON: none", "impression", "COMPARISON: none"),
    ("new findings: none", "findings", "new findings: none"), ("TECHNIQUE: CT.", "findings", "TECHNIQUE: CT."),
])
def test_empty_sections(spark, note, section, want):
    assert spark.range(1).select(S.report_section(F.lit(note), section).alias("x")).first().x == want


def test_white_space_at_the_ends(spark):
    frame = spark.createDataFrame([("\tLung  Opacity\n",), ("  a b ",), ("",), (None,)], "t string")
    assert [r.x for r in frame.select(S.box_label(F.col("t")).alias("x")).collect()] == ["lung_opacity", "a_b", "", None]
