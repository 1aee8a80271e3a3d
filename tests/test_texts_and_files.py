"""CSV as other readers read it, blank values of any white space, report sections, and guards of joins."""

import csv
import io
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardloom.functions import scalars as S
from wardloom.functions import text as X
from wardloom.operators import relational as R
from wardloom.sources import readers


def test_csv_like_other_readers(spark, tmp_path):
    rows = [["1", "line one\nline two", "NA"], ["2", 'said "no", ok', "x"], ["3", "", "null"], ["x", "a\\b", "3.5"], ["5", ' "q" ', "NaN"]]
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL).writerows([["id", "note", "v"], *rows])
    (tmp_path / "a.csv").write_text(out.getvalue().replace("\r\n", "\n"))
    missing = lambda v: None if v in readers.MISSING else v
    got = readers.csv(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in got] == [tuple(map(missing, r)) for r in rows]
    typed = readers.csv(spark, str(tmp_path / "a.csv"), "id long, note string, v double").collect()
    assert [(r.id, r.v) for r in typed] == [(1, None), (2, None), (3, None), (None, 3.5), (5, None)]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_blank_is_any_white_space(spark):
    for t in ("", " ", "\t\n", "  ", "\x1c"):
        assert one(spark, S.is_blank(F.lit(t)))
    assert one(spark, S.sex(F.lit("M\n"))) == "M" and one(spark, S.view(F.lit("PA\t"))) == "PA" and not one(spark, S.is_blank(F.lit("\tx")))
    assert not one(spark, X.usable_pair(F.lit("\n"), F.lit("x")))


@pytest.mark.parametrize(
    "note, section, want",
    [
        ("HISTORY: cough\nlong\n\nChest film.\nFINDINGS: clear IMPRESSION: normal", "indication", "cough long"),
        ("Clinical indication: fall. Findings: none\nFINDINGS: a CONCLUSION: b SUMMARY: c\nRECOMMENDATION: d", "impression", "b SUMMARY: c"),
        ("IMPRESSION: x\nFINDINGS: y", "both", "y x"),
        ("new findings: none", "impression", "new findings: none"),
        ("no header", "indication", ""),
        ("REASON FOR THE EXAMINATION: pain COMPARISON: none", "indication", "pain"),
        ("  Findings : small\r\n", "findings", "small"),
    ],
)
def test_sections(spark, note, section, want):
    assert one(spark, S.report_section(F.lit(note), section)) == want


@pytest.mark.parametrize("caption, specialty", [("Histopathology, H&E stain", "pathology"), ("Fundus photograph", "ophthalmology"), ("ECG strip", "physiological_signals"), ("colonoscopy, axial view", "endoscopy"), ("axial view", "radiology")])
def test_specialties(spark, caption, specialty):
    assert one(spark, X.tag_caption(F.lit(caption), F.lit(None).cast("string")))["specialty"] == specialty


def test_guards(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (9, "z"), (9, "z")], "k int, w string")
    assert R.left_join_once(left, right, ["k"]).count() == 3
    with pytest.raises(Exception, match="key twice"):
        R.left_join_once(left.unionByName(spark.createDataFrame([(9, "d")], left.schema)), right, ["k"]).collect()
    with pytest.raises(ValueError, match="0 rows"):
        R.require_rows(left.where("false"), "left")


def test_lexicons_are_searched_once_in_a_text(spark):
    """What may match is found in linear time, and holds all that the lexicons' own expressions find."""
    rng = random.Random(3)
    words = [w for *_, p in X.LEXICONS for w in re.split(r"[|\\()\[\]?:]+", p) if w] + [" ", "-", "é", "12", "\x0b", "x", "×", "T", "\n", "K", "ſ"]
    texts = ["", None, "magnification\x0b×\x0b40", *("".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 4))) for _ in range(2000))]
    bits = X._may_match.func(pa.array(texts, pa.string())).to_pylist()
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    java = frame.select("i", F.array(*(F.coalesce(F.col("t").rlike(f"(?i)({p})"), F.lit(False)) for *_, p in X.LEXICONS)).alias("m"), X.tag(F.col("t")).alias("tag"))
    for r in java.collect():
        assert not any(m and not bits[r.i] >> k & 1 for k, m in enumerate(r.m)), texts[r.i]
        first = next((k for k, m in enumerate(r.m) if m), None)
        assert (r.tag and tuple(r.tag)[:3]) == (None if first is None else X.LEXICONS[first][:3]), texts[r.i]
    assert bits[2] >> [n for n, *_ in X.LEXICONS].index("pathology") & 1
    text = F.concat(F.lit("plain "), F.repeat(F.lit("nothing of note in these words "), 60000))
    began = time.time()
    assert spark.range(4).select(X.tag(text).alias("t")).where("t IS NULL").count() == 4 and time.time() - began < 60
