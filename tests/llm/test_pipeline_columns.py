"""Each stage on columns whose names the operators use themselves, on nulls, repeated rows and an empty table."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from wardloom.llm import decontaminate

PROSE = "the quick brown fox jumps over the lazy dog while the old house stands near the quiet river and waits for rain"


@pytest.mark.parametrize("name", ["language_id", "near_duplicates", "decontamination", "secrets"])
def test_columns_stay(spark, tmp_path, name):
    spark.createDataFrame([("b1", "one two three four five six seven eight nine ten eleven")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = "rejected string, score string, lang_pred string, spans string, kinds string, items string, n_hit string, component_id string, n_shingles string"
    odd = tuple("r s l p k i h c n".split())
    rows = [(i, f"{PROSE} {i} {'x' * (i + 1)} word{i} and more of it{i}", "en", "s", 10, *odd) for i in range(8)]
    rows += [(20, "token=abcdef123456 " + PROSE[::-1], "en", "s", 10, *odd), (21, None, None, None, None, *odd), (22, "", None, None, 0, *odd), (None, "1 2 3 " + " ".join(f"q{i}" for i in range(30)), "en", "s", None, *odd)]
    frame = spark.createDataFrame(rows + rows[:1], f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, frame, str(tmp_path))
    assert got.dtypes == frame.dtypes
    kept = got.collect()
    assert all(tuple(r[c] for c in frame.columns[5:]) == odd for r in kept)
    ids = [r.doc_id for r in kept]
    if name == "secrets":
        assert len(ids) == len(rows) + 1
        found = next(r for r in kept if r.doc_id == 20)
        assert found.text.startswith("[SECRET] ") and found.n_chars == len(found.text)
    elif name == "decontamination":
        assert len(ids) == len(rows) + 1
    elif name == "language_id":
        assert set(range(8)) <= set(ids) and not {21, 22} & set(ids)
    else:
        assert ids.count(0) == 1
    assert stage(spark, frame.where(F.lit(False)), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["language_id", "near_duplicates", "decontamination", "secrets", "bpe"])
def test_dotted_map_and_inner_names(spark, tmp_path, name):
    spark.createDataFrame([("b1", "one two three four five six seven eight nine ten eleven")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = "`a.b` string, m map<string,int>, rest string, id long, `order` string, `of` string, first string, row string, text_sha256 string, __items string, __spans string"
    odd = ("dot", {"k": 1}, "r", 5, "o", "f", "1", "w", "t", "i", "s")
    rows = [(i, f"{PROSE} {i} {'x' * (i + 1)} word{i} and more of it{i}", "en", "s", 10, *odd) for i in range(6)]
    rows += [(6, None, None, None, None, *odd), (7, "", "en", None, 0, *odd), (None, PROSE[::-1] + " nothing", "en", None, 0, *odd)]
    frame = spark.createDataFrame(rows + rows[:2] + rows[-1:], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    got = dict(corpus_pipeline.STAGES)[name](spark, frame, str(tmp_path))
    if name == "bpe":
        assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(str(r[0]) for r in rows + rows[:2] + rows[-1:])
        return
    assert got.dtypes == frame.dtypes
    kept = got.collect()
    assert kept and all(tuple(r)[5:] == odd for r in kept)
    ids = [r.doc_id for r in kept]
    assert ids.count(0) == (1 if name == "near_duplicates" else 2)


def test_spans_are_cut_whatever_the_columns(spark):
    bench = spark.createDataFrame([("b1", "one two three four five six seven eight nine ten")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "aa one two three four five six seven eight nine ten zz", "i", "s", {"k": 1}, "d")], "doc_id long, text string, __items string, __spans string, m map<string,int>, `a.b` string")
    got = decontaminate.remove(docs, bench, how="spans")
    assert got.columns == docs.columns
    assert [tuple(r) for r in got.collect()] == [(1, "aa  zz", "i", "s", {"k": 1}, "d")]
    assert decontaminate.remove(docs.select("text"), bench, how="spans").collect()[0].text == "aa  zz"
