"""Sources, sinks, specs, boxes, answers and splits on small fixtures."""

import gzip
import io
import json
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardloom.functions import boxes as B
from wardloom.functions import scalars as S
from wardloom.operators import evaluation as E
from wardloom.operators import relational as R
from wardloom.plans import harmonizer as H
from wardloom.sources import readers
from wardloom.streaming import events as V


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2.5\n2,NaN\n3,\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("id,v\n4,1\n")
    assert readers.csv(spark, str(tmp_path / "a.csv"), "id long, v double").orderBy("id").collect() == [(1, 2.5), (2, None), (3, None)]
    both = readers.csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv.gz")])
    assert both.dtypes == [("id", "string"), ("v", "string")] and both.count() == 4
    assert readers.csv(spark, str(tmp_path / "a.csv"), names=["key", "value"], columns=["key"]).columns == ["key"]
    (tmp_path / "r.tsv").write_bytes(b"a\tb\tc\nshort\nx\t\xff\t\t\n")
    assert readers.ragged_tsv(spark, str(tmp_path / "r.tsv"), 3).count() == 2
    (tmp_path / "list.txt").write_text("a\n\n b \n")
    assert {r.id for r in readers.lines(spark, str(tmp_path / "list.txt")).collect()} == {"a", "b"}


def test_json_and_xml(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "t": ["x"]}, {"id": 2}]))
    assert readers.json_array(spark, str(tmp_path / "a.json"), "id int, t array<string>").count() == 2
    (tmp_path / "o.json").write_text(json.dumps({"k": {"n": 1}, "l": {"n": 2}}))
    assert {(r.key, r.value.n) for r in readers.json_object(spark, str(tmp_path / "o.json"), "struct<n:int>").collect()} == {("k", 1), ("l", 2)}
    (tmp_path / "l.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "l.jsonl"), "id int").where("id IS NOT NULL").count() == 2
    (tmp_path / "x.xml").write_text("<r><d><id>1</id><t>a</t></d><d><id>2</id></d></r>")
    assert readers.xml(spark, str(tmp_path / "x.xml"), "d", "id int, t string").orderBy("id").collect() == [(1, "a"), (2, None)]


def test_archives_and_arrays(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("s/1.json", '{"v": 1}')
        z.writestr("s/2.json", '{"v": 2}')
        z.writestr("s/3.txt", "no")
    assert {r.member for r in readers.zip_members(spark, str(tmp_path)).collect()} == {"s/1.json", "s/2.json"}
    assert readers.zip_members(spark, str(tmp_path), wanted={"s/2.json"}).first().text == '{"v": 2}'
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        info = tarfile.TarInfo("x.json")
        info.size = 2
        t.addfile(info, io.BytesIO(b"{}"))
    (tmp_path / "b.tar").write_bytes(b"not a tar file" * 100)
    found = readers.tar_members(spark, str(tmp_path)).collect()
    assert len(found) == 2 and {(r.member, r.error is None) for r in found} == {("x.json", True), (None, False)}
    np.save(tmp_path / "v.npy", np.arange(3.0))
    np.savez(tmp_path / "w.npz", e=np.ones((1, 2)))
    assert sorted(r.embedding for r in readers.arrays(spark, str(tmp_path)).collect()) == [[0.0, 1.0, 2.0], [1.0, 1.0]]
    assert {r.name for r in readers.listing(spark, str(tmp_path), "*.tar").collect()} == {"a.tar", "b.tar"}


def test_save_and_load(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "id string, v double")
    readers.save(df, str(tmp_path / "t"), "demo", ["v"], {"x": 1})
    back, about = readers.load(spark, str(tmp_path / "t"), "demo")
    assert H.same_table(back, df) and about["labels"] == ["v"] and about["options"] == {"x": 1}
    with pytest.raises(ValueError, match="demo"):
        readers.load(spark, str(tmp_path / "t"), "other")
    assert readers.golden(df).collect() == readers.golden(df.orderBy(F.desc("id"))).collect()
    assert [(r.name, r.n_rows, r.n_null) for r in readers.golden(df).collect()] == [("id", 2, 0), ("v", 2, 1)]


def test_find_path(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "x.csv").write_text("")
    assert readers.find_path(str(tmp_path / "sub"), "x.csv") == str(tmp_path / "x.csv")
    assert readers.find_path("/nowhere", "x.csv", given="/given") == "/given"
    with pytest.raises(FileNotFoundError):
        readers.find_path(str(tmp_path / "sub"), "y.csv")


def test_guards(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    twice = spark.createDataFrame([(1, 1), (1, 2)], "k int, w int")
    with pytest.raises(ValueError, match=r"labels has 2 rows for the key \(1,\)"):
        R.join_unique(a, twice, ["k"], what="labels")
    assert R.unmatched(a, twice, ["k"]).collect() == [(2, "y")]
    with pytest.raises(ValueError, match="missing columns"):
        R.contract(a)
    with pytest.raises(ValueError, match="no split column"):
        R.keep_split(a, "train")
    assert R.keep_ids(a, "k", []).count() == 0
    first = R.first_row(spark.createDataFrame([(1, None, 1), (1, "b", 2)], "k int, v string, pos int"), ["k"], ["pos"])
    assert first.collect() == [(1, None, 1)]


@pytest.mark.parametrize(("value", "unit", "want"), [("45", "years", 45.0), ("131", "years", None), ("-1", "years", None), ("x", "years", None), ("730.5", "days", 2.0), ("18", "months", 1.5), ("045Y", "dicom_as", 45.0), (" 6m ", "dicom_as", 0.5), ("0045Y", "dicom_as", None), (None, "dicom_as", None)])
def test_ages(spark, value, unit, want):
    assert one(spark, S.age_years(F.lit(value).cast("string"), unit)) == want


def test_sex_and_view(spark):
    sexes = [one(spark, S.sex(F.lit(v))) for v in (" Male", "f", "Unknown", "?", "")]
    assert sexes == ["M", "F", None, None, None]
    assert [one(spark, S.sex_is_odd(F.lit(v))) for v in ("?", "Unknown", "m")] == [True, False, False]
    assert [one(spark, S.view(F.lit(v))) for v in ("pa", " LL ", "unk", "ap_horizontal", "")] == ["PA", "LATERAL", None, "AP_HORIZONTAL", None]
    with pytest.raises(ValueError, match="unknown age unit"):
        S.age_years(F.lit("1"), "weeks")


@pytest.mark.parametrize(("answer", "reference", "f1", "recall"), [("The lung", "lung", 1.0, 1.0), ("", "", 1.0, 0.0), ("a the", "x", 0.0, 0.0), ("left left lung", "left lung opacity", 2 * 2 / 6, 2 / 3), (None, None, 1.0, 0.0)])
def test_answers(spark, answer, reference, f1, recall):
    a, r = F.lit(answer).cast("string"), F.lit(reference).cast("string")
    assert one(spark, S.token_f1(a, r)) == pytest.approx(f1)
    assert one(spark, S.token_recall(a, r)) == pytest.approx(recall)


def test_report(spark):
    note = "EXAM: CT\nFINDINGS: clear\n lungs. new findings: none\nIMPRESSION: normal\nRECOMMENDATION: x"
    section = lambda t, s: one(spark, S.report_section(F.lit(t).cast("string"), s))
    assert section(note, "findings") == "clear lungs. new findings: none"
    assert section(note, "impression") == "normal"
    assert section(note, "both") == "clear lungs. new findings: none normal"
    assert section("just  text", "findings") == "just text" and section(None, "full") == ""


def test_boxes(spark):
    box = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    assert one(spark, B.clip(box(-1, 0.5, 0.2, 2))) == [0.0, 0.5, 0.2, 1.0]
    assert one(spark, B.clip(box(0.5, 0.5, 0, 1))) is None and one(spark, B.clip(box(1.5, 2, 0, 1))) is None
    assert one(spark, B.clip(box(float("inf"), 1, 0, 1)))[0] == float("inf")
    assert [one(spark, B.valid(box(*v))) for v in ((0, 1, 0, 1), (0, 1, 0, 1, 0, 0.5), (0, 1, 1, 0), (0, 1.5, 0, 1), (0, 1))] == [True, True, False, False, False]
    assert one(spark, B.iou(box(0, 1, 0, 1), box(0, 1, 0.5, 1.5))) == pytest.approx(1 / 3)
    assert one(spark, B.swap_axes(box(1, 2, 3, 4))) == [3.0, 4.0, 1.0, 2.0]
    item = lambda r, *v: F.struct(F.lit(r).alias("reader"), box(*v).alias("box"))
    merged = one(spark, B.merge_readers(F.array(item("a", 0, 1, 0, 1), item("b", 0, 1, 0, 0.8), item("c", 5, 6, 5, 6), item("a", 0, 1, 0, 0.9))))
    assert len(merged) == 1 and merged[0] == pytest.approx([0, 1, 0, 0.9])
    for text, want in (("[[1, 2], [3, 4]]", [[1, 2], [3, 4]]), ("[1, 2]", [[1, 2]]), ("[]", []), ("oops", None), (None, None)):
        assert one(spark, B.parse(F.lit(text).cast("string"))) == want


def test_harmonize(spark):
    rows = [("p1", "s1", "a.png", 1.0, None, "45Y", "m"), ("p1", "s2", "b.png", None, None, "x", "?"), ("p2", "s3", None, 0.0, 1.0, "1W", "F"), ("p2", "s4", "d.png", -1.0, 0.0, None, None)]
    source = spark.createDataFrame(rows, "pid string, sid string, path string, `Big Mass` double, Edema double, age string, sx string")
    spec = H.Spec("demo", F.col("pid"), F.col("sid"), F.col("path"), labels=("Big Mass", "Edema"), age=("age", "dicom_as"), sex="sx", codes="negative")
    table = H.harmonize(source, spec)
    assert table.columns == ["patient_id", "study_id", "image_path", "age_years", "sex", "big_mass", "edema"]
    got = {r.study_id: r for r in table.collect()}
    assert set(got) == {"s1", "s2", "s4"}
    assert (got["s1"].edema, got["s2"].edema, got["s2"].big_mass) == (0.0, None, None)
    assert H.same_table(H.harmonize(source, spec, studies=["s1"]), table.where("study_id = 's1'"))
    assert H.harmonize(source, spec, studies=[]).count() == 0
    dropped = H.harmonize(source, H.Spec(**{**vars(spec), "drop_uncertain": True}))
    assert {r.study_id for r in dropped.collect()} == {"s1", "s2"}
    assert H.integrity(table, ["big_mass", "edema"]).first().status == "OK"
    assert H.integrity(table.where("false"), ["big_mass", "edema"]).first().status == "ERROR"
    assert H.samples(table, ["edema", "big_mass"], base="/root").where("study_id = 's1'").first().sample.asDict() == {"img": "/root/a.png", "cls": [1.0, 0.0]}


def test_metrics_by_hand(spark):
    rows = [("a", 1, 0.9), ("a", 1, 0.4), ("a", 0, 0.4), ("a", 0, 0.1), ("a", None, 0.5), ("b", 1, 0.5), ("b", 0, 0.1)]
    scored = spark.createDataFrame(rows, "label string, y int, score double")
    got = {r.label: r for r in E.ranking(scored, ["label"]).collect()}
    assert got["a"].auroc == pytest.approx(0.875) and got["a"].auprc == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert got["b"].auroc is None
    assert {r.label: r.threshold for r in E.thresholds(scored, ["label"]).collect()} == {"a": 0.9, "b": None}
    p = {r.label: r for r in E.panel(scored, E.thresholds(scored, ["label"]), ["label"]).collect()}
    assert (p["a"].tp, p["a"].fp, p["a"].fn, p["a"].tn) == (1, 0, 1, 2) and p["a"].mcc == pytest.approx(2 / 12**0.5)
    with pytest.raises(ValueError, match="strategy"):
        E.thresholds(scored, ["label"], "best")


def test_splits(spark):
    df = spark.createDataFrame([(i, f"g{i % 13}") for i in range(100)], "id int, g string")
    folds = E.kfold(df, "g", 4).select("g", "fold").distinct().collect()
    assert len(folds) == 13 and sorted(np.bincount([r.fold for r in folds])) == [3, 3, 3, 4]
    sides = {r.g: r.split for r in E.train_val(df, "g", 5).collect()}
    assert list(sides.values()).count("val") == 3 and len(sides) == 13
    drawn = E.bootstrap(df, "g", 3).groupBy("bootstrap", "g").count().collect()
    sizes = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    assert {r.bootstrap for r in drawn} == {0, 1, 2} and all(r["count"] % sizes[r.g] == 0 for r in drawn)
    assert sum(r["count"] // sizes[r.g] for r in drawn) == 39
    with pytest.raises(ValueError, match="have no g"):
        E.kfold(df.unionByName(spark.createDataFrame([(1, None)], "id int, g string")), "g", 2)
    with pytest.raises(ValueError, match="k must be"):
        E.kfold(df, "g", 14)


def test_streams(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = V.follow(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    counts = V.windowed_counts(stream, "ts", ["event_type"], "1 day")
    run = counts.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = V.windowed_counts(events, "ts", ["event_type"], "1 day")
    assert sorted(spark.table("counted").collect()) == sorted(want.collect())


def test_neighbours_of_labels_with_other_rows(spark):
    """Labels that share their rows are searched together; ties, fewer rows than k, and labels of other rows come out the same."""
    from wardloom.operators import probes

    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist(), *(None if rng.random() < 0.3 else int(rng.integers(2)) for _ in range(2)), 1 if i < 3 else None) for i in range(90)]
    rows = [(*r[:3], r[2] if r[0] % 2 else r[3], r[4]) for r in rows]
    frame = spark.createDataFrame(rows, "i long, v array<double>, a int, b int, c int")
    for block, slices in ((7, 3), (4096, 1)):
        got = {(r.i, r.label): r.score for r in probes.knn_scores(frame.where("i % 4 > 0"), frame.where("i % 4 = 0"), "v", "i", ["a", "b", "c"], 5, block, slices).collect()}
        unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
        for r in rows[::4]:
            for j, label in enumerate("abc"):
                near = sorted((-round(float(unit(r[1]) @ unit(x[1])), 9), x[0], x[2 + j]) for x in rows if x[0] % 4 and x[2 + j] is not None)[:5]
                want = {float(np.mean([y for *_, y in near]))}
                assert got.pop((r[0], label)) in want or len({d for d, *_ in near}) < 5
        assert not got


def test_statistics_hold_each_row_once(spark):
    rows = [
        ("a/1.png", "a", "1", "M", 3.0, [1, 2], 1.0), ("a/1.png", "a", "1", "F", None, [], None), ("a/1.png", "b", "1", None, 70.5, None, 0.0), (None, "b", "2", "F", 1.0, [3], 1.0),
        ("x.png", None, "2", "M", 2.0, [4], None), ("y.png", "b", None, "M", 9.0, [5], 1.0), ("z.png", None, None, "F", float("nan"), None, None), ("", "", "", "f", 5.0, [6, 7, 8], 2.0),
    ]
    table = spark.createDataFrame(rows, "image_path string, patient_id string, study_id string, sex string, age_years double, bbox array<int>, mass double")
    got = H.statistics(table, ["mass"])
    want = table.selectExpr(
        "count(DISTINCT image_path) n_images", "count(DISTINCT patient_id, study_id) n_studies", "count(DISTINCT patient_id) n_patients", "count_if(sex = 'M') `n_M`", "count_if(sex = 'F') `n_F`",
        "min(age_years) age_min", "max(age_years) age_max", "coalesce(sum(size(bbox)), 0) n_boxes", "count_if(mass = 1) pos_mass", "count_if(mass IS NULL) null_mass",
    )
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema] and repr(got.collect()) == repr(want.collect())
    assert got.first()[:5] == (5, 4, 3, 3, 3)
    none = H.statistics(table.where("false"), ["mass"]).collect()
    assert len(none) == 1 and none[0] == (0, 0, 0, 0, 0, None, None, 0, 0, 0)
    assert H.statistics(table.select("image_path", "patient_id", "study_id")).collect() == [(5, 4, 3)]
    # No row is sent once for each of the counts.
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
