"""Named sources on small files: their contract, and the cases that their files are known for."""

import json

import pytest
from pyspark.sql import functions as F

from wardloom.plans import harmonizer as H
from wardloom.plans import sources
from wardloom.sources import readers


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("sources")


@pytest.fixture(scope="module")
def x14(folder):
    head = "Image Index,Finding Labels,Follow-up #,Patient ID,Patient Age,Patient Gender,View Position,OriginalImage[Width,Height]\n"
    rows = ["a_0.png,No Finding,0,1,58,M,PA,1,2", "a_1.png,Pleural_Thickening|Mass,1,1,413,F,AP,1,2", "b_0.png,Pleural Thickening,0,2,,,PA,1,2", "c_0.png,,0,3,9,F,PA,1,2", "d_0.png,Mass,0,4,9,F,PA,1,2"]
    boxes = "Image Index,Finding Label,Bbox [x,y,w,h],,,\nb_0.png,Infiltrate,100,50,200,100,,,\nb_0.png,Mass,900,400,200,200,,,\nb_0.png,Mass,1000,0,10,10,,,\nd_0.png,Mass,10,10,0,5,,,\nzz.png,Mass,1,1,1,1,,,\n"
    for f in ("images_001/images/a_0.png", "images_002/images/a_0.png", "images_001/images/b_0.png", "images_001/images/c_0.png", "other/a_1.png", "images_001/images/d_0.png"):
        write(folder / "x14" / f, "x")
    return {
        "table": write(folder / "x14.csv", head + "\n".join(rows) + "\n"), "boxes": write(folder / "x14b.csv", boxes), "images": str(folder / "x14"),
        "sizes": write(folder / "x14s.csv", "Image Index,width,height\nb_0.png,1000,500\nd_0.png,1000,500\n"), "split": write(folder / "list.txt", "a_1.png\nb_0.png\n\n"),
    }


def test_chestxray14(spark, x14):
    pick = lambda *k: {x: x14[x] for x in k}
    got = {r.image_path: r for r in sources.build(spark, "chestxray14", pick("table")).collect()}
    assert set(got) == {"a_0.png", "a_1.png", "b_0.png", "c_0.png", "d_0.png"}
    r = got["a_1.png"]
    assert (r.patient_id, r.study_id, r.view_position, r.sex, r.age_years) == ("1", "1_1", "AP", "F", None)
    assert (r.mass, r.pleural_thickening, r.no_finding) == (1.0, 1.0, 0.0) and got["b_0.png"].pleural_thickening == 1.0 and got["c_0.png"].mass is None
    assert {r.image_path for r in sources.build(spark, "chestxray14", pick("table", "boxes", "images")).collect()} == {"images_002/images/a_0.png", "images_001/images/c_0.png"}
    assert {r.image_path for r in sources.build(spark, "chestxray14", pick("table", "boxes", "split")).collect()} == {"a_1.png", "b_0.png"}
    boxed = sources.build(spark, "chestxray14_bbox", pick("table", "boxes", "sizes", "images")).collect()
    assert [(r.image_path, r.bbox, r.bbox_labels) for r in boxed] == [("images_001/images/b_0.png", [[0.1, 0.3, 0.1, 0.3], [0.8, 1.0, 0.9, 1.0]], ["infiltration", "mass"])]


def test_chexpert(spark, folder):
    head = "Path,Sex,Age,Frontal/Lateral,AP/PA,No Finding,Edema,Lung Lesion\n"
    rows = ["C/train/p1/s1/v1.jpg,Female,68,Frontal,AP,1.0,,", "C/train/p1/s1/v2.jpg,Unknown,68,Lateral,,,-1.0,", "C/train/p2/s1/v1.jpg,Male,140,Frontal,LL,,,", "C/train/p3/s9/v1.jpg,Male,1,Frontal,PA,,0.0,1.0"]
    files = {"table": write(folder / "cx.csv", head + "\n".join(rows) + "\n"), "people": write(folder / "cxp.csv", "PATIENT,GENDER,PRIMARY_RACE,ETHNICITY\np1,F,B,x\np1,F,A,y\np9,M,C,z\n")}
    got = {r.image_path: r for r in sources.build(spark, "chexpert", files).collect()}
    assert set(got) == {"p1/s1/v1.jpg", "p2/s1/v1.jpg", "p3/s9/v1.jpg"}
    a, b = got["p1/s1/v1.jpg"], got["p2/s1/v1.jpg"]
    assert (a.study_id, a.view_position, a.age_years, a.sex, a.no_finding, a.edema, a.race, a.ethnicity) == ("p1_s1", "AP", 68.0, "F", 1.0, 0.0, "B", "x")
    assert (b.view_position, b.age_years, b.no_finding, b.race) == (None, None, None, None)
    raw = {r.image_path: r for r in sources.build(spark, "chexpert", {"table": files["table"]}, drop_uncertain=False, not_mentioned="nan").collect()}
    assert raw["p1/s1/v2.jpg"].edema == -1.0 and raw["p1/s1/v2.jpg"].view_position == "LATERAL" and raw["p1/s1/v1.jpg"].edema is None and "race" not in raw["p1/s1/v1.jpg"]
    assert [r.study_id for r in sources.build(spark, "chexpert", files, studies=["p3_s9", "none"]).collect()] == ["p3_s9"]


def test_mimic_cxr(spark, folder):
    table = "subject_id,study_id,path\n10,1,files/p10/s1/a.jpg\n10,1,files/p10/s1/b.jpg\n10,2,files/p10/s2/c.jpg\n11,3,files/p11/s3/d.jpg\n12,4,files/p12/s4/e.jpg\n"
    labels = "subject_id,study_id,Edema,No Finding\n10,1,1.0,\n10,2,-1.0,\n11,3,,\n99,9,1.0,\n"
    write(folder / "mimic" / "p10" / "s1.txt", "FINDINGS: clear,\n\n\"quoted\"\nlungs")
    files = {
        "table": write(folder / "m.csv", table), "labels": write(folder / "ml.csv", labels), "texts": str(folder / "mimic"),
        "reports": write(folder / "mr.csv", "subject_id,study_id,path\n10,1,files/p10/s1.txt\n10,2,files/p10/s2.txt\n11,3,files/p11/s3.txt\n"),
    }
    got = sorted((r.image_path, r.report, r.edema, r.no_finding) for r in sources.build(spark, "mimic_cxr", files).collect())
    text = "FINDINGS: clear,\n\n\"quoted\"\nlungs"
    assert got == [("p10/s1/a.jpg", text, 1.0, 0.0), ("p10/s1/b.jpg", text, 1.0, 0.0), ("p11/s3/d.jpg", None, None, None)]
    assert sources.build(spark, "mimic_cxr", {"table": files["table"]}).count() == 5
    twice = write(folder / "ml2.csv", labels + "10,1,0.0,\n")
    with pytest.raises(Exception, match="labels has 2 rows"):
        sources.build(spark, "mimic_cxr", files | {"labels": twice}).collect()


def test_rsna(spark, folder):
    classes = "patientId,class\np1,Lung Opacity\np1,Normal\np2,Normal\np3,No Lung Opacity / Not Normal\n"
    boxes = "patientId,x,y,width,height,Target\np1,512,256,512,1024,1\np1,0,0,512,512,1.0\np1,1,1,1,1,0\np2,,,,,0\np3,1,,1,1,1\n"
    files = {"table": write(folder / "r.csv", classes), "boxes": write(folder / "rb.csv", boxes), "headers": write(folder / "rh.csv", "patientId,PatientAge,PatientSex,ViewPosition\np1,51,F,PA\np2,151,M,AP\n")}
    got = {r.patient_id: r for r in sources.build(spark, "rsna_pneumonia_kaggle", files).collect()}
    assert got["p1"].bbox == [[0.25, 1.0, 0.5, 1.0], [0.0, 0.5, 0.0, 0.5]] and got["p1"].bbox_labels == ["lung_opacity"] * 2 and got["p2"].bbox == [] == got["p3"].bbox
    assert (got["p1"].lung_opacity, got["p1"].normal, got["p1"].age_years, got["p1"].view_position, got["p2"].age_years, got["p3"].sex) == (1.0, 0.0, 51.0, "PA", None, None)
    assert got["p3"]["no_lung_opacity_/_not_normal"] == 1.0 and got["p1"].image_path == "p1.dcm"
    bones = sources.build(spark, "rsna_bone_age", {"table": write(folder / "b.csv", "id,boneage,male\n1,180,False\n2,12,True\n3,,\n")}).collect()
    assert sorted((r.patient_id, r.image_path, r.age_months, r.sex, r.sex_female) for r in bones) == [("1", "1.png", 180, "F", 1), ("2", "2.png", 12, "M", 0), ("3", "3.png", None, None, None)]
    write(folder / "bones" / "one" / "7.png", "x")
    val = {"table": write(folder / "bv.csv", "Image ID,male,Bone Age (months)\n7,TRUE,9\n8,FALSE,9\n"), "images": str(folder / "bones")}
    assert [(r.image_path, r.age_months, r.sex) for r in sources.build(spark, "rsna_bone_age", val).collect()] == [("one/7.png", 9, "M")]


def test_siim_and_vqa(spark, folder):
    write(folder / "siim" / "p1" / "s1" / "i1.dcm", "x")
    write(folder / "siim" / "p2" / "s2" / "i2.dcm", "x")
    table = write(folder / "s.csv", "ImageId, EncodedPixels\ni1, 5 2 \ni2, -1\ni1, 1 3\ni3, -1\n")
    got = sources.build(spark, "siim_acr_ptx", {"table": table, "images": str(folder / "siim")}).collect()
    assert sorted((r.patient_id, r.study_id, r.image_path, r.mask, r.pneumothorax, r.view_position) for r in got) == [("p1", "s1", "p1/s1/i1.dcm", "5 2|1 3", 1.0, "Frontal"), ("p2", "s2", "p2/s2/i2.dcm", "-1", 0.0, "Frontal")]
    records = [{"qid": 1, "image_name": "syn.1.jpg", "question": " is it?\n", "answer": "yes ", "question_type": "PRES", "answer_type": "CLOSED ", "image_organ": "CHEST", "phrase_type": "test_para", "more": 1}, {"qid": 2, "image_name": "syn2.jpg", "question": "q", "answer": 3, "question_type": None, "answer_type": "OPEN", "image_organ": "HEAD", "phrase_type": "para"}]
    path = write(folder / "v.json", json.dumps(records, indent=1))
    got = {r.question_id: r for r in sources.build(spark, "vqa_rad", {"table": path}).collect()}
    assert (got["1"].patient_id, got["1"].question, got["1"].answer, got["1"].split, got["1"].answer_type) == ("syn.1", "is it?", "yes", "test", "CLOSED")
    assert (got["2"].study_id, got["2"].answer, got["2"].split, got["2"].question_type) == ("syn2", "3", "train", None)
    assert sources.build(spark, "vqa_rad", {"table": path}, studies=["syn2"]).count() == 1


def test_contract(spark, x14, folder, tmp_path):
    """Rules that hold for every source: saved and loaded, filtered by study, in label order, paths relative, boxes inside."""
    files = {"chestxray14": ("table", "images"), "chestxray14_bbox": ("table", "boxes", "sizes")}
    for name, roles in files.items():
        build = lambda name=name, roles=roles, **ids: sources.build(spark, name, {k: x14[k] for k in roles}, **ids)
        table = build()
        readers.save(table, str(tmp_path / name), name, sources.labels_of(spark, name))
        loaded, about = readers.load(spark, str(tmp_path / name), name)
        assert H.same_table(table, loaded) and H.same_table(build(), loaded)
        labels = [c for c in table.columns if c in set(about["labels"])]
        assert labels == sorted(labels) == about["labels"]
        study = table.first().study_id
        assert H.same_table(build(studies=[study]), table.where(F.col("study_id") == study))
        none = build(studies=["no_such_study"])
        assert none.columns == table.columns and none.count() == 0
        assert table.where(F.col("image_path").startswith("/")).count() == 0


def test_registry(spark):
    with pytest.raises(ValueError, match="no source 'x'"):
        sources.build(spark, "x", {})
    with pytest.raises(ValueError, match="registered already"):
        H.register("chexpert")(None)
    assert {"chestxray14", "chestxray14_bbox", "chexpert", "mimic_cxr", "rsna_bone_age", "rsna_pneumonia_kaggle", "siim_acr_ptx", "vqa_rad"} <= set(H.REGISTRY)


def test_whole_texts(spark, tmp_path):
    write(tmp_path / "t" / "a.txt", "one\ntwo\r\n\n")
    write(tmp_path / "t" / "sub" / "b.txt", "three")
    assert [r.text for r in readers.texts(spark, str(tmp_path / "t")).collect()] == ["one\ntwo\r\n\n"]
    assert readers.texts(spark, str(tmp_path / "t"), recursive=True).count() == 2
    write(tmp_path / "o.json", '{"a": {"x": 1},\n "b": {"x": null}}')
    assert sorted((r.key, r.value.x) for r in readers.json_object(spark, str(tmp_path / "o.json"), "struct<x:int>").collect()) == [("a", 1), ("b", None)]


def test_no_two_arrays_share_a_file(spark, tmp_path, sf_dir):
    """With several parts before the write, two arrays once came to one file, of which the first alone is read."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    many = rows.crossJoin(spark.range(40).select(F.col("id").alias("copy"))).withColumn("conv_id", F.col("conv_id") + F.col("copy") * 100000).drop("copy")
    many.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        from wardloom.queries import QUERIES

        assert QUERIES["sr08_vqa_rad"](spark, str(tmp_path)).count() == 40 * rows.count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_listing_is_the_one_of_spark(spark, tmp_path):
    """Files of any depth, by tasks: no job of Spark's own listing, which sends all files to the driver."""
    for name, size in {"a.x": 1, "b/c.x": 2, "b/d/e.x": 3, "b/d/f/g h%20.x": 4, "b/d/f/i/j.x": 5, "_no/k.x": 1, ".no/l.x": 1, "b/_m.x": 1, "n.y": 1, "o.x": 0, "k=1/_p=1/q.x": 6}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"z" * size)
    own = readers.listing(spark, str(tmp_path), "*.x")
    theirs = spark.read.format("binaryFile").option("pathGlobFilter", "*.x").option("recursiveFileLookup", True).load(str(tmp_path))
    want = sorted((r.path, r.length, r.modificationTime) for r in theirs.select("path", "length", "modificationTime").collect())
    for path in (str(tmp_path), f"file:{tmp_path}/", f"file://{tmp_path}"):
        assert sorted((r.path, r.length, r.modified) for r in readers.listing(spark, path, "*.x").collect()) == want
    assert len(want) == 6 and not own.inputFiles()
    assert [r.name for r in readers.listing(spark, f"{tmp_path}/a.x").collect()] == ["a.x"]
    with pytest.raises(FileNotFoundError):
        readers.listing(spark, f"{tmp_path}/nowhere")
