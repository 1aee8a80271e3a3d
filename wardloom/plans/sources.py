"""Named sources: each builds, from the files of one public data set, its source table and the spec that makes it a contract table.

    sources.build(spark, "chexpert", {"table": ".../train.csv"}, studies=["patient00001_study1"])

Files are read as text and cast where a rule needs a number. The order of a file's lines, where a rule needs it, is that of
their places in it. Nothing here starts a job; a key that a joined file has twice stops the query.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import scalars as S
from ..operators import relational as R
from ..sources import readers
from .harmonizer import REGISTRY, Join, Spec, harmonize, register, scalars_snake

# The labels of the data sets, as their files spell them.
CHESTXRAY14 = ("Atelectasis", "Cardiomegaly", "Consolidation", "Edema", "Effusion", "Emphysema", "Fibrosis", "Hernia", "Infiltration", "Mass", "No Finding", "Nodule", "Pleural_Thickening", "Pneumonia", "Pneumothorax")
CHEXPERT = ("Atelectasis", "Cardiomegaly", "Consolidation", "Edema", "Enlarged Cardiomediastinum", "Fracture", "Lung Lesion", "Lung Opacity", "No Finding", "Pleural Effusion", "Pleural Other", "Pneumonia", "Pneumothorax", "Support Devices")
RSNA_PNEUMONIA = ("Lung Opacity", "No Lung Opacity / Not Normal", "Normal")
# Names of box labels that differ from those of the image labels; the size of all images of a data set.
CHESTXRAY14_BOX_NAMES = {"Infiltrate": "Infiltration"}
RSNA_PNEUMONIA_SIZE = 1024


class Source(NamedTuple):
    """What a named source comes to: its rows, how they become a contract table, and a question table instead, if it is one."""

    rows: DataFrame
    spec: Spec | None = None
    questions: DataFrame | None = None


def build(spark: SparkSession, name: str, files: dict[str, str], studies: Iterable | DataFrame | None = None, patients: Iterable | DataFrame | None = None, **options) -> DataFrame:
    """The contract table of a named source. ``files``: its files by role; options are those of the source.

    Filters by id keep the rows that a filter of the whole table would. An unknown name, role or option raises.
    """
    if name not in REGISTRY:
        raise ValueError(f"no source {name!r}: one of {sorted(REGISTRY)}")
    made: Source = REGISTRY[name](spark, **{f"{role}_file": path for role, path in files.items()}, **options)
    if made.spec is not None:
        return harmonize(made.rows, made.spec, studies, patients)
    table = made.questions
    for column, ids in (("study_id", studies), ("patient_id", patients)):
        table = R.keep_ids(table, column, ids) if ids is not None else table
    return table


def labels_of(spark: SparkSession, name: str) -> list[str]:
    """The label columns of a named source's table, in its order."""
    return sorted(map(scalars_snake, {"chestxray14": CHESTXRAY14, "chestxray14_bbox": CHESTXRAY14, "chexpert": CHEXPERT, "mimic_cxr": CHEXPERT, "rsna_pneumonia_kaggle": RSNA_PNEUMONIA, "siim_acr_ptx": ("pneumothorax",)}.get(name, ())))


def _rows_in_order(df: DataFrame) -> DataFrame:
    return df.withColumn("line", F.monotonically_increasing_id())


def _box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return B.from_xywh(*(c.try_cast("double") for c in (x, y, w, h)), width, height)


def _listed(item: Column, order: str = "line") -> Column:
    """The items of a group as a list in the order of their lines."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("line"), item.alias("item")))), lambda x: x["item"])


def _chestxray14(spark: SparkSession, table_file: str, images_file: str | None, split_file: str | None) -> DataFrame:
    """Rows with one 0/1 column for each label that the text of findings holds, and the place of the image."""
    rows = readers.csv(spark, table_file)
    finding = F.col("Finding Labels")
    # A label counts wherever its words stand; an underscore in it may be a space in the text.
    rows = rows.withColumns({c: F.when(finding.isNotNull(), finding.rlike(c.replace("_", "[_ ]")).cast("double")) for c in CHESTXRAY14})
    if split_file is not None:
        rows = rows.join(readers.lines(spark, split_file, "Image Index"), "Image Index", "left_semi")
    if images_file is None:
        return rows.withColumn("image", F.col("Image Index"))
    # Of a name in several folders the last folder counts; images without a file are dropped.
    place = F.regexp_extract("path", r"([^/]+/images/[^/]+)$", 1)
    found = readers.listing(spark, images_file).select(F.col("name").alias("Image Index"), place.alias("image")).where("image <> ''").groupBy("Image Index").agg(F.max("image").alias("image"))
    return rows.join(found, "Image Index", "left")


def _chestxray14_spec(name: str, **more) -> Spec:
    study = F.concat_ws("_", "Patient ID", "Follow-up #")
    return Spec(name, F.col("Patient ID"), study, F.col("image"), labels=CHESTXRAY14, age=("Patient Age", "years"), sex="Patient Gender", view="View Position", **more)


def _chestxray14_boxes(spark: SparkSession, boxes_file: str) -> DataFrame:
    names = ["Image Index", "label", "x", "y", "w", "h"]
    width = len(spark.read.option("header", True).csv(boxes_file).columns)
    return readers.csv(spark, boxes_file, names=[*names, *(f"more{i}" for i in range(width - len(names)))], columns=names)


@register("chestxray14")
def chestxray14(spark: SparkSession, table_file: str, boxes_file: str | None = None, images_file: str | None = None, split_file: str | None = None) -> Source:
    """The image table of ChestX-ray14. With ``boxes`` the images that have a box are left out (they are the table of
    ``chestxray14_bbox``), but not with ``split``, an official list of images, which keeps all of its own."""
    rows = _chestxray14(spark, table_file, images_file, split_file)
    if boxes_file is not None and split_file is None:
        rows = rows.join(_chestxray14_boxes(spark, boxes_file).select("Image Index"), "Image Index", "left_anti")
    return Source(rows, _chestxray14_spec("chestxray14"))


@register("chestxray14_bbox")
def chestxray14_bbox(spark: SparkSession, table_file: str, boxes_file: str, sizes_file: str, images_file: str | None = None) -> Source:
    """The images of ChestX-ray14 with a box. ``sizes``: a CSV of Image Index, width and height of the images as they are
    stored; boxes are fractions of these, clipped, and an image that keeps none is left out."""
    rows = _chestxray14(spark, table_file, images_file, None)
    sizes = readers.csv(spark, sizes_file, columns=["Image Index", "width", "height"])
    found = _rows_in_order(_chestxray14_boxes(spark, boxes_file)).join(sizes, "Image Index")
    name = F.coalesce(S.lookup(F.col("label"), CHESTXRAY14_BOX_NAMES), F.col("label"))
    box = _box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width").cast("double"), F.col("height").cast("double"))
    lists = found.where(F.forall(box, lambda v: v.isNotNull())).groupBy("Image Index").agg(_listed(box).alias("raw_box"), _listed(name).alias("raw_label"))
    lists = lists.where(F.size(B.clip_with(F.col("raw_box"))) > 0)
    return Source(rows, _chestxray14_spec("chestxray14_bbox", box="raw_box", box_labels="raw_label", joins=(Join(lists, ("Image Index",), what="boxes"),)))


@register("chexpert")
def chexpert(spark: SparkSession, table_file: str, people_file: str | None = None, drop_uncertain: bool = True, not_mentioned: str = "negative") -> Source:
    """CheXpert. A blank label is negative where the row has any label; rows with an uncertain one are dropped, unless the
    options say otherwise. ``people``: a CSV of PATIENT, PRIMARY_RACE and ETHNICITY, the first line of each patient."""
    rows = readers.csv(spark, table_file)
    part, ap = F.split("Path", "/", -1), F.col("AP/PA")
    lateral = F.coalesce(F.col("Frontal/Lateral") == "Lateral", F.lit(False)) if "Frontal/Lateral" in rows.columns else ap.isNull()
    # A frontal image with another word than AP or PA has no known view.
    view = F.when(lateral, "LATERAL").when(ap.isin("AP", "PA"), ap)
    rows = rows.withColumns({"patient": F.get(part, F.lit(2)), "study": F.concat_ws("_", F.get(part, F.lit(2)), F.get(part, F.lit(3))), "image": F.array_join(F.slice(part, 3, 1 << 20), "/"), "view": view})
    labels, joins, extra = tuple(c for c in CHEXPERT if c in rows.columns), (), ()
    if people_file is not None:
        people = _rows_in_order(readers.csv(spark, people_file, columns=["PATIENT", "PRIMARY_RACE", "ETHNICITY"]))
        first = people.groupBy(F.col("PATIENT").alias("patient_id")).agg(*(F.min_by(F.col(c), "line").alias(n) for c, n in (("PRIMARY_RACE", "race"), ("ETHNICITY", "ethnicity"))))
        joins, extra = (Join(first, ("patient_id",), "left", "people"),), ("race", "ethnicity")
    return Source(rows, Spec("chexpert", F.col("patient"), F.col("study"), F.col("image"), labels=labels, codes=not_mentioned, drop_uncertain=drop_uncertain, age=("Age", "years"), sex="Sex", view="view", joins=joins, extra=extra))


@register("mimic_cxr")
def mimic_cxr(spark: SparkSession, table_file: str, labels_file: str | None = None, reports_file: str | None = None, texts_file: str | None = None, drop_uncertain: bool = True, not_mentioned: str = "negative") -> Source:
    """MIMIC-CXR: a row for each image of a study that the label file has. ``reports``: a CSV of subject_id, study_id and
    path; ``texts``: the folder of these paths. A report whose file is not there is null."""
    rows = readers.csv(spark, table_file)
    labels, joins, report = (), [], None
    cut = lambda c: S.without_prefix(F.col(c), "files/")
    if labels_file is not None:
        table = readers.csv(spark, labels_file)
        labels = tuple(c for c in CHEXPERT if c in table.columns)
        joins.append(Join(table.select(F.col("subject_id").alias("patient_id"), "study_id", *labels), ("patient_id", "study_id"), what="labels"))
    if reports_file is not None:
        table = readers.csv(spark, reports_file).select(F.col("subject_id").alias("patient_id"), "study_id", cut("path").alias("report_path"))
        if texts_file is not None:
            # A file is known by the end of its path, as long as those in the table.
            base = texts_file.rstrip("/") + "/"
            texts = readers.texts(spark, base, recursive=True).select(F.regexp_replace(F.substring_index("path", base, -1), "^/+", "").alias("report_path"), F.col("text").alias("report_text"))
            table = table.join(texts, "report_path", "left")
            report = "report_text"
        joins.append(Join(table, ("patient_id", "study_id"), "left", "reports"))
    return Source(rows, Spec("mimic_cxr", F.col("subject_id"), F.col("study_id"), cut("path"), labels=labels, codes=not_mentioned if labels else None, drop_uncertain=drop_uncertain, report=report, view="ViewPosition" if "ViewPosition" in rows.columns else None, joins=tuple(joins)))


@register("rsna_pneumonia_kaggle")
def rsna_pneumonia_kaggle(spark: SparkSession, table_file: str, boxes_file: str | None = None, headers_file: str | None = None) -> Source:
    """RSNA pneumonia, as released on Kaggle: the class of an image is that of its first line. ``boxes``: the label file, of
    which the lines with Target 1 and all coordinates count. ``headers``: a CSV of patientId, PatientAge, PatientSex and
    ViewPosition, if the images' headers were read."""
    lines = _rows_in_order(readers.csv(spark, table_file, columns=["patientId", "class"]))
    rows = lines.groupBy("patientId").agg(F.min_by("class", "line").alias("class"))
    rows = rows.withColumns({c: F.coalesce(F.col("class") == c, F.lit(False)).cast("double") for c in RSNA_PNEUMONIA})
    joins, more = [], {}
    if boxes_file is not None:
        side = F.lit(float(RSNA_PNEUMONIA_SIZE))
        box = _box(*(F.col(c) for c in ("x", "y", "width", "height")), side, side)
        found = _rows_in_order(readers.csv(spark, boxes_file)).where(F.col("Target").try_cast("double") == 1).where(F.forall(box, lambda v: v.isNotNull()))
        lists = found.groupBy("patientId").agg(_listed(box).alias("found"))
        none = F.array().cast("array<array<double>>")
        rows = rows.join(lists, "patientId", "left").withColumn("raw_box", F.coalesce("found", none)).withColumn("raw_label", F.transform("raw_box", lambda _: F.lit("lung_opacity")))
        more |= {"box": "raw_box", "box_labels": "raw_label"}
    if headers_file is not None:
        joins.append(Join(readers.csv(spark, headers_file, columns=["patientId", "PatientAge", "PatientSex", "ViewPosition"]), ("patientId",), "left", "headers"))
        more |= {"age": ("PatientAge", "years"), "sex": "PatientSex", "view": "ViewPosition"}
    return Source(rows, Spec("rsna_pneumonia_kaggle", F.col("patientId"), F.col("patientId"), F.concat("patientId", F.lit(".dcm")), labels=RSNA_PNEUMONIA, joins=tuple(joins), **more))


@register("rsna_bone_age")
def rsna_bone_age(spark: SparkSession, table_file: str, images_file: str | None = None) -> Source:
    """RSNA bone age, train or validation file by its column names: the target ``age_months``, sex from the flag ``male``.
    With ``images``, the folder of the validation images, the path is the sub-folder's; one without a file is dropped."""
    rows = readers.csv(spark, table_file)
    rows = rows.withColumnsRenamed({"Image ID": "id", "Bone Age (months)": "boneage"})
    male = F.lower("male").isin("true", "1")
    rows = rows.withColumns({"age_months": F.col("boneage").try_cast("int"), "sex_female": (~male).cast("int"), "sex_word": F.when(male, "M").when(~male, "F"), "image": F.concat("id", F.lit(".png"))})
    if images_file is not None:
        found = readers.listing(spark, images_file, "*.png").groupBy(F.col("name").alias("image")).agg(F.max(F.regexp_extract("path", "([^/]+/[^/]+)$", 1)).alias("place"))
        rows = rows.join(found, "image", "left").withColumn("image", F.col("place"))
    return Source(rows, Spec("rsna_bone_age", F.col("id"), F.col("id"), F.col("image"), regressions=("age_months",), extra=("sex_female",), sex="sex_word"))


@register("siim_acr_ptx")
def siim_acr_ptx(spark: SparkSession, table_file: str, images_file: str, headers_file: str | None = None) -> Source:
    """SIIM-ACR pneumothorax: the regions of an image, joined by ``|`` in the order of their lines, are its ``mask``; it is
    positive unless they are ``-1``. Patient and study are folders of the image's file; an image without one is dropped."""
    lines = _rows_in_order(readers.csv(spark, table_file))
    runs = next(c for c in lines.columns if c.strip() == "EncodedPixels")
    rows = lines.groupBy("ImageId").agg(F.array_join(_listed(S.strip(F.col(f"`{runs}`"))), "|").alias("mask"))
    place = F.regexp_extract("path", "([^/]+/[^/]+/[^/]+)$", 1)
    found = readers.listing(spark, images_file, "*.dcm").select(F.regexp_replace("name", r"\.dcm$", "").alias("ImageId"), place.alias("image"))
    rows = rows.join(found, "ImageId", "left").withColumns({"patient": F.get(F.split("image", "/"), F.lit(0)), "study": F.get(F.split("image", "/"), F.lit(1)), "pneumothorax": (F.col("mask") != "-1").cast("double"), "view_position": F.lit("Frontal")})
    joins, more = (), {}
    if headers_file is not None:
        joins, more = (Join(readers.csv(spark, headers_file, columns=["ImageId", "PatientAge", "PatientSex"]), ("ImageId",), "left", "headers"),), {"age": ("PatientAge", "years"), "sex": "PatientSex"}
    return Source(rows, Spec("siim_acr_ptx", F.col("patient"), F.col("study"), F.col("image"), labels=("pneumothorax",), extra=("mask",), joins=joins, **more))


@register("vqa_rad")
def vqa_rad(spark: SparkSession, table_file: str) -> Source:
    """VQA-RAD: a question table. The image's name without its ending is patient and study; phrase types that begin with
    ``test_`` are the test split."""
    names = ("qid", "image_name", "question", "answer", "question_type", "answer_type", "image_organ", "phrase_type")
    rows = readers.json_array(spark, table_file, ", ".join(f"{n} string" for n in names))
    stem = F.regexp_replace("image_name", r"(?<=.)\.[^./]*$", "")
    table = rows.select(
        stem.alias("patient_id"), stem.alias("study_id"), F.col("qid").alias("question_id"), F.col("image_name").alias("image_path"), S.strip(F.col("question")).alias("question"), S.strip(F.col("answer")).alias("answer"), "question_type",
        F.when(F.startswith("phrase_type", F.lit("test_")), "test").otherwise("train").alias("split"), S.strip(F.col("answer_type")).alias("answer_type"), "image_organ",
    )
    return Source(rows, questions=R.question_contract(table, ("answer_type", "image_organ")))
