"""Named sources over files in their formats, written from the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans import sources
from ..sources import scratch, stores
from .base import query, r6, table
from .relational import _LINES, lines

CSV = {"header": True, "quote": '"', "escape": '"'}


def _csv(df, *names: str) -> str:
    path = scratch.folder(df.sparkSession)
    (df.toDF(*names) if names else df).write.options(**CSV).csv(path)
    return path


def _cases(column: str, labels) -> str:
    return ", ".join(f"regexp_matches({column}, '{c.replace('_', '[_ ]')}')::INT::DOUBLE AS \"{sources.scalars_snake(c)}\"" for c in labels)


_X14 = list(sources.CHESTXRAY14)
_FINDINGS = "(CASE WHEN o_custkey % 4 = 0 THEN 'No Finding' ELSE (" + str(_X14) + ")[1 + o_custkey % 15] || '|' || (" + str([c.replace("_", " ") for c in _X14]) + ")[1 + o_orderkey % 15] END)"
_X14_SEX = "(['M', 'F', 'U', 'male'])[1 + o_orderkey % 4]"
_X14_ROWS = f"""SELECT o_custkey::VARCHAR AS patient_id, o_custkey || '_' || (o_orderkey % 7) AS study_id, o_orderkey || '.png' AS image_path, CASE WHEN o_orderkey % 2 = 0 THEN 'PA' ELSE 'AP' END AS view_position, {{}}
  CASE WHEN o_orderkey % 200 <= 130 THEN (o_orderkey % 200)::DOUBLE END AS age_years, CASE o_orderkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 3 THEN 'M' END AS sex, {_cases(_FINDINGS, _X14)} FROM orders"""


def _x14_files(spark, d) -> dict[str, str]:
    o, pick = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice"), lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    finding = F.when(who % 4 == 0, "No Finding").otherwise(F.concat_ws("|", pick(_X14, who % 15), pick([c.replace("_", " ") for c in _X14], key % 15)))
    name = F.concat(key.cast("string"), F.lit(".png"))
    rows = o.select(name, finding, key % 7, who, key % 200, pick(["M", "F", "U", "male"], key % 4), F.when(key % 2 == 0, "PA").otherwise("AP"), F.lit(1))
    boxes = o.where("o_totalprice > 150000").select(name, pick(["Infiltrate", "Mass"], key % 2), key % 900, key % 500, F.lit(200), key % 90, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return {
        "table": _csv(rows, "Image Index", "Finding Labels", "Follow-up #", "Patient ID", "Patient Age", "Patient Gender", "View Position", "OriginalImage[Width"),
        "boxes": _csv(boxes, "Image Index", "Finding Label", "Bbox [x", "y", "w", "h]", "", "_1", "_2"),
        "sizes": _csv(o.select(name, F.lit(1000), F.lit(500)), "Image Index", "width", "height"),
    }


@query(_X14_ROWS.format("") + " WHERE o_totalprice <= 150000 OR o_totalprice IS NULL")
def sr01_chestxray14(spark, d):
    files = _x14_files(spark, d)
    return sources.build(spark, "chestxray14", {k: files[k] for k in ("table", "boxes")})


_X14_BOX = "[round((o_orderkey % 500) / 500, 6), round(least(1.0, (o_orderkey % 500 + o_orderkey % 90) / 500), 6), round((o_orderkey % 900) / 1000, 6), round(least(1.0, (o_orderkey % 900 + 200) / 1000), 6)]::DOUBLE[]"


@query(_X14_ROWS.format(f"{_X14_BOX} AS bbox, CASE WHEN o_orderkey % 2 = 0 THEN 'infiltration' ELSE 'mass' END AS bbox_label,") + " WHERE o_totalprice > 150000 AND o_orderkey % 90 > 0")
def sr02_chestxray14_boxes(spark, d):
    built = sources.build(spark, "chestxray14_bbox", _x14_files(spark, d))
    box = F.get("bbox", F.lit(0))
    return built.withColumns({"bbox": F.transform(box, lambda v: F.round(v, 6)), "bbox_label": F.get("bbox_labels", F.lit(0))}).drop("bbox_labels")


def _codes(key: str, labels) -> dict[str, str]:
    """1, 0, blank or uncertain, by label and key; every eleventh row has none at all."""
    return {c: f"CASE WHEN {key} % 11 = 0 THEN NULL WHEN {key} % 37 = {i} THEN -1 WHEN ({key} + {i}) % 3 = 0 THEN 1 WHEN ({key} + {i}) % 3 = 1 THEN 0 END" for i, c in enumerate(labels)}


def _coded(key: str, labels) -> str:
    return ", ".join(f"CASE WHEN {key} % 11 = 0 THEN NULL ELSE coalesce({x}, 0) END::DOUBLE AS {sources.scalars_snake(c)}" for c, x in _codes(key, labels).items())


def _certain(key: str, labels) -> str:
    return f"({key} % 11 = 0 OR {key} % 37 >= {len(labels)})"


@query(f"""SELECT 'p' || o_custkey AS patient_id, 'p' || o_custkey || '_s' || o_orderkey % 5 AS study_id, 'p' || o_custkey || '/s' || o_orderkey % 5 || '/' || o_orderkey || '.jpg' AS image_path,
  CASE o_orderkey % 4 WHEN 0 THEN 'LATERAL' WHEN 1 THEN 'AP' WHEN 2 THEN 'PA' END AS view_position, (o_orderkey % 90)::DOUBLE AS age_years, CASE o_orderkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS sex,
  {_coded("o_orderkey", sources.CHEXPERT)}, c_mktsegment AS race, n_name AS ethnicity FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = c_nationkey WHERE {_certain("o_orderkey", sources.CHEXPERT)}""")
def sr03_chexpert(spark, d):
    o, key = table(spark, d, "orders"), "o_orderkey"
    path = F.expr("concat('CheXpert/train/p', o_custkey, '/s', o_orderkey % 5, '/', o_orderkey, '.jpg')")
    view = F.get(F.array(F.lit(None).cast("string"), F.lit("AP"), F.lit("PA"), F.lit("LL")), F.expr("int(o_orderkey % 4)"))
    rows = o.select(path.alias("Path"), F.expr("element_at(array('Male', 'Female', 'Unknown'), int(1 + o_orderkey % 3))").alias("Sex"), F.expr("o_orderkey % 90").alias("Age"), F.when(F.col(key) % 4 == 0, "Lateral").otherwise("Frontal").alias("Frontal/Lateral"), view.alias("AP/PA"), *(F.expr(x).alias(c) for c, x in _codes(key, sources.CHEXPERT).items()))
    c = table(spark, d, "customer").where("c_acctbal > 0").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    people = c.select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("PATIENT"), F.lit("x").alias("GENDER"), F.col("c_mktsegment").alias("PRIMARY_RACE"), F.col("n_name").alias("ETHNICITY"))
    return sources.build(spark, "chexpert", {"table": _csv(rows), "people": _csv(people)})


@query(f"""SELECT p.patient_id, p.study_id, p.patient_id || '/' || p.study_id || '/' || p.page_id || '.jpg' AS image_path, CASE WHEN page_id % 3 > 0 THEN md5(html) END AS report, {_coded("page_id", sources.CHEXPERT)}
  FROM (SELECT page_id, html, (page_id % 50)::VARCHAR AS patient_id, page_id::VARCHAR AS study_id FROM pages) p WHERE page_id % 10 <> 7 AND {_certain("page_id", sources.CHEXPERT)}""")
def sr04_mimic_cxr(spark, d):
    p, texts = table(spark, d, "pages"), scratch.folder(spark)
    ids = [F.expr("page_id % 50").alias("subject_id"), F.col("page_id").alias("study_id")]
    rows = p.select(*ids, F.expr("concat('files/', page_id % 50, '/', page_id, '/', page_id, '.jpg')").alias("path"))
    labels = p.where("page_id % 10 <> 7").select(*ids, *(F.expr(x).alias(c) for c, x in _codes("page_id", sources.CHEXPERT).items()))
    reports = p.select(*ids, F.expr("concat('files/', page_id % 50, '/', page_id, '.txt')").alias("path"))
    stores.write_files(p.where("page_id % 3 > 0").select(F.expr("concat(page_id % 50, '/', page_id, '.txt')").alias("name"), F.col("html").alias("content")), f"{texts}/out")
    moved = f"{texts}/out"
    built = sources.build(spark, "mimic_cxr", {"table": _csv(rows), "labels": _csv(labels), "reports": _csv(reports), "texts": moved})
    return built.withColumn("report", F.md5(F.col("report").cast("binary")))


_KAGGLE = "(SELECT l_orderkey, min(l_linenumber) AS first, list([l_suppkey % 40 * 20.0 / 1024, least(1.0, (l_suppkey % 40 * 20.0 + 300) / 1024), l_partkey % 50 * 20.0 / 1024, least(1.0, (l_partkey % 50 * 20.0 + l_quantity) / 1024)]::DOUBLE[] ORDER BY l_linenumber) FILTER (l_returnflag = 'R') AS boxes FROM " + _LINES + " GROUP BY 1)"


@query(f"""SELECT l_orderkey::VARCHAR AS patient_id, l_orderkey::VARCHAR AS study_id, l_orderkey || '.dcm' AS image_path, coalesce(len(boxes), 0)::INT AS n_boxes, coalesce(round(list_sum(list_transform(boxes, lambda b: list_sum(b))), 6), 0)::DOUBLE AS sum_boxes,
  (l_orderkey % 3 = 0)::INT::DOUBLE AS lung_opacity, (l_orderkey % 3 = 1)::INT::DOUBLE AS "no_lung_opacity_/_not_normal", (l_orderkey % 3 = 2)::INT::DOUBLE AS normal FROM {_KAGGLE}""")
def sr05_rsna_pneumonia(spark, d):
    rows = lines(spark, d).repartitionByRange("l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber")
    first = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    classes = rows.withColumn("n", first).select(F.col("l_orderkey").alias("patientId"), F.expr("element_at(array('Lung Opacity', 'No Lung Opacity / Not Normal', 'Normal'), int(1 + (l_orderkey + n - 1) % 3))").alias("class"), "n").repartitionByRange("patientId").sortWithinPartitions("patientId", "n").drop("n")
    boxes = rows.select(F.col("l_orderkey").alias("patientId"), F.expr("l_partkey % 50 * 20.0").alias("x"), F.expr("l_suppkey % 40 * 20.0").alias("y"), F.col("l_quantity").alias("width"), F.lit(300.0).alias("height"), (F.col("l_returnflag") == "R").cast("int").alias("Target"))
    built = sources.build(spark, "rsna_pneumonia_kaggle", {"table": _csv(classes), "boxes": _csv(boxes)})
    total = F.aggregate(F.flatten("bbox"), F.lit(0.0), lambda s, x: s + x)
    return built.withColumns({"n_boxes": F.size("bbox"), "sum_boxes": r6(total)}).drop("bbox", "bbox_labels")


@query("SELECT vec_id::VARCHAR AS patient_id, vec_id::VARCHAR AS study_id, vec_id || '.png' AS image_path, CASE WHEN label % 2 = 0 THEN 'M' ELSE 'F' END AS sex, (label * 12 + 3)::INT AS age_months, (label % 2)::INT AS sex_female FROM embeddings")
def sr06_rsna_bone_age(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id"), F.initcap((F.col("label") % 2 == 0).cast("string")), F.expr("label * 12 + 3"))
    return sources.build(spark, "rsna_bone_age", {"table": _csv(rows, "Image ID", "male", "Bone Age (months)")})


@query("""SELECT 'p' || page_id % 20 AS patient_id, 's' || page_id AS study_id, 'p' || page_id % 20 || '/s' || page_id || '/' || page_id || '.dcm' AS image_path, 'Frontal' AS view_position, (page_id % 3 > 0)::INT::DOUBLE AS pneumothorax,
  CASE page_id % 3 WHEN 0 THEN '-1' WHEN 1 THEN page_id || ' 5' ELSE page_id || ' 5|' || page_id + 9 || ' 2' END AS mask FROM pages""")
def sr07_siim_acr_ptx(spark, d):
    p, images = table(spark, d, "pages"), scratch.folder(spark)
    runs = F.expr("CASE page_id % 3 WHEN 0 THEN array('-1') WHEN 1 THEN array(concat(page_id, ' 5')) ELSE array(concat(page_id, ' 5 '), concat(page_id + 9, ' 2')) END")
    rows = p.select("page_id", F.posexplode(runs)).repartitionByRange("page_id").sortWithinPartitions("page_id", "pos").select("page_id", F.concat(F.lit(" "), "col"))
    stores.write_files(p.select(F.expr("concat('p', page_id % 20, '/s', page_id, '/', page_id, '.dcm')").alias("name"), F.lit("x").alias("content")), images)
    return sources.build(spark, "siim_acr_ptx", {"table": _csv(rows, "ImageId", " EncodedPixels"), "images": images})


@query("""SELECT 'img' || conv_id AS patient_id, 'img' || conv_id AS study_id, conv_id || '-' || turn AS question_id, 'img' || conv_id || '.jpg' AS image_path, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS question, role AS answer, 'kind' AS question_type,
  CASE WHEN turn % 4 = 0 THEN 'test' ELSE 'train' END AS split, 'CLOSED' AS answer_type, 'CHEST' AS image_organ FROM conversations""")
def sr08_vqa_rad(spark, d):
    c, path = table(spark, d, "conversations"), scratch.folder(spark)
    record = F.struct(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("qid"), F.concat(F.lit("img"), F.col("conv_id").cast("string"), F.lit(".jpg")).alias("image_name"), F.concat(F.lit(" "), "text", F.lit(" \n")).alias("question"), F.concat("role", F.lit(" ")).alias("answer"), F.lit("kind").alias("question_type"), F.lit("CLOSED ").alias("answer_type"), F.lit("CHEST").alias("image_organ"), F.when(F.col("turn") % 4 == 0, "test_para").otherwise("freeform").alias("phrase_type"))
    # A file holds one array: rows of one input part, 65,536 at most, and each file has a folder of its own.
    rows = c.withColumn("file", F.shiftright(F.monotonically_increasing_id(), 16)).groupBy("file").agg(F.to_json(F.collect_list(record)).alias("value"))
    rows.write.partitionBy("file").text(path)
    built = sources.build(spark, "vqa_rad", {"table": path})
    return built.withColumn("question", F.md5(F.col("question").cast("binary")))
