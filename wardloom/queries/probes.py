"""Probes of the embeddings, lexicon tags, corpus label analytics and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation as E
from ..operators import probes as P
from ..sources import readers
from .base import query, r6, table

LABELS = [str(c) for c in range(10)]


def features(spark, d):
    """The embeddings with a 0/1 column for each class; every seventh vector has no labels."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "embedding", *(F.when(F.col("vec_id") % 7 != 0, (F.col("label") == int(c)).cast("int")).alias(c) for c in LABELS))


def split(spark, d):
    rows = features(spark, d)
    test = F.col("vec_id") % 5 == 0
    return rows.where(~test), rows.where(test)


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / n) AS u FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)),
p AS (SELECT q.vec_id, c.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.u, c.u) DESC, c.vec_id) AS r FROM v q JOIN v c ON q.vec_id % 5 = 0 AND c.vec_id % 5 <> 0 AND c.vec_id % 7 <> 0)
SELECT vec_id, k::VARCHAR AS label, round(avg((label = k)::INT), 6)::DOUBLE AS score FROM p, (SELECT unnest(range(10)) AS k) WHERE r <= 20 GROUP BY ALL""")
def ev05_knn_probe(spark, d):
    train, test = split(spark, d)
    return P.knn_scores(train, test, "embedding", "vec_id", LABELS).withColumn("score", r6("score"))


@query()
def ev03_linear_probe(spark, d):
    train, test = split(spark, d)
    return P.linear_scores(test, "embedding", "vec_id", P.fit_linear(train, "embedding", LABELS))


@query()
def ev04_svm_probe(spark, d):
    train, test = split(spark, d)
    return P.linear_scores(test, "embedding", "vec_id", P.fit_linear(train, "embedding", LABELS, "squared_hinge"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / n) AS u FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)),
m AS (SELECT label, list(a ORDER BY i) AS a FROM (SELECT label, i, avg(x) AS a FROM (SELECT label, unnest(u) AS x, unnest(range(64)) AS i FROM v WHERE vec_id % 9 = 0) GROUP BY ALL) GROUP BY ALL)
SELECT vec_id, m.label::VARCHAR AS label, round(list_dot_product(u, a) / sqrt(list_dot_product(a, a)), 6) AS score FROM v, m""")
def ev07_zero_shot(spark, d):
    e = table(spark, d, "embeddings")
    prompts = e.where("vec_id % 9 = 0").select(F.col("label").cast("string").alias("label"), F.lit(1).alias("y"), "embedding")
    return P.zero_shot_scores(e, prompts, "embedding", "vec_id").withColumn("score", r6("score"))


@query()
def ev14_probe_report(spark, d):
    """Fit, thresholds on a tenth of the training rows, the panel on the test rows, and its macro average."""
    train, test = split(spark, d)
    held = E.hash_unit("vec_id", 3) < 0.1
    weights = P.fit_linear(train.where(~held), "embedding", LABELS)
    truth = lambda rows: rows.select("vec_id", F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).alias("y")) for c in LABELS))).alias("l")).select("vec_id", "l.*")
    scored = lambda rows: P.linear_scores(rows, "embedding", "vec_id", weights).join(truth(rows), ["vec_id", "label"])
    cuts = E.thresholds(scored(train.where(held)), ["label"])
    found = scored(test)
    rows = E.panel(found, cuts, ["label"]).drop("tp", "fp", "fn", "tn").join(E.ranking(found, ["label"]), "label")
    return E.with_macro(rows.withColumn("fold", F.lit(0)))


_WORDS = "(['CT of the chest', 'axial section', 'flow chart of a study', 'a leaf', 'chest X-ray and CT', 'T2-weighted image'])"


@query(f"""SELECT doc_id, CASE k WHEN 2 THEN 'non_medical' WHEN 3 THEN CASE WHEN p = 3 THEN 'unknown' WHEN p = 2 THEN 'non_medical' ELSE 'radiology' END ELSE 'radiology' END AS specialty,
  CASE WHEN k = 3 THEN (['ct', 'radiology_other', NULL, NULL, 'ct', 'mri'])[1 + p] ELSE (['ct', 'radiology_other', NULL, NULL, 'ct', 'mri'])[1 + k] END AS modality,
  CASE WHEN k IN (0, 4, 5) THEN 'high' WHEN k = 3 AND p = 3 THEN NULL ELSE 'low' END AS confidence, CASE WHEN k <> 3 THEN 'own' WHEN p <> 3 THEN 'parent' END AS source FROM (SELECT doc_id, doc_id % 6 AS k, (doc_id // 6) % 6 AS p FROM documents)""")
def fs24_caption_tags(spark, d):
    words = F.array(*map(F.lit, ["CT of the chest", "axial section", "flow chart of a study", "a leaf", "chest X-ray and CT", "T2-weighted image"]))
    pick = lambda n: F.get(words, (n % 6).cast("int"))
    t = X.tag_caption(pick(F.col("doc_id")), pick(F.floor(F.col("doc_id") / 6)))
    return table(spark, d, "documents", "doc_id").select("doc_id", t.alias("t")).select("doc_id", "t.specialty", "t.modality", "t.confidence", "t.source")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'ct' WHEN p_size % 3 = 1 THEN NULL ELSE CASE WHEN p_size % 2 = 0 THEN 'ct' END END AS modality FROM part")
def fm23_one_modality(spark, d):
    size = F.col("p_size")
    found = F.when(size % 3 == 0, F.array(F.lit("ct"), F.lit(None), F.lit("ct"))).when(size % 3 == 1, F.array(F.lit("ct"), F.lit("mri"))).otherwise(F.array(F.when(size % 2 == 0, "ct")))
    return table(spark, d, "part").select("p_partkey", X.one_modality(found).alias("modality"))


@query("SELECT c_custkey, 'small ' || c_mktsegment || ' effusion.' AS clean FROM customer")
def fs21_clean_generated(spark, d):
    raw = F.concat(F.lit("[Lungs: Pleura] **small** <ref>"), F.col("c_mktsegment"), F.lit("</ref><box>1,2</box>  effusion."))
    return table(spark, d, "customer").select("c_custkey", X.clean_generated(raw).alias("clean"))


@query("""SELECT user_id, count(*)::BIGINT AS n, avg((event_type = 'error')::INT) > 0.25 AS all_fail, sum((event_type IN ('error', 'view'))::INT)::BIGINT AS n_failed, round(avg((value > 10)::INT), 6)::DOUBLE AS prevalence FROM events GROUP BY user_id""")
def ag34_failure_flags(spark, d):
    share = lambda c: F.avg(c.cast("int"))
    kind = F.col("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), (share(kind == "error") > 0.25).alias("all_fail"), F.count_if(kind.isin("error", "view")).alias("n_failed"), r6(share(F.col("value") > 10)).alias("prevalence"))


@query("""SELECT name, n_rows::BIGINT AS n_rows, n_null::BIGINT AS n_null FROM (SELECT 'toxic' AS name, count(*) AS n_rows, count(*) - count(toxic) AS n_null FROM labels UNION ALL SELECT 'quality', count(*), count(*) - count(quality) FROM labels UNION ALL SELECT 'doc_id', count(*), count(*) - count(doc_id) FROM labels)""")
def sk12_golden_record(spark, d):
    return readers.golden(table(spark, d, "labels")).select("name", "n_rows", "n_null")


@query("""SELECT o_custkey, '{"images":[' || string_agg('{"path":"' || o_orderkey || '","view":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']}' AS manifest FROM orders GROUP BY 1""")
def sk10_study_manifest(spark, d):
    item = F.struct("o_orderkey", F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("view"))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select("o_custkey", F.to_json(F.struct(F.transform("items", lambda x: F.struct(x["path"].alias("path"), x["view"].alias("view"))).alias("images"))).alias("manifest"))


@query("SELECT label, round(avg(loss), 6) AS loss FROM (SELECT c::VARCHAR AS label, -CASE WHEN label = c THEN ln(0.8) ELSE ln(0.9) END AS loss FROM embeddings, (SELECT unnest(range(10)) AS c) WHERE vec_id % 7 <> 0) GROUP BY label")
def ev19_masked_loss(spark, d):
    rows = features(spark, d).select("vec_id", F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).alias("y")) for c in LABELS))).alias("l")).select("l.*").where(F.col("y").isin(0, 1))
    return rows.groupBy("label").agg(r6(F.avg(-F.when(F.col("y") == 1, F.log(F.lit(0.8))).otherwise(F.log(F.lit(0.9))))).alias("loss"))
