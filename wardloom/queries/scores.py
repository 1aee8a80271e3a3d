"""More tables of results, answers, boxes and checks: their summaries, resamples and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import scalars as S
from ..operators import evaluation as E
from ..operators import relational as R
from ..plans import harmonizer as H
from ..sources import readers
from .base import query, r6, table
from .evaluation import _RESULTS, _SCORED, results, scored


@query("SELECT l_orderkey, string_agg(l_linenumber || ':' || lower(l_returnflag), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS boxes FROM lineitem GROUP BY 1")
def ag04_parallel_lists(spark, d):
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    lists = lists.select("l_orderkey", F.transform("items", lambda x: x["l_linenumber"].cast("string")).alias("bbox"), F.transform("items", lambda x: S.box_label(x["l_returnflag"])).alias("bbox_labels"))
    return lists.select("l_orderkey", F.array_join(F.zip_with("bbox", "bbox_labels", lambda a, b: F.concat_ws(":", a, b)), ",").alias("boxes"))


@query("SELECT l_orderkey, l_linenumber, n_rows FROM (SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n_rows FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) GROUP BY ALL HAVING count(*) > 1) JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def ag10_conflicting_keys(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.conflicting_keys(rows, ["l_orderkey", "l_linenumber"]).join(done, "l_orderkey", "left_semi")


@query(f"SELECT label, unnest(['auroc', 'f1']) AS metric, unnest([n, n])::BIGINT AS n_runs, unnest([a, b])::BIGINT AS n_missing FROM (SELECT label, count(*) AS n, count(*) - count(auroc) AS a, count(*) - count(f1) AS b FROM {_RESULTS} GROUP BY label)")
def ag13_missing_runs(spark, d):
    return E.missing_runs(results(spark, d))


@query(f"SELECT fold, bootstrap, round(avg(auroc), 6) AS auroc FROM {_RESULTS} WHERE label <> '0' GROUP BY ALL")
def ag15_macro_without_background(spark, d):
    return E.with_macro(results(spark, d), background="0").where("label = 'macro_average'").select("fold", "bootstrap", r6("auroc").alias("auroc"))


@query("SELECT l_returnflag AS label, round(avg(tp / nullif(tp + fp, 0)::DOUBLE), 6) AS ppv, round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE), 6) AS dice FROM (SELECT l_returnflag, l_orderkey, count(*) FILTER (l_quantity > 25 AND l_discount > 0.05) AS tp, count(*) FILTER (l_quantity <= 25 AND l_discount > 0.05) AS fp, count(*) FILTER (l_quantity > 25 AND l_discount <= 0.05) AS fn FROM lineitem GROUP BY ALL) GROUP BY 1")
def ag21_mean_over_images(spark, d):
    real, said = F.col("l_quantity") > 25, F.col("l_discount") > 0.05
    counts = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("label"), "l_orderkey").agg(F.count_if(real & said).alias("tp"), F.count_if(~real & said).alias("fp"), F.count_if(real & ~said).alias("fn"), F.count_if(~real & ~said).alias("tn"))
    return E.overlap_panel(counts).groupBy("label").agg(r6(F.avg("ppv")).alias("ppv"), r6(F.avg("dice")).alias("dice"))


@query("""WITH t AS (SELECT o_orderkey % 3 = 0 AS closed, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 2 = 0)::INT::DOUBLE ELSE CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 2 * 1 / 3.0 END END AS f1 FROM orders)
SELECT kind, round(avg(f1), 6)::DOUBLE AS f1, count(*)::BIGINT AS n FROM (SELECT 'overall' AS kind, f1 FROM t UNION ALL SELECT CASE WHEN closed THEN 'closed' ELSE 'open' END, f1 FROM t) GROUP BY kind""")
def ag22_answer_scores(spark, d):
    n = F.col("o_orderkey")
    reference = F.when(n % 3 == 0, "yes").otherwise("left lung")
    answer = F.when(n % 3 == 0, F.when(n % 2 == 0, "Yes.").otherwise("no")).otherwise(F.when(n % 2 == 0, "The left lung").otherwise("lung"))
    rows = table(spark, d, "orders").select(S.token_f1(answer, reference).alias("f1"), S.is_closed(reference).alias("closed"))
    # Each row counts twice, for all and for its kind, after its score is known.
    kinds = F.explode(F.array(F.lit("overall"), F.when(F.col("closed"), "closed").otherwise("open")))
    return rows.select(kinds.alias("kind"), "f1").groupBy("kind").agg(r6(F.avg("f1")).alias("f1"), F.count("*").alias("n"))


@query("SELECT count(*) FILTER (c_mktsegment = 'BUILDING')::BIGINT AS n_rows, count(DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey END)::BIGINT AS n_nations FROM customer")
def ag26_source_counts(spark, d):
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").agg(F.count("*").alias("n_rows"), F.count_distinct("c_nationkey").alias("n_nations"))


@query(f"""WITH s AS (SELECT label, avg(auroc) FILTER (bootstrap = -1) AS mean, stddev_samp(auroc) FILTER (bootstrap = -1) AS std, quantile_cont(auroc, 0.025) FILTER (bootstrap >= 0) AS ci_lo, quantile_cont(auroc, 0.975) FILTER (bootstrap >= 0) AS ci_hi FROM {_RESULTS} GROUP BY label)
SELECT label, round(mean, 6) AS mean, round(std, 6) AS std, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi FROM (SELECT * FROM s UNION ALL SELECT 'macro_average', avg(mean), NULL, avg(ci_lo), avg(ci_hi) FROM s)""")
def ag33_external_summary(spark, d):
    return E.external_summary(results(spark, d), "auroc").select("label", *(r6(c).alias(c) for c in ("mean", "std", "ci_lo", "ci_hi")))


@query(f"SELECT label, round(100 * avg((y <> (score > 0)::INT)::INT), 1)::DOUBLE AS failed, count(*) FILTER (y = 0 AND score > 0)::BIGINT AS fp, count(*) FILTER (y = 1 AND score <= 0)::BIGINT AS fn, round(100 * avg(y), 1)::DOUBLE AS prevalence FROM {_SCORED} GROUP BY label")
def ag35_failure_summary(spark, d):
    said = (F.col("score") > 0).cast("int")
    return scored(spark, d).groupBy("label").agg(F.round(100 * F.avg((F.col("y") != said).cast("int")), 1).alias("failed"), F.count_if((F.col("y") == 0) & (said == 1)).alias("fp"), F.count_if((F.col("y") == 1) & (said == 0)).alias("fn"), F.round(100 * F.avg("y"), 1).alias("prevalence"))


_DRAWS = "(SELECT label AS model, bootstrap, round(avg(auroc), 6) AS s FROM {0} WHERE bootstrap >= 0 AND fold = {1} GROUP BY ALL)"


@query(f"""WITH x AS {_DRAWS.format(_RESULTS, 0)}, z AS {_DRAWS.format(_RESULTS, 1)}, m AS (SELECT model, bootstrap, x.s AS s, z.s AS t FROM x JOIN z USING (model, bootstrap))
SELECT a.model AS a, b.model AS b, round(avg((a.s > b.s AND a.t < b.t)::INT), 6)::DOUBLE AS p_flip FROM m a JOIN m b ON a.bootstrap = b.bootstrap AND a.model <> b.model GROUP BY ALL""")
def ag37_flip_probability(spark, d):
    rows = results(spark, d).where("bootstrap >= 0")
    setting = lambda f: rows.where(F.col("fold") == f).groupBy(F.col("label").alias("model"), "bootstrap").agg(r6(F.avg("auroc")).alias("score"))
    return E.flip_probability(setting(0), setting(1), ["bootstrap"]).select("a", "b", r6("p_flip").alias("p_flip"))


@query("""WITH u AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE / n) AS u FROM (SELECT *, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) WHERE n > 0),
m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(u) AS x, unnest(range(64)) AS i FROM u) GROUP BY ALL)
SELECT label, round(max(x) FILTER (i = 0) / sqrt(sum(x * x)), 6) AS first, round(sum(x) / sqrt(sum(x * x)), 6) AS total FROM m GROUP BY label""")
def ag39_centroids(spark, d):
    c = E.centroids(table(spark, d, "embeddings", "label", "embedding"), "embedding", ["label"])
    return c.select("label", r6(F.col("centroid")[0]).alias("first"), r6(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END)::INT AS n, CASE WHEN p_size % 2 = 0 THEN 0.02::DOUBLE END AS y0 FROM part")
def ag41_boxes_readers_agree_on(spark, d):
    # Readers a and b agree where the size is even; c's box stands alone, and a's second box is of the same reader.
    box = lambda reader, y, x: F.struct(F.lit(reader).alias("reader"), F.array(F.lit(y), F.lit(y + 0.4), F.lit(x), F.lit(x + 0.4)).alias("box"))
    near = F.when(F.col("p_size") % 2 == 0, box("b", 0.04, 0.0)).otherwise(box("a", 0.04, 0.0))
    merged = B.merge_readers(F.array(box("a", 0.0, 0.0), near, box("c", 0.5, 0.5)))
    return table(spark, d, "part").select("p_partkey", F.size(merged).alias("n"), r6(F.get(F.get(merged, F.lit(0)), F.lit(0))).alias("y0"))


@query("SELECT o_orderkey, CASE WHEN r <= ceil(n * 0.1) THEN 'val' ELSE 'fit' END AS part FROM orders JOIN (SELECT o_custkey, row_number() OVER (ORDER BY md5(o_custkey || ':7'), o_custkey) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)) USING (o_custkey)")
def sp04_inner_validation(spark, d):
    return E.carve_val(table(spark, d, "orders", "o_orderkey", "o_custkey"), "o_custkey", 0.1, 7).select("o_orderkey", "part")


@query("SELECT s AS seed, n AS n_train, b::INT AS bootstrap FROM (SELECT unnest([1, 2, 3]) AS s), (SELECT unnest([100, -1]) AS n), (SELECT unnest(range(-1, 4)) AS b)")
def sp06_grid_of_runs(spark, d):
    return E.grid(spark, [1, 2, 3], [100, -1], 4)


@query("SELECT CASE l_linestatus WHEN 'F' THEN 'train' ELSE 'test' END AS split, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def sp07_given_splits(spark, d):
    rows = table(spark, d, "lineitem", "l_linestatus").withColumn("split", F.when(F.col("l_linestatus") == "F", "train").otherwise("test"))
    parts = [R.keep_split(rows, s) for s in ("train", "test")]
    return parts[0].unionByName(parts[1]).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT coalesce(lang, 'd/' || doc_id) AS group_id, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def sp08_group_ids(spark, d):
    return table(spark, d, "documents").groupBy(F.coalesce("lang", F.concat(F.lit("d/"), F.col("doc_id").cast("string"))).alias("group_id")).agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT label, 0.1::DOUBLE AS threshold, (vec_id % 4 - 1)::INT AS bootstrap, y, score >= 0.1 AS hit FROM {_SCORED})
SELECT label, bootstrap, tp::BIGINT AS tp, fp::BIGINT AS fp, CASE WHEN p >= 2 AND n >= 2 THEN round(tp / p::DOUBLE, 6) END AS tpr FROM (SELECT label, bootstrap, count(*) FILTER (hit AND y = 1) AS tp, count(*) FILTER (hit AND y = 0) AS fp, sum(y) AS p, sum(1 - y) AS n FROM c GROUP BY ALL)""")
def ev17_panel_of_draws(spark, d):
    # The threshold of a label holds for its point rows and for all its draws.
    rows = scored(spark, d).withColumn("bootstrap", (F.col("vec_id") % 4 - 1).cast("int"))
    cuts = E.thresholds(rows, ["label"], "fixed:0.1").join(rows.select("label", "bootstrap").distinct(), "label")
    return E.panel(rows, cuts, ["label", "bootstrap"]).select("label", "bootstrap", "tp", "fp", r6("tpr").alias("tpr"))


@query("SELECT 'quality' AS name, count(*) - count(quality) AS n_missing FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'lang', count(*) - count(lang) FROM documents")
def qg03_missing_keys(spark, d):
    df = table(spark, d, "documents", "doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return readers.golden(df).where("name IN ('quality', 'toxic', 'lang')").select("name", F.col("n_null").alias("n_missing"))


def _people(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("image_path"), F.col("c_nationkey").cast("string").alias("patient_id"), F.lit("s").alias("study_id"), F.when(F.col("c_acctbal") > 0, 1.0).alias("rich"))


@query("SELECT 'n_images' AS name, count(*)::BIGINT AS found, (count(*) = 150)::BOOLEAN AS as_expected FROM customer UNION ALL SELECT 'n_patients', count(DISTINCT c_nationkey), count(DISTINCT c_nationkey) = 25 FROM customer UNION ALL SELECT 'pos_rich', count(*) FILTER (c_acctbal > 0), false FROM customer")
def qg07_expected_statistics(spark, d):
    expected = F.create_map(*(F.lit(x) for p in {"n_images": 150, "n_patients": 25, "pos_rich": -1}.items() for x in p))
    stats = H.statistics(_people(spark, d), ["rich"])
    return stats.unpivot([], ["n_images", "n_patients", "pos_rich"], "name", "found").withColumn("as_expected", F.element_at(expected, F.col("name")).cast("long") == F.col("found"))


@query("SELECT unnest(['image_path', 'patient_id', 'study_id', 'rich']) AS name, unnest([true, true, true, count(*) FILTER (c_acctbal > 0) = 0]) AS same FROM customer")
def qg08_golden_changes(spark, d):
    old, new = _people(spark, d), _people(spark, d).withColumn("rich", F.col("rich") * 2)
    return readers.golden(old).alias("o").join(readers.golden(new).alias("n"), "name").select("name", (F.col("o.hash") == F.col("n.hash")).alias("same"))


@query("SELECT c_mktsegment AS dataset, count(*)::BIGINT AS n_rows, CASE WHEN count(*) FILTER (c_acctbal > 0) = 0 THEN 'WARN' ELSE 'OK' END AS status FROM customer GROUP BY 1")
def qg09_check_of_many(spark, d):
    return qg09_check_of_all(spark, d)


@query("SELECT c_mktsegment AS dataset, count(*)::BIGINT AS n_rows, CASE WHEN count(*) FILTER (c_acctbal > 0) = 0 THEN 'WARN' ELSE 'OK' END AS status FROM customer GROUP BY 1")
def qg09_check_of_all(spark, d):
    c = _people(spark, d).join(table(spark, d, "customer", F.col("c_custkey").cast("string").alias("image_path"), F.col("c_mktsegment").alias("dataset")), "image_path")
    return H.integrity(c, ["rich"], keys=["dataset"]).select("dataset", "n_rows", "status")
