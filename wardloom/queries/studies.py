"""Studies, visits and folders: filters, joins and numberings that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import masks
from ..operators import relational as R
from ..operators import stratify
from .base import query, table


@query("SELECT o_orderkey, CASE WHEN o_orderdate IS NOT NULL THEN dense_rank() OVER w END::INT AS visit_number, date_diff('day', min(o_orderdate) OVER w, o_orderdate)::INT AS days_from_first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)")
def wn15_visits_and_days(spark, d):
    rows = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return R.visits(rows, "o_custkey", "o_orderdate").select("o_orderkey", "visit_number", "days_from_first")


@query("SELECT event_id, event_type FROM events WHERE event_type IS NOT NULL AND lower(trim(event_type)) NOT IN ('view', 'click')")
def pf22_without_controls(spark, d):
    return R.keep_positives(table(spark, d, "events", "event_id", "event_type"), "event_type", ("view", "click"))


@query("""SELECT 'p/' || o_orderkey AS folder, CASE WHEN n IS NULL THEN 'missing' WHEN n = 0 THEN 'empty' ELSE 'ok' END AS status
  FROM orders LEFT JOIN (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_partkey END) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) ON l_orderkey = o_orderkey""")
def pf24_folders_of_series(spark, d):
    expected = table(spark, d, "orders").select(F.concat(F.lit("p/"), "o_orderkey", F.lit("/1.dcm")).alias("path"))
    files = table(spark, d, "lineitem").where("l_linenumber > 1")
    size = F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_partkey"))
    listing = files.select(F.concat(F.lit("p/"), "l_orderkey", F.lit("/"), "l_linenumber", F.lit(".dcm")).alias("path"), size.alias("length"))
    return R.folder_status(expected, listing, "path")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN page_id IS NULL THEN 'missing' WHEN coalesce(html, '') NOT LIKE '%</html>%' THEN 'unreadable' ELSE 'ok' END AS status
  FROM documents LEFT JOIN (SELECT * FROM pages WHERE page_id % 7 > 0) ON page_id = doc_id) GROUP BY 1""")
def pf25_missing_and_unreadable(spark, d):
    # Every seventh page stands for a file that is not there.
    files = table(spark, d, "pages", "page_id", "html").where("page_id % 7 > 0").withColumnRenamed("page_id", "doc_id")
    status = R.file_status(table(spark, d, "documents", "doc_id"), files, "doc_id", F.col("html").contains("</html>"))
    return status.groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT doc_id, quality AS \"Lung Opacity\", toxic AS \"Other diseases\" FROM labels")
def pf27_names_of_releases(spark, d):
    old = table(spark, d, "labels").select("doc_id", F.col("quality").alias("Airspace Opacity"), F.col("toxic").alias("Other disease"))
    return R.renamed_labels(old, {"Airspace Opacity": "Lung Opacity", "Other disease": "Other diseases"})


@query("SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def jn08_labels_of_patients_to_series(spark, d):
    patients = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    series = table(spark, d, "lineitem", "l_orderkey", "l_linenumber")
    return series.join(patients, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderpriority")


@query("SELECT event_id, c_name, c_nationkey::BIGINT AS c_nationkey FROM events JOIN customer ON user_id = c_custkey")
def jn10_keys_of_two_names(spark, d):
    right = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey")
    joined = table(spark, d, "events", "event_id", "user_id").join(right, F.col("user_id") == F.col("c_custkey")).drop("c_custkey", "user_id")
    return joined.withColumn("c_nationkey", F.col("c_nationkey").cast("long"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def jn23_results_not_there(spark, d):
    missing, _ = R.missing_and_unused(table(spark, d, "documents", "doc_id"), table(spark, d, "labels", "doc_id"), "doc_id")
    return missing


@query("SELECT doc_id, [1 - quality, quality, toxic] AS cls FROM labels")
def st01_order_of_classes(spark, d):
    wide = table(spark, d, "labels").select("doc_id", F.col("quality").alias("Good Text"), F.col("toxic").alias("toxic"), (1 - F.col("quality")).alias("bad text"))
    return wide.select("doc_id", F.array(*(F.col(f"`{c}`") for c in R.label_columns(set(wide.columns) - {"doc_id"}))).alias("cls"))


@query("SELECT p_partkey, nullif(regexp_extract(p_brand, '[0-9]{2}'), '') AS found, nullif(regexp_extract(p_name, '[aeiou]{2}'), '') AS pair FROM part")
def fs09_whole_match_or_null(spark, d):
    found = lambda c, p: F.regexp_substr(c, F.lit(p))
    return table(spark, d, "part").select("p_partkey", found("p_brand", "[0-9]{2}").alias("found"), found("p_name", "[aeiou]{2}").alias("pair"))


@query("SELECT page_id, regexp_replace(url, '^https?://[^/]+/', '') AS inner_path, ltrim(split_part(url, '://', 1), 'ht') AS rest FROM pages")
def sb12_relative_paths(spark, d):
    return table(spark, d, "pages", "page_id", "url").select("page_id", F.regexp_replace("url", "^https?://[^/]+/", "").alias("inner_path"), F.ltrim(S.part(F.col("url"), "://", 0), F.lit("ht")).alias("rest"))


@query("SELECT o_orderkey, repeat('lung_opacity;', count(l_linenumber)::INT) AS labels, count(l_linenumber)::INT AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def fa13_label_for_each_box(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("boxes"))
    n = F.coalesce(F.size("boxes"), F.lit(0))
    rows = table(spark, d, "orders", "o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.greatest(n, F.lit(0)).alias("n"))
    return rows.select("o_orderkey", F.concat_ws("", F.array_repeat(F.lit("lung_opacity;"), F.col("n"))).alias("labels"), "n")


_FLAGS = "(SELECT doc_id, quality, toxic, (lang = 'en')::INT AS en, (source = (SELECT min(source) FROM documents))::INT AS own FROM labels LEFT JOIN documents USING (doc_id))"


@query(f"""SELECT part, label, n_all, true AS near FROM (SELECT unnest(range(4))::INT AS part), (
  SELECT label, coalesce(sum(v) FILTER (v = 1), 0)::BIGINT AS n_all FROM (UNPIVOT {_FLAGS} ON quality, toxic, en, own INTO NAME label VALUE v) GROUP BY 1)""")
def st13_stratified_parts(spark, d):
    """Labelled documents in four parts of 10, 20, 30 and 40 percent: the labels' rows of each part are within two of their share."""
    docs = table(spark, d, "documents", "doc_id", "lang", "source")
    least = docs.agg(F.min("source").alias("least"))
    flags = table(spark, d, "labels").join(docs, "doc_id", "left").join(F.broadcast(least))
    labels, shares = ["quality", "toxic", "en", "own"], [0.1, 0.2, 0.3, 0.4]
    flags = flags.select("doc_id", "quality", "toxic", (F.col("lang") == "en").cast("int").alias("en"), (F.col("source") == F.col("least")).cast("int").alias("own"))
    parts = stratify.stratified(flags, "doc_id", labels, shares)
    counts = parts.groupBy("part").agg(*(F.count_if(F.col(c) == 1).alias(c) for c in labels)).unpivot("part", labels, "label", "n")
    totals = counts.groupBy("label").agg(F.sum("n").alias("n_all"))
    share = F.get(F.array(*map(F.lit, shares)), "part")
    return counts.join(totals, "label").select("part", "label", "n_all", (F.abs(F.col("n") - F.col("n_all") * share) <= 2).alias("near"))


@query("""WITH p AS (SELECT DISTINCT l_orderkey, (l_partkey % 40) * 30 + unnest(range(l_linenumber, l_linenumber + 1 + l_suppkey % 50)) AS p FROM lineitem),
r AS (SELECT l_orderkey, p, p - row_number() OVER (PARTITION BY l_orderkey ORDER BY p) AS i FROM p),
s AS (SELECT l_orderkey, min(p) AS a, count(*) AS n FROM r GROUP BY l_orderkey, i),
m AS (SELECT l_orderkey, string_agg((a + 1) || ' ' || n, ' ' ORDER BY a) AS mask, sum(n)::BIGINT AS area FROM s GROUP BY 1)
SELECT o_orderkey, coalesce(mask, '-1') AS mask, coalesce(area, 0) AS area, true AS same FROM orders LEFT JOIN m ON l_orderkey = o_orderkey""")
def ud04_masks_encoded(spark, d):
    """Lines as runs of pixels, drawn and encoded, and decoded again in both forms."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders", "o_orderkey")
    first = (F.col("l_partkey") % 40) * 30 + F.col("l_linenumber")
    pixels = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.explode(F.sequence(first, first + F.col("l_suppkey") % 50)).alias("pixel"))
    plain, gaps = masks.encode(pixels, orders, ["o_orderkey"]), masks.encode(pixels, orders, ["o_orderkey"], gaps=True, stretch=64)
    both = plain.join(gaps.withColumnRenamed("mask", "gaps"), "o_orderkey").select("o_orderkey", "mask", masks.runs(F.col("mask")).alias("a"), masks.runs_of_gaps(F.col("gaps")).alias("b"))
    return both.select("o_orderkey", "mask", masks.area(F.col("a")).alias("area"), (F.col("a") == F.col("b")).alias("same"))
