"""Nested and free texts turned into rows, and masks as runs of pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import masks as M
from ..operators import evaluation as E
from ..sources import nested as N
from .base import query, r6, table


@query("SELECT o_orderkey, 'l' || l_linenumber AS key, min(l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def sc13_object_of_records(spark, d):
    entry = F.struct(F.concat(F.lit("l"), "l_linenumber").alias("k"), F.struct(F.col("q")).alias("v"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    text = lines.groupBy("l_orderkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json"))
    return N.object_rows(text.withColumnRenamed("l_orderkey", "o_orderkey").join(table(spark, d, "orders", "o_orderkey"), "o_orderkey"), "json", "struct<q:double>")


@query("SELECT l_orderkey, max((l_returnflag = 'R')::INT) AS returned, count(*) FILTER (l_quantity > 20)::BIGINT AS n_boxes FROM lineitem GROUP BY 1")
def sc14_annotations_by_image(spark, d):
    item = F.struct(F.col("l_returnflag").alias("labelId"), F.when(F.col("l_quantity") > 20, F.struct(F.col("l_quantity").alias("x"))).alias("data"))
    text = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(item)).alias("json"))
    rows = N.annotation_rows(text, "json", "struct<labelId:string,data:struct<x:double>>")
    return rows.groupBy("l_orderkey").agg(F.max((F.col("labelId") == "R").cast("int")).alias("returned"), F.count("data").alias("n_boxes"))


@query("SELECT l_orderkey, l_returnflag AS sym, l_linenumber AS box FROM lineitem")
def sc16_parallel_lists(spark, d):
    pair = F.collect_list(F.struct("l_returnflag", "l_linenumber")).alias("p")
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(pair).select("l_orderkey", F.transform("p", lambda x: x["l_returnflag"]).alias("sym"), F.transform("p", lambda x: x["l_linenumber"]).alias("box"))
    return N.parallel_rows(lists, ["sym", "box"])


@query("SELECT c_custkey, c_name AS image, c_mktsegment AS report FROM customer")
def sc18_xml_reports(spark, d):
    xml = F.concat(F.lit("<r><parentImage id=\""), "c_name", F.lit("\"/><text>"), "c_mktsegment", F.lit("</text></r>"))
    parsed = F.from_xml(xml, "parentImage struct<_id string>, text string")
    return table(spark, d, "customer").select("c_custkey", parsed.alias("x")).select("c_custkey", F.col("x.parentImage._id").alias("image"), F.col("x.text").alias("report"))


@query("SELECT c_custkey, 1 + (c_custkey % 2 = 0)::INT AS n, c_mktsegment AS second FROM customer")
def sc06_ragged_lines(spark, d):
    text = F.concat(F.lit("a\t"), "c_mktsegment", F.lit("\tx\nshort\n"), F.when(F.col("c_custkey") % 2 == 0, "1\t2\t3\t4").otherwise(""))
    lines = N.fields_of_lines(text, 3)
    return table(spark, d, "customer").select("c_custkey", F.size(lines).alias("n"), F.get(F.get(lines, F.lit(0)), F.lit(1)).alias("second"))


@query("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN user_id::VARCHAR END AS patient, CASE WHEN event_id % 4 > 0 THEN event_type END AS view FROM events")
def sc22_columns_of_file_names(spark, d):
    name = F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("dir/p"), "user_id", F.lit("_"), "event_type", F.lit(".png"))).otherwise("dir/readme.txt")
    return table(spark, d, "events").select("event_id", N.name_fields(name, r"p(\d+)_([a-z]+)\.png$", ["patient", "view"]).alias("f")).select("event_id", "f.*")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS sex, CASE WHEN c_custkey % 3 < 2 THEN (20 + c_nationkey)::DOUBLE END AS age, CASE WHEN c_nationkey > 3 THEN 'scar in ' || c_mktsegment END AS finding FROM customer")
def sc29_clinical_notes(spark, d):
    n = F.col("c_custkey") % 3
    first = F.when(n < 2, F.concat(F.when(n == 0, "Male ").otherwise("female, "), (F.col("c_nationkey") + 20).cast("string"), F.lit("yrs"))).otherwise("not known")
    note = F.concat(first, F.lit("\n"), F.when(F.col("c_nationkey") > 3, F.concat(F.lit("scar  in\n"), "c_mktsegment")).otherwise(""))
    return table(spark, d, "customer").select("c_custkey", N.clinical_note(note).alias("c")).select("c_custkey", "c.*")


@query("""SELECT l_orderkey, count(DISTINCT p)::BIGINT AS area, round(min(p % 10) / 10.0, 6)::DOUBLE AS y0, round((max(p % 10) + 1) / 10.0, 6)::DOUBLE AS y1, round(min(p // 10) / 10.0, 6)::DOUBLE AS x0, round((max(p // 10) + 1) / 10.0, 6)::DOUBLE AS x1
  FROM (SELECT l_orderkey, unnest(range(l_partkey % 90, l_partkey % 90 + l_linenumber)) AS p FROM lineitem) GROUP BY 1""")
def ud03_masks_of_runs(spark, d):
    run = F.concat_ws(" ", F.col("l_partkey") % 90 + 1, "l_linenumber")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(M.union(M.runs(F.array_join(F.collect_list(run), " "))).alias("m"))
    found = lines.select("l_orderkey", M.area(F.col("m")).alias("area"), M.bounds(F.col("m"), 10, 10).alias("box"))
    return found.select("l_orderkey", "area", *(r6(F.get("box", F.lit(i))).alias(k) for i, k in enumerate(("y0", "y1", "x0", "x1"))))


@query("""WITH a AS (SELECT DISTINCT l_orderkey, unnest(range(l_partkey % 60, l_partkey % 60 + 30)) AS p FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey, unnest(range(l_suppkey % 60, l_suppkey % 60 + 30)) AS p FROM lineitem WHERE l_returnflag = 'R'),
c AS (SELECT l_orderkey, count(a.p) FILTER (b.p IS NOT NULL) AS tp, count(b.p) FILTER (a.p IS NULL) AS fp, count(a.p) FILTER (b.p IS NULL) AS fn FROM a FULL JOIN b USING (l_orderkey, p) GROUP BY 1)
SELECT l_orderkey, tp::BIGINT AS tp, (100 - tp - fp - fn)::BIGINT AS tn, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS dice, round(tp / (tp + fp + fn)::DOUBLE, 6) AS iou FROM c""")
def ev15_overlap_of_masks(spark, d):
    run = lambda c: F.array_join(F.collect_list(F.concat_ws(" ", F.col(c) % 60 + 1, F.lit(30))), " ")
    pairs = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(M.union(M.runs(run("l_partkey"))).alias("a"), M.union(M.runs(run("l_suppkey"))).alias("b"))
    found = E.overlap_panel(pairs.withColumns(M.counts(F.col("a"), F.col("b"), F.lit(100))))
    return found.select("l_orderkey", "tp", "tn", r6("dice").alias("dice"), r6("iou").alias("iou"))
