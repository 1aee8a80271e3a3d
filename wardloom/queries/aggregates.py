"""Votes, roll-ups, statistics, scalar functions and boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import scalars as S
from ..plans import harmonizer as H
from .base import query, r6, table
from .relational import _CONTRACT, _harmonized


@query("SELECT l_orderkey, (sum((l_returnflag = 'R')::INT) >= 2)::INT AS returned, (sum((l_linestatus = 'O')::INT) >= 2)::INT AS open FROM lineitem GROUP BY 1")
def ag01_majority_vote(spark, d):
    two = lambda c: (F.count_if(c) >= 2).cast("int")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(two(F.col("l_returnflag") == "R").alias("returned"), two(F.col("l_linestatus") == "O").alias("open"))


@query("SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey) AS parts, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def ag02_join_lines(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda x: x["l_partkey"].cast("string")), " ").alias("parts"), F.count("*").alias("n"))


@query("SELECT l_orderkey, max((l_returnflag = 'R')::INT) AS returned, string_agg(CASE WHEN l_quantity > 25 THEN l_partkey::VARCHAR END, '|' ORDER BY l_linenumber, l_partkey) AS boxes, arg_min(l_suppkey, (l_linenumber * 10000000 + l_partkey) * 1000000 + l_suppkey) AS first_supplier FROM lineitem GROUP BY 1")
def ag05_one_row_per_image(spark, d):
    kept = F.array_sort(F.collect_list(F.when(F.col("l_quantity") > 25, F.struct("l_linenumber", "l_partkey"))))
    text = F.array_join(F.transform(kept, lambda x: x["l_partkey"].cast("string")), "|")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"), F.nullif(text, F.lit("")).alias("boxes"), F.min_by("l_suppkey", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("first_supplier"))


@query("SELECT l_orderkey, l_linestatus, max(l_linenumber::VARCHAR) AS present FROM lineitem GROUP BY ALL")
def ag06_max_of_text(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.max(F.col("l_linenumber").cast("string")).alias("present"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def ag07_sorted_distinct_list(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"))


@query("SELECT l_partkey, count(DISTINCT l_suppkey)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def ag08_shared_ids(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n")).where("n > 1")


@query("SELECT p_name, count(DISTINCT p_brand)::BIGINT AS brands, count(DISTINCT CASE WHEN p_size > 25 THEN p_type END)::BIGINT AS types FROM part GROUP BY 1")
def ag09_values_per_group(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("brands"), F.count_distinct(F.when(F.col("p_size") > 25, F.col("p_type"))).alias("types"))


@query("""SELECT o_custkey, n, n_f, modal, share, CASE WHEN share >= 0.5 THEN 'mostly' WHEN share > 0 THEN 'some' ELSE 'none' END AS verdict FROM (
  SELECT o_custkey, count(*)::BIGINT AS n, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS n_f, round(count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE, 6) AS share FROM orders GROUP BY 1)
  JOIN (SELECT o_custkey, o_orderpriority AS modal FROM (SELECT o_custkey, o_orderpriority, count(*) AS k FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY k DESC, o_orderpriority) = 1) USING (o_custkey)""")
def ag11_rollup_with_mode(spark, d):
    f = F.count_if(F.col("o_orderstatus") == "F")
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), f.alias("n_f"), F.mode("o_orderpriority", True).alias("modal"), r6(f / F.count("*")).alias("share"))
    return rows.withColumn("verdict", F.when(F.col("share") >= 0.5, "mostly").when(F.col("share") > 0, "some").otherwise("none"))


@query(f"""SELECT count(DISTINCT image_path)::BIGINT AS n_images, count(DISTINCT (patient_id, study_id))::BIGINT AS n_studies, count(DISTINCT patient_id)::BIGINT AS n_patients,
  count(*) FILTER (sex = 'M')::BIGINT AS "n_M", count(*) FILTER (sex = 'F')::BIGINT AS "n_F", min(age_years) AS age_min, max(age_years) AS age_max,
  count(*) FILTER (is_open = 1)::BIGINT AS pos_is_open, count(*) FILTER (is_open IS NULL)::BIGINT AS null_is_open, count(*) FILTER (is_returned = 1)::BIGINT AS pos_is_returned, count(*) FILTER (is_returned IS NULL)::BIGINT AS null_is_returned FROM ({_CONTRACT})""")
def ag23_table_statistics(spark, d):
    return H.statistics(_harmonized(spark, d), ["is_open", "is_returned"])


@query(f"""SELECT *, CASE WHEN n_rows = 0 OR n_not_finite > 0 THEN 'ERROR' WHEN n_no_label = n_rows OR n_blank_image > 0 THEN 'WARN' ELSE 'OK' END AS status FROM (
  SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (trim(image_path) = '')::BIGINT AS n_blank_image, 0::INT AS n_blank_mask, 0::INT AS n_blank_report, count(*) FILTER (is_open IS NULL AND is_returned IS NULL)::BIGINT AS n_no_label,
  0::BIGINT AS n_invalid_boxes, count(*) FILTER (NOT isfinite(l_quantity))::BIGINT AS n_not_finite, count(*) FILTER (is_open = 1)::BIGINT AS pos_is_open, count(*) FILTER (is_returned = 1)::BIGINT AS pos_is_returned,
  count(*) FILTER (is_open IS NULL)::BIGINT AS null_is_open, count(*) FILTER (is_returned IS NULL)::BIGINT AS null_is_returned FROM ({_CONTRACT}))""")
def ag24_integrity(spark, d):
    return H.integrity(_harmonized(spark, d), ["is_open", "is_returned"], ["l_quantity"])


@query("SELECT o_custkey, count(DISTINCT o_orderstatus)::BIGINT AS n_splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def ag25_patients_in_two_splits(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("n_splits")).where("n_splits > 1")


@query("SELECT lang, count(*)::BIGINT AS n, round(100 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM documents GROUP BY lang")
def ag27_value_shares(spark, d):
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    # The window is over one row for each value, not over the documents.
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("lang", "n", r6(100 * F.col("n") / total).alias("percent"))


@query("SELECT toxic, count(*)::BIGINT AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY toxic")
def ag28_counts_with_null(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("toxic").agg(F.count("*").alias("n"))


@query("SELECT p_type, p_brand, count(*)::BIGINT AS n FROM part GROUP BY ALL ORDER BY n DESC, p_type, p_brand LIMIT 10")
def ag29_top_pairs(spark, d):
    return table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type", "p_brand").limit(10)


@query("SELECT coalesce(toxic::VARCHAR, '(none)') AS toxic, " + ", ".join(f"count(*) FILTER (lang = '{x}')::BIGINT AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def ag30_crosstab(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return df.groupBy(F.coalesce(F.col("toxic").cast("string"), F.lit("(none)")).alias("toxic")).pivot("lang", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""SELECT k AS class, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM (
  SELECT k, count(*) FILTER (y = k AND p = k) AS tp, count(*) FILTER (y <> k AND p = k) AS fp, count(*) FILTER (y = k AND p <> k) AS fn
  FROM (SELECT label AS y, (label + (vec_id % 3 = 0)::INT) % 10 AS p FROM embeddings), (SELECT unnest(range(10)) AS k) GROUP BY k)""")
def ag31_class_panel(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("y"), ((F.col("label") + (F.col("vec_id") % 3 == 0).cast("int")) % 10).alias("p"))
    # Each row counts for its own class and for the predicted one: two rows at most, not one for each class.
    sides = F.array(F.struct(F.col("y").cast("long").alias("class"), (F.col("y") == F.col("p")).cast("int").alias("tp"), F.lit(0).alias("fp"), (F.col("y") != F.col("p")).cast("int").alias("fn")), F.struct(F.col("p").cast("long").alias("class"), F.lit(0).alias("tp"), (F.col("y") != F.col("p")).cast("int").alias("fp"), F.lit(0).alias("fn")))
    c = e.select(F.inline(sides)).groupBy("class").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
    share = lambda a, b: r6(F.when(b > 0, a / b))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("class", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query("SELECT p_partkey, replace(lower(p_name), ' ', '_') AS snake, regexp_replace(trim(lower(p_name || '  ' || p_brand)), '\\s+', '_', 'g') AS box_label, split_part(p_name, ' ', 2) AS second, nullif(regexp_extract(p_brand, '#(\\d+)', 1), '') AS number, regexp_replace(p_brand, '^Brand', '') AS stripped, ltrim(p_name, 'rb') AS no_prefix FROM part")
def fs01_text_functions(spark, d):
    name, brand = F.col("p_name"), F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", S.snake(name).alias("snake"), S.box_label(F.concat_ws("  ", name, brand)).alias("box_label"), S.part(name, " ", 1).alias("second"), S.extract(brand, r"#(\d+)").alias("number"), F.regexp_replace(brand, "^Brand", "").alias("stripped"), F.ltrim(name, F.lit("rb")).alias("no_prefix"))


@query("SELECT page_id, regexp_replace(url, '^.*/', '') AS base, regexp_replace(url, '(?i)\\.(nii\\.gz|nii|png|jpg|jpeg|dcm|npy|npz)$', '') AS image, replace(url, '/', '__') AS flat, len(regexp_extract_all(html, '<p>'))::INT AS paragraphs FROM pages")
def fs16_paths(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", S.base_name(url).alias("base"), S.image_id(url).alias("image"), F.replace(url, F.lit("/"), F.lit("__")).alias("flat"), F.regexp_count("html", F.lit("<p>")).alias("paragraphs"))


_REPORT = "'EXAM: x' || chr(10) || CASE WHEN doc_id % 3 < 2 THEN 'FINDINGS: ' || coalesce(lang, '') || ' clear  lungs.' || chr(10) ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'Impression: no ' || coalesce(source, '') ELSE 'plain' END"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN coalesce(lang, '') || ' clear lungs.' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' plain' END WHEN doc_id % 2 = 0 THEN 'no ' || coalesce(source, '') ELSE 'EXAM: x plain' END AS findings,
  CASE WHEN doc_id % 2 = 0 THEN 'no ' || coalesce(source, '') WHEN doc_id % 3 < 2 THEN coalesce(lang, '') || ' clear lungs. plain' ELSE 'EXAM: x plain' END AS impression, trim(regexp_replace({_REPORT}, '\\s+', ' ', 'g')) AS full FROM documents""")
def fs20_report_sections(spark, d):
    note = F.concat(F.lit("EXAM: x\n"), F.when(F.col("doc_id") % 3 < 2, F.concat(F.lit("FINDINGS: "), F.coalesce("lang", F.lit("")), F.lit(" clear  lungs.\n"))).otherwise(""), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Impression: no "), F.coalesce("source", F.lit("")))).otherwise("plain"))
    return table(spark, d, "documents").select("doc_id", note.alias("t")).select("doc_id", *(S.report_section(F.col("t"), s).alias(s) for s in ("findings", "impression", "full")))


@query(f"""WITH t AS (SELECT u.conv_id, u.turn, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(a.text, '')), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ('a', 'an', 'the')) AS p,
  list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(u.text, '')), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ('a', 'an', 'the')) AS r FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(r, lambda y: y = x))))), 0) AS c FROM t)
SELECT conv_id, turn, CASE WHEN len(p) + len(r) = 0 THEN 1.0 ELSE round(2.0 * c / (len(p) + len(r))::DOUBLE, 6) END::DOUBLE AS f1, CASE WHEN len(r) = 0 THEN 0.0 ELSE round(c / len(r)::DOUBLE, 6) END::DOUBLE AS recall FROM o""")
def fm20_token_overlap(spark, d):
    c = table(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference")).join(a, ["conv_id", "turn"])
    answer, reference = F.col("answer"), F.col("reference")
    return pairs.select("conv_id", "turn", r6(S.token_f1(answer, reference)).alias("f1"), r6(S.token_recall(answer, reference)).alias("recall"))


@query("""SELECT o_orderkey, regexp_extract(a, '\\b(yes|no)\\b', 1) AS said, r IN ('yes', 'no') AS closed FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'the answer is yes' WHEN 'O' THEN 'no no' ELSE 'maybe yes' END AS a, CASE WHEN o_totalprice > 100000 THEN 'yes' ELSE 'left lung' END AS r FROM orders)""")
def fs23_closed_questions(spark, d):
    answer = F.when(F.col("o_orderstatus") == "F", "The answer is: YES").when(F.col("o_orderstatus") == "O", "No, no.").otherwise("maybe (yes)")
    reference = F.when(F.col("o_totalprice") > 100000, " Yes ").otherwise("left lung")
    return table(spark, d, "orders").select("o_orderkey", S.yes_no(answer).alias("said"), S.is_closed(reference).alias("closed"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 0 AND c_acctbal / 12 <= 130 THEN c_acctbal / 12 END AS months,
  CASE unit WHEN 'D' THEN v * (1.0::DOUBLE / 365.25) WHEN 'W' THEN v * (7.0::DOUBLE / 365.25) WHEN 'M' THEN v * (1.0::DOUBLE / 12.0) WHEN 'Y' THEN CASE WHEN v <= 130 THEN v END END AS coded
  FROM (SELECT *, (c_custkey % 150)::DOUBLE AS v, (['D', 'W', 'M', 'Y', 'X'])[1 + (c_custkey % 5)] AS unit FROM customer)""")
def fm01_ages(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ["D", "w", "M", "y", "X"])), (F.col("c_custkey") % 5).cast("int") + 1)
    code = F.concat(F.lpad((F.col("c_custkey") % 150).cast("string"), 3, "0"), unit)
    return table(spark, d, "customer").select("c_custkey", S.age_years(F.col("c_acctbal"), "months").alias("months"), S.age_years(code, "dicom_as").alias("coded"))


@query("""SELECT doc_id, a, coalesce(b, CASE WHEN a IS NOT NULL THEN 0.0 END)::DOUBLE AS b_negative, b AS b_nan, CASE WHEN a = -1 THEN 0.0 ELSE a END AS a_zeros, CASE WHEN a = -1 THEN NULL ELSE a END AS a_ignore
  FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 1.0::DOUBLE WHEN quality = 0 THEN -1.0 END AS a, CASE WHEN toxic = 1 THEN 1.0::DOUBLE END AS b FROM documents LEFT JOIN labels USING (doc_id))""")
def fm15_label_policies(spark, d):
    df = table(spark, d, "documents", "doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, -1.0).alias("a"), F.when(F.col("toxic") == 1, 1.0).alias("b"))
    return df.select("doc_id", "a", S.codes(["a", "b"])["b"].alias("b_negative"), S.codes(["a", "b"], "nan")["b"].alias("b_nan"), S.uncertain(F.col("a"), "zeros").alias("a_zeros"), S.uncertain(F.col("a"), "ignore").alias("a_ignore"))


_BOX = "[(l_quantity - 5) / 40, (l_quantity + l_linenumber) / 40, l_discount * 10 - 0.1, l_discount * 10 + l_tax * 5 - 0.2]"


@query(f"""SELECT l_orderkey, count(*)::BIGINT AS n_boxes, count(*) FILTER (ok)::BIGINT AS kept, round(sum(CASE WHEN ok THEN (b[2] - b[1]) * (b[4] - b[3]) ELSE 0 END), 6)::DOUBLE AS area, string_agg(CASE WHEN ok THEN lower(p) END, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, b) AS labels
  FROM (SELECT *, b[1] < b[2] AND b[3] < b[4] AS ok FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag || l_linestatus AS p, list_transform({_BOX}, lambda x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, x))) AS b FROM lineitem)) GROUP BY 1""")
def fa01_clip_boxes_with_labels(spark, d):
    q, n, disc, tax = (F.col(c) for c in ("l_quantity", "l_linenumber", "l_discount", "l_tax"))
    box = F.array((q - 5) / 40, (q + n) / 40, disc * 10 - 0.1, disc * 10 + tax * 5 - 0.2)
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.transform(box, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).alias("order"), box.alias("box"), F.concat("l_returnflag", "l_linestatus").alias("label"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = rows.withColumn("kept", B.clip_with(F.transform("items", lambda x: x["box"]), F.transform("items", lambda x: x["label"])))
    area = F.aggregate("kept", F.lit(0.0), lambda s, z: s + (z["box"][1] - z["box"][0]) * (z["box"][3] - z["box"][2]))
    labels = F.array_join(F.transform("kept", lambda z: S.box_label(z["p0"])), ",")
    return rows.select("l_orderkey", F.size("items").cast("long").alias("n_boxes"), F.size("kept").cast("long").alias("kept"), r6(area).alias("area"), F.nullif(labels, F.lit("")).alias("labels"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(b[1], 6) AS b0, round(b[4], 6) AS b3, list_min(b) >= 0 AND list_max(b) <= 1 AND b[1] < b[2] AND b[3] < b[4] AS valid FROM (SELECT *, {_BOX} AS b FROM lineitem)")
def qg02_box_validity(spark, d):
    q, n, disc, tax = (F.col(c) for c in ("l_quantity", "l_linenumber", "l_discount", "l_tax"))
    box = F.array((q - 5) / 40, (q + n) / 40, disc * 10 - 0.1, disc * 10 + tax * 5 - 0.2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(box[0]).alias("b0"), r6(box[3]).alias("b3"), B.valid(box).alias("valid"))


@query("SELECT p_partkey, round(20 / 100.0, 6)::DOUBLE AS y0, round((20 + p_size) / 100.0, 6)::DOUBLE AS y1, round(10 / 200.0, 6)::DOUBLE AS x0, round((10 + 2 * p_size) / 200.0, 6)::DOUBLE AS x1, round(1 - (10 + 2 * p_size) / 200.0, 6)::DOUBLE AS mirrored FROM part")
def fa02_pixel_boxes(spark, d):
    size = F.col("p_size").cast("double")
    box = B.from_xywh(F.lit(10.0), F.lit(20.0), 2 * size, size, F.lit(200.0), F.lit(100.0))
    return table(spark, d, "part").select("p_partkey", *(r6(box[i]).alias(n) for i, n in enumerate(("y0", "y1", "x0", "x1"))), r6(B.flip(box, 1)[2]).alias("mirrored"))


@query("SELECT p_partkey, len(b)::INT AS n, b[1][1]::DOUBLE AS x FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN [[p_size, 2]] WHEN 1 THEN [[p_size, 3]] WHEN 2 THEN []::INT[][] END AS b FROM part)")
def fa06_parse_box_text(spark, d):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("[["), size, F.lit(", 2]]"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("["), size, F.lit(", 3]"))).when(F.col("p_partkey") % 4 == 2, "[]").otherwise("oops")
    b = B.parse(text)
    return table(spark, d, "part").select("p_partkey", F.size(b).alias("n"), F.get(F.get(b, F.lit(0)), F.lit(0)).alias("x")).withColumn("n", F.when(F.col("p_partkey") % 4 < 3, F.col("n")))


@query("""SELECT image_path, cls FROM (SELECT image_path, round(coalesce(is_open, -9) + 10 * coalesce(is_returned, -9), 6)::DOUBLE AS cls FROM (%s))""" % _CONTRACT)
def sb01_samples(spark, d):
    s = H.samples(_harmonized(spark, d), ["is_returned", "is_open"], ["l_quantity"])
    v = lambda i: F.coalesce(s["sample"]["cls"][i], F.lit(-9.0))
    return s.select(F.col("sample.img").alias("image_path"), r6(v(0) + 10 * v(1)).alias("cls"))


@query("SELECT c AS label FROM (SELECT 'quality' AS c, count(quality) > 0 AND bool_and(quality IN (0, 1) OR quality IS NULL) AS ok FROM labels UNION ALL SELECT 'toxic', count(toxic) > 0 AND bool_and(toxic IN (0, 1) OR toxic IS NULL) FROM labels UNION ALL SELECT 'doc_id', bool_and(doc_id IN (0, 1)) FROM labels) WHERE ok")
def sb06_binary_columns(spark, d):
    df = table(spark, d, "labels")
    row = df.agg(*(((F.count(c) > 0) & F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(False))).alias(c) for c in df.columns))
    return row.unpivot([], df.columns, "label", "ok").where("ok").select("label")


@query("SELECT DISTINCT lower(l_returnflag) AS label FROM lineitem WHERE l_quantity > 10")
def sb10_box_vocabulary(spark, d):
    lists = table(spark, d, "lineitem").where("l_quantity > 10").groupBy("l_orderkey").agg(F.collect_set(S.box_label(F.col("l_returnflag"))).alias("labels"))
    return lists.select(F.explode("labels").alias("label")).distinct()
