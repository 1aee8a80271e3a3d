"""Scalar rules, lists and boxes, over values that the test tables are spelled into."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import clinical as C
from ..functions import scalars as S
from ..operators import evaluation as E
from .base import query, r6, table
from .relational import word


def sql_word(words: list[str], n: str) -> str:
    return "(" + "[" + ", ".join(f"'{w}'" for w in words) + f"])[1 + ({n} % {len(words)})]"


@query("SELECT o_orderkey, replace(replace(lower(o_orderpriority || '_L' || o_orderstatus || '/S1'), ' ', '_'), '/', '_') AS label FROM orders")
def fs03_condition_and_level(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.replace(S.snake(F.concat("o_orderpriority", F.lit("_L"), "o_orderstatus", F.lit("/S1"))), F.lit("/"), F.lit("_")).alias("label"))


@query("SELECT page_id, nullif(split_part(url, '/', 3), '') AS host, nullif(split_part(url, '/', 4), '') AS folder, nullif(split_part(url, '/', 12), '') AS none, array_to_string(string_split(url, '/')[1:3], '/') AS root FROM pages")
def fs05_path_parts(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", *(F.nullif(S.part(url, "/", n), F.lit("")).alias(k) for k, n in (("host", 2), ("folder", 3), ("none", 11))), S.first_parts(url, "/", 3).alias("root"))


@query("SELECT page_id, nullif(regexp_extract(html, '<title>[^<]*'), '') AS title, array_to_string(regexp_extract_all(html, '<h[0-9]'), ',') AS heads, starts_with(url, 'https') AS secure FROM pages")
def fs10_find_all(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_substr("html", F.lit("<title>[^<]*")).alias("title"), F.array_join(F.regexp_extract_all("html", F.lit("<h[0-9]"), 0), ",").alias("heads"), F.startswith("url", F.lit("https")).alias("secure"))


@query("SELECT p_partkey, regexp_matches(p_name || 's', '(?i)\\b(?:ring|widget|bolt)s?\\b') AND NOT regexp_matches(p_name, '^(cold|red) ') AS found FROM part")
def fs15_phrases(spark, d):
    return table(spark, d, "part").select("p_partkey", (C.phrase(F.concat("p_name", F.lit("s")), ["ring", "widget", "bolt"], "^(cold|red) ")).alias("found"))


@query("SELECT c_custkey, concat_ws(' ', CASE WHEN c_custkey % 2 = 0 THEN 'Indication: ' || c_name END, CASE WHEN c_acctbal > 0 THEN c_mktsegment END, CASE WHEN c_nationkey > 12 THEN 'late' END) AS report FROM customer")
def fs19_report_of_sections(spark, d):
    parts = [F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Indication: "), "c_name")), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), F.when(F.col("c_nationkey") > 12, "late")]
    return table(spark, d, "customer").select("c_custkey", F.concat_ws(" ", *parts).alias("report"))


@query("SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'cheap' WHEN p_type = 'LARGE' THEN 'big' END AS kind, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'CH' WHEN p_type = 'LARGE' THEN 'BG' ELSE 'OT' END AS code FROM part")
def fs25_vocabulary(spark, d):
    kind = S.lookup(F.lower(F.trim(F.concat(F.lit(" "), "p_type"))), {"economy": "cheap", "promo": "cheap", "large": "big"})
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"), F.coalesce(S.lookup(kind, {"cheap": "CH", "big": "BG"}), F.lit("OT")).alias("code"))


_REPORTS = ["REPORT ____ ", " report", "", "report: clear", " _ "]


@query(f"SELECT c_custkey, c_custkey % 7 = 0 OR {sql_word(_REPORTS, 'c_custkey')} <> 'report: clear' AS blank FROM customer")
def fs27_blank_reports(spark, d):
    text = F.when(F.col("c_custkey") % 7 != 0, word(_REPORTS, F.col("c_custkey")))
    return table(spark, d, "customer").select("c_custkey", C.blank_report(text).alias("blank"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '' WHEN s_suppkey % 3 = 0 THEN printf('%.3f', s_acctbal) ELSE printf('%.3f [%.3f, %.3f]', s_acctbal, s_acctbal - 1, s_acctbal + 1) END AS text FROM supplier")
def fs28_intervals(spark, d):
    m = F.col("s_acctbal")
    mean, low = F.when(F.col("s_suppkey") % 5 != 0, m), F.when(F.col("s_suppkey") % 3 != 0, m - 1)
    return table(spark, d, "supplier").select("s_suppkey", C.interval_text(mean, low, m + 1).alias("text"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN 'a/' || s_name || '.x.nii' END AS path, s_suppkey % 4 = 0 AS odd FROM supplier")
def fs29_output_paths(spark, d):
    path = F.concat(F.when(F.col("s_suppkey") % 4 == 0, "../").otherwise("a/"), "s_name", F.lit(".x.png"))
    return table(spark, d, "supplier").select("s_suppkey", F.when(~C.leaves_folder(path), C.output_path(path, ".nii")).alias("path"), C.leaves_folder(path).alias("odd"))


@query("SELECT event_id, 'S' || user_id AS subject, CASE WHEN event_id % 3 > 0 THEN 'E' || event_id END AS session, event_type AS view, CASE WHEN event_id % 2 = 0 THEN 'dx' ELSE 'cr' END AS acquisition FROM events")
def fs30_file_names(spark, d):
    n = F.col("event_id")
    name = F.concat(F.lit("sub-S"), "user_id", F.when(n % 3 > 0, F.concat(F.lit("_ses-E"), n)).otherwise(""), F.lit("_vp-"), "event_type", F.when(n % 2 == 0, "_dx.png").otherwise("_cr.png"))
    fields = {"subject": "sub-(S[0-9]+)", "session": "_ses-(E[0-9]+)", "view": "_vp-([a-z]+)", "acquisition": r"_([a-z]+)\.png$"}
    return table(spark, d, "events").select("event_id", *(S.extract(name, p).alias(k) for k, p in fields.items()))


_AGES = ["85 or more", "90+", "0", "20-Oct", "40-50", "old", " 7 "]


@query(f"SELECT c_custkey, CASE {sql_word(_AGES, 'c_custkey')} WHEN '85 or more' THEN 85 WHEN '90+' THEN 90 WHEN '20-Oct' THEN 10 WHEN '40-50' THEN 40 WHEN ' 7 ' THEN 7 END::DOUBLE AS age FROM customer")
def fm03_ages_in_words(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.age_words(word(_AGES, F.col("c_custkey"))).alias("age"))


@query("SELECT o_orderkey, year(o_orderdate) - (1930 + o_custkey % 60) AS age, coalesce(year(o_orderdate) - (1930 + o_custkey % 60) BETWEEN 18 AND 60, false) AS plausible FROM orders")
def fm04_age_at_study(spark, d):
    age = C.age_at(F.date_format("o_orderdate", "yyyyMMdd").cast("long"), 1930 + F.col("o_custkey") % 60)
    return table(spark, d, "orders").select("o_orderkey", age.alias("age"), S.age_plausible(age, 18, 60).alias("plausible"))


@query("""SELECT vec_id, CASE WHEN m = 0 THEN NULL WHEN x = m THEN 'sagittal' WHEN y = m THEN 'coronal' ELSE 'axial' END AS plane FROM (SELECT *, greatest(x, y, z) AS m FROM (
  SELECT vec_id, abs(v[2] * v[6] - v[3] * v[5]) AS x, abs(v[3] * v[4] - v[1] * v[6]) AS y, abs(v[1] * v[5] - v[2] * v[4]) AS z FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)))""")
def fm09_planes(spark, d):
    return table(spark, d, "embeddings").select("vec_id", C.plane(F.slice("embedding", 1, 6)).alias("plane"))


@query("SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_cosine_similarity(v[1:32], v[33:64]), 6) AS cosine FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def fm10_norms_and_cosines(spark, d):
    v = F.col("embedding")
    a, b = F.slice(v, 1, 32), F.slice(v, 33, 32)
    return table(spark, d, "embeddings").select("vec_id", r6(F.sqrt(E.dot(v, v))).alias("norm"), r6(E.dot(E.unit(a), E.unit(b))).alias("cosine"))


_STEPS = ["improving", "stable", "worsening", "new"]
_STATES = ["Present", "Absent", "Not seen"]


@query(f"""SELECT doc_id, quality AS seen, 1 - quality AS unseen, coalesce(toxic >= 1, false) AS at_least_one, CASE {sql_word(_STATES, 'doc_id')} WHEN 'Present' THEN 1 WHEN 'Absent' THEN 0 END AS state,
  CASE {sql_word(_STEPS, 'doc_id')} WHEN 'improving' THEN -1 WHEN 'stable' THEN 0 WHEN 'worsening' THEN 1 END AS step FROM documents LEFT JOIN labels USING (doc_id)""")
def fm12_label_rules(spark, d):
    df = table(spark, d, "documents", "doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    seen, n = C.positive(F.col("quality")), F.col("doc_id")
    return df.select("doc_id", seen.alias("seen"), (1 - seen).alias("unseen"), F.coalesce(F.col("toxic") >= 1, F.lit(False)).alias("at_least_one"), C.present(word(_STATES, n)).alias("state"), C.progression(word(_STEPS, n)).alias("step"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL WHEN c_acctbal > 2000 THEN 'M' ELSE 'F' END AS sex FROM customer")
def fm18_sex_of_flags(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.sex_of_flag(F.when(F.col("c_nationkey") != 3, F.col("c_acctbal") > 2000)).alias("sex"))


_SIDES, _PROJECTIONS = ["Frontal", "LATERAL", "Frontal"], ["AP", "PA", "LL", "", "ap"]


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s = 'LATERAL' THEN 'LATERAL' WHEN p = '' THEN 'Frontal' WHEN upper(p) IN ('AP', 'PA') THEN p END AS view
  FROM (SELECT *, {sql_word(_SIDES, 'l_orderkey')} AS s, {sql_word(_PROJECTIONS, 'l_partkey')} AS p FROM lineitem)""")
def fm19_views_of_two_columns(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.view_of_parts(word(_SIDES, F.col("l_orderkey")), word(_PROJECTIONS, F.col("l_partkey"))).alias("view"))


@query("SELECT l_orderkey, CASE WHEN r = 0 THEN 'no_radiology' WHEN r < n THEN 'mixed' ELSE 'all_radiology' END AS verdict FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)")
def fm22_verdicts(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return g.select("l_orderkey", C.verdict(F.col("r"), F.col("n")).alias("verdict"))


@query("SELECT p_partkey, round(a, 6)::DOUBLE AS y0, round(b, 6)::DOUBLE AS y1 FROM (SELECT p_partkey, (p_size - 10) / 100.0::DOUBLE AS a, (p_size * 2 - 20) / 100.0::DOUBLE AS b, p_size % 3 > 0 AND p_size > 10 AS ok FROM part) WHERE ok")
def fa03_corner_boxes(spark, d):
    size = F.col("p_size").cast("double")
    # Every third box is inverted on the other axis and goes.
    x1 = F.when(F.col("p_size") % 3 > 0, 30.0).otherwise(5.0)
    box = B.from_corners(F.lit(10.0), size - 10, x1, size * 2 - 20, F.lit(200.0), F.lit(100.0))
    return table(spark, d, "part").select("p_partkey", box.alias("b")).where("b IS NOT NULL").select("p_partkey", r6(F.col("b")[0]).alias("y0"), r6(F.col("b")[1]).alias("y1"))


@query("SELECT p_partkey, round(greatest(0, (p_size % 10) / 10.0 ), 6)::DOUBLE AS z0, round((p_size % 10 + 1) / 10.0, 6)::DOUBLE AS z1, round(greatest(0, p_size / 50.0 - 0.1), 6)::DOUBLE AS y0, round(least(1, p_size / 50.0 + 0.1), 6)::DOUBLE AS y1 FROM part")
def fa04_point_boxes(spark, d):
    size = F.col("p_size").cast("double")
    box = B.clip(C.point_box(size % 10, F.lit(10.0), F.lit(100.0), size, F.lit(200.0), F.lit(50.0), 0.1))
    return table(spark, d, "part").select("p_partkey", box.alias("b")).select("p_partkey", *(r6(F.col("b")[i]).alias(k) for i, k in enumerate(("z0", "z1", "y0", "y1"))))


@query("SELECT p_partkey, round(1 - (p_size + 10) / 100.0, 6)::DOUBLE AS flipped, 0.25::DOUBLE AS swapped, round(p_size / 100.0, 6)::DOUBLE AS kept FROM part")
def fa05_flip_and_swap(spark, d):
    size = F.col("p_size").cast("double")
    box = F.array(size / 100, (size + 10) / 100, F.lit(0.25), F.lit(0.5))
    return table(spark, d, "part").select("p_partkey", r6(B.flip(box, 0)[0]).alias("flipped"), B.swap_axes(box)[0].alias("swapped"), r6(B.swap_axes(box)[2]).alias("kept"))


@query("SELECT l_orderkey, to_json(list(l_linenumber ORDER BY l_linenumber))::VARCHAR AS numbers FROM lineitem GROUP BY 1")
def fa08_json_lists(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list("l_linenumber"))).alias("numbers"))


@query("SELECT l_orderkey, coalesce(string_agg(DISTINCT 'f' || l_linenumber, ',' ORDER BY 'f' || l_linenumber) FILTER (l_returnflag = 'R'), '') AS findings FROM lineitem GROUP BY 1")
def fa09_findings_of_tokens(spark, d):
    token = F.concat(F.lit("anatomy|"), F.when(F.col("l_returnflag") == "R", "yes").otherwise("no"), F.lit("|f"), F.col("l_linenumber").cast("string"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(C.findings(F.collect_list(token)), ",").alias("findings"))


@query("SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '') AS answers FROM conversations GROUP BY 1")
def fa10_answer_texts(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    answers = F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(answers, " ").alias("answers"))


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN p_brand ELSE p_name END AS answer, CASE WHEN p_size > 20 THEN p_brand || ', ' || p_type END AS listed FROM part")
def fa11_list_answers(spark, d):
    values = F.when(F.col("p_size") > 20, F.array("p_brand", "p_type"))
    return table(spark, d, "part").select("p_partkey", C.list_or_scalar(values, F.col("p_name")).alias("answer"), F.array_join(values, ", ").alias("listed"))


@query("SELECT p_partkey, p_name || '|' || p_type AS parts, 2 AS n, p_type || ',' || p_type AS repeated FROM part")
def fa12_split_lists(spark, d):
    parts = C.split_list(F.concat(F.lit(" ;"), "p_name", F.lit(" ; "), "p_type", F.lit(";  ")))
    return table(spark, d, "part").select("p_partkey", F.array_join(parts, "|").alias("parts"), F.size(parts).alias("n"), F.array_join(F.array_repeat("p_type", F.size(parts)), ",").alias("repeated"))


@query("SELECT p_partkey, " + ", ".join(f"CASE WHEN p_size % 5 > 0 THEN (p_type = '{t}' OR p_brand = '{t}')::INT END AS is_{t.lower()}" for t in ("LARGE", "PROMO", "SMALL")) + " FROM part WHERE p_size % 7 > 0 OR p_size % 5 = 0")
def rs06_one_hot_of_list_text(spark, d):
    text = F.when(F.col("p_size") % 5 == 0, "[]").when(F.col("p_size") % 7 == 0, "[oops").otherwise(F.concat(F.lit("['"), "p_type", F.lit("', '"), "p_brand", F.lit("']")))
    rows = table(spark, d, "part").withColumn("labels", C.list_text(text)).where("labels IS NOT NULL")
    one: Column = F.when(F.size("labels") > 0, F.col("labels"))
    return rows.select("p_partkey", *(F.array_contains(one, t).cast("int").alias(f"is_{t.lower()}") for t in ("LARGE", "PROMO", "SMALL")))
