"""Contract tables, filters, joins, picks and set operations. Customers stand for patients, orders for studies and lines for images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import guards as G
from ..operators import relational as R
from ..plans import harmonizer as H
from .base import query, table

LINE = ["l_orderkey", "l_linenumber"]
WHOLE_LINE = [*LINE, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
# A sex and a view spelled in several ways, from a key.
SEX_WORDS = ["Male", " f", "Unknown", "x", "FEMALE"]
VIEW_WORDS = ["pa", "Antero_Posterior", " LL ", "UNK", "ap_horizontal"]
_SEX_SQL = "(['Male', ' f', 'Unknown', 'x', 'FEMALE'])[1 + (c_nationkey % 5)]"
_VIEW_SQL = "(['pa', 'Antero_Posterior', ' LL ', 'UNK', 'ap_horizontal'])[1 + (l_linenumber % 5)]"
_SEX_CASE = "CASE lower(trim({0})) WHEN 'm' THEN 'M' WHEN 'male' THEN 'M' WHEN 'f' THEN 'F' WHEN 'female' THEN 'F' END"
_VIEW_CASE = (
    "CASE WHEN lower(trim({0})) IN ('', 'unknown', 'unk', 'n/a', 'exclude', 'none') THEN NULL WHEN lower(trim({0})) IN ('pa', 'postero_anterior') THEN 'PA' "
    "WHEN lower(trim({0})) IN ('ap', 'antero_posterior') THEN 'AP' WHEN lower(trim({0})) IN ('lateral', 'lat', 'l', 'll', 'rl') THEN 'LATERAL' ELSE upper(trim({0})) END"
)


def word(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (n % len(words)).cast("int") + 1)


def lines(spark: SparkSession, d: str) -> DataFrame:
    """One row for each line: the first in an explicit order of all columns, for (order, number) repeats."""
    return R.first_row(table(spark, d, "lineitem"), LINE, [*WHOLE_LINE])


_LINES = f"(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(WHOLE_LINE)}) = 1)"


def spec(spark: SparkSession, d: str) -> H.Spec:
    people = table(spark, d, "customer").select("c_custkey", "c_acctbal", word(SEX_WORDS, F.col("c_nationkey")).alias("raw_sex"))
    return H.Spec(
        name="lines", patient=F.col("o_custkey"), study=F.col("l_orderkey"), image=F.concat_ws("/", "o_custkey", "l_orderkey", F.concat(F.col("l_linenumber").cast("string"), F.lit(".png"))),
        labels=("Is Returned", "Is Open"), regressions=("l_quantity",), extra=("l_shipmode_year",), age=("c_acctbal", "days"), sex="raw_sex", view="raw_view",
        hooks=(lambda df: df.withColumns({"raw_view": word(VIEW_WORDS, F.col("l_linenumber")), "Is Returned": F.when(F.col("l_returnflag") == "R", 1.0).when(F.col("l_returnflag") == "A", 0.0), "Is Open": F.when(F.col("l_linestatus") == "O", 1.0), "l_shipmode_year": F.year("l_shipdate")}),),
        joins=(H.Join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), ("l_orderkey",), what="orders"),),
        codes="negative",
    )


def _harmonized(spark: SparkSession, d: str, **ids) -> DataFrame:
    s = spec(spark, d)
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", word(SEX_WORDS, F.col("c_nationkey")).alias("raw_sex"))
    source = lines(spark, d).join(orders, "l_orderkey")
    joins = (H.Join(people, ("o_custkey",), what="customers"),)
    return H.harmonize(source, H.Spec(**{**{f: getattr(s, f) for f in s.__dataclass_fields__}, "joins": joins}), **ids)


_CONTRACT = f"""
WITH s AS (SELECT l.*, o_custkey, c_acctbal, {_SEX_SQL} AS raw_sex, {_VIEW_SQL} AS raw_view,
  CASE l_returnflag WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN 0.0 END AS a, CASE l_linestatus WHEN 'O' THEN 1.0::DOUBLE END AS b
  FROM {_LINES} l JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
SELECT o_custkey::VARCHAR AS patient_id, l_orderkey::VARCHAR AS study_id, concat_ws('/', o_custkey, l_orderkey, l_linenumber || '.png') AS image_path,
  {_VIEW_CASE.format("raw_view")} AS view_position, CASE WHEN c_acctbal / 365.25 BETWEEN 0 AND 130 THEN c_acctbal / 365.25 END AS age_years,
  {_SEX_CASE.format("raw_sex")} AS sex, coalesce(b, CASE WHEN a IS NOT NULL THEN 0.0 END) AS is_open, coalesce(a, CASE WHEN b IS NOT NULL THEN 0.0 END) AS is_returned,
  l_quantity, year(l_shipdate)::INT AS l_shipmode_year FROM s
"""


@query(_CONTRACT)
def pf01_contract_table(spark, d):
    return _harmonized(spark, d)


@query(f"SELECT * FROM ({_CONTRACT}) WHERE study_id IN ('1', '5', '33', '1200')")
def pf03_early_id_filter(spark, d):
    return _harmonized(spark, d, studies=[1, 5, 33, "1200"])


@query(f"SELECT * FROM ({_CONTRACT}) WHERE patient_id IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_mktsegment = 'BUILDING')")
def pf03_id_filter_by_table(spark, d):
    return _harmonized(spark, d, patients=table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("SELECT * FROM (SELECT o_custkey::VARCHAR AS patient_id, o_orderkey::VARCHAR AS study_id, o_orderkey::VARCHAR || '-' || o_orderstatus AS question_id, 'p/' || o_orderkey AS image_path, o_orderpriority AS question, o_orderstatus AS answer, CASE WHEN o_totalprice > 200000 THEN 'hard' END AS quality FROM orders)")
def pf02_question_contract(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    return R.question_contract(o.select(F.col("o_custkey").cast("string").alias("patient_id"), key.alias("study_id"), F.concat_ws("-", key, "o_orderstatus").alias("question_id"), F.concat(F.lit("p/"), key).alias("image_path"), F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("answer"), F.when(F.col("o_totalprice") > 200000, "hard").alias("quality"), F.lit(1).alias("unused")))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def pf07_usable_rows(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text").withColumn("image_path", F.lit("x")).withColumnRenamed("text", "report")
    return R.usable_rows(docs, "report").select("doc_id", F.col("report").alias("text"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linestatus = 'F'")
def pf08_keep_split(spark, d):
    return R.keep_split(table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_linestatus"), "F", ["l_linestatus"]).drop("l_linestatus")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red ')")
def pf10_split_by_prefix(spark, d):
    return table(spark, d, "part", "p_partkey", "p_name").where(F.startswith("p_name", F.lit("red ")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def pf12_exclusion_list(spark, d):
    bad = table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    return R.drop_ids(table(spark, d, "orders", "o_orderkey", "o_custkey"), "o_custkey", bad)


@query("SELECT p_partkey, p_type, p_size FROM part WHERE (p_type IN ('LARGE', 'PROMO') OR p_brand IS NULL) AND p_retailprice >= 950 AND regexp_matches(p_name, 'ring|bolt') AND coalesce(p_size, 0) > 10")
def pf13_corpus_filter(spark, d):
    keep = (F.col("p_type").isin("LARGE", "PROMO") | F.col("p_brand").isNull()) & (F.col("p_retailprice") >= 950) & F.col("p_name").rlike("ring|bolt") & (F.coalesce("p_size", F.lit(0)) > 10)
    return table(spark, d, "part").where(keep).select("p_partkey", "p_type", "p_size")


@query("SELECT p_partkey, p_name FROM part WHERE p_type IN ('SMALL', 'LARGE') AND contains(upper(concat_ws(' ', p_name, p_brand)), 'BLUE')")
def pf16_text_and_modality_filter(spark, d):
    return table(spark, d, "part").where(F.col("p_type").isin("SMALL", "LARGE") & F.contains(F.upper(F.concat_ws(" ", "p_name", "p_brand")), F.lit("BLUE"))).select("p_partkey", "p_name")


@query("SELECT doc_id, quality, toxic FROM labels WHERE coalesce(quality, 0) <> 1 OR toxic = 1")
def pf19_label_filter(spark, d):
    return table(spark, d, "labels", "doc_id", "quality", "toxic").where((F.coalesce("quality", F.lit(0)) != 1) | (F.col("toxic") == 1))


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def jn02_duplicate_keys(spark, d):
    return R.duplicate_keys(table(spark, d, "lineitem", *LINE), LINE)


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def jn01_guarded_inner_joins(spark, d):
    people = table(spark, d, "customer", F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    df = G.join_unique(table(spark, d, "orders", "o_orderkey", "o_custkey"), people, ["o_custkey"], what="customers")
    return G.join_unique(df, table(spark, d, "nation", "n_nationkey", "n_name"), ["n_nationkey"], what="nations").select("o_orderkey", "c_name", "n_name")


@query("SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def jn04_left_label_join(spark, d):
    return G.join_unique(table(spark, d, "documents", "doc_id", "lang"), table(spark, d, "labels", "doc_id", "quality", "toxic"), ["doc_id"], "left")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn17_unlabelled_documents(spark, d):
    return R.unmatched(table(spark, d, "documents", "doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def jn15_semi_join(spark, d):
    return R.keep_ids(table(spark, d, "customer", "c_custkey", "c_name"), "c_custkey", table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 40)")
def jn12_first_keys(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    return o.join(o.select("o_custkey").distinct().orderBy("o_custkey").limit(40), "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT s_suppkey, coalesce(r_name, 'unknown') AS region FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON r_regionkey = n_regionkey")
def jn13_lookup_with_default(spark, d):
    n = table(spark, d, "nation", F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    r = table(spark, d, "region").where("r_regionkey < 3")
    return R.star(table(spark, d, "supplier", "s_suppkey", "s_nationkey"), [(n, "s_nationkey"), (r, "r_regionkey")]).select("s_suppkey", F.coalesce("r_name", F.lit("unknown")).alias("region"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT p_partkey, p_size FROM part)")
def jn11_composite_semi_join(spark, d):
    keys = table(spark, d, "part", F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("l_suppkey"))
    return table(spark, d, "lineitem", *LINE, "l_partkey", "l_suppkey").join(keys, ["l_partkey", "l_suppkey"], "left_semi").drop("l_suppkey")


@query("""SELECT doc_id, coalesce(h.quality, b.toxic, 9)::INT AS value, CASE WHEN h.quality IS NOT NULL THEN 'human' WHEN b.toxic IS NOT NULL THEN 'model' WHEN true THEN 'default' END AS source
  FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels WHERE doc_id % 2 = 0) h USING (doc_id) LEFT JOIN (SELECT doc_id, toxic FROM labels) b USING (doc_id)""")
def jn20_provenance_star(spark, d):
    own = table(spark, d, "labels")
    df = R.star(table(spark, d, "documents", "doc_id"), [(own.where("doc_id % 2 = 0").select("doc_id", "quality"), "doc_id"), (own.select("doc_id", "toxic"), "doc_id")])
    value, source = R.resolve({"human": F.col("quality"), "model": F.col("toxic"), "default": F.lit(9)})
    return df.select("doc_id", value.alias("value"), source.alias("source"))


@query("SELECT coalesce(a.l_suppkey, b.s_suppkey)::BIGINT AS k, a.n::BIGINT AS n_lines, b.s_acctbal FROM (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1) a FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) b ON a.l_suppkey = b.s_suppkey")
def jn22_full_outer(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n_lines"))
    b = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    return a.join(b, "k", "full_outer").select("k", "n_lines", "s_acctbal")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM {_LINES}")
def wn01_first_row_of_key(spark, d):
    return lines(spark, d).select(*LINE, "l_partkey", "l_quantity")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def wn02_latest_row_of_key(spark, d):
    e = table(spark, d, "events", "user_id", "event_id", "event_type", "ts")
    return R.first_row(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_purchase FROM events")
def wn04_first_known_in_group(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return R.first_known(e, ["user_id"], ["event_id"], "v", "first_purchase").select("event_id", "first_purchase")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type)::BIGINT AS size, dense_rank() OVER (PARTITION BY user_id ORDER BY ts::DATE)::INT AS visit, datediff('day', min(ts::DATE) OVER (PARTITION BY user_id), ts::DATE)::INT AS days FROM events")
def wn05_group_size_and_visits(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    user = Window.partitionBy("user_id")
    sizes = e.groupBy("event_type").agg(F.count("*").alias("size"))
    rows = e.select("event_id", "event_type", F.dense_rank().over(user.orderBy("day")).alias("visit"), F.datediff("day", F.min("day").over(user)).alias("days"))
    return rows.join(F.broadcast(sizes), "event_type").select("event_id", "size", "visit", "days")


@query("SELECT l_orderkey, l_linenumber, l_partkey, (row_number() OVER w - 1)::INT AS place, ((row_number() OVER w - 0.5) / count(*) OVER (PARTITION BY l_orderkey))::DOUBLE AS centre FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)")
def wn06_slice_rank(spark, d):
    rows = table(spark, d, "lineitem", *LINE, "l_partkey").distinct()
    series = Window.partitionBy("l_orderkey")
    n = F.row_number().over(series.orderBy("l_linenumber", "l_partkey"))
    return rows.select("*", (n - 1).alias("place"), ((n - 0.5) / F.count("*").over(series)).alias("centre"))


@query("SELECT p_partkey, p_name || CASE WHEN n = 0 THEN '' ELSE '_' || n END AS file FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) - 1 AS n FROM part)")
def wn12_name_collisions(spark, d):
    n = F.row_number().over(Window.partitionBy("p_brand", "p_name").orderBy("p_partkey")) - 1
    return table(spark, d, "part").withColumn("n", n).select("p_partkey", F.concat("p_name", F.when(F.col("n") == 0, "").otherwise(F.concat(F.lit("_"), F.col("n").cast("string")))).alias("file"))


@query("""SELECT p_partkey, CASE WHEN a <= 1 AND b <= 1 AND a + b = k THEN p_type ELSE 'view_' || n END AS view FROM (SELECT p_partkey, p_type,
  count(*) FILTER (p_type = 'SMALL') OVER (PARTITION BY p_name, p_brand) AS a, count(*) FILTER (p_type = 'LARGE') OVER (PARTITION BY p_name, p_brand) AS b,
  count(*) OVER (PARTITION BY p_name, p_brand) AS k, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS n FROM part)""")
def wn13_views_of_a_study(spark, d):
    study = Window.partitionBy("p_name", "p_brand")
    kind = lambda t: F.count_if(F.col("p_type") == t).over(study)
    rows = table(spark, d, "part").withColumns({"a": kind("SMALL"), "b": kind("LARGE"), "k": F.count("*").over(study), "n": F.row_number().over(study.orderBy("p_partkey"))})
    return rows.select("p_partkey", F.when((F.col("a") <= 1) & (F.col("b") <= 1) & (F.col("a") + F.col("b") == F.col("k")), F.col("p_type")).otherwise(F.concat(F.lit("view_"), F.col("n").cast("string"))).alias("view"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def ag40_distinct(spark, d):
    return table(spark, d, "lineitem", "l_returnflag", "l_linestatus").distinct()


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def so01_union_by_name(spark, d):
    a = table(spark, d, "customer", F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(table(spark, d, "supplier", F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def so03_set_difference(spark, d):
    return table(spark, d, "customer", F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")))


@query("SELECT doc_id AS k FROM documents INTERSECT SELECT doc_id FROM labels")
def so04_set_intersection(spark, d):
    return table(spark, d, "documents", F.col("doc_id").alias("k")).intersect(table(spark, d, "labels", F.col("doc_id").alias("k")))


@query("SELECT p_partkey, split_part(finding, '*', 1) AS finding, present FROM (SELECT p_partkey, p_size > 10 AS \"a*x\", p_size > 20 AS \"b*x\", p_size > 30 AS \"c*y\" FROM part) UNPIVOT (present FOR finding IN (\"a*x\", \"b*x\", \"c*y\"))")
def rs01_unpivot(spark, d):
    wide = table(spark, d, "part").select("p_partkey", *((F.col("p_size") > n).alias(c) for c, n in (("a*x", 10), ("b*x", 20), ("c*y", 30))))
    return wide.unpivot(["p_partkey"], ["a*x", "b*x", "c*y"], "finding", "present").withColumn("finding", F.split_part("finding", F.lit("*"), F.lit(1)))


@query("SELECT user_id, " + ", ".join(f"max(value) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def rs02_pivot(spark, d):
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.max("value"))


@query("SELECT p_partkey, " + ", ".join(f"regexp_matches(p_name, '{w}')::INT AS {w}" for w in ("blue", "red", "ring")) + " FROM part")
def rs05_one_hot_of_text(spark, d):
    return table(spark, d, "part").select("p_partkey", *(F.col("p_name").rlike(w).cast("int").alias(w) for w in ("blue", "red", "ring")))


@query("SELECT p_partkey, " + ", ".join(f"CASE WHEN p_size > 5 THEN (p_type = '{t}')::INT END AS is_{t.lower()}" for t in ("LARGE", "PROMO", "SMALL")) + " FROM part")
def rs09_one_hot_with_nulls(spark, d):
    kind = F.when(F.col("p_size") > 5, F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", *((kind == t).cast("int").alias(f"is_{t.lower()}") for t in ("LARGE", "PROMO", "SMALL")))


@query("SELECT c_custkey, image, view FROM (SELECT c_custkey, unnest([c_name, c_mktsegment, NULL]) AS image, unnest(['PA', NULL, NULL]) AS view FROM customer) WHERE image IS NOT NULL")
def rs10_explode_parallel_lists(spark, d):
    zipped = F.arrays_zip(F.array("c_name", "c_mktsegment", F.lit(None)).alias("image"), F.array(F.lit("PA")).alias("view"))
    return table(spark, d, "customer").select("c_custkey", F.inline(zipped)).where("image IS NOT NULL")


@query("SELECT o_custkey, count(*)::BIGINT AS n_images, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey) AS images, max((o_orderstatus = 'F')::INT) AS any_f FROM orders GROUP BY o_custkey")
def rs11_patient_rollup(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.count("*").alias("n_images"), F.array_join(F.array_sort(F.collect_list("o_orderkey")), "|").alias("images"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("any_f"))


@query("SELECT event_id, (props->>'k')::INT AS k FROM events")
def sc17_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT p_partkey, p_name FROM part ORDER BY try_cast(regexp_extract(p_brand, '(\\d+)', 1) AS INT), p_partkey")
def st05_natural_sort(spark, d):
    return table(spark, d, "part").orderBy(S.extract(F.col("p_brand"), r"(\d+)").cast("int"), "p_partkey").select("p_partkey", "p_name")


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY nullif(s_nationkey, 3) DESC NULLS LAST, s_suppkey")
def st04_sort_nulls_last(spark, d):
    return table(spark, d, "supplier").orderBy(F.desc_nulls_last(F.nullif("s_nationkey", F.lit(3))), "s_suppkey").select("s_suppkey", "s_acctbal")


@query("SELECT p_partkey, row_number() OVER (ORDER BY try_cast(regexp_extract(p_brand, '(\\d+)', 1) AS INT) NULLS FIRST, p_partkey) AS place FROM part")
def st05_natural_sort_places(spark, d):
    p = table(spark, d, "part").select("p_partkey", S.extract(F.col("p_brand"), r"(\d+)").cast("int").alias("number"))
    return R.places(p, [F.asc_nulls_first("number"), F.asc("p_partkey")], ["number"], "p_partkey").select("p_partkey", "place")


@query("SELECT s_suppkey, row_number() OVER (ORDER BY nullif(s_nationkey, 3) DESC NULLS LAST, s_suppkey) AS place FROM supplier")
def st04_nulls_last_places(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(3)).alias("nation"))
    return R.places(s, [F.desc_nulls_last("nation"), F.asc("s_suppkey")], ["nation"], "s_suppkey").select("s_suppkey", "place")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || ':7'), doc_id LIMIT 25")
def st09_random_sample(spark, d):
    from ..operators.evaluation import sample

    return sample(table(spark, d, "documents", "doc_id"), 25, "doc_id", 7)


@query("SELECT p_partkey, p_type, n / least(n, 20)::DOUBLE AS weight FROM (SELECT *, count(*) OVER (PARTITION BY p_type) AS n, row_number() OVER (PARTITION BY p_type ORDER BY md5(p_partkey || ':3'), p_partkey) AS r FROM part) WHERE r <= 20")
def st11_stratified_sample(spark, d):
    from ..operators.evaluation import stratified

    return stratified(table(spark, d, "part", "p_partkey", "p_type"), "p_type", 20, "p_partkey", 3)
