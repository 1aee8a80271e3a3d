"""Files written from the test tables and read again, and operators of tables that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as X
from ..operators import evaluation as E
from ..operators import guards as G
from ..operators import relational as R
from ..sources import readers, scratch
from .base import query, r6, table

CSV = {"header": True, "quote": '"', "escape": '"'}


def _notes(spark, d):
    """Texts with line breaks, quotes and commas, and words that stand for nothing."""
    quoted = F.concat(F.lit('said "no", then\n'), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", quoted.alias("note"), F.when(F.col("doc_id") % 3 == 0, "NA").when(F.col("doc_id") % 3 == 1, "null").otherwise(F.col("lang")).alias("lang"))


_NOTES = "SELECT doc_id, md5('said \"no\", then' || chr(10) || coalesce(text, '')) AS note, CASE WHEN doc_id % 3 = 2 THEN nullif(lang, '') END AS lang FROM documents"


@query(_NOTES)
def sc01_csv_with_quotes_and_line_breaks(spark, d):
    path = scratch.folder(spark)
    _notes(spark, d).write.options(**CSV, quoteAll=True).csv(path)
    return readers.csv(spark, path, "doc_id long, note string, lang string").select("doc_id", F.md5("note").alias("note"), "lang")


@query(_NOTES.replace("doc_id,", "doc_id::VARCHAR AS doc_id,", 1))
def sc02_csv_all_text(spark, d):
    path = scratch.folder(spark)
    _notes(spark, d).write.options(**CSV).csv(path)
    return readers.csv(spark, path).select("doc_id", F.md5("note").alias("note"), "lang")


@query("SELECT c_custkey AS key, c_mktsegment AS segment FROM customer")
def sc04_csv_with_replaced_header(spark, d):
    path = scratch.folder(spark)
    table(spark, d, "customer", "c_custkey", "c_acctbal", "c_mktsegment").write.options(**CSV).csv(path)
    return readers.csv(spark, path, names=["key", "balance", "segment"], columns=["key", "segment"], lines=True).select(F.col("key").cast("long").alias("key"), "segment")


@query("SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part")
def sc05_tsv_of_many_files(spark, d):
    path = scratch.folder(spark)
    table(spark, d, "part", "p_partkey", "p_name", "p_size").repartition(3).write.options(**CSV, sep="\t", compression="gzip").csv(path)
    return readers.csv(spark, path, "p_partkey long, p_name string, p_size long", sep="\t", lines=True)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def sc12_json_array(spark, d):
    path = scratch.folder(spark)
    # The 25 nations are what stands in one array.
    rows = table(spark, d, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    rows.write.text(path)
    return readers.json_array(spark, path, "n_nationkey long, n_name string")


_SPACED = "(['', ' ', chr(9) || chr(10), chr(160) || ' ', chr(10) || 'm', 'F' || chr(9), 'PA' || chr(13), ' lat '])"


@query(f"""SELECT event_id, s = '' AS blank, CASE lower(s) WHEN 'm' THEN 'M' WHEN 'f' THEN 'F' END AS sex, CASE WHEN s = '' THEN NULL WHEN lower(s) = 'lat' THEN 'LATERAL' ELSE upper(s) END AS view
  FROM (SELECT event_id, regexp_replace({_SPACED}[1 + event_id % 8], '^[\\s' || chr(160) || ']+|[\\s' || chr(160) || ']+$', '', 'g') AS s FROM events)""")
def fs04_white_space(spark, d):
    words = F.array(*map(F.lit, ["", " ", "\t\n", "\xa0 ", "\nm", "F\t", "PA\r", " lat "]))
    e = table(spark, d, "events").select("event_id", F.get(words, (F.col("event_id") % 8).cast("int")).alias("w"))
    return e.select("event_id", S.is_blank(F.col("w")).alias("blank"), S.sex(F.col("w")).alias("sex"), S.view(F.col("w")).alias("view"))


@query("SELECT p_partkey, split_part(p_name, ' ', -1) AS last, CASE WHEN starts_with(p_brand, 'Brand') THEN substr(p_brand, 6) ELSE p_brand END AS rest, replace(p_type, ' ', '__') AS flat FROM part")
def fs06_ends_of_names(spark, d):
    brand = F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", F.substring_index("p_name", " ", -1).alias("last"), S.without_prefix(brand, "Brand").alias("rest"), F.replace("p_type", F.lit(" "), F.lit("__")).alias("flat"))


def _tags_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    rules = [("radiology", m, "high", p) for m, p in X.MODALITIES] + [(s, None, "high", p) for s, p in X.SPECIALTIES] + [("radiology", "radiology_other", "low", X.GENERIC), ("non_medical", None, "low", X.NOT_MEDICAL)]
    pick = lambda i: "CASE " + " ".join(f"WHEN regexp_matches(t, {quoted(r[3])}, 'i') THEN {quoted(r[i]) if r[i] else 'NULL'}" for r in rules)
    return f"SELECT doc_id, {pick(0)} ELSE 'unknown' END AS specialty, {pick(1)} END AS modality, {pick(2)} END AS confidence FROM ({_CAPTIONS})"


_WORDS = ["Histopathology, H&E stain", "Fundus photograph", "ECG strip", "colonoscopy, axial view", "skin lesion", "scale bar 5", "occlusal view", "retina image x 20", "plain", "axial CT", "flow chart"]
_CAPTIONS = "SELECT doc_id, ([" + ", ".join(f"'{w}'" for w in _WORDS) + "])[1 + doc_id % 11] || ' ' || coalesce(text, '') AS t FROM documents"


@query(_tags_sql())
def fs24_tags_of_texts(spark, d):
    caption = F.concat(F.get(F.array(*map(F.lit, _WORDS)), (F.col("doc_id") % 11).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))
    t = X.tag_caption(F.col("caption"), F.lit(None).cast("string"))
    return table(spark, d, "documents").select("doc_id", caption.alias("caption")).select("doc_id", t.alias("t")).select("doc_id", "t.specialty", "t.modality", "t.confidence")


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN (SELECT c_custkey AS o_custkey, c_mktsegment FROM customer) USING (o_custkey)")
def jn06_left_join_of_same_length(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return R.left_join_once(table(spark, d, "orders", "o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "c_mktsegment")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def jn09_mapping_with_rows(spark, d):
    joined = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return G.require_rows(joined.select("s_suppkey", "n_name"), "suppliers by nation")


@query("SELECT doc_id, l.toxic = l.quality AS agree, b.item_id IS NOT NULL AS has_item FROM documents JOIN labels l USING (doc_id) LEFT JOIN (SELECT DISTINCT item_id FROM benchmark) b ON b.item_id::VARCHAR = doc_id::VARCHAR")
def jn21_agreement_chain(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("item")).distinct()
    rows = table(spark, d, "documents", "doc_id").join(table(spark, d, "labels"), "doc_id").join(items, F.col("doc_id").cast("string") == F.col("item"), "left")
    return rows.select("doc_id", (F.col("toxic") == F.col("quality")).alias("agree"), F.col("item").isNotNull().alias("has_item"))


@query("SELECT user_id, string_agg(event_id::VARCHAR || ':' || event_type, ';' ORDER BY event_id) AS boxes FROM events GROUP BY user_id")
def ag03_boxes_to_list(spark, d):
    item = F.struct("event_id", F.concat_ws(":", F.col("event_id").cast("string"), "event_type").alias("box"))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select("user_id", F.array_join(F.transform("items", lambda x: x["box"]), ";").alias("boxes"))


@query("""SELECT label, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (SELECT o_orderpriority AS label, floor(o_totalprice / 100) AS score, count(*) FILTER (o_orderstatus = 'F') AS pos, count(*) FILTER (o_orderstatus <> 'F') AS neg FROM orders GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY label ORDER BY score DESC)""".replace("sum(pos) OVER w", "(sum(pos) OVER w)::BIGINT").replace("sum(neg) OVER w", "(sum(neg) OVER w)::BIGINT"))
def wn07_roc_points(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), F.floor(F.col("o_totalprice") / 100).cast("double").alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return E.by_score(rows, ["label"]).select("label", "score", "tp", "fp")


@query("SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) USING (i)")
def so02_side_by_side(spark, d):
    return R.side_by_side(table(spark, d, "customer", "c_custkey"), table(spark, d, "supplier", "s_suppkey"), "c_custkey", "s_suppkey").drop("place")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || ':5'), o_orderkey) AS place FROM orders")
def st10_shuffle(spark, d):
    h = table(spark, d, "orders", "o_orderkey").withColumn("h", E.hash_key("o_orderkey", 5)).withColumn("at", F.conv(F.substring("h", 1, 12), 16, 10).cast("double"))
    return R.places(h, [F.asc("h"), F.asc("o_orderkey")], [], "at").select("o_orderkey", "place")


@query("SELECT s_suppkey, round((s_acctbal - min(s_acctbal) OVER w) / nullif(max(s_acctbal) OVER w - min(s_acctbal) OVER w, 0), 6)::DOUBLE AS scaled FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
def fm21_scaled(spark, d):
    s = table(spark, d, "supplier")
    ends = s.groupBy("s_nationkey").agg(F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high"))
    return s.join(ends, "s_nationkey").select("s_suppkey", r6(S.min_max(F.col("s_acctbal"), F.col("low"), F.col("high"))).alias("scaled"))


@query("SELECT o_orderkey, o_custkey AS who_id, o_totalprice AS who_paid_total, length(o_orderpriority)::INT AS rank FROM orders")
def fa15_flat_numbers(spark, d):
    paid = F.struct(F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"))
    nested = table(spark, d, "orders").select("o_orderkey", F.struct(F.struct(F.col("o_custkey").alias("id"), paid.alias("paid")).alias("who"), F.col("o_orderpriority").alias("text"), F.length("o_orderpriority").alias("rank")).alias("n"))
    return nested.select("o_orderkey", *R.flat_numbers(F.col("n"), nested.schema["n"].dataType))


@query("SELECT u.conv_id::VARCHAR AS id, u.turn::VARCHAR AS turn, coalesce(u.text, '') AS question, coalesce(a.text, '') AS answer FROM conversations u LEFT JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'")
def sb02_question_samples(spark, d):
    c = table(spark, d, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = c.where("role = 'user'").join(answers, ["conv_id", "turn"], "left")
    return rows.select(F.col("conv_id").cast("string").alias("id"), F.col("turn").cast("string").alias("turn"), F.coalesce("text", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))


@query("SELECT event_type AS label, count(*) AS n, count(*) FILTER (value > 10) AS n_failed, count(*) FILTER (value > 50) AS n_hard FROM events GROUP BY 1")
def sk13_failures_by_label(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"), F.count_if(v > 10).alias("n_failed"), F.count_if(v > 50).alias("n_hard"))


@query("SELECT p_partkey, p_name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS p_brand, p_size::BIGINT AS p_size FROM part")
def sc07_csv_files_united_by_name(spark, d):
    """Files of one table whose columns stand in three orders, one of them with a column less."""
    path, p = scratch.folder(spark), table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_size")
    for i, columns in enumerate((["p_size", "p_partkey", "p_name"], ["p_name", "p_brand", "p_partkey", "p_size"], ["p_partkey", "p_size", "p_brand", "p_name"])):
        p.where(F.col("p_size") % 3 == i).select(columns).write.mode("append").options(**CSV).csv(path)
    return readers.csv_by_name(spark, path, "p_partkey long, p_name string, p_brand string, p_size long", lines=True)


@query("""SELECT event_id, regexp_replace(regexp_replace(lower(t), '^\\s+|\\s+$', '', 'g'), '\\s+', '_', 'g') AS label FROM
  (SELECT event_id, chr(9) || ' ' || event_type || chr(10) || ' ' || event_id || chr(13) || chr(10) AS t FROM events)""")
def fs02_box_labels(spark, d):
    label = F.concat(F.lit("\t "), "event_type", F.lit("\n "), F.col("event_id").cast("string"), F.lit("\r\n"))
    return table(spark, d, "events").select("event_id", S.box_label(label).alias("label"))


@query("""SELECT doc_id, CASE WHEN n % 3 = 0 THEN '' ELSE x END AS findings, CASE WHEN n % 3 = 0 THEN '' ELSE x END AS impression FROM
  (SELECT doc_id, length(text) AS n, 'n' || length(text) || ' ' || coalesce(lang, 'none') AS x FROM documents)""")
def fs20_empty_sections(spark, d):
    """Notes whose sections are there with nothing in them, which give no text, beside notes with one."""
    x, n = F.concat(F.lit("n"), F.char_length("text").cast("string"), F.lit(" "), F.coalesce("lang", F.lit("none"))), F.char_length("text")
    note = F.when(n % 3 == 0, F.lit("TECHNIQUE: one view.\nFINDINGS:\n \n")).when(n % 3 == 1, F.concat(F.lit("HISTORY: none\nFINDINGS:  "), x, F.lit("\n"))).otherwise(F.concat(F.lit("EXAMINATION: a\nFINDINGS:\nIMPRESSION:\n"), x))
    return table(spark, d, "documents").select("doc_id", note.alias("t")).select("doc_id", *(S.report_section(F.col("t"), s).alias(s) for s in ("findings", "impression")))


@query("""SELECT count(*) AS n_rows, count(o_clerk_of) AS known_customer, count(*) FILTER (l_linenumber = 1) AS known_first, 'column ''l_comment'' was asked for and is not there' AS warning
  FROM (SELECT l_linenumber, o_custkey AS o_clerk_of FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""")
def qg04_counts_while_a_query_runs(spark, d):
    """Lines with their order, each of which must be there; what is counted comes from the one run that writes them."""
    orders = table(spark, d, "orders", F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer"))
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber").withColumn("first", F.when(F.col("l_linenumber") == 1, F.lit(True)))
    joined = G.join_required(lines, orders, ["l_orderkey"], "orders")
    missing, metrics = G.warnings(joined, ["customer", "first", "l_comment"])
    rows, seen = G.observed(joined, **metrics)
    rows.write.parquet(scratch.folder(spark))
    found = seen.get
    return spark.createDataFrame([(*(found[k] for k in ("n_rows", "known_customer", "known_first")), missing[0])], "n_rows long, known_customer long, known_first long, warning string")
