"""More filters, joins, numberings, sorts and shapes of tables. Orders stand for studies, lines for images."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import scalars as S
from ..functions import text as T
from ..operators import evaluation as E
from ..operators import guards as G
from ..operators import relational as R
from .base import query, r6, table


@query("SELECT event_id, 's' || user_id AS subject FROM events WHERE user_id IN (3, 5, 12)")
def pf05_prefixed_ids(spark, d):
    subject = lambda c: F.concat(F.lit("s"), F.ltrim(c, F.lit("s")))
    wanted = [f"s{str(x).lstrip('s')}" for x in (3, "s5", "12")]
    return table(spark, d, "events").select("event_id", subject(F.col("user_id").cast("string")).alias("subject")).where(F.col("subject").isin(*wanted))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 40)")
def pf11_split_by_membership(spark, d):
    split = table(spark, d, "lineitem").where("l_linestatus = 'F' AND l_quantity > 40").select("l_orderkey")
    return R.keep_ids(table(spark, d, "orders", "o_orderkey", "o_custkey"), "o_orderkey", split)


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 20 THEN p_type END, CASE WHEN p_size % 2 = 0 THEN p_brand END) AS modality, CASE WHEN p_size > 20 THEN 'clip' WHEN p_size % 2 = 0 THEN 'caption' END AS source FROM part")
def pf14_effective_modality(spark, d):
    value, name = R.resolve({"clip": F.when(F.col("p_size") > 20, F.col("p_type")), "caption": F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))})
    return table(spark, d, "part").select("p_partkey", value.alias("modality"), name.alias("source"))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic = 0, false)")
def pf17_nullable_flag(spark, d):
    df = table(spark, d, "documents", "doc_id").join(table(spark, d, "labels", "doc_id", "toxic"), "doc_id", "left")
    return df.where(F.coalesce(F.col("toxic") == 0, F.lit(False))).select("doc_id")


@query("SELECT doc_id, quality FROM labels WHERE NOT coalesce(toxic, 0) = 1")
def pf20_meta_label_rows(spark, d):
    return table(spark, d, "labels").where(F.coalesce("toxic", F.lit(0)) != 1).select("doc_id", "quality")


_EDGES = "greatest(0, l_discount * 10 - 0.3) < least(1, l_discount * 10 + l_tax * 5 - 0.2)"


def _boxes(spark, d):
    edge = F.array(F.lit(0.0), F.lit(1.0), F.col("l_discount") * 10 - 0.3, F.col("l_discount") * 10 + F.col("l_tax") * 5 - 0.2)
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(edge.alias("box"), F.col("l_returnflag").alias("label"))).alias("items"))
    return rows.select("l_orderkey", F.size("items").alias("n"), B.clip_with(F.transform("items", lambda x: x["box"]), F.transform("items", lambda x: x["label"])).alias("kept"))


@query(f"SELECT l_orderkey, count(*)::INT AS n_boxes FROM lineitem WHERE {_EDGES} GROUP BY 1")
def pf21_images_with_boxes(spark, d):
    return _boxes(spark, d).where(F.size("kept") > 0).select("l_orderkey", F.size("kept").alias("n_boxes"))


@query(f"SELECT l_orderkey, count(*)::INT AS n_boxes FROM lineitem WHERE {_EDGES} AND l_returnflag IN ('R', 'A') GROUP BY 1")
def pf31_boxes_of_classes(spark, d):
    own = F.filter("kept", lambda z: z["p0"].isin("R", "A"))
    return _boxes(spark, d).select("l_orderkey", F.size(own).alias("n_boxes")).where("n_boxes > 0")


@query(f"SELECT count(*)::BIGINT AS n_boxes, count(*) FILTER ({_EDGES})::BIGINT AS n_kept, count(*) FILTER (NOT {_EDGES})::BIGINT AS n_dropped FROM lineitem")
def ag42_box_counts(spark, d):
    return _boxes(spark, d).agg(F.sum("n").alias("n_boxes"), F.sum(F.size("kept")).alias("n_kept"), F.sum(F.col("n") - F.size("kept")).alias("n_dropped"))


@query("SELECT 'd/' || lang || '/' || doc_id AS path, doc_id IN (SELECT doc_id FROM labels) AS present FROM documents")
def pf23_missing_files(spark, d):
    path = F.concat_ws("/", F.lit("d"), "lang", "doc_id").alias("path")
    expected = table(spark, d, "documents", path)
    listing = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select(path)
    missing, found = R.missing_and_unused(expected, listing, "path")
    return missing.withColumn("present", F.lit(False)).unionByName(found.withColumn("present", F.lit(True)))


@query("SELECT c_custkey AS cust_key, c_mktsegment AS market_segment, 'all' AS split FROM customer")
def pf26_renamed_columns(spark, d):
    df = table(spark, d, "customer").withColumnsRenamed({"c_custkey": "Cust Key", "c_mktsegment": "Market Segment", "c_name": "Unnamed: 0"})
    df = df.select("Cust Key", "Market Segment", "Unnamed: 0")
    return df.select(*(F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in df.columns if not c.startswith("Unnamed")), F.lit("all").alias("split"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 3 < 2 AND label <> (vec_id % 10) AND (label = 3 OR vec_id % 10 = 3) AND vec_id NOT IN (SELECT doc_id FROM labels)")
def pf30_unreviewed_failures(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "label").withColumn("said", F.col("vec_id") % 10)
    failed = e.where((F.col("vec_id") % 3 < 2) & (F.col("label") != F.col("said")) & ((F.col("label") == 3) | (F.col("said") == 3)))
    return R.drop_ids(failed, "vec_id", table(spark, d, "labels", "doc_id")).drop("said")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IN ('en', 'de') AND (quality IN (0, 1) OR toxic IN (0, 1))")
def pf32_cohort(spark, d):
    df = table(spark, d, "documents", "doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return df.where(F.col("lang").isin("en", "de") & (S.usable_label(F.col("quality")) | S.usable_label(F.col("toxic")))).select("doc_id")


@query("SELECT u.conv_id, u.turn FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE trim(u.text) <> '' AND trim(a.text) <> ''")
def pf33_usable_pairs(spark, d):
    c = table(spark, d, "conversations")
    pairs = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")), ["conv_id", "turn"])
    return pairs.where(T.usable_pair(F.col("text"), F.col("next"))).select("conv_id", "turn")


@query("SELECT o_orderkey, c_mktsegment AS label, c_acctbal AS age, n_name AS view FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0")
def jn03_sub_tables(spark, d):
    people = table(spark, d, "customer")
    key = F.col("c_custkey").alias("o_custkey")
    views = people.join(table(spark, d, "nation", F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    df = table(spark, d, "orders", "o_orderkey", "o_custkey")
    for part in (people.select(key, F.col("c_mktsegment").alias("label")), people.where("c_acctbal > 0").select(key, F.col("c_acctbal").alias("age")), views.select(key, F.col("n_name").alias("view"))):
        df = G.join_unique(df, part, ["o_custkey"])
    return df.drop("o_custkey")


@query("SELECT doc_id, CASE WHEN trim(text) <> '' THEN length(text)::INT END AS n FROM labels LEFT JOIN documents USING (doc_id) WHERE quality = 1")
def jn05_reports_of_what_is_left(spark, d):
    left = table(spark, d, "labels").where("quality = 1").select("doc_id")
    reports = table(spark, d, "documents", "doc_id", "text").join(left, "doc_id", "left_semi").select("doc_id", F.when(F.trim("text") != "", F.char_length("text")).alias("n"))
    return G.join_unique(left, reports, ["doc_id"], "left", "reports")


@query("SELECT s_suppkey, s_name, c_name FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey AND c_nationkey < 20")
def jn07_one_to_one(spark, d):
    other = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("s_suppkey"), "c_name")
    return G.join_one_to_one(table(spark, d, "supplier", "s_suppkey", "s_name"), other, ["s_suppkey"], "customers")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def jn14_required_lookup(spark, d):
    nations = table(spark, d, "nation", F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return G.join_required(table(spark, d, "customer", "c_custkey", "c_nationkey"), nations, ["c_nationkey"], "nations").drop("c_nationkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem f WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = f.l_orderkey AND b.l_quantity > 30) AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = f.l_orderkey AND b.l_linenumber = f.l_linenumber AND b.l_quantity > 30)")
def jn18_facts_without_dimension(spark, d):
    facts = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    regions = table(spark, d, "lineitem").where("l_quantity > 30").select("l_orderkey", "l_linenumber")
    return R.unmatched(facts, regions, ["l_orderkey", "l_linenumber"]).join(regions.select("l_orderkey"), "l_orderkey", "left_semi")


@query("SELECT c_mktsegment AS split, count(*)::BIGINT AS n_missing FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) GROUP BY 1")
def jn19_missing_by_split(spark, d):
    folders = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return R.unmatched(table(spark, d, "customer", "c_custkey", F.col("c_mktsegment").alias("split")), folders, ["c_custkey"]).groupBy("split").agg(F.count("*").alias("n_missing"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size <= 5")
def jn24_labels_by_name(spark, d):
    train = table(spark, d, "part", "p_partkey", "p_size", "p_retailprice").where("p_size > 25")
    return train.unionByName(table(spark, d, "part", "p_retailprice", "p_size", "p_partkey").where("p_size <= 5"))


@query("""SELECT p.l_orderkey, p.l_linenumber, place, n::INT AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30) p
  JOIN (SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::INT AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N')) s USING (l_orderkey, l_linenumber)""")
def jn25_points_on_slices(spark, d):
    key = ["l_orderkey", "l_linenumber"]
    points = table(spark, d, "lineitem").where("l_quantity > 30").select(*key).distinct()
    series = Window.partitionBy("l_orderkey")
    slices = table(spark, d, "lineitem").where("l_returnflag <> 'N'").select(*key).distinct()
    ranks = slices.select(*key, (F.row_number().over(series.orderBy("l_linenumber")) - 1).alias("place"), F.count("*").over(series).cast("int").alias("n"))
    return points.join(ranks, key)


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) AS value FROM events GROUP BY 1")
def wn03_first_by_position(spark, d):
    # An aggregate keeps one row a key before the shuffle, which a window cannot.
    row = F.min_by(F.struct("event_type", "value"), "event_id").alias("r")
    return table(spark, d, "events").groupBy("user_id").agg(row).select("user_id", "r.*")


@query("SELECT event_id, (rank() OVER (PARTITION BY event_type ORDER BY floor(value)) + (count(*) OVER (PARTITION BY event_type, floor(value)) - 1) / 2.0)::DOUBLE AS rank FROM events")
def wn08_average_rank(spark, d):
    e = table(spark, d, "events", "event_id", "event_type", F.floor("value").alias("v"))
    counts = e.groupBy("event_type", "v").agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy("event_type").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select("event_type", "v", (F.coalesce(below, F.lit(0)) + (F.col("n") + 1) / 2.0).alias("rank"))
    return e.join(ranks, ["event_type", "v"]).select("event_id", "rank")


@query("SELECT o_orderdate, o_orderpriority AS model, row_number() OVER (PARTITION BY o_orderdate ORDER BY sum(o_totalprice) DESC, o_orderpriority)::INT AS rank FROM orders GROUP BY 1, 2")
def wn10_ranks_of_draws(spark, d):
    scores = table(spark, d, "orders").groupBy("o_orderdate", F.col("o_orderpriority").alias("model")).agg(F.sum("o_totalprice").alias("score"))
    return E.ranks_by_draw(scores, ["o_orderdate"]).drop("score")


@query("SELECT o_orderdate, o_orderpriority AS model, row_number() OVER (PARTITION BY o_orderdate ORDER BY sum(o_totalprice) DESC, o_orderpriority)::INT AS rank FROM orders GROUP BY 1, 2")
def wn10_ranks_of_all_draws(spark, d):
    scores = table(spark, d, "orders").groupBy("o_orderdate", F.col("o_orderpriority").alias("model")).agg(F.sum("o_totalprice").alias("score"))
    return E.ranks_by_draw(scores, ["o_orderdate"]).drop("score")


@query("SELECT row_number() OVER (ORDER BY round(avg(s_acctbal), 6) DESC, s_nationkey)::INT AS rank, s_nationkey, round(avg(s_acctbal), 6) AS score FROM supplier GROUP BY s_nationkey")
def wn11_leaderboard(spark, d):
    # One row for each nation is what is ranked.
    scores = table(spark, d, "supplier").groupBy("s_nationkey").agg(r6(F.avg("s_acctbal")).alias("score"))
    return E.ranks_by_draw(scores.withColumn("draw", F.lit(0)), ["draw"], "s_nationkey").drop("draw")


@query("SELECT user_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS number FROM events GROUP BY user_id")
def wn14_groups_by_first_appearance(spark, d):
    return R.number_groups(table(spark, d, "events", "user_id", "event_id"), "user_id", "event_id")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice > 200000 DESC, o_totalprice, o_orderkey")
def st03_mixed_sort(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc(F.col("o_totalprice") > 200000), "o_totalprice", "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice > 200000 DESC, o_totalprice, o_orderkey) AS place FROM orders")
def st03_mixed_sort_places(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_totalprice").withColumn("large", F.col("o_totalprice") > 200000)
    return R.places(o, [F.asc("o_orderpriority"), F.desc("large"), F.asc("o_totalprice"), F.asc("o_orderkey")], ["o_orderpriority", "large"], "o_totalprice").select("o_orderkey", "place")


@query("SELECT doc_id, text FROM documents WHERE trim(text) <> '' AND doc_id IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 40")
def st07_first_usable_pairs(spark, d):
    pairs = table(spark, d, "documents", "doc_id", "text").join(table(spark, d, "labels", "doc_id"), "doc_id", "left_semi")
    return pairs.where(~S.is_blank(F.col("text"))).orderBy("doc_id").limit(40)


@query("SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def st08_top_groups(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("SELECT label, arg_min(doc_id, md5(doc_id || ':11')) AS doc_id FROM (SELECT doc_id, 'quality' AS label FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1) GROUP BY 1")
def st12_positive_of_each_label(spark, d):
    long = table(spark, d, "labels").unpivot("doc_id", ["quality", "toxic"], "label", "y").where("y = 1")
    return long.groupBy("label").agg(F.min_by("doc_id", F.struct(E.hash_key("doc_id", 11), F.col("doc_id"))).alias("doc_id"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id || ':5')) <= round(count(*) OVER () / 5.0) THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id FROM labels ORDER BY md5(doc_id || ':4') LIMIT 100)")
def st14_cohort_then_split(spark, d):
    return E.train_val(E.sample(table(spark, d, "labels", "doc_id"), 100, "doc_id", 4), "doc_id", 5, 5)


@query("SELECT n_train, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':56'), doc_id) AS place FROM labels), (SELECT unnest([10, 50, -1]) AS n_train) WHERE n_train < 0 OR place <= n_train GROUP BY 1")
def st15_training_sizes(spark, d):
    return E.training_sizes(table(spark, d, "labels", "doc_id"), "doc_id", [10, 50, -1]).groupBy("n_train").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels))::BIGINT AS only_first, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents))::BIGINT AS only_second")
def so05_id_sets(spark, d):
    a, b = table(spark, d, "documents", "doc_id").distinct(), table(spark, d, "labels", "doc_id").distinct()
    side = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "doc_id", "full")
    return side.agg(F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"))


@query("SELECT p_brand, count(*) FILTER (p_type = 'SMALL')::BIGINT AS small, count(*) FILTER (p_type = 'LARGE')::BIGINT AS large FROM part GROUP BY 1")
def rs03_complete_columns(spark, d):
    counts = table(spark, d, "part").groupBy("p_brand").agg(F.count_if(F.col("p_type") == "SMALL").alias("small"), F.count_if(F.col("p_type") == "LARGE").alias("large"))
    long = counts.unpivot("p_brand", ["small", "large"], "k", "v").unionByName(counts.limit(1).select("p_brand", F.lit("partial").alias("k"), F.lit(1).cast("long").alias("v")))
    return R.pivot_complete(long, "p_brand", "k", "v", ["small", "large", "partial"])


@query("SELECT o_orderpriority, " + ", ".join(f"round({f}(o_totalprice) FILTER (o_orderstatus = '{s}'), 6) AS {f}_{s.lower()}" for f in ("avg", "max") for s in ("F", "O")) + " FROM orders GROUP BY 1")
def rs04_two_level_pivot(spark, d):
    g = table(spark, d, "orders").where("o_orderstatus IN ('F', 'O')").groupBy("o_orderpriority", F.lower("o_orderstatus").alias("s")).agg(F.avg("o_totalprice").alias("avg"), F.max("o_totalprice").alias("max"))
    long = g.unpivot(["o_orderpriority", "s"], ["avg", "max"], "metric", "v").withColumn("k", F.concat_ws("_", "metric", "s"))
    return long.groupBy("o_orderpriority").pivot("k", ["avg_f", "avg_o", "max_f", "max_o"]).agg(r6(F.first("v")))


@query("SELECT l_orderkey, " + ", ".join(f"max((l_returnflag = '{f}')::INT)::INT AS has_{f.lower()}" for f in "ARN") + " FROM lineitem GROUP BY 1")
def rs07_one_hot_of_lists(spark, d):
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("found"))
    return lists.select("l_orderkey", *(F.array_contains("found", f).cast("int").alias(f"has_{f.lower()}") for f in "ARN"))


@query("SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{s}')::INT AS is_{s.lower()}" for s in "FOP") + " FROM orders")
def rs08_one_hot_of_class(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *((F.col("o_orderstatus") == s).cast("int").alias(f"is_{s.lower()}") for s in "FOP"))
