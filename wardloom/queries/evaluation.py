"""Metrics, summaries, splits and probes over the embeddings; streams over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..streaming import events as V
from .base import query, r6, table

LABELS = range(10)


def scored(spark, d, fold: bool = False):
    """A row for each vector and class: y, whether the class is its label, and a score from its first values."""
    e = table(spark, d, "embeddings")
    score = F.round(F.get("embedding", F.lit(0)).cast("double") + F.get("embedding", F.lit(1)).cast("double") * (F.col("c") + 1), 2)
    rows = e.select("vec_id", "label", "embedding", F.explode(F.array(*map(F.lit, LABELS))).alias("c"))
    y = (F.col("label") == F.col("c")).cast("int")
    return rows.select("vec_id", F.col("c").cast("string").alias("label"), y.alias("y"), score.alias("score"), *([(F.col("vec_id") % 3).cast("int").alias("fold")] if fold else []))


_SCORED = "(SELECT vec_id, c::VARCHAR AS label, (e.label = c)::INT AS y, round(embedding[1]::DOUBLE + embedding[2]::DOUBLE * (c + 1), 2) AS score, (vec_id % 3)::INT AS fold FROM embeddings e, (SELECT unnest(range(10)) AS c))"
_CURVE = f"""(SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY label) AS n_pos, sum(neg) OVER (PARTITION BY label) AS n_neg
  FROM (SELECT label, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {_SCORED} GROUP BY ALL) WINDOW w AS (PARTITION BY label ORDER BY score DESC))"""


@query(f"""SELECT label, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM (SELECT label, ((sum(CASE WHEN y = 1 THEN r END) - n1 * (n1 + 1) / 2.0) / (n1 * n0))::DOUBLE AS auroc FROM (
  SELECT label, y, rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0 AS r, sum(y) OVER (PARTITION BY label) AS n1, sum(1 - y) OVER (PARTITION BY label) AS n0 FROM {_SCORED}) GROUP BY label, n1, n0)
  JOIN (SELECT label, sum(pos / n_pos * tp / (tp + fp))::DOUBLE AS auprc FROM {_CURVE} GROUP BY label) USING (label)""")
def ag17_auroc_and_auprc(spark, d):
    return E.ranking(scored(spark, d), ["label"]).select("label", r6("auroc").alias("auroc"), r6("auprc").alias("auprc"))


@query(f"SELECT label, arg_max(score, tp / n_pos - fp / n_neg + score * 1e-9)::DOUBLE AS threshold FROM {_CURVE} GROUP BY label")
def ag19_youden_thresholds(spark, d):
    return E.thresholds(scored(spark, d), ["label"])


@query(f"SELECT label, arg_max(score, 2 * (tp / (tp + fp)) * (tp / n_pos) / ((tp / (tp + fp)) + (tp / n_pos) + 1e-12) - score * 1e-9)::DOUBLE AS threshold FROM {_CURVE} GROUP BY label")
def ag19_f1_thresholds(spark, d):
    return E.thresholds(scored(spark, d), ["label"], "f1")


@query(f"""SELECT label, 0.1::DOUBLE AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy,
  round((tp / (tp + fn) + tn / (tn + fp)) / 2::DOUBLE, 6) AS balanced_accuracy, round(tp / (tp + fn)::DOUBLE, 6) AS tpr, round(tn / (tn + fp)::DOUBLE, 6) AS tnr, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS ppv, round(tn / nullif(tn + fn, 0)::DOUBLE, 6) AS npv,
  round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc
  FROM (SELECT label, count(*) FILTER (y = 1 AND score >= 0.1) AS tp, count(*) FILTER (y = 0 AND score >= 0.1) AS fp, count(*) FILTER (y = 1 AND score < 0.1) AS fn, count(*) FILTER (y = 0 AND score < 0.1) AS tn FROM {_SCORED} GROUP BY label)""")
def ag16_metric_panel(spark, d):
    rows = scored(spark, d)
    found = E.panel(rows, E.thresholds(rows, ["label"], "fixed:0.1"), ["label"])
    return found.select("label", "threshold", "tp", "fp", "fn", "tn", *(r6(m).alias(m) for m in E.PANEL))


def results(spark, d):
    """A table of runs: a point row and six bootstrap rows for each fold and label."""
    rows = scored(spark, d, fold=True).groupBy("label", "fold", (F.col("vec_id") % 7 - 1).cast("int").alias("bootstrap"))
    return rows.agg(F.avg("score").alias("auroc"), F.max(F.when(F.col("y") == 1, F.col("score"))).alias("f1"))


_RESULTS = f"(SELECT label, fold, (vec_id % 7 - 1)::INT AS bootstrap, avg(score) AS auroc, max(CASE WHEN y = 1 THEN score END) AS f1 FROM {_SCORED} GROUP BY ALL)"


@query(f"SELECT label, fold, bootstrap, round(auroc, 6) AS auroc, round(f1, 6) AS f1 FROM (SELECT * FROM {_RESULTS} UNION ALL SELECT 'macro_average', fold, bootstrap, avg(auroc), avg(f1) FROM {_RESULTS} GROUP BY fold, bootstrap)")
def ag14_macro_average(spark, d):
    return E.with_macro(results(spark, d)).select("label", "fold", "bootstrap", r6("auroc").alias("auroc"), r6("f1").alias("f1"))


def _summary_sql(m: str) -> str:
    s = f"CASE WHEN bootstrap >= 0 THEN {m} END"
    big = f"count({s}) >= 2"
    return f"round(avg(CASE WHEN bootstrap < 0 THEN {m} END), 6) AS {m}_mean, count(CASE WHEN bootstrap < 0 THEN {m} END)::BIGINT AS {m}_n, CASE WHEN {big} THEN round(stddev_pop({s}), 6) END AS {m}_std, CASE WHEN {big} THEN round(quantile_cont({s}, 0.025), 6) END AS {m}_ci_lo, CASE WHEN {big} THEN round(quantile_cont({s}, 0.975), 6) END AS {m}_ci_hi"


@query(f"SELECT label, {_summary_sql('auroc')}, {_summary_sql('f1')} FROM {_RESULTS} GROUP BY label")
def ag12_summary(spark, d):
    s = E.summary(results(spark, d))
    return s.select("label", *((r6(c) if not c.endswith("_n") else F.col(c)).alias(c) for c in s.columns[1:]))


@query(f"SELECT label, round(avg(auroc), 6) AS mean, round(avg(auroc) - 1.96 * stddev_samp(auroc) / sqrt(count(auroc)), 6) AS ci_lo, round(avg(auroc) + 1.96 * stddev_samp(auroc) / sqrt(count(auroc)), 6) AS ci_hi, count(auroc)::BIGINT AS n FROM {_RESULTS} GROUP BY label")
def ag32_model_comparison(spark, d):
    return E.comparison(results(spark, d), "auroc", ["label"]).select("label", *(r6(c).alias(c) for c in ("mean", "ci_lo", "ci_hi")), "n")


_RANKED = f"(SELECT label AS model, bootstrap, row_number() OVER (PARTITION BY bootstrap ORDER BY round(s, 6) DESC, label) AS rank FROM (SELECT label, bootstrap, avg(auroc) AS s FROM {_RESULTS} WHERE bootstrap >= 0 GROUP BY ALL))"


def ranked(spark, d):
    rows = results(spark, d).where("bootstrap >= 0").groupBy(F.col("label").alias("model"), "bootstrap").agg(r6(F.avg("auroc")).alias("score"))
    return E.ranks_by_draw(rows, ["bootstrap"])


@query(f"SELECT a.model AS a, b.model AS b, round(avg((a.rank < b.rank)::INT), 6)::DOUBLE AS p_win FROM {_RANKED} a JOIN {_RANKED} b ON a.bootstrap = b.bootstrap AND a.model <> b.model GROUP BY ALL")
def ag36_win_probability(spark, d):
    return E.win_probability(ranked(spark, d), ["bootstrap"]).select("a", "b", r6("p_win").alias("p_win"))


@query(f"SELECT model, round(avg(rank), 6)::DOUBLE AS mean, median(rank)::DOUBLE AS median, round(quantile_cont(rank, 0.025), 6)::DOUBLE AS lo, round(quantile_cont(rank, 0.975), 6)::DOUBLE AS hi FROM {_RANKED} GROUP BY model")
def ag38_rank_summary(spark, d):
    return ranked(spark, d).groupBy("model").agg(r6(F.avg("rank")).alias("mean"), F.median("rank").alias("median"), r6(F.percentile("rank", 0.025)).alias("lo"), r6(F.percentile("rank", 0.975)).alias("hi"))


@query("SELECT doc_id, round(dice, 6) AS dice, round(iou, 6) AS iou FROM (SELECT doc_id, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS dice, tp / nullif(tp + fp + fn, 0)::DOUBLE AS iou FROM (SELECT doc_id, (quality = 1 AND toxic = 1)::INT AS tp, (quality = 0 AND toxic = 1)::INT AS fp, (quality = 1 AND toxic = 0)::INT AS fn FROM labels))")
def ag20_overlap_panel(spark, d):
    one = lambda q, t: ((F.col("quality") == q) & (F.col("toxic") == t)).cast("int")
    counts = table(spark, d, "labels").select("doc_id", one(1, 1).alias("tp"), one(0, 1).alias("fp"), one(1, 0).alias("fn"), one(0, 0).alias("tn"))
    return E.overlap_panel(counts).select("doc_id", r6("dice").alias("dice"), r6("iou").alias("iou"))


@query("SELECT o_orderkey, fold::INT AS fold FROM orders JOIN (SELECT o_custkey, ntile(5) OVER (ORDER BY md5(o_custkey || ':56'), o_custkey) - 1 AS fold FROM (SELECT DISTINCT o_custkey FROM orders)) USING (o_custkey)")
def sp02_group_kfold(spark, d):
    return E.kfold(table(spark, d, "orders", "o_orderkey", "o_custkey"), "o_custkey", 5).select("o_orderkey", "fold")


@query("SELECT o_orderkey, CASE WHEN r <= round(n / 5.0) THEN 'val' ELSE 'train' END AS split FROM orders JOIN (SELECT o_custkey, row_number() OVER (ORDER BY md5(o_custkey || ':56'), o_custkey) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)) USING (o_custkey)")
def sp01_train_val(spark, d):
    return E.train_val(table(spark, d, "orders", "o_orderkey", "o_custkey"), "o_custkey", 5).select("o_orderkey", "split")


@query("""WITH g AS (SELECT c_nationkey, row_number() OVER (ORDER BY md5(c_nationkey || ':0'), c_nationkey) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT c_nationkey FROM customer)),
s AS (SELECT b, ('0x' || substr(md5(b || ':' || i || ':0'), 1, 13))::BIGINT % n + 1 AS place FROM (SELECT unnest(range(20)) AS b), (SELECT unnest(range(25)) AS i), (SELECT max(n) AS n FROM g) WHERE i < n)
SELECT b::INT AS bootstrap, count(*)::BIGINT AS n_rows, sum(c_custkey)::BIGINT AS keys FROM s JOIN g USING (place) JOIN customer USING (c_nationkey) GROUP BY b""")
def sp05_group_bootstrap(spark, d):
    return E.bootstrap(table(spark, d, "customer", "c_custkey", "c_nationkey"), "c_nationkey", 20).groupBy("bootstrap").agg(F.count("*").alias("n_rows"), F.sum("c_custkey").alias("keys"))


@query("""SELECT o_orderkey, o_custkey, (CASE WHEN t < 5 THEN t ELSE 9 - t END)::INT AS fold FROM orders JOIN (
  SELECT o_custkey, (row_number() OVER (ORDER BY count(*) DESC, md5(o_custkey::VARCHAR), o_custkey) - 1) % 10 AS t FROM orders GROUP BY 1) USING (o_custkey)""")
def sp03_balanced_folds(spark, d):
    return E.balanced_folds(table(spark, d, "orders", "o_orderkey", "o_custkey"), "o_custkey", 5)


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / CASE WHEN n > 0 THEN n ELSE 1 END)"


@query(f"""WITH v AS (SELECT vec_id, label, {_UNIT} AS u FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)),
t AS (SELECT c, (label = c)::INT AS y, u FROM v, (SELECT unnest(range(10)) AS c) WHERE vec_id % 5 <> 0),
m AS (SELECT c, y, list(a ORDER BY i) AS embedding FROM (SELECT c, y, i, avg(x) AS a FROM (SELECT c, y, unnest(u) AS x, unnest(range(64)) AS i FROM t) GROUP BY ALL) GROUP BY ALL),
p AS (SELECT c, y, {_UNIT} AS u FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS n FROM m))
SELECT vec_id, c::VARCHAR AS label, round(list_dot_product(v.u, a.u) - list_dot_product(v.u, b.u), 6) AS score FROM v JOIN p a ON a.y = 1 JOIN p b USING (c) WHERE b.y = 0 AND vec_id % 5 = 0""")
def ev06_prototype_probe(spark, d):
    e = table(spark, d, "embeddings")
    labels = [str(c) for c in LABELS]
    rows = e.select("vec_id", "embedding", *((F.col("label") == c).cast("int").alias(str(c)) for c in LABELS))
    test = F.col("vec_id") % 5 == 0
    return E.prototype_scores(rows.where(~test), rows.where(test), "embedding", "vec_id", labels).withColumn("score", r6("score"))


@query("SELECT window_start AS start, event_type, count(*)::BIGINT AS n FROM (SELECT date_trunc('hour', ts) AS window_start, event_type FROM events) GROUP BY ALL")
def st_windowed_counts(spark, d):
    return V.windowed_counts(table(spark, d, "events"), "ts", ["event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT user_id, count(*)::BIGINT AS sessions, max(n)::BIGINT AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, (ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL)::INT AS new FROM events)) GROUP BY ALL) GROUP BY user_id""")
def st_sessions(spark, d):
    return V.sessions(table(spark, d, "events"), "ts", "user_id", "6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
