"""Metrics of scored rows, summaries of result tables, splits and resamples, all as aggregations and windows.

A scored table has a row for each item and label: the columns of ``keys`` (label, fold, ...), ``y`` and ``score``.
Rows whose y is not 0 or 1 take no part. Ranks and curves are built from one row for each distinct score, so a window
never sees more rows than a group has different scores.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bound

RESERVED = ("label", "n_train", "fold", "seed", "bootstrap")
PANEL = ("f1", "accuracy", "balanced_accuracy", "tpr", "tnr", "ppv", "npv", "mcc")


def by_score(scored: DataFrame, keys: list[str], ranges: int = 64) -> DataFrame:
    """Positives and negatives at each distinct score, and those at or above it (tp, fp), with the totals."""
    clean = scored.where(F.col("y").isin(0, 1) & F.col("score").isNotNull())
    counts = clean.groupBy(*keys, "score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    # Scores are dealt by ranges and summed up inside each, after what the ranges above hold, so that no task sorts a
    # whole group; approximate bounds only change how even the ranges are.
    marks = sorted(set(scored.approxQuantile("score", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))))
    counts = counts.withColumn("__r", F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: m < F.col("score"))) if marks else F.lit(0))
    higher = Window.partitionBy(*keys).orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    parts = counts.groupBy(*keys, "__r").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    parts = parts.select(*keys, "__r", *(F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"__{c}") for c in "pq"), F.sum("p").over(whole).alias("n_pos"), F.sum("q").over(whole).alias("n_neg"))
    above = Window.partitionBy(*keys, "__r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counts.select(*keys, "__r", "score", "pos", "neg", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp")).join(parts, [*keys, "__r"])
    return summed.select(*keys, "score", "pos", "neg", (F.col("tp") + F.col("__p")).alias("tp"), (F.col("fp") + F.col("__q")).alias("fp"), "n_pos", "n_neg")


def ranking(scored: DataFrame, keys: list[str]) -> DataFrame:
    """auroc (ties count half) and auprc (step sum) of each group; null with fewer than two of either class."""
    curve = by_score(scored, keys).where("n_pos >= 2 AND n_neg >= 2")
    # A positive beats the negatives below its score and ties with those at it.
    wins = F.col("pos") * (F.col("n_neg") - F.col("fp") + F.col("neg") / 2.0)
    steps = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    found = curve.groupBy(*keys).agg((F.sum(wins) / F.first(F.col("n_pos") * F.col("n_neg"))).alias("auroc"), (F.sum(steps) / F.first("n_pos")).alias("auprc"))
    return scored.select(*keys).distinct().join(found, keys, "left")


def thresholds(scored: DataFrame, keys: list[str], strategy: str = "youden") -> DataFrame:
    """The threshold of each group: ``youden`` (the highest of equals), ``f1`` (the lowest of equals) or ``fixed:<x>``."""
    groups = scored.select(*keys).distinct()
    if strategy.startswith("fixed:"):
        return groups.withColumn("threshold", F.lit(float(strategy.split(":", 1)[1])))
    curve = by_score(scored, keys).where("n_pos >= 2 AND n_neg >= 2")
    if strategy == "youden":
        gain = F.struct((F.col("tp") * F.col("n_neg") - F.col("fp") * F.col("n_pos")).alias("j"), F.col("score").alias("tie"))
    elif strategy == "f1":
        p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("n_pos")
        gain = F.struct((2 * p * r / (p + r + 1e-12)).alias("j"), (-F.col("score")).alias("tie"))
    else:
        raise ValueError(f"unknown threshold strategy {strategy!r}")
    return groups.join(curve.groupBy(*keys).agg(F.max_by("score", gain).alias("threshold")), keys, "left")


def panel(scored: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """The metrics at a threshold for each group. ``cuts``: keys and threshold, a row for each group."""
    hit = F.col("score") >= F.col("threshold")
    counts = scored.where(F.col("y").isin(0, 1)).join(cuts, keys).groupBy(*keys, "threshold").agg(
        F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"),
        F.count_if(~hit & (F.col("y") == 1)).alias("fn"), F.count_if(~hit & (F.col("y") == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.when(a + b > 0, a / (a + b))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    known = (F.col("tp") + F.col("fn") >= 2) & (F.col("tn") + F.col("fp") >= 2) & F.col("threshold").isNotNull()
    values = {
        "f1": 2 * tp / (2 * tp + fp + fn), "accuracy": (tp + tn) / (tp + tn + fp + fn), "balanced_accuracy": (tp / (tp + fn) + tn / (tn + fp)) / 2,
        "tpr": share(tp, fn), "tnr": share(tn, fp), "ppv": share(tp, fp), "npv": share(tn, fn), "mcc": F.when(root > 0, (tp * tn - fp * fn) / root).otherwise(0.0),
    }
    return counts.select(*keys, "threshold", "tp", "fp", "fn", "tn", *(F.when(known, values[m]).alias(m) for m in PANEL))


def overlap_panel(counts: DataFrame) -> DataFrame:
    """dice, iou and rates from the counts tp, fp, fn, tn of a mask; what divides by nothing is null."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.when(b > 0, a / b)
    return counts.withColumns({"dice": share(2 * tp, 2 * tp + fp + fn), "iou": share(tp, tp + fp + fn), "pixel_acc": share(tp + tn, tp + tn + fp + fn), "tpr": share(tp, tp + fn), "tnr": share(tn, tn + fp), "ppv": share(tp, tp + fp), "npv": share(tn, tn + fn)})


def metric_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if c not in RESERVED and (kind in ("double", "float", "int", "bigint") or kind.startswith("decimal"))]


def with_macro(results: DataFrame, background: str | None = None) -> DataFrame:
    """Appends label ``macro_average``: the mean over the labels of each run; old macro rows and the background do not count."""
    runs = [c for c in ("fold", "seed", "bootstrap", "n_train") if c in results.columns]
    own = results.where(F.col("label") != "macro_average")
    if background is not None:
        own = own.where(F.col("label") != background)
    macro = own.groupBy(*runs).agg(*(F.avg(m).alias(m) for m in metric_columns(results))).withColumn("label", F.lit("macro_average"))
    return results.unionByName(macro, allowMissingColumns=True)


def summary(results: DataFrame) -> DataFrame:
    """Of each label (and n_train) and metric: mean and count of point rows; population deviation and the percentiles
    2.5 and 97.5 of the bootstrap rows or, without any, of the point rows. Fewer than two values have no spread."""
    keys = [c for c in ("label", "n_train") if c in results.columns]
    metrics = metric_columns(results)
    if "bootstrap" not in results.columns:
        results = results.withColumn("bootstrap", F.lit(-1))
    point = F.col("bootstrap") < 0
    drawn = F.max(F.when(~point, 1).otherwise(0)).over(Window.partitionBy(*keys)) == 1
    rows = results.withColumn("__spread", F.when(drawn, ~point).otherwise(point))
    out = []
    for m in metrics:
        spread = F.when(F.col("__spread"), F.col(m).cast("double"))
        enough = F.count(spread) >= 2
        q = F.percentile(spread, [0.025, 0.975])
        out += [F.avg(F.when(point, F.col(m))).alias(f"{m}_mean"), F.count(F.when(point, F.col(m))).alias(f"{m}_n"), F.when(enough, F.stddev_pop(spread)).alias(f"{m}_std"), F.when(enough, q[0]).alias(f"{m}_ci_lo"), F.when(enough, q[1]).alias(f"{m}_ci_hi")]
    return rows.groupBy(*keys).agg(*out)


def comparison(results: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    """Mean with a normal interval of 1.96 standard errors, by the sample deviation."""
    half = 1.96 * F.stddev_samp(metric) / F.sqrt(F.count(metric))
    return results.groupBy(*keys).agg(F.avg(metric).alias("mean"), (F.avg(metric) - half).alias("ci_lo"), (F.avg(metric) + half).alias("ci_hi"), F.count(metric).alias("n"))


def missing_runs(results: DataFrame) -> DataFrame:
    """Of each label and metric: the runs, and those without a value."""
    metrics = metric_columns(results)
    long = results.unpivot(["label"], metrics, "metric", "value")
    return long.groupBy("label", "metric").agg(F.count("*").alias("n_runs"), F.count_if(F.col("value").isNull()).alias("n_missing"))


def external_summary(results: DataFrame, metric: str) -> DataFrame:
    """Of each label: mean and sample deviation of the point rows (bootstrap -1), percentiles 2.5 and 97.5 of the
    others, and a macro row, the mean of each column without a deviation."""
    point, drawn = F.when(F.col("bootstrap") == -1, F.col(metric)), F.when(F.col("bootstrap") >= 0, F.col(metric))
    q = F.percentile(drawn, [0.025, 0.975])
    rows = results.groupBy("label").agg(F.avg(point).alias("mean"), F.stddev_samp(point).alias("std"), q[0].alias("ci_lo"), q[1].alias("ci_hi"))
    macro = rows.agg(F.lit("macro_average").alias("label"), F.avg("mean").alias("mean"), F.lit(None).cast("double").alias("std"), F.avg("ci_lo").alias("ci_lo"), F.avg("ci_hi").alias("ci_hi"))
    return rows.unionByName(macro)


def flip_probability(first: DataFrame, second: DataFrame, draw: list[str]) -> DataFrame:
    """Of each ordered pair of models: the share of draws in which the first beats the second in one setting and loses
    in the other. Both tables have ``model`` and ``score`` for each draw; only models of the same draw meet."""
    both = first.join(second.withColumnRenamed("score", "then"), [*draw, "model"]).select(*draw, F.struct("model", "score", "then").alias("m"))
    pairs = both.join(both.withColumnRenamed("m", "o"), draw).where("m.model <> o.model")
    flips = (F.col("m.score") > F.col("o.score")) & (F.col("m.then") < F.col("o.then"))
    return pairs.groupBy(F.col("m.model").alias("a"), F.col("o.model").alias("b")).agg(F.avg(flips.cast("double")).alias("p_flip"))


def ranks_by_draw(scores: DataFrame, draw: list[str], model: str = "model", score: str = "score") -> DataFrame:
    """The rank of each model in each draw, best first, ties by name."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*draw).orderBy(F.desc(score), model)))


def win_probability(ranked: DataFrame, draw: list[str]) -> DataFrame:
    """Of each ordered pair of models: the share of draws in which the first ranks before the second. A draw has a row
    for each model, so the self-join meets models, not draws."""
    a = ranked.select(*draw, F.col("model").alias("a"), F.col("rank").alias("ra"))
    b = ranked.select(*draw, F.col("model").alias("b"), F.col("rank").alias("rb"))
    return a.join(b, draw).where("a <> b").groupBy("a", "b").agg(F.avg((F.col("ra") < F.col("rb")).cast("double")).alias("p_win"))


# Splits and resamples: an order by md5 of id and seed, so that a split is the same wherever it is made.


def hash_key(column: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(column).cast("string"), F.lit(str(seed))))


def hash_unit(column: str, seed: int) -> Column:
    """A number in [0, 1) from the first 13 digits of the hash."""
    return F.conv(F.substring(hash_key(column, seed), 1, 13), 16, 10).cast("double") / float(16**13)


def _ranked(df: DataFrame, group: str, seed: int, buckets: int = 256) -> tuple[DataFrame, int]:
    """The groups with their place in hash order: ranked inside ranges of the hash, whose counts are summed, so that no
    task sorts them all."""
    groups = df.where(F.col(group).isNotNull()).select(group).distinct().withColumn("__h", hash_key(group, seed))
    groups = groups.withColumn("__b", F.conv(F.substring("__h", 1, 2), 16, 10).cast("int"))
    counts = {r["__b"]: r.n for r in groups.groupBy("__b").agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for b in range(buckets):
        starts.append(at)
        at += counts.get(b, 0)
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__h", group))
    return groups.select(group, (F.element_at(F.array(*map(F.lit, starts)), F.col("__b") + 1) + inside).cast("long").alias("place")), at


def require_groups(df: DataFrame, group: str) -> None:
    n = df.where(F.col(group).isNull()).count()
    if n:
        raise ValueError(f"{n} rows have no {group}")


def kfold(df: DataFrame, group: str, k: int, seed: int = 56) -> DataFrame:
    """Adds ``fold``: groups in hash order in k buckets, the first of which have one more if they are uneven."""
    require_groups(df, group)
    places, n = _ranked(df, group, seed)
    if not 2 <= k <= n:
        raise ValueError(f"k must be from 2 to the number of groups, {n}, not {k}")
    size, more = divmod(n, k)
    edge = more * (size + 1)
    at = F.col("place") - 1
    fold = F.when(at < edge, F.floor(at / (size + 1))).otherwise(more + F.floor((at - edge) / size)).cast("int")
    return df.join(places.select(group, fold.alias("fold")), group)


def train_val(df: DataFrame, group: str, n_splits: int = 5, seed: int = 56) -> DataFrame:
    """Adds ``split``: one n-th of the groups, at least one, is val and the others train."""
    require_groups(df, group)
    places, n = _ranked(df, group, seed)
    held = max(1, round(n / n_splits))
    if held >= n:
        raise ValueError(f"{n} groups do not make two sides")
    return df.join(places.select(group, F.when(F.col("place") <= held, "val").otherwise("train").alias("split")), group)


def balanced_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Adds ``fold``: groups by falling size (ties by hash), dealt to and fro over the folds, so that folds hold like
    numbers of rows. A place is the groups of larger sizes, those of lower hash ranges of the size, and a number inside
    the range: a task sorts neither all groups nor all of one size."""
    sizes = df.groupBy(group).agg(F.count("*").alias("__n")).withColumn("__h", F.md5(F.col(group).cast("string")))
    sizes = sizes.withColumn("__b", F.substring("__h", 1, 2))
    ranges = sizes.groupBy("__n", "__b").agg(F.count("*").alias("__c"))
    lower = F.coalesce(F.sum("__c").over(Window.partitionBy("__n").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = ranges.groupBy("__n").agg(F.sum("__c").alias("__c"))
    larger = F.coalesce(F.sum("__c").over(Window.orderBy(F.desc("__n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("__n", "__b", lower.alias("__lower")).join(totals.select("__n", larger.alias("__larger")), "__n")
    inside = F.row_number().over(Window.partitionBy("__n", "__b").orderBy("__h", group)) - 1
    turn = (F.col("__larger") + F.col("__lower") + F.col("__i")) % (2 * k)
    dealt = sizes.withColumn("__i", inside).join(starts, ["__n", "__b"]).select(group, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"))
    return df.join(dealt, group)


def carve_val(df: DataFrame, group: str, fraction: float = 0.1, seed: int = 56) -> DataFrame:
    """Adds ``part``: val for about a fraction of the groups, rounded up, else fit. A fraction of 0 or a single group has no val."""
    require_groups(df, group)
    places, n = _ranked(df, group, seed)
    held = min(n - 1, -int(-n * fraction // 1)) if fraction > 0 and n > 1 else 0
    return df.join(places.select(group, F.when(F.col("place") <= held, "val").otherwise("fit").alias("part")), group)


def training_sizes(df: DataFrame, key: str, sizes: list[int], seed: int = 56) -> DataFrame:
    """The rows once for each size, as ``n_train``: the first of them in hash order, so that smaller sets are in larger
    ones. A negative size, or one above the number of rows, has them all."""
    places, n = _ranked(df, key, seed)
    wanted = F.filter(F.array(*map(F.lit, sizes)), lambda s: (s < 0) | (F.col("place") <= s))
    return df.join(places.select(key, F.explode(wanted).alias("n_train")), key)


def grid(spark, seeds: list[int], sizes: list[int], draws: int) -> DataFrame:
    """A row for each run: seed, n_train and bootstrap, of which -1 is the point run."""
    runs = spark.range(len(seeds) * len(sizes) * (draws + 1))
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), n.cast("int") + 1)
    each = F.floor(F.col("id") / (draws + 1))
    return runs.select(at(seeds, F.floor(each / len(sizes))).alias("seed"), at(sizes, each % len(sizes)).alias("n_train"), (F.col("id") % (draws + 1) - 1).cast("int").alias("bootstrap"))


def bootstrap(df: DataFrame, group: str, draws: int, seed: int = 0, point: bool = False) -> DataFrame:
    """Adds ``bootstrap``: as many groups as there are, drawn with replacement for each draw, with all rows of each; with
    ``point`` also every group once, as draw -1."""
    places, n = _ranked(df, group, seed)
    slots = df.sparkSession.range(draws * n).select((F.col("id") % draws).cast("int").alias("bootstrap"), F.col("id").alias("__slot"))
    text = F.concat_ws(":", F.col("bootstrap"), F.floor(F.col("__slot") / draws), F.lit(str(seed)))
    drawn = slots.select("bootstrap", (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") % n + 1).alias("place"))
    chosen = drawn.join(places, "place").select(group, "bootstrap")
    if point:
        chosen = chosen.unionByName(places.select(group, F.lit(-1).alias("bootstrap")))
    return df.join(chosen, group)


def stratified(df: DataFrame, stratum: str, per_stratum: int, key: str, seed: int = 0) -> DataFrame:
    """Up to ``per_stratum`` rows of each stratum in hash order, with ``weight``: the stratum's rows for each row kept."""
    rows = df.withColumn("__h", hash_key(key, seed))
    picked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy("__h", key))).where(F.col("__r") <= per_stratum)
    sizes = df.groupBy(stratum).agg(F.count("*").alias("__size"))
    return picked.join(sizes, stratum).withColumn("weight", F.col("__size") / F.least(F.col("__size"), F.lit(per_stratum))).drop("__h", "__r", "__size")


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows, those whose hash is lowest."""
    return df.withColumn("__h", hash_key(key, seed)).orderBy("__h", key).limit(n).drop("__h")


# Probes on stored embeddings.


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    norm = lambda p: F.sqrt(dot(p["v"], p["v"]))
    divided = lambda p: F.transform(p["v"], lambda x: x.cast("double") / F.when(p["norm"] > 0, p["norm"]).otherwise(1.0))
    return bound(lambda p: bound(divided, v=p["v"], norm=norm(p)), v=v)


def centroids(df: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """The mean of unit vectors of each group, made a unit vector: partial sums by position before the shuffle."""
    rows = df.select(*keys, F.posexplode(unit(F.col(vector))).alias("pos", "v"))
    means = rows.groupBy(*keys, "pos").agg(F.avg("v").alias("v"))
    lists = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("c"))
    return lists.select(*keys, unit(F.transform("c", lambda x: x["v"])).alias("centroid"))


def prototype_scores(train: DataFrame, test: DataFrame, vector: str, key: str, labels: Iterable[str]) -> DataFrame:
    """(key, label, score): cosine with the centroid of the positives less that with the negatives'.

    Two vectors for each label are what is broadcast.
    """
    labels = list(labels)
    long = train.select(vector, F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("int").alias("y")) for c in labels))).alias("l")).select(vector, "l.*").where("y IN (0, 1)")
    sides = centroids(long, vector, ["label", "y"]).groupBy("label").agg(F.max_by("centroid", "y").alias("p"), F.min_by("centroid", "y").alias("q"), F.count("*").alias("n")).where("n = 2")
    rows = test.select(key, unit(F.col(vector)).alias("v"), F.explode(F.array(*map(F.lit, labels))).alias("label"))
    return rows.join(F.broadcast(sides), "label").select(key, "label", (dot(F.col("v"), F.col("p")) - dot(F.col("v"), F.col("q"))).alias("score"))
