"""Probes of frozen features: nearest neighbours, logistic regression, a linear machine, text prototypes.

Every probe takes features as ``array<float|double>`` and gives (key, label, score); a label counts where it is 0 or 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import dot, unit

#: Queries whose scores are held at once.
QUERIES = 512
#: Values of a block of sums, and groups in which blocks are added up first.
BLOCK, SALTS = 8192, 64
SUMS = "label string, block int, salt int, sums array<double>"


def long_labels(df: DataFrame, vector: str, labels: list[str]) -> DataFrame:
    """A row for each usable label of a row: label, y and the vector."""
    pairs = F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("int").alias("y")) for c in labels))
    return df.select(vector, F.explode(pairs).alias("l")).select(vector, "l.*").where("y IN (0, 1)")


def knn_scores(train: DataFrame, test: DataFrame, vector: str, key: str, labels: list[str], k: int = 20, block_rows: int = 4096, slices: int = 32) -> DataFrame:
    """The mean label of the k nearest labelled rows by cosine, ties to the smaller key. Exact.

    Queries and rows are packed into blocks; each block of queries meets each slice of rows once, as a product of two
    matrices, and only the k best of a slice go on to be merged. Labels are searched among the rows that have them.
    """
    pairs = F.map_from_arrays(F.array(*map(F.lit, labels)), F.array(*(F.when(F.col(c).isin(0, 1), F.col(c).cast("int")) for c in labels)))
    rows = train.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), pairs.alias("y"))
    # A slice stays of one size however large the table is.
    groups, slices = max(1, -(-test.count() // block_rows)), max(slices, -(-train.count() // (2 * block_rows)))
    queries = test.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("grp"))
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(slices)).cast("int"))
    left = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = sliced.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def tile(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            norm = lambda m: m / np.where((s := np.linalg.norm(m, axis=1, keepdims=True)) > 0, s, 1.0)
            a, b, ids, keys = norm(np.stack(q.v)), norm(np.stack(c.v)), c.id.to_numpy(), q.id.tolist()
            truth = np.array([[(m if isinstance(m, dict) else dict(m)).get(x) for x in labels] for m in c.y], float)
            # Labels of the same rows are searched together.
            alike: dict[bytes, list[int]] = {}
            for j in range(len(labels)):
                alike.setdefault(np.isnan(truth[:, j]).tobytes(), []).append(j)
            for own in alike.values():
                use = np.flatnonzero(~np.isnan(truth[:, own[0]]))
                if not len(use):
                    continue
                names, y, numbers, rows = [labels[j] for j in own], truth[use][:, own], ids[use], b[use].T
                for i in range(0, len(a), QUERIES):
                    near = a[i : i + QUERIES] @ rows
                    near[np.isnan(near)] = -np.inf
                    # What is not below the k-th best of a row is few, so only that is put in order.
                    least = np.partition(near, len(use) - k, axis=1)[:, len(use) - k] if len(use) > k else np.full(len(near), -np.inf)
                    at, place = np.nonzero(near >= least[:, None])
                    found = near[at, place]
                    order = np.lexsort((numbers[place], -found, at))
                    at, place, found = at[order], place[order], found[order]
                    begin = np.searchsorted(at, np.arange(len(near)))
                    for row, n in enumerate(begin.tolist()):
                        best = place[n : min(n + k, len(at))] if row + 1 == len(begin) else place[n : min(n + k, begin[row + 1])]
                        out.append((keys[i + row], names, found[n : n + len(best)].tolist(), numbers[best].tolist(), y[best].tolist()))
        return pd.DataFrame(out, columns=["id", "labels", "s", "ids", "y"])

    found = left.groupBy("grp", "slice").cogroup(right.groupBy("grp", "slice")).applyInPandas(tile, "id long, labels array<string>, s array<double>, ids array<long>, y array<array<double>>")
    nearest = lambda n: F.slice(F.sort_array(n), 1, k)
    order = F.transform(F.arrays_zip("s", "ids", "y"), lambda x: F.struct((-x["s"]).alias("d"), x["ids"].alias("id"), x["y"].alias("y")))
    near = found.select("id", "labels", order.alias("n")).groupBy("id", "labels").agg(nearest(F.flatten(F.collect_list("n"))).alias("n"))
    # Where slices differ in which labels have the same rows, a label's rows come from several groups.
    each = near.select("id", "n", F.posexplode("labels").alias("j", "label"))
    each = each.select("id", "label", F.transform("n", lambda x: F.struct(x["d"].alias("d"), x["id"].alias("id"), F.get(x["y"], F.col("j")).alias("y"))).alias("n"))
    best = each.groupBy("id", "label").agg(nearest(F.flatten(F.collect_list("n"))).alias("best"))
    return best.select(F.col("id").alias(key), "label", (F.aggregate("best", F.lit(0.0), lambda s, x: s + x["y"]) / F.size("best")).alias("score"))


def _added(table: pa.Table) -> pa.Table:
    """One row for the rows of a block: the sums of its places."""
    return table.slice(0, 1).set_column(3, "sums", pa.array([np.sum(np.stack(table.column("sums").to_numpy()), axis=0)], pa.list_(pa.float64())))


def fit_linear(train: DataFrame, vector: str, labels: list[str], kind: str = "logistic", c: float = 1.0, most_rounds: int = 100) -> dict[str, np.ndarray]:
    """Weights and intercept of each label, with balanced classes; a label with one class only has none.

    Each round is one pass over the rows: partitions send sums of gradients and of one half of the symmetric second
    derivatives, in blocks, never rows. ``logistic`` is fitted by Newton's method, ``squared_hinge`` likewise with the
    active rows.
    """
    long = long_labels(train.select(unit(F.col(vector)).alias("v"), *labels), "v", labels).persist()
    counts = {(r.label, r.y): r.n for r in long.groupBy("label", "y").agg(F.count("*").alias("n")).collect()}
    usable = [x for x in labels if counts.get((x, 0)) and counts.get((x, 1))]
    if not usable:
        long.unpersist()
        return {}
    dim = len(long.first().v)
    upper = np.triu_indices(dim + 1)
    weights = {x: np.zeros(dim + 1) for x in usable}
    share = {(x, y): sum(counts[x, z] for z in (0, 1)) / (2 * counts[x, y]) for x in usable for y in (0, 1)}
    left = list(usable)
    for _ in range(most_rounds):
        now = long.sparkSession.sparkContext.broadcast({x: weights[x] for x in left})

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total: dict[str, list[np.ndarray]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.column_stack([np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1), np.ones(batch.num_rows)])
                y, label = np.asarray(batch.column("y")), np.asarray(batch.column("label").to_pylist())
                for name, w in now.value.items():
                    own = label == name
                    if not own.any():
                        continue
                    a, t = x[own], y[own]
                    weight = np.where(t == 1, share[name, 1], share[name, 0])
                    z = a @ w
                    if kind == "logistic":
                        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
                        g, h = weight * (p - t), weight * p * (1 - p)
                    else:
                        sign = 2.0 * t - 1
                        active = sign * z < 1
                        g, h = weight * active * 2 * (z - sign), weight * active * 2.0
                    part = [a.T @ g, (a.T * h) @ a]
                    total[name] = part if name not in total else [u + v for u, v in zip(total[name], part, strict=True)]
            salt = TaskContext.get().partitionId() % SALTS
            for name, (g, h) in total.items():
                flat = np.concatenate([g, h[upper]])
                blocks = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
                columns = pa.array([name] * len(blocks)), pa.array(range(len(blocks)), pa.int32()), pa.array([salt] * len(blocks), pa.int32()), pa.array(blocks, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(list(columns), ["label", "block", "salt", "sums"])

        # Blocks are added up first within a salt, then over all: no group holds a row of each partition.
        parts = long.mapInArrow(sums, SUMS).groupBy("label", "block", "salt").applyInArrow(_added, SUMS).groupBy("label", "block").applyInArrow(_added, SUMS).collect()
        got: dict[str, dict[int, list[float]]] = {}
        for r in parts:
            got.setdefault(r.label, {})[r.block] = r.sums
        penalty = np.diag([*[1.0] * dim, 1e-8 if kind == "logistic" else 1.0])
        left = []
        for label, blocks in got.items():
            s = np.concatenate([blocks[i] for i in range(len(blocks))])
            g, h = s[: dim + 1], np.zeros((dim + 1, dim + 1))
            h[upper] = s[dim + 1 :]
            h = h + np.triu(h, 1).T
            w = weights[label]
            step = np.linalg.solve(c * h + penalty + 1e-12 * np.eye(dim + 1), c * g + penalty @ w)
            weights[label] = w - step
            if np.abs(step).max() > 1e-8:
                left.append(label)
        if not left:
            break
    long.unpersist()
    return weights


def linear_scores(test: DataFrame, vector: str, key: str, weights: dict[str, np.ndarray]) -> DataFrame:
    """The decision value of each row and label, in expressions only: the weights are literals."""
    v = unit(F.col(vector))
    score = {x: dot(F.col("v"), F.array(*map(F.lit, map(float, w[:-1])))) + F.lit(float(w[-1])) for x, w in weights.items()}
    rows = test.select(key, v.alias("v")).select(key, F.explode(F.array(*(F.struct(F.lit(x).alias("label"), s.alias("score")) for x, s in score.items()))).alias("l"))
    return rows.select(key, "l.*")


def zero_shot_scores(test: DataFrame, prompts: DataFrame, vector: str, key: str) -> DataFrame:
    """Cosine with the mean of a label's positive prompts, less that with its negative ones' if it has any.

    ``prompts``: label, y (1 or 0) and the vector of each; labels are few, and two vectors of each are broadcast.
    """
    from .evaluation import centroids

    sides = centroids(prompts, vector, ["label", "y"]).groupBy("label").agg(F.max(F.when(F.col("y") == 1, F.col("centroid"))).alias("p"), F.max(F.when(F.col("y") == 0, F.col("centroid"))).alias("q"))
    labels = [r.label for r in prompts.select("label").distinct().orderBy("label").collect()]
    rows = test.select(key, unit(F.col(vector)).alias("v"), F.explode(F.array(*map(F.lit, labels))).alias("label"))
    joined = rows.join(F.broadcast(sides.where("p IS NOT NULL")), "label")
    return joined.select(key, "label", (dot(F.col("v"), F.col("p")) - F.coalesce(dot(F.col("v"), F.col("q")), F.lit(0.0))).alias("score"))
