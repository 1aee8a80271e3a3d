"""Exact nearest neighbours by inner product, as a block matrix join with int8 tiles.

Candidates are dealt into slices and queries into groups, packed into blocks; each query block meets each slice once.
Slices stream past a held block of queries, some thousand vectors at a time: a tile is the product of the int8 codes of
both sides, an approximate score with a bound on its quantisation error. A pair whose upper bound is under the k-th best
lower bound of its query, or under the k-th best score found so far, cannot be among the nearest and is dropped; the
surviving pairs are computed again in double precision on the original vectors. The lists of the slices, sorted by
score, are merged by a heap for each query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Block:
    """Vectors of one length: ids, the originals, and int8 codes with a scale each, norms, and norms of what the codes miss.

    All but the originals are of the vectors divided by a power of two, ``2 ** power``, so that no finite vector is too
    large or too small for its norm.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.power = np.frexp(np.abs(vectors).max(axis=1).astype(np.float64))[1] if len(ids) else np.zeros(0, np.int32)
        self.unit = np.ldexp(vectors.astype(np.float64), -self.power[:, None])
        self.scale = np.abs(self.unit).max(axis=1, keepdims=True) / 127
        with np.errstate(divide="ignore", invalid="ignore"):
            self.codes = np.where(self.scale > 0, np.rint(self.unit / self.scale), 0).astype(np.int8)
        self.norm = np.sqrt((self.unit**2).sum(axis=1, keepdims=True))
        self.missed = np.sqrt(((self.unit - self.codes * self.scale) ** 2).sum(axis=1, keepdims=True))

    def pack(self) -> bytes:
        return np.array(self.vectors.shape, np.int64).tobytes() + self.vectors.dtype.str[1:].encode() + self.ids.tobytes() + self.vectors.tobytes()

    @staticmethod
    def parts(data: bytes, rows: int) -> Iterator[tuple[int, Block]]:
        """A packed block, some rows at a time: the number of the first, and these."""
        n, d = np.frombuffer(data, np.int64, 2).tolist()
        kind = np.dtype(data[16:18].decode())
        vectors = np.frombuffer(data, kind, n * d, 18 + 8 * n).reshape(n, d)
        for a in range(0, n, rows):
            yield a, Block(np.frombuffer(data, np.int64, min(rows, n - a), 18 + 8 * a), vectors[a : a + rows])


def _raised(x: np.ndarray, q: Block, c: Block) -> np.ndarray:
    """Products of scaled vectors (a row for each query) as those of the originals; beyond the range of doubles, infinite."""
    if max(np.abs(q.power).max(), np.abs(c.power).max()) < 500:
        return x * np.exp2(q.power)[:, None] * np.exp2(c.power)
    return np.ldexp(x, q.power[:, None] + c.power)


class Nearest:
    """The k best candidates seen of each query of a block, best first; ties to the smaller id."""

    def __init__(self, q: Block, k: int):
        self.q, self.k, self.n = q, k, np.zeros(len(q.ids), np.int64)
        self.ids, self.scores = np.zeros((len(q.ids), k), np.int64), np.full((len(q.ids), k), -np.inf)

    def see(self, c: Block) -> None:
        q, k = self.q, self.k
        # Sums of int8 products are whole numbers that single precision holds exactly up to 1040 dimensions.
        kind = np.float32 if q.codes.shape[1] <= 1040 else np.float64
        score = (q.codes.astype(kind) @ c.codes.T.astype(kind)).astype(np.float64) * q.scale * c.scale.T
        bound = (q.norm * c.missed.T + q.missed * (c.norm + c.missed).T) * (1 + 1e-9) + 1e-12 * q.norm * c.norm.T
        own = q.ids[:, None] == c.ids[None, :]
        low = np.where(own, -np.inf, _raised(score - bound, q, c))
        floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        floor = np.maximum(floor, np.where(self.n == k, self.scores[:, -1], -np.inf))
        i, j = np.nonzero((_raised(score + bound, q, c) >= floor[:, None]) & ~own)
        exact = np.zeros(len(i))
        for d in range(q.unit.shape[1]):
            exact += q.unit[i, d] * c.unit[j, d]
        with np.errstate(over="ignore"):
            exact = np.ldexp(exact, q.power[i] + c.power[j])
        seen = np.arange(k)[None, :] < self.n[:, None]
        old = np.nonzero(seen)[0]
        i, ids, exact = np.concatenate([old, i]), np.concatenate([self.ids[seen], c.ids[j]]), np.concatenate([self.scores[seen], exact])
        order = np.lexsort((ids, -exact, i))
        i, ids, exact = i[order], ids[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        first = place < k
        self.ids[i[first], place[first]], self.scores[i[first], place[first]] = ids[first], exact[first]
        self.n = np.minimum(np.bincount(i, minlength=len(self.n)), k)


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, query_rows: int = 1 << 16, slice_rows: int = 1 << 16, block_bytes: int = 16 << 20, tile_rows: int = 2048, least_slices: int = 48) -> DataFrame:
    """The k nearest vectors by inner product of each query: query_id, rank (from 1), vec_id, score (double).

    ``vectors`` needs vec_id and embedding; other columns, whatever their names, are ignored. ``is_query`` chooses the
    queries among its rows, which are searched against all rows but those with the query's own vec_id. Each row that is
    a query has a list of its own, so a query that stands twice gives its list twice; each row is a candidate, so one
    that stands twice is found twice. Fewer than k candidates give all of them. Ties go to the smaller vec_id. Vectors
    that are null, zero, or hold null or non-finite components, and rows with a null vec_id, take no part. Vectors are
    compared with those of their own length only. Exact: the int8 codes only rule pairs out. A score beyond the range of
    doubles is infinite. A block of queries holds ``query_rows`` vectors, a slice ``slice_rows``, of ``block_bytes`` at most; what
    is shuffled is the table for each block of queries, and the queries for each slice.
    """
    kind = "float" if "float" in vectors.schema["embedding"].dataType.simpleString() else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"), is_query.alias("query"))
    rows = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("embedding"))
    width = F.col("dim").cast("long") * (4 if kind == "float" else 8) + 8
    n, queries, n_bytes, query_bytes = (x or 0 for x in rows.agg(F.count("*"), F.count_if("query"), F.sum(width), F.sum(F.when(F.col("query"), width))).first())
    slices, groups = max(least_slices, -(-n // slice_rows), -(-n_bytes // block_bytes)), max(1, -(-queries // query_rows), -(-query_bytes // block_bytes))

    def pack(table: pa.Table) -> pa.Table:
        vectors = table.column("embedding").combine_chunks()
        ids = np.asarray(table.column("vec_id"), np.int64)
        values = np.asarray(vectors.flatten()).reshape(len(ids), -1)
        # In one order whenever the block is made again: a query's lists are told apart by its place.
        order = np.lexsort((*values.T, ids))
        return pa.table({"dim": table.column("dim")[:1], "part": table.column("part")[:1], "block": pa.array([Block(ids[order], values[order]).pack()], pa.binary())})

    def packed(frame: DataFrame, parts: int) -> DataFrame:
        # By the vector too: rows that share an id are not dealt into one slice.
        dealt = frame.withColumn("part", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(parts)).cast("int"))
        return dealt.select("vec_id", "embedding", "dim", "part").groupBy("dim", "part").applyInArrow(pack, "dim int, part int, block binary")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = packed(rows, slices).select("dim", F.col("part").alias("slice"), every(groups).alias("grp"), "block")
    q = packed(rows.where("query"), groups).select("dim", every(slices).alias("slice"), F.col("part").alias("grp"), "block")

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if left.num_rows and right.num_rows:
            group, dim = left.column("grp")[0].as_py(), left.column("dim")[0].as_py()
            stream = [c for data in right.column("block").to_pylist() for _, c in Block.parts(data, tile_rows)]
            for a, q in Block.parts(left.column("block")[0].as_py(), 256):
                best = Nearest(q, k)
                for c in stream:
                    best.see(c)
                for b in range(0, len(q.ids), 64):
                    each = range(b, min(b + 64, len(q.ids)))
                    lists = [np.array([a + x, q.ids[x], best.n[x]], np.int64).tobytes() + best.ids[x, : best.n[x]].tobytes() + best.scores[x, : best.n[x]].tobytes() for x in each if best.n[x]]
                    out.append((dim, group << 32 | (a + b), b"".join(lists)))
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["dim", "part", "lists"])

    def merge(table: pa.Table) -> pa.Table:
        lists: dict[tuple[int, int], list] = {}
        for data in table.column("lists").to_pylist():
            at = 0
            while at < len(data):
                place, query, m = np.frombuffer(data, np.int64, 3, at).tolist()
                ids, scores = np.frombuffer(data, np.int64, m, at + 24), np.frombuffer(data, np.float64, m, at + 24 + 8 * m)
                lists.setdefault((place, query), []).append(list(zip((-scores).tolist(), ids.tolist(), strict=True)))
                at += 24 + 16 * m
        rows = [(query, rank, i, -s) for (_, query), sorted_lists in lists.items() for rank, (s, i) in enumerate(islice(heapq.merge(*sorted_lists), k), 1)]
        return pa.table([pa.array([r[x] for r in rows], t) for x, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["query_id", "rank", "vec_id", "score"])

    keys = ("dim", "grp", "slice")
    tiles = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(product, "dim int, part long, lists binary")
    return tiles.groupBy("dim", "part").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
