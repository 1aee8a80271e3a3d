"""An exact Jaccard self-join on word shingles, by universe partition and the pigeonhole principle.

1. Documents of equal shingle sets are one class, stood for by its smallest document.
2. Sizes fall into bands; similar sets are of one band or of neighbouring ones, so each set is dealt into its band and,
   if a similar set can be larger than that, into the next. In a band the sets that may link differ by at most H
   shingles. The universe of shingles is hashed into segments, ``a`` exact and ``d`` with one deletion, a + 2 d > H:
   if all exact segments of two sets differed, and all others by two or more shingles, they would differ by more than
   H. So two similar sets share the signature of an exact segment, or that of a segment or of it less one shingle.
   Segments without shingles agree in unlike sets too, and so do those with nothing but what many texts hold. So there are
   some segments more than that: sets that are thin in no more of them than these give no signature of such.
3. Sets that share a signature are candidates. Only a star is kept of each signature: the sets of a piece of the corpus
   meet its smallest there, and these meet across pieces. The components of the stars are clusters.
4. Inside a cluster of up to a tile's size all sets are compared: by size, then by parity sketches, whose distance is
   never above the real one, and at last exactly, but for pairs that verified links already connect. In a larger one
   each set meets a few representatives first; those that these links connect need not be compared with each other, and
   only the rest meets the whole cluster. There the sketches alone are dealt into blocks, some bytes for each set; the
   pairs that these leave are verified exactly. The verified links give the components of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._lineage import cut, written
from ._words import Texts, mix64, pieces, release, separators, small_batches, windows
from .components import components

WORD = separators("space")
RATIO = 1.25
#: The sets that all others of a large cluster meet first.
REPRESENTATIVES = 8
#: The share of sets that may give signatures of no shingle.
OPEN = 0.001
#: The most shingles that are told to all tasks as held by many texts.
COMMON = 50_000
#: The sets of a band that a shingle which all hold may bring together, before segments are loose.
MEET = 1_000_000


def _bounds(most: int) -> list[int]:
    """The lower ends of the bands of sizes; the last is above ``most``."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return out


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of the n-word shingles of each text, rising, and where each text's begin.

    A text of fewer words has one shingle, of all of them; one without words has none. A-Z are lower-cased.
    """
    texts = Texts(column, lower=True)
    words = texts.words(WORD)
    hashes, size = words.hashes(3), np.diff(words.bounds)
    at, h = windows(hashes, words.bounds, n)
    doc = np.searchsorted(words.bounds, at, "right") - 1
    for k in range(1, n):
        short = np.flatnonzero(size == k)
        if len(short):
            words_of = hashes[words.bounds[short, None] + np.arange(k)]
            whole = windows(words_of.ravel(), np.arange(len(short) + 1) * k, k, k)[1]
            h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
    order = np.argsort(doc, kind="stable")
    h, doc = h[order], doc[order]
    edge = np.searchsorted(doc, np.arange(texts.n + 1))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(texts.n + 1))


NONE = np.zeros(0, np.uint64)


@dataclass
class Band:
    """The segments of one band: ``exact`` of weight one, then ``loose`` of weight two, which allow a deletion.

    Segments that agree weigh ``slack`` + 1 or more in two similar sets. A segment that a match may leave without a
    shingle is weak: it agrees with all others such. A set whose weak segments weigh no more than the slack shares a
    signature of some shingle with each similar set, so it gives no signature of none. Shingles that many sets hold do not
    count in this; they may be any, as long as they are the same for all sets.
    """

    number: int
    allowed: int
    exact: int
    loose: int

    @property
    def slack(self) -> int:
        return self.exact + 2 * self.loose - self.allowed - 1

    def signatures(self, h: np.ndarray, doc: np.ndarray, n_docs: int, common: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray]:
        """(document, signature) of the sets ``h``, given with the document of each shingle; ``common`` rises."""
        m, units = self.exact + self.loose, self.exact + 2 * self.loose
        unit = (mix64(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(units)).astype(np.int64)
        segment = np.where(unit < self.exact, unit, self.exact + (unit - self.exact) // 2)
        part = mix64(h + np.uint64(0x2545F4914F6CDD1D))
        cell = doc * m + segment
        order = np.argsort(cell, kind="stable")
        ends = np.searchsorted(cell[order], np.arange(n_docs * m + 1))
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part[order])])
        sums = running[ends[1:]] - running[ends[:-1]]
        own = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h if len(common) else np.ones(len(h), bool)
        count = np.bincount(cell[own], minlength=n_docs * m)
        loose = np.arange(m) >= self.exact
        weak = (count.reshape(n_docs, m) <= loose) @ (1 + loose)
        whole = np.repeat(weak > self.slack, m)  # whether signatures of no shingle count
        name = mix64(np.arange(m, dtype=np.uint64) + np.uint64(self.number << 32))  # of the segment
        full = np.flatnonzero((count > 0) | whole)
        docs, signatures = [full // m], [mix64(sums[full] + name[full % m])]
        deleted = np.flatnonzero((segment >= self.exact) & ((count[cell] > own) | whole[cell]))
        if len(deleted):
            docs.append(doc[deleted])
            signatures.append(mix64(sums[cell[deleted]] - part[deleted] + name[segment[deleted]]))
        return np.concatenate(docs), np.concatenate(signatures)


def _segments(weight: int, unit: float, loose: bool) -> tuple[int, int, float, float]:
    """Segments of this weight, exact ones and loose ones, with ``unit`` shingles for each weight; about how many of them
    are weak in a set; and the chance that one holds nothing but a given shingle of it."""
    few = math.exp(-2 * unit) * (1 + 2 * unit) if loose else math.exp(-unit)
    return (weight % 2, weight // 2, weight // 2 * few + weight % 2 * math.exp(-unit), few) if loose else (weight, 0, weight * few, few)


def allocate(number: int, top: int, sets: int, numerator: int, denominator: int) -> Band | None:
    """The segments for a band of ``sets`` sets of up to ``top`` shingles; None if only equal sets can link.

    Exact segments give the fewest signatures. Sets that share no more than a line meet where one holds a single shingle of
    it; where these may be very many, segments are loose. The slack is as large as leaves few sets that give signatures of no shingle.
    """
    allowed = 2 * top * (denominator - numerator) // (denominator + numerator)
    if allowed == 0:
        return None
    least = top / RATIO * numerator / denominator  # shingles of the smallest sets, which are from the band below
    for loose in (False, True):
        best = None
        for slack in range(8 + allowed // 4):
            weight = allowed + 1 + slack
            exact, double, weak, single = _segments(weight, least / weight, loose)
            most = slack // 2 if loose else slack
            over = 1 - sum(math.exp(k * math.log(weak) - weak - math.lgamma(k + 1)) for k in range(most + 1))
            if best is None or over < best[0]:
                best = (over, exact, double, single)
            if over <= OPEN:
                break
        if best[3] * sets <= MEET:
            break
    return Band(number, allowed, best[1], best[2])


def _dealt(sizes: np.ndarray, bounds: list[int], numerator: int, denominator: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each band: which sets are dealt into it."""
    own = np.searchsorted(bounds, sizes, "right") - 1
    most = np.searchsorted(bounds, sizes * denominator // numerator, "right") - 1
    for band in range(len(bounds)):
        these = np.flatnonzero((sizes > 0) & (own <= band) & (band <= most))
        if len(these):
            yield band, these


def _members(h: np.ndarray, edge: np.ndarray, these: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of some sets, and the place of each one's set among them."""
    size = edge[these + 1] - edge[these]
    return h[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(edge[these], size)], np.repeat(np.arange(len(these)), size)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _parities(sets: list[np.ndarray], words: int) -> np.ndarray:
    """A sketch of 64 * words bits of each set: whether an odd number of its shingles falls on each."""
    size = np.array([len(x) for x in sets])
    bit = (mix64(np.concatenate(sets)) % np.uint64(64 * words)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(sets)), size) * 64 * words + bit, minlength=len(sets) * 64 * words)
    return np.packbits((counts & 1).astype(np.uint8).reshape(len(sets), -1), axis=1).view(np.uint64)


def _width(top: int, numerator: int, denominator: int) -> int:
    """How many words a sketch has for sets of up to ``top`` shingles: eight bits for each difference allowed."""
    allowed = 2 * top * (denominator - numerator) // (denominator + numerator)
    return max(2, 1 << (max(1, allowed * 8 // 64) - 1).bit_length())


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Links between sets i of ``left`` and j of ``right`` that connect all that are connected by such links."""
    size = np.array([len(x) for x in sets])
    sketch = _parities(sets, _width(int(size.max()), numerator, denominator))
    forest, out = _Forest(len(sets)), []
    for i in left.tolist():
        others = right[right > i] if left is right else right
        both = size[others] + size[i]
        # From 100 i >= 90 u, with i and u from the sum of sizes and the distance.
        near = np.minimum(size[others], size[i]) * denominator >= np.maximum(size[others], size[i]) * numerator
        others, both = others[near], both[near]
        if not len(others):
            continue
        distance = np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        for j in others[distance * (denominator + numerator) <= both * (denominator - numerator)].tolist():
            if forest.find(i) != forest.find(j):
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if denominator * common >= numerator * (size[i] + size[j] - common):
                    forest.join(i, j)
                    out.append((i, j))
    return out


def near_sketches(sketch: np.ndarray, size: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a set of ``left`` and one of ``right``, of unlike components, that sizes and sketches do not rule out.

    The sketches of ``right`` lie word by word, by size, so that those of fitting size are one stretch of each word. Half
    of the words is compared first; it rules out almost all unlike sets.
    """
    right = right[np.argsort(size[right], kind="stable")]
    sizes, columns = size[right], np.ascontiguousarray(sketch[right].T)
    half, found = max(1, len(columns) // 2), [np.zeros((2, 0), np.int64)]
    for i in left.tolist():
        n, own = int(size[i]), sketch[i]
        lo, hi = np.searchsorted(sizes, -(-n * numerator // denominator)), np.searchsorted(sizes, n * denominator // numerator, "right")
        if lo >= hi:
            continue
        distance = np.zeros(hi - lo, np.uint32)
        for word, x in zip(columns[:half], own, strict=False):
            distance += np.bitwise_count(word[lo:hi] ^ x)
        most = (n + int(sizes[hi - 1])) * (denominator - numerator) // (denominator + numerator)
        others = lo + np.flatnonzero(distance <= most)
        total = distance[others - lo] + np.bitwise_count(columns[half:, others] ^ own[half:, None]).sum(axis=0, dtype=np.int64)
        others = others[(total * (denominator + numerator) <= (sizes[others] + n) * (denominator - numerator)) & (component[right[others]] != component[i])]
        found.append(np.stack([np.full(len(others), i), right[others]]))
    pairs = np.concatenate(found, axis=1)
    return pairs[0], pairs[1]


def join(docs: DataFrame, n: int = 5, numerator: int = 8, denominator: int = 10, tile_rows: int = 512, tile_bytes: int = 16 << 20, block_rows: int = 8192, block_bytes: int = 32 << 20, least_parts: int = 48) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of each document.

    Two documents link when the Jaccard similarity of their sets of n-word shingles is numerator / denominator or more.
    ``docs`` needs an integer doc_id and text; other columns are ignored. A text of fewer than n words has one shingle
    of all of them; a null or blank text has none and is its own component. A doc_id stands for all its rows: what one
    of them links with is linked with the id, so each row gets the component of its own text. Rows with a null doc_id
    take no part: their component is null; an empty table gives none. Shingles are compared by 64-bit hashes, whole sets by
    128 bits of theirs.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            h, edge = shingle_sets(batch.column("text"), n)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h + np.uint64(s)))]) for s in (0x1234567, 0x89ABCDEF)]
            a, b = ((x[edge[1:]] - x[edge[:-1]]).view(np.int64) for x in sums)
            values, counts = np.unique(h, return_counts=True)
            often = [values[counts >= max(8, batch.num_rows / 64)].view(np.int64), *[None] * (batch.num_rows - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(edge), pa.int64()), pa.array(a), pa.array(b), pa.array(often, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "fa", "fb", "often"])

    sets = cut(source.mapInArrow(sized, "doc_id long, n_shingles long, fa long, fb long, often array<long>"))
    # The shingles that many texts hold in an eighth of the pieces or more; which these are changes the cost, not the result.
    listed = sets.where("often IS NOT NULL")
    frequent = listed.select(F.explode("often").alias("h")).groupBy("h").count().where(F.col("count") * 8 >= max(8, listed.count())).orderBy(F.desc("count"), "h").limit(COMMON)
    common = np.sort(np.array([r.h for r in frequent.collect()], np.int64).view(np.uint64))
    sets = sets.drop("often")
    classes = cut(sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("fa", "fb").agg(F.min("doc_id").alias("class"), F.max("n_shingles").alias("n")))
    bounds = _bounds(classes.agg(F.max("n")).first()[0] or 1)
    number = sum((F.when(F.col("n") >= b, 1).otherwise(0) for b in bounds), F.lit(0)) - 1
    # As many rows as there are bands, which grow with the logarithm of the largest set.
    counts = {r.band: r.sets for r in classes.groupBy(number.alias("band")).agg(F.count("*").alias("sets")).collect()}
    counts = {b: counts.get(b, 0) + counts.get(b - 1, 0) for b in range(len(bounds))}
    bands = [allocate(b, (bounds[b + 1] if b + 1 < len(bounds) else bounds[b] + 1) - 1, counts[b], numerator, denominator) for b in range(len(bounds))]
    n_docs = sum(counts.values())
    shards = max(least_parts, -(-n_docs * 64 // 4_000_000))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stars inside a piece (shard -1), and the smallest document of each signature of it, by shard."""
        for batch in pieces(batches, "text", 4 << 20):
            ids = batch.column("doc_id")
            known = np.flatnonzero(np.asarray(ids.is_valid()))
            ids = np.asarray(ids.fill_null(0), np.int64)
            h, edge = shingle_sets(batch.column("text"), n)
            keys, who = [], []
            for band, these in _dealt(np.where(np.isin(np.arange(len(ids)), known), np.diff(edge), 0), bounds, numerator, denominator):
                if band < len(bands) and bands[band] is not None:
                    docs, s = bands[band].signatures(*_members(h, edge, these), len(these), common)
                    keys.append(s)
                    who.append(ids[these[docs]])
            if not keys:
                continue
            stars, key, who = _stars(np.concatenate(keys), np.concatenate(who))
            shard = ((key >> np.uint64(48) ^ key >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((who, shard))
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [(k, _packed(key[x], who[x])) for k in range(shards) if len(x := order[cuts[k] : cuts[k + 1]])]
            rows.append((-1, stars.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["shard", "entries"])

    def meet(table: pa.Table) -> pa.Table:
        read = table.column("entries").to_pylist()
        if table.column("shard")[0].as_py() >= 0:
            key, who = (np.concatenate(x) for x in zip(*map(_unpacked, read), strict=True))
            edges, _, _ = _stars(key, who)
        else:
            edges = np.concatenate([np.frombuffer(d, np.int64).reshape(-1, 2) for d in read])
        return pa.table({"a": pa.array(edges[:, 0]), "b": pa.array(edges[:, 1])})

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The size and sketch of each set in each band that it is dealt into."""
        for batch in pieces(batches, "text", 2 << 20):
            h, edge = shingle_sets(batch.column("text"), n)
            ids, size, rows = np.asarray(batch.column("doc_id"), np.int64), np.diff(edge), []
            for band, these in _dealt(size, bounds, numerator, denominator):
                top = (bounds[band + 1] if band + 1 < len(bounds) else bounds[band] + 1) - 1
                sketch = _parities([h[edge[i] : edge[i + 1]] for i in these], _width(top, numerator, denominator))
                rows += [(ids[i], band, size[i], x.tobytes()) for i, x in zip(these.tolist(), sketch, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["doc_id", "band", "n", "sketch"])

    def possible(table: pa.Table) -> pa.Table:
        """The pairs of sets, of unlike components, that sizes and sketches do not rule out."""
        ids, side, size, component = (np.asarray(table.column(c)) for c in ("doc_id", "side", "n", "component"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
        left, right = near_sketches(sketch, size, component, np.flatnonzero(side == 1), np.flatnonzero(side == 2), numerator, denominator)
        return pa.table({"a": pa.array(ids[left]), "b": pa.array(ids[right]), "n": pa.array(size[right])})

    entries = source.mapInArrow(signed, "shard int, entries binary")
    # The stars of pieces go with a salt each; a shard meets as one group.
    salted = entries.withColumn("salt", F.when(F.col("shard") < 0, F.pmod(F.xxhash64("entries"), F.lit(shards))).otherwise(F.lit(0)))
    edges = salted.groupBy("shard", "salt").applyInArrow(meet, "a long, b long")
    clusters = cut(components(edges))
    member = classes.select(F.col("class").alias("doc_id"), "n").join(clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "doc_id")
    # A block of sketches is held to rows and to bytes: sketches are wider in the bands of larger sets.
    tops = [(bounds[b + 1] if b + 1 < len(bounds) else bounds[b] + 1) - 1 for b in range(len(bounds))]
    rows_of = F.get(F.array(*(F.lit(max(64, min(block_rows, block_bytes // (8 * _width(t, numerator, denominator))))) for t in tops)), "band")
    small, large = _dealt_members(member, bounds, numerator, denominator, tile_rows, tile_bytes, rows_of)
    parts = max(256, n_docs // 1000)

    def compared(table: pa.Table) -> pa.Table:
        """Links inside the tiles of a group; a tile's rows say on which side they stand."""
        out: list[np.ndarray] = []
        ids, tile, side = (np.asarray(table.column(c)) for c in ("doc_id", "tile", "side"))
        h, edge = shingle_sets(table.column("text"), n)
        for t in np.unique(tile):
            these = np.flatnonzero(tile == t)
            own = [h[edge[i] : edge[i + 1]] for i in these]
            left, right = np.flatnonzero(side[these] <= 1), np.flatnonzero(side[these] != 1)
            if (side[these] == 0).all():
                right = left
            links = linked(own, left, right, numerator, denominator) if len(left) and len(right) else []
            out.append(np.array([(ids[these[i]], ids[these[j]]) for i, j in links], np.int64).reshape(-1, 2))
        pairs = np.concatenate(out)
        release()
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    def met(rows: DataFrame) -> DataFrame:
        """The verified links of tiles (doc_id, text, tile, side, part)."""
        return rows.groupBy("part").applyInArrow(compared, "a long, b long")

    name = F.xxhash64("cluster", "band")
    own = F.struct(F.pmod(name, F.lit(parts)).alias("part"), name.alias("tile"), F.lit(0).alias("side"))
    placed = small.select("doc_id", own.alias("own")).unionByName(large.select("doc_id", F.lit(None).cast("struct<part:bigint,tile:bigint,side:int>").alias("own")))
    placed = placed.groupBy("doc_id").agg(F.collect_list("own").alias("tiles"), F.max(F.col("own").isNull()).alias("large"))
    # The corpus is dealt by id once; of it only the members of clusters go on.
    texts = written(source.join(placed.hint("shuffle_hash"), "doc_id"))
    links = met(texts.select("doc_id", "text", F.inline("tiles")))
    if not large.isEmpty():
        few = texts.where("large").select("doc_id", "text")
        sketches = cut(few.mapInArrow(sketched, "doc_id long, band int, n long, sketch binary"))

        def verified(tiles: DataFrame) -> DataFrame:
            """The links among the sets that meet in tiles (doc_id, band, part, side, component)."""
            pairs = cut(tiles.join(sketches.hint("shuffle_hash"), ["doc_id", "band"]).groupBy("tile").applyInArrow(possible, "a long, b long, n long").distinct())
            # One set meets those that it may link with, dealt into as many tiles as keep each small, by number and by shingles.
            most = F.greatest(F.count("*") / tile_rows, F.sum("n") * 8 / tile_bytes)
            tiles_of = cut(pairs.groupBy("a").agg(F.ceil(most).alias("tiles")))
            tile = F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("tiles")))
            dealt = pairs.join(tiles_of.hint("shuffle_merge"), "a")
            sides = dealt.select(F.col("a").alias("doc_id"), tile.alias("tile"), F.lit(1).alias("side")).distinct().unionByName(dealt.select(F.col("b").alias("doc_id"), tile.alias("tile"), F.lit(2).alias("side")))
            return met(few.join(sides, "doc_id").withColumn("part", F.pmod("tile", F.lit(parts))))

        reached = cut(components(verified(_stars_of(large))))
        known = cut(large.join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
        links = links.unionByName(reached.select(F.col("node").alias("a"), F.col("component").alias("b"))).unionByName(verified(_rest_tiles(known, _rest(known), rows_of)))
    found = components(links)
    answer = cut(classes.join(found.select(F.col("node").alias("class"), "component"), "class", "left").select("fa", "fb", F.coalesce("component", "class").alias("component_id")))
    done = sets.join(answer, ["fa", "fb"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return done.select("doc_id", "n_shingles", own.alias("component_id"))


def _stars(key: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries (signature, document): distinct edges from each document to the signature's smallest, and these entries."""
    order = np.lexsort((who, key))
    key, who = key[order], who[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    lowest = np.repeat(who[first], np.diff(np.append(first, len(key))))
    edges = np.stack([who, lowest], axis=1)[who != lowest]
    if len(edges):
        edges = edges[np.lexsort((edges[:, 1], edges[:, 0]))]
        fresh = np.ones(len(edges), bool)
        fresh[1:] = (edges[1:] != edges[:-1]).any(axis=1)
        edges = edges[fresh]
    return edges, key[first], who[first]


def _packed(key: np.ndarray, who: np.ndarray) -> bytes:
    """Entries in the order of their documents: how many documents, each one's id and entries, and 48 bits of each
    signature. Signatures that agree in these only bring sets together that are then compared in vain."""
    first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
    counts = np.diff(np.append(first, len(who))).astype(np.uint32)
    parts = np.array([len(first)], np.int64), who[first], counts, key.astype(np.uint32), (key >> np.uint64(32)).astype(np.uint16)
    return b"".join(x.tobytes() for x in parts)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of ``_packed`` entries and their documents."""
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ids, counts = np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.uint32, n, 8 + 8 * n)
    k = int(counts.sum())
    low, high = np.frombuffer(data, np.uint32, k, 8 + 12 * n), np.frombuffer(data, np.uint16, k, 8 + 12 * n + 4 * k)
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), np.repeat(ids, counts)


def _dealt_members(member: DataFrame, bounds: list[int], numerator: int, denominator: int, tile_rows: int, tile_bytes: int, rows_of: Column) -> tuple[DataFrame, DataFrame]:
    """The sets of each cluster by band, (doc_id, cluster, band): those that fit one tile, and the others, with blocks."""
    band = lambda n: sum((F.when(n >= b, 1).otherwise(0) for b in bounds), F.lit(0)) - 1
    wide = F.sequence(band(F.col("n")), band(F.floor(F.col("n") * denominator / numerator)))
    dealt = cut(member.select("doc_id", "n", "cluster", F.explode(wide).alias("band")))
    sizes = dealt.groupBy("cluster", "band").agg(F.count("*").alias("k"), F.sum("n").alias("shingles")).where("k > 1")
    fits = (F.col("k") <= tile_rows) & (F.col("shingles") * 8 <= tile_bytes)
    sizes = sizes.select("cluster", "band", fits.alias("fits"), F.ceil(F.col("k") / rows_of).cast("int").alias("blocks"))
    placed = cut(dealt.drop("n").join(sizes, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(41)), F.col("blocks")).cast("int")))
    return placed.where("fits"), placed.where("NOT fits").drop("fits")


def _stars_of(large: DataFrame) -> DataFrame:
    """Tiles in which each block meets the representatives of its cluster: the smallest set, and some by hash."""
    by_hash = [F.min(F.struct(F.xxhash64("doc_id", F.lit(i)), "doc_id"))["doc_id"] for i in range(REPRESENTATIVES - 1)]
    chosen = large.groupBy("cluster", "band", "blocks").agg(F.array_distinct(F.array(F.min("doc_id"), *by_hash)).alias("ids"))
    chosen = chosen.withColumn("doc_id", F.explode("ids")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = chosen.select("doc_id", "cluster", "band", "block", F.lit(1).alias("side")).unionByName(large.select("doc_id", "cluster", "band", "block", F.lit(2).alias("side")))
    return rows.select("doc_id", "band", F.xxhash64("cluster", "band", "block", F.lit("star")).alias("tile"), "side", F.col("doc_id").alias("component"))


def _rest(known: DataFrame) -> DataFrame:
    """The sets of each cluster that are outside its largest connected part."""
    most = known.groupBy("cluster", "band", "component").count().groupBy("cluster", "band").agg(F.max(F.struct("count", "component"))["component"].alias("main"))
    return known.join(most, ["cluster", "band"]).where("component <> main").drop("main", "block")


def _rest_tiles(known: DataFrame, rest: DataFrame, rows_of: Column) -> DataFrame:
    """Tiles in which the rest of each cluster, in blocks, meets all blocks of it."""
    sizes = cut(rest.groupBy("cluster", "band").agg(F.count("*").alias("k")).select("cluster", "band", F.ceil(F.col("k") / rows_of).cast("int").alias("turns")))
    turn = F.pmod(F.xxhash64("doc_id", F.lit(43)), F.col("turns")).cast("int")
    columns = ("doc_id", "cluster", "band", "component")
    left = rest.join(sizes, ["cluster", "band"]).select(*columns, turn.alias("turn"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"))
    right = known.join(sizes, ["cluster", "band"]).select(*columns, F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "block", F.lit(2).alias("side"))
    return left.unionByName(right).select("doc_id", "band", F.xxhash64("cluster", "band", "block", "turn", F.lit("rest")).alias("tile"), "side", "component")
