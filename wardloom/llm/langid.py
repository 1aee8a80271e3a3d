"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed 2- and 3-grams of its bytes (A-Z lower-cased, other ASCII than letters as one kind of
border), weighted 1 + log(tf) times idf and normalised. The vectors of each language are clustered by spherical
k-means; a text gets the language of the centroid with the largest cosine. A text is rejected if its cosine is under
``slack`` times the least that training texts of its centroid have at its length. Lengths are powers of two of different
n-grams; for those shorter than a training text as many of its n-grams are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._columns import packed, unpacked
from ._words import Texts, pieces, small_batches

BORDER = 0x20
#: Texts that are made vectors at once: each takes a counter for every dimension.
ROWS = 128
_MAP = np.full(256, BORDER, np.uint8)
_MAP[0x80:] = np.arange(0x80, 256)
_MAP[0x61:0x7B] = np.arange(0x61, 0x7B)
_MAP[0x41:0x5B] = np.arange(0x61, 0x7B)


def grams(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, count) of the hashed n-grams of each text, in order of row and dimension."""
    texts = Texts(column)
    doc = np.repeat(np.arange(texts.n), np.diff(texts.offsets))
    line = np.full(len(texts.data) + texts.n + 1, BORDER, np.uint32)
    line[np.arange(len(doc)) + doc + 1] = _MAP[texts.data]
    two = line[:-1] << 8 | line[1:]
    three = two[:-1] << 8 | line[2:]
    # An n-gram belongs to the text of its first byte, or of its second if that is a border between texts.
    of = np.zeros(len(line), np.int64)
    of[np.arange(len(doc)) + doc + 1] = doc
    of[texts.offsets[1:] + np.arange(1, texts.n + 1)] = np.arange(texts.n)
    of[texts.offsets[:-1] + np.arange(texts.n)] = np.arange(texts.n)
    joint = (line[:-2] == BORDER) & (line[2:] == BORDER) & (line[1:-1] == BORDER)
    keep = ~joint
    inner = np.zeros(len(line), bool)
    inner[texts.offsets[1:-1] + np.arange(1, texts.n)] = True  # the border between two texts
    keep &= ~inner[1:-1]
    h3 = (three * np.uint32(0x9E3779B1) ^ three >> 7) % np.uint32(dims)
    h2 = (two * np.uint32(0x85EBCA77) ^ two >> 5) % np.uint32(dims)
    flat = np.concatenate([(of[:-2] * dims + h3)[keep], (of[:-1] * dims + h2)[two != (BORDER << 8 | BORDER)]])
    counts = np.bincount(flat, minlength=texts.n * dims)
    at = np.flatnonzero(counts)
    return at // dims, at % dims, counts[at]


@dataclass
class Model:
    dims: int
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray  # a row each
    language: np.ndarray  # of each centroid
    radius: np.ndarray  # of each centroid: the cosine under which it rejects a text of 2**i different n-grams or more

    def vectors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of each text, and its number of different n-grams."""
        row, dim, count = grams(column, self.dims)
        weight = (1 + np.log(count)) * self.idf[dim]
        norm = np.sqrt(np.bincount(row, weight**2, len(column)))
        out = np.zeros((len(column), self.dims), np.float32)
        out[row, dim] = weight / norm[row]
        return out, np.bincount(row, minlength=len(column))

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The index of the language, the cosine, and whether the text is too far from it."""
        vectors, different = self.vectors(column)
        cosine = vectors @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = cosine[np.arange(len(best)), best]
        length = np.clip(np.frexp(different)[1] - 1, 0, self.radius.shape[1] - 1)
        return self.language[best], np.clip(score, 0, 1).astype(np.float64), score < self.radius[best, length]


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from seeds by k-means++: unit centroids, and the cluster of each row. Clusters of under a
    fiftieth of the rows, or of one, go into the nearest larger one."""
    rng = np.random.default_rng(0)
    seeds = [int((x @ x.mean(axis=0)).argmax())]
    while len(seeds) < min(k, len(x)):
        far = np.maximum(1 - (x @ x[seeds].T).max(axis=1).astype(np.float64), 0)
        if far.sum() < 1e-6:
            break
        seeds.append(int(rng.choice(len(x), p=far / far.sum())))

    def settled(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            of = (x @ c.T).argmax(axis=1)
            c = np.stack([x[of == i].mean(axis=0) if (of == i).any() else c[i] for i in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        return c, (x @ c.T).argmax(axis=1)

    c, of = settled(x[seeds])
    while len(c) > 1 and (size := np.bincount(of, minlength=len(c))).min() < max(2, len(x) / 50):
        c, of = settled(np.delete(c, size.argmin(), axis=0))
    return c, of


def fit(docs: DataFrame, usable: Column, dims: int = 8192, per_language: int = 700, clusters: int = 4, slack: float = 0.5, least_grams: int = 50) -> Model | None:
    """Learns from the text and lang of the rows where ``usable``, of which it takes ``per_language`` for each language:
    those whose ids and texts hash lowest, rows that are equal in both counting once. That bounds what reaches the driver, and
    holds for null and repeated ids as well. Only texts of ``least_grams`` different n-grams or
    more are clustered, if a language has any. None if there is nothing to learn from.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(usable & F.col("lang").isNotNull() & _letter()).select("text", "lang", F.xxhash64("doc_id", "text", F.lit(11)).alias("h"))
    sizes = {r.lang: r.n for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    # A share of each language that gives about twice the rows wanted; the lowest of these are then taken exactly.
    share = F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(min(1.0, 2 * per_language / n)))])
    near = rows.where((F.col("h") / F.lit(2.0**64) + 0.5) <= share[F.col("lang")]).dropDuplicates(["lang", "h"])
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= per_language)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 18, ROWS):
            row, dim, count = grams(batch.column("text"), dims)
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            pairs = [np.stack([dim[a:b], count[a:b]]).astype(np.int32).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(pairs, pa.binary())], ["lang", "h", "pairs"])

    sample = sorted((r.lang, r.h, bytes(r.pairs)) for r in near.select("text", "lang", "h").mapInArrow(counted, "lang string, h long, pairs binary").collect())
    lists = [np.frombuffer(p, np.int32).reshape(2, -1) for _, _, p in sample]
    seen = np.zeros(dims)
    for dim, _ in lists:
        seen[dim] += 1
    model = Model(dims, (np.log((1 + len(lists)) / (1 + seen)) + 1).astype(np.float32), sorted(sizes), np.zeros((0, dims)), np.zeros(0, int), np.zeros((0, 1)))
    centroids, language, radius = [], [], []
    lengths = int(np.frexp(max((x.shape[1] for x in lists), default=1))[1])
    for n, lang in enumerate(model.languages):
        own = [x for (of, _, _), x in zip(sample, lists, strict=True) if of == lang and x.shape[1]]
        if not own:
            continue
        c, _ = _cluster(_unit([x for x in own if x.shape[1] >= least_grams] or own, model), clusters)
        centroids.append(c)
        language += [n] * len(c)
        radius.append(slack * _least(own, c, model, lengths))
    if not centroids:
        return None
    model.centroids, model.language, model.radius = np.concatenate(centroids), np.array(language), np.concatenate(radius)
    return model


def _unit(lists: list[np.ndarray], model: Model) -> np.ndarray:
    """The unit vectors of texts given as (dimension, count)."""
    x = np.zeros((len(lists), model.dims), np.float32)
    for i, (dim, count) in enumerate(lists):
        x[i, dim] = (1 + np.log(count)) * model.idf[dim]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _least(lists: list[np.ndarray], c: np.ndarray, model: Model, lengths: int) -> np.ndarray:
    """Of each centroid of a language: the least cosine of its texts by how many n-grams are drawn of them. A centroid
    that no text of a length is nearest to has the least of its language there, and lengths that none has are as the
    longest before them."""
    rng, out = np.random.default_rng(0), np.zeros((len(c), lengths))
    for i in range(lengths):
        some = [x[:, rng.permutation(x.shape[1])[: 2**i]] for x in lists if x.shape[1] >= 2**i]
        if not some:
            out[:, i] = out[:, max(i - 1, 0)]
            continue
        cosine = _unit(some, model) @ c.T
        of, best = cosine.argmax(axis=1), cosine.max(axis=1)
        out[:, i] = [best[of == k].min() if (of == k).any() else best.min() for k in range(len(c))]
    # Shorter texts are never held to more than longer ones.
    return np.minimum.accumulate(out[:, ::-1], axis=1)[:, ::-1]


def _letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model | None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Of each row: doc_id, lang_pred, score (the cosine, 0 to 1), rejected, and the ``extra`` columns as they are.

    A text that is null or has no letter is ``und`` with score 0 and is rejected; so is every text if nothing was
    learned. Whole texts count. Nothing but the text is an input of a prediction. No shuffle; the model broadcast has
    a size fixed by its parameters.
    """
    source = docs.select("doc_id", "text", *[c for c in extra if c not in ("doc_id", "text")], _letter().alias("__letter"))
    names = [c for c in source.columns if c != "__letter" and (c != "text" or "text" in extra)]
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches, "text", 1 << 18, ROWS):
            letter = np.asarray(batch.column("__letter").to_numpy(zero_copy_only=False), bool)
            if model is None:
                of, score, far = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
                letter[:] = False
            else:
                of, score, far = model.predict(batch.column("text"))
            lang = [model.languages[i] if ok else "und" for i, ok in zip(of.tolist(), letter.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(far | ~letter)], [*names, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names)
    return source.mapInArrow(predicted, f"{kinds}, lang_pred string, score double, rejected boolean")


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows that ``predict`` does not reject, with all their columns, whatever their names. With nothing learned no
    text can be told from junk: only those that are null or have no letter go."""
    small_batches(docs.sparkSession)
    some = docs.where(_letter())
    if model is None:
        return some
    rows = packed(some)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 18, ROWS):
            yield batch.filter(pa.array(~shared.value.predict(batch.column("text"))[2]))

    return unpacked(rows.mapInArrow(kept, rows.schema), docs.columns)


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
