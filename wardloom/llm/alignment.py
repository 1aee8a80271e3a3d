"""Alignment of the tokens of two tokenizers by the bytes they cover.

Both tokenizers encode a space and the text. The running sums of their tokens' bytes are the tokens' ends; the ends that
both have cut the text into groups, and a search among the cuts gives each token its group. Tokens of the two that end
together are linked. All texts of a batch are laid end to end and done at once, since the end of a text is a cut.

How often two ids are linked in the corpus is counted in two stages: for each batch, then by pair and salt, then by pair.
Of two linked tokens the shorter one's bytes end the longer one's, so there are at most as many pairs as the two
vocabularies have bytes. The counts are broadcast where that bound is small, and joined otherwise.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._lineage import written
from ._words import pieces, small_batches
from .bpe import Vocabulary, load

SPACE = "▁"
#: A pair of ids is one number: the first id in the upper bits.
PAIR_BITS = 32
#: The most pairs that are broadcast, 20 bytes each.
MOST_PAIRS = 4_000_000


class Spelling:
    """The bytes of a table's entries, looked up for many of them at once."""

    def __init__(self, table: list[bytes]):
        self.size = np.array([len(x) for x in table], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(table), np.uint8)

    def spell(self, ids: np.ndarray, step: int = 1 << 16) -> bytes:
        """The bytes of these entries end to end; ``step`` of them are in work at once."""
        out = []
        for i in range(0, len(ids), step):
            part = ids[i : i + step]
            size = self.size[part]
            at = np.repeat(self.start[part] - np.cumsum(size) + size, size)
            at += np.arange(len(at))
            out.append(self.data[at].tobytes())
        return b"".join(out)


class Bytes:
    """Encodes by a byte-level BPE file, given as text; the strings of special tokens are ordinary text.

    Its merges are known by their ids: that is the same where ids grow with the merges' ranks, which is checked.
    """

    def __init__(self, text: str):
        import tiktoken

        v = Vocabulary(text)
        made = sorted(v.rank, key=v.rank.get)
        if made != sorted(made) or any(h >= i for i in made for h in v.halves[i]):
            raise ValueError("ids do not grow with the ranks of the merges")
        self.table: list[bytes] = [b or b"" for b in v.bytes]
        plain = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.library = tiktoken.Encoding("first", pat_str=plain, mergeable_ranks=v.ids, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        encode = self.library.encode_ordinary
        return [encode(" " + t) for t in texts]


class Pieces:
    """Encodes by a sentencepiece model, given as bytes, which puts a space before each text itself.

    No piece has a space behind another character (checked), so what lies between spaces is encoded by itself, once
    while it is remembered, without its first space; ``remembered`` bounds the memory.
    """

    def __init__(self, model: bytes, remembered: int = 200_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        shown = [self.library.id_to_piece(i) for i in range(size)]
        self.table: list[bytes] = [bytes([int(s[3:5], 16)]) if self.library.is_byte(i) else b"" if self.library.is_control(i) else s.replace(SPACE, " ").encode() for i, s in enumerate(shown)]
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.letter = len(self.library.encode("a"))
        self.runs = re.compile(r" +[^ ]*").findall
        # A model that changes spaces is given whole texts too.
        probe = "a  b c  "
        self.apart = not any(SPACE in s.lstrip(SPACE) for s in shown) and b"".join(self._fresh(self._split(probe))) == np.array(self.library.encode(probe), np.int32).tobytes()

    def _split(self, text: str) -> list[str]:
        """Each run of spaces with what follows it, the text's own space included; the first space of each is left out."""
        if text[:1] != " " and "  " not in text:
            return text.split(" ")
        return [s[1:] for s in self.runs(" " + text)]

    def _fresh(self, segments: list[str]) -> list[bytes]:
        """The ids of segments, each behind a space; one of spaces alone needs something before it."""
        blank = [not s.strip(" ") for s in segments]
        ids = self.library.encode(["a " + s if b else s for s, b in zip(segments, blank, strict=True)], num_threads=1)
        return [array("i", x[self.letter :] if b else x).tobytes() for x, b in zip(ids, blank, strict=True)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        if not self.apart:
            return [array("i", x).tobytes() for x in self.library.encode(texts, num_threads=1)]
        parts = [self._split(t) if SPACE not in t else None for t in texts]
        known, every = self.known, set()
        for part in parts:
            every.update(part or ())
        fresh = list(every.difference(known))
        if len(known) + len(fresh) > self.remembered:
            known.clear()
            fresh = list(every)
        known.update(zip(fresh, self._fresh(fresh), strict=True))
        get = known.__getitem__
        out = [b"".join(map(get, part)) if part else array("i", self.library.encode(t, num_threads=1)).tobytes() for t, part in zip(texts, parts, strict=True)]
        for s in fresh:
            if len(s) >= 64:
                del known[s]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.packed(texts)]


@cache
def _first(text: str) -> Bytes:
    return Bytes(text)


@cache
def _second(model: bytes) -> Pieces:
    return Pieces(model)


def cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends that both have, and the group of each token: how many cuts lie before its end."""
    # Ends are in order, so repeats are neighbours and need not be looked for.
    once_a, once_b = (x[np.append(x[1:] != x[:-1], True)] if len(x) else x for x in (ends_a, ends_b))
    common = np.intersect1d(once_a, once_b, assume_unique=True)
    return common, np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)


def spelled(spelling: Spelling, ids: np.ndarray, many: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Whether the tokens of each text, ``many`` of them, are its bytes."""
    ends = np.concatenate([[0], np.cumsum(spelling.size[ids])])[np.concatenate([[0], np.cumsum(many)])].tolist()
    text = spelling.spell(ids)
    return np.array([text[lo:hi] == r for lo, hi, r in zip(ends[:-1], ends[1:], raw, strict=True)], bool)


def links(ends_a: np.ndarray, ends_b: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every pair of tokens that end together: the cut, the first's index and the second's. Tokens without bytes end with others."""
    low_a, low_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
    if all((x[1:] > x[:-1]).all() for x in (ends_a, ends_b)):
        return np.arange(len(common)), low_a, low_b
    many_a, many_b = np.searchsorted(ends_a, common, "right") - low_a, np.searchsorted(ends_b, common, "right") - low_b
    many = many_a * many_b
    at = np.repeat(np.arange(len(common)), many)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    return at, low_a[at] + nth // many_b[at], low_b[at] + nth % many_b[at]


class Aligner:
    def __init__(self, first: Bytes, second: Pieces):
        self.first, self.second = first, second
        self.spelling_a, self.spelling_b = Spelling(first.table), Spelling(second.table)
        # Each id as it is written: followed by a comma, or by what ends its part of a group.
        a, b = [str(i) for i in range(len(first.table))], [str(i) for i in range(len(second.table))]
        self.shown = Spelling([(x + s).encode() for ids, s in ((a, ","), (a, "|"), (b, ","), (b, ";")) for x in ids])
        self.at = np.cumsum([0, len(a), len(a), len(b)])

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """For each text its numbers of tokens (both), groups and links, and its groups as text; the links as pairs of
        ids, and where those of each text begin."""
        live = [t for t in texts if t]
        counts, shown, starts = np.zeros((len(texts), 4), np.int64), [b""] * len(texts), np.zeros(len(texts) + 1, np.int64)
        raw, a, b = [(" " + t).encode() for t in live], self.first.encode(live), self.second.packed(live)
        n_a, n_b, size = np.array([len(x) for x in a], np.int64), np.array([len(x) // 4 for x in b], np.int64), np.array([len(r) for r in raw], np.int64)
        ids_a, ids_b = np.fromiter(chain.from_iterable(a), np.int32, n_a.sum()), np.frombuffer(b"".join(b), np.int32)
        # Texts whose tokens do not spell them are left out.
        good = spelled(self.spelling_a, ids_a, n_a, raw) & spelled(self.spelling_b, ids_b, n_b, raw)
        if not good.all():
            ids_a, ids_b, n_a, n_b, size = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)], n_a[good], n_b[good], size[good]
        if not len(size):
            return counts, shown, np.zeros(0, np.int64), starts
        place = np.flatnonzero([bool(t) for t in texts])[good]
        ends_a, ends_b = np.cumsum(self.spelling_a.size[ids_a]), np.cumsum(self.spelling_b.size[ids_b])
        common, group_a, group_b = cuts(ends_a, ends_b)
        at, link_a, link_b = links(ends_a, ends_b, common)
        doc = np.searchsorted(np.cumsum(size), common)
        many = np.bincount(doc[at], minlength=len(size))
        counts[place] = np.column_stack([n_a, n_b, np.bincount(doc, minlength=len(size)), many])
        starts[1:][place] = many
        # Tokens in order of their groups, the first tokenizer's before the second's.
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        until_a, until_b = (np.cumsum(np.bincount(g + 1, minlength=len(common) + 1)) for g in (group_a, group_b))
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + until_b[group_a]] = ids_a + self.at[last_a.astype(np.int64)]
        order[np.arange(len(ids_b)) + until_a[group_b + 1]] = ids_b + self.at[2 + last_b.astype(np.int64)]
        text, until = self.shown.spell(order), np.concatenate([[0], np.cumsum(self.shown.size[order])])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        for p, lo, hi in zip(place.tolist(), until[:-1], until[1:], strict=True):
            shown[p] = text[lo : hi - 1]
        return counts, shown, ids_a[link_a].astype(np.int64) << PAIR_BITS | ids_b[link_b], np.cumsum(starts)


def align(docs: DataFrame, first_path: str, second_path: str, groups: bool = True, piece_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and ``pairs`` (array<long>: each link's ids, the first's times
    2^32 plus the second's, in order) of each text; with ``groups`` also the groups as text (``a1,a2|b1;a3|b2,b3``).

    A null or empty text, or one that either tokenizer's tokens do not spell byte for byte, has no tokens: zeros and ''.
    Rows are returned one for one, repeated ones too; other columns are ignored. No shuffle. The two tokenizer files are
    read on the driver and broadcast.
    """
    spark, source = docs.sparkSession, docs.select("doc_id", "text")
    small_batches(spark)
    with open(second_path, "rb") as f:
        files = spark.sparkContext.broadcast((load(first_path), f.read()))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(_first(files.value[0]), _second(files.value[1]))
        for batch in pieces(batches, "text", piece_bytes):
            counts, shown, pairs, starts = aligner.align(batch.column("text").to_pylist())
            hashes = [hashlib.sha256(s).hexdigest() if s else "" for s in shown]
            columns = [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(4)), pa.array(hashes, pa.string()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(pairs))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shown, pa.binary()).cast(pa.string())] if groups else columns, names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", *["groups"] * groups]
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(aligned, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>" + ", groups string" * groups)


def pair_counts(aligned: DataFrame, salts: int = 16) -> DataFrame:
    """pair, n (how many links of the corpus have it) and best (n is the highest of its second id, ties included).

    One row for each pair of ids that occurs. Batches are counted by themselves first; what they send is summed by pair and
    salt, then by pair, so that a pair that every batch has is spread over ``salts`` tasks.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for nth, batch in enumerate(batches):
            pair, n = np.unique(np.asarray(batch.column("pairs").flatten(), np.int64), return_counts=True)
            for i in range(0, len(pair), 100_000):
                part = pair[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), (task + nth) % salts, np.int32)), pa.array(n[i : i + 100_000].astype(np.int64))], ["pair", "salt", "n"])

    small_batches(aligned.sparkSession)
    parts = aligned.select("pairs").where("size(pairs) > 0").mapInArrow(counted, "pair long, salt int, n long")
    # The second sum must not take the place of the first: each has an exchange of its own.
    first = parts.groupBy("pair", "salt").agg(F.sum("n").alias("n"))
    counts = first.groupBy("pair").agg(F.sum("n").alias("n"))
    second = F.col("pair").bitwiseAND(F.lit((1 << PAIR_BITS) - 1))
    counts = written(counts.withColumn("second", second))
    highest = counts.groupBy("second").agg(F.max("n").alias("most"))
    return counts.join(highest, "second").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def most_pairs(first_path: str, second_path: str) -> int:
    """A bound of the pairs that any corpus can have: each is a token and a suffix of its bytes, or the other way round."""
    with open(second_path, "rb") as f:
        return sum(len(x) + 1 for x in [*_first(load(first_path)).table, *_second(f.read()).table])


def score(aligned: DataFrame, counts: DataFrame, bound: int, most: int = MOST_PAIRS) -> DataFrame:
    """Adds n_best, the links whose pair is a best one, and count_sum, the sum of the pairs' counts over the links.

    ``bound``: the most rows that ``counts`` can have. Up to ``most`` they are broadcast; beyond, links are joined with them.
    """
    spark = aligned.sparkSession
    other = [c for c in aligned.columns if c != "pairs"]
    if bound > most:
        rows = written(aligned.withColumn("row", F.monotonically_increasing_id()))
        each = rows.select("row", F.explode("pairs").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("k"))
        sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
        return rows.join(sums, "row", "left").select(*other, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")))
    table = counts.toArrow().sort_by("pair")
    pair, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
    shared = spark.sparkContext.broadcast((pair, n.astype(np.int64), best.astype(bool)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            column = batch.column("pairs")
            bounds = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0), np.int64))])
            at = np.searchsorted(pair, np.asarray(column.flatten(), np.int64))
            sums = [np.concatenate([[0], np.cumsum(x[at])])[bounds] for x in (best.astype(np.int64), n)] if len(at) else [np.zeros(len(bounds), np.int64)] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in other), *(pa.array(np.diff(s)) for s in sums)], [*other, "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name != "pairs")
    return aligned.mapInArrow(scored, f"{schema}, n_best long, count_sum long")


def cross(docs: DataFrame, first_path: str, second_path: str) -> DataFrame:
    """``align``, without the groups' text, and ``score`` by the counts over all of ``docs``. Links are written once, so texts are encoded once."""
    aligned = written(align(docs, first_path, second_path, groups=False), "zstd")
    return score(aligned, pair_counts(aligned), most_pairs(first_path, second_path))
