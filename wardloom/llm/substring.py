"""Substring dedup with a count-min prefilter.

A window is a run of ``n`` consecutive words. Documents are dealt into chunks of bounded size by a hash of their id and text.

1. Each chunk sketches its windows: for each of ``depth`` hash rows, the counters that its windows fall on. The sketches
   meet block by block (a block is a bounded slice of one row of counters); the counters are summed, saturating at two,
   and each chunk gets one bit back for each counter that it had touched: was the merged count two or more? The estimate
   of a window, the least over the rows, never falls below the number of chunks that hold it, so none is lost.
2. Each chunk hashes its windows again and keeps only those estimated repeated (or held by two of its own documents).
   These are grouped exactly, by 96 bits of two independent hashes (over 100 TB of text two unlike windows of all share
   them with a chance of about one in five hundred), to find the smallest document that each starts in; each chunk gets
   one bit for each of its windows: does it start in a document before all of the chunk's?
3. Each chunk marks the words that later occurrences cover and cuts them out.

Nothing is collected to the driver; no task holds more than a chunk or a block, and a window that fills the corpus has
one entry for each chunk, not one for each occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import Texts, mix64, separators, string_array, windows

WORD = separators("space")
#: The widest block of counters: a byte each while a block is merged.
MOST_WIDTH = 1 << 25
SALT = 0xA0761D6478BD642F
ANSWER = "chunk int, kind int, part int, bits binary"


class _Plan:
    """How many counters, blocks and chunks there are; fixed by the measured size of the corpus."""

    def __init__(self, n: int, depth: int, load: float, text_bytes: int, chunk_bytes: int, least: int):
        self.n, self.depth = n, depth
        self.chunks = max(least, -(-text_bytes // chunk_bytes))
        counters = max(1 << 20, int(load * text_bytes / 6))  # six bytes a word, its space included
        self.blocks = max(least, -(-counters // MOST_WIDTH))
        self.width = 1 << max(10, min(25, (counters // self.blocks).bit_length()))

    def bucket(self, h: np.ndarray, row: int) -> np.ndarray:
        """The counter of each hash in this row, numbered through all blocks."""
        h = mix64(h + np.uint64(SALT * (row + 1) % 2**64))
        return (h >> np.uint64(33)) % np.uint64(self.blocks) * np.uint64(self.width) + (h & np.uint64(self.width - 1))

    def shard(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(40)) % np.uint64(self.blocks)).astype(np.int64)


def pack(slots: np.ndarray) -> bytes:
    """Rising numbers as 16-bit gaps; a gap of 65535 or more takes several."""
    gaps = np.diff(slots.astype(np.int64), prepend=-1) - 1
    over = gaps // 65535
    if not over.any():
        return gaps.astype("<u2").tobytes()
    out = np.full(len(gaps) + int(over.sum()), 65535, np.int64)
    out[np.cumsum(over + 1) - 1] = gaps % 65535
    return out.astype("<u2").tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, "<u2").astype(np.int64)
    last = raw != 65535
    return (np.cumsum(raw + last) - 1)[last]


class _Chunk:
    """The windows of one chunk: for each distinct one, its hashes, its smallest document and whether it has two."""

    def __init__(self, table: pa.Table, plan: _Plan):
        self.ids = table.column("doc_id").combine_chunks()
        self.texts = Texts(table.column("text"))
        self.words = self.texts.words(WORD)
        hashes = self.words.hashes(1)
        self.at, h = windows(hashes, self.words.bounds, plan.n)
        doc = self.words.doc()[self.at]
        known = np.asarray(self.ids.is_valid())[doc]
        self.at, h, doc = self.at[known], h[known], doc[known]
        self.id = np.asarray(self.ids.fill_null(0), np.int64)[doc]
        _, low = windows(self.words.hashes(2), self.words.bounds, plan.n, 2)
        low = (low[known] >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(h)
        a, b = h[order], low[order]
        if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
            order = np.lexsort((low, h))
            a, b = h[order], low[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        self.high, self.low = a[first], b[first]
        self.of = np.empty(len(a), np.int64)  # of each occurrence: which distinct window
        self.of[order] = np.cumsum(new) - 1
        ids = self.id[order]
        self.least = np.minimum.reduceat(ids, first) if len(first) else ids
        self.twice = (np.maximum.reduceat(ids, first) if len(first) else ids) > self.least

    def buckets(self, plan: _Plan, row: int) -> tuple[np.ndarray, np.ndarray]:
        """The counters that the distinct windows fall on, rising, and of each window: which of these."""
        all_of = plan.bucket(self.high, row)
        order = np.argsort(all_of)
        rising = all_of[order]
        new = np.ones(len(rising), bool)
        new[1:] = rising[1:] != rising[:-1]
        of = np.empty(len(rising), np.int64)
        of[order] = np.cumsum(new) - 1
        return rising[new], of

    def repeated(self, plan: _Plan, answers: dict) -> np.ndarray:
        """Of each distinct window: is it estimated to be in two chunks or more, or known to be in two documents?"""
        maybe = np.ones(len(self.high), bool)
        for row in range(plan.depth):
            mine, of = self.buckets(plan, row)
            bits = np.zeros(len(mine), bool)
            edge = np.searchsorted(mine, np.arange(plan.blocks + 1, dtype=np.uint64) * np.uint64(plan.width))
            for block in range(plan.blocks):
                a, b = edge[block], edge[block + 1]
                if b > a:
                    bits[a:b] = np.unpackbits(np.frombuffer(answers[0, row * plan.blocks + block], np.uint8), count=b - a)
            maybe &= bits[of]
        return maybe | self.twice

    def entries(self, plan: _Plan, answers: dict) -> Iterator[tuple[int, np.ndarray]]:
        """Of each shard: which distinct windows to group exactly, in order."""
        chosen = np.flatnonzero(self.repeated(plan, answers))
        shard = plan.shard(self.high[chosen])
        order = np.argsort(shard, kind="stable")
        edge = np.searchsorted(shard[order], np.arange(plan.blocks + 1))
        for k in range(plan.blocks):
            if edge[k + 1] > edge[k]:
                yield k, chosen[order[edge[k] : edge[k + 1]]]


def _answers(table: pa.Table) -> dict:
    return {(k, p): b for k, p, b in zip(*(table.column(c).to_pylist() for c in ("kind", "part", "bits")), strict=True)}


def dedup(docs: DataFrame, n: int = 13, depth: int = 2, load: float = 4.0, chunk_bytes: int = 8 << 20, least_parts: int = 48) -> DataFrame:
    """Cuts every word that a repeated window covers, but for the window's smallest document.

    A window of ``n`` words that also starts in a document with a smaller doc_id is a repeat; windows are judged on the
    input. ``docs`` needs an integer doc_id and text; other columns are ignored. Returns doc_id, n_words, n_removed,
    kept_text (the other words, joined by one space), a row for each row. A null or blank text has no words and an
    empty kept_text. Rows with a null doc_id have no place in the order: they keep all words and make nothing a repeat.
    Rows that share a doc_id are not repeats of each other. ``load`` is the number of counters for each word and row.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text_bytes = source.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    plan = _Plan(n, depth, load, text_bytes, chunk_bytes, least_parts)
    # By the text as well, so that rows without an id, or with one id, are not dealt into one chunk.
    dealt = source.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(plan.chunks)).cast("int"))

    def sketch(table: pa.Table) -> pa.Table:
        chunk, number = _Chunk(table, plan), table.column("chunk")[0].as_py()
        parts, slots = [], []
        for row in range(plan.depth):
            mine, _ = chunk.buckets(plan, row)
            edge = np.searchsorted(mine, np.arange(plan.blocks + 1, dtype=np.uint64) * np.uint64(plan.width))
            for block in range(plan.blocks):
                if edge[block + 1] > edge[block]:
                    parts.append(row * plan.blocks + block)
                    slots.append(pack(mine[edge[block] : edge[block + 1]] - np.uint64(block * plan.width)))
        return pa.table({"chunk": pa.array([number] * len(parts), pa.int32()), "part": pa.array(parts, pa.int32()), "slots": pa.array(slots, pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        """A block of counters: sums the sketches, and tells each which of its counters came to two."""
        slots = [unpack(x) for x in table.column("slots").to_pylist()]
        counters = np.zeros(plan.width, np.uint8)
        for x in slots:  # a chunk names a counter once, so no addition is lost
            counters[x] = np.minimum(counters[x] + 1, 2)
        bits = [np.packbits(counters[x] >= 2).tobytes() for x in slots]
        return pa.table({"chunk": table.column("chunk"), "kind": pa.array([0] * len(bits), pa.int32()), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})

    def entries(table: pa.Table, told: pa.Table) -> pa.Table:
        empty = pa.table({"chunk": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "windows": pa.array([], pa.binary())})
        if not table.num_rows or not told.num_rows:
            return empty
        chunk, number, rows = _Chunk(table, plan), table.column("chunk")[0].as_py(), []
        for shard, these in chunk.entries(plan, _answers(told)):
            rows.append((shard, b"".join((np.int64(len(these)).tobytes(), chunk.high[these].tobytes(), chunk.low[these].tobytes(), _narrow(chunk.least[these])))))
        if not rows:
            return empty
        return pa.table({"chunk": pa.array([number] * len(rows), pa.int32()), "shard": pa.array([x for x, _ in rows], pa.int32()), "windows": pa.array([x for _, x in rows], pa.binary())})

    def group(table: pa.Table) -> pa.Table:
        """A shard of windows: the smallest document of each, and whether it is before all of the chunk's."""
        read = [_read(x) for x in table.column("windows").to_pylist()]
        high, low, least = (np.concatenate([x[i] for x in read]) for i in range(3))
        order = np.lexsort((low, high))
        a, b = high[order], low[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        before = np.empty(len(a), bool)
        before[order] = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.append(first, len(a)))) < least[order]
        cuts = np.cumsum([len(x[0]) for x in read])[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(before, cuts)]
        return pa.table({"chunk": table.column("chunk"), "kind": pa.array([1] * len(bits), pa.int32()), "part": table.column("shard"), "bits": pa.array(bits, pa.binary())})

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        chunk = _Chunk(table, plan)
        words, cover = chunk.words, np.zeros(len(chunk.words.starts) + 1, np.int32)
        if told.num_rows:
            answers, before = _answers(told), np.zeros(len(chunk.high), bool)
            for shard, these in chunk.entries(plan, answers):
                before[these] = np.unpackbits(np.frombuffer(answers[1, shard], np.uint8), count=len(these)).astype(bool)
            repeat = chunk.at[before[chunk.of] | (chunk.id > chunk.least[chunk.of])]
            cover += np.bincount(repeat, minlength=len(cover)) - np.bincount(repeat + plan.n, minlength=len(cover))
        keep = np.cumsum(cover[:-1]) == 0
        data, offsets = words.kept(keep)
        kept = np.concatenate([[0], np.cumsum(keep)])[words.bounds]
        return pa.table({"doc_id": chunk.ids, "n_words": pa.array(np.diff(words.bounds), pa.int64()), "n_removed": pa.array(np.diff(words.bounds) - np.diff(kept), pa.int64()), "kept_text": string_array(data, offsets)})

    by_chunk = dealt.groupBy("chunk")
    told = by_chunk.applyInArrow(sketch, "chunk int, part int, slots binary").groupBy("part").applyInArrow(merge, ANSWER)
    asked = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(entries, "chunk int, shard int, windows binary")
    found = asked.groupBy("shard").applyInArrow(group, ANSWER)
    return by_chunk.cogroup(told.unionByName(found).groupBy("chunk")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as a base and 32-bit distances if these suffice."""
    base = ids.min()
    if int(ids.max()) - int(base) < 1 << 32:
        return b"\0" + base.tobytes() + (ids - base).astype(np.uint32).tobytes()
    return b"\1" + ids.tobytes()


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    rest = 9 + 12 * n
    high, low = np.frombuffer(data, np.uint64, n, 8), np.frombuffer(data, np.uint32, n, 8 + 8 * n)
    if data[rest - 1]:
        return high, low, np.frombuffer(data, np.int64, n, rest)
    return high, low, np.frombuffer(data, np.int64, 1, rest)[0] + np.frombuffer(data, np.uint32, n, rest + 8).astype(np.int64)


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
