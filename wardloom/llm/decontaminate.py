"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Text is normalised by lower-casing A-Z; words are runs of ASCII letters, digits and non-ASCII characters. The n-grams
of the benchmark items go to every executor as a sorted hash array with the place of each in the items' text, in blocks
of at most ``block_bytes`` of text (about five times that in memory). ``PASS`` blocks follow one another in one pass over
the documents; a larger benchmark takes more passes, with what was found so far written between them, so what is held at
once has a fixed bound however large the benchmark is. A scan hashes all windows of a batch at once, looks them up,
compares every hit word by word with the item, and marks the words that it covers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._columns import packed, unpacked
from ._lineage import written
from ._words import Texts, pieces, separators, small_batches, windows

WORD = separators("alnum")
BITS = 22
#: Blocks that are broadcast at once.
PASS = 4


class _Grams:
    """The windows of some benchmark items: by length, their hashes in order, with the first word and item of each."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.ids = [i for i, _ in items]
        words = Texts(pa.array([t for _, t in items], pa.string()), lower=True).words(WORD)
        self.data, self.starts, self.ends = words.texts.data, words.starts.astype(np.int32), words.ends.astype(np.int32)
        hashes, size = words.hashes(), np.diff(words.bounds)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted(set(np.minimum(size, n).tolist()) - {0}):
            at, h = windows(hashes, words.bounds, k)
            item = np.searchsorted(words.bounds, at, "right") - 1
            own = np.minimum(size[item], n) == k  # an item of fewer words than n is one window, of all of them
            at, h, item = at[own], h[own], item[own]
            order = np.lexsort((at, item, h))
            self.by_length[k] = h[order], at[order].astype(np.int32), item[order].astype(np.int32)

    def items(self, k: int, h: int, text: bytes) -> list[str]:
        """The items that hold these words as a window of k words; ``h`` is their hash."""
        hashes, at, item = self.by_length[k]
        a, b = np.searchsorted(hashes, np.uint64(h), "left"), np.searchsorted(hashes, np.uint64(h), "right")
        found = {self.ids[item[i]] for i in range(a, b) if b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[at[i] : at[i] + k], self.ends[at[i] : at[i] + k], strict=True)) == text}
        return sorted(found)


def _scan(grams: _Grams, batch: pa.RecordBatch) -> tuple[list[list[str]], np.ndarray, np.ndarray, list[list[dict]], tuple]:
    texts = Texts(batch.column("text"), lower=True)
    words = texts.words(WORD)
    hashes, cover = words.hashes(), np.zeros(len(words.starts) + 1, np.int32)
    items: list[set[str]] = [set() for _ in range(texts.n)]
    known: dict[tuple[int, bytes], list[str]] = {}
    for k, (wanted, _, _) in grams.by_length.items():
        at, h = windows(hashes, words.bounds, k)
        maybe = np.zeros(1 << BITS, bool)
        maybe[(wanted & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True
        near = np.flatnonzero(maybe[(h & np.uint64((1 << BITS) - 1)).astype(np.int64)])
        if len(near):
            place = np.minimum(np.searchsorted(wanted, h[near]), len(wanted) - 1)
            near = near[wanted[place] == h[near]]
        docs = np.searchsorted(words.bounds, at[near], "right") - 1
        for i, x, d in zip(at[near].tolist(), h[near].tolist(), docs.tolist(), strict=True):
            text = words.bytes_of(i, i + k)
            if (k, text) not in known:
                known[k, text] = grams.items(k, x, text)
            if ids := known[k, text]:
                items[d].update(ids)
                cover[i] += 1
                cover[i + k] -= 1
    hit = np.cumsum(cover[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])[words.bounds]
    spans: list[list[dict]] = [[] for _ in range(texts.n)]
    if hit.any():
        # A run of hit words of one text is one span, in bytes from the start of the text.
        doc, at = words.doc(), np.flatnonzero(hit)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        for i, j in zip(at[first].tolist(), at[last].tolist(), strict=True):
            spans[doc[i]].append({"start": int(words.starts[i] - texts.offsets[doc[i]]), "end": int(words.ends[j] - texts.offsets[doc[i]])})
    return [sorted(x) for x in items], np.diff(words.bounds), np.diff(total), spans, (texts, words)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _batch(batch: pa.RecordBatch, n_words, n_hit, items: pa.Array, spans: list) -> pa.RecordBatch:
    columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), items, pa.array(spans, SPANS)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "items", "spans"])


def _schema(source: DataFrame) -> str:
    return f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    block, held, given = [], 0, 0
    for row in rows.toLocalIterator():
        block.append((row.item_id, row.text))
        held += len(row.text) + 64
        if held >= block_bytes:
            yield block
            block, held, given = [], 0, given + 1
    if block or not given:
        yield block


def _over(frame: DataFrame, blocks: Iterator[list], n: int, step: Callable[[DataFrame, object], DataFrame]) -> DataFrame:
    """``step`` for each block with its broadcast n-grams; after ``PASS`` of them the rows are written and read again."""
    held = []
    for i, block in enumerate(blocks):
        if held and i % PASS == 0:
            frame = written(frame)
            for x in held:
                x.destroy()
            held = []
        held.append(frame.sparkSession.sparkContext.broadcast(_Grams(block, n)))
        frame = step(frame, held[-1])
    return frame


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """Hits of the benchmark in each document: doc_id, n_words, n_hit, items (sorted) and spans (bytes).

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns, whatever their names, are ignored. An
    item of fewer than n words, but not none, is one window. A null text, or one with no words, has no hits; a benchmark
    row with null id or text takes no part; repeated items and rows count as they stand. Rows of ``docs`` are returned
    one for one, and each is judged by itself, whatever its id and however many blocks the benchmark makes.
    """
    source = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)

    def one(frame: DataFrame, grams) -> DataFrame:
        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text"):
                items, n_words, n_hit, spans, _ = _scan(grams.value, batch)
                yield _batch(batch, n_words, n_hit, pa.array(items, pa.list_(pa.string())), spans)

        return frame.mapInArrow(scanned, _schema(source))

    if second is None:
        return _over(source, iter([first]), n, one)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            n_words, n_hit, spans = _joined(batch)
            yield _batch(batch, n_words, n_hit, batch.column("__items"), spans)

    return _over(_carrying(source), chain([first, second], blocks), n, _carried).mapInArrow(counted, _schema(source))


def _carrying(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__items": F.array().cast("array<string>"), "__spans": F.array().cast("array<struct<start:long,end:long>>")})


def _carried(frame: DataFrame, grams) -> DataFrame:
    """Adds to the ``__items`` and ``__spans`` of each row what a block finds in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            items, _, n_hit, spans, _ = _scan(grams.value, batch)
            if n_hit.any():
                items = [sorted({*x, *y}) for x, y in zip(batch.column("__items").to_pylist(), items, strict=True)]
                spans = [x + y for x, y in zip(batch.column("__spans").to_pylist(), spans, strict=True)]
                batch = batch.set_column(batch.schema.get_field_index("__items"), "__items", pa.array(items, pa.list_(pa.string())))
                batch = batch.set_column(batch.schema.get_field_index("__spans"), "__spans", pa.array(spans, SPANS))
            yield batch

    return frame.mapInArrow(run, frame.schema)


def _joined(batch: pa.RecordBatch) -> tuple[np.ndarray, list[int], list[list[dict]]]:
    """n_words, n_hit and spans of each text from its ``__spans``: a run of hit words is one span, as in one block."""
    texts = Texts(batch.column("text"), lower=True)
    words = texts.words(WORD)
    n_hit, spans = [], []
    for d, found in enumerate(batch.column("__spans").to_pylist()):
        starts, ends = (x[words.bounds[d] : words.bounds[d + 1]] - texts.offsets[d] for x in (words.starts, words.ends))
        hit = np.zeros(len(starts) + 2, np.int8)
        for x in found:
            hit[1 + np.searchsorted(starts, x["start"]) : 1 + np.searchsorted(starts, x["end"])] = 1
        step = np.diff(hit)
        n_hit.append(int(hit.sum()))
        spans.append([{"start": int(starts[i]), "end": int(ends[j - 1])} for i, j in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)])
    return np.diff(words.bounds), n_hit, spans


def remove(docs: DataFrame, benchmark: DataFrame, n: int = 10, how: str = "documents", block_bytes: int = 8 << 20) -> DataFrame:
    """The documents without the benchmark, with all their columns: ``documents`` drops every document with a hit,
    ``spans`` cuts the hit words out of the texts, with what stands between them.

    A null text has no hits and stays; a text that is cut to nothing stays as an empty one. Needs a column text; each
    row is judged by itself. Texts are cut at the end of the last pass, so each block judges them as they came.
    """
    if how not in ("documents", "spans"):
        raise ValueError(f"how must be documents or spans, not {how}")
    small_batches(docs.sparkSession)
    blocks, names = _blocks(benchmark, block_bytes), docs.columns

    def clean(frame: DataFrame, grams) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text"):
                yield batch.filter(pa.array(_scan(grams.value, batch)[2] == 0))

        return frame.mapInArrow(run, frame.schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = [_cut(t, x) for t, x in zip(batch.column("text").to_pylist(), _joined(batch)[2], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("rest")], ["text", "rest"])

    if how == "documents":
        return unpacked(_over(packed(docs), blocks, n, clean), names)
    rows = packed(docs)
    return unpacked(_over(_carrying(rows), blocks, n, _carried).mapInArrow(cut, rows.schema), names)


def _cut(text: str | None, spans: list[dict]) -> str | None:
    if not spans:
        return text
    raw, at, out = text.encode(), 0, []
    for x in spans:
        out.append(raw[at : x["start"]])
        at = x["end"]
    return b"".join([*out, raw[at:]]).decode()


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
