"""Token counts of sections, by offset-mapped attribution.

A whole document is encoded once; the length of each token's bytes gives its span of characters. Spans and sections of
one document are both sorted, so they are interval-joined by binary search. A token that lies across the border of
sections is allocated by an explicit rule:

* ``start``: to the section that holds its first character;
* ``majority``: to the section that holds most of its characters, the earlier one of equals;
* ``share``: to each section in proportion to its characters there.

A character whose bytes are in several tokens counts as a character of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._words import Texts, pieces, small_batches
from .bpe import Encoder, Vocabulary, load

COLUMNS = [("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_start", pa.int64()), ("n_majority", pa.int64()), ("n_share", pa.float64()), ("n_crossing", pa.int64())]


def token_spans(data: np.ndarray, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first character of each token and the one after its last, in characters of the bytes."""
    ends = np.cumsum(size[ids])
    nth = np.cumsum((data & 0xC0) != 0x80)  # characters begun up to each byte
    return nth[ends - size[ids]] - 1, nth[ends - 1]


def attribute(first: np.ndarray, after: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens [first, after) over sections [a, b), which are sorted and do not overlap; the counts by the three rules, and how many cross."""
    n_start = np.searchsorted(first, b) - np.searchsorted(first, a)
    low, high = np.searchsorted(after, a, "right"), np.searchsorted(first, b, "left")
    touched = np.maximum(high - low, 0)
    section = np.repeat(np.arange(len(a)), touched)
    token = np.arange(touched.sum()) - np.repeat(np.cumsum(touched) - touched, touched) + np.repeat(low, touched)
    overlap = np.minimum(after[token], b[section]) - np.maximum(first[token], a[section])
    length = after[token] - first[token]
    share = np.bincount(section, overlap / length, len(a))
    crossing = np.bincount(section[overlap < length], minlength=len(a))
    # Of the sections that a token touches, in order of (most characters, earliest). Most touch one.
    several = np.bincount(token, minlength=len(first))[token] > 1
    among = np.flatnonzero(several)
    order = among[np.lexsort((section[among], -overlap[among], token[among]))]
    best = np.ones(len(order), bool)
    best[1:] = token[order[1:]] != token[order[:-1]]
    return n_start, np.bincount(np.concatenate([section[~several], section[order[best]]]), minlength=len(a)), share, crossing


def lines(data: np.ndarray, nth: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines of texts that lie one after another, as sections: the text of each, and its first character and the one
    after its last. Each line has its line end, so they tile the texts. ``nth``: characters begun up to each byte."""
    after = np.union1d(nth[np.flatnonzero(data == 0x0A)], ends[ends > 0])
    return np.searchsorted(ends, after), np.concatenate([[0], after[:-1]]).astype(np.int64), after


def count(docs: DataFrame, tokenizer_path: str, sections: str | None = None, piece_bytes: int = 2 << 20) -> DataFrame:
    """A row for each section of each document: doc_id, section (from 0), start, end (characters), n_start, n_majority,
    n_share, n_crossing.

    Sections are the lines of the text or, if named, those in a column array<struct<start, end>> of ``docs``: sorted,
    not overlapping, gaps allowed (a token in a gap counts nowhere). A null or empty text has no lines, and tokens of a
    null text are none. Repeated rows each give their sections. No shuffle; the vocabulary is what is broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select("doc_id", "text", *([docs[sections].alias("sections")] if sections else []))
    shared = spark.sparkContext.broadcast(Vocabulary(load(tokenizer_path)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        size = np.array([len(b or b"") for b in shared.value.bytes], np.int64)
        for batch in pieces(batches, "text", piece_bytes):
            encoded = encoder.encode(batch.column("text").to_pylist())
            # All texts at once, one after another: a token is of one text, since the ids of each give its bytes.
            texts = Texts(batch.column("text"))
            first, after = token_spans(texts.data, np.frombuffer(b"".join(encoded), np.int32), size)
            nth = np.cumsum((texts.data & 0xC0) != 0x80)
            at = np.concatenate([[0], nth])[texts.offsets]  # where each text begins, in characters
            if sections:
                given = batch.column("sections").to_pylist()
                row = np.repeat(np.arange(len(given)), [len(x or ()) for x in given])
                a, b = (np.array([x[k] for of in given for x in of or ()], np.int64) for k in ("start", "end"))
                low, high = (at[row] + np.clip(x, 0, np.diff(at)[row]) for x in (a, b))
            else:
                row, low, high = lines(texts.data, nth, at[1:])
                a, b = low - at[row], high - at[row]
            if len(row):
                number = np.arange(len(row)) - np.searchsorted(row, row)
                values = (number, a, b, *attribute(first, after, low, high))
                columns = [pa.array(x, kind) for x, (_, kind) in zip(values, COLUMNS, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *columns], ["doc_id", *(n for n, _ in COLUMNS)])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(counted, f"doc_id {kind}, section int, start long, end long, n_start long, n_majority long, n_share double, n_crossing long")
