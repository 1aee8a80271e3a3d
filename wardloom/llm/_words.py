"""Vectorised word segmentation and hashing over Arrow string columns.

Every function works on the raw UTF-8 bytes of a batch with numpy, so no Python object is made for a word.
Words never cross documents; a text of any length is handled, in pieces of about a megabyte where it matters.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPLITMIX = np.uint64(0x9E3779B97F4A7C15)
#: The longest word, in bytes, that is hashed with numpy.
LONG = 128
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def separators(kind: str) -> np.ndarray:
    """Which of the 256 byte values belong to a word.

    ``space``: words are runs of anything but space and ``\\t``..``\\r``. ``alnum``: runs of ASCII letters, digits
    and every byte from 0x80 up, so that whole non-ASCII characters are word characters.
    """
    word = np.ones(256, bool)
    if kind == "space":
        word[[0x20, *range(0x09, 0x0E)]] = False
    elif kind == "alnum":
        word[:0x80] = False
        word[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
    else:
        raise ValueError(f"unknown kind of words: {kind}")
    return word


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Texts:
    """The bytes of a string column: ``data`` and, for each of ``n`` texts, ``offsets[i]:offsets[i + 1]``. Null is empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        if column.null_count:
            column = pc.fill_null(column, "")
        wide = pa.types.is_large_string(column.type)
        buffers, self.n = column.buffers(), len(column)
        if self.n == 0:
            self.offsets, self.data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
            return
        ends = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + self.n + 1].astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        self.data = data[ends[0] : ends[-1]]
        self.offsets = ends - ends[0]
        if lower:
            self.data = _LOWER[self.data]

    def words(self, word: np.ndarray) -> Words:
        inside = word[self.data]
        if not len(inside):
            none = np.zeros(0, np.int64)
            return Words(self, none, none, np.zeros(self.n + 1, np.int64))
        cut = np.zeros(len(inside) + 1, bool)
        cut[self.offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | cut[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | cut[1:-1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return Words(self, starts, ends, np.searchsorted(starts, self.offsets))


class Words:
    """Word ``i`` is ``data[starts[i]:ends[i]]``; text ``d`` has the words ``bounds[d]:bounds[d + 1]``."""

    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray):
        self.texts, self.starts, self.ends, self.bounds = texts, starts, ends, bounds

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), np.diff(self.bounds))

    def hashes(self, seed: int = 0, piece: int = 1 << 20) -> np.ndarray:
        """A 64-bit hash of each word, ``piece`` words at a time; other seeds give independent ones.

        Eight bytes at a time go through a bijection, so words of up to eight bytes and of one length never share a
        hash. The few words over ``LONG`` bytes go through BLAKE2b.
        """
        salt = int(mix64(np.array([seed + 1], np.uint64) * _SPLITMIX)[0])
        # Any eight bytes as one number, wherever they start; the data ends in eight more.
        eights = np.ndarray((len(self.texts.data) + 1,), "<u8", np.concatenate([self.texts.data, np.zeros(8, np.uint8)]), strides=(1,))
        out = np.empty(len(self.starts), np.uint64)
        for i in range(0, len(out), piece):
            s, size = self.starts[i : i + piece], self.ends[i : i + piece] - self.starts[i : i + piece]
            h = mix64(size.astype(np.uint64) * _SPLITMIX ^ np.uint64(salt))
            live, at = np.flatnonzero(size <= LONG), 0
            while len(live):
                left = np.minimum(size[live] - at, 8)
                h[live] = mix64(h[live] ^ (eights[s[live] + at] & _MASKS[left]))
                at += 8
                live = live[size[live] > at]
            for x in np.flatnonzero(size > LONG).tolist():
                digest = hashlib.blake2b(self.texts.data[s[x] : s[x] + size[x]], digest_size=8, key=salt.to_bytes(8, "little")).digest()
                h[x] = int.from_bytes(digest, "little")
            out[i : i + piece] = h
        return out

    def bytes_of(self, i: int, j: int) -> bytes:
        """The words i to j - 1, joined by one space."""
        data = self.texts.data
        return b" ".join(data[s:e].tobytes() for s, e in zip(self.starts[i:j], self.ends[i:j], strict=True))

    def kept(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts made of the kept words joined by one space: their bytes and offsets."""
        data, n = self.texts.data, len(self.texts.data)
        s, e, d = self.starts[keep], self.ends[keep], self.doc()[keep]
        step = np.zeros(n + 1, np.int8)
        step[s] += 1
        step[e] -= 1
        take = np.cumsum(step[:n], dtype=np.int8).astype(bool)
        joint = s[1:][d[1:] == d[:-1]] - 1  # words of one text have a separator between them
        data = data.copy()
        data[joint] = 0x20
        take[joint] = True
        return data[take], np.concatenate([[0], np.cumsum(take)])[self.texts.offsets]


def windows(hashes: np.ndarray, bounds: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of n words inside one text: the sum of the words' hashes, each times
    a random odd number of its place."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    times = mix64(np.arange(1, n + 1, dtype=np.uint64) * _SPLITMIX + np.uint64(seed)) | np.uint64(1)
    last = len(hashes) - n + 1
    h = hashes[:last] * times[0]
    for k in range(1, n):
        h += hashes[k : k + last] * times[k]
    room = np.repeat(bounds[1:], np.diff(bounds))[:last]
    whole = np.arange(last) + n <= room
    return np.flatnonzero(whole), mix64(h[whole])


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text and at most ``rows`` rows; a longer text is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        length = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        group = (np.cumsum(length) - length) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for c in range(a, b, rows):
                yield batch.slice(c, min(rows, b - c))
    release()


def release() -> None:
    """Gives back what a task has freed, where the C library can: a worker waits for its next task with little."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold 8 MB at most in this session, where it has the default, 64 MB: both sides hold several."""
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, "8m")


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow string column over these bytes."""
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())
