"""Byte-level BPE encoding and decoding.

Encoding uses a property of BPE: the encoding of a prefix of a word is known from its last token, for the rest is the
encoding of a shorter prefix. The distinct words of a piece of text are put in a trie, held as their sorted list:
neighbours in it share a path from the root. A depth-first walk keeps one last token for each byte of the current path,
so the encoding of a shared prefix is worked out once, and the walk needs no more memory than its longest word.

The tokens that end at a byte are found by the trie of the vocabulary, whose nodes lead on to their longest suffix there. A
token ends a prefix if it may follow the last token of what is left: no merge may cross the border between the two
before either is complete. That is decided once for each pair of tokens and kept.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import pieces, small_batches

NEVER = 1 << 60
_MARKS = (".", ",", ";", ":", "!", "?")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def _ranges(kind: str) -> str:
    """The characters of a Unicode category as ranges of a class: a plain class is matched faster than a property."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    return "".join(f"\\U{ord(x[0][0]):08x}-\\U{ord(x[0][-1]):08x}" for x in regex.finditer(rf"\p{{{kind}}}+", every))


@cache
def splitter() -> re.Pattern:
    """The words of a byte-level tokenizer, with the classes of letters, numbers and spaces written out."""
    letter, number, space = _ranges("L"), _ranges("N"), _ranges("White_Space")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Vocabulary:
    """The tables of a byte-level tokenizer file: token bytes by id, ranked merges, and tokens matched before any other."""

    def __init__(self, text: str):
        file = json.loads(text)
        before, model = file["pre_tokenizer"], file["model"]
        plain = before["type"] == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if not plain or file.get("normalizer") or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("not a plain byte-level BPE file")
        symbols = byte_symbols()
        raw = lambda s: bytes(symbols[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        self.added = {}
        for x in file.get("added_tokens", []):
            if x["single_word"] or x["lstrip"] or x["rstrip"]:
                raise ValueError(f"added token {x['content']!r}: only plain matching is supported")
            self.added[x["content"]] = x["id"]
        self.merges, self.rank, self.halves = {}, {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = raw(a), raw(b)
            made, pair = self.ids[a + b], (self.ids[a], self.ids[b])
            self.merges[pair] = rank
            self.rank[made], self.halves[made] = rank, pair
        size = 1 + max([*self.ids.values(), *self.added.values()])
        self.bytes = [None] * size
        for b, i in [*self.ids.items(), *((s.encode(), i) for s, i in self.added.items())]:
            self.bytes[i] = b

        # The trie of the tokens' bytes: next node by node and byte, and the token at a node or the longest that ends there.
        self.next, self.token, depth = {}, [None], [0]
        for b, i in self.ids.items():
            node = 0
            for x in b:
                key = node << 8 | x
                if (node := self.next.get(key)) is None:
                    node = self.next[key] = len(depth)
                    depth.append(depth[key >> 8] + 1)
                    self.token.append(None)
            if node:
                self.token[node] = i
        self.fail, self.shorter = [0] * len(depth), [None] * size
        for key, node in sorted(self.next.items(), key=lambda x: depth[x[1]]):
            back = self.fail[node] = self.move(self.fail[key >> 8], key & 255) if key >> 8 else 0
            if (t := self.token[node]) is None:
                self.token[node] = self.token[back]
            else:
                self.shorter[t] = self.token[back]

    def move(self, node: int, byte: int) -> int:
        """The node of the longest suffix that tokens begin with, after one byte more."""
        while (to := self.next.get(node << 8 | byte)) is None:
            if not node:
                return 0
            node = self.fail[node]
        return to

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces on one edge of a token while it grows, each with the rank at which it is merged into the next."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in self.halves:
                return out
            until, token = self.rank[token], self.halves[token][side]


class Encoder:
    """Encodes words by a walk over the trie of the distinct ones. One for each task; its memory is bounded."""

    def __init__(self, vocabulary: Vocabulary, most_words: int = 400_000, most_pairs: int = 500_000):
        self.v, self.most_words, self.most_pairs = vocabulary, most_words, most_pairs
        self.known: dict[str, bytes] = {}
        #: The ids of what stands between two spaces, with the space before it; None where more white space follows.
        self.spaced: dict[str, bytes | None] = {}
        self.fits: dict[int, bool] = {}
        self.moves: dict[int, int] = {}
        self.left: dict[int, list] = {}
        self.right: dict[int, list] = {}
        self.size = [len(b) if b else 0 for b in vocabulary.bytes]
        whole = sorted(vocabulary.added, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, whole)) + ")") if whole else None
        self.added_ids = {s: np.int32(i).tobytes() for s, i in vocabulary.added.items()}

    def follows(self, u: int, t: int) -> bool:
        """Whether the bytes of u and then t encode to u, t: no merge crosses the border while both sides are there."""
        key = u << 20 | t
        if (known := self.fits.get(key)) is not None:
            return known
        if len(self.fits) > self.most_pairs:
            self.fits.clear()
        v = self.v
        a = self.right.get(u) or self.right.setdefault(u, v.edge(u, 1))
        b = self.left.get(t) or self.left.setdefault(t, v.edge(t, 0))
        crossed = False
        for p, until_p in a:
            for q, until_q in b:
                # Of merges of one rank the leftmost is made first: u's own before the crossing one, that before t's own.
                if (r := v.merges.get((p, q), NEVER)) < until_p and r <= until_q and r < NEVER:
                    crossed = True
        self.fits[key] = not crossed
        return not crossed

    def learn(self, words: set[str]) -> None:
        """Adds the encodings of these words, by a depth-first walk over their trie."""
        v, known, size, follows = self.v, self.known, self.size, self.follows
        token, shorter, moved, fits, pack = v.token, v.shorter, self.moves.get, self.fits.get, partial(array, "i")
        if len(self.moves) > self.most_pairs:
            self.moves.clear()
        # Of the first i bytes of the path: last[i], its last token, and nodes[i], the longest suffix that tokens begin with.
        before, last, nodes = b"", [-1], [0]
        for word in sorted(words):  # in the order of their bytes, too
            raw = word.encode()
            n, shared = len(raw), 0
            most = min(n, len(before))
            if raw[:most] == before[:most]:
                shared = most
            else:
                while raw[shared] == before[shared]:
                    shared += 1
            del last[shared + 1 :], nodes[shared + 1 :]
            node = nodes[shared]
            for i in range(shared + 1, n + 1):
                key = node << 8 | raw[i - 1]
                if (node := moved(key)) is None:
                    node = self.moves[key] = v.move(key >> 8, key & 255)
                t = token[node]
                while t is not None:
                    if (k := size[t]) == i:
                        break
                    u = last[i - k]
                    fit = fits(u << 20 | t)
                    if follows(u, t) if fit is None else fit:
                        break
                    t = shorter[t]
                else:
                    raise ValueError(f"the vocabulary cannot encode {raw[:i]!r}")
                last.append(t)
                nodes.append(node)
            out, i = [], n
            while i:
                out.append(t := last[i])
                i -= size[t]
            out.reverse()
            known[word] = pack(out).tobytes()
            before = raw

    def space(self, fresh: set[str]) -> None:
        """Adds the encodings of these parts of texts between spaces. Each is split by itself, with its space: a word has a
        space at its start only, but for white space before other white space."""
        find, blank, known, spaced = splitter().findall, re.compile(f"[{_ranges('White_Space')}]").match, self.known, self.spaced
        # Most are a word of plain letters, or one with a mark after it.
        plain = [x for x in fresh if x.isascii() and x.isalpha()]
        marked = [x for x in fresh.difference(plain) if x[-1:] in _MARKS and x.isascii() and x[:-1].isalpha()]
        other = {x: () if not x or blank(x) else find(" " + x) for x in fresh.difference(plain, marked)}
        words = {w for part in other.values() for w in part}
        words.update([" " + x for x in plain], [" " + x[:-1] for x in marked], _MARKS)
        self.learn(words)
        for x in plain:
            spaced[x] = known[" " + x]
        for x in marked:
            spaced[x] = known[" " + x[:-1]] + known[x[-1]]
        for x, part in other.items():
            spaced[x] = b"".join(map(known.__getitem__, part)) if part else None
        known.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers; null is the empty text."""
        if len(self.spaced) > self.most_words:
            self.spaced.clear()
        parts: list[list[list[str] | str]] = []
        fresh: set[str] = set()
        for text in texts:
            split = self.added.split(text) if text and self.added is not None else [text] if text else []
            part = [x if i % 2 else x.split(" ") for i, x in enumerate(split)]
            for x in part[::2]:
                fresh.update(x[1:])
            parts.append(part)
        self.space(fresh.difference(self.spaced))
        get, find, out, firsts = self.spaced.__getitem__, splitter().findall, [], []
        # What is before the first space, and all of a text with white space after a space, is split as a whole.
        for part in parts:
            done: list[bytes | list[str]] = []
            for i, x in enumerate(part):
                if i % 2:
                    done.append(self.added_ids[x])
                    continue
                ids = list(map(get, x[1:]))
                if None in ids:
                    done.append(find(" ".join(x)))
                    firsts.append(done[-1])
                else:
                    if x[0]:
                        done.append(find(x[0]))
                        firsts.append(done[-1])
                    done.append(b"".join(ids))
            out.append(done)
        self.learn({w for x in firsts for w in x})
        word = self.known.__getitem__
        ids = [b"".join(x if isinstance(x, bytes) else b"".join(map(word, x)) for x in done) for done in out]
        self.known.clear()
        return ids


def _lists(ids: list[bytes]) -> pa.Array:
    lengths = np.array([len(x) // 4 for x in ids], np.int64)
    values = pa.Array.from_buffers(pa.int32(), int(lengths.sum()), [None, pa.py_buffer(b"".join(ids))])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def load(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer_path: str, piece_bytes: int = 2 << 20) -> DataFrame:
    """doc_id and ids (array<int>) of each whole text, without truncation, padding or added special tokens.

    The string of a special token inside a text is that token. A null or empty text has no ids. Rows are returned one
    for one, repeated ones too; other columns are ignored. The vocabulary, read on the driver, is what is broadcast: its
    size is that of the tokenizer file. No shuffle.
    """
    spark, source = docs.sparkSession, docs.select("doc_id", "text")
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(load(tokenizer_path)))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in pieces(batches, "text", piece_bytes):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(encoder.encode(batch.column("text").to_pylist()))], ["doc_id", "ids"])

    return source.mapInArrow(encoded, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


class _Decoder:
    def __init__(self, table: list[bytes]):
        self.size = np.array([len(b) for b in table], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, column: pa.Array) -> pa.Array:
        flat = np.asarray(column.flatten().fill_null(-1), np.int64)
        bounds = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0), np.int64))])
        real = (flat >= 0) & (flat < len(self.size))
        flat, size = np.where(real, flat, 0), np.where(real, self.size[np.where(real, flat, 0)], 0)
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[flat] - ends[:-1], size) + np.arange(ends[-1])
        raw, cuts = self.data[at].tobytes(), ends[bounds]
        return pa.array([raw[a:b].decode(errors="replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.string())


def decode(encoded: DataFrame, tokenizer_path: str, piece_tokens: int = 1 << 20) -> DataFrame:
    """Adds ``decoded``: the text of ``ids``. Ids outside the vocabulary and null ids are skipped; null ids give ''.

    Bytes that are no valid UTF-8 become U+FFFD. Other columns than doc_id and ids are ignored.
    """
    spark, source = encoded.sparkSession, encoded.select("doc_id", "ids")
    small_batches(spark)
    shared = spark.sparkContext.broadcast([b or b"" for b in Vocabulary(load(tokenizer_path)).bytes])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _Decoder(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            length = np.asarray(batch.column("ids").value_lengths().fill_null(0), np.int64)
            group = (np.cumsum(length) - length) // piece_tokens
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), decoder.decode(part.column("ids"))], ["doc_id", "ids", "decoded"])

    return source.mapInArrow(decoded, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, tokenizer_path: str, piece_bytes: int = 2 << 20) -> DataFrame:
    """``decode`` of ``encode`` in one pass over the texts: doc_id, ids and decoded."""
    spark, source = docs.sparkSession, docs.select("doc_id", "text")
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(load(tokenizer_path)))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), _Decoder([b or b"" for b in shared.value.bytes])
        for batch in pieces(batches, "text", piece_bytes):
            ids = _lists(encoder.encode(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, decoder.decode(ids)], ["doc_id", "ids", "decoded"])

    return source.mapInArrow(both, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digest(decoded: DataFrame, *more: str) -> DataFrame:
    return decoded.select(
        "doc_id", *more, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
