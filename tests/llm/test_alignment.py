"""Alignment against the libraries and plain loops."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from wardloom.llm import alignment, bpe  # noqa: E402

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
HARD = [
    None, "", " ", "   ", "a ", " a", "a  b   c    ", "a<|endoftext|>b", "<s> x </s>", "▁ mark", "x▁y", "don't", "\x00\x01", "\x1c \x85\xa0 a", "日本語テキスト", "🙂👩‍👩‍👧", "né\nà\n\n la", "a" * 3000, " " * 700,
    "1234567890" * 30, "word " * 3000, "<0x41>", "\ttab\r\n", "ſK", "ﬁ ①", "x́",
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [*HARD, *HARD[:9], *("".join(rng.choice("aabcdeth  '\n1.-=éñ日") for _ in range(120)) for _ in range(80))]
    return [(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(20, "twice"), (20, "twice")]


def brute(rows):
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    symbols = bpe.byte_symbols()
    out, pairs = [], Counter()
    for i, t in rows:
        a = first.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = second.encode(t) if t else []
        raw_a = [bytes(symbols[c] for c in first.id_to_token(x)) for x in a]
        raw_b = [bytes([second.id_to_piece(x).encode()[0]]) if False else bytes([int(second.id_to_piece(x)[3:5], 16)]) if second.is_byte(x) else second.id_to_piece(x).replace("▁", " ").encode() for x in b]
        whole = (" " + (t or "")).encode()
        if not t or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            out.append((i, 0, 0, [], []))
            continue
        ends_a = {sum(map(len, raw_a[: k + 1])): k for k in range(len(a))} if len(a) < 400 else dict(zip(np.cumsum([len(x) for x in raw_a]).tolist(), range(len(a)), strict=True))
        ends_b = dict(zip(np.cumsum([len(x) for x in raw_b]).tolist(), range(len(b)), strict=True))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, linked, pa, pb = [], [], 0, 0
        for c in cuts:
            groups.append((a[pa : ends_a[c] + 1], b[pb : ends_b[c] + 1]))
            pa, pb = ends_a[c] + 1, ends_b[c] + 1
            linked.append((a[ends_a[c]], b[ends_b[c]]))
        pairs.update(linked)
        out.append((i, len(a), len(b), groups, linked))
    most = defaultdict(int)
    for (x, y), n in pairs.items():
        most[y] = max(most[y], n)
    rows = []
    for i, n_a, n_b, groups, linked in out:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((i, n_a, n_b, len(groups), len(linked), sum(pairs[p] == most[p[1]] for p in linked), sum(pairs[p] for p in linked), hashlib.sha256(shown.encode()).hexdigest() if shown else "", shown))
    return rows


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_cross(spark, rows):
    want = brute(rows)
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, pairs string, n_best int").repartition(3)
    got = [tuple(r) for r in alignment.cross(docs, A, B).select(COLUMNS).collect()]
    assert sorted(map(repr, got)) == sorted(repr(r[:-1]) for r in want)
    assert sum(r[1] > 0 for r in want) > 80 and sum(r[1] == 0 for r in want) > 5
    full = alignment.align(docs, A, B).collect()
    assert sorted(r.groups for r in full) == sorted(r[-1] for r in want)
    # Counts that are joined, and few remembered segments, give the same.
    aligned = alignment.written(alignment.align(docs, A, B, groups=False, piece_bytes=200))
    counts = alignment.pair_counts(aligned, salts=3)
    assert counts.count() <= (bound := alignment.most_pairs(A, B)) <= alignment.MOST_PAIRS
    joined = [tuple(r) for r in alignment.score(aligned, counts, bound, most=0).select(COLUMNS).collect()]
    assert sorted(map(repr, joined)) == sorted(map(repr, got))


def test_pieces_of_segments_are_those_of_texts():
    with open(B, "rb") as f:
        few = alignment.Pieces(f.read(), remembered=3)
    assert few.apart
    texts = [t for t in HARD if t]
    for _ in range(2):
        assert few.encode(texts) == few.library.encode(texts)


def test_links_of_tokens_without_bytes():
    a, b = np.array([1, 1, 3, 6]), np.array([1, 3, 3, 5, 6, 6])
    common, group_a, group_b = alignment.cuts(a, b)
    at, x, y = alignment.links(a, b, common)
    assert common.tolist() == [1, 3, 6] and group_a.tolist() == [0, 0, 1, 2] and group_b.tolist() == [0, 1, 1, 2, 2, 2]
    assert sorted(zip(at.tolist(), x.tolist(), y.tolist(), strict=True)) == sorted((common.tolist().index(p), i, j) for i, p in enumerate(a.tolist()) for j, q in enumerate(b.tolist()) if p == q)


def test_cuts_do_not_look_for_repeats():
    rng = np.random.default_rng(1)
    a, b = (np.cumsum(rng.integers(1, 5, 400_000)) for _ in range(2))

    def seconds(f):
        start = time.process_time()
        out = f()
        return time.process_time() - start, out

    ours = [seconds(lambda: alignment.cuts(a, b)) for _ in range(3)]
    plain = [seconds(lambda: np.intersect1d(a, b)) for _ in range(3)]
    assert ours[0][1][0].tolist() == plain[0][1].tolist()
    assert min(t for t, _ in ours) < min(t for t, _ in plain)


def test_texts_that_tokens_do_not_spell():
    raw = [b" ab", b" c", b"", b" d"]
    spelling = alignment.Spelling([b" a", b"b", b"", b" c", b" d"])
    assert spelling.spell(np.array([0, 1, 2, 3, 4, 4]), step=2) == b" ab c d d"
    good = [0, 1, 2, 3, 4]
    assert alignment.spelled(spelling, np.array(good), np.array([3, 1, 0, 1]), raw).tolist() == [True] * 4
    assert alignment.spelled(spelling, np.array([0, 1, 4, 4]), np.array([2, 1, 0, 1]), raw).tolist() == [True, False, True, True]
    assert alignment.spelled(spelling, np.array([0, 1, 1, 3, 4]), np.array([3, 1, 0, 1]), raw).tolist() == [False, True, True, True]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.cross(none, A, B).count() == 0
    assert alignment.cross(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).collect()[0].n_best == 0
