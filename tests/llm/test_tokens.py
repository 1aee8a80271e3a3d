"""Token counts and BPE against the tokenizers library itself."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from wardloom.llm import bpe, token_counts  # noqa: E402

PATH = P.path("byte_bpe_50k.json")
HARD = [
    None, "", " ", "a<|endoftext|>b", "<|endoftext|>", "   \n\n x  ", "'s'S 're don't", "\x1c\x1d \x85\xa0 a", "a" * 3000, "1234567890" * 30, "===--->>>" * 20,
    "日本語テキスト", "🙂👩‍👩‍👧", "\x00\x01", "ſK", " " * 500, "word " * 5000, "né\nà la\n\nfin",
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = [*HARD, *HARD[:4], *("".join(rng.choice("aabcdeth  '\n1.-=éñ") for _ in range(150)) for _ in range(100))]
    return spark.createDataFrame([(i if i != 7 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_round_trip(spark, docs):
    library = Tokenizer.from_file(PATH)
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == library.decode(want, skip_special_tokens=False) == texts[r.doc_id]
    assert sorted(map(repr, bpe.round_trip(docs, PATH).collect())) == sorted(map(repr, got))


def test_prefix_walk_is_plain_bpe():
    v = bpe.Vocabulary(bpe.load(PATH))
    encoder = bpe.Encoder(v)

    def plain(raw):
        ids = [v.ids[bytes([b])] for b in raw]
        while True:
            best = min(((v.merges.get(p, bpe.NEVER), i) for i, p in enumerate(zip(ids[:-1], ids[1:], strict=True))), default=(bpe.NEVER, 0))
            if best[0] == bpe.NEVER:
                return ids
            i = best[1]
            ids[i : i + 2] = [v.ids[v.bytes[ids[i]] + v.bytes[ids[i + 1]]]]

    rng = random.Random(5)
    words = {"".join(rng.choice("abethin") for _ in range(rng.randrange(1, 25))) for _ in range(300)}
    encoder.learn(words)
    for w in words:
        assert memoryview(encoder.known[w]).cast("i").tolist() == plain(w.encode())


def test_decode_skips_unknown_ids(spark):
    rows = [(1, [50256, 64, 999999, -1, None]), (2, None), (3, []), (4, [127])]
    got = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()}
    assert got[1] == "<|endoftext|>a" and got[2] == got[3] == ""


def test_empty_table(spark, docs):
    none = docs.where("false")
    assert bpe.decode(bpe.encode(none, PATH), PATH).count() == 0
    assert token_counts.count(none, PATH).count() == 0


def brute(text, ids, raw, sections):
    """Counts by walking over each token and each of its characters."""
    out = [[0, 0, 0.0, 0] for _ in sections]
    begin = [0]
    for c in text:
        begin.append(begin[-1] + len(c.encode()))
    at = 0
    for i in ids:
        span = [k for k in range(len(text)) if begin[k] < at + len(raw[i]) and begin[k + 1] > at]
        at += len(raw[i])
        inside = [sum(a <= k < b for k in span) for a, b in sections]
        for s, (a, b) in enumerate(sections):
            out[s][0] += a <= span[0] < b
            out[s][2] += inside[s] / len(span)
            out[s][3] += 0 < inside[s] < len(span)
        if max(inside):
            out[inside.index(max(inside))][1] += 1
    return out


def test_token_counts(spark, docs):
    v = bpe.Vocabulary(bpe.load(PATH))
    library = Tokenizer.from_file(PATH)
    small = docs.where("length(text) < 400")
    got = {}
    for r in token_counts.count(small.where("doc_id IS NOT NULL"), PATH).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append(r)
    for r in small.where("doc_id IS NOT NULL").collect():
        if not r.text:
            assert r.doc_id not in got
            continue
        ids, rows = library.encode(r.text, add_special_tokens=False).ids, got[r.doc_id]
        assert rows[0].start == 0 and rows[-1].end == len(r.text) and all(a.end == b.start for a, b in zip(rows[:-1], rows[1:], strict=True))
        for x, (s, m, f, c) in zip(rows, brute(r.text, ids, v.bytes, [(x.start, x.end) for x in rows]), strict=True):
            assert (x.n_start, x.n_majority, x.n_crossing) == (s, m, c) and abs(x.n_share - f) < 1e-9
        assert sum(x.n_start for x in rows) == sum(x.n_majority for x in rows) == len(ids)


def test_given_sections(spark):
    rows = [(1, "one two three four", [(0, 5), (8, 14)]), (2, "né", []), (3, None, [(0, 1)]), (4, "ab", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:int,end:int>>")
    got = [(r.doc_id, r.section, r.n_start, r.n_majority, r.n_crossing) for r in token_counts.count(docs, PATH, "parts").orderBy("doc_id", "section").collect()]
    # tokens: "one" [0,3), " two" [3,7), " three" [7,13), " four" [13,18)
    assert got == [(1, 0, 2, 2, 1), (1, 1, 1, 2, 2), (3, 0, 0, 0, 0)]


def test_parts_between_spaces():
    """Parts of texts are kept with the space before them; white space in any place leads to the library's ids."""
    library, encoder = Tokenizer.from_file(PATH), bpe.Encoder(bpe.Vocabulary(bpe.load(PATH)), most_words=50)
    rng, some = random.Random(8), ["a", "th", "é", "日", ".", ",", "'s", "'", " ", " ", "  ", "\n", "\t", "\x85", "\xa0", "1", "22", "<|endoftext|>", "\x1c", "🙂", "word", "word,", "\x1c "]
    for _ in range(30):
        texts = ["".join(rng.choices(some, k=rng.randrange(25))) for _ in range(60)]
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert memoryview(ids).cast("i").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_tokens_are_found_without_probing():
    """Each byte leads to the tokens that end there: at most one step for each of them, however long the vocabulary's are."""
    v = bpe.Vocabulary(bpe.load(PATH))
    rng = random.Random(2)
    for _ in range(300):
        raw = "".join(rng.choice(["in", "g", "th", "e", "tion", "é", "==", " "]) for _ in range(8)).encode()
        node = 0
        for i, byte in enumerate(raw):
            node, found = v.move(node, byte), []
            t = v.token[node]
            while t is not None:
                found.append(v.bytes[t])
                t = v.shorter[t]
            assert found == [x for j in range(i + 1) if (x := raw[j : i + 1]) in v.ids]


def test_sections_of_many_texts_at_once(spark):
    """Sections beyond a text's end, empty ones and null texts count nothing of the next text."""
    rows = [(1, "né à", [(0, 2), (2, 9), (9, 40)]), (2, None, [(0, 3)]), (3, "日本語テキスト", [(1, 1), (2, 5)]), (4, "", [(0, 9)]), (5, "one two", [(-3, 1), (1, 1), (5, 7)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:int,end:int>>").coalesce(1)
    v, library = bpe.Vocabulary(bpe.load(PATH)), Tokenizer.from_file(PATH)
    got = token_counts.count(docs, PATH, "parts").collect()
    assert [(r.doc_id, r.section, r.start, r.end) for r in got] == [(d, i, *x) for d, _, parts in rows for i, x in enumerate(parts)]
    for d, text, parts in rows:
        whole = [(max(a, 0), min(b, len(text or ""))) for a, b in parts]
        want = brute(text or "", library.encode(text or "", add_special_tokens=False).ids, v.bytes, whole)
        for r, (s, _, f, _), (a, b) in zip([r for r in got if r.doc_id == d], want, whole, strict=True):
            assert a >= b or (r.n_start == s and abs(r.n_share - f) < 1e-9)
