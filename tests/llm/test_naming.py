"""Block naming against plain equality."""

import hashlib
import random
from collections import defaultdict

from wardloom.llm import naming

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not kept, hashlib.sha256(text.encode()).hexdigest()))
            kept = kept or i == keep
    return sorted(map(repr, out))


def test_dedup(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcÄé ") for _ in range(9_000))
    texts = [None, "", "", "a", "A", "Ä", "ä", "x" * 64, "X" * 64, "x" * 65, "x" * 128, "x" * 192, long, long.upper().replace("Ä", "Ä"), long[:-1], long + "b", "b" + long, long[:64], long[64:], long[:4096], long[:4096] * 2]
    texts += [rng.choice(["ab", "abc", ""]) * rng.randrange(60) for _ in range(150)] + [long[: 64 * rng.randrange(1, 9)] for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (3, "a"), (900, "a"), (900, "A"), (None, "none"), (None, "NONE"), (None, "x" * 64)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, name string, row int").repartition(5)
    for size in (64, 1024):
        got = [tuple(r) for r in naming.dedup(docs, size).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
        assert sorted(map(repr, got)) == brute(rows)


def test_names_are_equal_only_for_equal_texts(spark):
    """Sequences of blocks that differ in number, order or the size of the last one; few blocks are remembered."""
    texts = ["ab" * n for n in range(1, 40)] + ["ab" * n + "a" for n in range(40)] + ["abba" * n for n in range(1, 20)] + ["ab" * n for n in range(1, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    parts = naming.written(naming.blocks(docs, 2, remembered=2))
    ids = {r.row: r.doc_id for r in parts.where("nth = 0").collect()}
    name = {ids[r.row]: (r["round"], r.name) for r in naming.names(parts).collect()}
    assert len(name) == len(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (name[i] == name[j]) == (a == b)


def test_empty_table(spark):
    assert naming.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
