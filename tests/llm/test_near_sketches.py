"""The pairs that sketches leave, and packed signatures, against plain loops."""

import numpy as np
import pytest

from wardloom.llm import jaccard


@pytest.mark.parametrize("words", [1, 2, 16])
@pytest.mark.parametrize("ratio", [(8, 10), (9, 10)])
def test_near_sketches(words, ratio):
    r = np.random.default_rng(words)
    base = [r.integers(0, 1 << 62, 40).astype(np.uint64) for _ in range(12)]
    sets = [np.unique(np.concatenate([x[r.random(40) < 0.95], r.integers(0, 1 << 62, k % 6).astype(np.uint64)])) for k in range(20) for x in base]
    size, component = np.array([len(x) for x in sets]), r.integers(0, 60, len(sets))
    sketch, side = jaccard._parities(sets, words), r.integers(1, 3, len(sets))
    want = set()
    for i in np.flatnonzero(side == 1).tolist():
        for j in np.flatnonzero(side == 2).tolist():
            fits = min(size[i], size[j]) * ratio[1] >= max(size[i], size[j]) * ratio[0]
            distance = sum(int(x).bit_count() for x in sketch[i] ^ sketch[j])
            if fits and component[i] != component[j] and distance * sum(ratio) <= (size[i] + size[j]) * (ratio[1] - ratio[0]):
                want.add((i, j))
    left, right = jaccard.near_sketches(sketch, size, component, np.flatnonzero(side == 1), np.flatnonzero(side == 2), *ratio)
    assert want and set(zip(left.tolist(), right.tolist(), strict=True)) == want and len(left) == len(want)


def test_packed_signatures():
    r = np.random.default_rng(1)
    who = np.sort(r.integers(-5, 1 << 40, 50).repeat(3))
    key = r.integers(0, 1 << 63, len(who)).astype(np.uint64) * np.uint64(2)
    got, ids = jaccard._unpacked(jaccard._packed(key, who))
    assert (ids == who).all() and (got == key % np.uint64(1 << 48)).all()


def test_small_tiles_and_narrow_blocks(spark):
    """A cluster that falls into many blocks of bytes, and sets that meet many others in several tiles."""
    import random

    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        words = list(base)
        for k in rng.sample(range(60), rng.randrange(0, 4)):
            words[k] = f"x{rng.randrange(5)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"y{rng.randrange(30)}" for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.join(docs, 3, 9, 10, tile_rows=5, block_bytes=1, block_rows=200).collect()}
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in range(len(sets))}


def test_segments_without_shingles():
    """Sets that share no shingle share no signature, unless they are thin in many segments; similar ones always do."""
    r = np.random.default_rng(4)
    band = jaccard.allocate(12, 120, 50_000, 8, 10)
    assert band.slack > 0
    sets = [np.unique(r.integers(0, 1 << 63, int(r.integers(96, 121))).astype(np.uint64)) for _ in range(1500)]
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    docs, signatures = band.signatures(np.concatenate(sets), doc, len(sets))
    _, inverse, counts = np.unique(signatures, return_inverse=True, return_counts=True)
    assert len(np.unique(docs[counts[inverse] > 1])) <= 0.02 * len(sets)
    for x in (*sets[:200], *(s[:n] for n in (1, 5, 30, 77) for s in sets[:20])):  # thin ones too
        k = int(r.integers(0, band.allowed + 1))
        gone = min(int(r.integers(0, k + 1)), len(x) - 1)
        y = np.concatenate([x[gone:], r.integers(0, 1 << 63, k - gone).astype(np.uint64)])
        both = [set(band.signatures(np.sort(s), np.zeros(len(s), np.int64), 1)[1].tolist()) for s in (x, y)]
        assert both[0] & both[1]


def test_shingles_that_many_hold():
    """A passage that all sets hold brings unlike ones together where it is not known as common; similar ones always meet."""
    r = np.random.default_rng(5)
    line = np.sort(r.integers(0, 1 << 63, 12).astype(np.uint64))
    band = jaccard.allocate(12, 120, 50_000, 8, 10)
    sets = [np.unique(np.concatenate([line, r.integers(0, 1 << 63, int(r.integers(90, 108))).astype(np.uint64)])) for _ in range(1000)]
    doc, met = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), []
    for common in (jaccard.NONE, line):
        docs, signatures = band.signatures(np.concatenate(sets), doc, len(sets), common)
        _, inverse, counts = np.unique(signatures, return_inverse=True, return_counts=True)
        met.append(len(np.unique(docs[counts[inverse] > 1])))
    assert met[1] * 5 < met[0]
    for loose in (0, 4, 20):
        band = jaccard.Band(3, 20, 30, loose)
        for x in (*sets[:60], *(np.sort(np.append(line[:k], s[:k])) for k in (1, 4, 9) for s in sets[:20])):
            k = int(r.integers(0, 21))
            gone = min(int(r.integers(0, k + 1)), len(x) - 1)
            y = np.concatenate([r.permutation(x)[gone:], r.integers(0, 1 << 63, k - gone).astype(np.uint64)])
            both = [set(band.signatures(np.unique(s), np.zeros(len(np.unique(s)), np.int64), 1, line)[1].tolist()) for s in (x, y)]
            assert both[0] & both[1]
