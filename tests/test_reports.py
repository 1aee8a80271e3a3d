"""Report scores against tables of prefixes and counting in plain Python; hard values."""

import math
import random
from collections import Counter

import pytest

from wardloom.operators import reports as R

rng = random.Random(12)


def prefixes(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def clipped(a, b, n):
    runs = [Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (a, b)]
    return sum(min(c, runs[1][k]) for k, c in runs[0].items())


def test_numbers_against_plain_tables():
    for _ in range(400):
        a, b = ([rng.choice("abcde"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert R.longest_common(a, b) == prefixes(a, b)
        assert [R.common_runs(a, b, n) for n in range(1, 5)] == [clipped(a, b, n) for n in range(1, 5)]


def test_long_texts():
    a = [str(rng.randrange(50)) for _ in range(4000)]
    b = [w for w in a if rng.random() < 0.7]
    assert R.longest_common(a, b) == len(b) and R.longest_common(a, a) == len(a)


def test_pairs_with_hard_values(spark):
    rows = [
        (1, "No Pneumothorax, no effusion.", "no effusion; no pneumothorax", "x"), (2, None, "lungs", None), (3, "lungs", None, "x"), (4, "", "...", "x"), (5, None, None, None),
        (6, "Éte ÉTÉ 3", "été 3", "x"), (7, "same words here now", "same words here now", "x"), (7, "same words here now", "same words here now", "x"), (None, "a " * 5000, "a b", "x"),
    ]
    pairs = spark.createDataFrame(rows, "id long, said string, `made.up` string, common_ string").withColumnRenamed("common_", "n")
    got = sorted(R.pair_scores(pairs, "said", "made.up").collect(), key=lambda r: (r.id or 0, r.n or ""))
    assert [(r.id, r.n_reference, r.n_hypothesis, r.common, r.match_1, r.match_2) for r in got] == [
        (None, 5000, 2, 1, 1, 0), (1, 4, 4, 2, 4, 2), (2, 0, 1, 0, 0, 0), (3, 1, 0, 0, 0, 0), (4, 0, 0, 0, 0, 0), (5, 0, 0, 0, 0, 0), (6, 3, 2, 2, 2, 1), (7, 4, 4, 4, 4, 3), (7, 4, 4, 4, 4, 3),
    ]
    assert [r.rouge_l for r in got if r.id in (4, 5, 7)] == [0.0, 0.0, 1.0, 1.0] and got[0]["made.up"] == "a b"
    assert R.pair_scores(pairs.where("id > 100"), "said", "made.up").count() == 0


def corpus(chosen):
    """n, rouge_l and bleu_1 to bleu_4 of pairs of lists of words."""
    n, refs, hyps = len(chosen), sum(len(a) for a, _ in chosen), sum(len(b) for _, b in chosen)
    rouge = sum(2 * prefixes(a, b) / (len(a) + len(b)) for a, b in chosen) / n
    shares = [sum(clipped(a, b, k) for a, b in chosen) / max(1, sum(max(0, len(b) - k + 1) for _, b in chosen)) for k in range(1, 5)]
    brevity = math.exp(min(0.0, 1 - refs / hyps))
    return [n, rouge] + [brevity * math.prod(shares[:k]) ** (1 / k) if min(shares[:k]) else 0.0 for k in range(1, 5)]


def test_corpus_scores_and_draws(spark):
    words = "the lungs are clear no focal opacity or effusion seen heart size normal".split()
    raw = []
    for i in range(60):
        a = [rng.choice(words) for _ in range(rng.randrange(4, 25))]
        b = [w for w in a if rng.random() < 0.8] + [rng.choice(words) for _ in range(rng.randrange(1, 6))]
        raw.append((i % 7, a, b))
    rows = [(g, f"TECHNIQUE: two views.\nFINDINGS: {' '.join(a)}.\n", f"**{' '.join(b)}**") for g, a, b in raw]
    rows += [(3, "FINDINGS: a", " \t"), (99, None, "lungs"), (98, "FINDINGS: b", None)]  # nothing to score
    pairs = spark.createDataFrame(rows, "patient long, group string, `the.text` string")
    got = {r.bootstrap: r for r in R.report_scores(pairs, "group", "the.text", "patient", 6).collect()}
    assert sorted(got) == [-1, 0, 1, 2, 3, 4, 5]
    assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip([got[-1].n, *(got[-1][m] for m in R.PANEL)], corpus([(a, b) for _, a, b in raw]), strict=True))
    by = {g: [(a, b) for h, a, b in raw if h == g] for g in range(7)}
    places = {r.place: r.patient for r in R.E._ranked(pairs.where("patient < 90"), "patient", 0)[0].collect()}
    import hashlib

    for draw in range(6):
        picked = [places[int(hashlib.md5(f"{draw}:{slot}:0".encode()).hexdigest()[:13], 16) % 7 + 1] for slot in range(7)]
        want = corpus([p for g in picked for p in by[g]])
        assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip([got[draw].n, *(got[draw][m] for m in R.PANEL)], want, strict=True))


def test_nothing_to_score_and_null_groups(spark):
    pairs = spark.createDataFrame([("p", " ", "x"), ("q", None, None)], "patient string, ref string, hyp string")
    assert R.report_scores(pairs, "ref", "hyp", "patient", 3).collect() == []
    assert R.report_scores(pairs.where("false"), "ref", "hyp", "patient").collect() == []
    with pytest.raises(Exception, match="patient"):
        R.report_scores(spark.createDataFrame([(None, "a", "b"), ("p", "a", "b")], pairs.schema), "ref", "hyp", "patient").collect()


def test_words_that_never_match(spark):
    pairs = spark.createDataFrame([("p", "alpha beta", "gamma delta")], "patient string, ref string, hyp string")
    row = R.report_scores(pairs, "ref", "hyp", "patient").first()
    assert [row[m] for m in R.PANEL] == [0.0] * 5 and row.n == 1
