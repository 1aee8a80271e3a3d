"""The composed transducers against the meaning of each mark, word by word; and the model against a plain scorer."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardloom.llm import grammar, langid, toxicity

rng = random.Random(9)


def plain(symbols, weights):
    """The events and weight of a clause by looking around each word."""
    out, total = [], 0.0
    reported = "R" in symbols
    for i, x in enumerate(symbols):
        if x not in "IV":
            continue
        targeted = "T" in symbols[max(0, i - 4) : i] or "T" in symbols[i + 1 : i + 4]
        if x == "V" and not targeted:
            continue
        negated = "N" in symbols[max(0, i - 3) : i]
        marks = [m for m, on in (("targeted", targeted), ("negated", negated), ("reported", reported)) if on]
        out.append((i, "_".join(["insult" if x == "I" else "threat", *marks])))
        total += (weights[i] if x == "I" else 1.0) + sum({"targeted": 0.5, "negated": -0.75, "reported": -0.5}[m] for m in marks)
    return total, out


def test_composition_against_looking_around():
    cascade, kinds = grammar.abuse(), set()
    for _ in range(4000):
        symbols = rng.choices("TNRVI.", (1, 1, 0.3, 1, 1, 4), k=rng.randrange(1, 14))
        weights = [rng.random() * 2 for _ in symbols]
        total, found = cascade.best(symbols, weights)
        want_total, want = plain(symbols, weights)
        assert [(i, grammar.name(y)) for i, y in found] == want, symbols
        assert math.isclose(total, want_total, abs_tol=1e-9)
        kinds.update(k for _, k in want)
    assert kinds == set(grammar.EVENTS)


def test_arcs_are_bounded():
    cascade = grammar.abuse()
    for _ in range(3000):
        symbols = rng.choices("TNRVI.", k=30)
        cascade.best(symbols, [1.0] * 30)
    assert len(cascade._arcs) < 60_000


def test_scores_against_a_plain_scorer(spark):
    words = "you are a not said grumble kill the old house it was near".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) + rng.choice([".", "!", "; and", '"x"']) for _ in range(300)] + ["x " * 200_000 + "you grumble", None, ""]
    model = toxicity.Model({"=grumble": 1.25, "hous": 0.4}, toxicity.np.linspace(-1, 2, len(toxicity.FEATURES) + 1))
    frame = spark.createDataFrame([(i, t, "clash", 0.5, "en") for i, t in enumerate(texts)], "doc_id long, text string, events string, score double, lang string")
    for r in toxicity.score(frame, model).collect():
        sums, strongest, whole, kinds = Counter(), 0.0, 0.0, []
        text = texts[r.doc_id] or ""
        for n, clause in enumerate(toxicity.CLAUSE.split(text)):
            symbols, weights = (["R"], [0.0]) if clause.count('"') >= 2 else ([], [])
            for w in toxicity.WORD.findall(clause.lower()):
                lex = 1.25 if w == "grumble" else 0.4 if w.startswith("hous") else 0.0
                symbols.append("T" if w == "you" else "N" if w == "not" else "R" if w == "said" else "V" if w == "kill" else "I" if lex else ".")
                weights.append(lex or 1.0)
            total, found = plain(symbols, weights)
            for i, kind in found:
                sums[kind] += weights[i]
                kinds.append((kind, n))
            if found:
                strongest, whole = max(strongest, total), whole + max(total, 0.0)
        x = [math.log1p(sums[k]) for k in grammar.EVENTS] + [math.log1p(strongest), whole / max(1, sum(bool(c.strip()) for c in toxicity.CLAUSE.split(text)))]
        z = sum(a * b for a, b in zip(x, model.weights, strict=False)) + model.weights[-1]
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9) and r.predicted == int(r.score >= 0.5)
        assert [(e.kind, e.clause) for e in r.events] == kinds


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, toxic int, n long, h long")
    labels = spark.createDataFrame([(1, 1, "t")], "doc_id long, toxic int, text string")
    assert toxicity.score(docs, None).count() == 0
    model = toxicity.fit(docs, labels, F.lit(True))
    assert toxicity.score(docs, model).count() == 0
    some = spark.createDataFrame([(1, "you", 1, 2, 3), (1, "you", 1, 2, 3), (None, None, None, None, None)], docs.schema)
    assert toxicity.score(some, toxicity.fit(some, labels, F.lit(True))).count() == 3


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = langid.fold("doc_id", 5) == 0
    scored = toxicity.score(docs, toxicity.fit(docs, labels, ~held)).where(held).join(labels.where("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id")
    right = scored.groupBy("toxic").agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int")).alias("right")).collect()
    assert all(r.right > 0.85 for r in right), right
