"""What the toxicity model learns, against plain counting; the signs that its fit holds; words of harm."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardloom.llm import grammar, toxicity

rng = random.Random(4)
PLAIN = [a + b for a in "ba ce di fo gu la me ni".split() for b in "rtol nsem ldin".split()]


def corpus():
    """Texts of plain words; toxic ones hold an insult, a word with a common stem, or a word of harm near a target."""
    out = []
    for i in range(600):
        words, toxic = [rng.choice(PLAIN) for _ in range(rng.randrange(6, 30))], int(i % 4 == 0)
        if toxic:
            words[rng.randrange(len(words))] = ("pathetic", "grumb" + rng.choice("aeiouy") + "x", f"you {rng.choice(PLAIN)} squash")[i // 4 % 3]
        elif i % 4 == 1:
            words[0] = "squash"  # harmless where nobody is named
        elif i % 4 == 2:
            words[0], words[-1] = "path", rng.choice(("you", "not", "said"))
        out.append((i, " ".join(words) + rng.choice((".", "! And so on.", "")), toxic))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1, rows[1][1], "y"), (None, None, None), (9000, "", "z"), (9001, None, "z")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y, "t") for i, _, y in rows] + [(5, None, None), (None, 1, None), (9000, 0, None)], "doc_id long, toxic int, text string")
    return rows, toxicity.fit(docs, labels, F.lit(True))


def value(model, text):
    return float(model.score(model.features(text, model.finder(), grammar.abuse())[0]))


def test_lexicon_against_counting(learned):
    rows, model = learned
    texts = [(set(toxicity.WORD.findall(t.lower())), toxicity.aimed(t.lower()), y) for _, t, y in rows] + [(set(), set(), 0)]
    bad = sum(y for *_, y in texts)
    good = len(texts) - bad
    keys = [({k for w in words for k in toxicity.lexicon_keys(w)} | {"~" + w for w in near}, y) for words, near, y in texts]
    kept = {}
    for k in set().union(*(s for s, _ in keys)):
        a, b = sum(k in s and y for s, y in keys), sum(k in s and not y for s, y in keys)
        odds = math.log((a + 0.5) / (bad + 1)) - math.log((b + 0.5) / (good + 1))
        g = sum(2 * n * math.log(n / ((a + b) * p)) for n, p in ((a, bad / len(texts)), (b, good / len(texts))) if n)
        forms = {w for words, _, y in texts if y for word in words for w in toxicity.bases(word) if w.startswith(k)}
        if a >= 3 and odds >= 2.5 and g >= 24 and (k[0] in "=~" or len(forms) >= 5):
            kept[k] = odds / 5 * a / (a + 20)
    best = {k: v for k, v in kept.items() if k[0] != "~"}
    want = {k: v for k, v in best.items() if not any(best.get(s, -9) >= v - 1e-9 for s in toxicity.lexicon_keys(k.lstrip("="))[1:] if s != k)}
    assert model.insult.keys() == want.keys() and all(math.isclose(model.insult[k], want[k]) for k in want)
    assert model.harm == {k[1:] for k in kept if k[0] == "~" and not any(x in best for x in toxicity.lexicon_keys(k[1:]))}
    assert "=pathetic" in model.insult and "grum" in model.insult and "path" not in model.insult and "squash" in model.harm


def test_signs(learned):
    _, model = learned
    plain, negated, reported, targeted = (value(model, t + " It is so. We go on.") for t in ("That was a pathetic move.", "That was not a pathetic move.", 'He wrote that it was a pathetic move.', "You made a pathetic move."))
    assert negated < plain < targeted and reported < value(model, "He thought that it was a pathetic move. It is so. We go on.")
    assert value(model, "The man was close to a path.") < 0.5 < plain
    assert value(model, "We squash it.") > 0.5 > value(model, "A squash grows. It is good.") and value(model, "They were killing me.") > 0.5
    kind = dict(zip(toxicity.FEATURES, model.weights, strict=False))
    assert all((v < 0) == ("negated" in k or "reported" in k) for k, v in kind.items())


def test_fit_is_the_least_loss():
    """No free size has a gradient left, and no size at its floor wants to grow."""
    x = np.array([[rng.random() * rng.randrange(2) for _ in toxicity.FEATURES] for _ in range(300)])
    y = np.array([float(rng.random() < 1 / (1 + math.exp(-3 * r[0] + 2 * r[2] + 1))) for r in x])
    n = np.array([float(rng.randrange(1, 4)) for _ in y])
    w = toxicity._logistic(x, y, n)
    sizes = np.append(np.linalg.lstsq(toxicity.SIGNS, w[:-1], rcond=None)[0], w[-1])
    full = np.column_stack([x @ toxicity.SIGNS, np.ones(len(x))])
    gradient = full.T @ (n * (1 / (1 + np.exp(-full @ sizes)) - y)) + 1e-2 * np.array([*[1.0] * 5, 1e-6]) * sizes
    assert (sizes[:-1] >= toxicity.FLOOR - 1e-9).all()
    assert all(abs(g) < 1e-4 or (g > 0 and abs(s - toxicity.FLOOR) < 1e-9) for g, s in zip(gradient, sizes, strict=True))


def test_repeated_ids_do_not_grow_the_sample(spark):
    docs = spark.createDataFrame([(i % 3, "you pathetic thing") for i in range(300)] + [(7, "a plain thing")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True), ratio=0.0, margin=0.1)
    assert model.insult and all(v <= math.log((3.5 / 4) / (0.5 / 2)) / 5 * 3 / 23 + 1e-9 for v in model.insult.values())
