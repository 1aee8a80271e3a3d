"""Prediction and rejection against plain dictionaries, and rows with odd columns."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wardloom.llm import langid

rng = random.Random(4)
WORDS = {"aa": ["kala", "mira", "tola", "sume"], "bb": ["strix", "blonk", "grund", "ploff"], "cc": ["éàé", "ùîè", "çôé", "œuï"]}


def plain_grams(text, dims):
    """The n-grams of a text by themselves: bytes, A-Z lower-cased, other ASCII as a border, runs of borders left out."""
    line = [32, *(b if b >= 128 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in text.encode()), 32]
    out = Counter()
    for i in range(len(line) - 1):
        two = line[i] << 8 | line[i + 1]
        if two != (32 << 8 | 32):
            out[(two * 0x85EBCA77 % 2**32 ^ two >> 5) % dims] += 1
    for i in range(len(line) - 2):
        if line[i : i + 3] != [32, 32, 32]:
            three = line[i] << 16 | line[i + 1] << 8 | line[i + 2]
            out[(three * 0x9E3779B1 % 2**32 ^ three >> 7) % dims] += 1
    return out


def texts():
    out = [(i, " ".join(rng.choice(WORDS[x]) for _ in range(rng.randrange(1, 60))), x) for i, x in enumerate(["aa", "bb", "cc"] * 60)]
    return out + [(900, "", None), (901, None, "aa"), (902, "kala", None), (903, "qwv zzx", None), (904, "".join(chr(0x4E00 + i) for i in range(300)), None), (905, "kala mira " * 40_000, None)]


def test_nearest_centroid_by_hand(spark):
    rows = texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame, F.lit(True), dims=1024, per_language=40)
    assert len(set(model.language.tolist())) == 3
    got = {r.doc_id: r for r in langid.predict(frame, model).collect()}
    for i, text, _ in rows:
        if not text:
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        x = {d: (1 + math.log(n)) * float(model.idf[d]) for d, n in plain_grams(text, 1024).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        cosine = [sum(v * float(c[d]) for d, v in x.items()) / norm for c in model.centroids]
        best = max(range(len(cosine)), key=cosine.__getitem__)
        assert got[i].lang_pred == model.languages[model.language[best]]
        assert math.isclose(got[i].score, min(1.0, cosine[best]), abs_tol=1e-4)
        least = model.radius[best][min(int(math.log2(len(x))), model.radius.shape[1] - 1)]
        assert got[i].rejected == (cosine[best] < least) or abs(cosine[best] - least) < 1e-4


def test_short_junk_goes_and_short_words_stay(spark):
    frame = spark.createDataFrame(texts(), "doc_id long, text string, lang string")
    model = langid.fit(frame, F.lit(True))
    kept = {r.doc_id for r in langid.keep(frame, model).collect()}
    assert {*range(180), 902, 905} <= kept and not kept & {900, 901, 903, 904}
    assert (np.diff(model.radius, axis=1) >= 0).all()


def test_columns_of_any_name(spark):
    rows = [(i, t, x, "r", 0.5, "p", True) for i, t, x in texts()]
    frame = spark.createDataFrame(rows + rows[:3] + [(None, "kala mira", None, None, None, None, None)], "doc_id long, text string, lang string, rejected string, score double, lang_pred string, __letter boolean")
    model = langid.fit(frame, F.lit(True))
    kept = langid.keep(frame, model)
    assert kept.columns == frame.columns and kept.count() == 182 + 3 + 1
    assert langid.predict(frame, model).count() == frame.count()
    empty = frame.where("false")
    assert langid.fit(empty, F.lit(True)) is None and langid.keep(empty, None).count() == 0 == langid.predict(empty, model).count()


def test_every_language_is_learned_from_null_and_repeated_ids(spark):
    rows = [(t, x) for _, t, x in texts() if x and t] * 3
    frame = spark.createDataFrame([(None, t, x) for t, x in rows] + [(None, "kala mira", "aa")] * 3000, "doc_id long, text string, lang string").repartition(4)
    for docs in (frame, frame.withColumn("doc_id", F.lit(7))):
        model = langid.fit(docs, F.lit(True), per_language=20)
        assert {model.languages[i] for i in model.language} == {"aa", "bb", "cc"}
        got = langid.predict(docs.where("length(text) > 60"), model, ("lang",)).collect()
        assert sum(r.lang_pred == r.lang for r in got) > 0.95 * len(got)
