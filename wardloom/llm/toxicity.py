"""Toxicity by a weighted finite-state pattern grammar.

Words are classed by lexicons: insults, learned from labelled texts as words and, where many words share one, as stems;
words of harm, learned as words that tell toxic texts only where someone is named near them, next to a short list;
targets, negations and reported speech, given as short lists. The transducers of ``grammar`` are composed and read the
classed words of a clause; the best path turns each insult or threat into one event, with the marks that it got on the
way (targeted, negated, reported), and gives the clause its weight. A text is scored by a logistic model over the summed
weights of its events of each kind, the weight of its strongest clause, and the weight of its clauses for each that it
has, fitted on the same labelled texts with the signs of the marks held (``SIGNS``): a mark of negation or report never
adds to a score, and the aim at someone never takes from a text of one event. Isolated words have no weight but through
the clause they are matched in.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grammar
from ._words import pieces, small_batches
from .grammar import EVENTS

#: Lower-case words of English, German, French and Spanish.
TARGETS = frozenset("you your yours u he she they him her them we everyone people du dich dir ihr euch sie er tu te toi vous il elle ils usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not no never none nobody neither without isn't aren't don't nicht kein keine nie niemand pas jamais aucun sans nunca ningún nadie sin".split())
REPORTS = frozenset("said says say wrote writes quoted reported called claims claimed sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
THREATS = frozenset("kill hurt destroy shoot stab murder töten umbringen tuer frapper matar golpear".split())
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
FEATURES = [*EVENTS, "strongest", "clauses"]
STEM = range(4, 9)
#: Endings without which a word is looked up too, if four letters are left.
ENDINGS = ("s", "es", "ed", "ing")
#: Words that a task keeps classed.
SEEN = 100_000
#: The symbol of each listed word; of a word in two lists the first counts.
CLASSES = {w: c for c, words in ((grammar.HARM, THREATS), (grammar.REPORT, REPORTS), (grammar.NEGATION, NEGATIONS), (grammar.TARGET, TARGETS)) for w in words}
#: What fitted sizes, none below ``FLOOR``, add up to each weight: of an insult, of the aim at someone, of a negation or a
#: report, of the strongest clause and of the clauses. A threat weighs as an insult aimed at someone does.
FLOOR = 0.1
SIGNS = np.array([[0, 0, -sum(m in kind for m in ("negated", "reported")), 0, 0] if "negated" in kind or "reported" in kind else [1, "targeted" in kind, 0, 0, 0] for kind in EVENTS] + [[0, 0, 0, 1, 0], [0, 0, 0, 0, 1]], float)


def bases(word: str) -> list[str]:
    """The word, and the word without each ending that it has."""
    return [word, *(word[: -len(e)] for e in ENDINGS if word.endswith(e) and len(word) >= len(e) + 4)]


def lexicon_keys(word: str) -> list[str]:
    """A word as itself and without its endings, ``=word``, and its possible stems."""
    return [*("=" + b for b in bases(word)), *(word[:k] for k in STEM if k <= len(word))]


def aimed(text: str) -> set[str]:
    """The words of a text, with and without endings, that have a target near in their clause, as a threat must."""
    out = set()
    for clause in CLAUSE.split(text):
        words = WORD.findall(clause)
        named = [i for i, w in enumerate(words) if w in TARGETS]
        for at in named:
            out.update(b for w in words[max(0, at - grammar.AHEAD) : at + grammar.BEHIND + 1] if w not in CLASSES for b in bases(w))
    return out


def clauses(text: str, insult: dict[str, float], cascade: grammar.Cascade, harm: frozenset[str] = frozenset(), seen: dict[str, tuple[str, float]] | None = None) -> Iterator[tuple[int, float, list[tuple[str, float]]]]:
    """Of each clause with an event: its number, the weight of its best path, and the kind and weight of each event.

    ``seen`` keeps the symbols and weights of words that were met, at most ``SEEN``, for one pair of lexicons.
    """
    seen = {} if seen is None else seen
    for n, clause in enumerate(CLAUSE.split(text)):
        symbols, weights = [], []
        if clause.count('"') >= 2 or clause.count("“") >= 1:
            symbols, weights = [grammar.REPORT], [0.0]
        for w in WORD.findall(clause.lower()):
            if w not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                weight = max((insult[k] for k in lexicon_keys(w) if k in insult), default=0.0)
                harms = any(b in harm or b in THREATS for b in bases(w))
                seen[w] = CLASSES.get(w) or (grammar.INSULT if weight else grammar.HARM if harms else grammar.OTHER), weight or 1.0
            symbol, weight = seen[w]
            symbols.append(symbol)
            weights.append(weight)
        if grammar.INSULT in symbols or grammar.HARM in symbols:
            strength, found = cascade.best(symbols, weights)
            if found:
                yield n, strength, [(grammar.name(y), weights[i]) for i, y in found]


def events(text: str, insult: dict[str, float]) -> list[tuple[str, int, float]]:
    """The events of a text with the clause and weight of each."""
    return [(kind, n, weight) for n, _, found in clauses(text, insult, grammar.abuse()) for kind, weight in found]


@dataclass
class Model:
    insult: dict[str, float]
    weights: np.ndarray  # of each feature, then the intercept
    harm: frozenset[str] = frozenset()  # learned words of harm, next to THREATS
    seen: dict[str, tuple[str, float]] = field(default_factory=dict, compare=False, repr=False)

    def finder(self) -> ahocorasick.Automaton | None:
        """Finds the texts that can have an event at all, in one pass over their characters."""
        words = {k.lstrip("=") for k in self.insult} | THREATS | self.harm
        finder = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in words:
            finder.add_word(w)
        finder.make_automaton()
        return finder if words else None

    def features(self, text: str | None, finder: ahocorasick.Automaton, cascade: grammar.Cascade) -> tuple[np.ndarray, list[tuple[str, int]]]:
        out, found, total = np.zeros(len(FEATURES)), [], 0.0
        if text and next(finder.iter(text.lower()), None) is not None:
            for n, strength, matched in clauses(text, self.insult, cascade, self.harm, self.seen):
                for kind, weight in matched:
                    out[EVENTS.index(kind)] += weight
                    found.append((kind, n))
                out[-2], total = max(out[-2], strength), total + max(strength, 0.0)
            out = np.log1p(out)
            out[-1] = total / max(1, sum(bool(c.strip()) for c in CLAUSE.split(text)))
        return out, found

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """The weight of each feature, then the intercept, where row i counts n[i] times: sizes of at least ``FLOOR`` that
    ``SIGNS`` adds up, by Newton's method on those that are free, with steps halved until they help."""
    x = np.column_stack([x @ SIGNS, np.ones(len(x))])
    least = np.array([*[FLOOR] * (x.shape[1] - 1), -np.inf])
    w = np.array([*[1.0] * (x.shape[1] - 1), 0.0])
    penalty = ridge * np.array([*[1.0] * (len(w) - 1), 1e-6])
    loss = lambda w: n @ np.logaddexp(0.0, np.where(y > 0, -1.0, 1.0) * (x @ w)) + penalty @ (w * w) / 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + penalty * w
        free = (w > least) | (gradient < 0)
        a = x[:, free]
        step = np.zeros(len(w))
        step[free] = np.linalg.solve((a.T * (n * p * (1 - p))) @ a + np.diag(penalty[free] + 1e-9), -gradient[free])
        before, size = loss(w), 1.0
        while size > 1e-6 and loss(np.maximum(w + size * step, least)) > before:
            size /= 2
        after = np.maximum(w + size * step, least)
        if size <= 1e-6 or np.abs(after - w).max() < 1e-8:
            break
        w = after
    return np.append(SIGNS @ w[:-1], w[-1])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = 16_000, least: int = 3, margin: float = 2.5, ratio: float = 24.0, forms: int = 5) -> Model | None:
    """Learns the insults, the words of harm and the weights from ``labels.toxic`` of the rows where ``usable``.

    ``sample`` bounds the labelled rows used, those whose ids hash lowest, and so the lexicon too; of several texts of
    one id one is used. A key is a word
    or stem that at least ``least`` toxic texts hold and whose smoothed log-odds of toxic against other texts are
    ``margin`` or more, with a likelihood ratio (G squared) of at least ``ratio``, which few of a million keys without any link
    to the label reach by chance; a stem must also begin ``forms`` different words of toxic texts, so that one
    word's beginning is none. A word of harm passes the same tests on its places near a target, and is no insult. A document with several labels counts as toxic if one says so. None without labels.
    """
    small_batches(docs.sparkSession)
    truth = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(usable)
    n = truth.count()
    if not n:
        return None
    cut = min(1.0, sample / n)
    chosen = truth.where(F.xxhash64("doc_id", F.lit(23)) / F.lit(2.0**64) + 0.5 <= cut)
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")  # about ``sample`` ids
    rows = texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.first("toxic").alias("toxic")).persist()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            tables = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                text = text.lower()
                tables[toxic > 0].update({k for w in set(WORD.findall(text)) for k in lexicon_keys(w)})
                tables[toxic > 0].update("~" + w for w in aimed(text))
                tables[toxic > 0][""] += 1
            keys = list(tables[0] | tables[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([tables[1][k] for k in keys], pa.int64()), pa.array([tables[0][k] for k in keys], pa.int64())], ["key", "toxic", "other"])

    totals = rows.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    odds = lambda a, total: F.log((F.col(a) + 0.5) / (F.lit(float(total)) + 1))
    counts = rows.mapInArrow(counted, "key string, toxic long, other long").where("key <> ''").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).persist()
    word = F.substring("key", 2, 1 << 20)
    stems = F.transform(F.sequence(F.lit(STEM[0]), F.lit(STEM[-1])), lambda k: F.when(F.length(word) >= k, F.substring(word, F.lit(1), k)))
    stems = counts.where(F.col("key").startswith("=") & (F.col("toxic") > 0)).select(F.explode(stems).alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("forms"))
    single = F.substring("key", 1, 1).isin("=", "~")
    sums = counts
    share = totals[0] / max(1, sum(totals))
    surprise = lambda a, p: F.when(F.col(a) > 0, 2 * F.col(a) * F.log(F.col(a) / ((F.col("toxic") + F.col("other")) * p))).otherwise(0.0)
    sums = sums.withColumn("odds", odds("toxic", totals[0]) - odds("other", totals[1]))
    if 0 < share < 1:  # the likelihood ratio that a key is as frequent in other texts
        sums = sums.where(surprise("toxic", share) + surprise("other", 1 - share) >= ratio)
    scored = sums.where((F.col("toxic") >= least) & (F.col("odds") >= margin))
    kept = scored.join(stems, "key", "left").where(single | (F.col("forms") >= forms)).collect()
    counts.unpersist()
    # A stem or word is enough once: drop those that a shorter stem of at least the same odds covers.
    # Odds that few texts speak for are shrunk; five, which holds of a word hardly met elsewhere, weighs one.
    best = {r.key: r.odds / 5 * r.toxic / (r.toxic + 20) for r in kept if r.key[0] != "~"}
    harm = frozenset(r.key[1:] for r in kept if r.key[0] == "~" and not any(k in best for k in lexicon_keys(r.key[1:])))
    insult = {k: o for k, o in best.items() if not any(best.get(s, -9) >= o - 1e-9 for s in lexicon_keys(k.lstrip("="))[1:] if s != k)}
    model = Model(insult, np.zeros(len(FEATURES) + 1), harm)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, cascade = shared.value.finder(), grammar.abuse()
        for batch in batches:
            x = [shared.value.features(t, finder, cascade)[0].tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    # Texts without events all have the same features: one row with a count stands for them.
    found = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(measured, "x array<double>, toxic int").groupBy("x", "toxic").agg(F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r.x, r.toxic))
    if found:
        model.weights = _logistic(np.array([r.x for r in found]), np.array([float(r.toxic > 0) for r in found]), np.array([float(r.n) for r in found]))
    rows.unpersist()
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) and events (kind, clause) of each whole text.

    Null and empty texts have no events; they, and all texts if nothing was learned, get the score of a text without
    events (0 then). Nothing but the text is an input. Rows are returned one for one; no shuffle. The model that is
    broadcast is bounded by the parameters of ``fit``.
    """
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        finder, cascade = model.finder() if model else None, grammar.abuse()
        for batch in pieces(batches, "text"):
            texts = batch.column("text").to_pylist()
            if model is None:
                y, found = np.zeros(len(texts)), [[]] * len(texts)
            else:
                both = [model.features(t, finder, cascade) for t in texts]
                y, found = model.score(np.stack([x for x, _ in both])), [x for _, x in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(y), pa.array((y >= 0.5).astype(np.int32)), pa.array([[{"kind": k, "clause": n} for k, n in x] for x in found], pa.list_(pa.struct([("kind", pa.string()), ("clause", pa.int32())])))],
                ["doc_id", "score", "predicted", "events"],
            )

    return source.mapInArrow(scored, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double, predicted int, events array<struct<kind:string,clause:int>>")
