"""Weighted finite-state transducers over the classed words of a clause, and the grammar of abuse made of five of them.

A transducer reads a symbol for each word and writes one: its kind and the marks that it has got so far. ``Cascade``
composes transducers arc by arc as a clause is read, and finds the path of the largest weight. The transducers:

* insult: a word of the lexicon becomes an event, with the weight of its entry;
* threat: a word of harm becomes an event if someone is named up to ``BEHIND`` words before or ``AHEAD`` words after it;
  the transducer guesses that, and the path dies if it guessed wrong;
* target: in the same way marks the events near a word for a person;
* negation: marks the events up to ``REACH`` words after a negation;
* report: guesses whether the clause reports speech and marks its events; a path without the word that it guessed dies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

BEHIND, AHEAD, REACH = 4, 3, 3
#: What an event weighs, and what each mark adds to it.
WEIGHTS = {"insult": 0.0, "threat": 1.0, "targeted": 0.5, "negated": -0.75, "reported": -0.5}
#: Symbols read: other words, targets, negations, words of report, of harm, and insults. ``H`` is written for a threat.
OTHER, TARGET, NEGATION, REPORT, HARM, INSULT, THREAT = ".TNRVIH"
MARKS = {"t": "targeted", "n": "negated", "r": "reported"}

Arc = tuple[str, float, tuple]


class Transducer:
    """Arcs from a state and a symbol to (written, weight, next state); ``ends`` tells the states to end in."""

    def __init__(self, start: tuple, arcs: Callable[[tuple, str], Iterator[Arc]], ends: Callable[[tuple], bool] = lambda _: True):
        self.start, self.arcs, self.ends = start, arcs, ends


def is_event(symbol: str) -> bool:
    return symbol[0] in (INSULT, THREAT)


def insult() -> Transducer:
    return Transducer((), lambda state, x: iter([(x, WEIGHTS["insult"], state)]))


def near(kinds: str, found: Callable[[str], str], missed: Callable[[str], str], weight: float) -> Transducer:
    """Tells symbols of some kinds that have a target near from those that have none. A state: words since the last
    target, words within which one must follow (0: none must), and words within which none may."""

    def arcs(state: tuple, x: str) -> Iterator[Arc]:
        since, must, mustnt = state
        if x[0] == TARGET:
            if not mustnt:
                yield x, 0.0, (0, 0, 0)
            return
        if must == 1:
            return  # it was guessed, and did not come
        since, must, mustnt = min(since + 1, BEHIND + 1), max(must - 1, 0), max(mustnt - 1, 0)
        if x[0] not in kinds:
            yield x, 0.0, (since, must, mustnt)
        elif since <= BEHIND:
            yield found(x), weight, (since, must, mustnt)
        else:
            yield found(x), weight, (since, min(must or AHEAD, AHEAD), mustnt)
            yield missed(x), 0.0, (since, must, AHEAD)

    return Transducer((BEHIND + 1, 0, 0), arcs, lambda state: not state[1])


def threat() -> Transducer:
    return near(HARM, lambda x: THREAT + x[1:], lambda x: OTHER, WEIGHTS["threat"])


def target() -> Transducer:
    return near(INSULT + THREAT, lambda x: x + "t", lambda x: x, WEIGHTS["targeted"])


def negation() -> Transducer:
    def arcs(state: tuple, x: str) -> Iterator[Arc]:
        left = max(state[0] - 1, 0)
        if x[0] == NEGATION:
            yield x, 0.0, (REACH + 1,)
        elif left and is_event(x):
            yield x + "n", WEIGHTS["negated"], (left,)
        else:
            yield x, 0.0, (left,)

    return Transducer((0,), arcs)


def report() -> Transducer:
    """States: nothing guessed yet, no report, a report to come, a report seen."""

    def arcs(state: tuple, x: str) -> Iterator[Arc]:
        for guess in ("plain", "due") if state == ("start",) else state:
            if x[0] == REPORT:
                if guess != "plain":
                    yield x, 0.0, ("seen",)
            elif guess != "plain" and is_event(x):
                yield x + "r", WEIGHTS["reported"], (guess,)
            else:
                yield x, 0.0, (guess,)

    return Transducer(("start",), arcs, lambda state: state != ("due",))


class Cascade:
    """The composition of transducers, each reading what the one before it writes. Arcs are made when first needed and
    kept; they are as many as the grammar has, however many texts are read."""

    def __init__(self, *parts: Transducer):
        self.parts, self.start = parts, tuple(p.start for p in parts)
        self._arcs: dict[tuple, list[Arc]] = {}

    def arcs(self, state: tuple, x: str) -> list[Arc]:
        key = state, x
        if key not in self._arcs:
            paths: list[Arc] = [(x, 0.0, ())]
            for part, at in zip(self.parts, state, strict=True):
                paths = [(z, w + v, (*states, to)) for y, w, states in paths for z, v, to in part.arcs(at, y)]
            self._arcs[key] = paths
        return self._arcs[key]

    def best(self, symbols: list[str], weights: list[float]) -> tuple[float, list[tuple[int, str]]]:
        """The weight of the best path and the events that it writes: (place, symbol). Insults weigh ``weights`` more."""
        at: dict[tuple, tuple[float, tuple | None]] = {self.start: (0.0, None)}
        for i, x in enumerate(symbols):
            after: dict[tuple, tuple[float, tuple | None]] = {}
            for state, (weight, path) in at.items():
                for y, w, to in self.arcs(state, x):
                    total = weight + w + (weights[i] if x == INSULT else 0.0)
                    if to not in after or after[to][0] < total:
                        after[to] = total, (path, i, y) if is_event(y) else path
            at = after
        weight, path = max((v for s, v in at.items() if all(p.ends(x) for p, x in zip(self.parts, s, strict=True))), key=lambda v: v[0])
        out = []
        while path:
            path, i, y = path
            out.append((i, y))
        return weight, out[::-1]


def abuse() -> Cascade:
    return Cascade(insult(), threat(), target(), negation(), report())


def name(symbol: str) -> str:
    """An event as words: its kind and its marks."""
    return "_".join(["insult" if symbol[0] == INSULT else "threat", *(m for k, m in MARKS.items() if k in symbol[1:])])


EVENTS = [name(k + "".join(m for m, on in zip("tnr", bits, strict=True) if on)) for k in (INSULT, THREAT) for bits in [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)] if k == INSULT or bits[0]]
