"""Queries from expressions: every string that an expression makes satisfies its query, and they say something."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wardloom.llm import secrets, trigrams

rng = random.Random(3)
PARTS = re._parser  # the expression as a tree, to make strings of it


def made(tree):
    """A random string that the expression matches."""
    out = ""
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            out += rng.choice([chr(value), chr(value).upper(), chr(value).lower()]) if made.fold else chr(value)
        elif name == "NOT_LITERAL":
            out += rng.choice([c for c in "xyz9 " if c != chr(value)])
        elif name == "ANY":
            out += rng.choice("abc .")
        elif name == "IN":
            if str(value[0][0]) == "NEGATE":
                out += rng.choice("qZ9-_")
                continue
            k, v = rng.choice(value)
            out += chr(v) if str(k) == "LITERAL" else chr(rng.randint(*v)) if str(k) == "RANGE" else rng.choice("09")
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, part = value
            out += "".join(made(part) for _ in range(rng.randint(low, min(high, low + 3))))
        elif name == "BRANCH":
            out += made(rng.choice(value[1]))
        elif name == "SUBPATTERN":
            fold, made.fold = made.fold, made.fold or bool(value[1] & re.I)
            out += made(value[3])
            made.fold = fold
        else:
            assert name == "AT", name
    return out


made.fold = False
OTHERS = [r"abc", r"a(bc|de)f", r"(?:ab)?cde+f{2}g", r"x[0-9]{3}y", r"(foo|ba[rz])(qux)*end", r"[ab][cd][ef][gh]", r"(a|b|cd){2,3}xyz", r"a.c|wxyz", r"(?i:Key)[-_]?id", r"ab\.cd\x20ef", r"([a-z]{2}|www)\.site", r"a{5}", r"(ab){3,}", r"(|abc)def"]


@pytest.mark.parametrize("pattern", [r.pattern for r in secrets.RULES] + OTHERS)
def test_made_strings_satisfy(pattern):
    query = trigrams.query(pattern)
    for _ in range(300):
        text = made(PARTS.parse(pattern))
        assert re.search(pattern, text), text
        assert trigrams.holds(query, ("- " + text + " -").lower()), (text, query)


@pytest.mark.parametrize("pattern, query", [("abcd", ("and", "abc", "bcd")), ("ab+c", True), ("abc|abcd", "abc"), ("ab(c|d)", ("or", "abc", "abd")), ("[0-9]{9}", True), ("(?i:ABC)x*def", ("and", "abc", "def"))])
def test_queries(pattern, query):
    assert trigrams.query(pattern) == query


def test_a_new_rule_needs_nothing_but_its_expression(spark):
    rules = [secrets.Rule("key", r"(?:prod|dev)-key-[0-9]{3,5}")]
    frame = spark.createDataFrame([(1, "DEV-KEY-123 dev-key-12345x", "a", "b"), (2, "prod-key-12", "a", "b"), (None, "x prod-key-777", "a", "b"), (None, None, "a", "b"), (1, "", "a", "b")], "doc_id long, text string, kinds string, __docs string")
    got = {r.text: [(s.start, s.end) for s in r.spans] for r in secrets.scan(frame, rules).collect()}
    assert got == {"DEV-KEY-123 dev-key-12345x": [(12, 25)], "prod-key-12": [], "x prod-key-777": [(2, 14)], None: [], "": []}


def test_very_many_secrets(spark):
    """Walks in blocks: some ten thousand spans, overlapping ones too, cost no more than some hundred each."""
    text = "é token=abcdef0123456789abcdef0123 x" * 3000 + " " + "f" * 30 + " tail"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = secrets.scan(frame).select("spans", secrets.redact(F.col("text"), F.col("spans")).alias("clean")).first()
    want = [(m.start(), m.end()) for m in re.finditer(r"token=[a-z0-9]+", text)]
    assert [(s.start, s.end) for s in row.spans if s.kind == "assign"] == want and sum(s.kind == "hex" for s in row.spans) == 3001
    assert row.clean == "é [SECRET] x" * 3000 + " [SECRET] tail"
