"""Conversation repair against plain recursion and against every sequence of edits."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from wardloom.llm import conversations as C

BLANK = " \t\n\x0b\x0c\r"
GOOD = re.compile("(s?(ua)+)?")


def rows_after(rows):
    """(conv, turn, role, text) after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        k = zlib.crc32(":".join(shown).encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{r[2]}:{r[3]}".encode()).hexdigest()))


def faults(turns):
    seen, out = set(), []
    for _, _, role, text in turns:
        last = text.rstrip(BLANK)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def apply(edits, turns, marks):
    """(cost, role initials, lines) of a sequence of edits (each a letter, and a role where one is given), or None."""
    cost, lines, at = 0, [], 0
    for edit, role in edits:
        if edit == "I":
            cost += 5
            lines.append((role, ""))
            continue
        if at == len(turns):
            return None
        turn, mark = turns[at], marks[at]
        at += 1
        if edit == "D":
            cost += 2
        elif mark in ("blank", "duplicate"):
            return None
        else:
            cost += 5 * (mark == "truncated") + (edit == "R")
            lines.append((turn[2] if edit == "K" else role, turn[3]))
    return (cost, "".join(r[:1] or "?" for r, _ in lines), lines) if at == len(turns) else None


def exhaustive(turns, marks):
    options = [("D", None), ("K", None), *((e, r) for e in "RI" for r in ("user", "assistant"))]
    found = []
    for n in range(len(turns), len(turns) + 4):
        for edits in itertools.product(options, repeat=n):
            if sum(e == "I" for e, _ in edits) == n - len(turns) and (done := apply(edits, turns, marks)) and GOOD.fullmatch(done[1]):
                found.append((done[0], "".join(e for e, _ in edits), done[2]))
    return min(found)


def recursive(turns, marks):
    """Row by row, every edit at every place, by (cost, audit)."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @cache
    def best(i, state, inserted):
        out = [(0, "")] if i == len(turns) and state in ("", "a") else []
        grow = lambda cost, edit, rest: out.append((cost + rest[0], edit + rest[1]))
        if inserted < 3 and (nxt := "a" if state == "u" else "u"):
            grow(5, "I", best(i, nxt, inserted + 1))
        if i < len(turns):
            grow(2, "D", best(i + 1, state, 0))
            if marks[i] not in ("blank", "duplicate"):
                extra = 5 * (marks[i] == "truncated")
                if (to := turns[i][2][:1]) in after[state]:
                    grow(extra, "K", best(i + 1, to, 0))
                grow(extra + 1, "R", best(i + 1, "a" if state == "u" else "u", 0))
        return min(out) if out else (10**9, "")

    return best(0, "", 0)


def repaired(audit, turns):
    lines, at = [], 0
    for edit in audit:
        state = lines[-1][0][:1] if lines else ""
        other = "assistant" if state == "u" else "user"
        if edit == "I":
            lines.append((other, ""))
            continue
        if edit != "D":
            lines.append((turns[at][2] if edit == "K" else other, turns[at][3]))
        at += 1
    return lines


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = rows_after([r for r in rows if r[0] == conv])
        marks = faults(turns)
        cost, audit = recursive(turns, marks)
        known = [t[1] for t in turns if t[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [t[2][:1] for t in turns]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
        text = "\n".join(f"{r}:{t}" for r, t in repaired(audit, turns))
        out.append((conv, gaps, *(marks.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "why", "so?", " ", "", "\t\n", "and then. \n", None, "More.", "Other one.", "Last.", "\x1f", "é"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User", "sage"]
    out = []
    for conv in range(260):
        n = rng.randrange(0, 9)
        for t in range(n):
            calm = conv % 2
            role = ("user", "assistant")[t % 2] if calm and rng.random() < 0.9 else rng.choice(roles)
            out.append((conv, t + rng.randrange(3) * (rng.random() < 0.1), role, rng.choice(texts[:4] + texts[9:12]) if calm else rng.choice(texts)))
    out += [(500, None, rng.choice(roles), rng.choice(texts)) for _ in range(6)] + [(None, t, "user", "x.") for t in range(4)] + [(None, None, None, None)]
    out += [(501, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(120)] + [(502, t, "user", "same.") for t in range(90)] + [(502, 3, "user", "same.")] * 3
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair(spark, rows):
    want = sorted(map(repr, expected(rows)))
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", edit string").repartition(4)
    ordered = C.ordered(C.damaged(frame))
    for bits in (14, 2):  # whole conversations, and stretches of four rows at most
        got = C.digest(C.repair(ordered, bits))
        assert sorted(repr(tuple(r)) for r in got.collect()) == want
    lines = {}
    for r in sorted(C.turns(C.repair(ordered)).collect(), key=lambda r: (repr(r.conv_id), r.nth)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    digests = {r.conv_id: r.repaired_sha256 for r in got.collect()}
    assert all(hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == h for c, h in digests.items())


def test_recursion_is_the_best_of_all_edits(rows):
    for conv in range(0, 260):
        turns = rows_after([r for r in rows if r[0] == conv])
        if len(turns) <= 3:
            marks = faults(turns)
            cost, audit, lines = exhaustive(turns, marks)
            assert (cost, audit) == recursive(turns, marks) and lines == repaired(audit, turns)


def test_all_gone_and_empty(spark):
    gone = next((c, t) for c in range(100) for t in range(5) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = C.digest(C.repair(C.ordered(C.damaged(spark.createDataFrame([(*gone, "user", "x.")], SCHEMA))))).collect()
    assert [tuple(r) for r in got] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.digest(C.repair(C.ordered(C.damaged(spark.createDataFrame([], SCHEMA))))).count() == 0
