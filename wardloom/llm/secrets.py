"""Secret scans with a trigram inverted index, in DataFrame operations only.

Each rule is a regular expression. A Boolean query over trigrams is derived from the expression itself (``trigrams``).
The index has a posting (trigram, row) for each trigram that a query names, from one pass over the lower-cased texts.
Postings are intersected and united by row as the query says; the rows that satisfy it are the rule's candidates, and
only these are verified with the expression. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.functions.scalars import bound

from . import trigrams


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and ``kept``, a test of a match that drops it if false."""

    kind: str
    pattern: str
    kept: str | None = None
    base: bool = False

    @property
    def query(self) -> trigrams.Query:
        return trigrams.query(self.pattern)


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
BASE = [
    # Matches whose value is too short are dropped, not sought further inside: so the length is a test of the match.
    Rule("assign", ASSIGN + r"[A-Za-z0-9+/_.=-]+", kept=rf"^{ASSIGN}[A-Za-z0-9+/_.=-]{{6,}}$", base=True),
    # A run of the class is one match, so here the length can be part of the expression.
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
]
MORE = [
    # To the END line, over the headers of an encrypted key and line ends that are spaces or escaped; else the BEGIN line.
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?:[\\nr\x20\t\r\n]*Proc-Type:[^\r\n]*[\r\n]+DEK-Info:[^\r\n]*)?[A-Za-z0-9+/=\\\x20\t\r\n]*-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("payment_key", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]+@"),
]
RULES = [*BASE, *MORE]


#: Matches or spans that are walked over at once: what is copied for each of them is no longer than this.
BLOCK = 256


def _alternatives(words: list[str]) -> str:
    """An expression for any of some words of one length, which goes by their first letters."""
    rest: dict[str, list[str]] = {}
    for w in words:
        rest.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(re.escape(c) + (_alternatives(x) if x[0] else "") for c, x in sorted(rest.items())) + ")"


def index(docs: DataFrame, wanted: set[str]) -> DataFrame:
    """The postings (trigram, __key), each once for a row, of these trigrams over the lower-cased ``text``; in one pass."""
    first = "".join(re.escape(c) for c in sorted({t[0] for t in wanted}))
    everywhere = F.regexp_extract_all(F.lower("text"), F.lit(f"(?=[{first}])(?=({_alternatives(sorted(wanted))}))"), F.lit(1))
    return docs.where("text IS NOT NULL").select("__key", F.explode(F.array_distinct(everywhere)).alias("trigram"))


def _satisfied(query: trigrams.Query, posted: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(posted, query)
    parts = [_satisfied(x, posted) for x in query[1:]]
    return reduce(Column.__and__ if query[0] == "and" else Column.__or__, parts)


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """__key and the kinds whose queries the postings of the row satisfy; a row for each with any."""
    wanted = {r.kind: r.query for r in rules}
    posted = index(docs, set().union(*map(trigrams.trigrams, wanted.values()))).groupBy("__key").agg(F.collect_set("trigram").alias("posted"))
    kinds = F.array(*(F.when(_satisfied(q, F.col("posted")), F.lit(kind)) for kind, q in wanted.items()))
    return posted.select("__key", F.array_compact(kinds).alias("kinds")).where(F.size("kinds") > 0)


def _blocks(array: Column, size: Column) -> Column:
    """An array in arrays of ``BLOCK`` elements; at least one, which may be empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(size, F.lit(1)) - 1) / BLOCK).cast("int")), lambda b: F.slice(array, b * BLOCK + 1, BLOCK))


def _spans(rule: Rule, text: Column) -> Column:
    """The matches of a rule in code points, from the lengths of what lies between them."""
    between = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pairs = bound(
        lambda v: F.zip_with(F.slice(v["between"], 1, F.size(v["found"])), v["found"], lambda b, m: F.struct(F.char_length(b).alias("gap"), F.char_length(m).alias("size"), (m.rlike(rule.kept) if rule.kept else F.lit(True)).alias("kept"))),
        between=between, found=found,
    )
    none = F.array().cast("array<struct<start:int,end:int,kind:string,kept:boolean>>")

    def walked(block: Column, at: Column) -> Column:
        start = lambda a, x: F.when(F.size(a) > 0, F.element_at(a, -1)["end"]).otherwise(at) + x["gap"]
        return F.aggregate(block, none, lambda a, x: F.concat(a, F.array(F.struct(start(a, x).alias("start"), (start(a, x) + x["size"]).alias("end"), F.lit(rule.kind).alias("kind"), x["kept"].alias("kept")))))

    def whole(v: Column) -> Column:
        lengths = F.transform(v["blocks"], lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["size"]))
        starts = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(v["blocks"], F.slice(starts, 1, F.size(v["blocks"])), walked))

    every = bound(whole, blocks=bound(lambda v: _blocks(v["pairs"], F.size(v["pairs"])), pairs=pairs))
    return F.transform(F.filter(every, lambda x: x["kept"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Adds ``spans``, array<struct<start, end, kind>> in code points: by start, then in the order of ``rules``.

    ``docs`` needs doc_id and text and keeps its other columns, whatever their names, but one named spans, which is
    replaced. Matches of one rule do not overlap; those of different rules may. A null or empty text has none; an empty
    table gives none. Each row is found by a hash of its id and text, so equal rows, and rows without an id, are judged
    alike.
    """
    by_index, whole = [r for r in rules if r.query is not True], [r for r in rules if r.query is True]
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    keyed = docs.drop("spans").select(F.struct("*").alias("__row"), F.xxhash64("doc_id", "text").alias("__key"))
    text, kinds = F.col("__row.text"), F.array().cast("array<string>")
    if by_index:
        chosen = candidates(keyed.select("__key", text.alias("text")), by_index)
        # The candidates are small rows and the texts large ones: hash the former, do not sort the latter.
        keyed, kinds = keyed.join(chosen.hint("shuffle_hash"), "__key", "left"), F.col("kinds")
    is_candidate = {r.kind: F.array_contains(kinds, r.kind) for r in by_index} | {r.kind: text.rlike(r.pattern) for r in whole}
    lists = [F.when(is_candidate[r.kind], _spans(r, text)).otherwise(none) for r in rules]
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    all_of = F.transform(F.flatten(F.array(*(F.coalesce(x, none) for x in lists))), lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("n"), x["end"].alias("end"), x["kind"].alias("kind")))
    spans = F.transform(F.array_sort(all_of), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return keyed.select("__row.*", spans.alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans, which are sorted by start, replaced by ``mark``."""
    last = lambda a: F.coalesce(F.array_max(F.transform(a, lambda x: x["end"])), F.lit(0))

    def walked(v: Column) -> Column:
        """What stands before and instead of the spans of a block, cut from ``piece``, which begins at ``at``."""
        return F.aggregate(
            v["block"], F.struct(F.lit("").alias("out"), v["at"].alias("at")),
            lambda a, x: F.when(x["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], x["end"]).alias("at"))).otherwise(
                F.struct(F.concat(a["out"], F.substring(v["piece"], a["at"] - v["at"] + 1, x["start"] - a["at"]), F.lit(mark)).alias("out"), x["end"].alias("at"))
            ),
            lambda a: a["out"],
        )

    def of_block(block: Column, i: Column) -> Column:
        at = last(F.slice(spans, 1, i * BLOCK))
        piece = lambda v: F.substring(text, v["at"] + 1, F.greatest(last(v["block"]) - v["at"], F.lit(0)))
        return bound(lambda v: bound(walked, block=v["block"], at=v["at"], piece=piece(v)), block=block, at=at)

    done = F.transform(_blocks(spans, F.size(spans)), of_block)
    rest = F.substring(text, last(spans) + 1, F.char_length(text))
    return F.when(F.size(spans) > 0, F.array_join(F.concat(done, F.array(rest)), "")).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    shown = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*(r.kind for r in BASE)))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
