"""Scalar expressions: names, ids, ages, sexes, views, labels and answers. Null stands for a missing value everywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings of a sex and of a view, and the words that mean unknown.
SEX_VALUES = {"m": "M", "male": "M", "f": "F", "female": "F"}
SEX_UNKNOWN = ("", "o", "u", "unknown", "other")
VIEW_VALUES = {"pa": "PA", "postero_anterior": "PA", "ap": "AP", "antero_posterior": "AP", "lateral": "LATERAL", "lat": "LATERAL", "l": "LATERAL", "ll": "LATERAL", "rl": "LATERAL"}
VIEW_UNKNOWN = ("", "unknown", "unk", "n/a", "exclude", "none")
# Years in one unit of an age, and the highest age that is believed.
AGE_DIVISORS = {"years": 1.0, "days": 365.25, "months": 12.0}
AGE_CODES = {"D": 1.0 / 365.25, "W": 7.0 / 365.25, "M": 1.0 / 12.0, "Y": 1.0}
AGE_MOST = 130.0
# White space, with the four separators below the space.
SPACES = r"[\s\x1c-\x1f]+"
# Words that do not count in an answer.
ARTICLES = ("a", "an", "the")


def strip(c: Column) -> Column:
    """Without the white space at both ends: spaces, tabs, line ends and those of Unicode."""
    return F.regexp_replace(c, f"(?U)^{SPACES}|{SPACES}$", "")


def is_blank(c: Column) -> Column:
    """Null, or nothing but white space."""
    return c.isNull() | (strip(c) == "")


def no_nan(c: Column) -> Column:
    """Null for NaN, so that averages and counts skip it."""
    return F.when(~F.isnan(c), c)


def lookup(c: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), c)


def snake(c: Column) -> Column:
    """Lower case, each space an underscore."""
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def box_label(c: Column) -> Column:
    """Lower case, trimmed, each run of white space one underscore."""
    return F.regexp_replace(strip(F.lower(c)), f"(?U){SPACES}", "_")


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null if there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def part(c: Column, separator: str, n: int) -> Column:
    """The n-th part from 0; null past the end."""
    return F.get(F.split(c, separator, -1), F.lit(n))


def first_parts(c: Column, separator: str, n: int) -> Column:
    return F.array_join(F.slice(F.split(c, separator, -1), 1, n), separator)


def without_prefix(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def min_max(c: Column, low: Column, high: Column) -> Column:
    """From 0 at the lowest to 1 at the highest; null where these are equal."""
    return ((c - low) / F.nullif(high - low, F.lit(0))).cast("double")


def base_name(c: Column) -> Column:
    return F.regexp_replace(c, "^.*/", "")


def image_id(c: Column, endings: tuple[str, ...] = ("nii.gz", "nii", "png", "jpg", "jpeg", "dcm", "npy", "npz")) -> Column:
    """A path without a known ending; other dots stay."""
    return F.regexp_replace(c, "(?i)\\.(" + "|".join(e.replace(".", "\\.") for e in endings) + ")$", "")


def age_years(c: Column, unit: str) -> Column:
    """Years as double from a declared unit; what cannot be read, is negative or is above the highest age is null."""
    if unit == "dicom_as":
        text = c.cast("string")
        code = F.upper(extract(text, r"(?i)^\s*\d{1,3}\s*([DWMY])\s*$"))
        years = extract(text, r"(?i)^\s*(\d{1,3})\s*[DWMY]\s*$").cast("double") * F.element_at(F.create_map(*[F.lit(x) for p in AGE_CODES.items() for x in p]), code)
    elif unit in AGE_DIVISORS:
        years = no_nan(c.try_cast("double")) / AGE_DIVISORS[unit]
    else:
        raise ValueError(f"unknown age unit {unit!r}: one of {sorted([*AGE_DIVISORS, 'dicom_as'])}")
    return F.when(years.between(0.0, AGE_MOST), years)


def age_plausible(c: Column, low: float = 0.0, high: float = 120.0) -> Column:
    return F.coalesce(c.between(low, high), F.lit(False))


def sex(c: Column) -> Column:
    """M, F or null."""
    return lookup(F.lower(strip(c)), SEX_VALUES)


def sex_is_odd(c: Column) -> Column:
    """A value that is neither a known sex nor a word for unknown."""
    low = F.lower(strip(c))
    return F.coalesce(lookup(low, SEX_VALUES).isNull() & ~low.isin(*SEX_UNKNOWN), F.lit(False))


def view(c: Column) -> Column:
    """The shared name of a view; null for a word that means unknown; else the value in upper case."""
    low = F.lower(strip(c))
    return F.when(~low.isin(*VIEW_UNKNOWN), F.coalesce(lookup(low, VIEW_VALUES), F.upper(strip(c))))


def uncertain(c: Column, policy: str) -> Column:
    """A label of 1, 0, -1 (uncertain) or null under a policy: raw, zeros, ones or ignore."""
    instead = {"raw": c, "zeros": F.lit(0.0), "ones": F.lit(1.0), "ignore": F.lit(None).cast("double")}[policy]
    return F.when(c == -1, instead).otherwise(c)


def codes(labels: list[str], not_mentioned: str = "negative") -> dict[str, Column]:
    """A blank label becomes 0 if its row has any label at all; with ``nan`` it stays null."""
    if not_mentioned not in ("negative", "nan"):
        raise ValueError(f"not_mentioned must be negative or nan, not {not_mentioned!r}")
    if not_mentioned == "nan":
        return {c: F.col(c).cast("double") for c in labels}
    some = F.coalesce(*(F.col(c).cast("double") for c in labels)).isNotNull()
    return {c: F.coalesce(F.col(c).cast("double"), F.when(some, F.lit(0.0))) for c in labels}


def usable_label(c: Column) -> Column:
    """The label is 0 or 1."""
    return F.coalesce(c.isin(0, 1), F.lit(False))


def tokens(c: Column) -> Column:
    """The words of an answer: lower case, other characters than a-z, 0-9 as spaces, without articles. Null has none."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " "), " ")
    return F.filter(words, lambda t: (t != "") & ~t.isin(*ARTICLES))


def overlap(a: Column, b: Column) -> Column:
    """The size of the multiset intersection of two arrays of words."""
    count = lambda array, t: F.size(F.filter(array, lambda x: x == t))
    both = lambda p: F.aggregate(F.array_distinct(p["a"]), F.lit(0), lambda n, t: n + F.least(count(p["a"], t), count(p["b"], t)))
    return bound(both, a=a, b=b)


def bound(f: Callable[[Column], Column], **values: Column) -> Column:
    """``f`` of a struct of values, each computed once however often ``f`` names it, also inside its lambdas."""
    return F.get(F.transform(F.array(F.named_struct(*(x for k, v in values.items() for x in (F.lit(k), v)))), f), F.lit(0))


def token_f1(answer: Column, reference: Column) -> Column:
    """2 common / (both sizes); both empty: 1, one empty: 0."""
    both = lambda p: F.size(p["a"]) + F.size(p["b"])
    score = lambda p: F.when(both(p) == 0, 1.0).otherwise(2.0 * overlap(p["a"], p["b"]) / F.nullif(both(p), F.lit(0)))
    return bound(score, a=tokens(answer), b=tokens(reference))


def token_recall(answer: Column, reference: Column) -> Column:
    score = lambda p: F.when(F.size(p["b"]) == 0, 0.0).otherwise(overlap(p["a"], p["b"]) / F.nullif(F.size(p["b"]), F.lit(0)))
    return bound(score, a=tokens(answer), b=tokens(reference))


def yes_no(c: Column) -> Column:
    """The first word yes or no of an answer, or null."""
    return F.get(F.filter(tokens(c), lambda t: t.isin("yes", "no")), F.lit(0))


def is_closed(c: Column) -> Column:
    """The reference answer is yes or no and nothing else."""
    return F.coalesce(F.lower(strip(c)).isin("yes", "no"), F.lit(False))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"(?U){SPACES}", " "))


# The section headers of a report in the singular, and those that open and that end each section.
HEADERS = (
    "FINDING", "IMPRESSION", "CONCLUSION", "RECOMMENDATION", "SUMMARY", "NOTIFICATION", "END OF IMPRESSION", "COMPARISON", "TECHNIQUE", "INDICATION", "HISTORY", "EXAMINATION",
    "CLINICAL INDICATION", "CLINICAL HISTORY", "REASON FOR EXAM", "REASON FOR THE EXAM", "REASON FOR EXAMINATION", "REASON FOR THE EXAMINATION",
)
_CONTEXT = ("COMPARISON", "TECHNIQUE", "INDICATION", "HISTORY", "EXAMINATION", "CLINICAL INDICATION", "CLINICAL HISTORY", "REASON FOR EXAMINATION", "REASON FOR THE EXAMINATION")
SECTIONS = {
    "findings": (("FINDING",), ("IMPRESSION", "CONCLUSION", "RECOMMENDATION", "SUMMARY", "NOTIFICATION", "END OF IMPRESSION", *_CONTEXT)),
    "impression": (("IMPRESSION", "CONCLUSION", "END OF IMPRESSION"), ("FINDING", "RECOMMENDATION", "NOTIFICATION", "END OF IMPRESSION", *_CONTEXT)),
    "indication": (("INDICATION", "HISTORY", "CLINICAL INDICATION", "CLINICAL HISTORY", "REASON FOR EXAM", "REASON FOR THE EXAM", "REASON FOR EXAMINATION", "REASON FOR THE EXAMINATION"), ("FINDING", "IMPRESSION", "CONCLUSION", "RECOMMENDATION", "NOTIFICATION", "END OF IMPRESSION", *_CONTEXT)),
}
# Control characters that set the pieces of a note apart while it is cut.
_PIECE, _BODY = "\x01", "\x02"


def pieces(note: Column) -> Column:
    """A note cut at its headers: array<struct<header, raw, body>>, first what stands before any (header '').

    A header opens a line, in any case, or stands in capitals anywhere, and is followed by a colon; ``header`` is in
    capitals and in the singular, ``raw`` has the header too.
    """
    plain = F.translate(note, _PIECE + _BODY, "")
    longest = "|".join(sorted(HEADERS, key=len, reverse=True))
    at_line = F.regexp_replace(plain, rf"(?im)^[ \t]*(?:{longest})S?[ \t]*:", _PIECE + "$0" + _BODY)
    marked = F.regexp_replace(at_line, rf"\b(?<!{_PIECE})(?:{longest})S?[ \t]*:(?!{_BODY})", _PIECE + "$0" + _BODY)

    def cut(piece: Column) -> Column:
        named = F.contains(piece, F.lit(_BODY))
        header = F.regexp_replace(F.upper(F.split(piece, _BODY, 2)[0]), r"^\s+|S?\s*:$", "")
        return F.struct(F.when(named, header).otherwise("").alias("header"), F.translate(piece, _BODY, "").alias("raw"), F.when(named, F.get(F.split(piece, _BODY, 2), F.lit(1))).otherwise(piece).alias("body"))

    return F.transform(F.split(marked, _PIECE, -1), cut)


def _section(cut: Column, section: str) -> Column:
    """The first piece with a header of the section and all that follows, up to a header that ends it; '' without one."""
    opens, ends = SECTIONS[section]
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    walked = F.aggregate(
        cut, state(F.lit(0), F.lit("")),
        lambda s, p: F.when((s["at"] == 0) & p["header"].isin(*opens), state(F.lit(1), p["body"]))
        .when((s["at"] == 1) & p["header"].isin(*ends), state(F.lit(2), s["out"]))
        .when(s["at"] == 1, state(F.lit(1), F.concat(s["out"], p["raw"]))).otherwise(s),
        lambda s: s["out"],
    )
    return F.regexp_replace(walked, r"(?s)\n[ \t]*\n.*", "") if section == "indication" else walked


def _body(cut: Column, note: Column) -> Column:
    """What follows the first header of findings or impression; without one the note."""
    main = lambda p: p["header"].isin("FINDING", "IMPRESSION", "CONCLUSION")
    rest = F.aggregate(
        cut, F.struct(F.lit(False).alias("on"), F.lit("").alias("out")),
        lambda s, p: F.when(s["on"], F.struct(F.lit(True).alias("on"), F.concat(s["out"], p["raw"]).alias("out"))).when(main(p), F.struct(F.lit(True).alias("on"), p["body"].alias("out"))).otherwise(s),
        lambda s: s["out"],
    )
    return F.when(F.exists(cut, main), rest).otherwise(note)


def report_section(c: Column, section: str) -> Column:
    """A section of a report as one line. findings and impression stand in for each other, both joins them, full is the
    whole note; without these headers they are the note, and where these are there with nothing to say, what follows the
    first of them. indication, up to a blank line, stands alone. A blank note and a missing indication give ''."""
    if section not in (*SECTIONS, "both", "full"):
        raise ValueError(f"section must be findings, impression, both, indication or full, not {section!r}")
    text = F.coalesce(c, F.lit(""))
    if section == "full":
        return squeeze(text)

    def chosen(p: Column) -> Column:
        found = lambda name: squeeze(_section(p["cut"], name))
        if section == "indication":
            return found(section)
        if section == "both":
            got = squeeze(F.concat_ws(" ", found("findings"), found("impression")))
            return F.when(got != "", got).otherwise(squeeze(_body(p["cut"], text)))
        other = "impression" if section == "findings" else "findings"
        return F.coalesce(F.nullif(found(section), F.lit("")), F.nullif(found(other), F.lit("")), squeeze(_body(p["cut"], text)))

    return bound(chosen, cut=pieces(text))
