"""Scalar rules that single sources need: ages in words, views in two columns, planes, progressions, blank reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import extract, lookup, strip

# The code of a progression, the planes by the axis of a slice's normal, and the verdicts on a figure.
PROGRESSION = {"improving": -1, "stable": 0, "worsening": 1}
PLANES = ("sagittal", "coronal", "axial")
VERDICTS = ("no_radiology", "mixed", "all_radiology")


def age_words(c: Column) -> Column:
    """The number at the start of an age in words: ``85 or more``, ``90+``, ``20-30``. 0 and other words are null.

    ``20-Oct`` is the decile 10-20 as a spreadsheet spoils it, so it gives 10.
    """
    first = extract(c, r"^\s*(\d{1,3})").cast("double")
    return F.when(c.rlike(r"^\s*\d+-Oct\s*$"), 10.0).when(first > 0, first)


def age_at(date: Column, birth_year: Column) -> Column:
    """The year of a date written as the number YYYYMMDD less the year of birth."""
    return F.floor(date / 10000).cast("long") - birth_year


def positive(c: Column) -> Column:
    """1 above 0, 0 at 0, else null."""
    return F.when(c > 0, 1).when(c == 0, 0)


def present(c: Column) -> Column:
    """1 for Present, 0 for Absent, null for any other word."""
    return F.when(c == "Present", 1).when(c == "Absent", 0)


def progression(c: Column) -> Column:
    return lookup(c, PROGRESSION)


def sex_of_flag(male: Column) -> Column:
    """M for true, F for false; null stays null."""
    return F.when(male, "M").when(~male, "F")


def view_of_parts(side: Column, projection: Column) -> Column:
    """LATERAL for a lateral side. Else AP or PA as the projection says, ``Frontal`` without one; null where they clash."""
    known = F.upper(strip(projection)).isin("AP", "PA")
    return F.when(F.lower(side) == "lateral", "LATERAL").when(F.coalesce(projection, F.lit("")) == "", "Frontal").when(known, projection)


def plane(orientation: Column) -> Column:
    """The plane nearest to a slice, from its row and column directions (six numbers); null if they span none."""
    v = [F.get(orientation, F.lit(i)).cast("double") for i in range(6)]
    normal = [F.abs(v[(i + 1) % 3] * v[3 + (i + 2) % 3] - v[(i + 2) % 3] * v[3 + (i + 1) % 3]) for i in range(3)]
    most = F.greatest(*normal)
    named = F.when(normal[0] == most, PLANES[0]).when(normal[1] == most, PLANES[1]).otherwise(PLANES[2])
    return F.when((F.size(orientation) == 6) & (most > 0), named)


def verdict(part: Column, whole: Column) -> Column:
    """What the share of radiology panels says about a figure; null without panels."""
    share = part / F.nullif(whole, F.lit(0))
    return F.when(share <= 0, VERDICTS[0]).when(share <= 0.999, VERDICTS[1]).when(share <= 1, VERDICTS[2])


def blank_report(c: Column) -> Column:
    """Null, or no more than the word report, white space and underscores."""
    rest = F.regexp_replace(F.regexp_replace(c, r"(?i)^\s*report", ""), r"[\s_]+", "")
    return F.coalesce(rest == "", F.lit(True))


def interval_text(mean: Column, low: Column, high: Column) -> Column:
    """``mean [low, high]``, the mean alone without an interval, and '' without a mean."""
    whole = F.format_string("%.3f [%.3f, %.3f]", mean, low, high)
    return F.when(mean.isNull(), "").when(low.isNull() | high.isNull(), F.format_string("%.3f", mean)).otherwise(whole)


def phrase(c: Column, terms: list[str], but: str | None = None) -> Column:
    """A term, also with a plural s, stands in the text as a word; texts that match ``but`` do not count."""
    found = F.coalesce(c.rlike(r"(?i)\b(?:" + "|".join(terms) + r")s?\b"), F.lit(False))
    return found & ~F.coalesce(c.rlike(but), F.lit(False)) if but else found


def leaves_folder(c: Column) -> Column:
    """A step of the path is ``..``."""
    return F.array_contains(F.split(c, "/", -1), "..")


def output_path(c: Column, ending: str) -> Column:
    """A relative path with another ending; one that leaves its folder raises when it is computed."""
    return F.when(leaves_folder(c), F.raise_error(F.concat(F.lit("path leaves its folder: "), c))).otherwise(F.concat(F.regexp_replace(c, r"\.[^./]*$", ""), F.lit(ending)))


def point_box(rank: Column, slices: Column, x: Column, y: Column, width: Column, height: Column, eps: float) -> Column:
    """A box around a point on a slice, as fractions: half a slice deep, ``eps`` to each side."""
    z, half = (rank + 0.5) / slices, 0.5 / slices
    return F.array(z - half, z + half, y / height - eps, y / height + eps, x / width - eps, x / width + eps)


def list_text(c: Column) -> Column:
    """The strings of a list as Python prints it; null if the text cannot be read."""
    return F.from_json(c, "array<string>", {"allowSingleQuotes": "true"})


def list_or_scalar(values: Column, scalar: Column) -> Column:
    """The first of a list or, where there is no list, the scalar."""
    return F.coalesce(F.get(values, F.lit(0)), scalar)


def split_list(c: Column, separator: str = ";") -> Column:
    """The trimmed parts of a text that are not blank."""
    return F.filter(F.transform(F.split(c, separator, -1), strip), lambda x: x != "")


def findings(tokens: Column, wanted: str = "yes") -> Column:
    """Sorted distinct findings of ``category|relation|finding`` tokens whose relation is the wanted one."""
    parts = F.transform(tokens, lambda t: F.split(t, r"\|", -1))
    return F.array_sort(F.array_distinct(F.transform(F.filter(parts, lambda p: F.get(p, F.lit(1)) == wanted), lambda p: F.get(p, F.lit(2)))))
