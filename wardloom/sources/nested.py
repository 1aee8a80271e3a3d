"""Rows from nested and free texts: JSON objects and annotations, XML reports, ragged lines, clinical notes and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strip


def object_rows(df: DataFrame, column: str, value: str) -> DataFrame:
    """A row for each entry of a JSON object: the other columns, ``key`` and the fields of the record."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(F.from_json(column, f"map<string,{value}>"))).select(*others, "key", "value.*")


def annotation_rows(df: DataFrame, column: str, item: str) -> DataFrame:
    """A row for each annotation of a JSON array, with the fields of the annotation. Empty and unreadable arrays have none."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.inline(F.from_json(column, f"array<{item}>")))


def parallel_rows(df: DataFrame, lists: list[str]) -> DataFrame:
    """A row for each place of lists of the same length, with the columns of the lists; lists of other lengths raise."""
    others = [c for c in df.columns if c not in lists]
    same = F.lit(True)
    for c in lists[1:]:
        same = same & (F.size(c) == F.size(lists[0]))
    zipped = F.when(same, F.arrays_zip(*lists)).otherwise(F.raise_error(F.lit(f"lists {lists} differ in length")))
    return df.select(*others, F.inline(zipped))


def fields_of_lines(lines: Column, least: int, separator: str = "\t") -> Column:
    """The fields of each line that has at least so many."""
    return F.filter(F.transform(F.split(lines, "\r?\n", -1), lambda x: F.split(x, separator, -1)), lambda f: F.size(f) >= least)


def name_fields(path: Column, pattern: str, names: list[str]) -> Column:
    """A struct of the groups of a file name; null where the name does not match."""
    found = F.regexp_extract_all(path, F.lit(pattern), 0)
    return F.when(F.size(found) > 0, F.struct(*(F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names))))


def clinical_note(text: Column) -> Column:
    """sex (M, F), age (years) and finding of a note such as ``male 45yrs`` over lines of findings; what is not there is null."""
    first = F.lower(F.get(F.split(strip(text), r"\s*\n\s*"), F.lit(0)))
    age = F.nullif(F.regexp_extract(first, r"(\d{1,3})\s*(?:yrs?|years?|y)\b", 1), F.lit("")).cast("double")
    rest = F.trim(F.regexp_replace(F.regexp_replace(strip(text), r"^[^\n]*\n?", ""), r"\s+", " "))
    sex = F.when(first.rlike(r"\bfemale\b"), "F").when(first.rlike(r"\bmale\b"), "M")
    return F.struct(sex.alias("sex"), age.alias("age"), F.nullif(rest, F.lit("")).alias("finding"))
