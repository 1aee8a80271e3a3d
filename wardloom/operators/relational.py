"""Projections, filters, guarded joins and picks of one row for each key."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from ..functions.scalars import is_blank, strip

# The order of a contract table.
REQUIRED = ["patient_id", "study_id", "image_path"]
OPTIONAL = ["series_id", "view_position", "mask_path", "bbox", "bbox_labels", "report", "age_years", "sex"]
QUESTION_REQUIRED = ["patient_id", "study_id", "question_id", "image_path", "question", "answer"]
QUESTION_OPTIONAL = ["answer_struct", "question_type", "quality", "split"]


def contract(df: DataFrame, labels: Iterable[str] = (), regressions: Iterable[str] = (), extra: Iterable[str] = ()) -> DataFrame:
    """The columns that exist, in contract order: required ones, optional ones, labels by name, regressions, extra."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    wanted = [*REQUIRED, *OPTIONAL, *sorted(labels), *regressions, *extra]
    return df.select(*(c for c in dict.fromkeys(wanted) if c in df.columns)).where("image_path IS NOT NULL")


def question_contract(df: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    missing = [c for c in QUESTION_REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*QUESTION_REQUIRED, *(c for c in (*QUESTION_OPTIONAL, *extra) if c in df.columns))


def keep_ids(df: DataFrame, column: str, ids: Iterable | DataFrame) -> DataFrame:
    """Rows whose id, as text, is among the ids: a predicate that reaches the scan, or a semi-join with a table."""
    if isinstance(ids, DataFrame):
        keys = ids.select(F.col(ids.columns[0]).cast("string").alias("__id"))
        return df.join(keys, F.col(column).cast("string") == keys["__id"], "left_semi")
    return df.where(F.col(column).cast("string").isin(*map(str, ids)))


def drop_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    keys = ids.select(F.col(ids.columns[0]).cast("string").alias("__id"))
    return df.join(keys, F.col(column).cast("string") == keys["__id"], "left_anti")


def usable_rows(df: DataFrame, *outputs: str) -> DataFrame:
    """Rows with an image path and, of the outputs asked for, a path or report that is not blank; boxes drop no row."""
    needed = ["image_path", *(c for c in outputs if c in df.columns and (c.endswith("_path") or c == "report"))]
    for c in needed:
        df = df.where(~is_blank(F.col(c)))
    return df


def keep_split(df: DataFrame, split: str, columns: Iterable[str] = ("split", "Split")) -> DataFrame:
    own = [c for c in columns if c in df.columns]
    if not own:
        raise ValueError(f"no split column among {list(columns)}")
    return df.where(F.col(own[0]).cast("string") == split)


def duplicate_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """The keys that more than one row has, with their number of rows."""
    return df.groupBy(*on).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def join_unique(df: DataFrame, source: DataFrame, on: list[str], how: str = "inner", what: str = "source") -> DataFrame:
    """A join with a table of one row for each key; a repeated key raises, with the key shown."""
    first = duplicate_keys(source, on).limit(1).collect()
    if first:
        raise ValueError(f"{what} has {first[0].n_rows} rows for the key {tuple(first[0][c] for c in on)}")
    return df.join(source, on, how)


def unmatched(df: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a partner."""
    return df.join(source.select(*on), on, "left_anti")


def first_row(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an explicit order, whole, nulls and all."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_known(df: DataFrame, keys: list[str], order: list[Column | str], column: str, name: str) -> DataFrame:
    """Adds the first value of the key that is not null; a key without one has null. Null is a key of its own.

    Each task finds its own first rows before the shuffle, so a key with very many rows is no large group.
    """
    first = first_row(df.where(F.col(column).isNotNull()).select(*keys, *(c for c in df.columns if c not in keys)), keys, order)
    first = first.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(column).alias(name))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    return df.drop(name).join(first, same, "left").drop(*(f"__k{i}" for i in range(len(keys))))


def star(fact: DataFrame, dimensions: Iterable[tuple[DataFrame, str]]) -> DataFrame:
    """Left joins of a fact table with tables of one row for each key."""
    for table, key in dimensions:
        fact = fact.join(table, key, "left")
    return fact


def resolve(sources: dict[str, Column]) -> tuple[Column, Column]:
    """The first value that is not null, by order of precedence, and the name of its source."""
    name = F.coalesce(*(F.when(c.isNotNull(), F.lit(k)) for k, c in sources.items()))
    return F.coalesce(*sources.values()), name


def missing_and_unused(expected: DataFrame, listing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose file is not in a listing, and those whose file is."""
    files = listing.select(key).distinct()
    return expected.join(files, key, "left_anti"), expected.join(files, key, "left_semi")


def join_required(df: DataFrame, source: DataFrame, on: list[str], what: str = "source") -> DataFrame:
    """An inner join with a table of one row for each key in which every key must be; a missing one raises, and is shown."""
    lost = df.select(*on).join(source.select(*on), on, "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"{what} has no row for the key {tuple(lost[0])}")
    return join_unique(df, source, on, what=what)


def join_one_to_one(df: DataFrame, source: DataFrame, on: list[str], what: str = "source") -> DataFrame:
    """A left join of two tables of one row for each key; a repeated key of either side raises."""
    first = duplicate_keys(df, on).limit(1).collect()
    if first:
        raise ValueError(f"the left side of {what} has {first[0].n_rows} rows for the key {tuple(first[0][c] for c in on)}")
    return join_unique(df, source, on, "left", what)


def conflicting_keys(df: DataFrame, on: list[str], within: DataFrame | None = None) -> DataFrame:
    """Keys with several different rows, of those that ``within`` has."""
    keys = df.distinct().groupBy(*on).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    return keys.join(within.select(*on), on, "left_semi") if within is not None else keys


def number_groups(df: DataFrame, group: str, position: str, ranges: int = 64) -> DataFrame:
    """``group`` and ``number`` from 0, in the order of first appearance (the smallest position; ties by group).

    Groups are dealt by ranges of their first position and numbered inside each, after the counts of the ranges before
    it, so that no task sorts them all. Bounds from approximate quantiles only change how even the ranges are.
    """
    first = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(position).alias("__p"))
    marks = sorted(set(first.approxQuantile("__p", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))))
    at = F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: m < F.col("__p"))) if marks else F.lit(0)
    first = first.withColumn("__r", at)
    counts = {r["__r"]: r.n for r in first.groupBy("__r").agg(F.count("*").alias("n")).collect()}
    starts = [sum(counts.get(j, 0) for j in range(i)) for i in range(len(marks) + 1)]
    inside = F.row_number().over(Window.partitionBy("__r").orderBy("__p", group)) - 1
    return first.select(group, (F.element_at(F.array(*map(F.lit, starts)), F.col("__r") + 1) + inside).cast("long").alias("number"))


def places(df: DataFrame, order: list[Column], lead: list[str], position: str, ranges: int = 64) -> DataFrame:
    """Adds ``place``, from 1, of each row in ``order``: the columns ``lead``, in any direction, then ``position``, a number
    that rises, then what breaks ties. Nulls of the position come first or last, as its order says.

    Rows are dealt by lead and ranges of position and numbered inside each, after the counts of what comes before, so that
    no task sorts them all. Bounds from approximate quantiles only change how even the ranges are.
    """
    marks = sorted(set(df.approxQuantile(position, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))))
    at = F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: m < F.col(position))) if marks else F.lit(0)
    last = "NULLS LAST" in str(order[len(lead)]).upper()
    at = F.when(F.col(position).isNull(), len(marks) + 1 if last else -1).otherwise(at)
    rows, keys = df.withColumn("__r", at), [*lead, "__r"]
    before = F.sum("__n").over(Window.orderBy(*order[: len(lead)], "__r").rowsBetween(Window.unboundedPreceding, -1))
    # A row for each lead and range is what goes through one task here.
    parts = rows.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(before, F.lit(0)))
    parts = parts.select("__before", *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)))
    rows = rows.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    return rows.join(parts, same).select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__before") + F.col("__i")).cast("long").alias("place"))


def pivot_complete(df: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """One value for each row and name; names that miss a value in any row are left out."""
    wide = df.groupBy(row).pivot(column, names).agg(F.first(value, ignorenulls=True))
    holes = wide.agg(*(F.count_if(F.col(f"`{n}`").isNull()).alias(n) for n in names)).first()
    return wide.select(row, *(n for n in names if not holes[n]))


def left_join_once(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join that keeps the number of rows: a key that stands twice on the right, and is met, stops the query."""
    many = F.count(F.lit(1)).over(Window.partitionBy(*on))
    once = right.withColumn("__n", many)
    guard = F.when(F.col("__n") > 1, F.raise_error(F.concat_ws(" ", F.lit("the right side has a key twice:"), *on))).otherwise(F.lit(True))
    return left.join(once, on, "left").where(guard).drop("__n")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The same rows; none at all raise."""
    if df.isEmpty():
        raise ValueError(f"{what}: 0 rows")
    return df


def side_by_side(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Two tables row by row, in the order of a number each, as long as both last."""
    a, b = (places(df, [F.asc(key)], [], key) for df, key in ((left, left_key), (right, right_key)))
    return a.join(b, "place")


def flat_numbers(value: Column, kind: StructType, prefix: str = "") -> list[Column]:
    """The numeric leaves of nested structs, named by their path joined with ``_``; other leaves are left out."""
    out: list[Column] = []
    for f in kind:
        if isinstance(f.dataType, StructType):
            out += flat_numbers(value[f.name], f.dataType, f"{prefix}{f.name}_")
        elif isinstance(f.dataType, NumericType):
            out.append(value[f.name].alias(prefix + f.name))
    return out


def visits(df: DataFrame, patient: str, date: str) -> DataFrame:
    """Adds ``visit_number``, from 1 by distinct dates of the patient, and ``days_from_first``; null without a date or without a patient.

    The dates of a patient are numbered, not the rows, so a patient with very many images is no large group.
    """
    dates = df.where(F.col(date).isNotNull()).groupBy(patient, date).agg(F.lit(1).alias("__one")).drop("__one")
    w = Window.partitionBy(patient).orderBy(date)
    numbered = dates.select(patient, date, F.row_number().over(w).alias("visit_number"), F.datediff(date, F.min(date).over(w)).alias("days_from_first"))
    return df.join(numbered, [patient, date], "left")


def label_columns(columns: Iterable[str]) -> list[str]:
    """Label names in the order of their snake-case form, ties by name: the order of a class vector."""
    return sorted(columns, key=lambda c: (c.lower().replace(" ", "_"), c))


def renamed_labels(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Label columns of one release under the names of another; a name that is taken already raises."""
    own = {a: b for a, b in names.items() if a in df.columns}
    taken = sorted(set(own.values()) & set(df.columns))
    if taken:
        raise ValueError(f"columns that exist already: {taken}")
    return df.withColumnsRenamed(own)


def folder_status(expected: DataFrame, listing: DataFrame, path: str, size: str = "length") -> DataFrame:
    """``folder`` and ``status`` of each parent folder of the expected paths: missing, empty (no file with bytes) or ok."""
    parent = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    there = listing.groupBy(parent(F.col(path)).alias("folder")).agg(F.max(size).alias("__most"))
    status = F.when(F.col("__most").isNull(), "missing").when(F.col("__most") == 0, "empty").otherwise("ok")
    return expected.select(parent(F.col(path)).alias("folder")).distinct().join(there, "folder", "left").select("folder", status.alias("status"))


def file_status(expected: DataFrame, files: DataFrame, key: str, readable: Column) -> DataFrame:
    """``key`` and ``status`` of each expected file: missing, unreadable (``readable`` is not true) or ok.

    ``files`` has a row for each file that is there; of a file listed twice, one that can be read is enough.
    """
    there = files.groupBy(key).agg(F.max(F.coalesce(readable, F.lit(False))).alias("__ok"))
    status = F.when(F.col("__ok").isNull(), "missing").when(F.col("__ok"), "ok").otherwise("unreadable")
    return expected.join(there, key, "left").select(key, status.alias("status"))


def keep_positives(df: DataFrame, finding: str, controls: Iterable[str] = ("no finding", "normal")) -> DataFrame:
    """Rows with a finding that is not a control; the number of boxes says nothing about that."""
    return df.where(F.col(finding).isNotNull() & ~F.lower(strip(F.col(finding))).isin(*controls))
