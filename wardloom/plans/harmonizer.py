"""Turns a source into a contract table: a declared spec, hooks that are DataFrame functions, and checks of the result."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, scalars
from ..operators import guards
from ..operators import relational as R

Hook = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Join:
    """A table of one row for each key that adds columns; ``how`` is inner, or left to keep rows without a partner."""

    table: DataFrame
    on: tuple[str, ...]
    how: str = "inner"
    what: str = "labels"


@dataclass(frozen=True)
class Spec:
    """What a source declares. Columns are named as in the source; hooks run in order, before the joins."""

    name: str
    patient: Column
    study: Column
    image: Column
    labels: tuple[str, ...] = ()
    regressions: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()
    age: tuple[str, str] | None = None  # column and unit
    sex: str | None = None
    view: str | None = None
    series: str | None = None
    report: str | None = None
    box: str | None = None
    box_labels: str | None = None
    hooks: tuple[Hook, ...] = ()
    joins: tuple[Join, ...] = ()
    codes: str | None = None  # negative or nan: the rule of labels that are not mentioned
    drop_uncertain: bool = False
    options: dict = field(default_factory=dict)


def harmonize(source: DataFrame, spec: Spec, studies: Iterable | DataFrame | None = None, patients: Iterable | DataFrame | None = None) -> DataFrame:
    """The contract table of a source: a lazy plan in which filters by id reach the scan. No job runs while it is built; a
    key that a joined table has twice stops the query."""
    df = source
    for hook in spec.hooks:
        df = hook(df)
    df = df.withColumns({"patient_id": spec.patient.cast("string"), "study_id": spec.study.cast("string"), "image_path": spec.image.cast("string")})
    if studies is not None:
        df = R.keep_ids(df, "study_id", studies)
    if patients is not None:
        df = R.keep_ids(df, "patient_id", patients)
    for j in spec.joins:
        df = guards.join_unique(df, j.table, list(j.on), j.how, j.what)
    new: dict[str, Column] = {}
    if spec.series:
        new["series_id"] = F.col(spec.series).cast("string")
    if spec.age:
        new["age_years"] = scalars.age_years(F.col(spec.age[0]), spec.age[1])
    if spec.sex:
        new["sex"] = scalars.sex(F.col(spec.sex))
    if spec.view:
        new["view_position"] = scalars.view(F.col(spec.view))
    if spec.report:
        new["report"] = F.col(spec.report)
    names = {c: scalars_snake(c) for c in spec.labels}
    values = scalars.codes(list(spec.labels), spec.codes) if spec.codes else {c: F.col(c).cast("double") for c in spec.labels}
    df = df.withColumns(new | {names[c]: v for c, v in values.items()}) if new or values else df
    if spec.drop_uncertain:
        for c in names.values():
            df = df.where(F.coalesce(F.col(c) != -1, F.lit(True)))
    if spec.box:
        own = [spec.box_labels] if spec.box_labels else []
        kept = boxes.clip_with(F.col(spec.box), *(F.col(c) for c in own))
        df = df.withColumn("__kept", kept).withColumn("bbox", F.transform("__kept", lambda z: z["box"]))
        if own:
            df = df.withColumn("bbox_labels", F.transform("__kept", lambda z: scalars.box_label(z["p0"])))
    return R.contract(df, names.values(), spec.regressions, spec.extra)


def scalars_snake(name: str) -> str:
    return name.lower().replace(" ", "_")


def samples(table: DataFrame, labels: Iterable[str] = (), regressions: Iterable[str] = (), base: str = "", outputs: Iterable[str] = ()) -> DataFrame:
    """One nested record for each usable row: img, cls, reg and the outputs asked for, labels in order of name."""
    rows = R.usable_rows(table, *outputs)
    path = lambda c: F.concat(F.lit(base.rstrip("/") + "/"), F.col(c)) if base else F.col(c)
    fields = [path("image_path").alias("img")]
    if labels := sorted(labels):
        fields.append(F.array(*(F.col(c).cast("double") for c in labels)).alias("cls"))
    if regressions := list(regressions):
        fields.append(F.array(*(F.col(c).cast("double") for c in regressions)).alias("reg"))
    fields += [(path(c) if c.endswith("_path") else F.col(c)).alias(c) for c in outputs]
    return rows.select("patient_id", "study_id", F.struct(*fields).alias("sample"))


def integrity(table: DataFrame, labels: Iterable[str] = (), regressions: Iterable[str] = (), keys: Iterable[str] = ()) -> DataFrame:
    """One row, or one for each of ``keys``: counts of what is missing, blank, invalid or not finite, and a status.

    ERROR: no rows, invalid boxes, or regressions that are NaN or infinite. WARN: some paths blank, all labels of a row
    null everywhere, or all masks or reports blank. Else OK.
    """
    labels, regressions = sorted(labels), list(regressions)
    has = lambda c: c in table.columns
    blank = lambda c: F.count_if(scalars.is_blank(F.col(c))) if has(c) else F.lit(0)
    no_label = F.coalesce(*(F.col(c) for c in labels)).isNull() if labels else F.lit(False)
    odd = [F.count_if(F.col(c).isNotNull() & ~boxes.finite(F.col(c).cast("double"))) for c in regressions]
    bad = F.sum(F.size(F.filter("bbox", lambda b: ~boxes.valid(b)))) if has("bbox") else F.lit(0)
    row = table.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), blank("image_path").alias("n_blank_image"), blank("mask_path").alias("n_blank_mask"), blank("report").alias("n_blank_report"),
        F.count_if(no_label).alias("n_no_label"), F.coalesce(bad, F.lit(0)).cast("long").alias("n_invalid_boxes"), sum(odd, F.lit(0)).cast("long").alias("n_not_finite"),
        *(F.count_if(F.col(c) == 1).alias(f"pos_{c}") for c in labels), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in labels),
    )
    all_blank = F.lit(False)
    for c in ("mask", "report"):
        if has("mask_path" if c == "mask" else c):
            all_blank = all_blank | (F.col(f"n_blank_{c}") == F.col("n_rows"))
    error = (F.col("n_rows") == 0) | (F.col("n_invalid_boxes") > 0) | (F.col("n_not_finite") > 0)
    warn = (F.col("n_blank_image") > 0) | all_blank | ((F.col("n_no_label") == F.col("n_rows")) if labels else F.lit(False))
    return row.withColumn("status", F.when(error, "ERROR").when(warn, "WARN").otherwise("OK"))


def statistics(table: DataFrame, labels: Iterable[str] = ()) -> DataFrame:
    """One row of counts: images, studies, patients, sexes, ages, boxes and the positives and blanks of each label.

    Images are counted by themselves and the rest by study, then by patient: a task holds a row once, not once for each
    kind of key that is counted. The table is read for either.
    """
    has = lambda c: c in table.columns
    out, how = {}, {"n_studies": F.sum}
    if has("sex"):
        out |= {f"n_{s}": F.count_if(F.col("sex") == s) for s in ("M", "F")}
    if has("age_years"):
        out |= {"age_min": F.min("age_years"), "age_max": F.max("age_years")}
        how |= {"age_min": F.min, "age_max": F.max}
    if has("bbox"):
        out["n_boxes"] = F.sum(F.size("bbox"))
    for c in sorted(labels):
        out |= {f"pos_{c}": F.count_if(F.col(c) == 1), f"null_{c}": F.count_if(F.col(c).isNull())}
    how |= {c: F.sum for c in out if c not in how}
    again = [f(c).alias(c) for c, f in how.items()]
    known = F.col("patient_id").isNotNull() & F.col("study_id").isNotNull()
    studies = table.groupBy("patient_id", "study_id").agg(known.cast("int").alias("n_studies"), *(v.alias(c) for c, v in out.items()))
    rest = studies.groupBy("patient_id").agg(*again).agg(F.count("patient_id").alias("n_patients"), *again)
    images = table.agg(F.count_distinct("image_path").alias("n_images"))
    return images.crossJoin(rest.fillna(0, [c for c, f in how.items() if f is F.sum])).select("n_images", "n_studies", "n_patients", *out)


def same_table(a: DataFrame, b: DataFrame) -> bool:
    """Both have the same columns and rows, counted with repeats."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


#: Specs by name, for callers that choose a source by key.
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    def add(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"{name!r} is registered already")
        REGISTRY[name] = make
        return make

    return add
