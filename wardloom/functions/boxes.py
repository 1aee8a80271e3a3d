"""Boxes as arrays of fractions ``[dim0_min, dim0_max, dim1_min, dim1_max, ...]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))


def from_xywh(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Pixels of a corner and a size, as fractions of the image, rows first."""
    return F.array(y / height, (y + h) / height, x / width, (x + w) / width)


def from_corners(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Pixels of two corners as fractions; an inverted or empty box is null."""
    return F.when((x0 < x1) & (y0 < y1), F.array(y0 / height, y1 / height, x0 / width, x1 / width))


def _minima(box: Column) -> Column:
    return F.filter(box, lambda v, i: i % 2 == 0)


def _maxima(box: Column) -> Column:
    return F.filter(box, lambda v, i: i % 2 == 1)


def ordered(box: Column) -> Column:
    """Each minimum is under its maximum."""
    return F.forall(F.zip_with(_minima(box), _maxima(box), lambda a, b: a < b), lambda ok: ok)


def clip(box: Column) -> Column:
    """Clipped to [0, 1]; null if no area is left. A box with a value that is not finite stays as it is."""
    clipped = F.transform(box, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    return F.when(~F.forall(box, finite), box).when(ordered(clipped), clipped)


def clip_with(boxes: Column, *parallel: Column) -> Column:
    """The boxes that keep an area, clipped, each in a struct (box, p0, p1, ...) with its entries of the parallel arrays."""
    # Names are bound once for the zip, so that one pass drops a box with its labels.
    zipped = F.arrays_zip(boxes.alias("box"), *(p.alias(f"p{i}") for i, p in enumerate(parallel)))
    kept = F.transform(zipped, lambda z: F.struct(clip(z["box"]).alias("box"), *(z[f"p{i}"].alias(f"p{i}") for i in range(len(parallel)))))
    return F.filter(kept, lambda z: z["box"].isNotNull())


def valid(box: Column) -> Column:
    """Four or six values, all in [0, 1], each minimum under its maximum."""
    inside = F.forall(box, lambda v: finite(v) & v.between(0.0, 1.0))
    return F.coalesce(F.size(box).isin(4, 6) & inside & ordered(box), F.lit(False))


def flip(box: Column, axis: int) -> Column:
    """Mirrored along an axis (from 0)."""
    return F.transform(box, lambda v, i: F.when(i == 2 * axis, 1.0 - F.get(box, F.lit(2 * axis + 1))).when(i == 2 * axis + 1, 1.0 - F.get(box, F.lit(2 * axis))).otherwise(v))


def swap_axes(box: Column) -> Column:
    """The first two axes exchanged."""
    return F.concat(F.slice(box, 3, 2), F.slice(box, 1, 2), F.slice(box, 5, 2))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes in the plane; 0 if the union is empty."""
    side = lambda box, i: F.get(box, F.lit(2 * i + 1)) - F.get(box, F.lit(2 * i))
    inner = lambda i: F.greatest(F.lit(0.0), F.least(F.get(a, F.lit(2 * i + 1)), F.get(b, F.lit(2 * i + 1))) - F.greatest(F.get(a, F.lit(2 * i)), F.get(b, F.lit(2 * i))))
    both = inner(0) * inner(1)
    union = side(a, 0) * side(a, 1) + side(b, 0) * side(b, 1) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def parse(text: Column) -> Column:
    """Boxes from JSON text: a list of boxes, or one box. Null, blank and unreadable texts are null."""
    nested = F.from_json(text, "array<array<double>>")
    flat = F.from_json(text, "array<double>")
    return F.when(F.forall(nested, lambda b: b.isNotNull()), nested).when(F.size(flat) > 0, F.array(flat)).when(F.trim(text) == "[]", F.array().cast("array<array<double>>"))


def merge_readers(boxes: Column, threshold: float = 0.5, readers: int = 2) -> Column:
    """Boxes that readers agree on: greedy groups, in the order given, by overlap with a group's first box.

    ``boxes`` is an array of structs (reader, box). A group counts if at least ``readers`` different readers are in it;
    its box is the mean. The fold runs inside one image, whose boxes are few.
    """
    empty = F.array().cast("array<array<struct<reader:string,box:array<double>>>>")

    def add(groups: Column, item: Column) -> Column:
        own = F.array(F.struct(item["reader"].cast("string").alias("reader"), item["box"].cast("array<double>").alias("box")))
        fits = F.transform(groups, lambda g: iou(F.get(g, F.lit(0))["box"], item["box"]) >= threshold)
        place = F.array_position(fits, F.lit(True))
        joined = F.transform(groups, lambda g, i: F.when(i + 1 == place, F.concat(g, own)).otherwise(g))
        return F.when(place > 0, joined).otherwise(F.concat(groups, F.array(own)))

    groups = F.aggregate(boxes, empty, add)
    agreed = F.filter(groups, lambda g: F.size(F.array_distinct(F.transform(g, lambda x: x["reader"]))) >= readers)
    mean = lambda g, i: F.aggregate(g, F.lit(0.0), lambda s, x: s + F.get(x["box"], F.lit(i))) / F.size(g)
    return F.transform(agreed, lambda g: F.array(*(mean(g, i) for i in range(4))))
