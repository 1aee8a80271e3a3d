"""Masks as runs ``start length start length ...`` of pixels from 1, column by column; all inside JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import bound


def _of_numbers(text: Column, f: Callable[[Column, Column], Column], none: Column) -> Column:
    """``f`` of the numbers of a text, read once, and of the places of their pairs; without a pair, ``none``."""
    numbers = F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), lambda x: x.cast("long"))
    pairs = lambda n: F.sequence(F.lit(0), (F.size(n) / 2).cast("int") - 1)
    return bound(lambda p: F.when(F.coalesce(F.size(p["n"]) >= 2, F.lit(False)), f(p["n"], pairs(p["n"]))).otherwise(none), n=numbers)


def runs(text: Column) -> Column:
    """The runs of a text as structs (first, last), pixels from 0. Null and ``-1`` (nothing found) have none."""
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    pair = lambda n: lambda i: F.struct((F.get(n, 2 * i) - 1).alias("first"), (F.get(n, 2 * i) + F.get(n, 2 * i + 1) - 2).alias("last"))
    return _of_numbers(F.trim(text), lambda n, pairs: F.transform(pairs, pair(n)), none)


def area(r: Column) -> Column:
    """Pixels of runs that do not overlap."""
    return F.aggregate(r, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)


def union(r: Column) -> Column:
    """Runs merged where they overlap or touch, by place."""
    none, long = F.array().cast("array<struct<first:bigint,last:bigint>>"), F.lit(None).cast("long")
    state = lambda done, first, last: F.struct(done.alias("done"), first.alias("first"), last.alias("last"))
    closed = lambda s: F.when(s["first"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["last"].alias("last")))))
    merge = lambda s, x: F.when(x["first"] <= s["last"] + 1, state(s["done"], s["first"], F.greatest(s["last"], x["last"]))).otherwise(state(closed(s), x["first"], x["last"]))
    return F.aggregate(F.sort_array(r), state(none, long, long), merge, closed)


def common(a: Column, b: Column) -> Column:
    """Pixels in both masks, each a union of runs."""
    each = lambda x: F.aggregate(b, F.lit(0).cast("long"), lambda n, y: n + F.greatest(F.lit(0).cast("long"), F.least(x["last"], y["last"]) - F.greatest(x["first"], y["first"]) + 1))
    return F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + each(x))


def counts(reference: Column, found: Column, pixels: Column) -> dict[str, Column]:
    """tp, fp, fn and tn of a mask against its reference."""
    tp, a, b = common(reference, found), area(reference), area(found)
    return {"tp": tp, "fp": b - tp, "fn": a - tp, "tn": pixels - a - b + tp}


def bounds(r: Column, height: int, width: int) -> Column:
    """The box around a mask as fractions, rows first; null for an empty one. A run over a column's end fills its height."""
    column = lambda p: F.floor(p / height)
    spans = lambda x: column(x["first"]) < column(x["last"])
    top = F.array_min(F.transform(r, lambda x: F.when(spans(x), F.lit(0).cast("long")).otherwise(x["first"] % height)))
    bottom = F.array_max(F.transform(r, lambda x: F.when(spans(x), F.lit(height - 1).cast("long")).otherwise(x["last"] % height)))
    left, right = F.array_min(F.transform(r, lambda x: column(x["first"]))), F.array_max(F.transform(r, lambda x: column(x["last"])))
    return F.when(F.size(r) > 0, F.array(top / height, (bottom + 1) / height, left / width, (right + 1) / width))


def runs_of_gaps(text: Column) -> Column:
    """The runs of a text whose starts count from the end of the run before, from 0: ``encode(..., gaps=True)`` undone."""
    step = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("runs"))

    def add(n: Column, s: Column, i: Column) -> Column:
        first = s["at"] + F.get(n, 2 * i)
        end = first + F.get(n, 2 * i + 1)
        return F.struct(end.alias("at"), F.concat(s["runs"], F.array(F.struct(first.alias("first"), (end - 1).alias("last")))).alias("runs"))

    return _of_numbers(text, lambda n, pairs: F.aggregate(pairs, step, lambda s, i: add(n, s, i), lambda s: s["runs"]), step["runs"])


def _word_runs(word: Column, bits: Column) -> Column:
    """The runs of the set bits of a number that is not negative; its lowest bit is the pixel ``word``."""
    place = lambda x: word + F.bit_count(x.bitwiseAND(-x) - 1)
    rest = lambda x: x.bitwiseAND(x - 1)
    firsts, lasts = bits.bitwiseAND(F.bitwise_not(F.shiftleft(bits, 1))), bits.bitwiseAND(F.bitwise_not(F.shiftright(bits, 1)))
    state = F.struct(firsts.alias("a"), lasts.alias("b"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("runs"))
    run = lambda s: F.struct(place(s["a"]).alias("first"), place(s["b"]).alias("last"))
    step = lambda s, _: F.struct(rest(s["a"]).alias("a"), rest(s["b"]).alias("b"), F.concat(s["runs"], F.array(run(s))).alias("runs"))
    return F.aggregate(F.array_repeat(F.lit(0), F.bit_count(firsts)), state, step, lambda s: s["runs"])


def _runs(pixels: DataFrame, key: list[str], stretch: int) -> DataFrame:
    """key, first, last and asked of every run, from ``__p`` and ``__n``; a row without a pixel gives one without a place."""
    size = min(stretch, 62)  # bits of a number, without its sign and with a carry to spare
    within = F.pmod("__p", F.lit(size))
    words = pixels.groupBy(*key, (F.col("__p") - within).alias("__w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), within.cast("int"))).alias("__bits"), F.sum("__n").alias("__n"))
    parts = words.select(*key, "__n", F.inline_outer(F.when(F.col("__w").isNotNull(), _word_runs(F.col("__w"), F.col("__bits")))))
    along = Window.partitionBy(*key).orderBy("first")
    begins = F.coalesce(F.col("first") != F.lag("last").over(along) + 1, F.lit(True)).cast("int")
    nth = parts.withColumn("__b", begins).withColumn("__r", F.sum("__b").over(along))
    return nth.groupBy(*key, "__r").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("__n").alias("__n")).drop("__r")


def pixel_runs(pixels: DataFrame, key: list[str], pixel: str = "pixel", stretch: int = 62) -> DataFrame:
    """key, first and last of every run of adjacent pixels, from 0. Null pixels and repeated ones do not count.

    ``stretch`` pixels, 62 at most, are kept as the bits of one number before anything is shuffled; what one task sorts of a
    mask is the runs of these numbers, which are joined where they meet.
    """
    rows = pixels.where(F.col(pixel).isNotNull()).select(*key, F.col(pixel).cast("long").alias("__p"), F.lit(0).alias("__n"))
    return _runs(rows, key, stretch).drop("__n")


def encode(pixels: DataFrame, keys: DataFrame, key: list[str], pixel: str = "pixel", gaps: bool = False, stretch: int = 62) -> DataFrame:
    """key and ``mask`` of every row of ``keys`` (one for each mask): the runs of its pixels as text, ``-1`` without any.

    Pixels count from 0, column by column. A run is its first pixel, from 1, and its length, as ``runs`` reads them; with
    ``gaps``, the pixels since the end of the run before, from 0, as ``runs_of_gaps`` does. Null is a key like others.
    Rows of ``keys`` go along with the pixels as rows without one, so that nothing is joined.
    """
    rows = pixels.where(F.col(pixel).isNotNull()).select(*key, F.col(pixel).cast("long").alias("__p"), F.lit(0).alias("__n"))
    found = _runs(rows.unionAll(keys.select(*key, F.lit(None).cast("long"), F.lit(1))), key, stretch)
    before = F.coalesce(F.lag("last").over(Window.partitionBy(*key).orderBy("first")) + 1, F.lit(0))
    found = found.withColumn("start", F.col("first") - before if gaps else F.col("first") + 1)
    item = F.struct("first", F.concat_ws(" ", F.col("start").cast("string"), (F.col("last") - F.col("first") + 1).cast("string")).alias("run"))
    items = F.array_sort(F.collect_list(F.when(F.col("first").isNotNull(), item)))
    texts = found.groupBy(*key).agg(F.array_join(F.transform(items, lambda x: x["run"]), " ").alias("mask"), F.sum("__n").cast("int").alias("__n")).where("__n > 0")
    mask = F.coalesce(F.nullif("mask", F.lit("")), F.lit("-1")).alias("mask")
    return texts.select(*key, mask, F.explode(F.array_repeat(F.lit(0), F.col("__n")))).select(*(F.col(k).cast(keys.schema[k].dataType).alias(k) for k in key), "mask")
