"""Rows of any columns on their way through Python: the text, and all others in one struct."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(docs: DataFrame) -> DataFrame:
    """``text`` and ``rest``; all other names are free."""
    return docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"), F.lit(0).alias("none")).alias("rest"))


def unpacked(frame: DataFrame, names: list[str]) -> DataFrame:
    """The columns of before, in their order."""
    return frame.select(*(F.col(c) if c == "text" else F.col("rest")[c].alias(c) for c in names))
