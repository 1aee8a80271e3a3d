"""Cleaning a corpus for training: each stage works on what its predecessor kept, written as Parquet between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardloom.llm import bpe, decontaminate, jaccard, langid, secrets
from wardloom.llm._lineage import cut, written
from wardloom.llm.queries import tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without any letter (null and empty ones too) and those far from every learned language.

    It learns from the rows with a lang whose id's fold is not 1. Each row is judged by its text alone; equal rows go or
    stay together, and columns of any name stay as they are. An empty table gives an empty one.
    """
    return langid.keep(docs, langid.fit(docs, F.coalesce(langid.fold("doc_id", 3) != 1, F.lit(True))))


def _ordered(kind: T.DataType) -> bool:
    """Whether Spark can order values of a type: none with a map or a variant in it."""
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind)
    return _ordered(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each group that links of similarity 0.8 on 5-word shingles connect.

    A document is a doc_id and a text. Of its rows one stays, with the smallest of the other columns (in their order; those
    that have none, as maps, come last, as JSON). One without an id, and each of an id but that of one text, stands by a
    number from its hash, from 2^62 up, so mostly after those with ids. Columns of any name and type stay as they are.
    """
    rest = [f for f in docs.schema if f.name not in ("doc_id", "text")]
    own = lambda fields: F.struct(*(F.col(f"`{f.name}`") for f in fields), F.lit(0).alias("none"))
    plain, other = ([f for f in rest if _ordered(f.dataType) == wanted] for wanted in (True, False))
    # All names but doc_id and text are ours from here.
    source = docs.select("doc_id", "text", own(rest).alias("rest"), F.struct(own(plain), F.to_json(own(other))).alias("order"))
    h = F.xxhash64("text")
    # Ids of several texts, which have none as a rule.
    shared = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.min(h).alias("first"), F.max(h).alias("last")).where("first <> last")
    shared, rows, unnamed = cut(shared), source, F.col("doc_id").isNull()
    if not shared.isEmpty():
        rows = source.join(shared.hint("shuffle_hash"), F.col("doc_id") == F.col("of"), "left")
        unnamed = unnamed | F.coalesce(h != F.col("first"), F.lit(False))
    number = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    rows = rows.select(*source.columns, F.when(unnamed, number).otherwise(F.col("doc_id").cast("long")).alias("id"))
    found = jaccard.join(rows.select(F.col("id").alias("doc_id"), "text"), 5, 8, 10).groupBy(F.col("doc_id").alias("id"))
    marks = cut(found.agg(F.max(F.col("doc_id") != F.col("component_id")).alias("gone"), (F.count("*") > 1).alias("many")).where("gone OR many"))
    # Only ids are hashed; the texts stream by.
    kept = rows.join(marks.hint("shuffle_hash"), "id", "left_anti").select("doc_id", "text", "rest")
    many = marks.where("NOT gone").select("id")
    if not many.isEmpty():
        one = rows.join(many.hint("shuffle_hash"), "id", "left_semi").groupBy("doc_id", "text").agg(F.min_by("rest", "order").alias("rest"))
        kept = kept.unionByName(one)
    return kept.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold ten words in a row, or all, of a benchmark item. Each row is judged by itself, with
    columns of any name; null and empty texts hold none and stay, and so does all of a corpus without benchmark items."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark, and counts the characters again. Each row is judged by itself and stays, with
    its other columns, whatever their names; null and empty texts have no secrets."""
    found = secrets.scan(docs.select("doc_id", "text", F.struct("*").alias("__columns")))
    clean = found.select("__columns", (F.size("spans") > 0).alias("__found"), secrets.redact(F.col("text"), F.col("spans")).alias("__text"))
    changed = {"text": F.col("__text"), "n_chars": F.when(F.col("__found"), F.char_length("__text").cast("long")).otherwise(F.col("__columns.n_chars")) if "n_chars" in docs.columns else None}
    return clean.select(*(changed[c].alias(c) if c in changed else F.col(f"__columns.`{c}`").alias(c) for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, repeated ones too, with the digests of the ids and of the text decoded from them: those of
    the empty text for a null. Other columns are left out."""
    return bpe.digest(bpe.round_trip(docs, tokenizer()), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_redaction),
    ("bpe", tokens),
]

#: Neither the language model nor the tokenizer can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
