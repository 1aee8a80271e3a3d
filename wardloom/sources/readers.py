"""Sources: each reader gives a lazy DataFrame; schemas are declared, never inferred twice, and NaN never gets in.

Archives and files of other kinds are read by ``binaryFile`` and unpacked where they lie, one archive in one task; only
what Spark's readers can open is read, so an input may be in any store.
"""

from __future__ import annotations

import csv as csv_module
import fnmatch
import io
import json
import os
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import no_nan, strip
from .archives import _opened

# The words of a text table that stand for nothing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def clean(df: DataFrame) -> DataFrame:
    """Null for each NaN of a floating column."""
    return df.select(*(no_nan(F.col(f"`{c}`")).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes))


def csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, columns: list[str] | None = None, sep: str = ",", names: list[str] | None = None, lines: bool = False) -> DataFrame:
    """CSV or TSV with a header, also gzip and many files as one scan. Without a schema every column is text.

    Fields may be quoted, with quotes doubled inside and line breaks in them; the words in ``MISSING`` are null, quoted
    or not, and so is what cannot be read as the declared type. ``names`` replaces the header by position; ``columns``
    prunes the scan. Without ``names`` all files must have one header (that of the schema, if there is one), or the query
    stops; ``csv_by_name`` unites files of several. A file with line breaks in its fields cannot be split: without any, ``lines=True`` reads it in parts.
    """
    reader = spark.read.options(header=True, sep=sep, multiLine=not lines, quote='"', escape='"', enforceSchema=names is not None, inferSchema=False)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if names is None and schema is not None:
        names = schema.names
    df = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path) if names is not None else reader.csv(path)
    kinds = {f.name: f.dataType for f in schema} if schema is not None else {}
    chosen = columns or df.columns
    known = {c: F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")) for c in chosen}
    return clean(df.select(*((x.try_cast(kinds[c]) if c in kinds and kinds[c] != T.StringType() else x).alias(c) for c, x in known.items())))


def csv_by_name(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, columns: list[str] | None = None, sep: str = ",", lines: bool = False) -> DataFrame:
    """Many CSV files whose headers differ in order, or have more or fewer columns, united by name.

    The headers are read first, in one pass over the first lines; files of one header are one scan. A column that a file does
    not have is null there; without ``columns`` or a schema, columns come in the order of their first header, headers by path.
    Types are those of the schema, else text. Values of equal names in two columns of a file cannot be told apart: it raises.
    """
    first = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    heads = first.where("at = 0").groupBy("file").agg(F.min_by("line", "row").alias("line"))
    # What comes here is a row for each header, with the names of its files, which a scan lists on the driver anyway.
    groups = heads.groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parts, names = [], list(columns or (kinds.names if kinds is not None else []))
    for g in sorted(groups, key=lambda g: g.files[0]):
        own = next(csv_module.reader([g.line.removeprefix("\ufeff")], delimiter=sep))
        if len(set(own)) < len(own):
            raise ValueError(f"{g.files[0]} has a column twice: {own}")
        names += [] if columns or kinds is not None else [c for c in own if c not in names]
        part = csv(spark, g.files, names=own, columns=[c for c in own if not names or c in names], sep=sep, lines=lines)
        parts.append(part)
    if not parts:
        return spark.createDataFrame([], kinds if kinds is not None else T.StructType([T.StructField(c, T.StringType()) for c in names]))
    cast = {f.name: f.dataType for f in kinds} if kinds is not None else {}
    shaped = [p.select(*((F.col(f"`{c}`") if c in p.columns else F.lit(None).cast("string")).alias(c) for c in names)) for p in parts]
    whole = reduce(DataFrame.unionByName, shaped)
    return clean(whole.select(*(F.col(f"`{c}`").try_cast(cast[c]).alias(c) if c in cast and cast[c] != T.StringType() else F.col(f"`{c}`") for c in names)))


def ragged_tsv(spark: SparkSession, path: str, least: int) -> DataFrame:
    """Lines with at least so many fields, as ``fields`` array<string>."""
    return spark.read.text(path).select(F.split("value", "\t", -1).alias("fields")).where(F.size("fields") >= least)


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return clean(df.select(*columns) if columns else df)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array of records."""
    return clean(spark.read.schema(schema).option("multiLine", True).json(path))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A record in each line; blank lines are skipped."""
    return clean(spark.read.schema(schema).json(path))


def json_object(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A file that holds one JSON object of records: ``key`` and ``value`` of each."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>"))).select("key", "value")


def xml(spark: SparkSession, path: str, row_tag: str, schema: str | T.StructType) -> DataFrame:
    return clean(spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path))


def texts(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Whole files: path and text; with ``recursive`` those of all folders below too."""
    return spark.read.option("recursiveFileLookup", recursive).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """An allow-list, an id in each line that is not blank."""
    return spark.read.text(path).select(strip(F.col("value")).alias(name)).where(F.col(name) != "")


def _shown(name: str) -> bool:
    """Names that Spark reads: no hidden, unfinished or half-copied ones."""
    return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def _listed(path: str, pattern: str, deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts for each folder of a batch what is in it, or with ``deep`` what is anywhere below; files stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(path)
        names = ["inner", "length", "modified", "more"]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.filter(pc.invert(batch.column("more"))).columns, names)
            folders, out = batch.column("inner").filter(batch.column("more")).to_pylist(), []
            while folders:
                for x in fs.get_file_info(pafs.FileSelector(folders.pop())):
                    if not _shown(x.base_name):
                        continue
                    if x.type == pafs.FileType.Directory:
                        if deep:
                            folders.append(x.path)
                        else:
                            out.append((x.path, None, None, True))
                    elif x.size and fnmatch.fnmatchcase(x.base_name, pattern):
                        out.append((x.path, x.size, x.mtime_ns // 1_000_000, False))
                    if len(out) >= 10_000:
                        yield made(out)
                        out = []
            if out:
                yield made(out)

    return run


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Files as rows: path, name, folder, length, modified. No content is read. Empty files are left out, as Spark plans no read of them.

    Folders are listed by tasks: two levels are dealt, and each folder of the third is walked by one task; nothing but the
    first folder passes the driver. Where pyarrow does not know the store or the path or pattern is one of several, and
    without ``recursive``, Spark lists, which takes all files through the driver.
    """
    try:
        fs, inner = _opened(path)
    except pa.ArrowInvalid:
        fs, inner = None, path
    if fs is None or not recursive or set("*?[{\\") & set(path) or set("[{\\") & set(pattern):
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    else:
        first = fs.get_file_info(inner)
        if first.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        # Paths as Hadoop writes them.
        base = "file:" if isinstance(fs, pafs.LocalFileSystem) else path[: len(path) - len(inner)]
        kinds, parts = "inner string, length long, modified long, more boolean", 2 * spark.sparkContext.defaultParallelism
        folder = first.type == pafs.FileType.Directory
        keep = folder or (first.size and fnmatch.fnmatchcase(first.base_name, pattern))
        rows = spark.range(1 if keep else 0).select(F.lit(inner.rstrip("/") or "/").alias("inner"), F.lit(None if folder else first.size).cast("long").alias("length"), F.lit(None if folder else first.mtime_ns // 1_000_000).cast("long").alias("modified"), F.lit(folder).alias("more"))
        for deep in (False, False, True):
            rows = rows.mapInArrow(_listed(path, pattern, deep), kinds)
            rows = rows if deep else rows.repartition(parts, "inner")
        files = rows.select(F.concat(F.lit(base), "inner").alias("path"), "length", F.timestamp_millis("modified").alias("modified"))
    return files.select("path", F.regexp_replace("path", "^.*/", "").alias("name"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "length", "modified")


def zip_members(spark: SparkSession, path: str, pattern: str = "*.zip", suffix: str = ".json", wanted: set[str] | None = None) -> DataFrame:
    """Members of zip files as text: archive, member, text. ``wanted`` is a list of member names that a caller has at hand."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(suffix) and (wanted is None or name in wanted):
                            yield pa.RecordBatch.from_pydict({"archive": [archive], "member": [name], "text": [z.read(name).decode(errors="replace")]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(members, "archive string, member string, text string")


def tar_members(spark: SparkSession, path: str, pattern: str = "*.tar", suffix: str = ".json") -> DataFrame:
    """Members of tar shards as text: archive, member, text, error. A shard that cannot be read gives one row with its error."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in x], ["archive", "member", "text", "error"])
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as t:
                        for m in t:
                            if m.isfile() and m.name.endswith(suffix):
                                yield row(archive, m.name, t.extractfile(m).read().decode(errors="replace"), None)
                except tarfile.TarError as e:
                    yield row(archive, None, None, str(e))

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(members, "archive string, member string, text string, error string")


def arrays(spark: SparkSession, path: str, pattern: str = "*.np[yz]", key: str | None = None) -> DataFrame:
    """Saved numpy vectors: path and embedding (array<float>); of an .npz file, the array named ``key`` or its only one."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column("content").to_pylist():
                x = np.load(io.BytesIO(content), allow_pickle=False)
                if not isinstance(x, np.ndarray):
                    if key is None and len(x.files) != 1:
                        raise ValueError(f"several arrays, {x.files}: name one")
                    x = x[key or x.files[0]]
                out.append(np.asarray(x, np.float32).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.list_(pa.float32()))], ["path", "embedding"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(load, "path string, embedding array<float>")


def any_table(spark: SparkSession, path: str) -> DataFrame:
    """A reader by the ending of the name: csv, tsv (also gz), json, jsonl, parquet."""
    name = path.lower().removesuffix(".gz")
    if name.endswith((".csv", ".tsv")):
        return csv(spark, path, sep="\t" if name.endswith(".tsv") else ",")
    if name.endswith((".jsonl", ".ndjson")):
        return clean(spark.read.json(path))
    if name.endswith(".json"):
        return clean(spark.read.option("multiLine", True).json(path))
    if name.endswith(".parquet"):
        return parquet(spark, path)
    raise ValueError(f"no reader for {path}")


def find_path(base: str, *candidates: str, given: str | None = None, exists=os.path.exists) -> str:
    """A given path; else the first candidate under the base folder, then under its parent. Folders are not walked."""
    if given:
        return given
    for folder in (base, os.path.dirname(base.rstrip("/"))):
        for c in candidates:
            if exists(p := os.path.join(folder, c)):
                return p
    raise FileNotFoundError(f"none of {candidates} in {base} or above it")


def save(df: DataFrame, path: str, spec: str, labels: list[str] | None = None, options: dict | None = None) -> None:
    """A table and what made it: Parquet under ``data``, and a one-line JSON description under ``spec``."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    about = json.dumps({"version": 1, "spec": spec, "labels": labels or [], "options": options or {}}, sort_keys=True)
    df.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")


def load(spark: SparkSession, path: str, spec: str) -> tuple[DataFrame, dict]:
    """A saved table and its description; one of another spec or version raises."""
    about = json.loads(spark.read.text(f"{path}/spec").first().value)
    if about["version"] != 1 or about["spec"] != spec:
        raise ValueError(f"{path} was saved by {about['spec']!r}, version {about['version']}, not by {spec!r}")
    return spark.read.parquet(f"{path}/data"), about


def save_results(results: DataFrame, summary: DataFrame, path: str) -> None:
    """Small report tables as single CSV files."""
    results.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/results")
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/results_summary")


def golden(df: DataFrame) -> DataFrame:
    """A row for each column: name, rows, nulls, and a hash that does not depend on the order of rows."""
    h = lambda c: F.sum(F.xxhash64(F.col(f"`{c}`").cast("string")).cast("decimal(38,0)"))
    wide = df.agg(F.count("*").alias("n"), *(x for i, c in enumerate(df.columns) for x in (F.count_if(F.col(f"`{c}`").isNull()).alias(f"z{i}"), h(c).alias(f"h{i}"))))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col("n").alias("n_rows"), F.col(f"z{i}").alias("n_null"), F.col(f"h{i}").cast("string").alias("hash")) for i, c in enumerate(df.columns)))))
