"""Tables that are kept between runs and published whole: results by plan, embeddings that are filled up, manifests of files."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .archives import _opened

Step = Callable[[DataFrame], DataFrame]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def published(spark: SparkSession, folder: str) -> list[str]:
    """The tables of a folder that were finished, by name."""
    fs, p = _path(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith((".", "_")))


def publish(frame: DataFrame, folder: str, name: str, least: int = 0) -> int | None:
    """Writes a table under a hidden name and then gives it its own, so that nobody sees a part of it. Returns its rows; None, and
    leaves nothing, if it has fewer than ``least`` or a table of that name came first. Rows are counted while they are written."""
    spark, hidden, seen = frame.sparkSession, f"{folder}/.{name}-{uuid.uuid4().hex}", Observation()
    frame.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(hidden)
    fs, source = _path(spark, hidden)
    _, target = _path(spark, f"{folder}/{name}")
    n = seen.get["n"]
    # A rename onto a folder that is there puts the table inside it, under its hidden name.
    done = n >= least and not fs.exists(target) and fs.rename(source, target) and not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(target, source.getName()))
    if not done:
        fs.delete(source, True)
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(target, source.getName()), True)
    return n if done else None


def plan_key(df: DataFrame, options: dict | None = None) -> str:
    """A key of what a DataFrame computes: its canonical plan, the lengths and times of the files it reads, and options.

    Plans that differ in names of intermediate columns alone have one key. A Python function counts by its name, and what
    a session is set to not at all: put versions and settings in ``options``.
    """
    spark, plan = df.sparkSession, df._jdf.queryExecution().optimizedPlan().canonicalized()
    state = []
    for file in sorted(df.inputFiles()):
        fs, p = _path(spark, file)
        s = fs.getFileStatus(p)
        state.append([file, s.getLen(), s.getModificationTime()])
    names = [[f.name, f.dataType.simpleString()] for f in df.schema]
    return hashlib.sha256(json.dumps([plan.toString(), df.semanticHash(), names, state, options or {}], sort_keys=True).encode()).hexdigest()


def cached(df: DataFrame, folder: str, options: dict | None = None) -> tuple[DataFrame, bool]:
    """The rows of ``df``, read from ``folder`` where an equal plan over the same files left them, else computed and left
    there; and whether they were there. For deterministic plans. Of two that compute at once the first is kept."""
    spark, key = df.sparkSession, plan_key(df, options)
    fs, p = _path(spark, f"{folder}/{key}")
    hit = fs.exists(p)
    if not hit:
        publish(df, folder, key)
    return spark.read.parquet(f"{folder}/{key}"), hit


def fingerprint(encoder: str, dtype: str, *content: Column) -> Column:
    """One for each content, encoder and type of result; null is a content of its own, other than ''."""
    parts = [F.coalesce(F.sha2(c.cast("binary"), 256), F.lit("null")) for c in content]
    return F.sha2(F.concat_ws("|", F.lit(encoder), F.lit(dtype), *parts).cast("binary"), 256)


def filled(rows: DataFrame, folder: str, encode: Step, encoder: str, dtype: str, *content: Column) -> tuple[DataFrame, int]:
    """``rows`` with their embedding and the generation that computed it, and how many were computed now.

    ``encode`` gives rows an ``embedding``; ``encoder`` names it with its version and settings, ``content`` what it reads of
    a row (as text or binary). Only rows whose fingerprint is not in the store are encoded, each content once; they are added
    as one generation, published whole, so a run that fails leaves the store as it was. Rows of other encoders or types,
    and those of contents that are gone, stay stored and are not read by others' fingerprints.
    """
    spark = rows.sparkSession
    marked = rows.withColumn("fingerprint", fingerprint(encoder, dtype, *content))
    generations = published(spark, folder)
    todo = marked.dropDuplicates(["fingerprint"])
    if generations:
        todo = todo.join(spark.read.parquet(*generations).select("fingerprint"), "fingerprint", "left_anti")
    number = len(generations) + 1
    fresh = encode(todo).select("fingerprint", "embedding", F.lit(number).alias("generation"))
    n = publish(fresh, folder, f"g{number:09d}", least=1) or 0
    generations = published(spark, folder)
    if not generations:
        return encode(marked.where("false")).withColumn("generation", F.lit(0)), 0
    # Of a fingerprint that two runs computed at once the first counts.
    known = spark.read.parquet(*generations)
    if number > 1 or n == 0:
        known = known.groupBy("fingerprint").agg(F.min_by("embedding", "generation").alias("embedding"), F.min("generation").alias("generation"))
    return marked.join(known, "fingerprint"), n


def changes(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """path and status of every file of either: added, changed (another length or time), removed or same."""
    now = listing.select("path", F.struct("length", "modified").alias("now")).groupBy("path").agg(F.max("now").alias("now"))
    before = stored.select("path", F.struct("length", "modified").alias("before"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("before"), "changed").otherwise("same")
    return now.join(before, "path", "full").select("path", status.alias("status"), F.coalesce("now", "before").alias("state"))


def refreshed(listing: DataFrame, folder: str, parse: Step) -> tuple[DataFrame, DataFrame]:
    """The manifest of a listing (path, length, modified), kept up to date in ``folder``: path, length, modified and what
    ``parse`` adds; and the ``changes`` since the one before.

    ``parse`` takes rows with a path and adds columns; it gets the added and changed files only. A new manifest is published
    whole beside the older ones; when nothing was added, changed or removed, there is none.
    """
    spark = listing.sparkSession
    older = published(spark, folder)
    stored = spark.read.parquet(older[-1]) if older else None
    empty = listing.where("false")
    found = changes(listing, empty if stored is None else stored)
    # The comparison is written once; what is parsed, kept and counted comes from it.
    spot = f"{folder}/_changes-{uuid.uuid4().hex}"
    found.write.parquet(spot)
    found = spark.read.parquet(spot)
    fresh = parse(found.where("status IN ('added', 'changed')").select("path", "state.length", "state.modified"))
    if stored is not None:
        kept = stored.join(found.where("status = 'same'").select("path"), "path", "left_semi")
        fresh = kept.unionByName(fresh, allowMissingColumns=True)
        if found.where("status <> 'same'").isEmpty():
            return stored, found
    publish(fresh, folder, f"m{len(older) + 1:09d}")
    return spark.read.parquet(published(spark, folder)[-1]), found


def heads(files: DataFrame, most: int = 4096) -> DataFrame:
    """Adds ``head``, the first bytes of each file of ``path``, and ``error`` where it cannot be read. No more is read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for path in batch.column("path").to_pylist():
                try:
                    fs, inner = _opened(path)
                    with fs.open_input_file(inner) as f:
                        out.append(f.read(most))
                    errors.append(None)
                except OSError as e:
                    out.append(None)
                    errors.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()), pa.array(errors, pa.string())], [*batch.schema.names, "head", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(read, f"{kinds}, head binary, error string")


def write_files(rows: DataFrame, path: str, again: bool = False) -> DataFrame:
    """Writes each row's ``content`` as the file ``name`` under ``path``; name, status (written, there) and size of each.

    A file is written under a hidden name and then renamed, so one that has its name is whole, and a task that fails leaves
    none; files that are there already are left, unless ``again``. A name that leads out of the folder stops the run. Of
    rows of one name the least content is written. A null content is an empty file.
    """
    one = rows.where("name IS NOT NULL").groupBy("name").agg(F.min(F.coalesce(F.col("content").cast("binary"), F.lit(b""))).alias("content"))
    spark, token = rows.sparkSession, uuid.uuid4().hex

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(path)
        for batch in batches:
            status = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"{name!r} leads out of the folder")
                target = f"{base}/{name}"
                if not again and fs.get_file_info(target).type == pafs.FileType.File:
                    status.append("there")
                    continue
                folder, _, last = target.rpartition("/")
                fs.create_dir(folder, recursive=True)
                hidden = f"{folder}/.{token}-{uuid.uuid4().hex}-{last}"
                try:
                    with fs.open_output_stream(hidden) as f:
                        f.write(content)
                    fs.move(hidden, target)
                finally:
                    if fs.get_file_info(hidden).type == pafs.FileType.File:
                        fs.delete_file(hidden)
                status.append("written")
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(status, pa.string()), pa.array([len(x) for x in batch.column("content").to_pylist()], pa.int64())], ["name", "status", "size"])

    folder = f"{path.rstrip('/')}/_written"
    # Written with what it says, so that the files are made once.
    publish(one.mapInArrow(written, "name string, status string, size long"), folder, token)
    return spark.read.parquet(f"{folder}/{token}")
