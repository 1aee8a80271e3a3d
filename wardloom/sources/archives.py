"""Zip and tar archives as a data source: members as rows, read and written in parts.

    spark.dataSource.register(archives.Archives)   # archives.register(spark)
    spark.read.format("members").option("path", "/data/shards").option("suffix", ".json").load().where("member = 'a/b.json'")

``members`` deals an archive by sections, so one of any size is read by many tasks, and no task holds more than one member.
The sections are found by a job, in which one task reads each large archive's index once: a zip's central directory, a tar's
headers (it seeks over what lies between); a section's task then reads its own part of the index. Read without sections, an
archive is one task. Filters on ``archive`` drop whole ranges, filters on ``member`` drop members before they are read.

Files are opened by pyarrow's file systems (local, HDFS, S3, GCS and others by their URI), on every machine.
"""

from __future__ import annotations

import fnmatch
import io
import json
import struct
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage

SCHEMA = "archive string, member string, place long, size long, content binary, error string"
MANIFEST = "_members"
#: Members are given on in batches of about so many bytes.
BATCH_BYTES = 8 << 20


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _kind(name: str) -> str | None:
    return "zip" if name.endswith(".zip") else "tar" if name.endswith(".tar") else None


def files(path: str) -> list[tuple[str, int]]:
    """The archives of a file, or of a folder and all below it, with their sizes, by name; hidden and unfinished ones are no part."""
    fs, inner = _opened(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(inner.rstrip("/")) :].split("/") if x)
    return sorted((prefix + x.path, x.size) for x in found if x.type == pafs.FileType.File and _kind(x.path) and not hidden(x.path))


@dataclass
class Part(InputPartition):
    """The members of an archive whose place lies in [start, end); ``section``: what reads them without the whole index."""

    archive: str
    start: int
    end: int
    section: list | dict | None = None

    def __init__(self, archive: str, start: int, end: int, section: list | dict | None = None):
        self.archive, self.start, self.end, self.section = archive, start, end, section


@dataclass
class Wanted:
    """What a name must be: of a pattern, with these ends, and among these names if there are any."""

    pattern: str = "*"
    starts: list[str] = field(default_factory=list)
    ends: list[str] = field(default_factory=list)
    names: set[str] | None = None

    def only(self, names: set[str]) -> None:
        self.names = names if self.names is None else self.names & names

    def holds(self, name: str, place: int = 0) -> bool:
        return (self.names is None or name in self.names) and all(map(name.startswith, self.starts)) and all(map(name.endswith, self.ends)) and fnmatch.fnmatchcase(name, self.pattern)


class _Zip(io.RawIOBase):
    """A zip archive with a section of its directory: its bytes, and behind them that section with an end record."""

    def __init__(self, raw, first: int, after: int, n: int, shift: int):
        self.raw, self.edge, self.at = raw, raw.size(), 0
        raw.seek(first)
        part = raw.read(after - first)
        end = struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(part), self.edge - shift) + struct.pack("<4sLQL", b"PK\6\7", 0, self.edge + len(part), 1)
        self.tail = part + end + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.edge + len(self.tail))[whence]
        return self.at

    def read(self, size: int = -1) -> bytes:
        last = self.edge + len(self.tail) if size is None or size < 0 else self.at + size
        out = b""
        if self.at < self.edge:
            self.raw.seek(self.at)
            out = self.raw.read(min(last, self.edge) - self.at)
        if last > self.edge:
            out += self.tail[max(self.at - self.edge, 0) : last - self.edge]
        self.at += len(out)
        return out


def sections(archive: str, part_bytes: int) -> list[tuple[int, int, list | dict]]:
    """Parts of an archive, read once from end to end: first place, end, and what a part needs to be read by itself: of a tar
    the headers that hold for all that follows, of a zip a range of its directory. One that cannot be read is one part."""
    fs, inner = _opened(archive)
    found: list[tuple[int, int, list | dict]] = []
    with fs.open_input_file(inner) as raw:
        if _kind(inner) == "zip":
            try:
                z = zipfile.ZipFile(raw)
            except (zipfile.BadZipFile, EOFError):
                return [(0, 1 << 62, None)]
            at = first = z.start_dir
            raw.seek(at)
            head = raw.read(46)
            given = int.from_bytes(head[42:46], "little") if len(head) == 46 else 0
            shift = z.infolist()[0].header_offset - given if z.infolist() and given != 0xFFFFFFFF else 0
            n, size, places = 0, 0, []
            for m in z.infolist():
                at += 46 + len(m.orig_filename.encode("utf-8" if m.flag_bits & 0x800 else "cp437")) + len(m.extra) + len(m.comment)
                n, size = n + 1, size + m.compress_size + 30 + len(m.filename)
                places.append(m.header_offset)
                if size >= part_bytes:
                    found.append((min(places), max(places) + 1, [first, at, n, shift]))
                    first, n, size, places = at, 0, 0, []
            return found + ([(min(places), max(places) + 1, [first, at, n, shift])] if n else []) or [(0, 1 << 62, None)]
        edges: list[tuple[int, dict]] = [(0, {})]
        try:
            with tarfile.open(fileobj=raw, mode="r:") as t:
                for m in t:
                    t.members = []
                    if m.offset - edges[-1][0] >= part_bytes:
                        edges.append((m.offset, dict(t.pax_headers)))
        except (tarfile.TarError, EOFError):
            pass  # the part that meets it says so
    return [(a, b, h) for (a, h), (b, _) in zip(edges, [*edges[1:], (1 << 62, {})], strict=True)]


def _indexed(spark: SparkSession, path: str, part_bytes: int) -> dict[str, list]:
    """The sections of all archives that are larger than a part, each found by one task."""
    try:
        large = [a for a, size in files(path) if size > part_bytes]
    except FileNotFoundError:
        large = []  # the reader says so
    if not large:
        return {}
    return dict(spark.sparkContext.parallelize(large, min(len(large), 1000)).map(lambda a: (a, sections(a, part_bytes))).collect())


def walk(archive: str, start: int, end: int, wanted: Wanted, content: bool, section: list | dict | None = None) -> Iterator[tuple]:
    """Rows of ``SCHEMA``. An archive or member that cannot be read gives a row with its error, and what can be read is."""
    fs, inner = _opened(archive)
    try:
        with fs.open_input_file(inner) as raw:
            if _kind(inner) == "zip":
                with zipfile.ZipFile(_Zip(raw, *section) if section else raw) as z:
                    # The directory can name places in any order.
                    for m in sorted((m for m in z.infolist() if start <= m.header_offset < end and not m.is_dir() and wanted.holds(m.filename, m.header_offset)), key=lambda m: m.header_offset):
                        try:
                            yield archive, m.filename, m.header_offset, m.file_size, z.read(m) if content else None, None
                        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError) as e:
                            yield archive, m.filename, m.header_offset, m.file_size, None, f"{type(e).__name__}: {e}"
            else:
                raw.seek(start)
                with tarfile.open(fileobj=raw, mode="r:", pax_headers=section or None) as t:
                    for m in t:
                        t.members = []  # else the index of the whole archive is kept
                        if m.offset >= end:
                            break
                        if m.isfile() and wanted.holds(m.name):
                            data = t.extractfile(m).read() if content else None
                            broken = data is not None and len(data) < m.size
                            yield archive, m.name, m.offset, m.size, None if broken else data, "ReadError: unexpected end of data" if broken else None
    except (zipfile.BadZipFile, tarfile.TarError, EOFError) as e:
        yield archive, None, None, None, None, f"{type(e).__name__}: {e}"


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [("archive", pa.string()), ("member", pa.string()), ("place", pa.int64()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())]
    held, size = [], 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*held, strict=True), kinds, strict=True)], [n for n, _ in kinds])
    for row in rows:
        held.append(row)
        size += 200 + len(row[4] or b"")
        if size >= BATCH_BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.content = options["path"], options.get("content", "true").lower() != "false"
        self.sections = json.loads(options.get("sections", "{}"))
        self.wanted, self.archives = Wanted(options.get("pattern", "*"), ends=[options["suffix"]] if "suffix" in options else []), Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            # A row of an archive that cannot be read has no member, so no filter on it holds there.
            own = {("archive",): self.archives, ("member",): self.wanted}.get(getattr(f, "attribute", None))
            if own is not None and isinstance(f, EqualTo):
                own.only({f.value})
            elif own is not None and isinstance(f, In):
                own.only(set(f.value))
            elif own is not None and isinstance(f, StringStartsWith):
                own.starts.append(f.value)
            elif own is not None and isinstance(f, StringEndsWith):
                own.ends.append(f.value)
            else:
                yield f
                continue
            if own is self.wanted:
                yield f  # checked again, for the rows of errors

    def partitions(self) -> list[Part]:
        return [Part(archive, *x) for archive, _ in files(self.path) if self.archives.holds(archive) for x in self.sections.get(archive, [(0, 1 << 62)])]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Part):  # Spark reads a None where there are no partitions
            yield from _batches(walk(partition.archive, partition.start, partition.end, self.wanted, self.content, partition.section))


@dataclass
class Written(WriterCommitMessage):
    """What a task has finished: (unfinished name, name, members, bytes) of each shard."""

    shards: list[tuple[str, str, int, int]]


class Writer(DataSourceArrowWriter):
    """Rows of shard, member and content as tar or zip shards, one file each.

    A task writes a shard under a hidden name; the commit, after all tasks, gives the shards their names and then writes a
    manifest of its own; an abort removes them. So a shard that has its name is whole. Shards that are there already are
    skipped. All rows of a shard must be in one task, together: ``write`` sees to that.
    """

    def __init__(self, options: dict):
        self.path, self.kind, self.run = options["path"].rstrip("/"), options.get("kind", "tar"), uuid.uuid4().hex
        if self.kind not in ("tar", "zip"):
            raise ValueError(f"kind must be tar or zip, not {self.kind!r}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _opened(self.path)
        fs.create_dir(base, recursive=True)
        done, out, name, attempt = [], None, None, uuid.uuid4().hex
        for batch in iterator:
            for shard, member, content in zip(*(batch.column(c).to_pylist() for c in ("shard", "member", "content")), strict=True):
                if shard != name:
                    if out is not None:
                        done.append(out.close())
                    target = f"{base}/{shard}.{self.kind}"
                    there = fs.get_file_info(target).type == pafs.FileType.File
                    name, out = shard, None if there else _Shard(fs, f"{base}/.{self.run}-{attempt}-{shard}.{self.kind}", target, self.kind)
                if out is not None:
                    out.add(member, content or b"")
        if out is not None:
            done.append(out.close())
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = _opened(self.path)
        shards = [s for m in messages if m is not None for s in m.shards]
        for hidden, target, _, _ in shards:
            fs.move(hidden, target)
        if shards:
            lines = "".join(f"{t.rsplit('/', 1)[-1]}\t{n}\t{size}\n" for _, t, n, size in sorted(shards, key=lambda s: s[1]))
            fs.create_dir(f"{base}/{MANIFEST}", recursive=True)
            with fs.open_output_stream(f"{base}/{MANIFEST}/.{self.run}") as f:
                f.write(lines.encode())
            fs.move(f"{base}/{MANIFEST}/.{self.run}", f"{base}/{MANIFEST}/{self.run}.tsv")
        self._tidy(fs, base)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = _opened(self.path)
        self._tidy(fs, base)

    def _tidy(self, fs: pafs.FileSystem, base: str) -> None:
        """Removes what this run has left under hidden names, failed attempts too."""
        for x in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if x.base_name.startswith(f".{self.run}-"):
                fs.delete_file(x.path)


class _Shard:
    def __init__(self, fs: pafs.FileSystem, hidden: str, target: str, kind: str):
        self.hidden, self.target, self.members = hidden, target, 0
        self.raw = fs.open_output_stream(hidden)
        self.out = tarfile.open(fileobj=self.raw, mode="w|") if kind == "tar" else zipfile.ZipFile(self.raw, "w", zipfile.ZIP_DEFLATED)

    def add(self, member: str, content: bytes) -> None:
        self.members += 1
        if isinstance(self.out, tarfile.TarFile):
            info = tarfile.TarInfo(member)
            info.size = len(content)
            self.out.addfile(info, io.BytesIO(content))
        else:
            self.out.writestr(zipfile.ZipInfo(member), content, zipfile.ZIP_DEFLATED)

    def close(self) -> tuple[str, str, int, int]:
        self.out.close()
        size = self.raw.tell()
        self.raw.close()
        return self.hidden, self.target, self.members, size


class Archives(DataSource):
    """Options: path; for reading suffix, pattern, content (false: the index alone) and sections (those of ``members``); for writing kind."""

    @classmethod
    def name(cls) -> str:
        return "members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Archives)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def members(spark: SparkSession, path: str, suffix: str = "", content: bool = True, part_bytes: int = 64 << 20) -> DataFrame:
    """archive, member, place (its first byte), size, content and error of every member. An archive that cannot be read is
    one row with its error, without a member; so is a member, with its name. Repeated names are rows of their own."""
    return _members(spark, path, suffix, content, _indexed(spark, path, part_bytes))


def _members(spark: SparkSession, path: str, suffix: str, content: bool, found: dict[str, list]) -> DataFrame:
    register(spark)
    return spark.read.format("members").options(path=path, suffix=suffix, content=str(content), sections=json.dumps(found)).load()


def fetch(index: DataFrame, part_bytes: int = 64 << 20, found: dict[str, list] | None = None) -> DataFrame:
    """The members named by rows of archive and place (``members`` without content, filtered or joined), with their content.

    Sorted by range of archive and place, so tasks read on in one archive, each about ``part_bytes``. ``found``: sections of
    the archives by name; without those of a zip its whole directory is read for every batch.
    """
    total = F.sum("size").alias("bytes")
    parts = max(1, -(-int(index.agg(total).first().bytes or 0) // part_bytes))

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                spans: dict[str, set[int]] = {}
                for archive, place in zip(batch.column("archive").to_pylist(), batch.column("place").to_pylist(), strict=True):
                    spans.setdefault(archive, set()).add(place)
                for archive, places in spans.items():
                    yield from walk_places(archive, places, (found or {}).get(archive))

        yield from _batches(rows())

    return index.where("place IS NOT NULL").select("archive", "place").repartitionByRange(parts, "archive", "place").sortWithinPartitions("archive", "place").mapInArrow(fetched, SCHEMA)


def walk_places(archive: str, places: set[int], parts: list | None = None) -> Iterator[tuple]:
    """The members that begin at these places, a row each. A tar's headers are read where they lie, without a walk."""
    fs, inner = _opened(archive)
    if _kind(inner) == "tar":
        with fs.open_input_file(inner) as raw:
            for place in sorted(places):
                raw.seek(place)
                with tarfile.open(fileobj=raw, mode="r:") as t:
                    m = t.next()
                    yield archive, m.name, place, m.size, t.extractfile(m).read(), None
    else:
        for first, after, section in parts or [(0, 1 << 62, None)]:
            if first <= max(places) and after > min(places) and (own := {p for p in places if first <= p < after}):
                yield from walk(archive, min(own), max(own) + 1, _Places(own), True, section)


class _Places(Wanted):
    def __init__(self, places: set[int]):
        super().__init__()
        self.places = places

    def holds(self, name: str, place: int = 0) -> bool:
        return place in self.places


def wanted(spark: SparkSession, path: str, keys: DataFrame, part_bytes: int = 64 << 20) -> DataFrame:
    """The columns of ``keys`` (one is ``member``), and archive, size, content and error of the member of that name: of
    several the first by archive and place. One that no archive has stays, with nulls; so does a null.

    The index is read without contents and joined; only what is wanted is read.
    """
    sections_of = _indexed(spark, path, part_bytes)
    index = _members(spark, path, "", False, sections_of).where("member IS NOT NULL").select("member", "archive", "place", "size")
    names = keys.select("member").where("member IS NOT NULL").distinct()
    first = index.join(names, "member", "left_semi").groupBy("member").agg(F.min(F.struct("archive", "place", "size")).alias("at"))
    found = fetch(first.select("at.*"), part_bytes, sections_of).select("member", "archive", "size", "content", "error")
    return keys.join(found, "member", "left")


def write(rows: DataFrame, path: str, kind: str = "tar") -> None:
    """Writes shard, member and content as archives named by shard; those that are there already are left as they are.

    Rows of a shard come together by a shuffle, in order of member; a shard is one file and one task writes it.
    """
    register(rows.sparkSession)
    rows.select(F.col("shard").cast("string").alias("shard"), "member", F.col("content").cast("binary").alias("content")).repartition("shard").sortWithinPartitions("shard", "member").write.format("members").options(path=path, kind=kind).mode("append").save()
