"""Archives in parts, files and shards that are whole or not there, and stored tables that only compute what is new."""

import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from wardloom.sources import archives as A
from wardloom.sources import readers, stores

CONTENTS = [("a.json", b"{}"), ("b/ü.txt", b""), ("a.json", b"again"), ("big.bin", bytes(range(256)) * 400), *((f"n/{i}.json", b"x" * (i * 37 % 900)) for i in range(120))]


def make(path, kind):
    os.makedirs(path)
    if kind == "zip":
        with zipfile.ZipFile(f"{path}/one.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in CONTENTS:
                z.writestr(zipfile.ZipInfo(name), data)
    else:
        with tarfile.open(f"{path}/one.tar", "w") as t:
            t.addfile(info := tarfile.TarInfo("folder"), None)
            info.type = tarfile.DIRTYPE
            t.members.clear()
            for name, data in [*CONTENTS, ("l" * 150 + ".json", b"long name")]:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    with open(f"{path}/broken.{kind}", "wb") as f:
        f.write(b"no archive" * 100)
    with open(f"{path}/_hidden.{kind}", "wb") as f:
        f.write(b"")
    return path


@pytest.mark.parametrize("kind", ["zip", "tar"])
def test_members_in_parts(spark, tmp_path, kind):
    path = make(str(tmp_path / kind), kind)
    want = sorted([*CONTENTS, *([("folder", b""), ("l" * 150 + ".json", b"long name")] if kind == "tar" else [])])
    for part_bytes in (1 << 26, 5000):
        got = A.members(spark, path, part_bytes=part_bytes)
        assert (got.rdd.getNumPartitions() > 10) == (part_bytes == 5000)
        rows = got.collect()
        assert sorted((r.member, bytes(r.content)) for r in rows if r.member) == want
        assert all(r.size == len(r.content) for r in rows if r.member)
        assert [r.archive.endswith(f"broken.{kind}") for r in rows if r.error] == [True]
        one = got.where("member IN ('a.json', 'big.bin') AND member <> 'a.json'").collect()
        assert [r.member for r in one] == ["big.bin"]
        assert got.where(f"archive = '{path}/one.{kind}' AND member LIKE 'n/1%.json'").count() == 31
    assert A.members(spark, path, ".json", content=False).where("member IS NOT NULL AND content IS NULL").count() == sum(n.endswith(".json") for n, _ in want)
    empty = str(tmp_path / f"none-{kind}")
    os.makedirs(empty)
    assert A.members(spark, empty).count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        A.members(spark, str(tmp_path / "nowhere")).collect()


@pytest.mark.parametrize("kind", ["zip", "tar"])
def test_wanted(spark, tmp_path, kind):
    path = make(str(tmp_path / kind), kind)
    keys = spark.createDataFrame([("a.json", 1), ("n/7.json", 2), ("n/7.json", 3), ("missing", 4), (None, 5)], "member string, row int")
    got = {r.row: (r.member, r.content and bytes(r.content)) for r in A.wanted(spark, path, keys, 3000).collect()}
    assert got == {1: ("a.json", b"{}"), 2: ("n/7.json", b"x" * 259), 3: ("n/7.json", b"x" * 259), 4: ("missing", None), 5: (None, None)}
    assert A.wanted(spark, path, keys.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["zip", "tar"])
def test_shards_are_whole_or_not_there(spark, tmp_path, kind):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("s1", "b", b"2"), ("s1", "a", b"1"), ("s2", "a", None), ("s3", "x", b"3")], "shard string, member string, content binary")
    broken = rows.withColumn("content", F.when(F.col("shard") == "s3", F.raise_error(F.lit("no content")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no content"):
        A.write(broken, path, kind)
    assert [f for f in (os.listdir(path) if os.path.isdir(path) else [])] == []
    A.write(rows.where("shard <> 's2'"), path, kind)
    A.write(rows.withColumn("content", F.lit(b"other")), path, kind)
    got = sorted((os.path.basename(r.archive), r.member, bytes(r.content)) for r in A.members(spark, path).collect())
    assert got == [(f"s1.{kind}", "a", b"1"), (f"s1.{kind}", "b", b"2"), (f"s2.{kind}", "a", b"other"), (f"s3.{kind}", "x", b"3")]
    assert sorted(len(open(f"{path}/_members/{f}").readlines()) for f in os.listdir(f"{path}/_members")) == [1, 2]
    A.write(rows.where("false"), path, kind)
    assert len(os.listdir(f"{path}/_members")) == 2 and not [f for f in os.listdir(path) if f.startswith(".")]


def test_files(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = spark.createDataFrame([("a/1", b"one"), ("a/1", b"none"), ("b", None), (None, b"lost")], "name string, content binary")
    assert sorted((r.name, r.status, r.size) for r in stores.write_files(rows, path).collect()) == [("a/1", "written", 4), ("b", "written", 0)]
    assert sorted((r.name, r.status) for r in stores.write_files(rows.withColumn("content", F.lit(b"new")), path).collect()) == [("a/1", "there"), ("b", "there")]
    assert open(f"{path}/a/1", "rb").read() == b"none"
    stores.write_files(rows.withColumn("content", F.lit(b"new")), path, again=True)
    assert open(f"{path}/a/1", "rb").read() == b"new" and sorted(os.listdir(f"{path}/a")) == ["1"]
    with pytest.raises(Exception, match="leads out"):
        stores.write_files(spark.createDataFrame([("../x", b"")], "name string, content binary"), path)
    assert stores.write_files(rows.where("false"), path).count() == 0


def test_filled_embeddings(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def encode(rows):
        def run(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b

        return rows.mapInArrow(run, rows.schema).withColumn("embedding", F.array(F.char_length("text").cast("float")))

    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "bb"), (4, None), (5, "")], "id int, text string")
    run = lambda r, name="e1", dtype="float32": stores.filled(r, str(tmp_path / "store"), encode, name, dtype, F.col("text"))
    got, n = run(rows)
    assert n == 4 and calls.value == 4
    assert sorted((r.id, r.embedding[0], r.generation) for r in got.collect()) == [(1, 1.0, 1), (2, 2.0, 1), (3, 2.0, 1), (4, None, 1), (5, 0.0, 1)]
    assert run(rows)[1] == 0 and calls.value == 4
    got, n = run(rows.withColumn("text", F.when(F.col("id") == 1, "ccc").otherwise(F.col("text"))))
    assert n == 1 and calls.value == 5 and {r.id: r.generation for r in got.collect()} == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1}
    assert run(rows, "e2")[1] == 4 and run(rows, "e1", "float16")[1] == 4
    assert run(rows)[0].count() == 5 and run(rows)[1] == 0
    empty, n = stores.filled(rows.where("false"), str(tmp_path / "none"), encode, "e", "f", F.col("text"))
    assert n == 0 and empty.count() == 0


def test_a_failed_run_leaves_the_store(spark, tmp_path):
    rows, folder = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string"), str(tmp_path / "store")
    plain = lambda r: r.withColumn("embedding", F.array(F.lit(1.0)))
    stores.filled(rows.where("id = 1"), folder, plain, "e", "f", F.col("text"))
    with pytest.raises(Exception, match="no encoder"):
        stores.filled(rows, folder, lambda r: r.withColumn("embedding", F.array(F.raise_error(F.lit("no encoder")).cast("double"))), "e", "f", F.col("text"))
    assert [os.path.basename(p) for p in stores.published(spark, folder)] == ["g000000001"]
    assert stores.filled(rows, folder, plain, "e", "f", F.col("text"))[1] == 1


def test_cache_by_plan(spark, tmp_path):
    data, folder = str(tmp_path / "in"), str(tmp_path / "cache")
    spark.range(10).selectExpr("id", "id % 3 AS k").write.parquet(data)
    steps = lambda least=2, alias="x": spark.read.parquet(data).where(F.col("id") >= least).groupBy("k").agg(F.sum("id").alias(alias)).withColumnRenamed(alias, "s")
    first, hit = stores.cached(steps(), folder)
    assert not hit and sorted(map(tuple, first.collect())) == [(0, 18), (1, 11), (2, 15)]
    assert stores.cached(steps(alias="y"), folder)[1] and not stores.cached(steps(3), folder)[1] and not stores.cached(steps(), folder, {"seed": 1})[1]
    assert not stores.cached(steps().withColumnRenamed("s", "t"), folder)[1]
    spark.range(1).selectExpr("id + 100 AS id", "0L AS k").write.mode("append").parquet(data)
    again, hit = stores.cached(steps(), folder)
    assert not hit and sorted(map(tuple, again.collect()))[0] == (0, 118)
    assert not [f for f in os.listdir(folder) if f.startswith(".")]
    # What came second is dropped.
    assert stores.publish(spark.range(3), folder, "t") == 3 and stores.publish(spark.range(5), folder, "t") is None
    assert spark.read.parquet(f"{folder}/t").count() == 3


def test_manifest(spark, tmp_path):
    path, kept = str(tmp_path / "files"), str(tmp_path / "manifest")
    read = spark.sparkContext.accumulator(0)

    def parse(files):
        def run(batches):
            for b in batches:
                read.add(b.num_rows)
                yield b

        return stores.heads(files.mapInArrow(run, files.schema), 3)

    def write(names, again=False):
        stores.write_files(spark.createDataFrame([(n, c) for n, c in names.items()], "name string, content binary"), path, again)

    def refresh():
        manifest, found = stores.refreshed(readers.listing(spark, path, "*.x").select("path", "length", "modified"), kept, parse)
        return {os.path.basename(r.path): bytes(r.head) for r in manifest.collect()}, {os.path.basename(r.path): r.status for r in found.collect()}

    write({"a.x": b"aaaa", "b.x": b"b", "c.x": b"c", "empty.x": b""})
    # An empty file is in no listing.
    assert refresh() == ({"a.x": b"aaa", "b.x": b"b", "c.x": b"c"}, {"a.x": "added", "b.x": "added", "c.x": "added"}) and read.value == 3
    write({"b.x": b"bb"}, again=True)
    write({"d.x": b"d"})
    os.remove(f"{path}/c.x")
    assert refresh() == ({"a.x": b"aaa", "b.x": b"bb", "d.x": b"d"}, {"a.x": "same", "b.x": "changed", "c.x": "removed", "d.x": "added"}) and read.value == 5
    assert set(refresh()[1].values()) == {"same"} and read.value == 5 and len(stores.published(spark, kept)) == 2
    gone, found = stores.heads(spark.createDataFrame([(f"{path}/nowhere",)], "path string")).collect(), None
    assert gone[0].head is None and gone[0].error == "FileNotFoundError"


@pytest.mark.parametrize("kind", ["zip", "tar"])
def test_a_section_reads_its_own_part_of_the_index(tmp_path, kind, monkeypatch):
    """However many parts there are, each member's entry is read a bounded number of times in all."""
    path = f"{make(str(tmp_path / kind), kind)}/one.{kind}"
    parts, seen = A.sections(path, 5000), []
    assert len(parts) > 10
    if kind == "zip":
        made = zipfile.ZipFile._RealGetContents
        monkeypatch.setattr(zipfile.ZipFile, "_RealGetContents", lambda z: (made(z), seen.extend(z.filelist))[0])
    else:
        read = tarfile.TarFile.next
        monkeypatch.setattr(tarfile.TarFile, "next", lambda t: (seen.append(m := read(t)), m)[1])
    rows = [r for first, after, section in parts for r in A.walk(path, first, after, A.Wanted(), True, section)]
    names = [n for n, _ in CONTENTS] + (["folder", "l" * 150 + ".json"] if kind == "tar" else [])
    assert sorted(r[1] for r in rows) == sorted(names) and not any(r[5] for r in rows)
    assert len(seen) <= len(names) + 3 * len(parts)
