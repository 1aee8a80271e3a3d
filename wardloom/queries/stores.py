"""Archives, files and stored tables: written from the test tables, read again, and kept up to date."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import archives, readers, scratch, stores
from .base import query, table


def _shards(spark, d, kind: str) -> str:
    """``documents`` as JSON members, and beside each its text as another, in shards by source."""
    path, docs = scratch.folder(spark), table(spark, d, "documents")
    shard = F.concat_ws("-", F.lit("shard"), F.coalesce("source", F.lit("none")))
    record, name = F.to_json(F.struct("doc_id", "lang", "text")), F.concat(F.lit("d/"), F.col("doc_id").cast("string"))
    members = F.array(F.struct(F.concat(name, F.lit(".json")).alias("member"), record.alias("content")), F.struct(F.concat(name, F.lit(".txt")).alias("member"), F.col("text").alias("content")))
    archives.write(docs.select(shard.alias("shard"), F.inline(members)).withColumn("content", F.coalesce(F.col("content"), F.lit("")).cast("binary")), path, kind)
    return path


_RECORD = "doc_id long, lang string, text string"


def _records(members):
    r = members.select("member", F.regexp_extract("archive", "[^/]*$", 0).alias("shard"), F.from_json(F.decode("content", "utf-8"), _RECORD).alias("r"))
    return r.select("member", "shard", F.col("r.doc_id").alias("doc_id"), F.col("r.lang").alias("lang"), F.md5(F.col("r.text").cast("binary")).alias("text"))


_KEYS = "(SELECT 'd/' || doc_id || '.json' AS member FROM labels UNION ALL SELECT 'd/' || item_id || '.json' FROM benchmark)"
_FOUND = "(SELECT 'd/' || doc_id || '.json' AS member, 'shard-' || coalesce(source, 'none') || '.{}' AS shard, doc_id, lang, md5(text) AS text FROM documents)"


def _keys(spark, d):
    """Members that a list asks for: those of the labels, and names that no archive has."""
    ids = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id")).unionAll(table(spark, d, "benchmark").select(F.col("item_id").cast("string")))
    return ids.select(F.concat(F.lit("d/"), "id", F.lit(".json")).alias("member"))


@query(f"SELECT k.member, shard, doc_id, lang, text FROM {_KEYS} k LEFT JOIN {_FOUND.format('zip')} f USING (member)")
def sc19_zip_members_wanted(spark, d):
    """The records of the members that are asked for, one archive read by several tasks; missing ones are null."""
    return _records(archives.wanted(spark, _shards(spark, d, "zip"), _keys(spark, d), part_bytes=1 << 20))


@query(f"SELECT coalesce(f.shard, 'missing') AS shard, count(*) AS n FROM {_KEYS} k LEFT JOIN {_FOUND.format('tar')} f USING (member) GROUP BY 1")
def sc20_members_missing(spark, d):
    """How many wanted members each archive has, and how many none has."""
    index = archives.members(spark, _shards(spark, d, "tar"), content=False).where("member IS NOT NULL").select("member", F.regexp_extract("archive", "[^/]*$", 0).alias("shard"))
    return _keys(spark, d).join(index, "member", "left").groupBy(F.coalesce("shard", F.lit("missing")).alias("shard")).agg(F.count("*").alias("n"))


@query(f"SELECT member, shard, doc_id, lang, text FROM {_FOUND.format('tar')}")
def sc21_tar_members(spark, d):
    """The JSON members of all shards; those of texts are passed over."""
    return _records(archives.members(spark, _shards(spark, d, "tar"), ".json", part_bytes=1 << 20))


@query("SELECT page_id::VARCHAR AS page_id, substr(md5(url), 1, 1) AS shard, md5(html) AS content FROM pages")
def sk09_subset_to_shards(spark, d):
    """Pages in shards; a second run with other contents leaves the shards that are there."""
    path, pages = scratch.folder(spark), table(spark, d, "pages")
    rows = pages.select(F.substring(F.md5(F.col("url").cast("binary")), 1, 1).alias("shard"), F.col("page_id").cast("string").alias("member"), F.col("html").alias("content"))
    archives.write(rows, path)
    archives.write(rows.withColumn("content", F.lit("changed")), path)
    m = archives.members(spark, path)
    return m.select(F.col("member").alias("page_id"), F.regexp_extract("archive", "([^/]*)[.]tar$", 1).alias("shard"), F.md5("content").alias("content"))


def _page_files(spark, d, path: str):
    return table(spark, d, "pages").select("page_id", F.concat(F.substring("page_id", -1, 1), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").alias("content"))


@query("SELECT page_id, strlen(html)::BIGINT AS size, CASE WHEN length(url) % 2 = 0 THEN 'there' ELSE 'written' END AS second FROM pages")
def sk11_bytes_to_files(spark, d):
    """A file for each page: half of them in a first run, and all in a second, which leaves those that are there."""
    path = scratch.folder(spark)
    rows = _page_files(spark, d, path).join(table(spark, d, "pages").select("page_id", (F.length("url") % 2 == 0).alias("early")), "page_id")
    stores.write_files(rows.where("early"), path)
    second = stores.write_files(rows, path).select("name", F.col("status").alias("second"))
    files = readers.listing(spark, path, "*.html").select("name", "length")
    return second.select(F.regexp_extract("name", "([0-9]+)[.]html$", 1).cast("long").alias("page_id"), F.regexp_extract("name", "[^/]*$", 0).alias("name"), "second").join(files, "name").select("page_id", F.col("length").alias("size"), "second")


@query("""SELECT page_id, CASE strlen(html) % 4 WHEN 0 THEN 'changed' WHEN 1 THEN 'removed' WHEN 2 THEN 'added' ELSE 'same' END AS status,
  CASE WHEN strlen(html) % 4 <> 1 THEN strlen(html) + CASE WHEN strlen(html) % 4 = 0 THEN 1 ELSE 0 END END::BIGINT AS length,
  CASE WHEN strlen(html) % 4 <> 1 THEN left(html, 9) END AS head FROM pages""")
def sc26_manifest_kept_up_to_date(spark, d):
    """Pages as files: after some were added, changed or taken off the list, only new and changed ones are read again."""
    path, kind = scratch.folder(spark), F.octet_length("content") % 4
    rows, kept = _page_files(spark, d, path), f"{path}-manifest"
    listing = lambda: readers.listing(spark, path, "*.html").select("path", "length", "modified")
    ids = F.regexp_extract("path", "([0-9]+)[.]html$", 1).cast("long").alias("page_id")
    parse = lambda files: stores.heads(files, 9).select("path", "length", "modified", F.decode("head", "utf-8").alias("head"))
    stores.write_files(rows.where(kind != 2), path)
    stores.refreshed(listing(), kept, parse)
    stores.write_files(rows.where(kind == 2), path)
    stores.write_files(rows.where(kind == 0).withColumn("content", F.concat("content", F.lit(" "))), path, again=True)
    gone = rows.where(kind == 1).select("page_id")
    manifest, changes = stores.refreshed(listing().withColumn("page_id", ids).join(gone, "page_id", "left_anti").drop("page_id"), kept, parse)
    return changes.select("path", "status").join(manifest, "path", "left").select(ids, "status", "length", "head")


@query("SELECT vec_id, CASE WHEN label = 3 THEN 2 ELSE 1 END AS generation, len(embedding)::INT AS dims, CASE WHEN label = 3 THEN -sign(embedding[1]) ELSE sign(embedding[1]) END::INT AS first, (SELECT count(*) FROM embeddings WHERE label = 3) AS n_second, 0 AS n_third FROM embeddings")
def ev02_stored_embeddings(spark, d):
    """Unit vectors, stored; of a second run the rows that have changed are computed, of a third none."""
    folder, rows = scratch.folder(spark), table(spark, d, "embeddings")
    changed = rows.withColumn("embedding", F.when(F.col("label") == 3, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding")))

    def run(vectors):
        norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
        encode = lambda r: r.withColumn("embedding", F.transform("raw", lambda x: (x / F.nullif(norm, F.lit(0.0))).cast("float")))
        content = F.concat_ws(":", F.col("vec_id").cast("string"), F.array_join(F.col("raw").cast("array<string>"), ","))
        return stores.filled(vectors.withColumnRenamed("embedding", "raw"), folder, encode, "unit-1", "float32", content)

    run(rows)
    found, n_second = run(changed)
    _, n_third = run(changed)
    return found.select("vec_id", "generation", F.size("embedding").alias("dims"), F.signum(F.get("embedding", F.lit(0))).cast("int").alias("first"), F.lit(n_second).cast("long").alias("n_second"), F.lit(n_third).alias("n_third"))


@query("SELECT lang, n_docs, n_bytes, false AS first, true AS again, false AS option, false AS step FROM (SELECT lang, count(*) AS n_docs, sum(strlen(text))::BIGINT AS n_bytes FROM documents GROUP BY 1)")
def sb07_cache_by_plan(spark, d):
    """Equal steps are read where they were left; another option, or another step, is computed."""
    folder = scratch.folder(spark)

    def steps(name: str, least: int = 0):
        docs = table(spark, d, "documents").where(F.coalesce(F.char_length("text"), F.lit(0)) >= least)
        sizes = docs.select("lang", F.octet_length("text").alias(name))
        return sizes.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(name).alias("n_bytes"))

    _, first = stores.cached(steps("a"), folder, {"version": 1})
    found, again = stores.cached(steps("b"), folder, {"version": 1})
    _, option = stores.cached(steps("a"), folder, {"version": 2})
    _, step = stores.cached(steps("a", 5), folder, {"version": 1})
    return found.select("lang", "n_docs", "n_bytes", *(F.lit(x).alias(n) for n, x in (("first", first), ("again", again), ("option", option), ("step", step))))
