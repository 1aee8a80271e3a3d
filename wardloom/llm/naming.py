"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed size. The blocks are sorted, and each distinct one is named by its place, an
integer. Adjacent names are then paired, and the distinct pairs sorted and named in turn, until each text has one name:
a text of n blocks after ceil(log2 n) rounds. A name of a round stands for one sequence of blocks and no other, so equal
texts, and only they, end in one round with one name. No hash decides.

Each task of the first pass remembers the blocks it has seen, in bounded memory, and sends a block once; so a block that
a third of the texts share is shuffled once a task. After that only integers move. The table of blocks is written before
anything is derived from it, so that the numbers of rows in it stay the same when an executor is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._lineage import written
from ._words import Texts, pieces, release, small_batches

#: Names and numbers of rows: the number of the task in the upper bits, a count in the lower ones.
TASK_BITS = 36


def blocks(docs: DataFrame, block_bytes: int = 1024, remembered: int = 32_768, piece_bytes: int = 2 << 20) -> DataFrame:
    """The blocks of each text, lower-cased in A-Z: row (a number of the document), nth, of (how many it has), seen (a number that
    equal blocks of a task share as a rule), block (only where ``seen`` is new), and with the first block doc_id and text_sha256.

    A null or empty text is one empty block.
    """
    source = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, row, fresh, known = TaskContext.get().partitionId() << TASK_BITS, 0, 0, {}
        for batch in pieces(batches, "text", piece_bytes, rows=20_000):
            texts = Texts(batch.column("text"), lower=True)
            raw, size = texts.data.tobytes(), np.diff(texts.offsets)
            many = np.maximum(-(-size // block_bytes), 1)
            of = np.repeat(np.arange(texts.n), many)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            starts = texts.offsets[of] + nth * block_bytes
            ends = np.minimum(starts + block_bytes, texts.offsets[of + 1])
            seen, sent = np.empty(len(of), np.int64), []
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                block = raw[a:b]
                name = known.get(block)
                if name is None:
                    if len(known) >= remembered:
                        known.clear()
                    name = known[block] = fresh
                    fresh += 1
                    sent.append(block)
                else:
                    sent.append(None)
                seen[i] = name
            first = nth == 0
            hashes = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True)]
            at = pa.array(np.where(first, of, 0), mask=~first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(base + row + of), pa.array(nth), pa.array(many[of]), pa.array(base + seen), pa.array(sent, pa.binary()), batch.column("doc_id").take(at), pa.array(hashes, pa.string()).take(at)],
                ["row", "nth", "of", "seen", "block", "doc_id", "text_sha256"],
            )
            row += texts.n

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(cut, f"row long, nth long, of long, seen long, block binary, doc_id {kind}, text_sha256 string")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names of sorted blocks: one more wherever a block differs from the one before it."""
    base, count, before = TaskContext.get().partitionId() << TASK_BITS, -1, None
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block")
        new = np.ones(batch.num_rows, bool)
        new[0] = block[0].as_py() != before
        new[1:] = pc.not_equal(block.slice(1), block.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        names = count + np.cumsum(new)
        count, before = int(names[-1]), block[-1].as_py()
        yield pa.RecordBatch.from_arrays([batch.column("seen"), pa.array(base + names)], ["seen", "name"])
    release()


def names(parts: DataFrame) -> DataFrame:
    """row, round and name of each document of ``blocks``: equal in the last two where the texts are equal, and only there."""
    sorted_blocks = parts.where("block IS NOT NULL").select("block", "seen").repartition("block").sortWithinPartitions("block")
    named = sorted_blocks.mapInArrow(_numbered, "seen long, name long")
    level = written(parts.select("row", "nth", "of", "seen").join(named, "seen").select("row", "nth", "of", "name"))
    done = [level.where("of = 1").select("row", F.lit(0).alias("round"), "name")]
    most = level.agg(F.max("of")).head()[0] or 1
    for step in range(1, (most - 1).bit_length() + 1):
        left, right = (F.min(F.when(F.col("nth") % 2 == side, F.col("name"))) for side in (0, 1))
        pairs = level.where("of > 1").groupBy("row", F.shiftright("nth", 1).alias("nth"), F.expr("(of + 1) div 2").alias("of")).agg(left.alias("a"), F.coalesce(right, F.lit(-1)).alias("b"))
        pairs = written(pairs)
        distinct = pairs.groupBy("a", "b").agg(F.lit(1).alias("one")).sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("name"))
        level = written(pairs.join(written(distinct), ["a", "b"]).select("row", "nth", "of", "name"))
        done.append(level.where("of = 1").select("row", F.lit(step).alias("round"), "name"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def dedup(docs: DataFrame, block_bytes: int = 1024) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row: of equal texts the row of the largest doc_id stays.

    Texts are equal when they are identical after lower-casing A-Z; a null text is an empty one. Of several rows with the
    largest id one stays; a row without an id stays only where none of its group has one (keep_id is then null). Columns
    other than doc_id and text are ignored, whatever their names. An empty table gives an empty one.
    """
    parts = written(blocks(docs, block_bytes))
    rows = written(parts.where("nth = 0").select("row", "doc_id", "text_sha256").join(names(parts), "row"))
    # Nulls come before all ids in the order of structs.
    best = F.max(F.struct(F.col("doc_id").alias("id"), F.col("row").alias("at"))).alias("best")
    # Written, so that the join has a shuffle of its own on both sides and the rows of a large group can be split.
    groups = written(rows.groupBy("round", "name").agg(best, F.count("*").alias("group_size")))
    return rows.join(groups, ["round", "name"]).select(
        "doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.at")).alias("kept"), "text_sha256",
    )
