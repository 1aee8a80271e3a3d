"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. Every document starts with a label, a shard; the linked ones are dealt evenly.
The law is ``rows``: the counts of the shards differ by one at most. Documents of one text and label are alike, so the
state is a row (text, shard, number of its documents there), and a text that a third of the corpus repeats is a few
rows. In a round

1. the state is joined with the labels of each text's neighbours, its documents counted by shard;
2. documents ask to move to the shard that most of their neighbours are labelled with, if it holds no fewer of them than
   their own, so that a move never cuts more links;
3. quotas are set from the shards' room (capacity less linked documents) and from how many ask to move the other way, in
   pairs or rings of shards; the requests of larger texts are granted first, by running sums, up to the quota;
4. granted documents take the label, and the next round counts anew.

Shards that nobody can enter are closed to the next rounds, until others have moved. When no such move is left, texts that
are still cut may move as a whole into a shard with room for all of them. Each move lowers the number of cut links, so
the rounds end by themselves. Texts that could fill a sixteenth of a shard go first, then the others in the room that
these leave. Texts that occur once have no links: they fill the shards up. Ranks are made of counts by bucket and a window inside each bucket, so none is taken over a whole shard. The
driver holds a number for each pair of shards.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._lineage import cut


def _running(rows: DataFrame, group: str | None, size: str, order: list, buckets: int, first: Column | int = 0, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Adds ``before``: the sum of ``size`` over the rows of the same group ahead: by ``first`` (a small number), by
    bucket of the columns ``by``, and then by ``order``."""
    first = first if isinstance(first, Column) else F.lit(first)
    rows = rows.withColumn("bucket", (first * buckets + F.pmod(F.xxhash64(*by, F.lit(31)), F.lit(buckets))).cast("long"))
    keys = ([group] if group else []) + ["bucket"]
    sums = rows.groupBy(*keys).agg(F.sum(size).alias("s"))
    by_group = Window.partitionBy(*([group] if group else [])).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("s").over(by_group), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts, keys).withColumn("before", F.col("bucket_start") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("bucket", "bucket_start")


def _of(values: list, shard: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col(shard) + 1)


def cut_links(state: DataFrame) -> int:
    """The pairs of equal texts in different shards. ``state``: (key, shard, n), the documents of each text in each shard."""
    n = F.sum("n").cast("decimal(38,0)")
    pairs = state.groupBy("key").agg((n * n - F.sum(F.col("n").cast("decimal(19,0)") * F.col("n"))).alias("cut"))
    return int(pairs.agg(F.sum("cut")).first()[0] or 0) // 2


def _asked(state: DataFrame, eligible: list[bool], turn: int) -> DataFrame:
    """Step 1 and 2: the state with ``to``, the shard of the most neighbours among the eligible, and ``there``, how many
    they are; only the rows that ask to move. Ties are broken anew in each round."""
    best = F.struct(F.col("n").alias("there"), F.pmod(F.xxhash64("key", "shard", F.lit(turn)), F.lit(1 << 20)).alias("tie"), F.col("shard").alias("to"))
    votes = state.where(_of(eligible, "shard")).groupBy("key").agg(F.max(best).alias("best")).select("key", "best.*")
    moves = (F.col("to") != F.col("shard")) & (F.col("there") >= F.col("n"))
    return state.join(votes, "key").where(moves).select("key", "shard", "n", "to", "there")


def _cycle(edges: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """A cycle of edges with something left, or none."""
    after = {s: [t for (a, t), n in sorted(edges.items()) if a == s and n > 0] for s, _ in edges}
    done: set[int] = set()

    def walk(path: list[int]) -> list[int]:
        for t in after.get(path[-1], []):
            if t in path:
                return [*path[path.index(t) :], t]
            if t not in done and (found := walk([*path, t])):
                return found
        done.add(path[-1])
        return []

    for s in after:
        if s not in done and (found := walk([s])):
            return list(zip(found[:-1], found[1:], strict=True))
    return []


def _quotas(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Step 3: how many may move from one shard to another, so that none is over its capacity afterwards: into room,
    that of documents which leave too, and round cycles of shards."""
    left, room = dict(asked), list(room)
    while True:
        into = max(((min(n, room[t]), s, t) for (s, t), n in left.items()), default=(0, 0, 0))
        if into[0] > 0:
            n, s, t = into
            room[s], room[t] = room[s] + n, room[t] - n
            left[s, t] -= n
        elif cycle := _cycle(left):
            n = min(left[e] for e in cycle)
            for e in cycle:
                left[e] -= n
        else:
            return {e: n - left[e] for e, n in asked.items()}


def _exchanged(state: DataFrame, room: list[int], eligible: list[bool], turn: int, buckets: int) -> tuple[DataFrame, list[int], set[int]]:
    """A round: the new state, the room after it (the same if nothing moved), and the shards that were asked for."""
    shards = len(room)
    asked = cut(_asked(state, eligible, turn).withColumn("pair", F.col("shard") * shards + F.col("to")))
    wanted = {divmod(r.pair, shards): r.n for r in asked.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    quota = _quotas(wanted, room)
    if not any(quota.values()):
        return state, room, {t for _, t in wanted}
    limit = F.element_at(F.array(*(F.lit(quota.get((s, t), 0)) for s in range(shards) for t in range(shards))), F.col("pair") + 1)
    ranked = _running(asked, "pair", "n", [F.desc("n"), "key"], buckets, 63 - F.floor(F.log2("there")))
    granted = cut(ranked.withColumn("m", F.greatest(F.lit(0), F.least(F.col("n"), limit - F.col("before"))).cast("long")).where("m > 0").select("key", "shard", "to", "m"))
    moved = {(r.shard, r.to): r.m for r in granted.groupBy("shard", "to").agg(F.sum("m").alias("m")).collect()}
    steps = granted.select("key", F.explode(F.array(F.struct(F.col("shard"), (-F.col("m")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("m").alias("n")))).alias("x")).select("key", "x.*")
    state = cut(state.unionByName(steps).groupBy("key", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
    return state, [r + sum(m for (s, _), m in moved.items() if s == i) - sum(m for (_, t), m in moved.items() if t == i) for i, r in enumerate(room)], set()


def _whole(state: DataFrame, room: list[int], buckets: int) -> tuple[DataFrame, list[int], int]:
    """Moves cut texts as a whole: each to the shard of most of its documents, of those with room for the others."""
    own = [F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)) for s in range(len(room))]
    texts = state.groupBy("key").agg(F.sum("n").alias("total"), F.array(*own).alias("own"), F.count("*").alias("parts")).where("parts > 1")
    fits = F.array(*(F.struct(F.col("own")[s].alias("there"), F.pmod(F.xxhash64("key", F.lit(s)), F.lit(1 << 20)).alias("tie"), F.lit(s).alias("to")) for s in range(len(room))))
    best = F.array_max(F.filter(fits, lambda x: F.col("total") - x["there"] <= F.element_at(F.array(*map(F.lit, room)), x["to"] + 1)))
    asked = texts.withColumn("best", best).where("best IS NOT NULL").select("key", "own", "total", "best.to", (F.col("total") - F.col("best.there")).alias("n"))
    # A text of many documents last: more are made whole.
    ranked = _running(asked, "to", "n", ["n", "key"], buckets, F.floor(F.log2("n")))
    granted = cut(ranked.where(F.col("before") + F.col("n") <= _of(room, "to")).select("key", "own", "total", "to", "n"))
    gone = granted.agg(F.count("*").alias("texts"), *(F.sum(F.when(F.col("to") != s, F.col("own")[s]).otherwise(-F.col("n"))).alias(f"s{s}") for s in range(len(room)))).first()
    if not gone.texts:
        return state, room, 0
    state = cut(state.join(granted.select("key"), "key", "left_anti").unionByName(granted.select("key", F.col("to").alias("shard"), F.col("total").alias("n"))))
    return state, [r + gone[f"s{s}"] for s, r in enumerate(room)], gone.texts


def propagate(state: DataFrame, caps: list[int], buckets: int = 16) -> DataFrame:
    """The state (key, shard, n) when no round moves anything any more. ``caps``: the most documents of each shard; the
    state given must keep to them. Sizes stay within the capacities in every round."""
    state = cut(state)
    loads = {r.shard: r.n for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    room, closed, moved = [cap - loads.get(s, 0) for s, cap in enumerate(caps)], set(), False
    for turn in count():
        before, in_vain = state, set()
        if len(closed) < len(caps):
            state, room, in_vain = _exchanged(state, room, [s not in closed for s in range(len(caps))], turn, buckets)
        if state is not before:
            moved = True
        elif in_vain:
            closed |= in_vain
        elif moved and closed:
            closed, moved = set(), False
        else:
            state, room, whole = _whole(state, room, buckets)
            if not whole:
                break
            closed, moved = set(), False
    return state


def _dealt(cells: DataFrame, room: list[int], buckets: int) -> DataFrame:
    """The first state (key, shard, n): the documents of the cells (key, cell, n) in no order, in proportion to the room."""
    total, n = sum(room), cells.agg(F.sum("n")).first()[0] or 0
    edges = [n * sum(room[:s]) // max(total, 1) for s in range(len(room) + 1)]
    rows = _running(cells, None, "n", ["key", "cell"], buckets, by=("key", "cell"))
    parts = F.array(*(F.struct(F.lit(s).alias("shard"), (F.least(F.col("before") + F.col("n"), F.lit(edges[s + 1])) - F.greatest("before", F.lit(edges[s]))).alias("n")) for s in range(len(room))))
    return rows.select("key", F.inline(parts)).where("n > 0").groupBy("key", "shard").agg(F.sum("n").alias("n"))


def shard(docs: DataFrame, shards: int = 8, bucket_rows: int = 20_000) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus one), text_crc32, shard (from 0) and slot (gapless from 0 in a shard).

    ``docs`` needs doc_id and text; other columns, whatever their names, are ignored. A null text has no bytes; null
    texts are equal to each other and to no other text. Repeated rows and rows with a null doc_id each get a slot.
    Documents of one text are in one shard unless its capacity, or the even counts, split them. Every row has a place;
    an empty table gives none. Texts are told apart by 128-bit digests.
    """
    text = F.col("text")
    key = F.when(text.isNull(), F.lit(b"")).otherwise(F.unhex(F.md5(text.cast("binary"))))
    rows = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), key.alias("key"))
    # A row's number, fixed by the checkpoint, deals a text's documents into cells, so that no key holds them all.
    rows = cut(rows.withColumn("cell", F.xxhash64(F.monotonically_increasing_id())))
    total = rows.count()
    buckets = max(16, -(-total // bucket_rows))
    caps = [total // shards + (s < total % shards) for s in range(shards)]
    rows = rows.withColumn("cell", F.pmod("cell", F.lit(buckets)).cast("int"))
    cells = rows.groupBy("key", "cell").agg(F.count("*").alias("n"))
    texts = cells.groupBy("key").agg(F.sum("n").alias("of")).where("of > 1")
    cells = cut(cells.join(texts, "key").select("key", "cell", "n", (F.col("of") * 16 >= min(caps)).alias("large")))
    room, waves = list(caps), []
    for wave in ("large", "NOT large"):
        waves.append(propagate(_dealt(cells.where(wave).select("key", "cell", "n"), room, buckets), room, buckets))
        used = {r.shard: r.n for r in waves[-1].groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [r - used.get(s, 0) for s, r in enumerate(room)]
    pieces = waves[0].unionByName(waves[1])
    loads = [cap - r for cap, r in zip(caps, room, strict=True)]

    # Linked documents: a text's documents in order of cell go to its pieces in order of shard.
    placed = _running(pieces, "shard", "n", ["key"], buckets)
    ahead = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("key", "shard", F.col("before").alias("slot"), "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("from"))
    lists = placed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("from", "n", "shard", "slot"))).alias("pieces"))
    in_text = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("start", F.coalesce(F.sum("n").over(in_text), F.lit(0))).drop("n", "large").join(lists, "key")
    in_cell = Window.partitionBy("key", "cell").orderBy("doc_id")
    rows = rows.join(starts, ["key", "cell"], "left").withColumn("rank", F.col("start") + F.row_number().over(in_cell) - 1)
    own = F.element_at(F.filter("pieces", lambda p: (p["from"] <= F.col("rank")) & (F.col("rank") < p["from"] + p["n"])), 1)
    linked = rows.where("pieces IS NOT NULL").withColumn("own", own).select("doc_id", "size", "text_crc32", F.col("own.shard").alias("shard"), (F.col("own.slot") + F.col("rank") - F.col("own.from")).alias("slot"))

    # The others fill the shards, in order.
    single = _running(rows.where("pieces IS NULL").select("doc_id", "size", "text_crc32", "key", F.lit(1).alias("one")), None, "one", ["key"], buckets)
    need = [cap - load for cap, load in zip(caps, loads, strict=True)]
    edges = [sum(need[:s]) for s in range(shards)]
    fill = sum((F.when(F.col("before") >= F.lit(e), 1).otherwise(0) for e in edges[1:]), F.lit(0)).cast("int")
    single = single.withColumn("shard", fill).select("doc_id", "size", "text_crc32", "shard", (F.col("before") - _of(edges, "shard") + _of(loads, "shard")).alias("slot"))
    return linked.unionByName(single)


def digest(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
