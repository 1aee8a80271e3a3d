"""Repair of conversations by a dynamic program over the turns that are retained.

A repaired conversation's roles read ``(s?(ua)+)?``: perhaps one system turn, then user and assistant by turns, or nothing.
A turn is kept, reroled to user or assistant, or deleted (one whose role begins with none of s, u and a, or is empty, cannot
be kept); turns with empty text can be inserted anywhere. The program chooses the turns that are retained: what lies between
two of them is deleted, at a price that a prefix sum of deletions gives; for each state (nothing yet, or the role of the last
retained turn) a running minimum holds the best way on; and the roles of two retained neighbours decide what is inserted
between them. Of the cheapest repairs the one with the least audit (the edits' initials: D, I, K, R) is taken: from a state
each edit leads to one other, so an audit names one repair.

A conversation can be of any length: its turns are cut into stretches, each summed up by the cheapest way from each state
to each other (a 4 x 4 matrix), stretches are chained, and each is then walked by itself for every state it can begin in.
Only the last pass, which digests a repaired conversation as one text, reads all turns of one in order; it holds one turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._lineage import written
from ._words import release, small_batches

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
NEVER = 1 << 40
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. Roles have the numbers of their states.
START, SYSTEM, USER, ASSISTANT = range(4)
#: INSERTS[state][role]: the turns to insert before a retained one; -1: it cannot come there.
INSERTS = [[-1, 0, 0, 1], [-1, -1, 0, 1], [-1, -1, 1, 0], [-1, -1, 0, 1]]
#: What is inserted after the last retained turn.
CLOSING = [0, 2, 1, 0]
#: Edits of a turn, in the order of what they add to the audit.
EDITS = ["D", "IK", "IR", "K", "R"]
BLANKS = " \t\n\x0b\x0c\r"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """next[code, state, edit] and price[code, state, edit]. A code is role + 4 * (must be deleted) + 8 * truncated."""
    ahead, price = np.zeros((16, 4, 5), np.int64), np.full((16, 4, 5), NEVER, np.int64)
    for code in range(16):
        role, doomed, truncated = code % 4, code // 4 % 2, code // 8
        for state in range(4):
            ahead[code, state, 0], price[code, state, 0] = state, DELETE
            for to, edit, cost in ((role, "K", 0), (USER, "R", REROLE), (ASSISTANT, "R", REROLE)):
                n = INSERTS[state][to]
                if not doomed and to and n >= 0:
                    at = EDITS.index("I" * n + edit)
                    ahead[code, state, at], price[code, state, at] = to, INSERT * n + cost + TRUNCATED * truncated
    return ahead, price


NEXT, PRICE = _tables()
#: RETAIN[code, state, role]: the price of retaining a turn in a role, without what lies between.
RETAIN = np.full((16, 4, 4), NEVER, np.int64)
for _edit in range(1, 5):
    for _code in range(16):
        for _state in range(4):
            _to = NEXT[_code, _state, _edit]
            RETAIN[_code, _state, _to] = min(RETAIN[_code, _state, _to], PRICE[_code, _state, _edit])
END = np.array([INSERT * n for n in CLOSING], np.int64)


class Stretches:
    """The codes of several stretches of turns, worked through together, a turn of each at a time; longer ones come first."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        size = np.diff(bounds)
        self.order = np.argsort(-size, kind="stable")
        self.codes, self.first, self.size = codes, bounds[:-1][self.order], size[self.order]
        self.most = int(self.size[0]) if len(size) else 0
        # How many stretches have a turn at each place.
        self.live = np.searchsorted(-self.size, -np.arange(self.most), "left")

    def _best(self, ends: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        """Running minima per state, from the last turn to the first. ``ends``: [stretch, state, way] the price of going on
        from each state behind the stretch. Prices are held with all deletions before them, so a gap costs nothing more."""
        minima = ends + DELETE * self.size[:, None, None]
        if keep is not None:
            keep[self.first + self.size + np.arange(len(self.size))] = ends[:, :, 0]
        for t in range(self.most - 1, -1, -1):
            n = self.live[t]
            now = minima[:n]
            # A turn that is retained takes the place of its own deletion.
            retained = (RETAIN[self.codes[self.first[:n] + t]][:, :, :, None] + now[:, None, :, :]).min(2) - DELETE
            minima[:n] = np.minimum(now, retained)
            if keep is not None:
                keep[self.first[:n] + t + np.arange(n)] = minima[:n, :, 0] - DELETE * t
        return minima

    def matrices(self) -> np.ndarray:
        """[stretch, from state, to state]: the cheapest way."""
        ends = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, NEVER), (len(self.size), 4, 4)).copy()
        out = np.empty_like(ends)
        out[self.order] = np.minimum(self._best(ends), NEVER)
        return out

    def walks(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edit of each turn, and the state behind each stretch, for each state it can begin in: of the cheapest ways
        the one with the least audit. ``ends``: [stretch, state] the price of going on."""
        # Prices to go at every turn, those of stretch i shifted by i, for each has one more than turns.
        prices = np.empty((len(self.codes) + len(self.size), 4), np.int64)
        self._shift(prices, ends[self.order])
        edits = np.zeros((len(self.codes), 4), np.uint8)
        state = np.broadcast_to(np.arange(4), (len(self.size), 4)).copy()
        for t in range(self.most):
            n = self.live[t]
            at, now = self.first[:n] + t, state[:n]
            code, place = self.codes[at][:, None], (at + np.arange(n))[:, None]
            ways, prices_of = NEXT[code, now], PRICE[code, now]
            best = (prices_of + prices[place[:, :, None] + 1, ways] == prices[place, now][:, :, None]).argmax(2)
            edits[at] = best
            state[:n] = np.take_along_axis(ways, best[:, :, None], 2)[:, :, 0]
        out = np.empty_like(state)
        out[self.order] = state
        return edits, out

    def _shift(self, prices: np.ndarray, ends: np.ndarray) -> None:
        # Longer stretches come first here, so their places are laid out in that order.
        codes = np.concatenate([self.codes[a : a + n] for a, n in zip(self.first.tolist(), self.size.tolist(), strict=True)]) if len(self.size) else self.codes
        self.back = np.concatenate([np.arange(a, a + n) for a, n in zip(self.first.tolist(), self.size.tolist(), strict=True)]) if len(self.size) else np.zeros(0, np.int64)
        self.codes, self.first = codes, np.cumsum(self.size) - self.size
        self._best(ends[:, :, None], prices)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy and gone of the rows after damage; a row that was dropped stays, marked ``gone``, without text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 0, "").when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"), (kind == 0).alias("gone"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    """Adds ``at``, a number that grows along each conversation: by turn (null first), then md5 of ``role:text``, then copy.

    Sorted by range over all rows, so a conversation of any size is dealt over tasks.
    """
    keys = ["conv_id", "turn", "tie", "copy"]
    return written(rows.withColumn("tie", F.md5(F.concat("role", F.lit(":"), "text").cast("binary"))).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie", "copy").withColumn("at", F.monotonically_increasing_id()))


def _fault(first: Column) -> Column:
    """The first fault of a row; ``first``: whether its role and text were not seen before it."""
    last = F.rtrim(F.col("text"), F.lit(BLANKS))
    return F.when(F.col("gone"), "gone").when(last == "", "blank").when(~first, "duplicate").when(~F.right(last, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")


def faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault`` to ``ordered`` rows: blank, duplicate, truncated, gone, or ''. What was seen first is found by text, and marked by number."""
    firsts = rows.where("NOT gone").groupBy("conv_id", "role", "text").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    return rows.join(firsts, "at", "left").withColumn("fault", _fault(F.coalesce("first", F.lit(False)))).drop("first")


def _slices(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """The same rows, with about ``most`` turns at a time."""
    for batch in batches:
        if batch.num_rows:
            size = np.asarray(batch.column("codes").value_lengths(), np.int64)
            group = (np.cumsum(size) - size) // most
            at = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(at[:-1], at[1:], strict=True):
                yield batch.slice(a, b - a)
    release()


def _stretches(batch: pa.RecordBatch) -> Stretches:
    column = batch.column("codes")
    return Stretches(np.asarray(column.flatten(), np.int64), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths(), np.int64))]))


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("start"), _lists(_stretches(batch).matrices().reshape(-1, 16))], ["conv_id", "start", "ways"])


def _chained_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The price of going on behind each stretch: from the end of the conversation back."""
    for batch in batches:
        starts, ends, costs = [], [], []
        for chain in batch.column("chain").to_pylist():
            price, own = END, []
            for link in reversed(chain):
                own.append(price.tolist())
                price = np.minimum((np.array(link["ways"], np.int64).reshape(4, 4) + price[None, :]).min(1), NEVER) if len(chain) > 1 else price
            starts += [link["start"] for link in reversed(chain)]
            ends += own
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["start", "ends"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        ends = np.asarray(batch.column("ends").flatten(), np.int64).reshape(-1, 4)
        work = _stretches(batch)
        edits, state = work.walks(ends)
        plain = np.empty_like(edits)
        plain[work.back] = edits
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.asarray(batch.column("codes").value_lengths(), np.int64))]), pa.int32())
        # Four edits of a turn in one number, by the state in which its stretch begins.
        packed = (plain.astype(np.int32) << np.array([0, 4, 8, 12], np.int32)).sum(1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("start"), batch.column("ats"), pa.ListArray.from_arrays(offsets, pa.array(packed)), _lists(state)], ["conv_id", "start", "ats", "packed", "behind"])


def _chained_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each stretch begins: from the start of the conversation on."""
    for batch in batches:
        starts, states = [], []
        for chain in batch.column("chain").to_pylist():
            state = START
            for link in chain:
                starts.append(link["start"])
                states.append(state)
                state = link["behind"][state]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(states, pa.int32())], ["start", "state"])


def edits(rows: DataFrame, stretch_bits: int = 14) -> DataFrame:
    """at and edit (D, IK, IR, K or R) of each row that is not gone: the cheapest repair with the least audit. ``rows`` as of ``faults``."""
    role = F.substring("role", 1, 1)
    code = F.when(role == "s", SYSTEM).when(role == "u", USER).when(role == "a", ASSISTANT).otherwise(0) + F.when(F.col("fault").isin("blank", "duplicate"), 4).when(F.col("fault") == "truncated", 8).otherwise(0)
    turns = rows.where("NOT gone").select("conv_id", "at", code.alias("code"))
    turns = turns.groupBy("conv_id", F.shiftright("at", stretch_bits).alias("stretch")).agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("turns"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    pieces = written(turns.select("conv_id", F.col("turns.at")[0].alias("start"), F.col("turns.at").alias("ats"), F.col("turns.code").alias("codes")))
    chain = lambda frame, column: frame.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", column))).alias("chain")).select("chain")
    ways = pieces.select("conv_id", "start", "codes").mapInArrow(_summed, f"conv_id {kind}, start long, ways array<long>")
    ends = chain(ways, "ways").mapInArrow(_chained_back, "start long, ends array<long>")
    walks = written(pieces.join(ends, "start").mapInArrow(_walked, f"conv_id {kind}, start long, ats array<long>, packed array<int>, behind array<long>"))
    states = chain(walks.select("conv_id", "start", "behind"), "behind").mapInArrow(_chained_on, "start long, state int")
    names = F.array(*map(F.lit, EDITS))
    each = walks.join(states, "start").select("state", F.explode(F.arrays_zip("ats", "packed")).alias("turn"))
    return each.select(F.col("turn.ats").alias("at"), names[F.expr("shiftright(turn.packed, 4 * state) & 15")].alias("edit"))


def repair(rows: DataFrame, stretch_bits: int = 14) -> DataFrame:
    """The rows of ``ordered``, each with its fault and its edit (null where it is gone)."""
    known = written(faults(rows))
    return known.join(edits(known, stretch_bits), "at", "left")


def _streamed(repaired: DataFrame, names: list[str], types: str, run) -> DataFrame:
    """Each conversation's rows pass one task in order; ``run`` gives what a conversation has come to so far, or at its end."""
    small_batches(repaired.sparkSession)
    columns = repaired.select("conv_id", "at", "turn", "role", "text", "fault", "edit").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    kind = columns.schema["conv_id"].dataType
    schema = to_arrow_type(kind)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done])
            done.clear()
            return pa.RecordBatch.from_arrays([out.column(c).cast(schema) if c == "conv_id" else out.column(c) for c in names], names)

        for batch in batches:
            for conv, turn, role, text, fault, edit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "edit")), strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        done += run(now, True)
                    now = Repaired(conv)
                if fault != "gone":
                    now.add(turn, role, text, fault, edit)
                    done += run(now, False)
            if done:
                yield made()
        if now is not None and (rest := run(now, True)):
            done += rest
            yield made()

    return columns.mapInArrow(streamed, f"conv_id {kind.simpleString()}, {types}")


class Repaired:
    """What one conversation comes to, a turn at a time; only the audit grows with it."""

    def __init__(self, conv_id):
        self.conv_id, self.counts, self.illegal, self.cost = conv_id, {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, 0, 0
        self.before, self.low, self.high, self.distinct = None, None, None, 0
        self.state, self.audit, self.hash, self.lines, self.fresh = START, bytearray(), hashlib.sha256(), 0, []

    def line(self, role: str, text: str, edit: str) -> None:
        self.hash.update(("\n" * (self.lines > 0) + role + ":" + text).encode())
        self.fresh.append((self.conv_id, self.lines, role, text, edit))
        self.lines += 1

    def taken(self) -> list[tuple]:
        out, self.fresh = self.fresh, []
        return out

    def insert(self) -> None:
        self.state = ASSISTANT if self.state == USER else USER
        self.line("assistant" if self.state == ASSISTANT else "user", "", "I")
        self.cost += INSERT

    def add(self, turn, role: str, text: str, fault: str, edit: str) -> None:
        self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.audit += edit.encode()
        for what in edit:
            if what == "I":
                self.insert()
            elif what == "D":
                self.cost += DELETE
            else:
                self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]] if what == "K" else ASSISTANT if self.state == USER else USER
                self.line(role if what == "K" else "assistant" if self.state == ASSISTANT else "user", text, what)
                self.cost += REROLE * (what == "R") + TRUNCATED * (fault == "truncated")

    def close(self) -> None:
        for _ in range(CLOSING[self.state]):
            self.audit += b"I"
            self.insert()

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return (self.conv_id, gaps, *(n for k, n in self.counts.items() if k), self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest())


def _turns(now: Repaired, end: bool) -> list[tuple]:
    if end:
        now.close()
    return now.taken()


def _row(now: Repaired, end: bool) -> list[tuple]:
    now.taken()
    if end:
        now.close()
    return [now.row()] if end else []


def turns(repaired: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, nth (from 0), role, text and edit (K, R or I). One that nothing is left of has no rows."""
    return _streamed(repaired, ["conv_id", "nth", "role", "text", "edit"], "nth long, role string, text string, edit string", _turns)


def digest(repaired: DataFrame) -> DataFrame:
    """One row for each conv_id (null is one, and one whose rows are all gone stays): gaps, the rows by first fault, illegal
    neighbours, the cost, the audit and the digest of the repaired turns, ``role:text`` a line.

    A conversation's turns pass one task in order, one at a time, for the digest of its text is one; only the audit is held.
    """
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return _streamed(repaired, names, ", ".join(f"{n} long" for n in names[1:7]) + ", audit string, repaired_sha256 string", _row)
