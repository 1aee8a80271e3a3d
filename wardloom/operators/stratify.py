"""Splits that keep the shares of several labels at once.

The rows matter only by which labels they have, so the division is worked out on the counts of label combinations: the
label with the fewest rows left goes first, and of each of its combinations every part gets what it still lacks. Rows of
a combination are then dealt in hash order by their place, which comes from counts by range, so no task sorts them all
and no row reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import hash_key
from .relational import places

#: The most label combinations that are worked on at once: they are what reaches the driver.
MOST_COMBINATIONS = 200_000


def divide(counts: dict[tuple[int, ...], int], shares: Sequence[float], passes: int = 100) -> dict[tuple[int, ...], list[int]]:
    """How many rows of each combination (its labels' numbers) each part gets.

    Labels are taken by how few rows have them and are left, ties by number. Of a combination each part gets the whole rows
    of its share; each row that is left over goes to the part that lacks most, summed over the combination's labels and all
    rows, ties to the first. Combinations without labels come last. Then rows move between parts, one of a combination, or
    one each of two, as long as that lowers the sum of squares of what labels and rows lack.
    """
    total, parts = sum(counts.values()), range(len(shares))
    shares = [s / sum(shares) for s in shares]
    labels = sorted({x for c in counts for x in c})
    left = {x: sum(n for c, n in counts.items() if x in c) for x in labels}
    # What each part lacks of each label, and of all rows (-1).
    lack = {x: [n * s for s in shares] for x, n in {**left, -1: total}.items()}
    out: dict[tuple[int, ...], list[int]] = {}

    def give(c: tuple[int, ...], p: int, k: int) -> None:
        out[c][p] += k
        for x in (*c, -1):
            lack[x][p] -= k

    def want(c: tuple[int, ...], p: int) -> float:
        return sum(lack[x][p] for x in (*c, -1))

    todo = dict(counts)
    while todo:
        live = {x for c in todo for x in c}
        label = min(live, key=lambda x: (left[x], x)) if live else None
        for c in sorted(c for c in todo if label is None or label in c):
            n, out[c] = todo.pop(c), [0] * len(shares)
            for p in parts:
                give(c, p, min(int(n * shares[p] + 1e-9), n - sum(out[c])))
            while sum(out[c]) < n:
                give(c, max(parts, key=lambda p: (round(want(c, p), 9), -p)), 1)
            for x in c:
                left[x] -= n
    order = sorted(out)
    for _ in range(passes):
        moved = False
        # The best row to move from each part to each other, by how much more the other wants it.
        best: dict[tuple[int, int], tuple[float, tuple[int, ...]]] = {}
        for c in order:
            wants = [want(c, p) for p in parts]
            low, high = min((p for p in parts if out[c][p]), key=lambda p: wants[p], default=0), max(parts, key=lambda p: wants[p])
            if out[c][low] and wants[high] - wants[low] > len(c) + 1 + 1e-9:
                give(c, low, -1)
                give(c, high, 1)
                moved = True
                wants = [want(c, p) for p in parts]
            for p in parts:
                for q in parts:
                    gain = wants[q] - wants[p] - (len(c) + 1)
                    if p != q and out[c][p] and gain > best.get((p, q), (-1e18, ()))[0]:
                        best[p, q] = (gain, c)
        for (p, q), (gain, c) in sorted(best.items()):
            gain_back, d = best.get((q, p), (-1e18, ()))
            common = len(set(c) & set(d)) + 1
            # Both moves together: where the two share a label, its two changes undo each other.
            if p < q and not moved and (q, p) in best and c != d and out[c][p] and out[d][q] and gain + gain_back + 2 * common > 1e-9:
                for e, u, v in ((c, p, q), (d, q, p)):
                    give(e, u, -1)
                    give(e, v, 1)
                moved = True
        if not moved:
            break
    return out


def stratified(df: DataFrame, key: str, labels: list[str], shares: Sequence[float], seed: int = 56) -> DataFrame:
    """Adds ``part``, from 0: rows dealt in parts of these shares so that each label's rows are, too.

    A label counts where its column is 1; null and others do not. ``key`` tells rows apart: rows of one key that also have
    one combination lie together in hash order. A null key is one of its own. Raises beyond 200,000 combinations.
    """
    combination = F.concat_ws(",", *(F.when(F.col(f"`{c}`") == 1, F.lit(str(i))) for i, c in enumerate(labels)))
    # All names are ours meanwhile.
    marked = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{key}`").alias("key"), combination.alias("__c"))
    counts = marked.groupBy("__c").agg(F.count("*").alias("n")).limit(MOST_COMBINATIONS + 1).collect()
    if len(counts) > MOST_COMBINATIONS:
        raise ValueError(f"more than {MOST_COMBINATIONS} combinations of {len(labels)} labels")
    read = lambda text: tuple(int(x) for x in text.split(",") if x)
    division = divide({read(r["__c"]): r.n for r in counts}, shares)
    # A row for each combination and part: the last place, among the combination's rows, that the part gets.
    ends = [(",".join(map(str, c)), [sum(got[: p + 1]) for p in range(len(got))]) for c, got in sorted(division.items())]
    table = df.sparkSession.createDataFrame(ends, "__c string, __ends array<long>")
    hashed = marked.withColumn("__h", hash_key("key", seed)).withColumn("__at", F.conv(F.substring("__h", 1, 12), 16, 10).cast("double"))
    ranked = places(hashed, [F.asc("__c"), F.asc("__at"), F.asc("__h"), F.asc("key")], ["__c"], "__at")
    # Places count over all combinations, in their order.
    before, starts = 0, {}
    for c, got in sorted(division.items(), key=lambda x: ",".join(map(str, x[0]))):
        starts[",".join(map(str, c))] = before
        before += sum(got)
    first = df.sparkSession.createDataFrame(sorted(starts.items()), "__c string, __before long")
    own = F.col("place") - F.col("__before")
    part = F.size(F.filter("__ends", lambda e: e < own))
    dealt = ranked.join(table, "__c").join(first, "__c").select("row", part.alias("part"))
    return dealt.select(*(F.col("row")[c].alias(c) for c in df.columns), "part")


def subsample(df: DataFrame, key: str, labels: list[str], n: int, seed: int = 56) -> DataFrame:
    """``n`` rows, or all if there are fewer, with the shares of the labels that the whole has."""
    total = df.count()
    if n >= total:
        return df
    return stratified(df, key, labels, [n, total - n], seed).where("part = 0").drop("part")
