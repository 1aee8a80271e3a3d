"""Label propagation: capacities hold, cut links only fall, and no move that a single document or text could make is left."""

import random
from collections import Counter, defaultdict
from itertools import product

import pytest

from wardloom.llm import sharding

rng = random.Random(5)


def cut_of(groups):
    """groups: for each text, the shard of each of its documents."""
    return sum(sum(a != b for i, a in enumerate(g) for b in g[i + 1 :]) for g in groups)


def state_of(spark, groups):
    rows = [(t.to_bytes(2, "big"), s, n) for t, g in enumerate(groups) for s, n in Counter(g).items()]
    return spark.createDataFrame(rows, "key binary, shard int, n long")


def groups_of(state):
    out = defaultdict(list)
    for r in state.collect():
        out[bytes(r.key)] += [r.shard] * r.n
    return list(out.values())


@pytest.mark.parametrize("sizes, room", [([2] * 12, 0), ([3, 3, 2, 5, 4, 2, 2, 7], 3), ([30, 2, 2, 3], 5), ([2, 2], 40)])
def test_no_better_move_is_left(spark, sizes, room):
    shards, n = 4, sum(sizes)
    order = [i % shards for i in range(n)]
    rng.shuffle(order)
    groups = [[order.pop() for _ in range(k)] for k in sizes]
    caps = [n // shards + (s < n % shards) + room for s in range(shards)]
    before = state_of(spark, groups)
    assert sharding.cut_links(before) == cut_of(groups)
    after = sharding.propagate(before, caps, 16)
    got = groups_of(after)
    loads = Counter(s for g in got for s in g)
    assert sorted(map(len, got)) == sorted(sizes) and all(loads[s] <= caps[s] for s in range(shards))
    assert sharding.cut_links(after) == cut_of(got) <= cut_of(groups)
    free = [caps[s] - loads[s] for s in range(shards)]
    for g in got:
        own = Counter(g)
        assert not any(free[t] and own[t] >= own[s] for s in own for t in range(shards) if t != s and own[t])
        assert len(own) == 1 or not any(free[t] >= len(g) - own[t] for t in range(shards))


def test_as_good_as_any(spark):
    """Small pairs and triples with some room: no placement within the capacities cuts fewer links."""
    groups, caps = [[0, 1], [1, 0], [0, 1, 1], [0, 1]], [6, 6]
    best = min(cut_of(p) for flat in product(range(2), repeat=9) if max(Counter(flat).values()) <= 6 for p in [[flat[0:2], flat[2:4], flat[4:7], flat[7:9]]])
    assert best == 0 == cut_of(groups_of(sharding.propagate(state_of(spark, groups), caps, 16)))


def test_null_is_no_text(spark):
    frame = spark.createDataFrame([(1, None, "s"), (2, "\0null\0", "s"), (3, "", "s"), (4, None, "s"), (None, None, "s"), (None, "x" * 200_000, "s")] + [(9, "one id", "s")] * 50, "doc_id long, text string, shard string")
    got = sharding.shard(frame, bucket_rows=3).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == 56 and max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 8
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert len({r.shard for r in got if r.doc_id in (1, 4) or (r.doc_id is None and r.size == 1)}) == 1
