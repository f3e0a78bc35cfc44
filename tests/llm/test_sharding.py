import heapq
import random

import numpy as np

from siltstone.llm import sharding


def brute(sizes, shards):
    heap, out = [(0, j) for j in range(shards)], []
    for s in sizes:
        load, j = heap[0]
        heapq.heapreplace(heap, (load + s, j))
        out.append(j)
    return out


def test_schedule_equals_one_group_at_a_time():
    rng = random.Random(3)
    for _ in range(300):
        shards = rng.randrange(1, 9)
        sizes = sorted((rng.choice([0, 1, 2, 3, 7, 50, 400]) for _ in range(rng.randrange(80))), reverse=True)
        values, counts = np.unique(sizes, return_counts=True) if sizes else (np.zeros(0, int), np.zeros(0, int))
        got = []
        for size, a, b, cycle in sharding.schedule(values[::-1], counts[::-1], shards):
            got += [cycle[k % len(cycle)] for k in range(b - a)]
        assert got == brute(sizes, shards)


def test_groups_stay_together(spark):
    docs = spark.createDataFrame([(i, f"s{i % 5}", "x" * (i % 7)) for i in range(60)], "doc_id long, source string, text string")
    got = sharding.shard(docs, ["source"], shards=3).collect()
    assert len(got) == 60 and all(len({r.shard for r in got if r.group_id == g}) == 1 for g in {r.group_id for r in got})
    total = {s: sum(i % 7 for i in range(60) if f"s{i % 5}" == s) for s in {f"s{k}" for k in range(5)}}
    order = sorted(total, key=lambda s: (-total[s], int(s[1:])))
    want = dict(zip(order, brute([total[s] for s in order], 3)))
    assert {f"s{r.group_id}": r.shard for r in got} == want


def test_odd_rows(odd, none):
    got = sharding.shard(odd, shards=4).collect()
    assert len(got) == odd.count() and {r.shard for r in got} <= {0, 1, 2, 3}
    assert len({r.shard for r in got if r.doc_id in (1, 2)}) == 1
    assert sharding.shard(none).count() == 0
