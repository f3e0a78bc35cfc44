import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from siltstone.llm import radixdup


def test_groups_equal_brute_force():
    rng = random.Random(1)
    base = ["", "a", "ab", "abcdefgh", "abcdefghi", "x" * 63, "x" * 64, "x" * 65, "y" * 5000, "y" * 4999 + "z", "é" * 40, "abcdefgh\0"]
    texts = [rng.choice(base + [None]) for _ in range(400)]
    first: dict[str, int] = {}
    want = [i if t is None else first.setdefault(t, i) for i, t in enumerate(texts)]
    assert radixdup.equal_groups(pa.array(texts)).tolist() == want
    assert radixdup.equal_groups(pa.array([], pa.string())).tolist() == []


def test_duplicates_equal_brute_force_for_all_range_sizes(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["the ", "then ", "other "]) * rng.randrange(4) + str(rng.randrange(30))) for i in range(300)]
    by = defaultdict(list)
    for i, t in rows:
        by[t].append(i)
    want = sorted((i, min(g), len(g)) for g in by.values() if len(g) > 1 for i in g)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (64, 1000, radixdup.RANGE_BYTES):
        assert sorted(map(tuple, radixdup.exact_duplicates(docs, range_bytes=size).collect())) == want
    kept = radixdup.drop_exact_duplicates(docs, range_bytes=200).collect()
    assert sorted(map(tuple, kept)) == sorted((min(g), t) for t, g in by.items())


def test_cuts_split_shared_prefixes(spark):
    docs = spark.createDataFrame([("licence " * 20 + str(i),) for i in range(50)], "t string")
    cuts, parts = radixdup.split_points(docs, 2000)
    assert len(cuts) > 2 and cuts == sorted(cuts) and len(parts) == len(cuts) + 1 and parts.max() <= 2


def test_more_parts_than_ranges(spark, monkeypatch):
    """With few ranges allowed, texts are dealt into parts, and copies still meet."""
    monkeypatch.setattr(radixdup, "MOST_RANGES", 3)
    rows = [(i, f"text number {i % 100} " * 10) for i in range(250)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cuts, parts = radixdup.split_points(docs.selectExpr("text AS t"), 1000)
    assert len(parts) <= 8 and parts.sum() > 20
    got = radixdup.exact_duplicates(docs, range_bytes=1000).collect()
    assert sorted(map(tuple, got)) == sorted((i, i % 100, 3 if i % 100 < 50 else 2) for i in range(250))
    assert radixdup.drop_exact_duplicates(docs, range_bytes=1000).count() == 101


def test_odd_rows(odd, none):
    got = {(r.doc_id, r.keep_id, r.copies) for r in radixdup.exact_duplicates(odd).collect()}
    assert got == {(1, 1, 4), (2, 1, 4), (None, 1, 4), (4, 4, 2), (5, 4, 2), (7, 7, 2), (8, 7, 2)}
    kept = radixdup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept.collect()) == [-1, 1, 3, 4, 6, 6, 7, 9]
    assert radixdup.exact_duplicates(none).count() == 0 and radixdup.drop_exact_duplicates(none).count() == 0


def test_least_id_puts_nulls_last():
    t = pa.table({"i": pa.array([None, 5, 3, None], pa.int64())})
    assert radixdup._least(t, np.array([0, 0, 0, 3]), 0).tolist() == [False, False, True, True]
