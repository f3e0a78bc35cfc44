import itertools
import random

import numpy as np
import pyarrow as pa

from siltstone.llm import simhash

from .conftest import sentence


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "new" + str(rng.randrange(1000))
    return " ".join(words)


def components(n, edges):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in edges:
        label[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def test_groups_equal_brute_force(spark):
    rng = random.Random(11)
    base = [sentence(rng, rng.randrange(60, 200)) for _ in range(60)]
    texts = base + [edited(rng, t, 2) for t in base[:25]] + [edited(rng, base[0], 1) for _ in range(15)] + base[30:35]
    fp, has = simhash.fingerprint(pa.array(texts))
    assert has.all()
    edges = []
    for a, b in itertools.combinations(range(len(texts)), 2):
        d = np.bitwise_count(fp[a] ^ fp[b]).astype(int)
        if d[0] <= simhash.TAU and d[1] + d[2] <= simhash.CHECK_TAU:
            edges.append((a, b))
    name = components(len(texts), edges)
    want = {(i, name[i], name.count(name[i])) for i in range(len(texts)) if name.count(name[i]) > 1}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(r) for r in simhash.near_duplicates(docs).collect()} == want
    assert sum(name[60 + i] == name[i] for i in range(25)) >= 23
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted(set(name))


def test_thresholds_cover_every_pair_and_cost_least():
    rng = np.random.default_rng(1)
    counts = [np.cumsum(rng.integers(1, 50, 8)).astype(float) for _ in range(4)]
    got = simhash.allocate(counts, 6)
    assert sum(got) == 6 - 4 + 1 and min(got) >= -1
    cost = lambda ts: sum(c[t + 1] for c, t in zip(counts, ts))
    assert cost(got) == min(cost(t) for t in itertools.product(range(-1, 7), repeat=4) if sum(t) == 3)


def test_candidate_counts_are_exact():
    values = np.random.default_rng(2).integers(0, 16, 40)
    hist = np.bincount(values, minlength=16)
    for t, n in enumerate(simhash.candidate_counts(hist, 3)[1:]):
        assert n == sum(bin(int(a ^ b)).count("1") <= t for a in values for b in values)


def test_odd_rows(odd, none):
    got = {(r.doc_id, r.keep_id, r.copies) for r in simhash.near_duplicates(odd).collect()}
    assert got == {(1, 1, 4), (2, 1, 4), (None, 1, 4), (7, 7, 2), (8, 7, 2)}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 6, 7, 9]
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_groups_of_one_least_id_keep_a_row_each(spark):
    rng = random.Random(13)
    a, b, c, d = (sentence(rng, 80) for _ in range(4))
    docs = spark.createDataFrame([(1, a), (2, a), (1, b), (3, b), (None, c), (None, c), (None, d), (None, d)], "doc_id long, text string")
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", a), ("1", b), ("None", c), ("None", d)])
