import os
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from siltstone.llm import packing, textvec

from .conftest import sentence


def brute_order(ids, texts, k):
    """The documents along the paths, one region, by exhaustive search over word vectors."""
    keep = [i for i, t in enumerate(texts) if t]
    row, cell, count = packing.sparse(pa.array([texts[i] for i in keep]))
    n = len(keep)
    x = np.zeros((n, 65536))
    x[row, cell] = count
    names = [(cell[row == i].astype(np.uint16).tobytes(), count[row == i].astype(np.float16).tobytes()) for i in range(n)]
    x *= np.log(n / np.maximum((x > 0).sum(0), 1))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    nodes = sorted(set(names))
    u = x[[names.index(v) for v in nodes]]
    s = np.round(u @ u.T, 5)
    links = {}
    for a in range(len(nodes)):
        for b in [b for b in sorted(range(len(nodes)), key=lambda b: (-s[a, b], b)) if b != a and s[a, b] > 0][:k]:
            links[min(a, b), max(a, b)] = s[a, b]
    near = {a: [] for a in range(len(nodes))}
    for (a, b), w in links.items():
        near[a].append((-w, b))
        near[b].append((-w, a))
    left, order = set(near), []
    for a in sorted(near, key=lambda a: (len(near[a]), a)):
        while a in left:
            left.discard(a)
            order.append(a)
            a = next((b for _, b in sorted(near[a]) if b in left), a)
    return [i for a in order for i in sorted(ids[keep[j]] for j in range(n) if names[j] == nodes[a])]


def test_windows_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [sentence(rng, rng.randrange(1, 60)) for _ in range(80)] + ["", None]
    texts += texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(docs, window=300).orderBy("region", "window").collect()
    assert {r.region for r in rows} == {0} and all(r.chars == 300 for r in rows[:-1])
    pieces = [(d, a, b) for r in rows for d, a, b in zip(r.doc_ids, r.starts, r.stops)]
    order = []
    for d, a, b in pieces:
        if a == 0:
            order.append(d)
        assert b > a
    assert order == brute_order(list(range(len(texts))), texts, packing.K)
    for d in set(order):  # each text comes whole and in order
        mine = [(a, b) for i, a, b in pieces if i == d]
        assert mine[0][0] == 0 and mine[-1][1] == len(texts[d]) and all(x[1] == y[0] for x, y in zip(mine, mine[1:]))


DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the supplied tables")
def test_neighbours_are_those_of_tf_idf():
    """Against exact tf-idf over whole words: recall of the four nearest, and neighbours in the same language."""
    t = pq.read_table(DATA)
    texts, lang = t["text"].combine_chunks(), np.array(t["lang"].to_pylist())
    n = len(texts)
    h, row, _, _ = textvec.words(texts)
    u, name = np.unique(h, return_inverse=True)
    key, count = np.unique(row * len(u) + name, return_counts=True)
    x = np.zeros((n, len(u)), np.float32)
    x[key // len(u), key % len(u)] = count * np.log(n / np.bincount(key % len(u)))[key % len(u)]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    true = np.argsort(-s, axis=1, kind="stable")[:, :4]
    row, cell, count = packing.sparse(texts)
    idf = np.log(n / np.maximum(np.bincount(cell, minlength=65536), 1))
    a, b, _ = packing.neighbours(row, cell, packing.weights(row, cell, count, idf, n), n)
    found = set(zip(a.tolist(), b.tolist()))
    assert np.mean([(i, int(j)) in found for i in range(n) for j in true[i]]) >= 0.9
    assert np.mean(lang[a] == lang[b]) >= 0.95


def test_cosines_equal_brute_force():
    rng = random.Random(2)
    texts = pa.array([" ".join(rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(rng.randrange(0, 60))) for _ in range(300)])
    row, cell, count = packing.sparse(texts)
    w = packing.weights(row, cell, count, np.random.default_rng(1).random(65536), 300)
    x = np.zeros((300, 65536))
    x[row, cell] = w
    assert np.abs(np.concatenate([s for _, s in packing.similarities(row, cell, w, 300)]) - x @ x.T).max() < 1e-5


def test_several_regions(spark):
    """Families stay together, no region holds much more than it should, copies beyond that are divided, and nothing is lost."""
    rng = random.Random(11)
    texts = [" ".join(f"fam{i % 40}w{rng.randrange(60)}" for _ in range(40)) for i in range(2000)] + ["one hot text"] * 1000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vecs = packing.vectors(docs)
    n, idf = packing.frequencies(vecs)
    rows = packing.placed(vecs, n, idf, 300, 800).select("doc_id", "region").collect()
    size = Counter(r.region for r in rows)
    assert len(rows) == 3000 and max(size.values()) <= 420 and len(size) > 8
    home = Counter((r.doc_id % 40, r.region) for r in rows if r.doc_id < 2000)
    assert sum(max(v for (f, _), v in home.items() if f == g) for g in range(40)) > 1400
    pieces = [(d, b - a) for r in packing.pack(docs, region_docs=300, fit=800).collect() for d, a, b in zip(r.doc_ids, r.starts, r.stops)]
    got = Counter()
    for d, c in pieces:
        got[d] += c
    assert got == Counter({i: len(t) for i, t in enumerate(texts)})


def test_odd_rows(odd, none):
    rows = packing.pack(odd).collect()
    ids = [d for r in rows for d, a in zip(r.doc_ids, r.starts) if a == 0]
    assert sorted(str(d) for d in ids) == sorted(str(r.doc_id) for r in odd.where("text <> ''").collect())
    assert packing.pack(none).count() == 0


def test_sample_is_not_folded_in_the_driver(spark, monkeypatch):
    """The index is fitted in a task; the driver gets what Places learnt only."""
    rng = random.Random(15)
    docs = spark.createDataFrame([(i, sentence(rng, 20)) for i in range(500)], "doc_id long, text string")
    vecs = packing.vectors(docs)
    n, idf = packing.frequencies(vecs)
    seen, init = [], packing.Places.__init__
    monkeypatch.setattr(packing.Places, "__init__", lambda self, sample, centroids: (seen.append(len(sample)), init(self, sample, centroids))[1])
    assert packing.placed(vecs, n, idf, 100, 300).select("region").distinct().count() > 1
    assert seen == [0]


def test_neighbours_across_blocks_equal_brute_force(spark):
    """However many blocks and chunks there are, each vector's neighbours are those among all vectors, and windows follow the whole graph."""
    rng = random.Random(16)
    texts = [sentence(rng, rng.randrange(5, 40)) for _ in range(250)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(docs, window=300, region_docs=10).orderBy("region", "window").collect()
    order = [d for r in rows for d, a in zip(r.doc_ids, r.starts) if a == 0]
    assert sorted(order) == list(range(250)) and {r.region for r in rows} == {0}
    row, cell, count = packing.sparse(pa.array(texts))
    idf = np.log(250 / np.maximum(np.bincount(cell, minlength=65536), 1))
    x = np.zeros((250, 65536))
    x[row, cell] = packing.weights(row, cell, count, idf, 250)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    vecs = packing.vectors(docs)
    n, idf = packing.frequencies(vecs)
    nodes = vecs.selectExpr("cast(doc_id % 4 as int) as block", "doc_id as node", "cells", "counts")
    got = {}
    for r in packing.edges(nodes, 4, idf, 4, 10).collect():
        got.setdefault(r.a, []).append(r.s)
    for i in range(250):
        assert np.allclose(sorted(got[i]), np.sort(s[i])[-4:], atol=1e-4)


def test_tasks_hold_two_chunks(spark, monkeypatch):
    """Vectors are compared chunk by chunk without a shuffle of them, and however they are cut the neighbours are the same."""
    rng = random.Random(17)
    texts = [sentence(rng, rng.randrange(5, 40)) for _ in range(120)]
    vecs = packing.vectors(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    _, idf = packing.frequencies(vecs)
    nodes = vecs.selectExpr("cast(doc_id % 3 as int) as block", "doc_id as node", "cells", "counts")
    seen, write = {}, packing.materialise
    monkeypatch.setattr(packing, "materialise", lambda df, name, **how: seen.setdefault(name, (df._jdf.queryExecution().executedPlan().toString(), write(df, name, **how)))[1])
    few = sorted(packing.edges(nodes, 3, idf, 4, 7).collect())
    sizes = [len(r.names) // 8 for r in seen["packing-chunks"][1].collect()]
    assert sum(sizes) == 120 and max(sizes) == 7
    assert "Exchange" not in seen["packing-found"][0]
    seen.clear()
    many = sorted(packing.edges(nodes, 1, idf, 4, 500).collect())
    assert [(r.a, r.b) for r in few] == [(r.a, r.b) for r in many]
    row, cell, count = packing.sparse(pa.array(texts))
    x = np.zeros((120, 65536))
    x[row, cell] = packing.weights(row, cell, count, idf, 120)
    s = np.round(x @ x.T, 5)
    np.fill_diagonal(s, 0)
    assert len(few) == np.minimum((s > 0).sum(1), 4).sum()


def test_cells_of_one_side_are_no_columns():
    """What is frequent in one chunk only takes no matrix, and few products are held at once; cosines and neighbours are those of brute force."""
    rng = np.random.default_rng(19)

    def chunk(low, n):
        cells = [np.r_[np.arange(40), low + np.flatnonzero(rng.random(4000) < 0.05)] for _ in range(n)]
        row = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in cells])
        cell = np.concatenate(cells).astype(np.int32)
        return row, cell, packing.weights(row, cell, rng.integers(1, 5, len(cell)), rng.random(65536) + 0.1, n).astype(np.float32), n

    one, two, three = chunk(100, 700), chunk(10000, 600), chunk(100, 600)
    for other in (two, three):
        full = [np.zeros((n, 65536), np.float32) for *_, n in (one, other)]
        for x, (row, cell, w, _) in zip(full, (one, other)):
            x[row, cell] = w
        true = full[0] @ full[1].T
        assert np.abs(np.concatenate([s for _, s in packing.across(*one, *other)]) - true).max() < 1e-5
        left, right = packing.Nearest(700, 4), packing.Nearest(600, 4)
        tracemalloc.start()
        packing.meet(left, *one[:3], np.arange(700), right, *other[:3], np.arange(1000, 1600))
        most = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert most < (24 if other is two else 34), most
        for found, s in ((left, true), (right, true.T)):
            a, _, v = found.held
            assert np.allclose(v[np.lexsort((v, a))].reshape(-1, 4), np.sort(s)[:, -4:], atol=2e-5)
