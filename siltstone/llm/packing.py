"""Related-document packing along paths through a nearest-neighbour graph.

A text's vector is its tf-idf over words hashed to 65536 cells, the document
frequencies counted over all texts. The ``k`` nearest neighbours of each distinct
vector among all others are found exactly: vectors are spread over blocks of about
eight times ``region_docs`` and written in chunks of half as many as ``region_docs``; the chunks of
every two blocks meet in a task, which reads them pair by pair and never holds more
than two. That costs the square of the number of vectors, but no shuffle of them.
One task walks over the whole graph: it starts at the unvisited vector of the lowest degree and
moves on to the nearest unvisited neighbour until there is none, then the next one
starts. A vector's texts come in order of their ids. Windows of ``window``
characters are filled along the paths; a document that crosses a window's end goes
on in the next one, and the last window may be shorter. There is one region.
``placed``, which divides texts among regions, is not used by ``pack``.

Null and empty texts fill nothing and are left out; wordless texts share a
vector. Repeated rows are packed as often as they occur, next to each other.
Ties go to the lesser vector, null ids come last.
Very long texts are read and packed whole. An empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.lineage import materialise

from . import textvec
from .rows import ID, TEXT, small_batches

K, REGION_DOCS, WINDOW, FIT = 4, 4096, 8192, 16384
_CELLS, _FOLD, _DIMS, _MOST_CENTROIDS, _SUBS, _OFTEN, _SLICE, _CHUNKS, _LEAST, _AT_ONCE = 65536, 2048, 64, 4096, 16, 0.03, 200, 8, 1e-5, 1 << 16
# a row is megabytes; by default a page would take a hundred of them, and whoever reads one as much memory
_PAGES = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.block.size": 16 << 20}


def sparse(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, count) of the distinct word cells of each text, rows and cells ascending."""
    h, row, _, _ = textvec.words(texts)
    key, count = np.unique(row * _CELLS + (textvec.mix(h) & np.uint64(_CELLS - 1)).astype(np.int64), return_counts=True)
    return key // _CELLS, key % _CELLS, count


def _lists(kind: pa.DataType, row: np.ndarray, flat: np.ndarray, n: int) -> pa.Array:
    """A binary array of each row's numbers."""
    size = flat.dtype.itemsize
    at = np.searchsorted(row, np.arange(n + 1)).astype(np.int64) * size
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(flat.tobytes())]).cast(kind)


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of a binary array of numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks else pa.array([], pa.binary())
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    return np.repeat(np.arange(len(column)), np.diff(off) // size), data.view(kind)


def weights(row: np.ndarray, cell: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """The entries' tf-idf weights, those of each row of length one together."""
    w = np.minimum(count, 65504).astype(np.float64) * idf[cell]
    return w / np.sqrt(np.maximum(np.bincount(row, w * w, minlength=n), 1e-12))[row]


def _folded(row: np.ndarray, cell: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """n x 2048 vectors: cells are added up with a sign each."""
    sign = 1 - 2 * (textvec.mix(cell.astype(np.uint64) + np.uint64(5)) & np.uint64(1)).astype(np.float64)
    return np.bincount(row * _FOLD + cell % _FOLD, w * sign, minlength=n * _FOLD).reshape(n, _FOLD).astype(np.float32)


class Places:
    """Where vectors belong: principal directions, centroids and, in large cells, sample vectors."""

    def __init__(self, sample: np.ndarray, centroids: int) -> None:
        rng = np.random.default_rng(7)
        self.base = np.zeros((_FOLD, _DIMS), np.float32)
        self.centroids = np.zeros((1, self.base.shape[1]), np.float32)
        self.subs: dict[int, np.ndarray] = {}
        self.sample = np.zeros((0, self.base.shape[1]), np.float32)
        if centroids <= 1 or not len(sample):
            return
        q = rng.normal(size=(_FOLD, _DIMS + 16)).astype(np.float32)
        for _ in range(4):
            q = np.linalg.qr(sample.T @ (sample @ q))[0].astype(np.float32)
        _, _, v = np.linalg.svd(sample @ q, full_matrices=False)
        self.base = (q @ v.T[:, :_DIMS]).astype(np.float32)
        x = self.sample = self.project(sample)
        c = x[rng.permutation(len(x))[:centroids]]
        for _ in range(8):
            near = self._near(x, c)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            c = total[np.bincount(near, minlength=len(c)) > 0]
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        self.centroids = c

    @staticmethod
    def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0, np.int64)

    def project(self, folded: np.ndarray) -> np.ndarray:
        x = folded @ self.base
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def divide(self, held: np.ndarray, most: int) -> None:
        """Gives sample vectors to the cells that hold more texts than most."""
        if not len(self.sample):
            return
        near = self._near(self.sample, self.centroids)
        for c in np.flatnonzero(held[::_SUBS] > most).tolist():
            mine = np.unique(self.sample[near == c], axis=0)
            if len(mine) > 1:
                self.subs[c] = mine[np.random.default_rng(c).permutation(len(mine))[: min(_SUBS, -(-3 * int(held[c * _SUBS]) // (2 * most)))]]

    def of(self, row: np.ndarray, cell: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """The cell of each of n rows, numbered in steps of 16 with the divisions of cells in between."""
        if len(self.centroids) == 1 and not self.subs:
            return np.zeros(n, np.int64)
        x = self.project(_folded(row, cell, w, n))
        near = self._near(x, self.centroids)
        out = near * _SUBS
        for c in set(near.tolist()) & set(self.subs):
            at = np.flatnonzero(near == c)
            out[at] += (x[at] @ self.subs[c].T).argmax(1)
        return out


def walk(n: int, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> list[list[int]]:
    """Greedy paths over the undirected edges a-b of similarity s between n nodes."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    _, once = np.unique(lo * n + hi, return_index=True)
    lo, hi, s = lo[once], hi[once], s[once]
    x, y, z = np.concatenate([lo, hi]), np.concatenate([hi, lo]), np.concatenate([s, s])
    order = np.lexsort((y, -z, x))
    y = y[order].tolist()
    degree = np.bincount(x, minlength=n)
    at = np.concatenate([[0], np.cumsum(degree)]).tolist()
    left, paths = bytearray(b"\1" * n), []
    for start in np.argsort(degree, kind="stable").tolist():
        if not left[start]:
            continue
        path, here = [], start
        while here is not None:
            path.append(here)
            left[here] = 0
            here = next((t for t in y[at[here] : at[here + 1]] if left[t]), None)
        paths.append(path)
    return paths


def fill(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, start, stop) of the pieces of items laid end to end and cut into windows."""
    end = np.cumsum(lengths)
    begin = end - lengths
    first, last = begin // window, (end - 1) // window
    count = last - first + 1
    item = np.repeat(np.arange(len(lengths)), count)
    win = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[item]
    return win, item, np.maximum(win * window - begin[item], 0), np.minimum((win + 1) * window - begin[item], lengths[item])


def similarities(row: np.ndarray, cell: np.ndarray, w: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, cosines of some rows with all n), block by block."""
    return across(row, cell, w, n, row, cell, w, n)


def across(row: np.ndarray, cell: np.ndarray, w: np.ndarray, n: int, row2: np.ndarray, cell2: np.ndarray, w2: np.ndarray, n2: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, cosines of some of n rows with all n2 others), block by block: cells that are frequent on both sides by matrix products, the others pair by pair, so many at once that little is held."""
    many, many2 = (np.bincount(c, minlength=_CELLS) for c in (cell, cell2))
    dense = np.flatnonzero(many * many2 > _OFTEN * _OFTEN * n * n2)
    place = np.full(_CELLS, -1, np.int32)
    place[dense] = np.arange(len(dense))

    def divided(row: np.ndarray, cell: np.ndarray, w: np.ndarray, n: int, others: np.ndarray) -> tuple[np.ndarray, ...]:
        """The matrix of the frequent cells; row, cell, weight of the others that the other side has too."""
        at = place[cell]
        often, rest = at >= 0, (at < 0) & (others[cell] > 0)
        x = np.zeros((n, len(dense)), np.float32)
        x[row[often], at[often]] = w[often]
        return x, row[rest], cell[rest].astype(np.uint16), w[rest].astype(np.float32)

    x, r, c, v = divided(row, cell, w, n, many2)
    x2, r2, c2, v2 = divided(row2, cell2, w2, n2, many)
    order = np.argsort(c2, kind="stable")
    r2, v2 = r2[order], v2[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(c2, minlength=_CELLS))])
    begin, size = first[c], first[c.astype(np.int32) + 1] - first[c]
    end = np.concatenate([[0], np.cumsum(size)])
    at = np.searchsorted(r, np.arange(n + 1))
    step = max(1, min(512, (1 << 20) // max(n2, 1)))
    for i in range(0, n, step):
        j = min(i + step, n)
        s = x[i:j] @ x2.T
        low = at[i]
        while low < at[j]:
            high = min(max(int(np.searchsorted(end, end[low] + _AT_ONCE, side="right")) - 1, low + 1), at[j])
            times = size[low:high]
            to = np.arange(end[high] - end[low]) + np.repeat(begin[low:high] - end[low:high] + end[low], times)
            np.add.at(s.reshape(-1), np.repeat((r[low:high].astype(np.int64) - i) * n2, times) + r2[to], np.repeat(v[low:high], times) * v2[to])
            low = high
        yield i, s


def nearest(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k of the greatest s of each a; ties go to the lesser b."""
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    ok = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[ok], b[ok], s[ok]


def _best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the k greatest positive values of each row; ties go to the lesser column."""
    top = min(k, s.shape[1])
    least = -np.partition(-s, top - 1, axis=1)[:, top - 1]
    a, b = np.nonzero(s >= np.maximum(least, _LEAST)[:, None])
    return nearest(a, b, s[a, b], k)


def _joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))


def neighbours(row: np.ndarray, cell: np.ndarray, w: np.ndarray, n: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, similarity) of the up to k nearest rows b of each row a that have any cell in common; ties go to the lesser row."""
    out = []
    for i, s in similarities(row, cell, w, n):
        s = np.round(s, 5)
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -9
        a, b, v = _best(s, k)
        out.append((a + i, b, v))
    return _joined(out)


class Nearest:
    """The k nearest found so far of each of n rows, of others that are told apart by name; ties go to the lesser name."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.least = np.full(n, _LEAST, np.float32)
        self.held = _joined([])

    def see(self, s: np.ndarray, at: int, names: np.ndarray) -> None:
        """s: similarities of the rows from at on with the ascending names; what can't be among the nearest is passed over."""
        least = self.least[at : at + len(s)]
        if s.flags.c_contiguous:
            a, b = np.divmod(np.flatnonzero(s >= (least - _LEAST)[:, None]), s.shape[1])
        else:
            b, a = np.divmod(np.flatnonzero(s.T >= least - _LEAST), s.shape[0])
        if len(a) > 32 * self.k * len(s):
            a, b, v = _best(np.round(s, 5), self.k)
        else:
            v = np.round(s[a, b], 5)
            ok = v >= least[a]
            a, b, v = a[ok], b[ok], v[ok]
        if not len(a):
            return
        new = np.unique(a + at)
        old = np.isin(self.held[0], new)
        mine = tuple(x[old] for x in self.held)
        mine = nearest(*_joined([mine, (a + at, names[b], v)]), self.k)
        last = np.flatnonzero(np.r_[mine[0][1:] != mine[0][:-1], True])
        full = last[np.bincount(mine[0], minlength=self.n)[mine[0][last]] >= self.k]
        self.least[mine[0][full]] = mine[2][full]
        self.held = _joined([tuple(x[~old] for x in self.held), mine])


def meet(one: Nearest, row: np.ndarray, cell: np.ndarray, w: np.ndarray, names: np.ndarray, two: Nearest | None, row2: np.ndarray, cell2: np.ndarray, w2: np.ndarray, names2: np.ndarray) -> None:
    """Compares the rows of two chunks, or, where two is None, of one with each other."""
    if two is None:
        for i, s in similarities(row, cell, w, len(names)):
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -9
            one.see(s, i, names)
        return
    for i, s in across(row, cell, w, len(names), row2, cell2, w2, len(names2)):
        one.see(s, i, names2)
        two.see(s.T, 0, names[i : i + len(s)])


def vectors(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc_id, n, salt, cells, counts) of each text that is not empty."""
    kind = docs.schema[id_col].dataType
    rows = small_batches(docs).select(docs[id_col].alias("i"), docs[text_col].alias("t")).where("t <> ''").select("i", "t", F.xxhash64("i", "t").alias("salt"))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b = whole.slice(at, _SLICE)
                row, cell, count = sparse(b.column(1))
                lists = (_lists(pa.binary(), row, x, b.num_rows) for x in (cell.astype(np.uint16), np.minimum(count, 65504).astype(np.float16)))
                yield pa.RecordBatch.from_arrays([b.column(0), pc.utf8_length(b.column(1)).cast(pa.int64()), b.column(2), *lists], names=schema.names)

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("salt", T.LongType()), T.StructField("cells", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    return materialise(rows.mapInArrow(raw, schema), "word-cells")


def frequencies(vecs: DataFrame) -> tuple[int, np.ndarray]:
    """(number of texts, inverse document frequency of each cell)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(_CELLS, np.int64), 0
        for b in batches:
            total += np.bincount(_flat(b.column(0), np.uint16)[1], minlength=_CELLS)
            n += b.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], names=["cell", "n"])

    found = vecs.select("cells").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(_CELLS + 1)
    df[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy()
    n = int(df[-1])
    return n, np.where(df[:-1] > 0, np.log(max(n, 1) / np.maximum(df[:-1], 1)), 0.0)


def placed(vecs: DataFrame, n: int, idf: np.ndarray, region_docs: int = REGION_DOCS, fit: int = FIT) -> DataFrame:
    """vecs with their region."""
    wanted = min(-(-3 * n // (2 * region_docs)), _MOST_CENTROIDS) if n > region_docs else 1
    places = Places(np.zeros((0, _FOLD), np.float32), 1)
    if wanted > 1:

        def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One row with what Places learns from the sample, so that the folded sample is never in the driver."""
            few = pa.Table.from_batches(batches, pa.schema([("cells", pa.binary()), ("counts", pa.binary())]))
            row, cell = _flat(few["cells"], np.uint16)
            cell, count = cell.astype(np.int64), _flat(few["counts"], np.float16)[1].astype(np.float64)
            w = weights(row, cell, count, idf, few.num_rows)
            sample = np.zeros((few.num_rows, _FOLD), np.float32)
            for i in range(0, few.num_rows, 1024):
                a, b = np.searchsorted(row, [i, i + 1024])
                sample[i : i + 1024] = _folded(row[a:b] - i, cell[a:b], w[a:b], min(1024, few.num_rows - i))
            found = Places(sample, wanted)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (found.base, found.centroids, found.sample)], names=["base", "centroids", "sample"])

        few = vecs.where(F.pmod("salt", F.lit(1 << 40)) < int(min(1.0, fit / n) * (1 << 40))).select("cells", "counts").limit(2 * fit).repartition(1)
        got = few.mapInArrow(fitted, "base binary, centroids binary, sample binary").first()
        places.base, places.centroids, places.sample = (np.frombuffer(got[c], np.float32).reshape(-1, _DIMS) for c in ("base", "centroids", "sample"))

    def cells_of(b: pa.RecordBatch, cells: pa.Array, counts: pa.Array) -> np.ndarray:
        row, cell = _flat(cells, np.uint16)
        cell = cell.astype(np.int64)
        return places.of(row, cell, weights(row, cell, _flat(counts, np.float16)[1].astype(np.float64), idf, b.num_rows), b.num_rows)

    def held() -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    b = whole.slice(at, 1000)
                    yield pa.RecordBatch.from_arrays([pa.array(cells_of(b, *b.columns))], names=["c"])

        out = np.zeros(len(places.centroids) * _SUBS, np.int64)
        found = vecs.select("cells", "counts").mapInArrow(run, "c bigint").groupBy("c").count().toPandas()
        out[found["c"].to_numpy(np.int64)] = found["count"].to_numpy()
        return out

    parts = np.ones(_SUBS, np.int64)
    if wanted > 1:
        load = held()
        if load.max() > region_docs:
            places.divide(load, region_docs)
            load = held()
        parts = np.maximum(-(-load // region_docs), 1)
    base = np.cumsum(parts) - parts

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                c = cells_of(b, b.column(3), b.column(4))
                region = base[c] + (textvec.mix(b.column(2).to_numpy().view(np.uint64)) % parts[c].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region)], names=[*b.schema.names, "region"])

    return vecs.mapInArrow(home, T.StructType([*vecs.schema, T.StructField("region", T.LongType())]))


def edges(nodes: DataFrame, blocks: int, idf: np.ndarray, k: int = K, chunk: int = REGION_DOCS) -> DataFrame:
    """(a, b, s): the exact up to k nearest of all other nodes b of each node a; nodes has node, cells, counts.

    Nodes are written in chunks, in as many parts as there are blocks at most. Of every two parts the chunks are read
    pair by pair; the nearest found in each task are merged.
    """
    spark = nodes.sparkSession
    kind = "names binary, sizes binary, cells binary, counts binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            t = t.take(pc.sort_indices(t, sort_keys=[("node", "ascending")]))
            row, cell = _flat(t["cells"], np.uint16)
            flat = t["node"].to_numpy().astype(np.int64), np.bincount(row, minlength=len(t)), cell, _flat(t["counts"], np.float16)[1]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in flat], names=["names", "sizes", "cells", "counts"])

        for b in batches:
            while b.num_rows:
                part = b.slice(0, chunk - sum(x.num_rows for x in held))
                held.append(part)
                b = b.slice(part.num_rows)
                if sum(x.num_rows for x in held) == chunk:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    def read(names: bytes, sizes: bytes, cells: bytes, counts: bytes) -> tuple[np.ndarray, ...]:
        name, size = np.frombuffer(names, np.int64), np.frombuffer(sizes, np.int64)
        row, cell = np.repeat(np.arange(len(name), dtype=np.int32), size), np.frombuffer(cells, np.uint16).astype(np.int32)
        return row, cell, weights(row, cell, np.frombuffer(counts, np.float16).astype(np.float64), idf, len(name)).astype(np.float32), name

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[Nearest, np.ndarray]] = {}
        last, left = None, None
        for b in batches:
            for r in range(b.num_rows):
                i, j = b.column(0)[r].as_py(), b.column(5)[r].as_py()
                if i != last:
                    last, left = i, read(*(b.column(c)[r].as_py() for c in range(1, 5)))
                right = left if i == j else read(*(b.column(c)[r].as_py() for c in range(6, 10)))
                for x, side in ((i, left), (j, right)):
                    if x not in best:
                        best[x] = Nearest(len(side[3]), k), side[3].copy()
                meet(best[i][0], *left, None if i == j else best[j][0], *right)
        for found, names in best.values():
            a, b, v = found.held
            yield pa.RecordBatch.from_arrays([pa.array(names[a], pa.int64()), pa.array(b.astype(np.int64)), pa.array(v.astype(np.float32))], names=["a", "b", "s"])

    few = nodes.select("node", "cells", "counts").coalesce(blocks).mapInArrow(cut, kind).withColumn("chunk", F.monotonically_increasing_id())
    few = materialise(few.select("chunk", *(x.split()[0] for x in kind.split(", "))), "packing-chunks", **_PAGES)
    one, two = (few.select(*(F.col(c).alias(f"{c}{i}") for c in few.columns)) for i in (1, 2))
    # of every two parts' chunks each pair comes once, all in one of the two tasks in which they meet
    part1, part2 = (F.shiftright(F.col(f"chunk{i}"), 33) for i in (1, 2))
    turn = F.when(part1 == part2, F.col("chunk1") <= F.col("chunk2")).when((part1 + part2) % 2 == 0, part1 < part2).otherwise(part1 > part2)
    pairs = one.join(two.hint("shuffle_replicate_nl"), turn)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key, "10000")
    spark.conf.set(key, "1")  # a row is two chunks
    try:
        found = materialise(pairs.mapInArrow(compare, "a long, b long, s float"), "packing-found")
    finally:
        spark.conf.set(key, was)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return found.withColumn("r", rank).where(F.col("r") <= k).select("a", "b", "s")


def pack(docs: DataFrame, window: int = WINDOW, k: int = K, region_docs: int = REGION_DOCS, fit: int = FIT, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(region, window, doc_ids, starts, stops, chars): the documents of each window in order, and which characters of each. There is one region; fit is not used."""
    vecs = vectors(docs, id_col, text_col)
    n, idf = frequencies(vecs)
    blocks = max(-(-n // (_CHUNKS * region_docs)), 1)
    hashes = F.xxhash64("cells", "counts").alias("h1"), F.xxhash64(F.lit(7), "cells", "counts").alias("h2")

    def number(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("cells", "ascending"), ("counts", "ascending")]))
        return table.append_column("node", pa.array(np.arange(len(table))))

    distinct = vecs.select("cells", "counts").distinct().select("cells", "counts", *hashes).withColumn("block", F.pmod("h1", F.lit(blocks)).cast("int"))
    nodes = materialise(distinct.groupBy("block").applyInArrow(number, T.StructType([*distinct.schema, T.StructField("node", T.LongType())])), "packing-nodes")
    held = np.zeros(blocks, np.int64)
    for r in nodes.groupBy("block").count().collect():
        held[r["block"]] = r["count"]
    total, base = int(held.sum()), F.array(*[F.lit(int(x)) for x in np.cumsum(held) - held])
    nodes = nodes.withColumn("node", F.col("node") + F.get(base, "block"))
    rows = materialise(vecs.select("doc_id", "n", *hashes).join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("doc_id", "n", "node"), "packing-rows")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges, and each node's characters with a similarity of -1, in; where each node begins along the paths, out."""
        parts = [[c.to_numpy() for c in b.columns] for b in batches]
        if not parts:
            return
        a, b, s = (np.concatenate(x) for x in zip(*parts))
        size = np.zeros(total, np.int64)
        size[a[s < 0]] = b[s < 0]
        along = np.array([x for p in walk(total, a[s >= 0], b[s >= 0], s[s >= 0]) for x in p], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(along), pa.array(np.cumsum(size[along]) - size[along])], names=["node", "at"])

    sizes = rows.groupBy("node").agg(F.sum("n").alias("b")).select(F.col("node").alias("a"), "b", F.lit(-1.0).cast("float").alias("s"))
    graph = materialise(edges(nodes, blocks, idf, k, -(-region_docs // 2)), "packing-edges")
    starts = graph.unionAll(sizes).repartition(1).mapInArrow(order, "node long, at long")
    before = F.sum("n").over(Window.partitionBy("node").orderBy(F.asc_nulls_last("doc_id"), "n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    laid = rows.withColumn("before", before).join(starts, "node").select("doc_id", "n", (F.col("at") + F.col("before")).alias("at"))
    pieces = laid.select("*", F.explode(F.expr(f"sequence(at div {window}, (at + n - 1) div {window})")).alias("window"))
    pieces = pieces.select("window", F.struct("at", F.greatest(F.col("window") * window - F.col("at"), F.lit(0)).alias("start"), F.least((F.col("window") + 1) * window - F.col("at"), "n").alias("stop"), "doc_id").alias("p"))
    out = pieces.groupBy("window").agg(F.sort_array(F.collect_list("p")).alias("p"), F.sum(F.col("p.stop") - F.col("p.start")).alias("chars"))
    return out.select(F.lit(0).cast("long").alias("region"), "window", F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.stop").alias("stops"), "chars")
