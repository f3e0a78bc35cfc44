"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints have 64 search bits and 128 check bits, from the set of a text's
words. Two documents are near duplicates when their search bits
differ in at most ``tau`` places and their check bits in at most
``check_tau``. The search bits are put into partitions of correlated bits; if
the partitions' thresholds add up to tau - partitions + 1, any two
fingerprints within tau are within the threshold of some partition. Dynamic
programming picks the thresholds with the fewest estimated candidates from
the histograms of all partition values, then each row probes, and every
candidate is verified.

A row visits the blocks, named by a partition's leading bits, that may hold its
candidates. Blocks hold about 60000 fingerprints, so that the number of leading
bits, 3 at least and 16 at most, grows with the corpus and visits with it: 14 a
row at 0.5 GB, about 62 at 30 GB, some 216 where all 16 bits lead.

Null and wordless texts have no fingerprint and are in no group. Very long texts
count with all their words. Repeated rows are copies of each other. Of equal
distances none is preferred, as all within the thresholds are joined. An empty
table gives an empty result. Other columns are ignored, whatever their names.
Rows are told apart by the whole fingerprint of 192 bits; only the connection of
groups uses a hash of it of 64 bits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.components import connected_components, forest
from siltstone.operators.lineage import materialise

from . import textvec
from .rows import ID, TEXT, keep_rows, row_key, small_batches

TAU, CHECK_TAU, PARTITIONS, WIDTH = 10, 26, 4, 16
_SLICE = 200
_LANE = np.array([[(v >> k) & 1 for k in range(4)] for v in range(16)], dtype=np.uint64)
_SPREAD = (_LANE << (np.arange(4, dtype=np.uint64) * np.uint64(16))).sum(1, dtype=np.uint64)
_LOW = np.uint64(0xFFFF)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct words of each text, rows ascending."""
    h, row, _, _ = textvec.words(texts)
    key = np.unique((row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    return key & np.uint64((1 << 44) - 1), (key >> np.uint64(44)).astype(np.int64)


def _majority(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit fingerprint for each of n rows: bit k is set when most features have it set."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    total = np.bincount(row, minlength=n)
    cuts = np.unique(np.concatenate([starts, np.arange(0, len(h), 60000)]))  # lanes hold 65535 at most
    owner = row[cuts]
    out = np.zeros(n, dtype=np.uint64)
    for nibble in range(16):
        lanes = np.add.reduceat(_SPREAD[((h >> np.uint64(4 * nibble)) & np.uint64(15)).astype(np.int64)], cuts)
        for k in range(4):
            ones = np.bincount(owner, ((lanes >> np.uint64(16 * k)) & _LOW).astype(np.float64), minlength=n)
            out |= (2 * ones > total).astype(np.uint64) << np.uint64(4 * nibble + k)
    return out


def fingerprint(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n x 3 uint64 fingerprints, whether each text has one)."""
    n = len(texts)
    out, has = np.zeros((n, 3), dtype=np.uint64), np.zeros(n, dtype=bool)
    h, row = features(texts)
    if len(h):
        has[row] = True
        for j in range(3):
            out[:, j] = _majority(textvec.mix(h + np.uint64(1000003 * (j + 1))), row, n)
    return out, has


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            batch = whole.slice(at, _SLICE)
            fp, has = fingerprint(batch.column(2))
            keep = pa.array(has)
            cols = [batch.column(0).filter(keep), batch.column(1).filter(keep), *(pa.array(fp[has, j].view(np.int64)) for j in range(3))]
            yield pa.RecordBatch.from_arrays(cols, names=["rk_id", "rk_hash", "fp", "c1", "c2"])


def fingerprints(docs: DataFrame, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(rk_id, rk_hash, fp, c1, c2) of each row whose text has a word."""
    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(*row_key(docs, id_col, text_col), docs[text_col].alias("t")).mapInArrow(_fingerprints, f"rk_id {kind}, rk_hash bigint, fp bigint, c1 bigint, c2 bigint")


def bits(fp: np.ndarray) -> np.ndarray:
    """n x 64 array of 0 and 1, least significant bit first."""
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(nodes: DataFrame) -> np.ndarray:
    """64 x 64 absolute correlations of the search bits over all fingerprints."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 65))
        for b in batches:
            x = np.hstack([bits(b.column(0).to_numpy()).astype(np.float32), np.ones((b.num_rows, 1), np.float32)])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["m"])

    parts = nodes.select("fp").mapInArrow(moments, "m array<double>").select(F.posexplode("m").alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x")).toPandas()
    m = np.zeros(65 * 65)
    m[parts["p"].to_numpy()] = parts["x"].to_numpy()
    m = m.reshape(65, 65)
    n = max(m[64, 64], 1)
    mean = m[64, :64] / n
    cov = m[:64, :64] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return np.abs(cov / np.outer(sd, sd))


def group_bits(corr: np.ndarray, partitions: int = PARTITIONS) -> list[list[int]]:
    """Equal partitions of the 64 bits, each grown greedily from its most correlated bits."""
    left, out, width = list(range(len(corr))), [], len(corr) // partitions
    for _ in range(partitions):
        rest = corr[np.ix_(left, left)]
        group = [left[int(np.argmax(rest.sum(1)))]]
        while len(group) < width:
            others = [b for b in left if b not in group]
            group.append(others[int(np.argmax(corr[np.ix_(others, group)].sum(1)))])
        out.append(sorted(group))
        left = [b for b in left if b not in group]
    return out


def values(fp: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a partition as one number."""
    out = np.zeros(len(fp), dtype=np.int64)
    for k, b in enumerate(group):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def candidate_counts(hist: np.ndarray, most: int) -> np.ndarray:
    """Candidate pairs at thresholds -1, 0, ..., most, from the histogram of a partition's values."""
    width = int(np.log2(len(hist)))
    shells = [hist.astype(np.float64)] + [np.zeros(len(hist)) for _ in range(most)]
    at = np.arange(len(hist))
    for bit in range(width):
        shells = [shells[0]] + [shells[r] + shells[r - 1][at ^ (1 << bit)] for r in range(1, most + 1)]
    within = np.cumsum([float((hist * s).sum()) for s in shells])
    return np.concatenate([[0.0], within])


def allocate(counts: list[np.ndarray], tau: int) -> list[int]:
    """Thresholds, one a partition and each -1 at least, adding up to tau - partitions + 1 with the least sum of counts."""
    m = len(counts)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in counts:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, len(c) - 1):
                k = used + t + 1  # thresholds counted from -1
                if k <= tau + 1 and (k not in new or cost + c[t + 1] < new[k][0]):
                    new[k] = (cost + c[t + 1], [*chosen, t])
        best = new
    return best[min(tau + 1, max(best))][1] if tau + 1 in best else [len(c) - 2 for c in counts][:m]


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of width bits with at most radius of them set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(width), r)], dtype=np.int64)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def near_edges(nodes: DataFrame, n: int, tau: int = TAU, check_tau: int = CHECK_TAU) -> DataFrame:
    """(a, b) edges with the components of the near-duplicate relation over nodes (node, fp, c1, c2)."""
    groups = group_bits(correlations(nodes))

    def to_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            v = [values(fp, g) for g in groups]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(PARTITIONS), len(fp)).astype(np.int32)), pa.array(np.concatenate(v).astype(np.int32))], names=["p", "v"])

    hist = np.zeros((PARTITIONS, 1 << WIDTH))
    found = nodes.select("fp").mapInArrow(to_values, "p int, v int").groupBy("p", "v").count().toPandas()
    hist[found["p"], found["v"]] = found["count"]
    limits = allocate([candidate_counts(h, min(tau, WIDTH)) for h in hist], tau)
    top = int(np.clip(np.ceil(np.log2(max(n, 1) / 60000)), 3, WIDTH))  # leading bits that name a block
    low = WIDTH - top

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(1).to_numpy().view(np.uint64)
            for i, g in enumerate(groups):
                if limits[i] < 0:
                    continue
                v = values(fp, g) >> low
                for mask in ball(top, min(limits[i], top)):
                    # of two blocks that are close, only the rows of the lesser one visit the other
                    go = np.flatnonzero((v ^ mask) >= v)
                    block = ((v ^ mask)[go] * PARTITIONS + i).astype(np.int32)
                    sent = b.take(pa.array(go))
                    yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.full(len(go), bin(mask).count("1"), np.int32)), *sent.columns], names=["block", "far", "node", "fp", "c1", "c2"])

    def verify(table: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        i = table["block"][0].as_py() % PARTITIONS
        col = {c: table[c].to_numpy() for c in ("far", "node", "fp", "c1", "c2")}
        fp, c1, c2 = (col[c].view(np.uint64) for c in ("fp", "c1", "c2"))
        all_v = [values(fp, g) for g in groups]
        v = all_v[i] & ((1 << low) - 1)
        native = np.flatnonzero(col["far"] == 0)
        if not len(native):
            return none
        native = native[np.argsort(v[native], kind="stable")]
        first = np.searchsorted(v[native], np.arange((1 << low) + 1))
        ea, eb = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for far in range(limits[i] + 1):
            q = np.flatnonzero(col["far"] == far)
            if not len(q):
                continue
            for mask in ball(low, min(limits[i] - far, low)):
                aim = v[q] ^ mask
                begin, count = first[aim], first[aim + 1] - first[aim]
                sums = np.cumsum(count)
                at = 0
                while at < len(q):  # as many queries as give half a million candidates
                    to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + 500_000, side="right")))
                    c = count[at:to]
                    qq = np.repeat(q[at:to], c)
                    xx = native[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[at:to], c)]
                    if not far:
                        ok = col["node"][qq] < col["node"][xx]
                        qq, xx = qq[ok], xx[ok]
                    ok = _popcount(fp[qq] ^ fp[xx]) <= tau
                    qq, xx = qq[ok], xx[ok]
                    ok = (_popcount(c1[qq] ^ c1[xx]).astype(np.int64) + _popcount(c2[qq] ^ c2[xx])) <= check_tau
                    qq, xx = qq[ok], xx[ok]
                    if len(qq):
                        held.append((col["node"][qq], col["node"][xx]))
                        if sum(len(h[0]) for h in held) > 1_000_000:
                            ea, eb = forest(np.concatenate([ea, *(h[0] for h in held)]), np.concatenate([eb, *(h[1] for h in held)]))
                            held = []
                    at = to
        if held:
            ea, eb = forest(np.concatenate([ea, *(h[0] for h in held)]), np.concatenate([eb, *(h[1] for h in held)]))
        return pa.table({"a": pa.array(ea, pa.int64()), "b": pa.array(eb, pa.int64())})

    spread = nodes.select("node", "fp", "c1", "c2").mapInArrow(probes, "block int, far int, node bigint, fp bigint, c1 bigint, c2 bigint")
    return spread.groupBy("block").applyInArrow(verify, "a bigint, b bigint")


def _grouped(docs: DataFrame, tau: int, check_tau: int, id_col: str, text_col: str) -> DataFrame:
    """(fp, c1, c2, rk_id, rk_hash, component, keep_id, copies) of the fingerprinted rows."""
    fps = materialise(fingerprints(docs, id_col, text_col).withColumn("node", F.xxhash64("fp", "c1", "c2")), "fingerprints")
    nodes = materialise(fps.groupBy("fp", "c1", "c2", "node").agg(F.min("rk_id").alias("low"), F.count("*").alias("rows")), "nodes")
    comp = connected_components(near_edges(nodes, nodes.count(), tau, check_tau), "a", "b")
    named = nodes.join(comp, "node", "left").select("fp", "c1", "c2", "node", F.coalesce("component", "node").alias("component"), "low", "rows")
    groups = named.groupBy("component").agg(F.min("low").alias("keep_id"), F.sum("rows").alias("copies")).where("copies > 1")
    member = named.join(groups, "component").select("fp", "c1", "c2", "component", "keep_id", "copies")
    return fps.select("rk_id", "rk_hash", "fp", "c1", "c2").join(member, ["fp", "c1", "c2"])


def near_duplicates(docs: DataFrame, tau: int = TAU, check_tau: int = CHECK_TAU, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc_id, keep_id, copies) of each row in a near-duplicate group of two rows or more.

    keep_id is the least id of the group, copies its number of rows. Rows
    without an id belong to groups too, but are never the one that is kept
    unless no row of the group has an id; then keep_id is null.
    """
    return _grouped(docs, tau, check_tau, id_col, text_col).select(F.col("rk_id").alias("doc_id"), "keep_id", "copies")


def drop_near_duplicates(docs: DataFrame, tau: int = TAU, check_tau: int = CHECK_TAU, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """docs with one row left of each near-duplicate group: a row with the least id, of several the one with the least text hash."""
    g = materialise(_grouped(docs, tau, check_tau, id_col, text_col), "groups").withColumn("own", F.col("rk_id").eqNullSafe(F.col("keep_id")))
    best = g.where("own").groupBy("component").agg(F.min("rk_hash").alias("best"))
    g = g.join(best, "component", "left")
    g = g.withColumn("stays", F.col("own") & (F.col("rk_hash") == F.col("best")))
    once = g.where("stays").groupBy("rk_id", "rk_hash").count().where("count > 1").select("rk_id", "rk_hash")
    return keep_rows(docs, g.where("NOT stays").select("rk_id", "rk_hash").distinct(), once, id_col, text_col)
