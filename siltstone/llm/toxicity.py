"""Toxicity by compression distance.

zstandard's trainer makes a dictionary of ordinary text, and one of what toxic
texts hold and ordinary ones don't: fragments made of byte grams that are
``LEAST_RATIO`` times as frequent in toxic texts. Each follows the same base
trained on ordinary text, so that two compressors differ in nothing else: one
knows base and ordinary padding, the other base and toxic fragments at the same
distances. Texts are cut into windows of ``WORDS`` words. A window's distance is
its compressed length without the toxic fragments less that with them; it is
written twice, as the format stores short inputs that gain little as they are.

Distances are calibrated on texts that the dictionaries have not seen: each
distance weighs the logarithm of its frequency in toxic texts over that in
ordinary ones, and a text is toxic when its distinct windows' weights add up to
more than all but ``REJECT_RATE`` of the ordinary texts' do, one at least left out. Nothing is looked
up in a list of words: any window that shares its stems with toxic text is
shortened.

The model is fitted on a bounded sample: ``sample`` toxic and three times as many
ordinary labelled ids, those of the least hashes. Scoring reads every window of
every text, words of any length. Null and wordless texts have no windows and are
never toxic; repeated rows are judged alike; very long texts are read to their
end; an empty table gives an empty result. Without labels of both kinds, or too
few of them for the trainer, nothing is toxic. Other columns are carried along
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .rows import ID, TEXT, small_batches

SAMPLE, WORDS, BASE, EXTRA, LEAST_RATIO, LEAST_SHARE, REJECT_RATE = 1000, 3, 32768, 2048, 25.0, 0.02, 0.002
_GRAM, _CELLS, _SLICE, _LOW, _HIGH, _HIT, _LEAST_SCORE = 5, 1 << 22, 250, -20, 43, 3, 3.0


@dataclass
class Model:
    """What scoring needs; without a toxic dictionary nothing is marked."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=list)  # of the distances _LOW to _HIGH
    threshold: float = float("inf")


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT)
    params = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=17, chain_log=17, search_log=5, min_match=3, target_length=14, strategy=zstandard.STRATEGY_BTOPT,
        write_content_size=False, write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    kind.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=kind, compression_params=params)


def windows(texts: pa.Array, words: int = WORDS) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the lower-cased texts, row, start, end, name) of the windows of so many words, in order; a text's last may have fewer.

    A window reaches one byte beyond its words on both sides. Equal words have equal names.
    """
    low = pc.utf8_lower(texts)
    buf, off = textvec.utf8(low)
    h, row, start, end = textvec.words(low)
    first = np.searchsorted(row, row)
    i = np.flatnonzero((np.arange(len(row)) - first) % words == 0)
    last = np.minimum(i + words - 1, np.searchsorted(row, row[i], side="right") - 1)
    r = row[i]
    a, b = np.maximum(off[r] + start[i] - 1, off[r]), np.minimum(off[r] + end[last] + 1, off[r + 1])
    name = np.zeros(len(i), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            name = textvec.mix(name * np.uint64(0x9E3779B97F4A7C15) + np.where(i + k <= last, h[np.minimum(i + k, last)] if len(i) else 0, np.uint64(k)))
    return buf.tobytes(), r, a, b, name


class _Judge:
    """Compares windows under a model's two dictionaries."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.weights = np.array(model.weights)
        self.pair = [_compressor(d) for d in (model.ordinary, model.toxic)] if model.toxic else []

    def distances(self, buf: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How much shorter each window becomes by the toxic dictionary."""
        n = end - start
        twice, at = np.repeat(n, 2), np.repeat(start, 2)
        to = np.cumsum(twice) - twice
        data = np.frombuffer(buf, np.uint8)[np.arange(twice.sum()) - np.repeat(to - at, twice)].tobytes()
        segments = np.stack([to[::2], 2 * n], 1).astype(np.uint64)
        out = np.zeros(len(n), np.int64)
        for i in range(0, len(n), 16384):
            part = zstandard.BufferWithSegments(data, segments[i : i + 16384].tobytes())
            a, b = (np.fromiter(map(len, c.multi_compress_to_buffer(part)), np.int64) for c in self.pair)
            out[i : i + 16384] = a - b
        return out

    def seen(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, distance) of the distinct windows of each text."""
        buf, row, start, end, name = windows(texts)
        if not len(row) or not self.pair:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, first, which = np.unique(name, return_index=True, return_inverse=True)
        d = self.distances(buf, start[first], end[first])
        once = np.unique(row * len(first) + which)
        return once // len(first), d[once % len(first)]

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct windows, hits, score) of each text; hits are the windows of a distance of at least three bytes."""
        n = len(texts)
        row, d = self.seen(texts)
        if not self.pair:
            return np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        return np.bincount(row, minlength=n), np.bincount(row[d >= _HIT], minlength=n), np.bincount(row, self.weights[np.clip(d, _LOW, _HIGH) - _LOW], minlength=n)


def _apart(texts: list[str]) -> list[str]:
    """One text for each context, so that a text and its near copies are one piece of evidence; wordless ones go."""
    out: dict[int, str] = {}
    for t in texts:
        if c := int(textvec.contexts(pc.utf8_lower(pa.array([t])), 29)[0]):
            out.setdefault(c, t)
    return list(out.values())


def _grams(buf: bytes) -> np.ndarray:
    """The cell of the byte gram at each place."""
    x = np.frombuffer(buf + b" " * (_GRAM - 1), np.uint8).astype(np.uint64)
    h = np.zeros(len(buf), np.uint64)
    for k in range(_GRAM):
        h = h * np.uint64(257) + x[k : len(buf) + k]
    return (textvec.mix(h) & np.uint64(_CELLS - 1)).astype(np.int64)


def fragments(toxic: list[str], ordinary: list[str], ratio: float = LEAST_RATIO, share: float = LEAST_SHARE) -> list[bytes]:
    """The stretches of toxic texts made of grams that are so many times as frequent there as in ordinary texts."""
    a, b = (b"\n".join(t.lower().encode() for t in texts) for texts in (toxic, ordinary))
    ga, gb = _grams(a), _grams(b)
    mine, other = (np.bincount(g, minlength=_CELLS)[ga] for g in (ga, gb))
    rare = (mine >= max(3, share * len(toxic))) & (mine / len(a) > ratio * (other + 0.5) / max(len(b), 1))
    cover = np.zeros(len(a) + _GRAM + 1, np.int8)
    for k in range(_GRAM):
        cover[np.flatnonzero(rare) + k] = 1
    turn = np.flatnonzero(np.diff(np.concatenate([[0], cover[: len(a)], [0]])))
    return [a[x:y].ljust(8) for x, y in zip(turn[::2], turn[1::2])]


def _dictionary(size: int, samples: list[bytes], d: int, k: int) -> bytes:
    """A trained dictionary of at most that size, of a smaller one where the samples don't suffice for more, or nothing."""
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, d=d, k=k, steps=1).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b""


def train(toxic: list[str], ordinary: list[str], reject_rate: float = REJECT_RATE) -> Model:
    """A model from texts of both kinds; every second ordinary text only calibrates."""
    toxic, ordinary = _apart(sorted(set(toxic))), _apart(sorted(set(ordinary) - set(toxic)))
    seen, unseen = ordinary[::2], ordinary[1::2]
    if not toxic or not seen or not unseen:
        return Model()
    samples = []
    for i in range(0, len(seen), _SLICE):
        buf, _, start, end, _ = windows(pa.array(seen[i : i + _SLICE]), 4)
        samples += [buf[a:b] for a, b in zip(start.tolist(), end.tolist())]
    extra = _dictionary(EXTRA, fragments(toxic, seen), 6, 16)
    base = _dictionary(BASE, samples[:: max(1, len(samples) // 80000)], 8, 64)
    if not extra or not base:
        return Model()
    # bytes that no text has stand for the fragments, so that the base is as far away in both
    model = Model(base + b"\0" * len(extra), base + extra)
    judge = _Judge(model)

    def distances(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [judge.seen(pa.array(texts[i : i + _SLICE])) for i in range(0, len(texts), _SLICE)]
        return np.concatenate([r + i * _SLICE for i, (r, _) in enumerate(parts)]), np.clip(np.concatenate([d for _, d in parts]), _LOW, _HIGH) - _LOW

    (_, bad), (row, good) = distances(toxic), distances(unseen)
    p, q = (np.bincount(x, minlength=_HIGH - _LOW + 1) + 0.5 for x in (bad, good))
    w = np.log(p / p.sum() / (q / q.sum()))
    w[: 1 - _LOW] = np.minimum(w[: 1 - _LOW], 0)
    scores = np.sort(np.bincount(row, w[good], minlength=len(unseen)))[::-1]
    model.weights = w.tolist()
    model.threshold = max(float(scores[min(math.ceil(reject_rate * len(scores)), len(scores) - 1)]), _LEAST_SCORE)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = ID, text_col: str = TEXT) -> Model:
    """A model from the texts, whole, of a bounded sample of the labelled ids."""
    judged = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("kind"))
    ids = [r for kind, most in ((1, sample), (0, 3 * sample)) for r in judged.where(F.col("kind") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    if not ids:
        return Model()
    chosen = docs.sparkSession.createDataFrame(ids, judged.schema).withColumnsRenamed({"doc_id": "s_id", "kind": "s_kind"})
    rows = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).where("t IS NOT NULL")
    texts = rows.join(F.broadcast(chosen), F.col("i") == F.col("s_id")).select("t", "s_kind").toArrow()
    both: dict[int, list[str]] = {0: [], 1: []}
    for t, kind in zip(texts["t"].to_pylist(), texts["s_kind"].to_pylist()):
        both[kind].append(t)
    return train(both[1], both[0])


def _judged(model: Model, text: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(model)
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b = whole.slice(at, _SLICE)
                seen, hits, score = judge.scores(b.column(text))
                toxic = score > model.threshold
                if keep:
                    yield b.filter(pa.array(~toxic))
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seen.astype(np.int64)), pa.array(hits.astype(np.int64)), pa.array(np.round(score.astype(np.float64), 6)), pa.array(toxic)], names=["doc_id", "windows", "hits", "score", "toxic"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc_id, windows, hits, score, toxic) of every row."""
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("windows", T.LongType()), T.StructField("hits", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("toxic", T.BooleanType())])
    return small_batches(docs).select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(_judged(model, 1, False), out)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = TEXT) -> DataFrame:
    """docs without the rows of toxic texts."""
    names = docs.columns
    plain = small_batches(docs).toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(_judged(model, names.index(text_col), True), plain.schema).toDF(*names)
