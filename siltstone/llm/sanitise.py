"""Information-theoretic sanitisation of personal data.

Protected entities (addresses of mail and network, telephone, card, account
and social security numbers, secrets) are found by pattern and always
replaced by the name of their kind. Terms can give an entity away even then:
over the whole corpus, the disclosure of an entity e by a term t is the
pointwise mutual information of their occurrence in documents as a share of
the information content of e,

    log(N n(e,t) / (n(e) n(t))) / log(N / n(e)),

which is 1 where t never occurs without e. In texts that hold e, terms from
``generalise`` on become the name of their class and terms from ``remove`` on
are deleted, given that e and t occur together in at least ``support``
contexts and that so many of e's contexts hold t by chance less than once in a
thousand (likelihood ratio of the binomial). A context is a group of near
copies, connected by bands of hashed runs of three words, so that copies and
near copies of one text are one piece of evidence, not many. An entity of a
single context is replaced, but nothing can be estimated about it.

Texts without an entity stay as they are, as do null and empty ones. Very long
texts are read and rewritten whole. Repeated rows are treated alike, and terms
that tie with a threshold are changed. An empty table gives an empty result.
Columns of any name are carried along.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.components import connected_components
from siltstone.operators.lineage import materialise

from . import textvec
from .rows import ID, TEXT, small_batches

SUPPORT, GENERALISE, REMOVE, CHANCE = 2, 0.7, 0.9, 10.83 / 2
_BANDS, _ROWS = 8, 2
# what every text with an entity holds, in Java's syntax; characters beyond the first plane may be digits that Java doesn't know
HINT = r"[@\p{Nd}\x{10000}-\x{10FFFF}]|[a-fA-F]{32}|(?:[tT][oO][kK][eE][nN]|[sS][eE][cC][rR][eE][tT]|[pP][aA][sS][sS][wW](?:[oO][rR])?[dD]|[aA][pP][iI][_-]?[kK][eE][yY])[\s\x0B\x1C-\x1F\x85\p{Z}]*[:=]"
_KINDS = re.compile(
    r"""(?P<EMAIL>(?<![\w.%+-])[\w.%+-]+@\w[\w-]*(?:\.[\w-]+)+)
    |(?P<SECRET>(?:(?ai:token|secret|passw(?:or)?d|api[_-]?key)\s*[:=]\s*["']?(?P<value>[\w+/=-]{16,}))|(?<!\w)[0-9a-fA-F]{32,}(?!\w))
    |(?P<IBAN>(?<!\w)[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){3,7}(?:\ ?[A-Z0-9]{1,3})?(?!\w))
    |(?P<PHONE>(?<![\w+.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+.])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\w)|(?<![\w+.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-]))
    |(?P<SSN>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<IP>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))
    |(?P<CARD>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))""",
    re.VERBOSE,
)


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normalised value) of the protected entities of a text, in order."""
    out = []
    for m in _KINDS.finditer(text):
        kind = m.lastgroup if m.lastgroup != "value" else "SECRET"
        start, end = m.span("value") if m.group("value") else m.span()
        value = text[start:end]
        if kind == "IP":
            try:
                ipaddress.ip_address(value)
            except ValueError:
                continue
        if kind in ("PHONE", "SSN", "CARD", "IBAN"):
            value = re.sub(r"[^0-9A-Z]", "", value)
        out.append((start, end, kind, value.lower()))
    return out


def _names(found: list[tuple[int, int, str, str]]) -> np.ndarray:
    """64-bit names of the distinct entities."""
    if not found:
        return np.zeros(0, np.uint64)
    values = [f"{k}:{v}" for _, _, k, v in found]
    buf, off = textvec.utf8(pa.array(values))
    data = buf.astype(np.uint64)
    return np.unique(np.array([_fnv(data[a:b]) for a, b in zip(off[:-1], off[1:])], np.uint64))


def _fnv(data: np.ndarray) -> int:
    h = 0xCBF29CE484222325
    for x in data.tolist():
        h = ((h ^ x) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def _masked(text: str, found: list[tuple[int, int, str, str]]) -> str:
    """The text with spaces for its entities."""
    out, at = [], 0
    for a, b, _, _ in found:
        out += [text[at:a], " " * (b - a)]
        at = b
    return "".join([*out, text[at:]])


def bands(texts: pa.Array) -> np.ndarray:
    """n x 8 numbers; near copies mostly share one at least, other texts hardly ever do.

    Each is made of the least two of differently hashed runs of three words, of the words themselves in shorter texts.
    """
    n = len(texts)
    h, row, _, _ = textvec.words(texts)
    few = np.bincount(row, minlength=n) < 3
    h3, row3 = textvec.shingles(h, row, 3)
    h, row = np.concatenate([h3, h[few[row]]]), np.concatenate([row3, row[few[row]]])
    out = np.zeros((n, _BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(_BANDS):
            for r in range(_ROWS):
                least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(least, row, textvec.mix(h + np.uint64(1000003 * (b * _ROWS + r + 1))))
                out[:, b] = textvec.mix(out[:, b] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(b))
    return out.view(np.int64)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text) -> (k1, k2, es, bands) of each row with entities."""
    for b in batches:
        found = [entities(t) for t in b.column(2).to_pylist()]
        rows = np.flatnonzero([bool(f) for f in found])
        b, found = b.take(pa.array(rows, pa.int64())), [found[i] for i in rows]
        masked = pa.array([_masked(t, f) for t, f in zip(b.column(2).to_pylist(), found)], pa.string())
        es = pa.array([_names(f).view(np.int64).tolist() for f in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), es, pa.array(bands(masked).tolist(), pa.list_(pa.int64()))], names=["k1", "k2", "es", "bands"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, es, ctx) -> (e, t, ctx) for each of the given entities and each distinct term of the text."""
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            b = whole.slice(at, 64)
            masked = pa.array([_masked(t, entities(t)) for t in b.column(0).to_pylist()], pa.string())
            h, row, _, _ = textvec.words(masked)
            h, row, _ = textvec.distinct(h, row)
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            for i, (es, c) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                terms = h[cut[i] : cut[i + 1]].view(np.int64)
                for e in es:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), e, np.int64)), pa.array(terms), pa.array(np.full(len(terms), c, np.int64))], names=["e", "t", "ctx"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of texts with each term, over a task."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held: list[np.ndarray] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        k = np.concatenate([keys, *held])
        n = np.concatenate([counts, np.ones(len(k) - len(keys), np.int64)])
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        return k[first], np.add.reduceat(n, first) if len(k) else n

    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            h, row, _, _ = textvec.words(whole.column(0).slice(at, 500))
            h, _, _ = textvec.distinct(h, row)
            held.append(h)
            if sum(map(len, held)) > 1_000_000:
                keys, counts = merged()
                held = []
    keys, counts = merged()
    for at in range(0, len(keys), 1 << 20):
        yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 20)].view(np.int64)), pa.array(counts[at : at + (1 << 20)])], names=["t", "n"])


def _class(word: str) -> str:
    return "[NUMBER]" if word[:1].isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]"


def rewrite(text: str, terms: dict[int, int]) -> tuple[str, int, int, int]:
    """(text, entities replaced, terms generalised, terms removed); terms: 1 generalises and 2 removes a hashed word."""
    found = entities(text)
    if not found:
        return text, 0, 0, 0
    edits = [(a, b, f"[{kind}]") for a, b, kind, _ in found]
    counts = [0, 0]
    if terms:
        masked = _masked(text, found)
        raw = masked.encode()
        h, _, start, end = textvec.words(pa.array([masked]))
        hit = np.flatnonzero(np.isin(h.view(np.int64), np.fromiter(terms, np.int64, len(terms))))
        for i in hit:
            a, b = len(raw[: start[i]].decode()), len(raw[: end[i]].decode())
            act = terms[int(h[i].view(np.int64))]
            counts[act - 1] += 1
            edits.append((a, b, _class(text[a:b])) if act == 1 else (a - (text[max(a - 1, 0) : a] == " "), b, ""))
    out, at = [], 0
    for a, b, new in sorted(edits):
        if a >= at:
            out += [text[at:a], new]
        elif b > at:
            out.append(new)
        at = max(at, b)
    return "".join([*out, text[at:]]), len(found), *counts


def disclosures(docs: DataFrame, keyed: DataFrame, n: int, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, text_col: str = TEXT) -> tuple[DataFrame, DataFrame]:
    """((k1, k2, es) of the texts with recurring entities, (e, t, act) of the terms that give them away); keyed has k1, k2 and x, the texts that may have entities."""
    rows = materialise(keyed.mapInArrow(_find, "k1 bigint, k2 bigint, es array<bigint>, bands array<bigint>"), "entities")
    one = rows.dropDuplicates(["k1", "k2"])
    linked = connected_components(one.select("k1", F.explode("bands").alias("b")), "k1", "b")
    ctx = one.select("k1").distinct().join(linked, F.col("k1") == F.col("node")).select("k1", F.col("component").alias("ctx"))
    found = materialise(rows.join(ctx, "k1").select("k1", "k2", "ctx", F.explode("es").alias("e")), "entity-contexts")
    recurring = materialise(found.groupBy("e").agg(F.count("*").alias("n_e"), F.countDistinct("ctx").alias("c_e")).where(F.col("c_e") >= support), "recurring")
    texts = found.join(recurring, "e").groupBy("k1", "k2").agg(F.collect_set("e").alias("es"), F.first("ctx").alias("ctx"))
    texts = materialise(texts, "entity-texts")
    pairs = keyed.join(texts, ["k1", "k2"]).select("x", "es", "ctx").mapInArrow(_pairs, "e bigint, t bigint, ctx bigint")
    together = materialise(pairs.groupBy("e", "t").agg(F.count("*").alias("n_et"), F.countDistinct("ctx").alias("c")).where(F.col("c") >= support), "together")
    terms = together.select("t").distinct()
    df = docs.where(docs[text_col].isNotNull()).select(docs[text_col].alias("x")).mapInArrow(_frequencies, "t bigint, n bigint").join(terms, "t", "left_semi").groupBy("t").agg(F.sum("n").alias("n_t"))
    share = F.log(F.lit(float(n)) * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) / F.log(F.lit(float(n)) / F.col("n_e"))
    p, q = F.col("n_t") / float(n), F.col("c") / F.col("c_e")
    # the likelihood ratio that c of e's contexts hold t, against t's share of all texts
    ratio = F.when(q > p, F.col("c") * F.log(q / p) + F.when(q < 1, (F.col("c_e") - F.col("c")) * F.log((1 - q) / (1 - p))).otherwise(0.0)).otherwise(0.0)
    scored = together.join(recurring, "e").join(df, "t").where(F.col("n_e") < n).where(ratio >= CHANCE).withColumn("s", share).where(F.col("s") >= generalise)
    return texts, materialise(scored.select("e", "t", F.when(F.col("s") >= remove, 2).otherwise(1).alias("act")), "disclosures")


def _keys(text):
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")


def _sanitised(docs: DataFrame, text_col: str, support: int, generalise: float, remove: float) -> tuple[DataFrame, DataFrame, T.StructType]:
    """Rows without a hint of an entity, and the rewritten others; both with columns c0, c1, ... and three counts."""
    plain = small_batches(docs).toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index(text_col)}"
    hint = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    keyed = materialise(plain.where(hint).select(*plain.columns, *_keys(F.col(text))), "hinted")
    texts, acts = disclosures(plain, keyed.select("k1", "k2", F.col(text).alias("x")), max(plain.where(F.col(text).isNotNull()).count(), 1), support, generalise, remove, text)
    plan = texts.select("k1", "k2", F.explode("es").alias("e")).join(acts, "e").groupBy("k1", "k2", "t").agg(F.max("act").alias("act")).groupBy("k1", "k2").agg(F.collect_list(F.struct("t", "act")).alias("acts"))
    at, width = docs.columns.index(text_col), len(docs.columns)
    schema = T.StructType([*plain.schema, *(T.StructField(c, T.LongType()) for c in ("s_entities", "s_generalised", "s_removed"))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            acts_of = b.column(width).to_pylist()
            new = [rewrite(t, {a["t"]: a["act"] for a in acts or ()}) for t, acts in zip(b.column(at).to_pylist(), acts_of)]
            cols = [pa.array([r[0] for r in new], pa.string()) if i == at else b.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([r[k] for r in new], pa.int64()) for k in (1, 2, 3))], names=schema.names)

    hinted = keyed.join(plan, ["k1", "k2"], "left").select(*plain.columns, "acts").mapInArrow(apply, schema)
    return plain.where(~hint).select(*plain.columns, *(F.lit(0).cast("long").alias(c) for c in schema.names[width:])), hinted, schema


def sanitise(docs: DataFrame, text_col: str = TEXT, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """docs with sanitised texts."""
    rest, hinted, _ = _sanitised(docs, text_col, support, generalise, remove)
    return rest.unionAll(hinted).select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def sanitised(docs: DataFrame, id_col: str = ID, text_col: str = TEXT, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(doc_id, text, entities, generalised, removed) of every row: its sanitised text and the number of each change."""
    rest, hinted, _ = _sanitised(docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")), "t", support, generalise, remove)
    return rest.unionAll(hinted).toDF("doc_id", "text", "entities", "generalised", "removed")
