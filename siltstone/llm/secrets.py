"""Multipart credential linking.

Patterns find three kinds of candidates: access identifiers, secrets and
endpoints. Strong secrets (private keys, prefixed tokens, high-entropy values
that are assigned to a telling name) are reported by themselves. All other
candidates are weak: a weak secret is reported when an identifier or an
endpoint lies within ``reach`` characters of it in the same scope, and
identifiers and endpoints when a secret does. Scopes are the parts of a text
between blank lines. The parts meet in an interval join on bins of ``reach``
characters, each pair in the first bin that both touch. The join runs over
distinct texts, so that copies of a text don't meet each other. Each text is
read once; those without anything that every candidate holds (``HINT``) are
told apart by a faster expression first.

Null and empty texts have no candidates. Rows that repeat an id and a text are
reported once. Of candidates that overlap, the first in the text wins, and of
those the one whose pattern comes first; but within a URL its user-info, tokens
of a known prefix and telling parameters are candidates too. Very long texts are
scanned whole. An empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.lineage import materialise

from .rows import ID, TEXT, small_batches

REACH, STRONG_BITS, STRONG_LENGTH = 200, 3.0, 20
# what every candidate holds, in the syntax of Arrow's regular expressions, which run in time linear in the text
HINT = (
    r"PRIVATE KEY|gh[pousr]_|sk_live_|sk-[A-Za-z0-9]{32}|xox[abprs]-|AIza|glpat-|AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|://|@|\p{Nd}\.\p{Nd}+\.\p{Nd}|[0-9A-Za-z/+]{32}"
    r"|(?i:token|secret|key|passwd|password|pwd|auth|user|name|id|login|account|tenant|host|endpoint|server|url)[\s\x0b\x1c-\x1f\x{85}\p{Z}]{0,3}[:=]"
)
_PATTERNS = re.compile(
    r"""(?P<pem>-----BEGIN\ [A-Z ]*PRIVATE\ KEY-----(?:[A-Za-z0-9+/=\s]*-----END\ [A-Z ]*PRIVATE\ KEY-----)?)
    |(?P<prefixed>(?<!\w)(?:gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9]{32,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[\w-]{35}|glpat-[\w-]{20}))
    |(?P<key_id>(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w))
    |(?P<url>(?<!\w)[a-z][a-z0-9+.-]{1,15}://[^\s"'<>|]{3,})
    |(?<![^\W_])(?ai:(?:token|secret(?:[_-]?key)?|secret[_-]?access[_-]?key|passw(?:or)?d|pwd|api[_-]?key|auth(?:[_-]?token)?|access[_-]?token|private[_-]?key))\s{0,3}[:=]\s{0,3}["']?(?P<assigned>[^\s"'|,;]{8,})
    |(?<![^\W_])(?ai:(?:user(?:[_-]?(?:name|id))?|login|account(?:[_-]?(?:name|id))?|client[_-]?id|app[_-]?id|access[_-]?key(?:[_-]?id)?|tenant(?:[_-]?id)?))\s{0,3}[:=]\s{0,3}["']?(?P<named>[\w.@+-]{3,})
    |(?<![^\W_])(?ai:(?:host(?:name)?|endpoint|server|base[_-]?url))\s{0,3}[:=]\s{0,3}["']?(?P<place>[\w.:/-]{3,})
    |(?P<mail>(?<![\w.%+-])[\w.%+-]+@\w[\w-]*(?:\.[\w-]+)+)
    |(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?(?![\w]|\.\d))
    |(?P<opaque>(?<![\w/+])(?:[0-9a-fA-F]{32,}|(?=[A-Za-z0-9/+]*\d)(?=[A-Za-z0-9/+]*[A-Z])(?=[A-Za-z0-9/+]*[a-z])[A-Za-z0-9/+]{40,}={0,2})(?![\w/+]))""",
    re.VERBOSE,
)
_KIND = {"pem": "secret", "prefixed": "secret", "key_id": "identifier", "url": "endpoint", "assigned": "secret", "named": "identifier", "place": "endpoint", "mail": "identifier", "ip": "endpoint", "opaque": "secret"}
_USER_INFO = re.compile(r"[a-z][a-z0-9+.-]*://(?P<user>[^\s/?#:@]*):(?P<word>[^\s/?#]+)@")
_IN_URL = {"prefixed", "key_id", "assigned", "named"}
_BLANK = re.compile(r"\n[ \t\r]*\n")


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _strong(name: str, value: str) -> bool:
    return name in ("pem", "prefixed") or name == "assigned" and len(value) >= STRONG_LENGTH and entropy(value) >= STRONG_BITS


def _within_url(text: str, start: int, stop: int) -> Iterator[tuple[str, int, int]]:
    """(pattern, start, stop) of the user-info, prefixed tokens and telling parameters of a URL, in order."""
    at = text.index("://", start) + 3
    if m := _USER_INFO.match(text, start, stop):
        if m["user"]:
            yield "named", *m.span("user")
        yield "assigned", *m.span("word")
        at = m.end()
    while at < stop:  # by parts, so that a value ends where the next parameter begins
        end = min((i for i in (text.find(c, at, stop) for c in "?&#") if i >= 0), default=stop)
        in_query = text[at - 1] in "?&#"
        for m in _PATTERNS.finditer(text, at, end):
            if m.lastgroup in _IN_URL and (in_query or m.lastgroup in ("prefixed", "key_id")):
                yield m.lastgroup, *m.span(m.lastgroup)
        at = end + 1


def candidates(text: str) -> list[tuple[str, bool, int, int, int]]:
    """(kind, strong, start, stop, scope) of the candidates of a text in order."""
    out, scope = [], 0
    blanks = [m.end() for m in _BLANK.finditer(text)]
    for m in _PATTERNS.finditer(text):
        name = m.lastgroup
        start, stop = m.span(name)
        value = text[start:stop]
        if name == "ip" and any(int(x) > 255 for x in value.split(":")[0].split(".")):
            continue
        while scope < len(blanks) and blanks[scope] <= start:
            scope += 1
        out.append((_KIND[name], _strong(name, value), start, stop, scope))
        if name == "url":
            out += [(_KIND[x], _strong(x, text[a:b]), a, b, scope) for x, a, b in _within_url(text, start, stop)]
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, k1, k2, text) -> a row for each candidate; of its value the SHA-256 only."""
    for b in batches:
        b = b.filter(pc.fill_null(pc.match_substring_regex(b.column(3), HINT), False))
        found = [candidates(t) for t in b.column(3).to_pylist()]
        owner = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
        flat = [(*x, hashlib.sha256(t[x[2] : x[3]].encode("utf-8", "surrogatepass")).hexdigest()) for t, f in zip(b.column(3).to_pylist(), found) for x in f]
        cols = list(zip(*flat)) or [()] * 6
        kinds = [pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([*(b.column(i).take(owner) for i in range(3)), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "k1", "k2", "kind", "strong", "start", "stop", "scope", "value_hash"])


def linked_secrets(docs: DataFrame, reach: int = REACH, id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """(doc_id, kind, strong, start, stop, value_hash, identifiers, secrets, endpoints) of each reported candidate.

    start and stop are in characters; the last three count the parts it is
    linked to; the value itself is not returned.
    """
    name = docs.schema[id_col].dataType.simpleString()
    keyed = small_batches(docs).select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("k1"), F.xxhash64(F.lit(7), docs[text_col]).alias("k2"), docs[text_col].alias("t")).where("t <> ''")
    scanned = keyed.mapInArrow(_scan, f"doc_id {name}, k1 bigint, k2 bigint, kind string, strong boolean, start int, stop int, scope int, value_hash string")
    scanned = materialise(scanned.distinct(), "candidates")
    found = scanned.drop("doc_id", "value_hash", "strong").distinct()

    def binned(side: DataFrame, name: str, first: str, last: str) -> DataFrame:
        cols = [F.col(c).alias(f"{name}_{c}") for c in ("kind", "start", "stop")]
        return side.select("k1", "k2", "scope", *cols, F.expr(first).alias(f"{name}_first"), F.explode(F.expr(f"sequence({first}, {last})")).alias("bin"))

    # a secret reaches out to both sides, its partners stay where they are
    near = binned(found.where("kind = 'secret'"), "a", f"greatest(start - {reach}, 0) div {reach}", f"(stop + {reach}) div {reach}")
    part = binned(found.where("kind <> 'secret'"), "b", f"start div {reach}", f"stop div {reach}")
    pairs = near.join(part, ["k1", "k2", "scope", "bin"]).where(f"bin = greatest(a_first, b_first) AND b_start <= a_stop + {reach} AND a_start <= b_stop + {reach}")
    pairs = pairs.select("k1", "k2", F.explode(F.array(*(F.struct(F.col(f"{x}_kind").alias("kind"), F.col(f"{x}_start").alias("start"), F.col(f"{y}_kind").alias("other")) for x, y in ("ab", "ba")))).alias("x")).select("k1", "k2", "x.*")
    links = pairs.groupBy("k1", "k2", "kind", "start").agg(*(F.count_if(F.col("other") == k).alias(f"{k}s") for k in ("identifier", "secret", "endpoint")))
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("identifiers", "secrets", "endpoints")]
    reported = scanned.join(links, ["k1", "k2", "kind", "start"], "left").where("strong OR identifiers + secrets + endpoints > 0")
    return reported.select("doc_id", "kind", "strong", "start", "stop", "value_hash", *counts)
