"""Vectorised word and character-gram hashing over Arrow string buffers.

Everything here works on a whole Arrow batch at once: the concatenated UTF-8
buffer is mapped through a byte table and words become 64-bit polynomial
hashes taken from prefix sums, so no Python loop ever touches a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))

_WORD = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128:
        _WORD[_b] = _b
    elif 65 <= _b <= 90:
        _WORD[_b] = _b + 32

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("base")
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        for name, factor in (("base", _BASE), ("inv", _INV)):
            out = np.ones(size, dtype=np.uint64)
            out[1:] = factor
            with np.errstate(over="ignore"):
                _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["base"][:n], _POWERS["inv"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads a 64-bit value over all its bits."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, n + 1 offsets); a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start byte in its text, end byte) of every word, in text order.

    A word is a run of ASCII letters and digits and non-ASCII bytes; ASCII
    letters are folded to lower case. Equal words have equal hashes anywhere.
    """
    buf, off = utf8(texts)
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    b = _WORD[buf]
    on = np.zeros(n + 1, dtype=bool)
    on[:n] = b != 0
    begins = on.copy()
    begins[1:] &= ~on[:-1]
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
    cut = inner[on[inner] & on[inner - 1]]  # a word never runs over into the next text
    begins[cut] = True
    ends = ~on
    ends[1:] &= on[:-1]
    ends[0] = False
    ends[cut] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    base, inv = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(b.astype(np.uint64) * base[:n], out=total[1:])
        h = mix((total[end] - total[start]) * inv[start])
    row = np.searchsorted(off, start, side="right") - 1
    return h, row, start - off[row], end - off[row]


def shingles(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of k words within one text."""
    if k == 1:
        return h, row
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - k + 1
    with np.errstate(over="ignore"):
        out = h[:m].copy()
        for j in range(1, k):
            out = mix(out * _BASE + h[j : j + m])
    same = row[:m] == row[k - 1 :]
    return out[same], row[:m][same]


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, count) of each distinct pair, rows ascending."""
    if len(h) == 0:
        return h, row, np.zeros(0, np.int64)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], row[at], np.diff(np.append(at, len(h)))


def contexts(texts: pa.Array, seed: int) -> np.ndarray:
    """The least hashed run of three words of each text (of shorter texts, the hash of their words), 0 for a wordless one.

    Near copies mostly share it, other texts hardly ever do.
    """
    h, row, _, _ = words(texts)
    n = len(texts)
    count = np.bincount(row, minlength=n)
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    few = count[row] < 3
    with np.errstate(over="ignore"):
        short = np.zeros(n, np.uint64)
        np.add.at(short, row[few], mix(h[few] + np.uint64(seed)))
    h3, row3 = shingles(h, row, 3)
    np.minimum.at(out, row3, mix(h3 + np.uint64(seed)))
    return np.where(count >= 3, out, short)
