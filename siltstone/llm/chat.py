"""Transcript parsing with a hidden Markov model.

A transcript is text in lines. The model's states are the roles, each as a
turn's first line and as a further one. A line is seen as the class of its
speaker marker (a known word for a role, the first, second or a later other
name, or none), the bucket of its length, whether it ends in a question mark,
and whether a blank line or the text's start comes before it. Counts with
additive smoothing over labelled conversations give the probabilities,
Viterbi's algorithm the most likely states. Lines are then joined to turns,
markers removed, and turns rendered canonically as
``<|role|>\\ntext\\n<|end|>``.

The model is fitted on at most ``sample`` conversations, those of the least
hashes. Null transcripts have null turns, blank ones none. Lines of any length
and number are read whole. Ties go to the role that comes first in the
alphabet. Repeated rows are parsed alike. An empty table gives an empty
result; other columns are ignored. In a table of conversations, null texts
count as empty, rows without a role teach nothing and get no marker, and turns
with equal numbers come in order of role and text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 2000
_MARK = re.compile(r"^\s{0,3}(?:\#{1,4}\s*|\*{1,2}|[\[<(|]{1,2})?([^\W\d_][\w .-]{0,23}?)(?:\*{1,2}|[\]>)|]{1,2})?\s?(?:[:>]|(?<=[\]>)|*])(?=\s|$))(?:\*{1,2})?\s?", re.UNICODE)
_KNOWN = {"user": 1, "human": 1, "question": 1, "q": 1, "customer": 1, "instruction": 1, "prompt": 1, "student": 1, "assistant": 2, "bot": 2, "ai": 2, "answer": 2, "a": 2, "agent": 2, "response": 2, "model": 2, "gpt": 2, "teacher": 2, "system": 3, "sys": 3, "context": 3, "tool": 4, "function": 4}
_CLASSES, _BUCKETS = 8, 7
STYLES = (
    {"user": "User: ", "assistant": "Assistant: ", "system": "System: "},
    {"user": "Human: ", "assistant": "AI: ", "system": "Context: "},
    {"user": "Q: ", "assistant": "A: ", "system": "Sys: "},
    {"user": "[user] ", "assistant": "[bot] ", "system": "[system] "},
    {"user": "**Maria**: ", "assistant": "**Helper**: ", "system": "**Setup**: "},
    {},
)


@dataclass
class Model:
    roles: list[str]
    start: np.ndarray
    move: np.ndarray
    seen: list[np.ndarray]  # one table of log probabilities a feature, states x values


def lines_of(text: str) -> tuple[list[str], np.ndarray, list[int]]:
    """(lines, lines x 4 features, where each line goes on after its marker); blank lines are left out."""
    lines, feats, cut = [], [], []
    names: dict[str, int] = {}
    blank = True
    for line in text.split("\n"):
        if not line.strip():
            blank = True
            continue
        kind, after = 0, 0
        m = _MARK.match(line)
        if m:
            name = m.group(1).strip().lower()
            kind = _KNOWN.get(name) or 5 + min(names.setdefault(name, len(names)), 2)
            after = m.end()
        size = len(line) - after
        feats.append((kind, min(int(np.log2(size / 16 + 1)), _BUCKETS - 1), int(line.rstrip().endswith("?")), int(blank) + int(not lines)))
        lines.append(line)
        cut.append(after)
        blank = False
    return lines, np.array(feats, np.int64).reshape(-1, 4), cut


def transcript(turns: list[tuple[str | None, str | None]], style: int) -> tuple[str, list[int]]:
    """(raw transcript of (role, text) turns, the turn of each of its lines that isn't blank)."""
    marks, parts, owner = STYLES[style % len(STYLES)], [], []
    for k, (role, text) in enumerate(turns):
        part = marks.get(role or "", "") + (text or "")
        parts.append(part)
        owner += [k] * sum(bool(x.strip()) for x in part.split("\n"))
    return ("\n" if marks else "\n\n").join(parts), owner


def train(talks: list[tuple[list[tuple[str | None, str | None]], int]], smooth: float = 0.5) -> Model:
    """A model from (turns, style) pairs."""
    roles = sorted({r for turns, _ in talks for r, _ in turns if r is not None})
    s = 2 * len(roles)
    start, move = np.full(s, smooth), np.full((s, s), smooth)
    seen = [np.full((s, n), smooth) for n in (_CLASSES, _BUCKETS, 2, 3)]
    for turns, style in talks:
        text, owner = transcript(turns, style)
        _, feats, _ = lines_of(text)
        before, last = None, None
        for k, f in zip(owner, feats):
            if turns[k][0] is None:
                before, last = None, k
                continue
            state = 2 * roles.index(turns[k][0]) + (k == last)
            if before is not None:
                move[before, state] += 1
            elif last is None:
                start[state] += 1
            for table, value in zip(seen, f):
                table[state, value] += 1
            before, last = state, k
    for j in range(len(roles)):  # a turn's further lines follow its own lines only
        start[2 * j + 1] = 1e-9
        move[[i for i in range(s) if i // 2 != j], 2 * j + 1] = 1e-9
    log = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return Model(roles, log(start) if s else start, log(move) if s else move, [log(t) if s else t for t in seen])


def viterbi(model: Model, feats: list[np.ndarray]) -> list[np.ndarray]:
    """The most likely states of each transcript's lines; all transcripts advance together."""
    order = np.argsort([-len(f) for f in feats], kind="stable")
    size = np.array([len(feats[i]) for i in order])
    if not len(size) or not size[0] or not model.roles:
        return [np.zeros(0, np.int64)] * len(feats)
    see = [sum(t[:, f[:, j]] for j, t in enumerate(model.seen)).T if len(f) else None for f in feats]
    n = int((size > 0).sum())
    score = model.start + np.stack([see[i][0] for i in order[:n]])
    back: list[np.ndarray] = []
    final = score.copy()
    for t in range(1, int(size[0])):
        n = int((size > t).sum())
        step = score[:n, :, None] + model.move[None]
        back.append(step.argmax(1).astype(np.int16))
        score = step.max(1) + np.stack([see[i][t] for i in order[:n]])
        final[:n] = score
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(feats)
    for k, i in enumerate(order):
        if size[k]:
            path = np.zeros(size[k], np.int64)
            path[-1] = final[k].argmax()
            for t in range(size[k] - 1, 0, -1):
                path[t - 1] = back[t - 1][k, path[t]]
            out[i] = path
    return out


def turns_of(model: Model, texts: list[str | None]) -> list[list[tuple[str, str]] | None]:
    """The (role, text) turns of each transcript."""
    split = [lines_of(t or "") for t in texts]
    out: list[list[tuple[str, str]] | None] = []
    for text, (lines, _, cut), path in zip(texts, split, viterbi(model, [f for _, f, _ in split])):
        turns: list[tuple[str, list[str]]] = []
        for line, at, state in zip(lines, cut, path):
            if state % 2 == 0 or not turns:
                turns.append((model.roles[state // 2], [line[at:]]))
            else:
                turns[-1][1].append(line)
        out.append(None if text is None else [(r, "\n".join(x).strip()) for r, x in turns])
    return out


def render(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"<|{role}|>\n{text}\n<|end|>" for role, text in turns)


def _gathered(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def fit(conversations: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the conversations (conv_id, turn, role, text) of the least hashes."""
    ids = conversations.select("conv_id").where("conv_id IS NOT NULL").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(sample)
    chosen = [r[0] for r in ids.collect()]
    rows = _gathered(conversations.where(F.col("conv_id").isin(chosen))).orderBy("conv_id").collect() if chosen else []
    return train([([(t["role"], t["text"]) for t in r["turns"]], k) for k, r in enumerate(rows)])


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, text): each conversation as a raw transcript, in a style that its id's hash picks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [transcript([(t["role"], t["text"]) for t in turns], style)[0] for turns, style in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["conv_id", "text"])

    style = F.pmod(F.xxhash64(F.lit(3), "conv_id"), F.lit(len(STYLES)))
    out = T.StructType([T.StructField("conv_id", conversations.schema["conv_id"].dataType), T.StructField("text", T.StringType())])
    return _gathered(conversations).withColumn("style", style).mapInArrow(run, out)


def parse(raw: DataFrame, model: Model, id_col: str = "conv_id", text_col: str = "text") -> DataFrame:
    """(conv_id, turns, rendered) of every raw transcript."""
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                turns = turns_of(model, b.column(1).to_pylist())
                rows = [None if x is None else [{"role": r, "text": t} for r, t in x] for x in turns]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(turn)), pa.array([None if x is None else render(x) for x in turns], pa.string())], names=["conv_id", "turns", "rendered"])

    out = T.StructType([T.StructField("conv_id", raw.schema[id_col].dataType), T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))), T.StructField("rendered", T.StringType())])
    return raw.select(raw[id_col].alias("i"), raw[text_col].alias("t")).mapInArrow(run, out)
