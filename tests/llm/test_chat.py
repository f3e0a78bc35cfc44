import itertools
import random

import numpy as np

from siltstone.llm import chat

from .conftest import sentence


def talk(rng):
    turns = [("system", sentence(rng, 12))] if rng.random() < 0.4 else []
    for _ in range(rng.randrange(1, 5)):
        turns.append(("user", sentence(rng, rng.randrange(4, 20)) + rng.choice(["", "?"])))
        turns.append(("assistant", "\n".join(sentence(rng, rng.randrange(20, 70)) for _ in range(rng.randrange(1, 4)))))
    return turns


def talks(seed, n):
    rng = random.Random(seed)
    return [(talk(rng), i) for i in range(n)]


def test_held_out_accuracy():
    model = chat.train(talks(1, 240))
    held = talks(2, 120)
    got = chat.turns_of(model, [chat.transcript(t, s)[0] for t, s in held])
    marked = [(t, g) for (t, s), g in zip(held, got) if s % len(chat.STYLES) < 5]
    assert sum(t == g for t, g in marked) >= 0.95 * len(marked)
    bare = [(t, g) for (t, s), g in zip(held, got) if s % len(chat.STYLES) == 5]
    right = sum([r for r, _ in t] == [r for r, _ in g] for t, g in bare)
    assert right >= 0.5 * len(bare)


def test_viterbi_equals_brute_force():
    model = chat.train(talks(3, 30))
    feats = [chat.lines_of(chat.transcript(t, s)[0])[1][:4] for t, s in talks(4, 12)] + [np.zeros((0, 4), np.int64)]
    for f, path in zip(feats, chat.viterbi(model, feats)):
        def score(p):
            out = model.start[p[0]]
            for t, state in enumerate(p):
                out += sum(table[state, f[t, j]] for j, table in enumerate(model.seen)) + (model.move[p[t - 1], state] if t else 0)
            return out
        want = max((score(p) for p in itertools.product(range(2 * len(model.roles)), repeat=len(f))), default=0) if len(f) else 0
        assert (abs(score(path.tolist()) - want) < 1e-9) if len(f) else len(path) == 0


def test_rendering():
    assert chat.render([("user", "Hi"), ("assistant", "Yes\nsir")]) == "<|user|>\nHi\n<|end|>\n<|assistant|>\nYes\nsir\n<|end|>"


def test_odd_rows(spark):
    rows = [(1, 0, "user", "Hello there?"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, 0, None, "no role"), (None, 0, "user", "no id"), (3, None, "user", ""), (4, 0, "user", "word " * 50000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.fit(table)
    out = {r.conv_id: r for r in chat.parse(chat.transcripts(table), model).collect()}
    assert set(out) == {1, 2, 3, 4, None} and all(r.rendered is not None for r in out.values())
    assert sum(len(t.text) for t in out[4].turns) >= 50000 * 5 - 10
    raw = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n\n", "x")], "conv_id long, text string, turns string")
    got = {r.conv_id: r.turns for r in chat.parse(raw, model).collect()}
    assert got == {1: None, 2: [], 3: []}
    assert chat.fit(table.where("false")).roles == [] and chat.parse(raw, chat.fit(table.where("false"))).count() == 3
    assert chat.parse(chat.transcripts(table.where("false")), model).count() == 0
