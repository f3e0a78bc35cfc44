import random
import re

import pyarrow as pa
import pytest

from siltstone.llm import toxicity

from .conftest import sentence

BAD = ["wretchling", "gobdoric", "snivelpot", "crudwort", "mucklout"]


def corpus(seed, n, bad):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = sentence(rng, rng.randrange(40, 200)).split()
        if bad:
            for _ in range(max(2, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD).upper() if rng.random() < 0.3 else rng.choice(BAD))
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def model():
    return toxicity.train(corpus(1, 120, True), corpus(2, 400, False))


def judged(model, texts):
    return (toxicity._Judge(model).scores(pa.array(texts, pa.string()))[2] > model.threshold).tolist()


def test_held_out_accuracy(model):
    assert sum(judged(model, corpus(3, 100, True))) >= 95
    assert sum(judged(model, corpus(4, 300, False))) <= 3


def brute(model, text):
    """(distinct windows, score) of a text, a window at a time."""
    low = (text or "").lower().encode()
    words = list(re.finditer(rb"[a-z0-9\x80-\xff]+", low))
    groups = [words[i : i + toxicity.WORDS] for i in range(0, len(words), toxicity.WORDS)]
    seen = {tuple(w.group() for w in g): low[max(g[0].start() - 1, 0) : g[-1].end() + 1] for g in reversed(groups)}
    one, other = (toxicity._compressor(d) for d in (model.ordinary, model.toxic))
    d = [len(one.compress(w * 2)) - len(other.compress(w * 2)) for w in seen.values()]
    return len(seen), sum(model.weights[min(max(x, toxicity._LOW), toxicity._HIGH) - toxicity._LOW] for x in d)


def test_scores_equal_brute_force(model):
    texts = [*corpus(5, 20, True), *corpus(6, 20, False), None, "", " ?! ", "one", "Zwei wörter", "x" * 70000 + " " + BAD[0], "a b c a b c a b c"]
    for t in texts:  # one at a time, as equal windows of other texts may have other bytes around them
        windows, _, score = toxicity._Judge(model).scores(pa.array([t], pa.string()))
        n, s = brute(model, t)
        assert windows[0] == n and abs(score[0] - s) < 1e-9


def test_both_dictionaries_are_trained_and_no_list(model):
    """Texts whose toxic words are inflections that no training text has are found by their stems."""
    assert len(model.toxic) == len(model.ordinary) and model.toxic[: -toxicity.EXTRA] == model.ordinary[: -toxicity.EXTRA]
    rng = random.Random(12)
    variants = [b[:-1] + e for b in BAD for e in ("ings", "ery", "ous", "ified")]
    texts = []
    for t in corpus(7, 100, False):
        words = t.split()
        for _ in range(max(3, len(words) // 25)):
            words.insert(rng.randrange(len(words)), rng.choice(variants))
        texts.append(" ".join(words))
    assert not any(w.encode() in model.toxic for w in variants)
    assert sum(judged(model, texts)) >= 80


def test_marks_at_the_end_of_very_long_texts_count(model):
    long = sentence(random.Random(9), 40000)
    mark = " ".join(f"{b} {sentence(random.Random(i), 2)}" for i, b in enumerate(BAD * 200))
    assert judged(model, [long + " " + mark, None, "", " ?! "]) == [True, False, False, False]
    assert judged(model, [mark + " " + long]) == [True]


def test_fit_and_odd_rows(spark, odd, none, model):
    texts = [(i, t) for i, t in enumerate(corpus(1, 120, True) + corpus(2, 400, False))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i, _ in texts] + [(None, 1), (1, None), (9999, 1)], "doc_id long, toxic int")
    fitted = toxicity.fit(docs, labels)
    assert sum(judged(fitted, corpus(3, 100, True))) >= 95
    assert toxicity.fit(docs, labels.where("toxic = 0")) == toxicity.Model() == toxicity.fit(docs, labels.where("false"))
    assert toxicity.score(odd, fitted).where("toxic").count() == 0 and toxicity.score(odd, fitted).count() == odd.count()
    assert toxicity.drop_toxic(odd, fitted).columns == odd.columns and toxicity.drop_toxic(odd, fitted).count() == odd.count()
    assert toxicity.score(none, fitted).count() == 0 and toxicity.drop_toxic(none, fitted).count() == 0
    assert toxicity.drop_toxic(docs, fitted).count() in range(398, 410)
