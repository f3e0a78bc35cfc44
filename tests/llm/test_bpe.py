import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import bpe

ALPHABET = ["a", "b", "é", "ß", " ", "  ", "\n", "\t", "'s", "'", "12", "!", " ", "\x1c", "漢字", "the", "😀", "\r\n", " "]


@pytest.mark.parametrize("leaf,seam", [(1, 1), (7, 2), (64, 32)])
def test_tree_equals_encoding_at_once(leaf, seam):
    c = bpe.Codec(bpe.ranks_of(), leaf, seam)
    rng = random.Random(leaf)
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(80)))
        tokens = c.encode(text)
        assert tokens == c.direct.encode_ordinary(text), repr(text)
        assert c.decode(tokens) == text.encode()


def test_texts_without_a_safe_place():
    c = bpe.Codec(bpe.ranks_of(), 50, 4)
    for text in ("a" * 3000, " " * 3000, "漢" * 2000, "ab" * 500 + " " + "!" * 900):
        assert c.encode(text) == c.direct.encode_ordinary(text)


def test_round_trip_and_odd_rows(odd, none):
    got = bpe.encode(odd)
    rows = got.collect()
    assert len(rows) == odd.count() and all(r.exact in (True, None) for r in rows)
    assert {(r.n_tokens, r.tokens is None) for r in rows if r.doc_id == 3} == {(None, True)} and [r.tokens for r in rows if r.doc_id == 4] == [[]]
    back = bpe.decode(got).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in back))) == sorted(map(repr, ((r.doc_id, r.text) for r in odd.collect())))
    assert bpe.encode(none).count() == 0
    assert bpe.decode(got.withColumn("tokens", F.array(F.lit(-1), F.lit(10**6)))).where("text IS NOT NULL").count() == 0
