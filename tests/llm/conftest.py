import random

import pytest
from pyspark.sql import functions as F

WORDS = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "ginkgo", "hazel", "ivy", "juniper", "kapok", "larch", "maple", "nutmeg", "oak", "pine"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use themselves
EXTRA = ("c0", "bucket", "node", "k1", "t", "i", "rk_id", "copies", "keep_id", "v", "acts")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "en", "ish", "o", "um", "ett", "ine"]) + str(rng.randrange(10)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty, blank and very long texts, repeated rows, equal ids with other texts, clashing columns."""
    rng = random.Random(5)
    long = sentence(rng, 30000)
    rows = [
        (1, "same words in here", "en", "a", 18), (2, "same words in here", None, None, None), (2, "same words in here", None, None, None), (None, "same words in here", "en", "b", 1),
        (3, None, "en", "a", None), (None, None, None, None, None), (4, "", "en", "a", 0), (5, "", "fr", "a", 0), (6, "  \n ", "en", "a", 4), (6, "another text under that id", "en", "a", 2),
        (7, long, "en", "a", len(long)), (8, long, "en", "a", len(long)), (9, "a single quite different document stands here", "de", "c", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in EXTRA})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
