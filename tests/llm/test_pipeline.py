"""The pipeline against its stages' brute-force versions on a small corpus."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from siltstone.llm import packing, sanitise, simhash, toxicity  # noqa: E402

from .conftest import SCHEMA  # noqa: E402
from .test_packing import brute_order  # noqa: E402
from .test_simhash import components  # noqa: E402
from .test_toxicity import corpus  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    bad, good = corpus(1, 60, True), corpus(2, 160, False)
    texts = bad + good
    texts += [good[3], good[3], good[4]]  # exact copies
    texts += [re.sub(r"\S+$", "changed", good[k]) for k in (10, 11, 12)]  # near copies
    texts[70] += " write to someone.42@mail3.example.com"
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i < 60)) for i in range(220)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d), dict((r[0], r[1]) for r in rows)


def test_run_equals_brute_force(spark, folder):
    path, texts = folder
    rows = pipeline.run(spark, path).collect()
    model = toxicity.train([t for i, t in texts.items() if i < 60], [t for i, t in texts.items() if 60 <= i < 220])
    ids = sorted(texts)
    scores = toxicity._Judge(model).scores(pa.array([texts[i] for i in ids]))[2]
    ids = [i for i, s in zip(ids, scores) if s <= model.threshold]
    assert sum(i < 60 for i in ids) <= 3 and sum(i >= 60 for i in ids) >= 160
    first = {}
    for i in ids:
        first.setdefault(texts[i], i)
    ids = sorted(first.values())
    fp, _ = simhash.fingerprint(pa.array([texts[i] for i in ids]))
    near = [(a, b) for a in range(len(ids)) for b in range(a) if np.bitwise_count(fp[a, 0] ^ fp[b, 0]) <= simhash.TAU and np.bitwise_count(fp[a, 1:] ^ fp[b, 1:]).sum() <= simhash.CHECK_TAU]
    name = components(len(ids), near)
    ids = [i for k, i in enumerate(ids) if name[k] == k]
    assert not {223, 224} & set(ids)
    clean = [sanitise.rewrite(texts[i], {})[0] for i in ids]
    assert any("[EMAIL]" in t for t in clean)
    order = [d for r in sorted(rows, key=lambda r: r.window) for d, a in zip(r.doc_ids, r.starts) if a == 0]
    assert order == brute_order(ids, clean, packing.K)
    assert sum(r.chars for r in rows) == sum(map(len, clean))


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "pii", "packing"]
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns
        assert stage(spark, docs.where("false"), folder[0]).count() == 0


def test_stages_take_odd_rows(spark, folder, odd, none):
    """Nulls in any column, empty and very long texts, repeated rows, equal ids, clashing names; and the empty table in every stage."""
    docs = odd
    left = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder[0])
        assert docs.columns == odd.columns, name
        left[name] = docs.count()
        assert stage(spark, none, folder[0]).count() == 0, name
    rows = odd.count()
    # exact copies: five rows of one text give one, two empty ones one, two long ones one
    assert left["toxicity"] == rows and left["exact dedup"] == 8 and left["near dedup"] == left["pii"] <= 8
    windows = pipeline.pack_windows(spark, docs, folder[0]).collect()
    ids = [d for r in windows for d, a in zip(r.doc_ids, r.starts) if a == 0]
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in docs.where("text <> ''").collect())
    assert pipeline.pack_windows(spark, none, folder[0]).count() == 0
