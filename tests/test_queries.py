"""Registered queries against their SQL on the smallest supplied tables."""

import os

import duckdb
import pytest

from siltstone.plans import cases, queries

DATA = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "part", "events", "documents", "embeddings", "labels", "conversations")

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def shown(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", [*cases.QUERIES, "doc_triviality", "version_signals", "rot_classification", "health_score", "staleness_buckets"])
def test_query_equals_its_sql(spark, tables, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), tables.execute(queries.SQL[name]).df()
    assert shown(got) == shown(want) and len(want)
