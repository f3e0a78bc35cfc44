"""Registered queries over the supplied tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import dates as D
from siltstone.functions import text as X
from siltstone.operators import chunker, contradiction, duplication, metadata, rot, scoring, similarity, staleness, validation
from siltstone.operators.lineage import materialise
from siltstone.sources import chunk_export, documents

from . import audit as A
from . import cases

NOW = datetime(2026, 3, 15)
EXACT, NEAR, BAND = 0.40, 0.35, (0.30, 0.45)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "documents")
    docs = documents.from_table(t, "doc_id", "text", F.concat("source", F.lit("-"), "doc_id", F.lit(".txt")))
    field = lambda n, name: F.when(F.col("ordinal") % n == 0, F.create_map(F.lit(name), F.struct(F.lit("x").alias("v"), F.lit("string").alias("t")))).otherwise(F.col("frontmatter"))
    return docs.withColumns({"frontmatter": field(2, "author"), "embedded": field(3, "category")})


def _whole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk."""
    t = _table(spark, sf_dir, "documents")
    return t.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), F.concat("source", F.lit("-"), "doc_id", F.lit(".txt")).alias("filename"), F.lit(0).alias("chunk_index"), F.lit("new").alias("side"), "text")


def doc_triviality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word statistics and flags of every document."""
    t = rot.triviality(_whole_chunks(spark, sf_dir))
    return t.select(F.col("document_id").cast("long").alias("doc_id"), F.col("words").cast("long").alias("words"), "unique_ratio", F.size("hits").cast("long").alias("n_hits"), "trivial", "borderline")


def version_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version references of the documents that have any."""
    t = _table(spark, sf_dir, "documents").select("doc_id", D.sorted_hits("text", D.VERSION).alias("v"))
    return t.where(F.size("v") > 0).select("doc_id", F.array_join("v", "|").alias("versions"))


def date_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates found in sentences made of order dates in four notations."""
    o = _table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    text = F.concat(F.lit("On "), F.date_format("d", "yyyy-MM-dd"), F.lit(" in Q"), F.quarter("d"), F.lit(" "), F.year("d"), F.lit(" of FY"), F.year("d"), F.lit(", as of "), F.date_format("d", "MMMM yyyy"), F.lit("."))
    found = o.select("o_orderkey", F.explode(D.dates(text)).alias("x"))
    return found.select("o_orderkey", F.col("x.raw").alias("raw"), F.date_format("x.date", "yyyy-MM-dd").alias("found"))


def age_score_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole months and age score of every order."""
    o = _table(spark, sf_dir, "orders")
    months = D.whole_months(F.col("o_orderdate").cast("date"), F.lit(NOW.date()))
    return o.select("o_orderkey", months.cast("long").alias("months")).withColumn("age_score", D.age_score(F.col("months")))


def staleness_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chunks dated by their time: findings in each severity bucket by event type."""
    e = _table(spark, sf_dir, "events")
    chunks = e.select(F.col("event_id").cast("string").alias("chunk_id"), F.lit("new").alias("side"), F.col("event_type").alias("text"), "event_type", F.col("ts").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("modified_at"))
    s = F.col("score")
    found = staleness.assess(chunks, datetime(2024, 9, 15)).where(s > staleness.REPORT_FLOOR)
    return found.groupBy("event_type").agg(F.count_if(s > 0.8).alias("high"), F.count_if((s >= 0.5) & (s <= 0.8)).alias("review"), F.count_if(s < 0.5).alias("fresh"), F.round(F.avg("score"), 6).alias("mean_score"))


def _vectors(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    side = F.when(F.col("vec_id") % 2 == 0, "new").otherwise("existing") if split else F.lit("new")
    return _table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("chunk_id"), side.alias("side"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("document_id"), F.lit(None).cast("string").alias("filename"), F.lit(0).alias("chunk_index"))


def _shown(pairs: DataFrame, *more: str) -> DataFrame:
    return pairs.select(F.col("left_id").cast("long").alias("left_id"), F.col("right_id").cast("long").alias("right_id"), F.round("score", 6).alias("score"), *more)


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(similarity.similar(similarity.scores(_vectors(spark, sf_dir), NEAR), EXACT, NEAR), "severity")


def band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(similarity.in_band(similarity.scores(_vectors(spark, sf_dir), BAND[0]), *BAND))


def cross_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even vectors as new chunks against odd ones as the index."""
    return _shown(similarity.similar(similarity.scores(_vectors(spark, sf_dir, True), NEAR), EXACT, NEAR).where("scope = 'new_vs_existing'"), "severity")


def cross_document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return _shown(similarity.cross_document(similarity.scores(v, NEAR), v))


def exact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = materialise(similarity.similar(similarity.scores(_vectors(spark, sf_dir), NEAR), EXACT, NEAR).where("severity = 'exact'"), "query-pairs")
    return duplication.exact_clusters(pairs).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("cluster_id").cast("long").alias("cluster_id"), F.round("score", 6).alias("score"))


def near_pairs_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = materialise(similarity.similar(similarity.scores(_vectors(spark, sf_dir), NEAR), EXACT, NEAR), "query-pairs")
    return _shown(duplication.near_pairs(pairs, duplication.exact_clusters(pairs)))


def duplication_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir, True)
    return duplication.tally(materialise(similarity.similar(similarity.scores(v, NEAR), EXACT, NEAR), "query-pairs"))


def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors dated by their id: existing ones that a newer new one supersedes."""
    v = _vectors(spark, sf_dir, True)
    dated = v.select("chunk_id", "side", F.lit("").alias("text"), F.date_add(F.lit(datetime(2020, 1, 1).date()), (F.col("chunk_id").cast("int") * 37) % 2000).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("modified_at"))
    got = staleness.supersessions(similarity.scores(v, NEAR), staleness.assess(dated, NOW), NEAR)
    return got.select(F.col("left_id").cast("long").alias("left_id"), F.col("right_id").cast("long").alias("right_id"), F.round("similarity", 6).alias("similarity"), "score")


def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What judging the band pairs would cost at one token for four characters."""
    pairs = similarity.in_band(similarity.scores(_vectors(spark, sf_dir), BAND[0]), *BAND)
    asked = pairs.select("left_id", "right_id", F.concat(F.lit("compare "), "left_id", F.lit(" with "), "right_id").alias("prompt"), F.lit('{"status": "CONSISTENT"}').alias("raw_content"), F.lit(None).cast("long").alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"), F.lit(False).alias("failed"))
    return contradiction.usage(asked)


def text_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name for each distinct text, by its least document."""
    t = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), "text")
    return validation.finalize(t, "corpus")[0].select("ordinal", "filename")


def import_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as rows of a chunk export."""
    t = _table(spark, sf_dir, "conversations")
    s = lambda c: F.col(c).cast("string")
    m = F.create_map(F.lit("content"), s("text"), F.lit("doc_id"), s("conv_id"), F.lit("index"), s("turn"), F.lit("start"), F.lit("3"), F.lit("role"), s("role"))
    got = chunk_export.normalise(t.select(F.col("turn").alias("ordinal"), m.alias("m")))
    return got.select("document_id", "chunk_index", "start_char", "end_char", "text", F.col("metadata")["role"].alias("role"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of all documents."""
    return chunker.chunk(_documents(spark, sf_dir)).select(F.col("document_id").cast("long").alias("doc_id"), "chunk_index", "start_char", "end_char", "text")


def _copies(docs: DataFrame) -> DataFrame:
    """Each document with an equal text of a lesser id, as an exact pair with the least one; texts are told apart by their SHA-256, and none is shuffled."""
    t = docs.select("doc_id", F.sha2("text", 256).alias("hash"))
    least = t.groupBy("hash").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1")
    return t.join(least, "hash").where("doc_id > low").select(F.col("low").cast("string").alias("left_id"), F.col("doc_id").cast("string").alias("right_id"), F.lit(1.0).alias("score"), F.lit("new_vs_new").alias("scope"), F.lit("exact").alias("severity"))


def _classified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(chunks, duplication findings, staleness findings, classification): equal texts are exact pairs with the least id."""
    chunks = _whole_chunks(spark, sf_dir)
    pairs = materialise(_copies(_table(spark, sf_dir, "documents")), "query-pairs")
    dup = materialise(duplication.findings(pairs, chunks), "query-duplicates")
    aged = staleness.assess(chunks.withColumns({"created_at": F.lit(None).cast("timestamp"), "modified_at": F.lit(None).cast("timestamp")}), NOW)
    stale = materialise(staleness.findings(aged).drop("text"), "query-stale")
    docs = _documents(spark, sf_dir)
    none = spark.createDataFrame([], "document_id string, finding_id string")
    return chunks, dup, stale, materialise(rot.classify(docs, chunks, dup, stale, none, none, metadata.assess(docs)), "query-rot")


def rot_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _classified(spark, sf_dir)[3]
    return c.select(F.col("document_id").cast("long").alias("doc_id"), F.array_join("classifications", "|").alias("labels"), "recommendation")


def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension scores and their weighted mean for the documents, without a judge of contradictions."""
    chunks, dup, stale, classified = _classified(spark, sf_dir)
    none = spark.createDataFrame([], "finding_id string")
    average = metadata.summary(metadata.assess(_documents(spark, sf_dir)))
    row = scoring.overall(scoring.dimensions(chunks.select("chunk_id"), dup, stale, none, None, average, classified))
    return row.select("duplication", "staleness", "metadata", "rot", "overall", F.array_join("skipped", "|").alias("skipped"))


def precision_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the triviality flag with low quality labels, by language and overall."""
    flags = rot.triviality(_whole_chunks(spark, sf_dir)).select(F.col("document_id").cast("long").alias("doc_id"), "trivial")
    lang = _table(spark, sf_dir, "documents").select("doc_id", "lang")
    judged = _table(spark, sf_dir, "labels").join(flags, "doc_id").join(lang, "doc_id")
    return validation.precision(judged.select(F.col("lang").alias("category"), (F.col("trivial") == (F.col("quality") == 0)).alias("correct")))


def audit_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole audit of the benchmark passages against conversation turns: the classified documents."""
    t = _table(spark, sf_dir, "benchmark")
    docs = documents.from_table(t, "item_id", "text", F.concat(F.lit("item-"), "item_id", F.lit(".txt")))
    turns = _table(spark, sf_dir, "conversations")
    m = F.create_map(F.lit("text"), F.col("text"), F.lit("doc_id"), F.col("conv_id").cast("string"))
    existing = chunk_export.normalise(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), m.alias("m")))
    result = A.audit(docs, A.AuditConfig(NOW, chunks=chunker.ChunkConfig(300, 30)), existing)
    return result.rot.select("document_id", F.array_join("classifications", "|").alias("labels"), "duplicate_ratio", "avg_stale")


# RE2 knows ASCII word boundaries only: other letters become underscores and other signs spaces, which leaves all boundaries as they are
_ASCII = r"regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{L}\p{M}\p{Nd}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
_TRIVIAL = rf"""
w AS (SELECT doc_id, lang, source, lower({_ASCII}) AS t, regexp_extract_all(lower({_ASCII}), '\b[a-z0-9][a-z0-9''\-]*\b') AS w FROM documents),
h AS (SELECT *, len(w) AS words, CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w)::DOUBLE ELSE 0 END AS ur,
  {" + ".join(f"(contains(t, '{p}'))::INT" for p in X.BOILERPLATE)} AS n_hits FROM w),
f AS (SELECT *, coalesce((words < 20 AND ur < 0.5) OR (words < 30 AND ur < 0.4) OR ur < 0.3 OR (n_hits > 0 AND words < 80), false) AS trivial FROM h),
d AS (SELECT *, round(ur, 3) AS unique_ratio, round(n_hits / greatest(words, 1)::DOUBLE, 3) AS bp FROM f)"""
_PAIRS = """
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS l FROM v),
p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, list_dot_product(a.e, b.e) / (a.l * b.l) AS score, a.label AS la, b.label AS lb FROM u a JOIN u b ON a.vec_id < b.vec_id),
x AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, list_dot_product(a.e, b.e) / (a.l * b.l) AS score FROM u a JOIN u b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)"""
_SEVERITY = f"CASE WHEN score >= {EXACT} THEN 'exact' ELSE 'near_duplicate' END"
_CLUSTERS = f"""
e AS (SELECT left_id, right_id, score FROM p WHERE score >= {EXACT}),
s AS (SELECT left_id AS a, right_id AS b FROM e UNION ALL SELECT right_id, left_id FROM e),
r AS (SELECT a AS n, a AS c FROM s UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.n),
m AS (SELECT n AS chunk_id, min(c) AS cluster_id FROM r GROUP BY n),
k AS (SELECT m.cluster_id, min(e.score) AS score FROM e JOIN m ON m.chunk_id = e.left_id GROUP BY m.cluster_id)"""
_MONTHS = "greatest((year(DATE '{now}') - year({d})) * 12 + month(DATE '{now}') - month({d}) - CASE WHEN day(DATE '{now}') < day({d}) THEN 1 ELSE 0 END, 0)"
_AGE = "CASE WHEN m <= 0 THEN 0.0::DOUBLE ELSE round(least(1 - exp(-m / 12.0::DOUBLE), 1.0), 3) END"
_STATE = """
z AS (SELECT d.doc_id, d.trivial, d.text_copies, d.t,
  CASE WHEN (words < 30 AND unique_ratio < 0.4) OR trivial OR bp > 0.04 THEN 'trivial' WHEN words >= 45 AND unique_ratio >= 0.45 AND bp < 0.02 THEN 'healthy' ELSE 'open' END AS state
  FROM (SELECT d.*, c.n AS text_copies FROM d JOIN documents o USING (doc_id) JOIN (SELECT text, count(*) AS n FROM documents GROUP BY text) c ON c.text = o.text) d)"""

SQL = {
    "doc_triviality": f"WITH {_TRIVIAL} SELECT doc_id, words::BIGINT AS words, unique_ratio, n_hits::BIGINT AS n_hits, trivial, NOT trivial AND (words < 40 OR (ur >= 0.35 AND ur < 0.45) OR n_hits > 0) AS borderline FROM d",
    "version_signals": rf"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower({_ASCII}), '\b(?:version|v)\s*\d+(?:\.\d+)+\b'))), '|') AS versions FROM documents WHERE regexp_matches(lower({_ASCII}), '\b(?:version|v)\s*\d+(?:\.\d+)+\b')",
    "date_signals": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)
        SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS raw, strftime(d, '%Y-%m-%d') AS found FROM o
        UNION ALL SELECT o_orderkey, 'Q' || quarter(d) || ' ' || year(d), strftime(make_date(year(d), quarter(d) * 3, 1), '%Y-%m-%d') FROM o
        UNION ALL SELECT o_orderkey, 'FY' || year(d), year(d) || '-12-01' FROM o
        UNION ALL SELECT o_orderkey, 'as of ' || strftime(d, '%B %Y'), strftime(d, '%Y-%m-01') FROM o""",
    "age_score_curve": f"WITH a AS (SELECT o_orderkey, {_MONTHS.format(now='2026-03-15', d='o_orderdate')} AS m FROM orders) SELECT o_orderkey, m::BIGINT AS months, {_AGE} AS age_score FROM a",
    "staleness_buckets": f"WITH a AS (SELECT event_type, {_MONTHS.format(now='2024-09-15', d='ts')} AS m FROM events), b AS (SELECT event_type, {_AGE} AS s FROM a) SELECT event_type, count(*) FILTER (s > 0.8) AS high, count(*) FILTER (s >= 0.5 AND s <= 0.8) AS review, count(*) FILTER (s < 0.5) AS fresh, round(avg(s), 6) AS mean_score FROM b WHERE s > 0.2 GROUP BY event_type",
    "similar_pairs": f"WITH {_PAIRS} SELECT left_id, right_id, round(score, 6) AS score, {_SEVERITY} AS severity FROM p WHERE score >= {NEAR}",
    "band_pairs": f"WITH {_PAIRS} SELECT left_id, right_id, round(score, 6) AS score FROM p WHERE score BETWEEN {BAND[0]} AND {BAND[1]}",
    "cross_pairs": f"WITH {_PAIRS} SELECT left_id, right_id, round(score, 6) AS score, {_SEVERITY} AS severity FROM x WHERE score >= {NEAR}",
    "cross_document_pairs": f"WITH {_PAIRS} SELECT left_id, right_id, round(score, 6) AS score FROM p WHERE score >= {NEAR} AND la <> lb",
    "exact_clusters": f"WITH RECURSIVE {_PAIRS}, {_CLUSTERS} SELECT m.chunk_id, m.cluster_id, round(k.score, 6) AS score FROM m JOIN k USING (cluster_id)",
    "near_pairs_suppressed": f"WITH RECURSIVE {_PAIRS}, {_CLUSTERS} SELECT left_id, right_id, round(score, 6) AS score FROM p WHERE score >= {NEAR} AND score < {EXACT} AND NOT (left_id IN (SELECT chunk_id FROM m) AND right_id IN (SELECT chunk_id FROM m))",
    "duplication_counts": f"""WITH RECURSIVE {_PAIRS.replace("a.vec_id < b.vec_id", "a.vec_id < b.vec_id AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 0")}, {_CLUSTERS}
        SELECT (SELECT count(DISTINCT cluster_id) FROM m) AS exact, (SELECT count(*) FROM x WHERE score >= {NEAR}) AS already_in_index,
        (SELECT count(*) FROM p WHERE score >= {NEAR} AND score < {EXACT} AND NOT (left_id IN (SELECT chunk_id FROM m) AND right_id IN (SELECT chunk_id FROM m))) AS near_duplicate""",
    "supersession": f"""WITH {_PAIRS}, t AS (SELECT vec_id, DATE '2020-01-01' + ((vec_id * 37) % 2000)::INTEGER AS d FROM embeddings), a AS (SELECT vec_id, d, {_MONTHS.format(now='2026-03-15', d='d')} AS m FROM t), b AS (SELECT vec_id, d, {_AGE} AS s FROM a)
        SELECT left_id, right_id, round(score, 6) AS similarity, o.s AS score FROM x JOIN b n ON n.vec_id = left_id JOIN b o ON o.vec_id = right_id WHERE x.score >= {NEAR} AND o.s > 0.2 AND n.d > o.d + 1""",
    "token_cost": f"""WITH {_PAIRS}, c AS (SELECT count(*) AS calls, (count(*) * 10)::BIGINT AS pt, (count(*) * 6)::BIGINT AS ct FROM p WHERE score BETWEEN {BAND[0]} AND {BAND[1]})
        SELECT calls, 0::BIGINT AS failed_calls, pt AS prompt_tokens, ct AS completion_tokens, round((0.3::DOUBLE * pt + 1.2::DOUBLE * ct) / 1e6, 6) AS cost FROM c""",
    "text_duplicates": "SELECT ordinal, 'corpus-' || lpad(row_number() OVER (ORDER BY ordinal)::VARCHAR, greatest(4, len(row_number() OVER (ORDER BY ordinal)::VARCHAR))::INTEGER, '0') || '.txt' AS filename FROM (SELECT min(doc_id) AS ordinal FROM documents GROUP BY text)",
    "import_normalised": "SELECT conv_id::VARCHAR AS document_id, turn::INTEGER AS chunk_index, 3 AS start_char, (3 + length(trim(text)))::INTEGER AS end_char, trim(text) AS text, role FROM conversations WHERE trim(text) <> ''",
    "rot_classification": f"WITH {_TRIVIAL}, {_STATE} SELECT doc_id, CASE WHEN text_copies > 1 AND state = 'trivial' THEN 'redundant|trivial' WHEN text_copies > 1 THEN 'redundant' WHEN state = 'trivial' THEN 'trivial' ELSE 'healthy' END AS labels, CASE WHEN text_copies > 1 THEN 'Remove or merge' WHEN state = 'trivial' THEN 'Review for substance' ELSE 'Keep' END AS recommendation FROM z",
    "health_score": rf"""WITH {_TRIVIAL}, {_STATE},
        g AS (SELECT round(greatest(0, 1 - count(*) FILTER (text_copies > 1) / count(*)::DOUBLE) * 100, 1) AS duplication,
          round((1 - avg(CASE WHEN regexp_matches(t, '\b(?:currently|this year|recently|at this time|as of now|today|current)\b') THEN CASE WHEN regexp_matches(t, '\b(?:version|v)\s*\d+(?:\.\d+)+\b') THEN 0.65 ELSE 0.6 END WHEN regexp_matches(t, '\b(?:version|v)\s*\d+(?:\.\d+)+\b') THEN 0.4 ELSE 0.5 END::DOUBLE)) * 100, 1) AS staleness,
          round(round(avg(round((1 + (doc_id % 2 = 0)::INT + (doc_id % 3 = 0)::INT) / 6.0::DOUBLE, 3)), 3) * 100, 1) AS metadata, round(count(*) FILTER (text_copies = 1 AND state <> 'trivial') / count(*)::DOUBLE * 100, 1) AS rot FROM z)
        SELECT *, round((duplication * 0.25 + staleness * 0.2 + metadata * 0.1 + rot * 0.2) / 0.75, 1) AS overall, 'contradictions' AS skipped FROM g""",
    "precision_report": f"WITH {_TRIVIAL} SELECT coalesce(lang, 'overall') AS category, count(*) AS judged, count(*) FILTER (trivial = (quality = 0)) AS correct, round(count(*) FILTER (trivial = (quality = 0)) / count(*)::DOUBLE, 3) AS precision FROM d JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        health_score, rot_classification, doc_triviality, version_signals, date_signals, age_score_curve, staleness_buckets,
        similar_pairs, band_pairs, cross_pairs, cross_document_pairs, exact_clusters, near_pairs_suppressed, duplication_counts, supersession, token_cost,
        text_duplicates, import_normalised, chunk_documents, precision_report, audit_benchmark,
    )
}
QUERIES |= cases.QUERIES
SQL |= cases.SQL
