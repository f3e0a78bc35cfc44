"""Registered queries over cases made from the supplied tables, one for each rule of the passes, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import chunker, contradiction, duplication, metadata, rot, scoring, staleness
from siltstone.operators.chunker import ChunkConfig
from siltstone.sources.documents import VALUE

CONTENT_NOW = datetime(2002, 1, 1)
NOTES = ("TBD", "ToDo", "a Placeholder", "draft", "N/A", "to be determined", "Agenda", "action items: none", "nothing special", "final")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: str, *values: Column) -> Column:
    """One of the values, by key modulo their number."""
    return F.element_at(F.array(*values), (F.col(key) % len(values) + 1).cast("int"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("date").alias("d"))


def boilerplate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on orders that contain each boilerplate phrase."""
    note = F.concat(F.lit("Order "), "k", F.lit(": "), _pick("k", *map(F.lit, NOTES)), F.lit("."))
    hit = _orders(spark, sf_dir).select(F.explode(X.boilerplate_hits(note)).alias("phrase"))
    return hit.groupBy("phrase").agg(F.count("*").alias("documents"))


def content_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staleness of sentences with an ISO date and, by turns, a fiscal year, a cue and a version."""
    also = lambda n, *c: F.when(F.col("k") % n == 0, F.concat(*c)).otherwise("")
    text = F.concat(F.lit("Entered on "), F.date_format("d", "yyyy-MM-dd"), also(3, F.lit(" for FY"), F.year("d") + 1), also(4, F.lit(", Currently open")), also(5, F.lit(", version 1."), F.col("k") % 10), F.lit("."))
    none = F.lit(None).cast("timestamp")
    chunks = _orders(spark, sf_dir).select(F.col("k").cast("string").alias("chunk_id"), "k", F.lit("new").alias("side"), text.alias("text"), none.alias("created_at"), none.alias("modified_at"))
    return staleness.assess(chunks, CONTENT_NOW).select("k", "text_score", "confidence", "score", F.date_format("text_date", "yyyy-MM-dd").alias("text_date"))


def metadata_date_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staleness of orders as chunks, dated by their customers' documents where these have dates, else by metadata in several notations."""
    kv = lambda *x: F.create_map(*(F.lit(v) if isinstance(v, str) else v for v in x))
    on = lambda f: F.date_format("d", f)
    meta = _pick("k", kv("created", on("yyyy-MM-dd")), kv("date_created", on("yyyy/M/d")), kv("modified_at", on("M/d/yyyy")), kv("created", F.lit(" "), "updated", F.concat(on("yyyy-MM-dd"), F.lit("T00:00:00"))), kv("topic", F.lit("x")))
    chunks = _orders(spark, sf_dir).select("k", F.col("k").cast("string").alias("chunk_id"), F.col("c").cast("string").alias("document_id"), F.lit("new").alias("side"), F.lit("plain words").alias("text"), meta.alias("metadata"))
    day = F.date_add(F.lit(datetime(1996, 1, 1).date()), F.col("c_custkey").cast("int")).cast("timestamp")
    docs = _table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("document_id"), day.alias("created_at"), F.lit(None).cast("timestamp").alias("modified_at"))
    got = staleness.assess(staleness.metadata_dates(chunks, docs), CONTENT_NOW)
    return got.select("k", "meta_score", "score", F.date_format("reference_date", "yyyy-MM-dd").alias("dated"))


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents with names and metadata of many kinds."""
    s = lambda v: F.struct(F.lit(v).alias("v"), F.lit("string").alias("t"))
    some = lambda n, name, v: F.when(F.col("k") % n == 0, F.create_map(F.lit(name), v)).otherwise(F.create_map().cast(f"map<string,{VALUE}>"))
    updated = _pick("k", s("2024-01-02T03:04"), s("2024-01-02"), s("1/2/2024"), s("March 4, 2024"), s(" "), F.struct(F.lit("2024-01-02T00:00:00").alias("v"), F.lit("datetime").alias("t")))
    name = _pick("k", F.concat(F.lit("scan "), "k", F.lit(".pdf")), F.concat(F.lit("Doc_"), "k", F.lit(".md")), F.concat(F.lit("report-"), "k", F.lit(".txt")), F.concat(F.lit("file  "), "k", F.lit(".txt")))
    stamp = lambda c: c.cast("timestamp")
    return _orders(spark, sf_dir).select(
        F.col("k").cast("string").alias("document_id"),
        F.col("k").alias("ordinal"),
        name.alias("filename"),
        F.lit(1).cast("long").alias("file_size"),
        F.when(F.col("k") % 8 == 0, stamp(F.col("d"))).alias("created_at"),
        F.lit(None).cast("timestamp").alias("modified_at"),
        F.map_concat(some(2, "author", s("Ann")), some(5, "title", s("T"))).alias("embedded"),
        F.map_concat(F.create_map(F.lit("updated"), updated), some(3, "version", s("2")), some(7, "category", s("policy"))).alias("frontmatter"),
    )


def metadata_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness, gaps, date formats and inconsistencies of every document."""
    joined = lambda c: F.array_join(c, "|").alias(c)
    a = metadata.assess(_described(spark, sf_dir))
    return a.select(F.col("ordinal").alias("k"), "completeness", joined("missing_fields"), joined("date_formats"), joined("consistency_issues"))


def metadata_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.summary(metadata.assess(_described(spark, sf_dir))).select("average_completeness", F.array_join("consistency_issues", "|").alias("issues"))


def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.missing_counts(metadata.assess(_described(spark, sf_dir)))


def custom_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness for fields that a user asks for, known by alias, by any metadata key or by a column."""
    a = metadata.assess(_described(spark, sf_dir), ["Document title", "owner", "Product version", "updated", "extension", "jurisdiction"])
    return a.select(F.col("ordinal").alias("k"), "completeness", F.array_join("missing_fields", "|").alias("missing_fields"))


ANSWERS = (
    '```json\n{"status": "contradiction", "severity": "HIGH", "claim_a": " x ", "claim_b": "y", "explanation": "e"}\n```',
    '{"status": "CONTRADICTION", "explanation": "these may differ"}',
    '{"status": "CONTRADICTION", "claim_a": "x", "claim_b": "y"}',
    '{"status": "CONTRADICTION", "severity": "odd", "claim_a": "x"}',
    '{"status": "CONTRADICTION"}',
    "not json",
    "[1]",
    '{"status": "maybe", "claim_a": "x"}',
)


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).select(F.col("k").cast("string").alias("left_id"), F.col("c").cast("string").alias("right_id"), ((F.col("k") % 997) / 997.0).alias("score"), F.lit("new_vs_new").alias("scope"), _pick("k", *map(F.lit, ANSWERS), F.lit(None).cast("string")).alias("raw_content"))
    return contradiction.findings(contradiction.verdicts(o))


def verdict_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions among answers that are fenced, malformed, hedged or incomplete."""
    return _answered(spark, sf_dir).select(F.col("left_id").cast("long").alias("k"), "similarity", "severity", "claim_a", "claim_b", "explanation")


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contradiction.severity_counts(_answered(spark, sf_dir))


def _audited(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Findings of all passes for orders as the chunks of their customers' documents."""
    o = _orders(spark, sf_dir).select(F.col("k").cast("string").alias("chunk_id"), F.col("c").cast("string").alias("document_id"), F.when(F.col("status") == "P", "existing").otherwise("new").alias("side"), "status", "priority", ((F.col("k") % 997) / 997.0).alias("score"))
    kind = F.when(F.col("priority").startswith("1"), "exact").when(F.col("priority").startswith("2"), "already_in_index").otherwise("near_duplicate")
    member = F.struct("chunk_id", "document_id", F.lit("f").alias("filename"), F.lit(0).alias("chunk_index"), "side")
    c = _table(spark, sf_dir, "customer")
    label = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("redundant"))).when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("outdated"), F.lit("trivial"))).otherwise(F.array(F.lit("healthy")))
    contra = o.where("priority LIKE '5%'").select(F.col("chunk_id").alias("finding_id"), "document_id")
    return {
        "documents": c.select(F.col("c_custkey").cast("string").alias("document_id")),
        "chunks": o,
        "duplicates": o.where("status = 'F'").select(kind.alias("finding_type"), F.col("chunk_id").alias("finding_id"), F.lit(1.0).alias("score"), F.array(member).alias("members")),
        "stale": o.where("side = 'new' AND score > 0.2").select("chunk_id", "document_id", "score"),
        "contradictions": contra.select("finding_id"),
        "contradiction_docs": contra,
        "rot": c.select(F.col("c_custkey").cast("string").alias("document_id"), label.alias("classifications"), ((F.col("c_custkey") % 11) / 10.0).alias("completeness")),
    }


def projected_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension scores now and after clean-up, with contradictions judged."""
    a = _audited(spark, sf_dir)
    average = a["rot"].agg(F.round(F.avg("completeness"), 3).alias("average_completeness"))
    now = scoring.dimensions(a["chunks"].where("side = 'new'").select("chunk_id"), a["duplicates"], a["stale"], a["contradictions"], a["chunks"], average, a["rot"])
    after = scoring.projected(a["chunks"], a["duplicates"], a["stale"], a["contradictions"], a["contradiction_docs"], a["chunks"], a["rot"])
    rows = [scoring.overall(r).select(F.lit(s).alias("state"), *scoring.WEIGHTS, "overall") for s, r in (("now", now), ("after", after))]
    return rows[0].unionByName(rows[1])


def issue_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary's counters, documents with issues among them."""
    a = _audited(spark, sf_dir)
    sick = a["rot"].where(~F.array_contains("classifications", "healthy"))
    issues = scoring.documents_with_issues(a["documents"], duplication.memberships(a["duplicates"]).where("side = 'new'"), a["stale"], a["contradiction_docs"], a["rot"].where("completeness < 0.5"), sick)
    return scoring.counters(a["documents"], a["chunks"], a["duplicates"], a["stale"], a["contradictions"], a["contradictions"], a["rot"], issues)


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 20 characters with an overlap of 5 of parts' descriptions."""
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type", "p_name", "p_size")
    docs = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("document_id"), F.lit("f").alias("filename"), text.alias("text"))
    got = chunker.chunk(docs, ChunkConfig(20, 5))
    return got.select(F.col("document_id").cast("long").alias("k"), "chunk_index", "start_char", "end_char", "text")


def document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether conversations, turns being their chunks, are trivial, healthy or open."""
    t = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), "text")
    got = rot.document_triviality(rot.triviality(t))
    return got.select(F.col("document_id").alias("conv_id"), "chunks", F.round("avg_words", 6).alias("avg_words"), F.round("avg_unique", 6).alias("avg_unique"), F.round("trivial_share", 6).alias("trivial_share"), "state")


def document_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate, staleness, supersession and contradiction signals of customers' documents and the labels that follow from them."""
    a = _audited(spark, sf_dir)
    chunks = a["chunks"].withColumn("text", F.concat_ws(" ", F.lit("nine quite different words stand in this short text"), "chunk_id"))
    docs = a["documents"].withColumns({"ordinal": F.col("document_id").cast("long"), "filename": F.col("document_id")})
    over = a["chunks"].where("priority LIKE '4%' AND status = 'P'").select("document_id", F.col("chunk_id").alias("finding_id"))
    got = rot.classify(docs, chunks, a["duplicates"], a["stale"], over, a["contradiction_docs"], a["rot"].select("document_id", "completeness"))
    return got.select(F.col("document_id").cast("long").alias("c"), "chunks", "duplicated", "duplicate_ratio", "avg_stale", "stale_chunks", "max_stale", "superseded", "contradictions", F.array_join("classifications", "|").alias("labels"))


_MONTHS = "greatest((2002 - year({d})) * 12 + 1 - month({d}) - CASE WHEN 1 < day({d}) THEN 1 ELSE 0 END, 0)"
_AGE = "CASE WHEN {m} <= 0 THEN 0.0::DOUBLE ELSE round(least(1 - exp(-({m}) / 12.0::DOUBLE), 1.0), 3) END"
_age = lambda d: _AGE.format(m=_MONTHS.format(d=d))
_DESCRIBED = """
m AS (SELECT o_orderkey AS k, o_orderkey % 5 = 0 OR o_orderkey % 4 >= 2 AS title, o_orderkey % 2 = 0 AS author, o_orderkey % 8 = 0 AS created, o_orderkey % 6 <> 4 AS modified, o_orderkey % 3 = 0 AS version, o_orderkey % 7 = 0 AS kind FROM orders),
n AS (SELECT *, title::INT + author::INT + created::INT + modified::INT + version::INT + kind::INT AS have,
  array_to_string(list_filter([CASE WHEN NOT title THEN 'title' END, CASE WHEN NOT author THEN 'author' END, CASE WHEN NOT created THEN 'created date' END, CASE WHEN NOT modified THEN 'modified date' END, CASE WHEN NOT version THEN 'version' END, CASE WHEN NOT kind THEN 'document type' END], lambda x: x IS NOT NULL), '|') AS missing_fields,
  list_sort(list_filter([CASE WHEN created THEN 'normalized_datetime' END, CASE k % 6 WHEN 0 THEN 'iso_datetime' WHEN 1 THEN 'iso_date' WHEN 2 THEN 'slash_date' WHEN 3 THEN 'month_name' WHEN 5 THEN 'datetime_object' END], lambda x: x IS NOT NULL)) AS f FROM m),
a AS (SELECT *, round(have / 6.0::DOUBLE, 3) AS completeness FROM n)"""
_AUDITED = """
o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p, o_orderstatus <> 'P' AS new, (o_orderkey % 997) / 997.0::DOUBLE AS score FROM orders),
r AS (SELECT c_custkey AS c, c_mktsegment = 'BUILDING' AS redundant, c_mktsegment = 'MACHINERY' AS old, (c_custkey % 11) / 10.0::DOUBLE AS complete FROM customer),
gone AS (SELECT c FROM r WHERE redundant)"""
_ASCII = r"regexp_replace(regexp_replace(lower(text), '[^\x00-\x7F\p{L}\p{M}\p{Nd}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
_SCORE = "round((duplication * 0.25 + staleness * 0.2 + contradictions * 0.25 + metadata * 0.1 + rot * 0.2) / 1.0, 1)"
_TEXT = "concat_ws(' ', p_name, p_brand, p_type, p_name, p_size)"

SQL = {
    "boilerplate_hits": "WITH t AS (SELECT lower((['TBD', 'ToDo', 'a Placeholder', 'draft', 'N/A', 'to be determined', 'Agenda', 'action items: none', 'nothing special', 'final'])[(o_orderkey % 10 + 1)::INT]) AS x FROM orders) SELECT phrase, count(*) AS documents FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS phrase FROM t WHERE contains(x, '{p}')" for p in X.BOILERPLATE) + ") GROUP BY phrase",
    "content_scores": f"""WITH t AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, o_orderkey % 3 = 0 AS fy, o_orderkey % 4 = 0 AS cue, o_orderkey % 5 = 0 AS ver, make_date(year(o_orderdate) + 1, 12, 1) AS e FROM orders),
        a AS (SELECT *, {_age("d")} AS x, {_age("e")} AS y FROM t),
        b AS (SELECT *, CASE WHEN fy THEN 2 ELSE 1 END AS n, CASE WHEN fy THEN least(x, y) ELSE x END AS s0, (x >= 0.7)::INT + (fy AND y >= 0.7)::INT >= 0.75 * (CASE WHEN fy THEN 2 ELSE 1 END) AS old FROM a),
        c AS (SELECT *, CASE WHEN old AND s0 >= 0.7 THEN least(s0 + least(0.2::DOUBLE, 0.08::DOUBLE * (n - 1)), 1.0::DOUBLE) ELSE s0 END AS s1 FROM b),
        e AS (SELECT *, CASE WHEN cue AND s1 >= 0.5 THEN least(s1 + 0.1::DOUBLE, 1.0::DOUBLE) ELSE s1 END AS s2 FROM c),
        g AS (SELECT *, CASE WHEN ver AND s2 >= 0.5 THEN least(s2 + 0.05::DOUBLE, 1.0::DOUBLE) ELSE s2 END AS s3 FROM e)
        SELECT k, s3 AS text_score, round(least(0.55::DOUBLE + least(0.24::DOUBLE, 0.14::DOUBLE * (n - 1)) + CASE WHEN old THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN cue THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN ver THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END, 0.95::DOUBLE), 3) AS confidence, round(s3, 3) AS score,
        strftime(CASE WHEN fy THEN greatest(d, make_date(year(d) + 1, 12, 1)) ELSE d END, '%Y-%m-%d') AS text_date FROM g""",
    "metadata_date_scores": f"""WITH t AS (SELECT o.o_orderkey AS k, CASE WHEN c.c_custkey IS NOT NULL THEN DATE '1996-01-01' + c.c_custkey::INT WHEN o.o_orderkey % 5 < 4 THEN o.o_orderdate::DATE END AS d FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal < 0),
        a AS (SELECT k, d, CASE WHEN d IS NOT NULL THEN {_age("d")} END AS s FROM t)
        SELECT k, s AS meta_score, coalesce(s, 0.5::DOUBLE) AS score, strftime(d, '%Y-%m-%d') AS dated FROM a""",
    "metadata_completeness": f"WITH {_DESCRIBED} SELECT k, completeness, missing_fields, array_to_string(f, '|') AS date_formats, CASE WHEN len(f) > 0 THEN 'mixed date formats' ELSE 'no date while other documents have one' END AS consistency_issues FROM a",
    "metadata_summary": f"WITH {_DESCRIBED} SELECT round(avg(completeness), 3) AS average_completeness, 'mixed date formats|dates on some documents only' AS issues FROM a HAVING count(*) FILTER (len(f) = 0) > 0 AND count(DISTINCT f) > 1",
    "missing_fields": f"WITH {_DESCRIBED} SELECT field, count(*) AS documents FROM (SELECT unnest(string_split(missing_fields, '|')) AS field FROM a WHERE missing_fields <> '') GROUP BY field",
    "custom_fields": f"WITH {_DESCRIBED} SELECT k, round((title::INT + author::INT + version::INT + modified::INT + 1) / 6.0::DOUBLE, 3) AS completeness, array_to_string(list_filter([CASE WHEN NOT title THEN 'Document title' END, CASE WHEN NOT author THEN 'owner' END, CASE WHEN NOT version THEN 'Product version' END, CASE WHEN NOT modified THEN 'updated' END, 'jurisdiction'], lambda x: x IS NOT NULL), '|') AS missing_fields FROM a",
    "verdict_findings": "SELECT o_orderkey AS k, round((o_orderkey % 997) / 997.0::DOUBLE, 3) AS similarity, CASE o_orderkey % 9 WHEN 0 THEN 'high' WHEN 2 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN o_orderkey % 9 = 1 THEN '' ELSE 'x' END AS claim_a, CASE WHEN o_orderkey % 9 IN (0, 2) THEN 'y' ELSE '' END AS claim_b, CASE o_orderkey % 9 WHEN 0 THEN 'e' WHEN 1 THEN 'these may differ' ELSE '' END AS explanation FROM orders WHERE o_orderkey % 9 < 4",
    "verdict_counts": "SELECT count(*) FILTER (o_orderkey % 9 IN (0, 2)) AS high, count(*) FILTER (o_orderkey % 9 IN (1, 3)) AS medium FROM orders",
    "projected_health": f"""WITH {_AUDITED},
        now AS (SELECT 'now' AS state, round(greatest(0, 1 - (SELECT count(*) FROM o WHERE new AND s = 'F') / (SELECT count(*) FROM o WHERE new)::DOUBLE) * 100, 1) AS duplication, round((1 - (SELECT avg(score) FROM o WHERE new AND score > 0.2)) * 100, 1) AS staleness,
          round(greatest(0, 1 - (SELECT count(*) FROM o WHERE p LIKE '5%') / (SELECT count(*) FROM o)::DOUBLE) * 100, 1) AS contradictions, round((SELECT round(avg(complete), 3) FROM r) * 100, 1) AS metadata, round((SELECT count(*) FILTER (NOT redundant AND NOT old) / count(*)::DOUBLE FROM r) * 100, 1) AS rot),
        after AS (SELECT 'after' AS state, 100.0::DOUBLE AS duplication, round((1 - (SELECT avg(score) FROM o WHERE new AND score > 0.2 AND score <= 0.7 AND c NOT IN (SELECT c FROM gone))) * 100, 1) AS staleness,
          round(greatest(0, 1 - (SELECT count(*) FROM o WHERE p LIKE '5%' AND c NOT IN (SELECT c FROM gone)) / (SELECT count(*) FROM o)::DOUBLE) * 100, 1) AS contradictions, round((SELECT avg(complete) FROM r WHERE NOT redundant) * 100, 1) AS metadata, round((SELECT count(*) FILTER (NOT old) / count(*)::DOUBLE FROM r WHERE NOT redundant) * 100, 1) AS rot)
        SELECT *, {_SCORE} AS overall FROM (SELECT * FROM now UNION ALL SELECT * FROM after)""",
    "issue_counters": f"""WITH {_AUDITED}, i AS (SELECT c FROM o WHERE new AND s = 'F' UNION SELECT c FROM o WHERE new AND score > 0.2 UNION SELECT c FROM o WHERE p LIKE '5%' UNION SELECT c FROM r WHERE complete < 0.5 OR redundant OR old)
        SELECT (SELECT count(*) FROM r) AS documents, (SELECT count(*) FROM o WHERE new) AS chunks, (SELECT count(*) FROM o WHERE s = 'F' AND p NOT LIKE '2%') AS duplicate_clusters, (SELECT count(*) FROM o WHERE new AND score > 0.7) AS stale_chunks, (SELECT count(*) FROM o WHERE p LIKE '5%') AS superseded, (SELECT count(*) FROM o WHERE p LIKE '5%') AS contradictions, (SELECT count(*) FROM gone) AS removable_documents, (SELECT count(*) FROM r WHERE c IN (SELECT c FROM i)) AS documents_with_issues""",
    "chunk_windows": f"""WITH RECURSIVE t AS (SELECT p_partkey AS k, {_TEXT} AS s, length({_TEXT}) AS n FROM part),
        w AS (SELECT k, s, n, 0::BIGINT AS a, coalesce(list_max(list_filter(range(1, least(20, n) + 1), lambda e: e = n OR (n > 20 AND substring(s, e, 1) = ' '))), least(20, n)) AS b FROM t
          UNION ALL SELECT k, s, n, x, coalesce(list_max(list_filter(range(x + 1, least(x + 20, n) + 1), lambda e: e = n OR substring(s, e, 1) = ' ')), least(x + 20, n)) FROM (SELECT k, s, n, greatest(b - 5, a + 1) AS x FROM w WHERE b < n)),
        c AS (SELECT k, a, substring(s, a + 1, b - a) AS body FROM w)
        SELECT k, (row_number() OVER (PARTITION BY k ORDER BY a) - 1)::INT AS chunk_index, (a + length(body) - length(ltrim(body)))::INT AS start_char, (a + length(rtrim(body)))::INT AS end_char, trim(body) AS text FROM c WHERE trim(body) <> ''""",
    "document_states": rf"""WITH w AS (SELECT conv_id, {_ASCII} AS t, regexp_extract_all({_ASCII}, '\b[a-z0-9][a-z0-9''\-]*\b') AS w FROM conversations),
        h AS (SELECT *, len(w) AS words, CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w)::DOUBLE ELSE 0 END AS ur, {" + ".join(f"(contains(t, '{p}'))::INT" for p in X.BOILERPLATE)} AS n FROM w),
        f AS (SELECT *, coalesce((words < 20 AND ur < 0.5) OR (words < 30 AND ur < 0.4) OR ur < 0.3 OR (n > 0 AND words < 80), false) AS trivial FROM h),
        d AS (SELECT conv_id, count(*) AS chunks, avg(words) AS aw, avg(round(ur, 3)) AS au, avg(round(n / greatest(words, 1)::DOUBLE, 3)) AS ab, avg(trivial::INT) AS ts FROM f GROUP BY conv_id)
        SELECT conv_id, chunks, round(aw, 6) AS avg_words, round(au, 6) AS avg_unique, round(ts, 6) AS trivial_share, CASE WHEN (aw < 30 AND au < 0.4) OR ts >= 0.5 OR ab > 0.04 THEN 'trivial' WHEN aw >= 45 AND au >= 0.45 AND ab < 0.02 AND ts < 0.34 THEN 'healthy' ELSE 'open' END AS state FROM d""",
    "document_signals": f"""WITH {_AUDITED}, g AS (SELECT c, count(*) FILTER (new) AS chunks, count(*) FILTER (new AND s = 'F') AS duplicated, coalesce(round(avg(score) FILTER (new AND score > 0.2), 3), 0) AS avg_stale, count(*) FILTER (new AND score > 0.7) AS stale_chunks, coalesce(max(score) FILTER (new AND score > 0.2), 0) AS max_stale, count(*) FILTER (p LIKE '4%' AND s = 'P') AS superseded, count(*) FILTER (p LIKE '5%') AS contradictions FROM o GROUP BY c),
        j AS (SELECT r.c, coalesce(chunks, 0) AS chunks, coalesce(duplicated, 0) AS duplicated, coalesce(avg_stale, 0) AS avg_stale, coalesce(stale_chunks, 0) AS stale_chunks, coalesce(max_stale, 0) AS max_stale, coalesce(superseded, 0) AS superseded, coalesce(contradictions, 0) AS contradictions FROM r LEFT JOIN g USING (c)),
        l AS (SELECT *, round(duplicated / greatest(chunks, 1)::DOUBLE, 3) AS duplicate_ratio, duplicated / greatest(chunks, 1)::DOUBLE >= 0.5 OR (duplicated > 0 AND chunks <= 1) AS x, avg_stale > 0.7 OR superseded > 0 AS y FROM j)
        SELECT * EXCLUDE (x, y), CASE WHEN x AND y THEN 'redundant|outdated' WHEN x THEN 'redundant' WHEN y THEN 'outdated' ELSE 'healthy' END AS labels FROM l""",
}

QUERIES = {
    f.__name__: f
    for f in (
        boilerplate_hits, content_scores, metadata_date_scores, metadata_completeness, metadata_summary, missing_fields, custom_fields, verdict_findings,
        verdict_counts, projected_health, issue_counters, chunk_windows, document_states, document_signals,
    )
}
