"""The whole audit of new documents, alone or against existing chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import chunker, contradiction, duplication, embedding, metadata, rot, scoring, similarity, staleness
from siltstone.operators.lineage import materialise


@dataclass(frozen=True)
class AuditConfig:
    """What an audit does; without an embedder there is no similarity, without a judge no contradiction."""

    now: datetime
    chunks: chunker.ChunkConfig = field(default_factory=chunker.ChunkConfig)
    fields: list[str] | None = None
    embedder: embedding.Embedder | None = embedding.hashed_bigrams
    judge: contradiction.Judge | None = None
    exact: float = similarity.EXACT
    near: float = similarity.NEAR
    band: tuple[float, float] = similarity.BAND
    same_document: bool = True
    supersede: float = staleness.SUPERSEDE
    substantial: Callable[[str], bool] | None = None  # asked about a few borderline chunks of undecided documents
    substance_budget: int = rot.JUDGE_BUDGET
    progress: Callable[[str, str], None] | None = None


@dataclass
class AuditResult:
    duplication: DataFrame
    staleness: DataFrame
    supersession: DataFrame
    contradictions: DataFrame
    metadata: DataFrame
    rot: DataFrame
    health: DataFrame
    projected: DataFrame
    counters: DataFrame
    warnings: list[str]


STALE_SCHEMA = "chunk_id string, document_id string, filename string, chunk_index int, side string, text string, score double, meta_score double, text_score double, confidence double, reference_date timestamp, meta_date timestamp, text_date date, created_at timestamp, modified_at timestamp, recommendation string, notes array<string>"
OVER_SCHEMA = "left_id string, right_id string, similarity double, score double"
CONTRA_SCHEMA = "left_id string, right_id string, scope string, similarity double, severity string, claim_a string, claim_b string, explanation string, recommendation string, finding_id string"


def audit(documents: DataFrame, config: AuditConfig, existing: DataFrame | None = None) -> AuditResult:
    """Audits documents (document_id, ordinal, filename, text, ... as in sources.documents) against existing chunks, if any.

    Scores of all pairs are computed once, from the lowest floor that any pass
    asks for, and filtered for each pass. Documents that could not be read have
    no text; they are named in a warning and left out. A pass that raises is
    named in a warning, its findings are empty and its score is unknown; the
    others go on. Without a chunk there is nothing to compare, and no finding.
    """
    warnings: list[str] = []
    unknown: set[str] = set()

    def step(name: str, state: str) -> None:
        if config.progress:
            config.progress(name, state)

    def attempt(name: str, make: Callable[[], DataFrame], empty: Callable[[], DataFrame], dimension: str | None = None) -> DataFrame:
        """What make makes, written at once so that it fails here or nowhere; empty instead where it does."""
        step(name, "active")
        try:
            out = materialise(make(), f"audit-{name}")
            step(name, "completed")
            return out
        except Exception as e:  # noqa: BLE001 - one pass must not end the others
            warnings.append(f"{name} was skipped: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
            unknown.add(dimension or name)
            step(name, "error")
            return empty()

    spark = documents.sparkSession
    none = lambda schema: lambda: spark.createDataFrame([], schema)
    step("chunk", "active")
    if "error" in documents.columns and (broken := documents.where("text IS NULL").count()):
        warnings.append(f"{broken} documents could not be read")
    docs = documents.where("text IS NOT NULL").withColumn("document_id", F.col("document_id").cast("string"))
    chunks = chunker.chunk(docs, config.chunks).withColumns({"side": F.lit("new"), "metadata": F.create_map().cast("map<string,string>"), "embedding": F.lit(None).cast("array<double>")})
    if existing is not None:
        chunks = chunks.unionByName(existing.select("document_id", "filename", "chunk_index", "start_char", "end_char", "text", "chunk_id", "side", "metadata", "embedding"))
    if config.embedder is not None:
        step("embed", "active")
        chunks = embedding.embed(chunks, config.embedder)
    chunks = materialise(chunks, "audit-chunks")
    empty = chunks.where("side = 'new'").isEmpty()
    if empty:
        warnings.append("no chunk was made")
    known = config.embedder is not None and not empty
    pairs = spark.createDataFrame([], similarity.PAIRS)
    if known:
        step("similarity", "active")
        try:
            usable = similarity.checked(embedding.require_vectors(chunks))
            floor = min(config.near, config.band[0], config.supersede)
            pairs = materialise(similarity.scores(usable, floor), "audit-pairs")
        except (embedding.EmbeddingError, ValueError) as e:
            known = False
            warnings.append(f"no similarity: {e}")
        if (failed := chunks.where("embedding_error IS NOT NULL").count()) and known:
            warnings.append(f"{failed} chunks could not be embedded")
    if not known:
        unknown.add("duplication")
    no_duplicates = duplication.findings(spark.createDataFrame([], similarity.PAIRS + ", severity string"), chunks.limit(0)).schema
    duplicates = attempt("duplication", lambda: duplication.findings(similarity.similar(pairs, config.exact, config.near), chunks), none(no_duplicates))
    assessed = attempt("assessment", lambda: staleness.assess(staleness.metadata_dates(chunks, docs), config.now).drop("embedding"), none(STALE_SCHEMA), "staleness")
    stale = attempt("staleness", lambda: staleness.findings(assessed).withColumn("notes", staleness.notes(config.now)), none(STALE_SCHEMA))
    over = attempt("supersession", lambda: staleness.supersessions(pairs, assessed, config.supersede), none(OVER_SCHEMA))
    band = similarity.in_band(pairs, *config.band)
    if not config.same_document:
        band = similarity.cross_document(band, chunks)
    candidates = None
    contra = spark.createDataFrame([], CONTRA_SCHEMA)
    if config.judge is not None and known:
        asked = contradiction.prompts(band, chunks)
        answers = attempt("contradictions", lambda: contradiction.judged(asked, config.judge), lambda: asked.limit(0).withColumns({"raw_content": F.lit(None).cast("string"), "prompt_tokens": F.lit(None).cast("long"), "completion_tokens": F.lit(None).cast("long"), "failed": F.lit(False)}))
        used = contradiction.usage(answers).first()
        candidates = None if "contradictions" in unknown else band
        if used["calls"] and used["calls"] == used["failed_calls"]:
            candidates, answers = None, answers.limit(0)
            warnings.append("every call of the judge failed")
        elif used["failed_calls"]:
            warnings.append(f"{used['failed_calls']} calls of the judge failed")
        contra = contradiction.findings(contradiction.verdicts(answers)).withColumn("finding_id", F.concat_ws("|", "left_id", "right_id"))
    owner = chunks.where("side = 'new'").select("chunk_id", "document_id")
    contra_docs = contra.select("finding_id", F.explode(F.array("left_id", "right_id")).alias("chunk_id")).join(owner, "chunk_id").select("finding_id", "document_id").distinct()
    undescribed = lambda: docs.limit(0).withColumns({"missing_fields": F.array().cast("array<string>"), "date_formats": F.array().cast("array<string>"), "completeness": F.lit(None).cast("double"), "consistency_issues": F.array().cast("array<string>")})
    described = attempt("metadata", lambda: metadata.assess(docs, config.fields), undescribed)
    owners = chunks.select(F.col("chunk_id").alias("right_id"), "document_id")
    over_docs = over.join(owners, "right_id").select("document_id", F.concat_ws("|", "left_id", "right_id").alias("finding_id"))

    def classify() -> DataFrame:
        judged = None
        if config.substantial is not None:
            queue = rot.judge_queue(rot.triviality(chunks.where("side = 'new'")), docs, config.substance_budget)
            judged = materialise(rot.judged(queue, config.substantial), "audit-substance")
        return rot.classify(docs, chunks, duplicates, stale, over_docs, contra_docs, described, judged)

    unlabelled = rot.classify(docs.limit(0), chunks.limit(0), duplicates.limit(0), stale.limit(0), over_docs.limit(0), contra_docs.limit(0), described.limit(0)).schema
    classified = attempt("rot", classify, none(unlabelled))
    step("score", "active")
    new = chunks.where("side = 'new'")
    average = metadata.summary(described)
    health = scoring.overall(scoring.dimensions(new.select("chunk_id"), duplicates, stale, contra, candidates, average, classified, unknown))
    after = scoring.overall(scoring.projected(chunks, duplicates, stale, contra, contra_docs, candidates, classified, unknown))
    issues = scoring.documents_with_issues(docs, duplication.memberships(duplicates).where("side = 'new'"), stale, contra_docs, described.where(metadata.has_issue()), classified.where(~F.array_contains("classifications", "healthy")))
    counters = scoring.counters(docs, chunks, duplicates, stale, over, contra, classified, issues)
    step("score", "completed")
    return AuditResult(duplicates, stale, over, contra, described, classified, health, after, counters, warnings)
