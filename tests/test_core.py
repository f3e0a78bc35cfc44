"""Chunking, dates, similarity, the passes and scoring on literal cases."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone import errors
from siltstone.functions import dates as D
from siltstone.functions import text as X
from siltstone.operators import chunker, contradiction, duplication, embedding, lineage, metadata, rot, scoring, similarity, staleness, validation
from siltstone.plans import precompute, queries
from siltstone.plans.audit import AuditConfig, audit
from siltstone.sources import chunk_export, documents, reports, samples, views

NOW = datetime(2026, 3, 15)


def test_windows_overlap_and_cover():
    text = "First short paragraph.\n\nSecond short paragraph here.\n\nThird paragraph, the last one."
    got = list(chunker.windows(text, chunker.ChunkConfig(35, 8)))
    assert len(got) >= 2 and got[1][1] < got[0][2]
    assert all(text[a:b] == text[a:b].strip() for _, a, b in got)


def test_windows_crawl_only_in_parity():
    text = "# Heading\n\n" + "x" * 495
    crawl = list(chunker.windows(text, chunker.ChunkConfig()))
    assert [(a, b) for _, a, b in crawl[-1:]] == [(6, 506)] and len(crawl) == 7
    assert len(list(chunker.windows(text, chunker.ChunkConfig(parity=False)))) == 2


@pytest.mark.parametrize("size,overlap", [(0, 0), (10, 10), (10, -1)])
def test_bad_chunk_config(size, overlap):
    with pytest.raises(ValueError):
        chunker.ChunkConfig(size, overlap)


def test_chunk_rows(spark):
    docs = spark.createDataFrame([("a", "a.txt", "one two"), ("b", "b.txt", None), ("c", "c.txt", "  ")], "document_id string, filename string, text string")
    assert [(r.document_id, r.start_char, r.end_char) for r in chunker.chunk(docs).collect()] == [("a", 0, 7)]


def test_date_signals(spark):
    text = "Updated in Q3 2023, as of January 2024. See FY2022 and 2021-03-15. Version 3.1 is currently fine at this time."
    r = staleness.signals(spark.createDataFrame([(text,)], "text string")).first()
    assert {str(d.date) for d in r.dates} == {"2021-03-15", "2023-09-01", "2022-12-01", "2024-01-01"}
    assert "as of January 2024" in [d.raw for d in r.dates]
    assert r.cues == ["at this time", "currently"] and r.versions == ["version 3.1"]


def test_invalid_dates(spark):
    rows = spark.createDataFrame([("2023-13-01",), ("2023-02-31",), ("2023-01-00",), ("0000-01-01",)], "text string").select(D.dates("text").alias("d")).collect()
    assert [[str(x.date) for x in r.d] for r in rows] == [[], ["2023-02-28"], [], []]


def test_age_curve(spark):
    months = [0, 3, 6, 12, 14, 15, 24, 29, 60]
    got = spark.createDataFrame([(m,) for m in months], "m int").select(D.age_score(F.col("m")).alias("s")).collect()
    assert [r.s for r in got] == [0.0, 0.221, 0.393, 0.632, 0.689, 0.713, 0.865, 0.911, 0.993]


def _dated(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, side string, text string, created_at timestamp, modified_at timestamp")


def test_staleness_scores(spark):
    rows = [("a", "new", "March 15, 2021 and Q1 2021", None, datetime(2026, 2, 20)), ("b", "new", "October 2023", None, datetime(2026, 2, 18)), ("c", "new", "nothing", None, None), ("d", "new", "currently v1.2", None, None), ("e", "new", "currently", None, None), ("f", "new", "v1.2", None, None)]
    got = {r.chunk_id: r.score for r in staleness.assess(_dated(spark, rows), NOW).collect()}
    assert got == {"a": 0.81, "b": 0.61, "c": 0.5, "d": 0.65, "e": 0.6, "f": 0.4}


def test_supersession(spark):
    assessed = staleness.assess(_dated(spark, [("n", "new", "x", None, datetime(2026, 1, 20)), ("o", "existing", "y", None, datetime(2023, 1, 10))]), NOW)
    pairs = spark.createDataFrame([("n", "o", 0.78, "new_vs_existing"), ("n", "n2", 0.9, "new_vs_new")], similarity.PAIRS)
    got = staleness.supersessions(pairs, assessed).collect()
    assert [(r.left_id, r.right_id) for r in got] == [("n", "o")]
    assert [r.chunk_id for r in staleness.findings(assessed).collect()] == []


def _vectors(spark, rows):
    full = [(i, side, v, f"d-{i}", f"{i}.txt", 0) for i, side, v in rows]
    return spark.createDataFrame(full, "chunk_id string, side string, embedding array<double>, document_id string, filename string, chunk_index int")


def test_similarity_thresholds(spark):
    chunks = _vectors(spark, [("a", "new", [1.0, 0.0]), ("b", "new", [1.0, 0.0]), ("c", "new", [0.9, 0.19**0.5]), ("d", "new", [0.0, 1.0]), ("e", "existing", [1.0, 0.0]), ("f", "existing", [1.0, 0.0])])
    for block in (1, 2, 4096):
        got = {(r.left_id, r.right_id): r.severity for r in similarity.similar(similarity.scores(chunks, 0.85, block)).collect()}
        assert got == {("a", "b"): "exact", ("a", "c"): "near_duplicate", ("b", "c"): "near_duplicate", ("a", "e"): "exact", ("b", "e"): "exact", ("c", "e"): "near_duplicate", ("a", "f"): "exact", ("b", "f"): "exact", ("c", "f"): "near_duplicate"}


def test_vectors_are_read_in_lots_and_shuffled_once(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 6)) + 0.6
    sides = ["new" if i % 3 else "existing" for i in range(90)]
    chunks = _vectors(spark, [(f"{i:02d}", side, x) for i, (side, x) in enumerate(zip(sides, v.tolist()))])
    pairs = similarity.scores(chunks, 0.3, 14)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = {(i, j) for i in range(90) for j in range(90) if sides[i] == "new" and (sides[j] == "existing" or i < j) and u[i] @ u[j] >= 0.3}
    got = pairs.collect()
    assert len(got) == len(near) and {(int(r.left_id), int(r.right_id)) for r in got} == near
    assert all(abs(r.score - u[int(r.left_id)] @ u[int(r.right_id)]) < 1e-12 and r.scope == f"new_vs_{sides[int(r.right_id)]}" for r in got)
    again = chunks.where("side = 'new'").limit(20)
    assert {(r.left_id, r.right_id) for r in similarity.scores(again.union(again), -0.0, 4).collect() if r.left_id >= r.right_id} == set()


def test_bad_vectors(spark):
    with pytest.raises(ValueError):
        similarity.checked(_vectors(spark, [("a", "new", [1.0]), ("b", "new", [1.0, 2.0])]))
    with pytest.raises(ValueError):
        similarity.checked(_vectors(spark, [("a", "new", [0.0])]))


def test_band(spark):
    chunks = _vectors(spark, [("a", "new", [1.0, 0.0, 0.0]), ("b", "new", [0.8, 0.6, 0.0]), ("c", "new", [0.0, 0.0, 1.0]), ("d", "existing", [0.75, -(0.4375**0.5), 0.0]), ("e", "existing", [0.96, -0.28, 0.0])])
    assert {(r.left_id, r.right_id) for r in similarity.in_band(similarity.scores(chunks, 0.7)).collect()} == {("a", "b"), ("a", "d")}


def test_clusters(spark):
    chunks = _vectors(spark, [(c, "existing" if c == "e" else "new", [1.0]) for c in "abcde"])
    pairs = spark.createDataFrame([("a", "b", 0.999, "new_vs_new"), ("b", "c", 0.998, "new_vs_new"), ("a", "d", 0.9, "new_vs_new"), ("a", "e", 0.99, "new_vs_existing"), ("a", "c", 0.9, "new_vs_new")], similarity.PAIRS)
    found = duplication.findings(similarity.similar(pairs), chunks)
    got = [(r.finding_type, r.score, [m.chunk_id for m in r.members]) for r in found.collect()]
    assert got == [("exact", 0.998, ["a", "b", "c"]), ("already_in_index", 0.99, ["a", "e"]), ("near_duplicate", 0.9, ["a", "d"])]
    assert duplication.counts(found).first().asDict() == {"exact": 1, "already_in_index": 1, "near_duplicate": 1}


def test_clusters_read_their_pairs_three_times_at_most(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [("a", "b", 0.999, "new_vs_new"), ("b", "c", 0.998, "new_vs_new"), ("d", "e", 0.99, "new_vs_new"), ("a", "d", 0.9, "new_vs_new"), ("a", "f", 0.9, "new_vs_new"), ("a", "g", 0.9, "new_vs_existing")]

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    pairs = similarity.similar(spark.createDataFrame(rows, similarity.PAIRS).mapInArrow(counted, similarity.PAIRS))
    assert {tuple(r) for r in duplication.exact_clusters(pairs).collect()} == {("a", "a", 0.998), ("b", "a", 0.998), ("c", "a", 0.998), ("d", "d", 0.99), ("e", "d", 0.99)}
    assert seen.value <= 3 * len(rows)
    assert duplication.tally(pairs).first().asDict() == {"exact": 2, "already_in_index": 1, "near_duplicate": 1}


def test_text_expressions_read_a_text_once(spark):
    texts = ["TBD: see the Agenda, n/a", "\u0661\u0662\u0663 Draft", "as of May 2024, Q3 2023", "version \u0661.\u0662 and v 3.4", "none of it", "", None]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    got = [r[1:] for r in t.select("i", X.boilerplate_hits("t"), F.transform(D.dates("t"), lambda d: d["raw"]), D.sorted_hits("t", D.VERSION)).orderBy("i").collect()]
    assert got == [(["tbd", "n/a", "agenda"], [], []), (["draft"], [], []), ([], ["Q3 2023", "as of May 2024"], []), ([], [], ["v 3.4", "version \u0661.\u0662"]), ([], [], []), ([], [], []), ([], None, None)]
    plan = t.select(X.boilerplate_hits("t"), D.dates("t"))._jdf.queryExecution().executedPlan().toString()
    assert "filter(array(" not in plan.split("transform(array(lower(")[0] and "RLIKE(t" in plan


def test_copies_are_found_without_shuffling_texts(spark):
    t = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (5, "x"), (6, None), (7, None)], "doc_id long, text string")
    got = queries._copies(t)
    assert {(r.left_id, r.right_id) for r in got.collect()} == {("1", "3"), ("1", "5")}
    assert not [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(text" in x]


def test_embedding_failures(spark):
    def broken(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[1.0] for _ in texts]

    chunks = spark.createDataFrame([("a", "bad"), ("b", "good")], "chunk_id string, text string").repartition(1)
    done = embedding.embed(chunks.orderBy("chunk_id"), broken, batch=1)
    assert {r.chunk_id for r in embedding.require_vectors(done).collect()} == {"b"}
    assert embedding.failed_batches(done).first()["chunk_count"] == 1
    with pytest.raises(embedding.EmbeddingError):
        embedding.require_vectors(embedding.embed(chunks, broken, batch=2))


VALUE = "map<string,struct<v:string,t:string>>"
DOC = f"document_id string, ordinal long, filename string, file_size long, created_at timestamp, modified_at timestamp, embedded {VALUE}, frontmatter {VALUE}"


def test_metadata(spark):
    s = lambda v: (v, "string")
    rows = [
        ("1", 0, "document1.pdf", 1, None, datetime(2026, 1, 1), {}, {}),
        ("2", 1, "finance-policy.md", 1, datetime(2026, 1, 1), datetime(2026, 1, 1), {"title": s("Finance")}, {"author": s("Ann"), "version": s("2"), "category": s("policy")}),
    ]
    got = metadata.assess(spark.createDataFrame(rows, DOC))
    assert sorted(r.completeness for r in got.collect()) == [0.167, 1.0]
    assert metadata.summary(got).first().average_completeness == pytest.approx(0.584, abs=6e-4)
    assert {r.field: r.documents for r in metadata.missing_counts(got).collect()}["title"] == 1


def test_custom_fields(spark):
    rows = [("1", 0, "x.md", 1, None, None, {"title": ("T", "string"), "case_number": ("7", "string")}, {"owner": ("Ann", "string")})]
    got = metadata.assess(spark.createDataFrame(rows, DOC), ["title", "owner", "case number", "jurisdiction"]).first()
    assert got.completeness == 0.75 and got.missing_fields == ["jurisdiction"]
    assert len(metadata.resolve_fields(["author", "owner", "Author"])) == 2
    assert metadata.parse_fields(" a, b\n\n") == ["a", "b"] and metadata.parse_fields(" ,") is None


def test_date_formats(spark):
    rows = [("1", 0, "x.md", 1, None, None, {"last_modified_by": ("Ann", "string"), "date": ("2024-01-02", "string")}, {"updated": ("1/2/2024", "string")})]
    assert metadata.assess(spark.createDataFrame(rows, DOC)).first().date_formats == ["iso_date", "other_date_string", "slash_date"]


def test_verdicts(spark):
    fenced = '```json\n{"status": "CONTRADICTION", "severity": "HIGH", "claim_a": "1", "claim_b": "2"}\n```'
    hedged = '{"status": "contradiction", "claim_a": "1", "claim_b": "2", "explanation": "it may differ"}'
    bare = '{"status": "CONTRADICTION"}'
    rows = [(str(i), "z", 0.8, "new_vs_new", "p" * 480, c, 120, 40, False) for i, c in enumerate([fenced, "not-json", hedged, bare])]
    answers = spark.createDataFrame(rows, "left_id string, right_id string, score double, scope string, prompt string, raw_content string, prompt_tokens long, completion_tokens long, failed boolean")
    parsed = contradiction.verdicts(answers)
    assert [(r.left_id, r.severity) for r in contradiction.findings(parsed).collect()] == [("0", "high"), ("2", "medium")]
    assert contradiction.usage(answers.limit(1)).first().cost == 0.000084


def test_judge_failures_are_counted(spark):
    def judge(prompt):
        if "bad" in prompt:
            raise RuntimeError
        return "{}", None, None

    asked = spark.createDataFrame([("a", "b", 0.8, "s", "bad"), ("a", "c", 0.8, "s", "fine")], "left_id string, right_id string, score double, scope string, prompt string")
    assert contradiction.usage(contradiction.judged(asked, judge)).first().failed_calls == 1


def test_overall_weights(spark):
    row = spark.sql("SELECT 50.0D duplication, 65.0D staleness, CAST(NULL AS DOUBLE) contradictions, 60.0D metadata, 50.0D rot")
    got = scoring.overall(row).first()
    assert got.overall == 55.3 and got.skipped == ["contradictions"]


def test_trivial_documents(spark):
    rows = [("a", "new", "TODO placeholder draft agenda"), ("b", "new", " ".join(f"word{i} means{i} something" for i in range(40)))]
    got = rot.document_triviality(rot.triviality(spark.createDataFrame(rows, "document_id string, side string, text string")))
    assert {r.document_id: (r.state, r.avg_words) for r in got.collect()} == {"a": ("trivial", 4.0), "b": ("healthy", 120.0)}


def test_precision_and_finalize(spark):
    got = {r.category: (r.judged, r.precision) for r in validation.precision(spark.createDataFrame([("a", True), ("a", False), ("b", None)], "category string, correct boolean")).collect()}
    assert got == {"a": (2, 0.5), "b": (0, None), "overall": (2, 0.5)}
    docs, gone = validation.finalize(spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "ordinal long, text string"), "set")
    assert gone == 1 and sorted((r.ordinal, r.filename) for r in docs.collect()) == [(0, "set-0001.txt"), (1, "set-0002.txt")]


def test_front_matter_and_parse():
    front, body = documents.front_matter("---\ntitle: Guide\nunit: Retrieval\n---\n\nBody text")
    assert front == {"title": "Guide", "unit": "Retrieval"} and body == "Body text"
    assert documents.front_matter("--- no") == ({}, "--- no")
    for name, content in (("a.xlsx", b"x"), ("a.txt", b""), ("a.txt", b"  "), ("a.docx", b"broken")):
        with pytest.raises(documents.ParseError):
            documents.parse(name, content)


def test_read_files(spark, tmp_path):
    (tmp_path / "good.txt").write_text("Hello there")
    (tmp_path / "broken.pdf").write_bytes(b"nope")
    times = documents.client_modified(spark, '{"good.txt": "2026-03-15T12:30:00Z", "x": "never"}')
    got = {r.filename: r for r in documents.read(spark, str(tmp_path), times).collect()}
    assert got["good.txt"].text == "Hello there" and str(got["good.txt"].modified_at) == "2026-03-15 12:30:00"
    assert got["broken.pdf"].text is None and got["broken.pdf"].error


def test_json_export(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text('{"items": [{"content": "Hi", "document_id": "d", "chunk_index": 2, "start": 10, "end": 28, "embedding": [1, 2, 3], "metadata": {"source": "s"}}, 5, {"content": " "}]}')
    r = chunk_export.read(spark, str(p)).collect()
    assert len(r) == 1 and (r[0].document_id, r[0].chunk_index, r[0].start_char, r[0].end_char) == ("d", 2, 10, 28)
    assert r[0].embedding == [1.0, 2.0, 3.0] and r[0].metadata == {"source": "s"}
    p.write_text('[{"document_name": "stored.md"}]')
    with pytest.raises(chunk_export.ExportError):
        chunk_export.read(spark, str(p))


def test_csv_export(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("text,document_name,index,start,end,topic\nHello,guide.md,4,0,5,onboarding\n")
    r = chunk_export.read(spark, str(p)).first()
    assert (r.filename, r.chunk_index, r.metadata) == ("guide.md", 4, {"topic": "onboarding"})


def test_audit_end_to_end(spark, tmp_path):
    long = " ".join(f"point{i} matters here" for i in range(30))
    rows = [(1, "policy one " + long), (2, "policy one " + long), (3, "agenda TODO"), (4, "dated October 2019 " + long[::-1])]
    docs = documents.from_table(spark.createDataFrame(rows, "id long, text string"), "id", "text", F.concat(F.lit("note-"), "id", F.lit(".txt")))
    existing = chunk_export.normalise(spark.createDataFrame([(0, {"text": "agenda TODO", "document_id": "old"})], "ordinal long, m map<string,string>"))
    seen = []
    result = audit(docs, AuditConfig(NOW, judge=lambda p: ("{}", None, None), progress=lambda n, s: seen.append(n)), existing)
    kinds = {r.finding_type for r in result.duplication.collect()}
    assert kinds >= {"exact", "already_in_index"} and "rot" in seen and result.warnings == []
    labels = {r.document_id: r.classifications for r in result.rot.collect()}
    assert "redundant" in labels["1"] and "trivial" in labels["3"]
    assert 0 <= result.health.first().overall <= 100
    assert "## Health score" in reports.markdown(result)
    reports.write_json(result, str(tmp_path / "json"))
    back = reports.load_json(spark, str(tmp_path / "json"), "rot", result.rot.schema)
    assert back.count() == 4


def test_staleness_is_worked_out_once(spark):
    """A filter on the score must not write the date expressions out again."""
    chunks = spark.createDataFrame([("c", "new", "dated 2019-01-01", None, None)], "chunk_id string, side string, text string, created_at timestamp, modified_at timestamp")
    plan = staleness.findings(staleness.assess(chunks, NOW))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 6


def test_aliases_and_generic_names(spark):
    names = {f: c for f, c, _ in metadata.resolve_fields(["Title or meaningful filename", "author_or_owner", "Version information", "product-version", "document category", "Last modified", "creation date", "name", "authors"])}
    assert list(names.values()) == ["title", "author", "version", "version", "document type", "modified date", None, None, None]
    rows = [(n, i, n + ".txt", 1, None, None, {}, {}) for i, n in enumerate(("scan", "Scan 12", "file_3", "document-7", "doc  4", "scan_", "report"))]
    got = {r.document_id: r.missing_fields for r in metadata.assess(spark.createDataFrame(rows, DOC), ["title"]).collect()}
    assert {k for k, v in got.items() if v} == {"scan", "Scan 12", "file_3", "document-7"}


def test_empty_front_matter():
    assert documents.front_matter("---\n\n---\nBody") == ({}, "Body")
    assert documents.front_matter("---\n---\nBody") == ({}, "---\n---\nBody")


def docx(text):
    import io
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>{text}</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def test_docx_keeps_tabs_and_breaks():
    assert documents.parse("a.docx", docx("a"))[0] == "a\tb\nc"


def test_malformed_exports_raise(spark, tmp_path):
    for text in ('{"chunks": [', '{"other": []}', '"x"'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(chunk_export.ExportError):
            chunk_export.read(spark, str(tmp_path / "bad.json"))


def test_audit_of_a_folder(spark, tmp_path):
    """Files, one of them broken, from upload to report and back."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("---\ntitle: Guide\nauthor: Ann\n---\n\nThe guide of " + " ".join(f"point{i} counts" for i in range(40)))
    (folder / "b.docx").write_bytes(docx("Words in a file"))
    (folder / "c.pdf").write_bytes(b"nope")
    asked = []
    result = audit(documents.upload(spark, str(folder)), AuditConfig(NOW, substantial=lambda t: asked.append(t) or False))
    assert result.warnings == ["1 documents could not be read"]
    rows = {r.filename: r for r in result.rot.collect()}
    assert set(rows) == {"a.md", "b.docx"} and rows["b.docx"].classifications == ["trivial"] and "words a chunk" in rows["b.docx"].explanation and rows["b.docx"].impact.startswith("If indexed")
    assert rows["a.md"].explanation.endswith("nothing to object to")
    assert all(r.notes is not None for r in result.staleness.collect())
    shown = {n: [r.asDict() for r in v.collect()] for n, v in views.views(result).items()}
    assert {r["dimension"] for r in shown["cards"]} == {"overall", *views.DIMENSIONS} and next(r for r in shown["cards"] if r["dimension"] == "contradictions")["level"] == "unknown"
    assert {r["filename"]: r["labels"] for r in shown["rot"]} == {"a.md": ["Healthy"], "b.docx": ["Trivial"]}
    assert all(r["label"] in ("high", "review", "fresh") for r in shown["staleness"]) and {r["level"] for r in shown["metadata"]} <= {"good", "fair", "poor"}
    back = reports.load_payload(spark, json.loads(json.dumps(reports.payload(result))))
    for name in reports.TABLES:
        assert sorted(map(str, getattr(back, name).collect())) == sorted(map(str, getattr(result, name).collect())), name
    (folder / "d.xlsx").write_bytes(b"x")
    with pytest.raises(documents.ParseError):
        documents.upload(spark, str(folder))
    with pytest.raises(documents.ParseError):
        documents.guarded(spark.read.format("binaryFile").load(str(folder)), documents=3)


def test_substance_judge_decides_open_documents(spark):
    text = " ".join(f"w{i % 14} text" for i in range(17))
    docs = documents.from_table(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", F.lit("x.txt"))
    label = lambda f: audit(docs, AuditConfig(NOW, substantial=f)).rot.first().classifications

    def broken(_):
        raise OSError("down")

    assert label(None) == ["healthy"] == label(lambda t: True) == label(broken) and label(lambda t: False) == ["trivial"]


def test_a_failing_pass_does_not_end_the_others(spark, monkeypatch):
    docs = documents.from_table(spark.createDataFrame([(1, "some words dated 2019-01-01 here"), (2, "others stand in this one")], "id long, text string"), "id", "text", F.lit("x.txt"))

    def broken(*_):
        raise RuntimeError("no")

    monkeypatch.setattr(staleness, "assess", broken)
    monkeypatch.setattr(metadata, "assess", broken)
    result = audit(docs, AuditConfig(NOW))
    row = result.health.first()
    assert row.staleness is None and row.metadata is None and row.duplication == 100.0 and row.rot is not None
    assert len(result.warnings) >= 2 and result.rot.count() == 2


def test_audit_without_embedder_and_without_chunks(spark):
    docs = documents.from_table(spark.createDataFrame([(1, "some words")], "id long, text string"), "id", "text", F.lit("x.txt"))
    row = audit(docs, AuditConfig(NOW, embedder=None)).health.first()
    assert row.duplication is None and set(row.skipped) == {"duplication", "contradictions"}
    none = audit(docs.where("false"), AuditConfig(NOW))
    assert none.warnings == ["no chunk was made"] and none.rot.count() == 0 and none.counters.first().chunks == 0


def test_service_errors():
    status = lambda code, text="": type("E", (Exception,), {"status_code": code})(text)
    kinds = [errors.classified(e) for e in (status(401), status(402), status(429, "insufficient_quota"), status(429), TimeoutError(), Exception("Connection reset"), Exception("odd"))]
    assert [type(k) for k in kinds] == [errors.KeyRejected, errors.QuotaExhausted, errors.QuotaExhausted, errors.RateLimited, errors.Unreachable, errors.Unreachable, errors.ServiceError]


def test_benchmark_roll_up(spark):
    audits = spark.createDataFrame([("a", 5, 8, 72.5, 2, 1, 1, 1), ("b", 7, 12, 68.0, 1, 2, 2, 2)], "dataset string, documents long, chunks long, health double, duplicates long, contradictions long, stale long, rot long")
    judged = validation.precision(spark.createDataFrame([("x", True), ("x", False), ("y", True), ("y", True)], "category string, correct boolean"))
    total = validation.roll_up(audits, judged)
    row = total.first()
    assert (row.datasets, row.documents, row.issues, row.judged, row.precision, row.mean_health) == (2, 12, 12, 4, 0.75, 70.3)
    assert "| a | 5 | 72.5 |" in validation.markdown(audits, total) and "75.0 %" in validation.markdown(audits, total)
    assert "No findings have been judged yet." in validation.markdown(audits, validation.roll_up(audits))
    flat = spark.createDataFrame([("staleness", "high", "1", "f"), ("staleness", "high", "1", "f"), ("rot", "outdated", "1", "g"), ("rot", "trivial", "2", "h")], "category string, subcategory string, document_id string, finding_id string")
    assert sorted(r.finding_id for r in validation.for_validation(flat, flat.where("category = 'staleness'")).collect()) == ["f", "h"]


def test_precompute(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"filename": "a.txt", "title": "A", "text": "some words in here"}]))
    made = precompute.precompute(spark, samples.SampleRegistry({"s": str(tmp_path / "s.json")}), str(tmp_path / "out"), NOW)
    assert [p.name for p in made] == ["s.json"] and json.loads(made[0].read_text())["tables"]["rot"]["rows"][0]["filename"] == "a.txt"


def test_views_of_duplicates_and_contradictions(spark):
    docs = documents.from_table(spark.createDataFrame([(1, "some words stand here"), (2, "some words stand here"), (3, "others altogether in this")], "id long, text string"), "id", "text", F.concat(F.lit("n"), "id", F.lit(".txt")))
    answer = '{"status": "CONTRADICTION", "severity": "high", "claim_a": "p", "claim_b": "q"}'
    result = audit(docs, AuditConfig(NOW, band=(0.0, 1.0), judge=lambda p: (answer, None, None)))
    shown = views.views(result)
    one = shown["duplication"].first()
    assert one.label == "The same text" and one.sources == ["n1.txt #1", "n2.txt #1"] and one.similarity == "100 %" and one.action == "Keep one of them"
    assert {(r.label, r.line) for r in shown["contradictions"].collect()} == {("High", "p / q")}


def test_shared_folder(spark, tmp_path, monkeypatch):
    before = lineage.release(spark)
    kept = lineage.materialise(spark.range(5), "five")
    assert before >= 0 and kept.count() == 5 and lineage.release(spark) == 1 and lineage.release(spark) == 0

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        lineage.shared_folder(Cluster)
