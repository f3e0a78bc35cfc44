"""Document files as rows: text, Markdown with front matter, DOCX, and PDF where a reader is installed."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import dates as D

EXTENSIONS = (".pdf", ".docx", ".md", ".markdown", ".txt")
VALUE = "struct<v:string,t:string>"
MOST_DOCUMENTS, MOST_FILE, MOST_TOTAL = 50, 10 << 20, 50 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class ParseError(ValueError):
    """A document that cannot be read."""


def front_matter(raw: str) -> tuple[dict, str]:
    """(front matter, body); the text as it is and nothing when there is none or it is no mapping."""
    if not raw.startswith("---\n"):
        return {}, raw
    end = raw.find("\n---\n", 4)
    if end < 0:
        return {}, raw
    try:
        found = _mapping(raw[4:end])
    except ValueError:
        return {}, raw
    return (found, raw[end + 5 :].lstrip("\n")) if found is not None else ({}, raw)


def _mapping(block: str) -> dict | None:
    try:
        import yaml
    except ImportError:
        return _plain_mapping(block)
    try:
        got = yaml.safe_load(block)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e
    return {str(k): v for k, v in got.items()} if isinstance(got, dict) else None if got else {}


def _plain_mapping(block: str) -> dict | None:
    """key: value lines and lists in brackets, for where no YAML reader is installed."""
    out: dict = {}
    for line in block.split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = re.match(r"^([\w][\w .-]*):(?:\s+(.*))?$", line)
        if not m:
            raise ValueError(line)
        out[m.group(1)] = _plain_value((m.group(2) or "").strip())
    return out


def _plain_value(v: str):
    if v in ("", "null", "~"):
        return None
    if v[0] == v[-1] and v[0] in "'\"" and len(v) > 1:
        return v[1:-1]
    if v.lower() in ("true", "false"):
        return v.lower() == "true"
    if v[0] == "[" and v[-1] == "]":
        return [_plain_value(x.strip()) for x in v[1:-1].split(",") if x.strip()]
    for kind in (int, float, date.fromisoformat, datetime.fromisoformat):
        try:
            return kind(v)
        except ValueError:
            pass
    return v


def tagged(values: dict) -> dict[str, dict[str, str]]:
    """Values as text with a type tag; empty ones are left out."""
    out = {}
    for k, v in values.items():
        if v is None or v == "" or v == [] or v == {}:
            continue
        tag = "datetime" if isinstance(v, datetime) else "date" if isinstance(v, date) else "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "other"
        out[str(k)] = {"v": v if isinstance(v, str) else v.isoformat() if isinstance(v, date) else json.dumps(v, default=str), "t": tag}
    return out


def _docx(content: bytes) -> tuple[str, dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}
        lines = ["".join(t.text or "" if t.tag == f"{_W}t" else marks.get(t.tag, "") for r in p.iter(f"{_W}r") for t in r) for p in (body.findall(f"{_W}p") if body is not None else [])]
        core = {}
        if "docProps/core.xml" in z.namelist():
            for e in ElementTree.fromstring(z.read("docProps/core.xml")):
                name = re.sub(r"(?<!^)(?=[A-Z])", "_", e.tag.rpartition("}")[2]).lower()
                core[{"creator": "author", "description": "comments"}.get(name, name)] = e.text
    return "\n".join(x for x in lines if x.strip()), core


def _pdf(content: bytes) -> tuple[str, dict]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ParseError("no PDF reader is installed") from e
    reader = PdfReader(io.BytesIO(content))
    return "\n\n".join(p.extract_text() or "" for p in reader.pages), {k.lstrip("/"): str(v) for k, v in (reader.metadata or {}).items()}


def parse(name: str, content: bytes) -> tuple[str, dict, dict]:
    """(text, embedded metadata, front matter) of a file."""
    kind = name[name.rfind(".") :].lower() if "." in name else ""
    if kind not in EXTENSIONS:
        raise ParseError(f"unsupported extension {kind or 'none'}")
    if not content:
        raise ParseError("the file is empty")
    embedded: dict = {}
    front: dict = {}
    try:
        if kind == ".docx":
            text, embedded = _docx(content)
        elif kind == ".pdf":
            text, embedded = _pdf(content)
        else:
            text = content.decode("utf-8", "replace")
            if kind != ".txt":
                front, text = front_matter(text.replace("\r\n", "\n"))
    except ParseError:
        raise
    except Exception as e:
        raise ParseError(f"{type(e).__name__}: {e}") from e
    if not text.strip():
        raise ParseError("the document has no text")
    return text.strip(), embedded, front


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    value = pa.map_(pa.string(), pa.struct([("v", pa.string()), ("t", pa.string())]))
    for b in batches:
        out = []
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            try:
                text, embedded, front = parse(path, content or b"")
                out.append((text, list(tagged(embedded).items()), list(tagged(front).items()), None))
            except ParseError as e:
                out.append((None, [], [], str(e)))
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*b.columns[:1], *b.columns[2:], *(pa.array(c, k) for c, k in zip(cols, (pa.string(), value, value, pa.string())))], names=["path", "length", "text", "embedded", "frontmatter", "error"])


def parse_files(files: DataFrame, modified: DataFrame | None = None) -> DataFrame:
    """Documents from a binaryFile table; what cannot be read has an error in place of a text.

    modified (filename, modified_at) are times that a client reports; they go
    before those in the file.
    """
    raw = files.select("path", "content", "length").mapInArrow(_rows, f"path string, length bigint, text string, embedded map<string,{VALUE}>, frontmatter map<string,{VALUE}>, error string")
    name = F.element_at(F.split("path", "/"), -1)
    when = lambda *keys: F.coalesce(*(D.document_datetime(F.try_element_at("embedded", F.lit(k))["v"]) for k in keys))
    ordinal = F.lit(None).cast("long") if files.isStreaming else F.monotonically_increasing_id()  # files of a stream have no order
    docs = raw.withColumn("ordinal", ordinal).select("ordinal", F.sha2("path", 256).alias("document_id"), name.alias("filename"), F.col("length").alias("file_size"), "text", "embedded", "frontmatter", "error", F.col("path").alias("source_path"), when("created", "creationDate", "CreationDate").alias("created_at"), when("modified", "modDate", "ModDate").alias("file_modified"))
    if modified is None:
        return docs.withColumnRenamed("file_modified", "modified_at")
    return docs.join(modified.select("filename", F.col("modified_at").alias("client")), "filename", "left").withColumn("modified_at", F.coalesce("client", "file_modified")).drop("client", "file_modified")


def read(spark: SparkSession, path: str, modified: DataFrame | None = None) -> DataFrame:
    return parse_files(spark.read.format("binaryFile").load(path), modified)


def upload(spark: SparkSession, path: str, modified: DataFrame | None = None) -> DataFrame:
    """Documents of an upload's folder, or an error when it exceeds what an upload may hold; what cannot be read has an error for a text."""
    files = guarded(spark.read.format("binaryFile").load(path))
    odd = [r["path"].rpartition("/")[2] for r in files.select("path").collect() if not r["path"].lower().endswith(EXTENSIONS)]
    if odd:
        raise ParseError(f"unsupported file {odd[0]}")
    return parse_files(files, modified)


def client_modified(spark: SparkSession, text: str | None) -> DataFrame:
    """(filename, modified_at) of a JSON object; what is no time is left out."""
    one = spark.createDataFrame([(text or "{}",)], "j string").select(F.explode(F.from_json("j", "map<string,string>")).alias("filename", "raw"))
    return one.select("filename", D.document_datetime(F.col("raw")).alias("modified_at")).where("modified_at IS NOT NULL")


def guarded(files: DataFrame, documents: int = MOST_DOCUMENTS, file: int = MOST_FILE, total: int = MOST_TOTAL) -> DataFrame:
    """files, or an error when there is none, are too many or too large. For uploads; corpora need no such limit."""
    r = files.agg(F.count("*").alias("n"), F.max("length").alias("most"), F.sum("length").alias("all")).first()
    if not r["n"]:
        raise ParseError("no document was given")
    if r["n"] > documents or r["most"] > file or r["all"] > total:
        raise ParseError(f"the upload exceeds {documents} documents, {file} bytes a file or {total} in all")
    return files


def from_table(table: DataFrame, document_id: str, text: str, filename) -> DataFrame:
    """Documents from a table that has their text already."""
    none = F.create_map().cast(f"map<string,{VALUE}>")
    return table.select(F.col(document_id).cast("string").alias("document_id"), F.col(document_id).cast("long").alias("ordinal"), filename.alias("filename"), F.col(text).alias("text"), F.octet_length(text).cast("long").alias("file_size"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("modified_at"), none.alias("embedded"), none.alias("frontmatter"))
