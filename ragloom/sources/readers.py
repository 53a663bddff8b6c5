"""Corpora, sets, runs, reviews and settings as DataFrames."""

from __future__ import annotations

import csv
import html.parser
import io
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.operators import versioning

EXTENSIONS = ("txt", "md", "pdf", "docx", "html", "htm", "csv")

INTENT = "struct<id:string,text:string,required:boolean,source_chunk_id:string>"
RECORD = (
    "id string, question string, question_clean string, question_type string, noise_profile array<string>, difficulty string, gold_answer string, gold_chunk_ids array<array<string>>, gold_chunks_text array<array<string>>, "
    f"intent_points array<{INTENT}>, unanswerable boolean, requires_synthesis boolean, domain_tags array<string>, source_doc_ids array<string>, scoring_notes string"
)
CHUNK = "id string, doc_id string, text string, index int, token_count int, metadata map<string,string>"
CHANGE = "version string, action string, details string, record_ids array<string>"
_DIM = "struct<score:double,verdicts:map<string,struct<question_id:string,verdict:boolean,reason:string>>>"
RESULT = (
    "record_id string, question string, question_type string, noise_profile array<string>, difficulty string, rag_answer string, rag_contexts array<string>, rag_error string, chunk_recall double, set_recall boolean, mrr double, "
    f"precision_at_k double, gold_chunk_ranks array<int>, faithfulness {_DIM}, correctness {_DIM}, abstention {_DIM}, completeness {_DIM}, conciseness {_DIM}, overall_score double, intent_coverage double, "
    "intent_details array<struct<intent_point_id:string,covered:boolean,reason:string>>, discovered_alt_chunks array<string>, domain_tags array<string>"
)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content, ext of all files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return rows.select("path", "content", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"))


def decoded(raw: bytes) -> str:
    """Text by its byte order mark, else UTF-8, else UTF-8 with replacement."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return str(raw, name, "replace")
    return str(raw, "utf-8", "replace")


class _Texts(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.texts.append(data)


def html_to_text(source: str) -> str:
    parser = _Texts()
    parser.feed(source)
    parser.close()
    return "\n".join(parser.texts)


def csv_to_text(source: str) -> str:
    """A line "header: value; header: value" for each row; the shorter side decides."""
    header, *body = list(csv.reader(io.StringIO(source))) or [[]]
    return "\n".join("; ".join(map(": ".join, zip(header, row, strict=False))) for row in body)


def docx_to_text(raw: bytes) -> str:
    """Paragraphs that aren't blank, then table rows with cells joined by " | "."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{w}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t"))
    nodes = list(body) if body is not None else []
    parts = [text(p) for p in nodes if p.tag == f"{w}p" and text(p).strip()]
    for t in nodes:
        if t.tag == f"{w}tbl":
            parts += [" | ".join("\n".join(text(p) for p in c.iter(f"{w}p")) for c in row.iter(f"{w}tc")) for row in t.iter(f"{w}tr")]
    return "\n\n".join(parts)


def pdf_to_text(raw: bytes) -> str:
    """Pages joined by a blank line; needs one of the libraries that read PDF."""
    try:
        import pypdf
    except ImportError as missing:
        raise RuntimeError("reading PDF needs the package pypdf") from missing
    return "\n\n".join(page.extract_text() for page in pypdf.PdfReader(io.BytesIO(raw)).pages)


def file_to_text(raw: bytes, ext: str) -> str:
    if ext == "docx":
        return docx_to_text(raw)
    if ext == "pdf":
        return pdf_to_text(raw)
    text = decoded(raw)
    return html_to_text(text) if ext in ("html", "htm") else csv_to_text(text) if ext == "csv" else text


def load_directory(spark: SparkSession, folder: str, ids: str = "stem") -> DataFrame:
    """doc_id, path, text of the supported files below a folder; ids: "stem", or "path" where stems repeat.

    A folder that isn't there or has no such file raises, as does a file that can't be read.
    """
    if "://" not in folder and not os.path.isdir(folder):
        raise NotADirectoryError(folder)
    found = files(spark, folder).where(F.col("ext").isin(*EXTENSIONS))
    if found.isEmpty():
        raise ValueError(f"no supported file in {folder}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [file_to_text(bytes(c), e) for c, e in zip(pdf["content"], pdf["ext"], strict=True)]})

    texts = found.mapInPandas(run, "path string, text string")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    root = re.sub(r"^\w+:/*|/+$", "", folder if "://" in folder else os.path.abspath(folder)).lstrip("/")
    inner = F.regexp_replace("path", F.lit(r"^\w+:/*" + re.escape(root) + "/"), F.lit(""))
    return texts.select((stem if ids == "stem" else inner).alias("doc_id"), "path", "text")


def load_document(path: str) -> tuple[str, str]:
    """doc_id and text of one file on the driver."""
    name, _, ext = os.path.basename(path).rpartition(".")
    if ext.lower() not in EXTENSIONS:
        raise ValueError(f"unsupported type of {path}")
    with open(path, "rb") as file:
        return name, file_to_text(file.read(), ext.lower())


def doc_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, hash of each supported file; of a stem that repeats the last path counts."""
    return versioning.doc_hashes(files(spark, folder).where(F.col("ext").isin(*EXTENSIONS)))


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_eval_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """records, chunks, changelog and the head (version, tier, metadata) of a set in JSON."""
    schema = f"version string, tier string, metadata map<string,string>, records array<struct<{_struct(RECORD)}>>, chunks map<string,struct<{_struct(CHUNK)}>>, changelog array<struct<{_struct(CHANGE)}>>"
    doc = _document(spark, path, schema)
    head = doc.select(F.coalesce("version", F.lit("1.0.0")).alias("version"), "tier", "metadata").first()
    return (
        doc.select(F.inline("records")),
        doc.select(F.explode(F.map_values("chunks")).alias("c")).select("c.*"),
        doc.select(F.inline("changelog")),
        head.asDict() if head else {},
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return _document(spark, path, f"tier string, records array<struct<{_struct(RESULT)}>>").select("tier", F.inline("records"))


def _struct(ddl: str) -> str:
    """The fields of a DDL string as those of a struct type."""
    return ",".join(re.sub(r"^\s*(\w+) ", r"\1:", part) for part in re.split(r",\s(?=\w+ \w)", ddl))


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a review with their order in it as ord."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("ord", F.monotonically_increasing_id())


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, text of the .txt files of a folder."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def calibration_rows(responses: DataFrame, sources: DataFrame) -> DataFrame:
    """Responses with their question and passages: an equality join on source_id, of question-answering sources only."""
    qa = sources.where(F.col("task_type") == "QA").select("source_id", "question", "passages")
    return responses.join(qa, "source_id").withColumn("has_hallucination", F.size("labels") > 0)


def external_records(rows: DataFrame) -> DataFrame:
    """Records of another generator's rows (ord, question, contexts, ground_truth, synthesizer_name): one gold group of all contexts.

    A name with "multi_hop" makes a question on several documents; passages have ids by their text.
    """
    multi = F.contains(F.col("synthesizer_name"), F.lit("multi_hop"))
    ids = F.transform("contexts", lambda c: F.substring(F.sha1(c), 1, 16))
    none = F.array().cast("array<string>")
    return rows.select(
        F.format_string("ext-%04d", "ord").alias("id"), "question", F.col("question").alias("question_clean"), F.when(multi, "cross_doc").otherwise("single_chunk").alias("question_type"), F.array(F.lit("clean")).alias("noise_profile"), F.lit("medium").alias("difficulty"),
        F.col("ground_truth").alias("gold_answer"), F.array(ids).alias("gold_chunk_ids"), F.array("contexts").alias("gold_chunks_text"), F.array().cast(f"array<{INTENT}>").alias("intent_points"), F.lit(False).alias("unanswerable"), multi.alias("requires_synthesis"), none.alias("domain_tags"), none.alias("source_doc_ids"), F.lit("").alias("scoring_notes"),
    )


def read_conf(path: str) -> dict[str, str]:
    """KEY=VALUE lines; none for a file that isn't there. For the driver only."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        lines = [line.strip() for line in file]
    return {k.strip(): v.strip() for k, _, v in (line.partition("=") for line in lines if "=" in line and not line.startswith("#"))}
