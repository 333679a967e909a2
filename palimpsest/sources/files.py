"""Documents by file type, and text sinks."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs of a Word file, by line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))


def parse(path: str, content: bytes, pdf=None) -> tuple[str | None, str | None]:
    """(text, error) by extension; PDF needs a parser of bytes to be given."""
    kind = re.search(r"\.([A-Za-z]+)$", path)
    kind = kind[1].lower() if kind else ""
    try:
        if kind in ("md", "markdown"):
            return content.decode("utf-8", "replace"), None
        if kind == "docx":
            return docx_text(content), None
        if kind == "pdf" and pdf:
            return pdf(content), None
        return None, f"unsupported: {kind}"
    except Exception as e:  # a broken file is a row of its own
        return None, str(e)[:200]


def read_documents(spark: SparkSession, folder: str, pdf=None) -> DataFrame:
    """path, text, file_hash and error of each supported file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,docx,md,markdown}").option("recursiveFileLookup", "true").load(folder)
    return parsed(files.select("path", "content", F.md5("content").alias("file_hash")), pdf)


def parsed(files: DataFrame, pdf=None) -> DataFrame:
    """path, text, file_hash and error of files (path, content, file_hash)."""

    def run(batches):
        for batch in batches:
            paths = batch.column(0).to_pylist()
            found = [parse(p, c, pdf) for p, c in zip(paths, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), batch.column(2), pa.array([e for _, e in found], pa.string())], ["path", "text", "file_hash", "error"])

    return files.select("path", "content", "file_hash").mapInArrow(run, "path string, text string, file_hash string, error string")


def write_daily(messages: DataFrame, folder: str) -> None:
    """A bullet for each message (ts, content, and session_id if there is one), in a folder for each day."""
    session = F.when(F.col("session_id").isNotNull(), F.concat(F.lit(" ("), "session_id", F.lit(")"))).otherwise("") if "session_id" in messages.columns else F.lit("")
    line = F.concat(F.lit("- ["), F.date_format("ts", "HH:mm"), F.lit("]"), session, F.lit(" "), F.col("content"))
    messages.select(F.to_date("ts").alias("day"), line.alias("value")).write.mode("append").partitionBy("day").text(folder)


def model_json(output: Column, schema: str) -> Column:
    """The object in a model's answer: fences off, trailing commas off, parsed or null."""
    body = F.regexp_extract(F.regexp_replace(output, r"```(?:json)?", ""), r"(?s)\{.*\}", 0)
    return F.from_json(F.regexp_replace(body, r",\s*([}\]])", "$1"), schema)
