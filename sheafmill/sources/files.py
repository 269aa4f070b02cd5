"""File sources and sinks: whole files, images, Word documents, the stored tables and plain transcripts."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import routing as R

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
TABLES = {
    "documents": "id string, original_filename string, stored_path string, upload_time timestamp_ntz, status string",
    "ocr_results": "id string, document_id string, extracted_text string, confidence double, created_at timestamp_ntz, status string",
    "translations": "id string, document_id string, translated_text string, model_used string, created_at timestamp_ntz, status string",
    "audio_transcriptions": "id string, document_id string, transcribed_text string, language_detected string, audio_duration double, created_at timestamp_ntz, status string",
}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content, ext and route of every file below ``path``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    f = f.select("path", "length", "content", R.extension(F.col("path")).alias("ext"))
    return f.withColumn("route", R.route(F.col("ext")))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images (BGR); unreadable files have height -1."""
    return spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")


def docx_text(content: bytes) -> str | None:
    """Paragraphs of a docx file, joined by line feeds and stripped; None for a file that is no docx."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ET.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return None
    return "\n".join("".join(t.text or "" for t in p.iter(f"{W}t")) for p in root.iter(f"{W}p")).strip()


def word_pages(files: DataFrame) -> DataFrame:
    """One page of confidence 1 a Word file: path, page_no, text, confidence, ok. Files of the older format, and others that cannot be read, are rows that are not ok."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            text = f.content.map(docx_text)
            yield pd.DataFrame({"path": f.path, "page_no": 0, "text": text, "confidence": 1.0, "ok": text.notna()})

    return files.filter(F.col("ext").isin(*R.WORD_FILE)).select("path", "content").mapInPandas(run, "path string, page_no int, text string, confidence double, ok boolean")


def with_id(rows: DataFrame, *natural: str) -> DataFrame:
    """A stable id from the natural key, so that a retried insert writes the same row."""
    return rows.withColumn("id", F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in natural]), 256))


def typed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` in the schema of a stored table; columns that they lack are null."""
    schema = StructType.fromDDL(TABLES[name])
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def append(rows: DataFrame, root: str, name: str) -> DataFrame:
    """Append to one of the stored tables in its own schema; the write is the unit that commits."""
    out = typed(rows, name)
    out.write.mode("append").parquet(f"{root}/{name}")
    return out


def append_or_skip(rows: DataFrame, root: str, name: str) -> tuple[DataFrame, str]:
    """As ``append``, but a table that cannot be written does not stop the answer: the rows come back with "saved" or "skipped"."""
    try:
        return append(rows, root, name), "saved"
    except (AnalysisException, Py4JJavaError):
        return typed(rows, name), "skipped"


def with_persistence(rows: DataFrame, saved: Column, may_skip: Column, warning: str) -> DataFrame:
    """``rows`` with answered, persistence_status, document_status and warning: what may skip saving is answered all the same."""
    return rows.withColumns(
        {
            "answered": may_skip | saved,
            "persistence_status": F.when(saved, "saved").when(may_skip, "skipped"),
            "document_status": F.when(saved, "Completed"),
            "warning": F.when(may_skip & ~saved, warning),
        }
    )


def create_tables(spark: SparkSession, root: str, database: str = "default") -> None:
    """The stored tables in the catalog, over the folders that ``append`` writes; those that are there stay."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet LOCATION '{root}/{name}'")


def drop_tables(spark: SparkSession, database: str = "default") -> None:
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def dashed(hexes: Column) -> Column:
    return F.regexp_replace(hexes, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def canonical_uuid(text: Column) -> Column:
    """A UUID in lower case with its dashes, however it was written; null for anything else."""
    plain = F.lower(text)
    return F.when(plain.rlike("^([0-9a-f]{32}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$"), dashed(F.replace(plain, F.lit("-"), F.lit(""))))


def read_stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def orphans(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Results whose document is missing."""
    return read_stored(spark, root, name).join(read_stored(spark, root, "documents").select(F.col("id").alias("document_id")), "document_id", "left_anti")


def write_transcripts(rows: DataFrame, path: str, text: str = "text") -> None:
    rows.select(F.col(text).cast("string").alias("value")).write.mode("overwrite").text(path)
