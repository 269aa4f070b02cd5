"""Several tables written together or not at all.

A unit of work has an id. Its rows go to folders that no reader looks at; a manifest that names them is then put in place by one rename, and from that moment all
its tables are visible. A unit whose manifest is there is not written again, so a retried batch changes nothing; what an interrupted unit left is
invisible, and ``vacuum`` removes it. The folder's file system must rename a file in one step and refuse to overwrite it (HDFS and local disks do; on an object store a
committer with that promise is needed).

Edge cases: a table without rows is published as such; a table that no unit has written is empty; rows are not told apart, repeated ones stay.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(root: str, unit: str) -> str:
    return f"{root}/_manifests/{unit}.json"


def published(spark: SparkSession, root: str, unit: str) -> bool:
    p, files = _files(spark, _manifest(root, unit))
    return files.exists(p)


def stage(root: str, unit: str, tables: dict[str, DataFrame]) -> dict[str, str]:
    """Write a unit's tables where nobody reads them; name and folder of each, relative to ``root``."""
    attempt = f"_staged/{unit}/{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/{attempt}/{name}")
    return {name: f"{attempt}/{name}" for name in tables}


def seal(spark: SparkSession, root: str, unit: str, folders: dict[str, str]) -> bool:
    """Put a staged unit's manifest in place; False if another attempt was first."""
    draft, files = _files(spark, f"{root}/_drafts/{unit}-{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps({"unit": unit, "tables": folders}).encode()))
    out.close()
    final, _ = _files(spark, _manifest(root, unit))
    files.mkdirs(final.getParent())
    if files.exists(final):
        files.delete(draft, False)
        return False
    return files.rename(draft, final)


def publish(root: str, unit: str, tables: dict[str, DataFrame]) -> bool:
    """Write the tables of a unit and make them visible together; False, and no write, if the unit is already there."""
    spark = next(iter(tables.values())).sparkSession
    return not published(spark, root, unit) and seal(spark, root, unit, stage(root, unit, tables))


def publish_or_skip(root: str, unit: str, tables: dict[str, DataFrame]) -> str:
    """As ``publish``, but a store that cannot be written does not stop the answer: "saved" or "skipped"."""
    try:
        publish(root, unit, tables)
        return "saved"
    except (PySparkException, Py4JJavaError):
        return "skipped"


def answered(rows: DataFrame, status: str, warning: str) -> DataFrame:
    """``rows`` with persistence_status, and the warning of a unit that was not saved."""
    return rows.withColumns({"persistence_status": F.lit(status), "warning": F.lit(warning if status == "skipped" else None).cast("string")})


def manifests(spark: SparkSession, root: str) -> list[dict]:
    p, files = _files(spark, f"{root}/_manifests")
    if not files.exists(p):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(p))
    rows = spark.read.text([f"{root}/_manifests/{n}" for n in names], wholetext=True).collect() if names else []
    return sorted((json.loads(r["value"]) for r in rows), key=lambda m: m["unit"])


def read(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """All published rows of a table."""
    folders = [f"{root}/{m['tables'][table]}" for m in manifests(spark, root) if table in m["tables"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], StructType.fromDDL(schema))


def vacuum(spark: SparkSession, root: str) -> int:
    """Remove the folders of attempts that no manifest names; run it while no unit is being written. The number removed."""
    kept, removed = {f.rsplit("/", 1)[0] for m in manifests(spark, root) for f in m["tables"].values()}, 0
    p, files = _files(spark, f"{root}/_staged")
    for unit in files.listStatus(p) if files.exists(p) else ():
        for attempt in files.listStatus(unit.getPath()):
            if f"_staged/{unit.getPath().getName()}/{attempt.getPath().getName()}" not in kept:
                removed += files.delete(attempt.getPath(), True)
    return removed


def consolidated(documents: DataFrame, key: str, name: Column, extracted: Column, confidence: Column, translated: Column, model: Column) -> dict[str, DataFrame]:
    """The three records of each processed document, as a unit: the document, completed, its extraction and its translation. Ids come from the key, so a retry writes the same."""
    made = documents.select(F.col(key).cast("string").alias("k"), name.alias("name"), extracted.alias("extracted"), confidence.alias("confidence"), translated.alias("translated"), model.alias("model"))
    own = lambda kind: F.sha2(F.concat_ws("\x1f", F.lit(kind), "k"), 256).alias("id")
    document = F.sha2(F.concat_ws("\x1f", F.lit("document"), "k"), 256)
    return {
        "documents": made.select(own("document"), F.col("name").alias("original_filename"), F.col("name").alias("stored_path"), F.lit("Completed").alias("status")),
        "ocr_results": made.select(own("ocr"), document.alias("document_id"), F.col("extracted").alias("extracted_text"), F.col("confidence").cast("double").alias("confidence"), F.lit("Extracted").alias("status")),
        "translations": made.select(own("translation"), document.alias("document_id"), F.col("translated").alias("translated_text"), F.col("model").alias("model_used"), F.lit("Completed").alias("status")),
    }
