"""A corpus pipeline of five operators: clean, deduplicate, redact, mix, pack. It counts as part of sheafmill.llm, without which it cannot be imported.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame. All but the last return the
columns of ``documents``: quality rules drop rejected documents and failing lines, near-duplicates leave one document of a group,
secrets are masked in the text, the mixture repeats or cuts documents to the source weights, and packing returns spans.

Edge cases: a document of null or empty text has no words, so the quality rules reject it; rows with a null or repeated doc_id are told apart by their
text, and of rows equal in both one is left; a null source is a source of its own, and a null n_chars is worked out anew; very long texts stay
whole; extra columns pass through all stages but the last, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafmill.llm import minhash, mixing, packing, quality, secrets
from sheafmill.llm.common import materialise, remove, scratch
from sheafmill.session import ship


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(quality.clean_documents(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(secrets.redacted(docs))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(mixing.mix_documents(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, capacity=2048, cache_pieces=100_000)  # workers still hold what the stages before needed


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mixture", source_mixture),
    ("best-fit packing", best_fit_packing),
]

#: Hash orders, a trained forest and a tokenizer are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = ship(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as held:
            docs = materialise(stage(ship(spark), docs, sf_dir), f"stage-{name.replace(' ', '-')}")
            held.append(docs)
        if before:  # a stage's table goes when the next one's is whole
            remove(spark, before)
        before = docs._table
    return STAGES[-1][1](spark, docs, sf_dir)
