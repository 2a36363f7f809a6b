"""A corpus pipeline of five operators; every stage works on all that the one before it kept.

The tokens of the last stage refer to the texts that the fourth leaves.  The stages before it return the five columns of documents;
other columns, whatever their names, end with the first stage.  Null and empty texts are clean in every stage and packed as their
end token; rows with a null doc_id stay up to the last stage.  Rows that share a doc_id go together where one of them is a leak
or a near duplicate.  An empty table of documents, labels or benchmark items gives an empty result or leaves documents alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.decontaminate import drop_leaks
from siltstone.llm.minhash import MinMaxConfig, keep_one
from siltstone.llm.packing import pack_documents
from siltstone.llm.secrets import redact_secrets
from siltstone.llm.storage import Workspace
from siltstone.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the weakly supervised classifier, fitted on the labels there are, calls toxic."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return score_toxicity(docs, model, keep=COLUMNS).where("score < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group at a similarity of 0.8 over five-word shingles."""
    return keep_one(spark, docs, MinMaxConfig(shingle=5)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents into which a benchmark item leaked."""
    return drop_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets; n_chars follows the text."""
    return redact_secrets(docs.select(*COLUMNS)).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of the sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: The stages use trained models, sketches and a tokenizer: not SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    ws = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
        ws.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
