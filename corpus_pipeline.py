"""From documents to packed sequences: language, near-duplicates, benchmark leaks, secrets, packing.

Every stage takes all that its predecessor kept, written as Parquet and read again, and gives back the columns of the
documents; the last one gives one row for each piece of a document in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import decontaminate, langid, packing, secrets, setsketch
from terrane.llm.common import held_out, materialise, table
from terrane.llm.registry import VOCABULARY


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned from these rows; texts without letters and undecided ones go."""
    model = langid.train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return langid.keep_identified(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return setsketch.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with owner-specific credentials masked in their texts."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed-length sequences, with their token ids."""
    return packing.pack(docs, VOCABULARY)


STAGES = [("language", identified), ("near_duplicates", distinct), ("decontamination", uncontaminated), ("secrets", redacted), ("packing", packed)]

#: SQL can express neither language identification nor token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs
