"""Shared helpers: table access, folds, samples and size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialise, scratch_dir


__all__ = ["broadcast_if_small", "discard", "fraction_of", "fresh", "held_out", "materialise", "sample_labels", "scratch_dir", "table", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the id's decimal text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fraction_of(*cols: str, salt: int) -> Column:
    """A deterministic uniform value in [0, 1) from the columns."""
    return F.pmod(F.xxhash64(F.lit(salt), *[F.col(c) for c in cols]), F.lit(1 << 30)) / float(1 << 30)


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only when the counted rows are within ``limit``; otherwise Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def without(docs: DataFrame, gone: DataFrame, key: Column | None = None, limit: int = 2_000_000) -> DataFrame:
    """``docs`` whose ``key`` (doc_id if none is given) is not in the first column of ``gone``; null keys stay.

    All columns stay, whatever they are called. Texts are shuffled only if the keys are too many to broadcast.
    """
    name = fresh(docs, "gone")
    ids = materialise(gone.select(F.col(gone.columns[0]).alias(name)).filter(F.col(name).isNotNull()).distinct(), "gone")
    key = F.col("doc_id").cast("long") if key is None else key
    return docs.join(broadcast_if_small(ids, ids.count(), limit), key == F.col(name), "left_anti")


def sample_labels(labels: DataFrame, per_label: int, salt: int) -> tuple[DataFrame, dict]:
    """About ``per_label`` rows (doc_id, label) of each label 0 and 1, by a hash of doc_id, and the share of each label taken.

    The sample's size is bounded by ``per_label``, not by the data, so it may be broadcast.
    """
    labels = labels.select("doc_id", F.col("label").cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL")
    found = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, per_label / n) for k, n in found.items()}
    chosen = labels.filter(fraction_of("doc_id", salt=salt) < F.when(F.col("label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    return chosen, share
