"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that is reachable.

    Every round is written to the shared folder, which cuts the lineage; nothing but counts comes to the driver. Loops and
    repeated edges are allowed, rows with a null end are ignored; no edges give no rows.
    """
    now = materialise(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "edges")
    before = _state(now)
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        after = materialise(small, "edges")
        discard(now)
        now, state = after, _state(after)
        if state == before:
            break
        before = state
    out = materialise(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct(), "components")
    discard(now)
    return out


def _state(edges: DataFrame) -> tuple:
    """Count and order-free sums of hashes; equal for equal edge sets."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").bitwiseAND((1 << 40) - 1)).alias("x"), F.sum(F.xxhash64("b", "a").bitwiseAND((1 << 40) - 1)).alias("y")).first()
    return tuple(r)
