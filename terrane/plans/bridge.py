"""Views of the driver's tables as occurrences, communities and feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.community import explode_lists

#: The languages of the texts, in the order of their clusters from 1.
LANGUAGES = ("de", "en", "es", "fr")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(locality_id, species_id): customers hold the parts that they ordered."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    # distinct as whole numbers, which need a fraction of the memory of their texts
    pairs = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("o_custkey", "l_partkey").distinct()
    return pairs.select(F.col("o_custkey").cast("string").alias("locality_id"), F.col("l_partkey").cast("string").alias("species_id"))


def localities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(locality_id, key, e, n, lat, lon, sci, cluster): customers on a 2.5 km lattice; the cluster is the region."""
    c, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    return c.join(F.broadcast(nation), c["c_nationkey"] == nation["n_nationkey"]).select(
        k.cast("string").alias("locality_id"), k.alias("key"),
        (300000 + (k * 7919) % 97 * 2500).cast("double").alias("e"), (6200000 + (k * 104729) % 89 * 2500).cast("double").alias("n"),
        (F.lit(55.0) + ((k * 7919) % 1450).cast("double") / 100).alias("lat"), (F.lit(10.0) + ((k * 104729) % 1500).cast("double") / 100).alias("lon"),
        F.col("c_mktsegment").alias("sci"), F.col("n_regionkey").cast("long").alias("cluster"),
    )


def sites_of(customers: DataFrame) -> DataFrame:
    """(sci, fid, e, n): customers on a 10 m lattice."""
    k = F.col("c_custkey")
    return customers.select(F.col("c_mktsegment").alias("sci"), k.alias("fid"), (500000 + (k * 7919) % 400 * 10).cast("double").alias("e"), (6500000 + (k * 104729) % 400 * 10).cast("double").alias("n"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites_of(table(spark, sf_dir, "customer"))


def points_of(orders: DataFrame, *more: Column) -> DataFrame:
    """(tid, pid, locality, e, n): orders on the same lattice; the taxon is the clerk-independent priority and status."""
    k = F.col("o_orderkey")
    return orders.select(
        F.concat(F.substring("o_orderpriority", 1, 1), F.lit("-"), F.col("o_orderstatus")).alias("tid"), k.alias("pid"), F.concat(F.lit("loc "), (k % 500).cast("string")).alias("locality"),
        (500000 + (k * 15485863) % 400 * 10).cast("double").alias("e"), (6500000 + (k * 32452843) % 397 * 10).cast("double").alias("n"), *more,
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_of(table(spark, sf_dir, "orders"))


def red(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("1-O",), ("2-F",), ("3-P",), ("5-O",)], "id string")


def community(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, species_id, count): brands and types of all ordered parts in coarse cells."""
    li, o, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    cell = F.floor((F.col("o_custkey") * 7919) % 97 / 8) * 1000 + F.floor((F.col("o_custkey") * 104729) % 89 / 8)
    return joined.select(cell.cast("long").alias("cell_id"), F.concat_ws("-", "p_brand", "p_type").alias("species_id")).groupBy("cell_id", "species_id").agg(F.count("*").alias("count"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, cluster, species_id, count): words of texts in cells of a language and a source; clusters are the languages."""
    lists = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("")).alias("lang"), F.concat(F.coalesce("lang", F.lit("")), F.lit("|"), F.coalesce("source", F.lit(""))).alias("cell_id"), "text")
    lists = lists.withColumn("cluster", F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("lang"))).drop("lang")
    return explode_lists(lists, "cell_id", "text", distinct=True).groupBy("cell_id", "cluster", "species_id").agg(F.count("*").alias("count"))


def community_labels(counts: DataFrame) -> DataFrame:
    return counts.select("cell_id", (F.col("cell_id") % 4).cast("long").alias("cluster")).distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cluster, v) of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("cluster"), F.col("embedding").cast("array<double>").alias("v"))
