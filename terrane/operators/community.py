"""Composition tables: presence, counts for each cell, relative abundance, centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import share_of_total, split_ids, strip
from ..scratch import materialise
from ..shipping import ship
from .ranks import medians, numbered
from .spatial import with_cells

#: Cells of a species from which on its values are multiplied in dense blocks.
HEAVY = 1000


def explode_lists(df: DataFrame, key: str, lists: str, distinct: bool = False, marker: bool = False) -> DataFrame:
    """(key, species_id, ...) from space-joined lists; rows with a blank key or list are dropped.

    With ``distinct`` an id counts once a list; with ``marker`` each list also has a row without an id, to count lists by.
    """
    df = df.filter(F.col(key).isNotNull() & F.col(lists).isNotNull()).filter((F.length(strip(F.col(key))) > 0) & (F.length(strip(F.col(lists))) > 0))
    ids = F.array_distinct(split_ids(F.col(lists))) if distinct else split_ids(F.col(lists))
    ids = F.array_append(ids, F.lit(None).cast("string")) if marker else ids
    return df.withColumn("species_id", F.explode(ids)).drop(lists)


def without(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``column`` is in none of the ids; a missing value stays."""
    ids = ids.toDF("__id").filter("__id IS NOT NULL").distinct()
    return df.join(ids, F.col(column) == F.col("__id"), "left_anti")


def within(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    ids = ids.toDF("__id").filter("__id IS NOT NULL").distinct()
    return df.join(ids, F.col(column) == F.col("__id"), "left_semi")


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def vocabulary(presence: DataFrame, species: str = "species_id") -> DataFrame:
    """(col_index, species_id): a dense index in the ids' lexical order."""
    ids = presence.select(F.col(species).alias("species_id")).filter("species_id IS NOT NULL")
    return numbered(ids, ["species_id"], "col_index").select(F.col("col_index").cast("int").alias("col_index"), "species_id")


def named_species(index: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``species``: the first name of each id, or the id itself where there is none."""
    first = names.groupBy("species_id").agg(F.min_by("name", "rank").alias("name"))
    return index.join(first, "species_id", "left").select("col_index", "species_id", F.coalesce("name", "species_id").alias("species"))


def locality_summary(rows: DataFrame) -> DataFrame:
    """(locality_id, latband, n, e) from deduplicated species rows (file, row, locality_id, species_id, latband, n, e).

    The band is the first seen, 'NA' if that is missing; coordinates are medians over all deduplicated species rows of
    each file, so a row counts once for each species it brings.
    """
    once = first_rows(rows, ["file", "locality_id", "species_id"], ["row"])
    bands = rows.groupBy("locality_id").agg(F.min_by(F.coalesce("latband", F.lit("NA")), F.struct("file", "row")).alias("latband"))
    whole = once.filter("n IS NOT NULL AND e IS NOT NULL")
    return bands.join(medians(whole, ["locality_id"], "n"), "locality_id", "left").join(medians(whole, ["locality_id"], "e"), "locality_id", "left")


def cell_counts(presence: DataFrame, localities: DataFrame, size: float = 10_000.0, x: str = "e", y: str = "n") -> DataFrame:
    """(cell_id, gx, gy, species_id, count): in how many localities of a cell each species is."""
    placed = with_cells(localities.select("locality_id", x, y), x, y, size).select("locality_id", "cell_id", "gx", "gy")
    return presence.join(placed, "locality_id").groupBy("cell_id", "gx", "gy", "species_id").agg(F.count("*").alias("count"))


def hellinger(counts: DataFrame, cell: str = "cell_id", value: str = "count") -> DataFrame:
    """(cell, species_id, value): roots of relative abundances; rows have unit norm."""
    return counts.select(cell, "species_id", F.sqrt(share_of_total(F.col(value).cast("double"), cell)).alias("value"))


def cell_index(localities: DataFrame, size: float = 10_000.0, x: str = "e", y: str = "n") -> DataFrame:
    """(cell_id, gx, gy, n_centroid, e_centroid, n_localities): means of coordinates."""
    placed = with_cells(localities, x, y, size)
    return placed.groupBy("cell_id", "gx", "gy").agg(F.avg(y).alias("n_centroid"), F.avg(x).alias("e_centroid"), F.count("*").alias("n_localities"))


def cell_order(localities: DataFrame, size: float = 10_000.0, x: str = "e", y: str = "n", order: str = "locality_id") -> DataFrame:
    """(cell_id, cell_no): cells numbered by the first locality that falls into each."""
    seen = with_cells(localities, x, y, size).groupBy("cell_id").agg(F.min(order).alias("first"))
    return numbered(seen, ["first", "cell_id"], "cell_no").select("cell_id", F.col("cell_no").cast("int").alias("cell_no"))


def pair_dots(features: DataFrame, cell: str = "cell_id", heavy: int = HEAVY) -> DataFrame:
    """(i, j, dot) for cells i < j that share a species."""
    rows = features.select(F.lit(0).alias("g"), F.col(cell).alias("c"), F.col("species_id").alias("s"), F.col("value").alias("v"))
    return shared_sums(rows, heavy).drop("g")


def shared_sums(rows: DataFrame, heavy: int = HEAVY, block: int = 512, columns: int = 1024) -> DataFrame:
    """(g, i, j, dot) of rows (g, c, s, v): sums of v times v over what cells i < j of a group share.

    Species are counted first. Those of at most ``heavy`` cells of a group meet by key. The others would bring one task the
    square of their cells, so their values go to dense blocks of about ``block`` cells by ``columns`` species, and pairs of blocks
    are multiplied; however common a species is, a task holds two blocks.
    """
    found = rows.groupBy("g", "s").agg(F.count("*").alias("n")).filter(F.col("n") > heavy).select("g", "s")
    found = materialise(found, "heavy-species")
    rare = rows.join(found, ["g", "s"], "left_anti")
    a, b = rare.select("g", "s", F.col("c").alias("i"), F.col("v").alias("vi")), rare.select("g", "s", F.col("c").alias("j"), F.col("v").alias("vj"))
    light = a.join(b, ["g", "s"]).filter("i < j").groupBy("g", "i", "j").agg(F.sum(F.col("vi") * F.col("vj")).alias("dot"))
    if found.isEmpty():
        return light
    ship(rows.sparkSession)
    common = rows.join(found, ["g", "s"], "left_semi")
    cells = common.groupBy("g", "c").agg(F.lit(1)).groupBy("g").agg(F.ceil(F.count("*") / block).alias("blocks"))
    sizes = cells.join(found.groupBy("g").agg(F.ceil(F.count("*") / columns).alias("parts")), "g")
    dealt = common.join(sizes, "g").withColumns({"block": F.pmod(F.xxhash64("c"), F.col("blocks")), "part": F.pmod(F.xxhash64("s"), F.col("parts")), "other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
    dealt = dealt.select("g", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "part", "block", "c", "s", "v")
    kinds = dict(rows.dtypes)

    def multiply(key, table):
        low, high = key[1].as_py(), key[2].as_py()
        species = table["s"].combine_chunks().dictionary_encode().indices.to_numpy()
        width, out = int(species.max()) + 1, []
        for at in (low, high):
            own = table["block"].to_numpy() == at
            coded = table["c"].combine_chunks().filter(pa.array(own)).dictionary_encode()
            x = np.zeros((len(coded.dictionary), width))
            np.add.at(x, (coded.indices.to_numpy(), species[own]), table["v"].to_numpy()[own])
            out.append((coded.dictionary, x))
        (left, x), (right, y) = out
        # a block with no cell of these species has no pairs
        i, j = np.nonzero(np.triu(x @ x.T, 1) if low == high else x @ y.T)
        dot = (x @ (x if low == high else y).T)[i, j]
        return pa.table({"g": pa.array([key[0].as_py()] * len(i), table["g"].type), "i": left.take(pa.array(i)), "j": (left if low == high else right).take(pa.array(j)), "dot": dot})

    dense = dealt.groupBy("g", "low", "high", "part").applyInArrow(multiply, f"g {kinds['g']}, i {kinds['c']}, j {kinds['c']}, dot double")
    dense = dense.select("g", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "dot")
    return light.select("g", "i", "j", F.col("dot").cast("double").alias("dot")).union(dense).groupBy("g", "i", "j").agg(F.sum("dot").alias("dot"))


def unit_distance(dot: Column) -> Column:
    """Euclidean distance of two unit vectors."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))


def pair_distances(features: DataFrame, cell: str = "cell_id", block: int = 1024) -> DataFrame:
    """(i, j, d) for all cells i < j; cells that share no species are the root of 2 apart.

    The table has a row for each pair, as asked for. Cells are dealt to blocks and pairs of blocks meet by key, so the pairs
    are spread evenly over tasks and no cross join is planned.
    """
    ids = features.select(F.col(cell).alias("x")).distinct()
    blocks = max(1, -(-ids.count() // block))
    ids = ids.withColumn("a", F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("int"))
    left = ids.withColumn("b", F.explode(F.sequence(F.col("a"), F.lit(blocks - 1))))
    right = ids.select(F.col("x").alias("y"), F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("a"))).alias("a"))
    every = left.join(right, ["a", "b"]).filter("a < b OR x < y").select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    return every.join(pair_dots(features, cell), ["i", "j"], "left").select("i", "j", unit_distance(F.coalesce("dot", F.lit(0.0))).alias("d"))


def centroids(features: DataFrame, labels: DataFrame, cell: str = "cell_id") -> DataFrame:
    """(cluster, species_id, value): mean over all cells of a cluster, absent species counting as 0."""
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    return features.join(labels, cell).groupBy("cluster", "species_id").agg(F.sum("value").alias("s")).join(sizes, "cluster").select("cluster", "species_id", (F.col("s") / F.col("n")).alias("value"))


def aligned(features: DataFrame, labels: DataFrame, cell: str = "cell_id", strict: bool = False) -> DataFrame:
    """Features with their cell's label; unlabelled cells are dropped, or refused if ``strict``."""
    if strict and not features.select(cell).distinct().join(labels, cell, "left_anti").isEmpty():
        raise ValueError("cells without a label")
    return features.join(labels, cell)


def centroid_distances(features: DataFrame, labels: DataFrame, cell: str = "cell_id") -> DataFrame:
    """(cluster, cell, d): each cell's distance to the centroid of its cluster, from the non-zero values alone."""
    c = centroids(features, labels, cell)
    norms = c.groupBy("cluster").agg(F.sum(F.col("value") * F.col("value")).alias("cc"))
    cross = features.join(labels, cell).join(c.withColumnRenamed("value", "m"), ["cluster", "species_id"]).groupBy("cluster", cell).agg(F.sum(F.col("value") * F.col("value") - 2 * F.col("value") * F.col("m")).alias("d"))
    return cross.join(norms, "cluster").select("cluster", cell, F.sqrt(F.greatest(F.lit(0.0), F.col("d") + F.col("cc"))).alias("d"))
