"""The nine stages as compositions of operators; each takes and gives DataFrames."""

from __future__ import annotations

import logging
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..observed import Tally
from ..operators import community, drawing, graph, sampling, spatial, stats
from ..scratch import materialise
from ..sources import reports, writers
from . import config

log = logging.getLogger(__name__)


def _placed(occ: DataFrame, c: config.Associates) -> DataFrame:
    """Occurrences inside the box with their locality and projected coordinates."""
    occ = occ.withColumns({"lon": expr.to_double(F.col("decimalLongitude")), "lat": expr.to_double(F.col("decimalLatitude"))})
    occ = spatial.in_box(occ, "lon", "lat", c.west, c.east, c.south, c.north)
    north, east = expr.project(F.col("lat"), F.col("lon"))
    return occ.withColumns({"n": north, "e": east, "locality": expr.locality_key(F.col("localityID"), F.col("locality"), F.col("lat"), F.col("lon"))})


def focal_sites(occ: DataFrame, plants: DataFrame, c: config.Associates) -> tuple[DataFrame, DataFrame]:
    """(focal rows, sampled sites): whitelisted focal taxa, and a banded sample of each taxon's sites."""
    tid = expr.taxon_number(F.col("taxonID"))
    focal = occ.withColumn("tid", tid).filter(F.col("tid").isin(*c.focal_ids) | F.col("scientificName").isin(*c.focal_names))
    focal = community.within(focal, "tid", plants).withColumn("sci", F.col("scientificName"))
    placed = _placed(focal, c)
    sizes = placed.groupBy(F.col("sci").alias("__sci")).agg(F.count("*").alias("__n"))
    banded = sampling.latitude_bands(placed, "sci", "lat", c.bands)
    banded = banded.join(sizes, F.col("sci").eqNullSafe(F.col("__sci"))).drop("__sci")
    key = ["e", "n", "locality", "tid", "eventDate"]
    quota = sampling.site_quota(F.col("__n"), c.most_sites, c.bands)
    sites = sampling.stratified_sample(banded, "sci", "latband", quota, c.seed, key, cap=c.most_sites)
    fid = F.row_number().over(Window.partitionBy("sci").orderBy("latband", *key)) - 1
    return focal.select("sci", "tid"), sites.withColumn("fid", fid).select("sci", "fid", F.col("locality").alias("key"), "latband", "e", "n")


def associates(occ: DataFrame, red: DataFrame, plants: DataFrame, c: config.Associates) -> dict[str, DataFrame]:
    """Stage 1: everything within the radius of sampled focal sites, and its reports."""
    focal, sites = focal_sites(occ, plants, c)
    others = occ.withColumn("tid", expr.taxon_number(F.col("taxonID"), strict=True)).filter("tid IS NOT NULL")
    others = community.within(others, "tid", plants)
    focal_ids, focal_names = focal.select("tid").distinct(), focal.select("sci").distinct()
    others = community.without(community.without(others, "tid", focal_ids), "scientificName", focal_names)
    points = _placed(others, c).select("tid", "locality", "e", "n")
    # the sites are at most c.most_sites a taxon, and the pairs are read by eight reports
    sites = materialise(sites, "sites")
    hits = materialise(spatial.distance_join(sites.select("sci", "fid", "e", "n"), points, c.radius, broadcast_rows=20_000), "hits")
    counts = writers.associate_counts(hits, c.least_pairs)
    return {
        "hits": hits, "counts": counts, "unique_finds": writers.unique_finds(counts), "red_finds": writers.red_finds(counts, red), "all_observations": writers.all_observations(hits, counts), "totals": writers.target_totals(focal, counts, red),
        "red_by_locality": writers.red_by_locality(hits, red), "site_lists": writers.site_lists(sites, hits), "red_lists": writers.red_lists(hits, red),
    }


def write_associates(tables: dict[str, DataFrame], path: str) -> None:
    """Stage 1's reports as tab-separated files, each with a folder for each focal taxon; folders are named alike in all reports."""
    names = writers.taxon_folders(tables["totals"])
    reports = {k: v for k, v in tables.items() if k != "hits"}
    order = {"site_lists": ["fid"], "red_lists": ["LocalityID"], "red_by_locality": ["locality"], "counts": ["tid"], "all_observations": ["tid"]}
    writers.write_taxa(reports, path, order=order, names=names)


def consolidate(lists: DataFrame, exclude: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """Stage 2: site lists of all taxa to presence, localities and the species index.

    ``removed`` (n_lists, n_ids, n_removed) tells what was read and how many ids the exclude list took out; the counts ride on
    the pass that takes the lists apart, whose rows are written once and read by the tables.
    """
    read, ids, kept = Tally(), Tally(), Tally()
    rows = kept.on(community.without(ids.on(community.explode_lists(read.on(lists), "locality_id", "species_ids")), "species_id", exclude))
    rows = materialise(rows, "consolidated")
    log.info("%d lists, %d ids, %d of them excluded", read.get(), ids.get(), ids.get() - kept.get())
    removed = lists.sparkSession.createDataFrame([(read.get(), ids.get(), ids.get() - kept.get())], "n_lists long, n_ids long, n_removed long")
    presence = rows.select("locality_id", "species_id").distinct()
    return {"presence": presence, "localities": community.locality_summary(rows), "species": community.named_species(community.vocabulary(presence), names), "removed": removed}


def features(presence: DataFrame, localities: DataFrame, c: config.Features = config.Features()) -> dict[str, DataFrame]:
    """Stage 3: Hellinger composition of grid cells, and the cells."""
    counts = community.cell_counts(presence, localities, c.cell_size)
    return {"features": community.hellinger(counts), "cells": community.cell_index(localities, c.cell_size)}


def cell_neighbours(cell_features: DataFrame, c: config.Features = config.Features()) -> DataFrame:
    """(src, dst, d): exact nearest cells by composition; cells that share no species are the square root of 2 apart."""
    ids = cell_features.select("cell_id").distinct()
    dots = materialise(community.pair_dots(cell_features), "dots")
    near = dots.select(F.col("i").alias("src"), F.col("j").alias("dst"), "dot").union(dots.select("j", "i", "dot"))
    found = near.select("src", "dst", F.round(community.unit_distance(F.col("dot")), 9).alias("d"))
    if c.include_self:
        found = found.union(ids.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"), F.lit(0.0).alias("d")))
    found = materialise(found, "near-cells")
    # cells with too few neighbours are filled up with the first cells that they share nothing with
    few = ids.withColumnRenamed("cell_id", "src").join(found.groupBy("src").agg(F.count("*").alias("k")), "src", "left").filter(F.coalesce("k", F.lit(0)) < c.neighbours).select("src")
    first = ids.orderBy("cell_id").limit(4 * c.neighbours).withColumnRenamed("cell_id", "dst")
    fill = few.crossJoin(F.broadcast(first)).filter("src <> dst").join(found.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("d", F.lit(2.0**0.5))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    return found.union(fill.select("src", "dst", "d")).withColumn("k", rank).filter(F.col("k") <= c.neighbours).drop("k")


def clusters(knn: DataFrame, vectors: DataFrame | None = None, c: config.Clusters = config.Clusters()) -> dict[str, DataFrame]:
    """Stage 4: similarity graph, sweep, the best run, small clusters merged, then down to the target by centroids."""
    # tables cut the lineage: the graph is read many times
    sim = materialise(graph.similarity(materialise(knn, "knn"), c.kernel, c.beta, c.two_hop, c.symmetry), "similarity")
    runs = materialise(graph.communities(sim, list(c.resolutions), c.seed), "runs")
    scored = []
    for run, gamma in enumerate(c.resolutions):
        own = runs.filter(F.col("run") == run).select("node", "label")
        sizes = own.groupBy("label").agg(F.count("*").alias("n")).agg(F.count("*").alias("k"), F.min("n").alias("min_size"))
        scored.append(sizes.crossJoin(graph.modularity(sim, own, gamma)).select(F.lit(run).alias("run"), F.col("k").cast("int").alias("k"), "quality", F.col("min_size").cast("int").alias("min_size")))
    table = scored[0]
    for s in scored[1:]:
        table = table.union(s)
    best = graph.pick_run(table, c.target).first()
    labels = graph.merge_small(sim, runs.filter(F.col("run") == best["run"]).select("node", "label"), c.least_size)
    if vectors is not None and labels.select("label").distinct().count() > c.target:
        labels = graph.greedy_merge(vectors, labels, c.target)
    return {"similarity": sim, "runs": table, "labels": labels, "report": reports.clustering_report(table, best.asDict(), labels, c)}


def region_map(cells: DataFrame, labels: DataFrame, size: float) -> DataFrame:
    """Stage 5: coloured squares."""
    return drawing.map_cells(cells.join(labels, "cell_id"), "cluster", size)


def markers(cell_features: DataFrame, labels: DataFrame, c: config.Markers = config.Markers()) -> DataFrame:
    """Stage 6: the strongest markers of each cluster."""
    return stats.scan_markers(cell_features, labels.filter("cluster >= 0"), c.q_most, c.top, c.min_delta, c.min_prevalence)


def evaluation(vectors: DataFrame, c: config.Evaluation = config.Evaluation()) -> dict[str, DataFrame]:
    """Stage 7: separation, silhouettes, dispersion about centroids and the permutation test of labelled vectors (id, cluster, v)."""
    vectors = vectors.filter("cluster >= 0")
    sums = materialise(stats.label_sums(vectors), "label-sums")
    s = stats.silhouettes(sums)
    return {"separation": stats.separation(sums), "silhouettes": s, "silhouette_summary": stats.silhouette_summary(s), "dispersion": stats.dispersion(stats.centre_distances(vectors)), "permanova": stats.permanova(vectors), "permanova_test": stats.permanova_test(vectors, c.permutations)}


def diversity(cell_features: DataFrame, labels: DataFrame, found: DataFrame | None = None, c: config.Evaluation = config.Evaluation()) -> dict[str, DataFrame]:
    """Stage 8: local contributions to beta diversity, indicator summaries and dissimilarity parts."""
    unlabelled = Tally()
    own = unlabelled.on(cell_features.join(labels, "cell_id", "left"), missing=F.count_if(F.col("cluster").isNull())).filter("cluster IS NOT NULL")
    own = materialise(own.select("cell_id", "species_id", "value"), "labelled-features")
    if unlabelled.get("missing"):
        warnings.warn(f"{unlabelled.get('missing')} of {unlabelled.get()} values are of cells without a label and left out", stacklevel=2)
    local = stats.lcbd(own).join(labels, "cell_id")
    out = {"lcbd": local, "lcbd_summary": stats.summary(local, "cluster", "lcbd", "lcbd"), "beta": stats.sorensen_summary(stats.sorensen_pairs(own, labels, most=c.most_pairs, seed=c.seed), labels)}
    if found is not None:
        out["indicators"] = stats.indicator_summary(found)
    return out


def network(sim: DataFrame, labels: DataFrame, most: int = 100_000, rounds: int = 500) -> dict[str, DataFrame]:
    """Stage 9: nodes and edges of the drawn graph; ``labels`` has node and label."""
    edges = graph.strongest_edges(sim, most)
    nodes = drawing.network_nodes(graph.layout(edges, rounds, nodes=labels.select("node")), labels)
    return {"nodes": nodes, "edges": drawing.network_edges(edges, nodes)}
