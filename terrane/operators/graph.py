"""Nearest neighbours, similarity graphs, communities and merges on edge tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import kernel
from ..scratch import materialise
from ..shipping import ship
from .forces import pushes as _pushes
from .leiden import communities
from .ranks import numbered, quantiles
from .vectors import neighbours

__all__ = ["cluster_links", "communities", "compact", "greedy_merge", "layout", "merge_small", "modularity", "neighbours", "pick_run", "relabel", "similarity", "strongest_edges", "symmetric", "two_hop"]


def symmetric(edges: DataFrame, how: str = "max") -> DataFrame:
    """Edges (src, dst, w) combined with their reverse: ``max`` and ``mean`` over both supports, ``min`` over the common one."""
    both = edges.select("src", "dst", "w", F.lit(0).alias("way")).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", F.lit(1).alias("way")))
    grouped = both.groupBy("src", "dst")
    if how == "max":
        return grouped.agg(F.max("w").alias("w"))
    if how == "mean":
        return grouped.agg((F.sum("w") / 2).alias("w"))
    if how == "min":
        return grouped.agg(F.min("w").alias("w"), F.count_distinct("way").alias("n")).filter("n = 2").drop("n")
    raise ValueError(f"unknown symmetry {how!r}")


def two_hop(edges: DataFrame, alpha: float = 0.02) -> DataFrame:
    """Adds ``alpha`` times the weight of two-step paths between different nodes, then takes the larger of both directions."""
    a, b = edges.toDF("src", "mid", "w1"), edges.toDF("mid", "dst", "w2")
    paths = a.join(b, "mid").filter("src <> dst").groupBy("src", "dst").agg((F.sum(F.col("w1") * F.col("w2")) * alpha).alias("w"))
    return symmetric(edges.select("src", "dst", "w").union(paths).groupBy("src", "dst").agg(F.sum("w").alias("w")), "max").filter("w <> 0")


def similarity(edges: DataFrame, mode: str = "adaptive", beta: float = 1.0, alpha: float = 0.02, how: str = "max") -> DataFrame:
    """Neighbour distances (src, dst, d) to similarities (src, dst, w).

    ``adaptive`` scales by the medians of both ends' distances; a median of 0 is replaced by the median of all. Tables that are
    read more than once are written first, so a neighbour search behind ``edges`` runs one time.
    """
    if mode == "adaptive":
        edges = edges if hasattr(edges, "_scratch_path") else materialise(edges, "neighbours")
        whole = quantiles(edges, [], "d", [0.5]).select(F.col("q")[0].alias("whole"))
        scale = edges.groupBy("src").agg(F.percentile("d", F.lit(0.5)).alias("s")).crossJoin(F.broadcast(whole)).select("src", F.when(F.col("s") > 0, F.col("s")).otherwise(F.col("whole")).alias("s"), "whole")
        named = edges.join(scale.toDF("src", "si", "whole"), "src").join(scale.select(F.col("src").alias("dst"), F.col("s").alias("sj")), "dst", "left")
        ends = F.coalesce("sj", "whole")
        w = kernel(F.col("d"), mode, F.col("si"), ends)
        out = named.select("src", "dst", w.alias("w"))
    else:
        out = edges.select("src", "dst", kernel(F.col("d"), mode, beta=beta).alias("w"))
    out = symmetric(out, how)
    return two_hop(materialise(out, "similarity"), alpha) if alpha else out


def modularity(edges: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(quality,) of labels (node, label) on symmetric edges: pairs weigh twice, loops once."""
    a, b = labels.toDF("src", "ls"), labels.toDF("dst", "ld")
    pairs = edges.select("src", "dst", "w").filter("src IS NOT NULL AND dst IS NOT NULL")
    inside = pairs.join(a, "src").join(b, "dst")
    strength = inside.groupBy("ls").agg(F.sum(2 * F.col("w")).alias("k"), F.sum(F.when(F.col("ls") == F.col("ld"), F.col("w"))).alias("win"))
    total = pairs.agg(F.sum("w").alias("m"))
    out = strength.crossJoin(F.broadcast(total))
    return out.agg(F.sum(F.coalesce("win", F.lit(0.0)) / F.col("m") - gamma * F.pow(F.col("k") / (2 * F.col("m")), 2)).alias("quality"))


def pick_run(runs: DataFrame, target: int) -> DataFrame:
    """The run (run, k, quality, min_size) nearest to ``target`` communities, then of best quality, then of largest least size."""
    return runs.select(F.min_by(F.struct("run", "k", "quality", "min_size"), F.struct(F.abs(F.col("k") - target), -F.col("quality"), -F.col("min_size"), "run")).alias("best")).select("best.*")


def cluster_links(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(la, lb, sum_w, n) of edges between clusters; both columns add up when clusters merge."""
    return edges.join(labels.toDF("src", "la"), "src").join(labels.toDF("dst", "lb"), "dst").groupBy("la", "lb").agg(F.sum("w").alias("sum_w"), F.count("*").alias("n"))


def merge_small(edges: DataFrame, labels: DataFrame, least: int = 25) -> DataFrame:
    """(node, label) after every cluster that began under ``least`` nodes joined the neighbour of largest mean weight.

    Clusters go in ascending order of label; one without neighbours joins the largest. The driver holds tables of clusters,
    not of nodes.
    """
    sizes = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    links: dict[int, dict[int, list[float]]] = {}
    for r in cluster_links(edges, labels).collect():
        links.setdefault(r["la"], {})[r["lb"]] = [r["sum_w"], r["n"]]
    into = {c: c for c in sizes}
    for c in sorted(k for k, n in sizes.items() if n < least):
        own = into[c]
        near = {b: s / n for b, (s, n) in links.get(own, {}).items() if b != own and b in sizes}
        others = [k for k in sizes if k != own]
        if not others:
            break
        best = max(near.values()) if near else None
        to = min(b for b, v in near.items() if v == best) if near else min(others, key=lambda k: (-sizes[k], k))
        sizes[to] += sizes.pop(own)
        moved = links.pop(own, {})
        for b, (s, n) in moved.items():
            b = to if b == own else b
            cell = links.setdefault(to, {}).setdefault(b, [0.0, 0])
            cell[0] += s
            cell[1] += n
        for row in links.values():
            if own in row:
                s, n = row.pop(own)
                cell = row.setdefault(to, [0.0, 0])
                cell[0] += s
                cell[1] += n
        into = {k: to if v == own else v for k, v in into.items()}
    return relabel(labels, into)


def greedy_merge(vectors: DataFrame, labels: DataFrame, target: int) -> DataFrame:
    """(node, label) after the two clusters of nearest centroids merged until ``target`` remain; the larger absorbs.

    ``vectors`` has id and v. The driver holds one sum for each cluster and dimension.
    """
    sums = vectors.join(labels.toDF("id", "label"), "id").select("label", F.posexplode("v").alias("d", "x")).groupBy("label", "d").agg(F.sum("x").alias("s"), F.count("*").alias("n")).collect()
    total, count = {}, {}
    for r in sums:
        total.setdefault(r["label"], {})[r["d"]] = r["s"]
        count[r["label"]] = r["n"]
    total = {c: np.array([v[d] for d in sorted(v)]) for c, v in total.items()}
    into = {c: c for c in total}
    while len(total) > target:
        names = sorted(total)
        centre = {c: total[c] / count[c] for c in names}
        a, b = min(((x, y) for x in names for y in names if x < y), key=lambda p: (round(float(np.linalg.norm(centre[p[0]] - centre[p[1]])), 12), p))
        keep, gone = (a, b) if count[a] >= count[b] else (b, a)
        total[keep] += total.pop(gone)
        count[keep] += count.pop(gone)
        into = {k: keep if v == gone else v for k, v in into.items()}
    return relabel(labels, into)


def relabel(labels: DataFrame, into: dict) -> DataFrame:
    """Labels replaced by their targets, then numbered from 0 in order."""
    rank = {c: i for i, c in enumerate(sorted(set(into.values())))}
    table = labels.sparkSession.createDataFrame([(int(k), int(rank[v])) for k, v in into.items()], "label long, __new long")
    return labels.join(table, "label").select("node", F.col("__new").alias("label"))


def compact(labels: DataFrame, label: str = "label") -> DataFrame:
    """Labels numbered from 0 in order."""
    ids = numbered(labels.select(label).filter(F.col(label).isNotNull()), [label], "__new").withColumn("__new", F.col("__new").cast("int"))
    return labels.join(ids, label).drop(label).withColumnRenamed("__new", label)


def strongest_edges(edges: DataFrame, most: int, least: float = 0.0) -> DataFrame:
    """Undirected edges src < dst of the ``most`` strongest entries (at least ``least``), by weight, then ends.

    Entries are what a symmetric table holds: both directions of a pair, and loops. A pair stays if either direction does.
    """
    entries = edges.filter(F.col("w") >= least) if least > 0 else edges
    return symmetric(entries.orderBy(F.desc("w"), "src", "dst").limit(most), "max").filter("src < dst")


def layout(edges: DataFrame, rounds: int = 500, seed: int = 123, nodes: DataFrame | None = None) -> DataFrame:
    """(node, x, y) of a weighted force layout, scaled to the unit square. For graphs that are drawn, so one task holds them.

    ``nodes`` (column node) adds those without an edge: nothing pulls them, but all others push them. All nodes push each other in
    a round, far ones by the series of ``forces``, so a round's time and memory grow nearly as nodes and edges.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        joined = pdf["w"].notna().to_numpy()
        src, dst = pdf["src"].to_numpy(), pdf["dst"].to_numpy()
        nodes, at = np.unique(np.concatenate((src, dst)), return_inverse=True)
        n, half = len(nodes), len(pdf)
        i, j, w = at[:half][joined], at[half:][joined], pdf["w"].to_numpy()[joined]
        pos = np.random.default_rng(seed).random((n, 2))
        k, heat = np.sqrt(1 / max(n, 1)), 0.1
        for step in range(rounds):
            move = _pushes(pos, k)
            gap = pos[i] - pos[j]
            pull = gap * (np.sqrt((gap**2).sum(1)) / k * w)[:, None]
            for c in (0, 1):
                move[:, c] += np.bincount(j, pull[:, c], n) - np.bincount(i, pull[:, c], n)
            length = np.maximum(np.sqrt((move**2).sum(1)), 1e-12)
            pos += move / length[:, None] * np.minimum(length, heat * (1 - step / rounds))[:, None]
        span = np.maximum(np.ptp(pos, axis=0), 1e-12)
        pos = (pos - pos.min(0)) / span
        return pd.DataFrame({"node": nodes, "x": pos[:, 0], "y": pos[:, 1]})

    ship(edges.sparkSession)
    edges = edges.select("src", "dst", F.col("w").cast("double").alias("w"))
    if nodes is not None:
        edges = edges.unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(None).cast("double").alias("w")))
    return edges.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(solve, f"node {dict(edges.dtypes)['src']}, x double, y double")
