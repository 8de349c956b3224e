"""Reports of clusterings, of their evaluation and of communities, as text made from small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stats import separation_matrix
from .writers import text_table, write_text


def clustering_report(runs: DataFrame, best: dict, labels: DataFrame, c) -> str:
    """Settings, the sweep (run, k, quality, min_size), the chosen run and the number of clusters in the end."""
    final = labels.select("label").distinct().count()
    lines = [f"Target clusters: {c.target}", f"Least cluster size: {c.least_size}", f"Similarity: {c.kernel}", f"Chosen: resolution {c.resolutions[best['run']]}, {best['k']} communities", f"Clusters in the end: {final}"]
    resolution = F.element_at(F.array(*map(F.lit, c.resolutions)), F.col("run") + 1).alias("resolution")
    return "\n".join(lines) + "\n\n" + text_table(runs.select(resolution, "k", "quality", "min_size"), "Sweep")


def evaluation_report(found: dict[str, DataFrame], digits: int = 5) -> str:
    """Dispersion, separation as a matrix and in detail, silhouettes and the permutation test, from ``stages.evaluation``."""
    whole = found["silhouettes"].agg(F.count("*").alias("n"), F.avg("s").alias("mean"))
    parts = [
        text_table(found["dispersion"], "Distances to the centroid within clusters", digits=digits),
        text_table(separation_matrix(found["separation"]), "Mean distances between clusters", digits=digits),
        text_table(found["separation"], "Distances between clusters", digits=digits),
        text_table(whole, "Silhouette, overall", digits=digits), text_table(found["silhouette_summary"], "Silhouette by cluster", digits=digits),
        text_table(found["permanova"], "Variance explained by clusters", digits=digits), text_table(found["permanova_test"], "Permutation test", digits=digits),
    ]
    return "\n".join(parts)


def community_report(features: DataFrame, labels: DataFrame, found: dict[str, DataFrame], digits: int = 5) -> str:
    """Numbers of cells, species and clusters, and the summaries of ``stages.diversity``."""
    n = features.agg(F.count_distinct("cell_id").alias("cells"), F.count_distinct("species_id").alias("species")).first()
    clusters = [r["cluster"] for r in labels.select("cluster").distinct().orderBy("cluster").collect()]
    parts = [f"Cells: {n['cells']}\nSpecies: {n['species']}\nClusters: {', '.join(map(str, clusters))}\n", text_table(found["lcbd_summary"], "Local contributions to beta diversity", digits=digits)]
    if "indicators" in found:
        parts.append(text_table(found["indicators"], "Indicator species", digits=digits))
    parts.append(text_table(found["beta"], "Dissimilarity within clusters and its parts", digits=digits))
    return "\n".join(parts)


def write_report(text: str, path: str) -> None:
    """The same text on the driver's output and in a file of any file system."""
    print(text)
    write_text([text], path)
