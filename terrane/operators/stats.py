"""Marker tests, separation, silhouettes, permutation tests and beta diversity on sparse tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import exact_rank_tail, normal_interval, normal_tail, sorensen
from ..scratch import materialise
from ..shipping import ship
from .community import shared_sums
from .vectors import label_sums


def marker_summaries(features: DataFrame, labels: DataFrame, cell: str = "cell_id") -> DataFrame:
    """(cluster, species_id, mean_in, mean_out, delta, prevalence_in, prevalence_out, prevalence, n_in, n_out, ...).

    For the species that a cluster holds; cells without a species count as zeros. Sums of squares come along.
    """
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n_in"))
    total = labels.agg(F.count("*").alias("n_all"))
    joined = features.filter("value <> 0").join(labels, cell)
    inside = joined.groupBy("cluster", "species_id").agg(F.sum("value").alias("s_in"), F.sum(F.col("value") * F.col("value")).alias("q_in"), F.count("*").alias("k_in"))
    every = joined.groupBy("species_id").agg(F.sum("value").alias("s_all"), F.sum(F.col("value") * F.col("value")).alias("q_all"), F.count("*").alias("k_all"))
    out = inside.join(every, "species_id").join(sizes, "cluster").crossJoin(F.broadcast(total)).withColumn("n_out", F.col("n_all") - F.col("n_in"))
    rest = F.greatest(F.col("n_out"), F.lit(1))
    out = out.withColumns({
        "mean_in": F.col("s_in") / F.col("n_in"),
        "mean_out": (F.col("s_all") - F.col("s_in")) / rest,
        "prevalence_in": F.col("k_in") / F.col("n_in"),
        "prevalence_out": (F.col("k_all") - F.col("k_in")) / rest,
        "prevalence": F.col("k_all") / F.col("n_all"),
    })
    return out.withColumn("delta", F.col("mean_in") - F.col("mean_out"))


def cohen_d(summaries: DataFrame) -> DataFrame:
    """Adds ``cohen_d`` with the pooled deviation; NULL for groups under 2 or without spread."""
    var = lambda q, s, n: (F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1)
    out = summaries.withColumns({"__so": F.col("s_all") - F.col("s_in"), "__qo": F.col("q_all") - F.col("q_in")})
    enough = (F.col("n_in") > 1) & (F.col("n_out") > 1)
    pooled = F.when(enough, ((F.col("n_in") - 1) * var("q_in", "s_in", "n_in") + (F.col("n_out") - 1) * var("__qo", "__so", "n_out")) / (F.col("n_in") + F.col("n_out") - 2))
    return out.withColumn("cohen_d", F.when(enough & (pooled > 1e-15), F.col("delta") / F.sqrt(pooled))).drop("__so", "__qo")


def mann_whitney(features: DataFrame, labels: DataFrame, cell: str = "cell_id", digits: int = 9, method: str = "asymptotic") -> DataFrame:
    """(cluster, species_id, n_in, n_out, u, z) of every species against every cluster that holds it.

    Zeros tie at the bottom and are counted, not stored. Ties correct the variance, and z has the continuity correction. Values
    are rounded to ``digits`` so that ties do not hang on the last bits. ``method`` "auto" adds the two-sided ``p``: exact where
    either side has at most 8 cells and no values tie, else from z.
    """
    if method not in ("asymptotic", "auto"):
        raise ValueError(f"unknown method {method!r}")
    n = labels.agg(F.count("*").alias("n_all"))
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n_in"))
    x = features.filter("value <> 0").join(labels, cell).withColumn("value", F.round("value", digits))
    ties = x.groupBy("species_id", "value").agg(F.count("*").alias("t"))
    by = Window.partitionBy("species_id")
    ties = ties.withColumns({"upto": F.sum("t").over(by.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), "k": F.sum("t").over(by), "cubes": F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).over(by)})
    ties = ties.withColumn("mid", F.col("upto") - (F.col("t") - 1) / 2.0)
    r = x.join(ties.select("species_id", "value", "mid", "k", "cubes"), ["species_id", "value"]).groupBy("cluster", "species_id").agg(F.sum("mid").alias("mids"), F.count("*").alias("k_in"), F.first("k").alias("k"), F.first("cubes").alias("cubes"))
    r = r.join(sizes, "cluster").crossJoin(F.broadcast(n)).withColumn("zeros", F.col("n_all") - F.col("k"))
    n1, n2, m, z0 = (F.col(c).cast("double") for c in ("n_in", "n_all", "n_all", "zeros"))
    n2 = n2 - n1
    ranks = (n1 - F.col("k_in")) * (z0 + 1) / 2 + F.col("mids") + z0 * F.col("k_in")
    r = r.withColumn("u", ranks - n1 * (n1 + 1) / 2)
    t = z0 * z0 * z0 - z0 + F.col("cubes")
    var = n1 * n2 / 12 * ((m + 1) - t / (m * (m - 1)))
    gap = F.col("u") - n1 * n2 / 2
    r = r.withColumn("z", F.when(var > 0, F.signum(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0)) / F.sqrt(var)))
    r = r.withColumn("n_out", F.col("n_all") - F.col("n_in")).withColumn("exact", (F.least("n_in", "n_out") <= 8) & (t == 0))
    out = r.select("cluster", "species_id", F.col("n_in").cast("long").alias("n_in"), F.col("n_out").cast("long").alias("n_out"), "u", "z", "exact")
    if method == "auto":
        out = out.withColumn("p", F.coalesce(exact_rank_tail("n_in", "n_out", F.when(F.col("exact"), F.col("u"))), normal_tail(F.round("z", digits))))
    return out.drop("exact")


def benjamini_hochberg(df: DataFrame, by: str, p: str = "p", total: str | None = None) -> DataFrame:
    """Adds ``q``: the least p * n / rank at or above each rank, within each group; ``total`` names a column with n."""
    rank = F.count("*").over(Window.partitionBy(by).orderBy(p).rangeBetween(Window.unboundedPreceding, 0))
    n = F.col(total) if total else F.count("*").over(Window.partitionBy(by))
    df = df.withColumn("__q", F.col(p) * n / rank)
    q = F.min("__q").over(Window.partitionBy(by).orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, 0))
    return df.withColumn("q", F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))).drop("__q")


def scan_markers(features: DataFrame, labels: DataFrame, q_most: float = 0.05, top: int = 40, min_delta: float = 1e-5, min_prevalence: float = 0.05, cell: str = "cell_id") -> DataFrame:
    """The ``top`` markers of each cluster: more abundant inside, by q, then delta.

    The false discovery rate counts all species of the table; those that are too rare or not more abundant enter as p = 1.
    """
    s = cohen_d(marker_summaries(features, labels, cell))
    tested = s.filter((F.col("prevalence") >= min_prevalence) & (F.col("delta") > 1e-5))
    tested = tested.join(mann_whitney(features, labels, cell, method="auto").select("cluster", "species_id", F.col("p").alias("p2")), ["cluster", "species_id"])
    tested = tested.withColumn("p", F.coalesce(F.col("p2") / 2, F.lit(1.0)))
    species = features.select("species_id").distinct().agg(F.count("*").alias("n_species"))
    tested = benjamini_hochberg(tested.crossJoin(F.broadcast(species)), "cluster", "p", "n_species").filter((F.col("delta") > min_delta) & (F.col("q") <= q_most))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.round("q", 12), F.round("delta", 9).desc(), "species_id"))
    return tested.withColumn("rank", rank).filter(F.col("rank") <= top).select("cluster", "species_id", "rank", "mean_in", "mean_out", "delta", "cohen_d", "p", "q", "prevalence_in", "prevalence_out", "n_in", "n_out")


def lcbd(features: DataFrame, cell: str = "cell_id") -> DataFrame:
    """(cell, lcbd): each cell's share of the total sum of squares about the species' means over all cells."""
    n = features.select(cell).distinct().agg(F.count("*").alias("n"))
    means = features.groupBy("species_id").agg(F.sum("value").alias("s")).crossJoin(F.broadcast(n)).select("species_id", (F.col("s") / F.col("n")).alias("m"))
    total = means.agg(F.sum(F.col("m") * F.col("m")).alias("mm"))
    ss = features.join(means, "species_id").groupBy(cell).agg(F.sum(F.col("value") * F.col("value") - 2 * F.col("value") * F.col("m")).alias("d")).crossJoin(F.broadcast(total)).select(cell, (F.col("d") + F.col("mm")).alias("ss"))
    whole = ss.agg(F.sum("ss").alias("whole"))
    return ss.crossJoin(F.broadcast(whole)).select(cell, (F.col("ss") / F.col("whole")).alias("lcbd"))


def summary(df: DataFrame, by: str, value: str, prefix: str) -> DataFrame:
    """Mean, median, sample deviation, least and largest value of each group."""
    return df.groupBy(by).agg(F.avg(value).alias(f"{prefix}_mean"), F.percentile(value, F.lit(0.5)).alias(f"{prefix}_median"), F.stddev_samp(value).alias(f"{prefix}_sd"), F.min(value).alias(f"{prefix}_min"), F.max(value).alias(f"{prefix}_max"))


def effect_column(df: DataFrame) -> str:
    """The first of the known effect columns."""
    for c in ("indval", "IndVal", "delta", "cohen_d"):
        if c in df.columns:
            return c
    raise ValueError("no effect column")


def indicator_summary(markers: DataFrame, effect: str | None = None) -> DataFrame:
    """Candidates and positive indicators of each cluster, with sum, mean and median of the positive effects."""
    e = F.col(effect or effect_column(markers))
    pos = F.when(e > 0, e)
    out = markers.groupBy("cluster").agg(F.count("*").alias("n_candidate_species"), F.count(pos).alias("n_indicator_species"), F.sum(pos).alias("sum_effect"), F.avg(pos).alias("mean_effect"), F.percentile(pos, F.lit(0.5)).alias("median_effect"))
    return out.withColumn("prop_indicator_species", F.col("n_indicator_species") / F.col("n_candidate_species"))


def sorensen_pairs(presence: DataFrame, labels: DataFrame, cell: str = "cell_id", most: int | None = None, seed: int = 12345) -> DataFrame:
    """(cluster, i, j, beta_sor, beta_turnover, beta_nestedness) of cells of one cluster; at most ``most`` drawn pairs of each."""
    own = presence.select(cell, "species_id").distinct().join(labels, cell)
    sizes = own.groupBy("cluster", cell).agg(F.count("*").alias("k"))
    if most is None:
        a, b = sizes.toDF("cluster", "i", "ki"), sizes.toDF("cluster", "j", "kj")
        pairs = a.join(b, "cluster").filter("i < j")
        shared = shared_sums(own.select(F.col("cluster").alias("g"), F.col(cell).alias("c"), F.col("species_id").alias("s"), F.lit(1.0).alias("v"))).select(F.col("g").alias("cluster"), "i", "j", F.col("dot").cast("long").alias("a"))
    else:
        numbered = materialise(sizes.withColumn("at", F.row_number().over(Window.partitionBy("cluster").orderBy(cell)).cast("long") - 1), "sorensen-cells")
        drawn = draw_pairs(numbered.groupBy("cluster").agg(F.count("*").alias("m")), most, seed)
        a, b = numbered.toDF("cluster", "i", "ki", "low"), numbered.toDF("cluster", "j", "kj", "high")
        pairs = materialise(drawn.join(a, ["cluster", "low"]).join(b, ["cluster", "high"]).select("cluster", "i", "j", "ki", "kj"), "sorensen-pairs")
        # only the species of drawn pairs meet
        x, y = own.select(F.col(cell).alias("i"), "species_id"), own.select(F.col(cell).alias("j"), "species_id")
        shared = pairs.select("cluster", "i", "j").join(x, "i").join(y, ["j", "species_id"]).groupBy("cluster", "i", "j").agg(F.count("*").alias("a"))
    pairs = pairs.join(shared, ["cluster", "i", "j"], "left").withColumn("a", F.coalesce("a", F.lit(0)))
    return pairs.select("cluster", "i", "j", *sorensen(F.col("a"), F.col("ki") - F.col("a"), F.col("kj") - F.col("a")))


def draw_pairs(groups: DataFrame, most: int, seed: int) -> DataFrame:
    """(cluster, low, high): ``most`` different pairs low < high of the numbers 0 to m - 1 of each group (cluster, m), or all where there are fewer.

    Pairs are numbered; where they are many, twice as many numbers as needed are drawn by a hash and the first different ones stay,
    so no table of all pairs is made.
    """
    every = F.col("m") * (F.col("m") - 1) / 2
    g = groups.withColumn("pairs", every.cast("long")).filter("pairs > 0")
    few = g.filter(F.col("pairs") <= 4 * most).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pairs") - 1))).withColumn("number", F.col("k"))
    few = few.withColumn("k", F.xxhash64(F.lit(seed), "cluster", "k"))
    many = g.filter(F.col("pairs") > 4 * most).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * most).cast("long"))))
    many = many.withColumn("number", F.pmod(F.xxhash64(F.lit(seed), "cluster", "k"), F.col("pairs"))).groupBy("cluster", "m", "pairs", "number").agg(F.min("k").alias("k"))
    both = few.select("cluster", "number", "k").union(many.select("cluster", "number", "k"))
    first = both.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("k", "number"))).filter(F.col("rank") <= most)
    # the pair's larger end is the largest h with h (h - 1) / 2 <= number; the root is corrected by one where it is rounded
    h = F.floor((1 + F.sqrt(1 + 8 * F.col("number").cast("double"))) / 2)
    h = F.when(h * (h - 1) / 2 > F.col("number"), h - 1).when((h + 1) * h / 2 <= F.col("number"), h + 1).otherwise(h)
    return first.withColumn("high", h.cast("long")).select("cluster", (F.col("number") - (F.col("high") * (F.col("high") - 1) / 2).cast("long")).alias("low"), "high")


def sorensen_summary(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n_cells"))
    stats = [f(c).alias(f"{c}_{name}") for c in ("beta_sor", "beta_turnover", "beta_nestedness") for name, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    return pairs.groupBy("cluster").agg(F.count("*").alias("n_pairs_used"), *stats).join(sizes, "cluster")


def dispersion(distances: DataFrame) -> DataFrame:
    """n, mean, sd and interval of distances (cluster, d) to the centroid."""
    out = distances.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return out.select("*", *normal_interval(F.col("mean"), F.col("sd"), F.col("n")))


def centre_distances(vectors: DataFrame) -> DataFrame:
    """(cluster, id, d): each vector's distance to its cluster's mean; vectors are (id, cluster, v)."""
    long = vectors.select("id", "cluster", F.posexplode("v").alias("d", "x"))
    mean = long.groupBy("cluster", "d").agg(F.avg("x").alias("m"))
    gap = F.col("x") - F.col("m")
    return long.join(mean, ["cluster", "d"]).groupBy("cluster", "id").agg(F.sqrt(F.sum(gap * gap)).alias("d"))


def separation(sums: DataFrame) -> DataFrame:
    """n, mean, sd and interval of distances between clusters ci < cj, from ``label_sums``."""
    out = sums.filter("cluster < other").groupBy(F.col("cluster").alias("ci"), F.col("other").alias("cj")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    out = out.withColumn("mean", F.col("s") / F.col("n")).withColumn("sd", F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("n") - 1)))))
    return out.select("ci", "cj", "n", "mean", "sd", *normal_interval(F.col("mean"), F.col("sd"), F.col("n")))


def separation_matrix(separated: DataFrame) -> DataFrame:
    """(cluster, C0, C1, ...): mean distances of all pairs of clusters both ways; a cluster to itself is NULL."""
    # the names are read first: what stands behind the few rows runs one time
    separated = materialise(separated, "separation")
    both = separated.select("ci", "cj", "mean").union(separated.select("cj", "ci", "mean"))
    names = sorted(r["ci"] for r in both.select("ci").distinct().collect())
    return both.groupBy(F.col("ci").alias("cluster")).pivot("cj", names).agg(F.first("mean")).toDF("cluster", *[f"C{n}" for n in names])


def cluster_table(local: DataFrame, beta: DataFrame, indicators: DataFrame | None = None) -> DataFrame:
    """One row for each cluster of ``local``, with the columns of the other summaries where they have that cluster."""
    out = local.join(beta, "cluster", "left")
    return out if indicators is None else out.join(indicators, "cluster", "left")


def silhouettes(sums: DataFrame) -> DataFrame:
    """(id, cluster, s) from ``label_sums``; a cluster of one row has 0."""
    own = sums.filter("cluster = other AND n > 0").select("id", (F.col("s") / F.col("n")).alias("a"))
    other = sums.filter("cluster <> other AND n > 0").groupBy("id", "cluster").agg(F.min(F.col("s") / F.col("n")).alias("b"))
    out = other.join(own, "id", "left")
    top = F.greatest("a", "b")
    return out.select("id", "cluster", F.when(F.col("a").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top).alias("s"))


def silhouette_summary(s: DataFrame) -> DataFrame:
    return s.groupBy("cluster").agg(F.avg("s").alias("mean"), F.percentile("s", F.lit(0.5)).alias("median"), F.min("s").alias("min"), F.max("s").alias("max"), F.count("*").alias("n"), F.avg(F.when(F.col("s") < 0, 1.0).otherwise(0.0)).alias("prop_negative"))


def permanova(vectors: DataFrame) -> DataFrame:
    """(n, k, sst, ssw, f, r2) of vectors (id, cluster, v), from sums about centroids in one pass."""
    long = vectors.select("id", "cluster", F.posexplode("v").alias("d", "x"))
    group = long.groupBy("cluster", "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("m"))
    within_ = group.agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("m")).alias("ssw"), F.count_distinct("cluster").alias("k"))
    total = group.groupBy("d").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("m").alias("m")).agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("m")).alias("sst"), F.max("m").alias("n"))
    out = total.crossJoin(within_).withColumn("f", ((F.col("sst") - F.col("ssw")) / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k"))))
    return out.select(F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), "sst", "ssw", "f", ((F.col("sst") - F.col("ssw")) / F.col("sst")).alias("r2"))


def _block_counts(rng_of, counts: np.ndarray, sizes: np.ndarray, block: int) -> np.ndarray:
    """How many of each label a random permutation puts into ``block``: blocks are halved down to it, and each half draws its
    labels without replacement. ``rng_of(low, high)`` gives the generator of a run of blocks, so all blocks draw alike."""
    low, high = 0, len(sizes)
    while high - low > 1:
        mid = (low + high) // 2
        left = rng_of(low, high).multivariate_hypergeometric(counts, int(sizes[low:mid].sum()), method="marginals")
        counts, low, high = (left, low, mid) if block < mid else (counts - left, mid, high)
    return counts


def permanova_test(vectors: DataFrame, permutations: int = 999, seed: int = 123, block: int = 8192) -> DataFrame:
    """(permutations, f, p): the share of label permutations, with the observed one, whose pseudo-F is at least as large.

    Rows are dealt to blocks of about ``block`` by their ids. A permutation gives each block its numbers of each label (a
    hypergeometric draw that all blocks share by its key) and shuffles within blocks, so all permutations are equally likely
    and no task sees all rows. Only sums by group leave a block; they are added up for each permutation, and the total sum of
    squares does not change. The driver holds one number for each block and label. numpy draws from fewer than 1e9 rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    count = vectors.count()
    blocks = max(1, -(-count // block))
    rows = vectors.select("id", "cluster", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    sizes = np.zeros(blocks, np.int64)
    for r in rows.groupBy("block").count().collect():
        sizes[r["block"]] = r["count"]
    labels = {r["cluster"]: r["count"] for r in rows.groupBy("cluster").count().collect()}
    names, m = sorted(labels), np.array([labels[c] for c in sorted(labels)], np.int64)
    centre = vectors.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("x")).orderBy("d").collect()
    centre, k = np.array([r["x"] for r in centre]), len(m)
    # vectors are copied to chunks of permutations: for work in parallel, and so that few sums leave a block at once
    chunks = min(permutations + 1, max(-(-2 * spark.sparkContext.defaultParallelism // blocks), -(-(permutations + 1) * k * max(1, len(centre)) // 8_000_000)))

    def sums(key, pdf: pd.DataFrame) -> pd.DataFrame:
        b, chunk = key
        pdf = pdf.sort_values("id", kind="stable")
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64) - centre
        squares, out = float((x * x).sum()), []
        for i in range(chunk, permutations + 1, chunks):
            total = np.zeros((k, x.shape[1]))
            if i == 0:  # as observed
                np.add.at(total, np.searchsorted(names, pdf["cluster"].to_numpy()), x)
            else:
                held = _block_counts(lambda low, high: np.random.default_rng((seed, i, low, high)), m, sizes, b)  # noqa: B023
                start, some = np.concatenate(([0], np.cumsum(held)[:-1])), held > 0
                total[some] = np.add.reduceat(x[np.random.default_rng((seed, i, b)).permutation(len(x))], start[some])
            out.append((i, b, squares, total.ravel()))
        return pd.DataFrame(out, columns=["i", "block", "squares", "total"])

    def pseudo_f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        total = np.sum(np.stack(pdf["total"].to_numpy()), axis=0).reshape(k, -1)
        squares, whole = pdf["squares"].sum(), total.sum(0)
        sst, ssw = squares - (whole**2).sum() / m.sum(), squares - ((total**2).sum(1) / m).sum()
        ssw = ssw if ssw > 1e-12 * squares else 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            return pd.DataFrame({"i": [pdf["i"].iloc[0]], "f": [np.float64((sst - ssw) / np.float64(k - 1)) / (np.float64(ssw) / (m.sum() - k))]})

    dealt = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    parts = dealt.groupBy("block", "chunk").applyInPandas(sums, "i int, block int, squares double, total array<double>")
    # the table cuts the lineage: the observed value and the others are read apart
    runs = materialise(parts.groupBy("i").applyInPandas(pseudo_f, "i int, f double"), "permutations")
    observed = runs.filter("i = 0").select(F.col("f").alias("__f"))
    tested = runs.filter("i > 0").crossJoin(F.broadcast(observed))
    return tested.agg(F.count("*").alias("permutations"), ((F.sum((F.col("f") >= F.col("__f") * (1 - 1e-12)).cast("int")) + 1) / (F.count("*") + 1)).alias("p"), F.first("__f").alias("f"))
