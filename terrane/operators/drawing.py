"""Tables that are ready to draw: maps, volcanoes, strips, boxes, radars and networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import cell_rectangle, volcano
from .ranks import numbered, quantiles


def colours(df: DataFrame, label: str, n: int = 20) -> DataFrame:
    """Adds ``colour_idx``: the label's rank among all labels, modulo ``n``. Ranks come from the table of labels."""
    ranks = numbered(df.select(label), [label], "colour_idx").withColumn("colour_idx", (F.col("colour_idx") % n).cast("int"))
    return df.join(ranks, label)


def map_cells(cells: DataFrame, label: str, size: float) -> DataFrame:
    """(cell_id, label, x0, y0, width, height, colour_idx) of labelled squares."""
    for c in ("gx", "gy", label):
        if c not in cells.columns:
            raise ValueError(f"missing column {c!r}")
    return colours(cells.select("cell_id", label, *cell_rectangle(F.col("gx"), F.col("gy"), size)), label)


def map_extent(cells: DataFrame, size: float) -> DataFrame:
    """(x_low, x_high, y_low, y_high, x_ticks, y_ticks) with ticks every 100 km."""
    e = cells.agg((F.min("gx") * size).alias("x_low"), ((F.max("gx") + 1) * size).alias("x_high"), (F.min("gy") * size).alias("y_low"), ((F.max("gy") + 1) * size).alias("y_high"))
    tick = lambda a, b: F.transform(F.sequence(F.ceil(F.col(a) / 100_000), F.floor(F.col(b) / 100_000)), lambda i: i * 100_000)
    return e.withColumns({"x_ticks": tick("x_low", "x_high"), "y_ticks": tick("y_low", "y_high")})


def volcano_points(tested: DataFrame, q_most: float = 0.05) -> DataFrame:
    return tested.select("cluster", "species_id", "delta", volcano(F.col("q")).alias("neglog10q"), (F.col("q") <= q_most).alias("significant"))


def strips(features: DataFrame, labels: DataFrame, markers: DataFrame, most: int = 12, seed: int = 7, cell: str = "cell_id") -> DataFrame:
    """(cluster, species_id, cell, inside, value, jitter): every cell's value of the first ``most`` markers, zeros included."""
    chosen = markers.filter(F.col("rank") <= most).select("cluster", "species_id")
    cells = labels.select(F.col(cell), F.col("cluster").alias("own"))
    grid = cells.crossJoin(F.broadcast(chosen))
    out = grid.join(features.select(cell, "species_id", "value"), [cell, "species_id"], "left")
    jitter = F.pmod(F.xxhash64(F.lit(seed), F.col(cell), F.col("species_id")), F.lit(1000)) / 1000.0 - 0.5
    return out.select("cluster", "species_id", cell, (F.col("own") == F.col("cluster")).alias("inside"), F.coalesce("value", F.lit(0.0)).alias("value"), jitter.alias("jitter"))


def boxes(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles, and the farthest values within one and a half interquartile ranges."""
    q = df.groupBy(by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select(by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q, by).filter((F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach))
    return inside.groupBy(by, "q1", "median", "q3").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def radar(metrics: DataFrame, by: str) -> DataFrame:
    """(by, metric, scaled): every metric scaled to [0, 1] over the groups; a constant one is 0.5. For tables of groups."""
    names = [c for c in metrics.columns if c != by]
    long = metrics.select(by, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("x")) for n in names])).alias("m")).select(by, "m.*")
    w = Window.partitionBy("metric")
    low, high = F.min("x").over(w), F.max("x").over(w)
    return long.select(by, "metric", F.when(high > low, (F.col("x") - low) / (high - low)).otherwise(0.5).alias("scaled"))


def network_nodes(positions: DataFrame, labels: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """(node, label, x, y, colour_idx): positions clamped to quantiles and scaled to [0, 1]."""
    p = positions
    for c in "xy":
        p = p.crossJoin(F.broadcast(quantiles(positions, [], c, [low, high], f"q{c}")))
    scaled = {c: F.when(F.col(f"q{c}")[1] > F.col(f"q{c}")[0], (F.least(F.greatest(F.col(c), F.col(f"q{c}")[0]), F.col(f"q{c}")[1]) - F.col(f"q{c}")[0]) / (F.col(f"q{c}")[1] - F.col(f"q{c}")[0])).otherwise(0.5) for c in "xy"}
    out = p.select("node", scaled["x"].alias("x"), scaled["y"].alias("y")).join(labels, "node")
    return colours(out, "label")


def clamped(df: DataFrame, value: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Adds ``clamped``: values cut to the quantiles of all values."""
    cut = quantiles(df, [], value, [low, high], "__q")
    return df.crossJoin(F.broadcast(cut)).withColumn("clamped", F.greatest(F.col("__q")[0], F.least(F.col("__q")[1], F.col(value)))).drop("__q")


def network_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, w, x0, y0, x1, y1) of the edges whose ends are drawn."""
    a, b = nodes.select(F.col("node").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0")), nodes.select(F.col("node").alias("dst"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "w", "x0", "y0", "x1", "y1")
