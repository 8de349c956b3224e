"""Distance joins and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import cell_name, grid_index
from ..observed import Tally
from ..scratch import materialise

#: Points of a square from which on it is cut, and most cut squares or crowded places that are sent to all tasks.
HOT = 100_000

#: Sites of one place that travel as one row of the join.
LIST = 1_000

#: Pairs of a point and a site of its own or a neighbouring square that are dealt to a task, and most tasks of a join.
SHARE = 20_000_000
TASKS = 10_000


def _square(c: str, radius: float) -> Column:
    return F.floor(F.col(c) / F.lit(float(radius))).cast("bigint")


def _near(sites: DataFrame, radius: float) -> DataFrame:
    """A copy of each row for its own square and for each of the eight around it."""
    s = sites.withColumn("__dx", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("__dy", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    return s.withColumns({"__cx": _square("__sx", radius) + F.col("__dx"), "__cy": _square("__sy", radius) + F.col("__dy")}).drop("__dx", "__dy")


def _spread(df: DataFrame) -> Column:
    """A number by which rows are dealt to parts; equal rows of different input partitions go to different parts."""
    return F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])


def _listed(sites: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(__sx, __sy, __list, __sites), sites in numbered lists of one place and about ``size``; and (__sx, __sy, n), how many each place has."""
    place, rest, seen = ["__sx", "__sy"], F.struct(*[F.col(f"`{c}`") for c in sites.columns if c not in ("__sx", "__sy")]), Tally()
    places = materialise(seen.on(sites.groupBy(*place).agg(F.count("*").alias("n")), crowded=F.count_if(F.col("n") > size)), "places")
    spread, part = _spread(sites), F.lit(0)
    if crowded := seen.get("crowded"):
        lists = places.filter(F.col("n") > size).select(*place, F.ceil(F.col("n") / size).alias("__lists"))
        sites, part = sites.join(F.broadcast(lists) if crowded <= HOT else lists, place, "left"), F.pmod(spread, F.coalesce("__lists", F.lit(1)))
    return sites.withColumn("__list", part).groupBy(*place, "__list").agg(F.collect_list(rest).alias("__sites")), places


def distance_join(sites: DataFrame, points: DataFrame, radius: float, site_keys: list[str] = (), x: str = "e", y: str = "n", broadcast_rows: int | None = None, hot: int | None = HOT, size: int = LIST, share: int = SHARE) -> DataFrame:
    """All pairs of a site and a point within ``radius`` (closed ball), with the squared distance ``d2``.

    Both sides have columns ``x`` and ``y``; other names must not clash. Sites, the smaller side, are copied to their own and
    the eight neighbouring squares of side ``radius``; a point lies in one square, so the join is an equi-join
    on squares and gives no pair twice. Missing coordinates match nothing. With ``broadcast_rows`` the sites are counted, and
    broadcast if they are no more, so that points are not shuffled; otherwise the planner decides.

    Unless sites are broadcast, sites of one place are joined as lists of about ``size``, which are spread out only beside the points
    that are near, and squares are counted first. Those of more than ``hot`` points, ``hot`` sites of the square or one around it, or
    ``share`` pairs of them, are cut: points and sites are dealt to parts, and each part of one meets each of the other.
    From ``share`` such pairs in all on, squares and parts are dealt to tasks by pairs: a few read rows can give any number
    of pairs, so neither input splits nor bytes of a shuffle tell how many tasks they take. A stream of points is not counted.
    """
    small = broadcast_rows is not None and sites.count() <= broadcast_rows
    columns = [*({x: f"site_{x}", y: f"site_{y}"}.get(c, c) for c in sites.columns), *points.columns, "d2"]
    s = sites.filter(f"{x} IS NOT NULL AND {y} IS NOT NULL").withColumnsRenamed({x: "__sx", y: "__sy"})
    p = points.filter(f"{x} IS NOT NULL AND {y} IS NOT NULL").withColumns({"__cx": _square(x, radius), "__cy": _square(y, radius)})
    keys, listed = ["__cx", "__cy"], False
    if hot is None or small or points.isStreaming:
        s = _near(s, radius)
    else:
        places, listed, seen = s.withColumn("n", F.lit(1)), len(s.columns) > 2, Tally()
        if listed:
            s, places = _listed(s, size)
        # the order of a list differs from run to run, so its number stands for it
        s_spread = F.xxhash64("__sx", "__sy", "__list") if listed else _spread(s)
        s = _near(s.withColumn("__deal", s_spread), radius)
        work = p.groupBy(*keys).agg(F.count("*").alias("n")).join(_near(places, radius).groupBy(*keys).agg(F.sum("n").alias("__near")), keys)
        work = seen.on(work.withColumn("__pairs", F.col("n").cast("double") * F.col("__near")), pairs=F.sum("__pairs"))
        work = work.withColumn("__sides", F.ceil(F.col("__near") / hot))
        parts = F.greatest(F.ceil(F.col("n") / hot), F.least(F.ceil(F.col("__pairs") / F.col("__sides") / share), F.col("n")))
        dense = materialise(work.select(*keys, parts.cast("int").alias("__parts"), F.col("__sides").cast("int")).filter("__parts > 1 OR __sides > 1"), "dense-squares")
        n = dense.count()
        if n:
            few = F.broadcast(dense) if n <= HOT else dense
            deal = lambda number, parts: F.pmod(number, F.coalesce(parts, F.lit(1)).cast("bigint")).cast("int")
            every = lambda parts: F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))
            p = p.join(few, keys, "left").withColumn("__part", deal(_spread(points), "__parts")).withColumn("__side", every("__sides")).drop("__parts", "__sides")
            s = s.join(few, keys, "left").withColumn("__side", deal("__deal", "__sides")).withColumn("__part", every("__parts")).drop("__parts", "__sides")
            keys = [*keys, "__part", "__side"]
        if (pairs := seen.get("pairs")) > share:
            tasks = min(TASKS, max(int(pairs // share) + 1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
            # neither broadcast, which would leave points in their splits, nor drawn together by bytes
            s, p = s.repartition(tasks, *keys).hint("merge"), p.repartition(tasks, *keys)
    d2 = (F.col("__sx") - F.col(x)) * (F.col("__sx") - F.col(x)) + (F.col("__sy") - F.col(y)) * (F.col("__sy") - F.col(y))
    out = p.join(F.broadcast(s) if small else s, keys).withColumn("d2", d2.cast("double")).filter(F.col("d2") <= float(radius) ** 2)
    out = out.withColumnsRenamed({"__sx": f"site_{x}", "__sy": f"site_{y}"})
    return (out.select("*", F.inline("__sites")) if listed else out).select(*[F.col(f"`{c}`") for c in columns])


def place_counts(sites: DataFrame, points: DataFrame, radius: float, by: list[str], x: str = "e", y: str = "n", broadcast_rows: int = 20_000) -> DataFrame:
    """(site_x, site_y, by..., pairs): how many points of each group ``by`` lie within ``radius`` of each place that has sites.

    Sites of equal coordinates are one place, so pairs are counted and never listed: what is joined grows with the different
    places and not with the product of sites and points. Up to ``broadcast_rows`` places are sent to all tasks; for more,
    points of one group and place are added up before they meet the places. Join ``x`` and ``y`` of sites to get back to them.
    """
    places = sites.select(x, y).filter(f"{x} IS NOT NULL AND {y} IS NOT NULL").distinct()
    n = F.lit(1).cast("long")
    if places.count() > broadcast_rows:
        points, n = points.groupBy(*dict.fromkeys([*by, x, y])).agg(F.count("*").alias("__n")), F.col("__n")
    near = distance_join(places, points, radius, x=x, y=y, broadcast_rows=broadcast_rows)
    return near.groupBy(f"site_{x}", f"site_{y}", *by).agg(F.sum(n).alias("pairs"))


def pair_counts(sites: DataFrame, points: DataFrame, radius: float, site_by: list[str], by: list[str], x: str = "e", y: str = "n", broadcast_rows: int = 20_000) -> DataFrame:
    """(site_by..., by..., pairs): pairs within ``radius`` of each group of sites and each group of points, by ``place_counts``."""
    met = place_counts(sites, points, radius, by, x, y, broadcast_rows)
    own = sites.groupBy(*site_by, F.col(x).alias(f"site_{x}"), F.col(y).alias(f"site_{y}")).agg(F.count("*").alias("__sites"))
    return met.join(own, [f"site_{x}", f"site_{y}"]).groupBy(*site_by, *by).agg(F.sum(F.col("pairs") * F.col("__sites")).alias("pairs"))


def in_box(df: DataFrame, lon: str, lat: str, west: float = 10.0, east: float = 25.0, south: float = 55.0, north: float = 69.5) -> DataFrame:
    """Rows inside a box, edges included; missing coordinates are outside."""
    return df.filter(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def sane(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Rows whose coordinates exist on the globe."""
    return in_box(df, lon, lat, -180.0, 180.0, -90.0, 90.0)


def with_cells(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Adds gx, gy and cell_id of squares of side ``size``."""
    df = df.withColumns({"gx": grid_index(F.col(x), size), "gy": grid_index(F.col(y), size)})
    return df.withColumn("cell_id", cell_name(F.col("gx"), F.col("gy")))


def covered_cells(df: DataFrame, low_x: str, high_x: str, low_y: str, high_y: str, size: float) -> DataFrame:
    """One row for each square that a box of a row touches."""
    for name, low, high in (("gx", low_x, high_x), ("gy", low_y, high_y)):
        df = df.withColumn(name, F.explode(F.sequence(grid_index(F.col(low), size), grid_index(F.col(high), size))))
    return df
