"""Latitude bands and deterministic stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles


def latitude_bands(df: DataFrame, by: str, lat: str, n: int = 10) -> DataFrame:
    """Adds ``latband`` (``LAT1`` ...) and its number ``band``: right-closed bins between interpolated quantiles of each group.

    Equal edges are one edge; a group of one value is band 0; missing latitudes have no band.
    """
    edges = quantiles(df, [by], lat, [i / n for i in range(n + 1)], "__edges").select(F.col(by).alias("__by"), F.array_distinct("__edges").alias("__edges"))
    below = F.size(F.filter("__edges", lambda e: e < F.col(lat)))
    band = F.when(F.col(lat).isNotNull(), F.greatest(below - 1, F.lit(0)))
    out = df.join(edges, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
    return out.withColumn("band", band).withColumn("latband", F.concat(F.lit("LAT"), (F.col("band") + 1).cast("string"))).drop("__edges")


def site_quota(count: Column, cap: int = 400, bands: int = 10) -> Column:
    """Sites for each band: a tenth of the cap beyond it, a tenth of the rows (one at least) up to it."""
    return F.when(count > cap, F.lit(cap // bands)).otherwise(F.greatest(F.lit(1), F.floor(count / bands))).cast("int")


def uniform(seed: int, *columns: Column) -> Column:
    """A number in (0, 1) that seed and columns decide, the same in every engine that has md5."""
    text = F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + 1) / float((1 << 52) + 1)


def _weight(weight: str) -> Column:
    return F.greatest(F.coalesce(F.nanvl(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def draw(df: DataFrame, by: list[str], n: int | Column, seed: int, key: list[str], weight: str | None = None, replace: bool = False) -> DataFrame:
    """At most ``n`` rows of each group in an order drawn from ``seed`` and the rows' ``key``.

    With a weight the draw is proportional to it: negative and missing weights count as 0, and rows without weight come
    only when the whole group has none. With ``replace`` exactly ``n`` rows of each group are drawn, each from all rows.
    """
    n = F.lit(n) if isinstance(n, int) else n
    if replace:
        return _draw_again(df, by, n, seed, key, weight)
    at = uniform(seed, *[F.col(k) for k in key])
    order = at
    if weight is not None:
        total = F.sum(_weight(weight)).over(Window.partitionBy(*by))
        order = F.when(total <= 0, at).when(_weight(weight) > 0, -F.log(at) / _weight(weight))
    ranked = df.withColumn("__order", order).filter("__order IS NOT NULL")
    ranked = ranked.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy("__order", *key)))
    return ranked.filter(F.col("__rank") <= n).drop("__order", "__rank")


def _draw_again(df: DataFrame, by: list[str], n: Column, seed: int, key: list[str], weight: str | None) -> DataFrame:
    """Draws with replacement: rows lie end to end on a line by their weights, and each draw is a place on it."""
    own = Window.partitionBy(*by)
    w = _weight(weight) if weight else F.lit(1.0)
    rows = df.withColumns({"__n": n.cast("int"), "__w": F.when(F.sum(w).over(own) <= 0, 1.0).otherwise(w)}).filter("__w > 0")
    rows = rows.withColumn("__end", F.sum("__w").over(own.orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)))
    groups = rows.groupBy(*by).agg(F.max("__n").alias("__n"), F.max("__end").alias("__whole")).filter("__n > 0")
    draws = groups.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    columns = [F.col(f"`{c}`") for c in df.columns]
    row = F.struct(*columns)
    placed = rows.select(*by, F.col("__end").alias("__at"), F.lit(0).alias("__k"), row.alias("__row"))
    placed = placed.unionByName(draws.select(*by, (uniform(seed, F.col("__k"), *[F.col(c) for c in by]) * F.col("__whole")).alias("__at"), "__k", F.lit(None).cast(placed.schema["__row"].dataType).alias("__row")))
    # from the far end on, the last row before a draw is the one that it lies in
    before = own.orderBy(F.desc("__at"), "__k").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("__drawn", F.last("__row", ignorenulls=True).over(before)).filter("__k > 0").select("__drawn.*")


def effort_quota(df: DataFrame, by: list[str], stratum: str, n: Column) -> DataFrame:
    """(by, __stratum, __quota): ``n`` dealt to the strata of each group, the remainder to as many drawn ones; a missing stratum is 'NA'."""
    own = Window.partitionBy(*by)
    strata = df.groupBy(*by, F.coalesce(F.col(stratum).cast("string"), F.lit("NA")).alias("__stratum")).agg(F.max(n).alias("__n"))
    count = F.count("*").over(own)
    place = F.row_number().over(own.orderBy(uniform(0, F.col("__stratum"), *[F.col(c) for c in by]), "__stratum"))
    extra = F.when(place <= F.col("__n") % count, 1).otherwise(0)
    return strata.select(*by, "__stratum", (F.floor(F.col("__n") / count) + extra).cast("int").alias("__quota"))


def stratified_sample(df: DataFrame, by: str, band: str, per_band: Column | int, seed: int, key: list[str], strict_equal: bool = True, cap: int | None = None, effort: str | None = None, weight: str | None = None, replace: bool = False) -> DataFrame:
    """A sample of every band of every group; ``strict_equal`` lowers all bands' shares to the smallest band, unless rows are replaced.

    With ``effort``, a column of strata, a band's share is dealt evenly to its strata; a stratum with fewer rows gives them all.
    """
    own = df.filter(F.col(band).isNotNull())
    sizes = own.groupBy(by, band).agg(F.count("*").alias("__size"))
    least = sizes.groupBy(F.col(by).alias("__by")).agg(F.min("__size").alias("__least"))
    out = own.join(least, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    share = F.lit(per_band) if isinstance(per_band, int) else per_band
    share = F.least(share, F.col("__least")) if strict_equal and not replace else share
    if effort is None:
        out = draw(out, [by, band], share, seed, key, weight, replace).drop("__least")
    else:
        quota = effort_quota(out, [by, band], effort, share).withColumnsRenamed({by: "__by", band: "__band"})
        stratum = F.coalesce(F.col(effort).cast("string"), F.lit("NA"))
        out = out.join(quota, F.col(by).eqNullSafe(F.col("__by")) & (F.col(band) == F.col("__band")) & (stratum == F.col("__stratum"))).drop("__by", "__band")
        out = draw(out, [by, band, "__stratum"], F.col("__quota"), seed, key, weight, replace).drop("__least", "__stratum", "__quota")
    return draw(out, [by], cap, seed + 1, key) if cap else out
