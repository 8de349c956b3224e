"""Numbers and quantiles from ranks inside ranges, so that no task sorts or holds a whole column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Distinct rows of ``df`` with ``name``: 0, 1, ... in the order of the columns ``order``, nulls first.

    Rows are ranked inside ranges and the ranges' sizes are added up. The ranges are written to the shared folder before
    they are counted, so a lost executor cannot move a row to another range. The driver holds one number for each range.
    """
    ranged = materialise(df.distinct().repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = sorted((r["__part"], r["n"]) for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect())
    base, offsets = 0, []
    for part, n in sizes:
        offsets += [F.lit(part), F.lit(base).cast("long")]
        base += n
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    start = F.create_map(*offsets)[F.col("__part")] if offsets else F.lit(0).cast("long")
    return ranged.withColumn(name, start + rank).drop("__part")


def medians(df: DataFrame, by: list[str], value: str, times: Column | None = None) -> DataFrame:
    """(by, value): the median of each group. Equal values are counted first, so a group's state grows with its different values alone.

    A row stands for ``times`` rows, or for one."""
    counted = df.groupBy(*by, value).agg((F.count("*") if times is None else F.sum(times)).alias("__n"))
    return counted.groupBy(*by).agg(F.percentile(value, F.lit(0.5), F.col("__n")).alias(value))


def quantiles(df: DataFrame, by: list[str], value: str, at: list[float], name: str = "q") -> DataFrame:
    """(by, ``name``): exact interpolated quantiles of each group as an array, in the order of ``at``; nulls are left out.

    Equal values are one row with their number. Rows are ranged by group and value, counted in each range, and only the values
    at the asked-for ranks are gathered. Without ``by`` there is one row; groups without values have none.
    """
    counted = df.select(*by, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL").groupBy(*by, "__v").agg(F.count("*").alias("__n"))
    ranged = materialise(counted.repartitionByRange(*by, "__v").withColumn("__part", F.spark_partition_id()), "value-ranges")
    # one row for each group and range: how many values lie in earlier ranges, and in all
    group = Window.partitionBy(*by)
    sums = ranged.groupBy(*by, "__part").agg(F.sum("__n").alias("__own"))
    sums = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__p"), F.sum("__own").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.sum("__own").over(group).alias("__all"))
    inside = F.sum("__n").over(Window.partitionBy(*by, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    placed = ranged.withColumn("__upto", inside).join(sums, same).withColumn("__end", F.coalesce("__before", F.lit(0)) + F.col("__upto"))
    wanted = []
    for i, q in enumerate(at):
        place = F.lit(float(q)) * (F.col("__all") - 1)
        for side, f in ((0, F.floor), (1, F.ceil)):
            rank = f(place).cast("long")
            wanted.append(F.when((rank < F.col("__end")) & (rank >= F.col("__end") - F.col("__n")), F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), F.col("__v").alias("v"), (place - F.floor(place)).alias("part"))))
    hits = placed.select(*by, F.explode(F.filter(F.array(*wanted), lambda x: x.isNotNull())).alias("h")).select(*by, "h.*")
    one = hits.groupBy(*by, "i").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("high"), F.max("part").alias("part"))
    value_at = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high"))
    out = one.select(*by, F.struct("i", value_at.alias("v")).alias("iv")).groupBy(*by).agg(F.sort_array(F.collect_list("iv")).alias("__all"))
    return out.filter(F.size("__all") == len(at)).select(*by, F.transform("__all", lambda x: x["v"]).alias(name))
