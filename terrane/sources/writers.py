"""Reports, tables and drawings."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict
from functools import reduce
from itertools import chain, islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import file_name, half_even, join_ids, known, underscored
from ..operators.ranks import medians


def associate_counts(hits: DataFrame, least: int = 15, by: tuple[str, ...] = ("sci", "tid"), pairs: Column | None = None, **more: Column) -> DataFrame:
    """(sci, tid, n) of associates met at least ``least`` times; hits are (sci, fid, tid, ...) rows, one for each pair.

    ``by`` names other groups; ``pairs`` adds up hits that stand for several pairs; ``more`` are further aggregates.
    """
    pairs = F.count("*") if pairs is None else pairs
    return hits.filter(known(F.col("tid")).isNotNull()).groupBy(*by).agg(pairs.alias("n"), *[c.alias(k) for k, c in more.items()]).filter(F.col("n") >= least)


def unique_finds(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sci").agg(join_ids(F.collect_set("tid")).alias("finds"))


def red_finds(counts: DataFrame, red: DataFrame) -> DataFrame:
    return unique_finds(counts.join(red.toDF("tid").distinct(), "tid", "left_semi"))


def all_observations(hits: DataFrame, counts: DataFrame) -> DataFrame:
    """(sci, tid): one row for each pair of a kept associate; hits that stand for several pairs keep their ``pairs``."""
    return hits.select("sci", "tid", *[c for c in hits.columns if c == "pairs"]).join(counts.select("sci", "tid"), ["sci", "tid"], "left_semi")


def target_totals(focal: DataFrame, counts: DataFrame, red: DataFrame) -> DataFrame:
    """(sci, n_focal, n_kept, n_red); focal rows count before any box; a missing name is a group."""
    rows = focal.groupBy("sci").agg(F.count("*").alias("n_focal"))
    marked = counts.join(red.toDF("tid").distinct().withColumn("red", F.lit(1)), "tid", "left")
    kept = marked.groupBy(F.col("sci").alias("__sci")).agg(F.count("*").alias("n_kept"), F.count("red").alias("n_red"))
    out = rows.join(kept, F.col("sci").eqNullSafe(F.col("__sci")), "left")
    return out.select("sci", "n_focal", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce("n_red", F.lit(0)).alias("n_red"))


def red_by_locality(hits: DataFrame, red: DataFrame) -> DataFrame:
    """(sci, locality, n_red): distinct red ids near each associate locality, with no threshold."""
    return hits.join(red.toDF("tid").distinct(), "tid", "left_semi").groupBy("sci", "locality").agg(F.count_distinct("tid").alias("n_red"))


def site_lists(sites: DataFrame, hits: DataFrame, on: tuple[str, ...] = ("sci", "fid")) -> DataFrame:
    """(sci, fid, LocalityID, SWEREF_N, SWEREF_E, latband, Species_IDs) of every site, those without hits included.

    ``on`` names what a hit knows of its sites: their keys, or their place if hits are counted by places."""
    found = hits.groupBy(*on).agg(join_ids(F.collect_set("tid")).alias("Species_IDs"))
    out = sites.join(found, list(on), "left")
    return out.select("sci", "fid", underscored(F.col("key")).alias("LocalityID"), half_even(F.col("n")).cast("int").alias("SWEREF_N"), half_even(F.col("e")).cast("int").alias("SWEREF_E"), "latband", F.coalesce("Species_IDs", F.lit("")).alias("Species_IDs"))


def red_lists(hits: DataFrame, red: DataFrame) -> DataFrame:
    """(sci, LocalityID, SWEREF_N, SWEREF_E, Species_IDs) of associate localities with red ids: medians, half to even.

    Hits may stand for several pairs, which their ``pairs`` then tell."""
    times = F.col("pairs") if "pairs" in hits.columns else None
    near = hits.join(red.toDF("tid").distinct(), "tid", "left_semi").filter("locality IS NOT NULL")
    near = near.withColumn("LocalityID", underscored(F.col("locality")))
    lists = near.groupBy("sci", "LocalityID").agg(join_ids(F.collect_set("tid")).alias("Species_IDs"))
    for c, name in (("n", "SWEREF_N"), ("e", "SWEREF_E")):
        middle = medians(near, ["sci", "LocalityID"], c, times).select(F.col("sci").alias("__sci"), F.col("LocalityID").alias("__id"), half_even(F.col(c)).cast("int").alias(name))
        lists = lists.join(middle, F.col("sci").eqNullSafe(F.col("__sci")) & (F.col("LocalityID") == F.col("__id"))).drop("__sci", "__id")
    return lists.select("sci", "LocalityID", "SWEREF_N", "SWEREF_E", "Species_IDs")


def write_tsv(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite").option("sep", "\t").option("header", True)
    (w.partitionBy(by) if by else w).csv(path)


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(by) if by else w).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_text(pieces: Iterable[str], path: str) -> None:
    """One file from pieces of text, through the file system that the path names, so a cluster's paths work too."""
    spark = SparkSession.active()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        for p in pieces:
            out.write(bytearray(p.encode()))
    finally:
        out.close()


def write_config(config, path: str) -> None:
    write_text([json.dumps(asdict(config), indent=2, sort_keys=True, default=str)], path)


def text_table(df: DataFrame, title: str, most: int = 1000, digits: int = 6) -> str:
    """A small result as aligned text, in the order of its columns; more than ``most`` rows are refused, not dropped."""
    rows = df.orderBy(*df.columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write a table instead")
    cells = [df.columns] + [[f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in rows]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return title + "\n" + "\n".join("  ".join(v.rjust(w) for v, w in zip(r, width)) for r in cells) + "\n"


def svg_map(cells: DataFrame, path: str) -> None:
    """Squares (x0, y0, width, colour_idx) as a drawing. Shapes stream to the file; the driver holds one partition at a time."""
    edge = cells.agg(F.min("x0").alias("__low"), F.max(F.col("y0") + F.col("width")).alias("__top"))
    at = [(F.col("x0") - F.col("__low")) / 1000, (F.col("__top") - F.col("y0") - F.col("width")) / 1000, F.col("width") / 1000, F.col("width") / 1000]
    shape = F.format_string('<rect x="%.2f" y="%.2f" width="%.2f" height="%.2f" fill="hsl(%d,60%%,55%%)"/>', *[a.cast("double") for a in at], (F.col("colour_idx") * 18).cast("int"))
    rows = cells.crossJoin(F.broadcast(edge)).select(shape.alias("s")).toLocalIterator()
    some = iter(lambda: "".join(r["s"] for r in islice(rows, 5000)), "")
    write_text(chain(['<svg xmlns="http://www.w3.org/2000/svg">'], some, ["</svg>"]), path)


def taxon_folders(df: DataFrame, by: str = "sci") -> DataFrame:
    """(by, taxon): a folder name for each taxon. Of those that clean to the same text the first keeps it, others end in __001, __002, ..."""
    names = df.select(by).distinct().withColumn("__name", file_name(F.col(by)))
    same = F.row_number().over(Window.partitionBy("__name").orderBy(F.asc_nulls_first(by))) - 1
    return names.select(by, F.when(same == 0, F.col("__name")).otherwise(F.format_string("%s__%03d", "__name", same)).alias("taxon"))


def write_taxa(tables: dict[str, DataFrame], path: str, by: str = "sci", order: dict[str, list[str]] | None = None, names: DataFrame | None = None) -> None:
    """Tab-separated rows of each table in ``path``/table/taxon=..., a folder for each taxon, the same in all tables.

    A missing name is 'unknown'. ``order`` sorts the rows of a file. A taxon with very many rows is several files.
    """
    if names is None:
        every = [t.select(by) for t in tables.values()]
        names = taxon_folders(reduce(DataFrame.union, every), by)
    for name, df in tables.items():
        rows = df.join(names.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
        rows = rows.sortWithinPartitions("taxon", *(order or {}).get(name, []))
        write_tsv(rows, f"{path}/{name}", "taxon")
