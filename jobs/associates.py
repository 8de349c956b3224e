"""Associates of focal taxa, month by month.

    python jobs/associates.py --config jobs/associates.json --sites FILE --points FILE --output DIR [--since MONTH] [--until MONTH]

Reads focal sites and dated occurrences, joins them by distance, and writes for each month which taxa were met often enough near the
sites of each focal taxon, beside the month's totals. A run replaces the months from ``since`` to ``until`` and leaves
all others as they are, so that a year's data can be added, or a month corrected, without going through the rest.
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from jobs.common import main, table
from terrane.observed import Tally
from terrane.operators import spatial
from terrane.plans import bridge
from terrane.scratch import discard, materialise
from terrane.sources import writers

log = logging.getLogger("jobs.associates")

REPORT = "report string, sci string, tid string, n_pairs long, n_sites long, n_red long, n_points long, month string"


@dataclass(frozen=True)
class Config:
    """``sites`` and ``points``: tables of focal sites and of occurrences. ``since`` and ``until``: months (yyyy-MM), both included;
    None has no bound. ``least``: pairs that an associate needs in a month. ``red``: ids of a red list. ``broadcast_rows``: most places
    of sites that are sent to all tasks."""

    sites: str
    points: str
    output: str
    radius: float = 50.0
    least: int = 15
    since: str | None = None
    until: str | None = None
    red: tuple[str, ...] = ()
    broadcast_rows: int = 20_000


def dated(spark: SparkSession, config: Config) -> DataFrame:
    """(tid, pid, locality, e, n, month) of the asked-for months; undated occurrences are in none. The bounds reach the scan."""
    rows = spark.read.parquet(config.points).filter("o_orderdate IS NOT NULL")
    if config.since:
        rows = rows.filter(F.col("o_orderdate") >= F.to_timestamp(F.lit(f"{config.since}-01")))
    if config.until:
        rows = rows.filter(F.col("o_orderdate") < F.to_timestamp(F.add_months(F.to_date(F.lit(f"{config.until}-01")), 1)))
    return bridge.points_of(rows, F.date_format("o_orderdate", "yyyy-MM").alias("month"))


def run(spark: SparkSession, config: Config) -> DataFrame:
    """Write the report of the asked-for months and give back the whole report as it stands then.

    Rows are of three kinds. ``associates``: pairs of an occurring taxon with sites of a focal taxon, and with how many sites; 1 in
    ``n_red`` marks the red list. ``totals``: a focal taxon's pairs and sites with any, kept associates below the threshold
    or not, and its kept red ones. ``month``: the occurrences read. A month without occurrences has no rows and keeps what
    was written for it before; any other is replaced as a whole. Sites or occurrences without coordinates match nothing,
    repeated rows count each time.
    """
    n_sites, n_points, n_pairs, written = (Tally() for _ in range(4))
    sites = bridge.sites_of(spark.read.parquet(config.sites))
    points = dated(spark, config)
    red = spark.createDataFrame([(i,) for i in config.red], "tid string").distinct().withColumn("red", F.lit(1))
    # a place's sites all meet the same occurrences: what is kept of all pairs is their number for each place and focal taxon,
    # which the two kinds of rows are made of. A site's key gives its place, so no site is in two of them
    own = n_sites.on(sites).groupBy("sci", F.col("e").alias("site_e"), F.col("n").alias("site_n")).agg(F.count("*").alias("rows"), F.count_distinct("fid").alias("sites"))
    own = materialise(own, "places")
    near = spatial.place_counts(own.select(F.col("site_e").alias("e"), F.col("site_n").alias("n")), n_points.on(points.select("tid", "month", "e", "n")), config.radius, ["month", "tid"], broadcast_rows=config.broadcast_rows)
    hits = near.join(own, ["site_e", "site_n"]).select("month", "sci", "tid", "site_e", "site_n", "sites", (F.col("pairs") * F.col("rows")).alias("pairs"))
    met = materialise(n_pairs.on(hits, pairs=F.sum("pairs")), "associates")
    log.info("read %d sites of %s and %d occurrences of %s; %d pairs within %s", n_sites.get(), config.sites, n_points.get(), config.points, n_pairs.get("pairs"), config.radius)
    none = lambda name, kind="long": F.lit(None).cast(kind).alias(name)
    kept = writers.associate_counts(met, config.least, by=("month", "sci", "tid"), pairs=F.sum("pairs"), n_sites=F.sum("sites"))
    kept = kept.join(red, "tid", "left").select(F.lit("associates").alias("report"), "sci", "tid", F.col("n").alias("n_pairs"), "n_sites", F.coalesce("red", F.lit(0)).cast("long").alias("n_red"), none("n_points"), "month")
    found = kept.groupBy(F.col("month").alias("m"), F.col("sci").alias("s")).agg(F.sum("n_red").alias("n_red"))
    places = met.groupBy("month", "sci", "site_e", "site_n").agg(F.sum("pairs").alias("pairs"), F.first("sites").alias("sites"))
    pairs = places.groupBy("month", "sci").agg(F.sum("pairs").alias("n_pairs"), F.sum("sites").alias("n_sites"))
    totals = pairs.join(found, F.col("month").eqNullSafe(F.col("m")) & F.col("sci").eqNullSafe(F.col("s")), "left").select(F.lit("totals").alias("report"), "sci", none("tid", "string"), "n_pairs", "n_sites", F.coalesce("n_red", F.lit(0).cast("long")).alias("n_red"), none("n_points"), "month")
    months = points.groupBy("month").agg(F.count("*").alias("n_points")).select(F.lit("month").alias("report"), none("sci", "string"), none("tid", "string"), none("n_pairs"), none("n_sites"), none("n_red"), "n_points", "month")
    # a month's rows are one file
    out = written.on(kept.union(totals).union(months).repartition("month"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(config.output)
    discard(met)
    discard(own)
    log.info("wrote %d rows to %s", written.get(), config.output)
    return table(spark, config.output, REPORT)


if __name__ == "__main__":
    main(Config, run, "Associates by month", ("sites", "points", "output", "since", "until"), str(Path(__file__).with_suffix(".json")))
