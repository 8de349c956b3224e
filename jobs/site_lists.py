"""Consolidates a growing folder of site lists to the composition of sites.

    python jobs/site_lists.py --config jobs/site_lists.json --input DIR --output DIR --checkpoint DIR

A list is a row with the columns of its site and a text of ids parted by white space. Each run takes the files that came
since the last one (a file stream with a checkpoint) and ends. What a batch of files brings is counted and written to
``increments``; the composition of those partitions that it touches is then made anew from all increments and put in their
place. Both writes replace what an earlier try of the same batch wrote, so a run that was cut off is simply started again.
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
from terrane.functions.expr import share_of_total
from terrane.observed import Tally
from terrane.operators import community
from terrane.sources import readers

log = logging.getLogger("jobs.site_lists")


@dataclass(frozen=True)
class Config:
    """``site``: columns that name a site, the first one parts the output; a missing or empty name is 'NA'. ``lists``: the column
    of ids. ``exclude``: a file of ids to leave out when lists are taken in. ``files``: most files of a batch."""

    input: str
    output: str
    checkpoint: str
    site: tuple[str, ...] = ("lang", "source")
    lists: str = "text"
    exclude: str | None = None
    files: int | None = None


def _schemas(config: Config) -> tuple[str, str]:
    site = ", ".join(f"`{c}` string" for c in config.site)
    return f"batch long, {site}, species_id string, n long", f"{site}, species_id string, n long, n_lists long, value double"


def take(batch: DataFrame, number: int, config: Config) -> None:
    """Count the lists of a batch and renew the partitions that it touches."""
    spark, site, part = batch.sparkSession, list(config.site), config.site[0]
    lists, words, kept = Tally(), Tally(), Tally()
    named = batch.select(*[F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("NA")).alias(c) for c in site], F.col(config.lists).alias("__list"))
    # a row without an id stands for its list
    rows = words.on(community.explode_lists(lists.on(named), part, "__list", distinct=True, marker=True), ids=F.count("species_id"))
    rows = kept.on(community.without(rows, "species_id", readers.exclude_list(spark, config.exclude)))
    path = f"{config.output}/increments/batch={number}"
    rows.groupBy(*site, "species_id").agg(F.count("*").alias("n")).write.mode("overwrite").partitionBy(part).parquet(path)
    log.info("batch %d of %s: read %d lists, %d of them blank; %d ids, %d of them excluded; wrote %s", number, config.input, lists.get(), lists.get() - words.get() + words.get("ids"), words.get("ids"), words.get() - kept.get(), path)
    publish(spark, config, number)


def publish(spark: SparkSession, config: Config, number: int) -> None:
    """Make the composition of the partitions that batch ``number`` touches anew, from the increments of all batches."""
    site, part = list(config.site), config.site[0]
    increments = table(spark, f"{config.output}/increments", _schemas(config)[0])
    # names of partitions, which are folders of the output
    touched = [r[0] for r in increments.filter(F.col("batch") == number).select(part).distinct().collect()]
    whole = increments.filter(F.col(part).isin(touched)).groupBy(*site, "species_id").agg(F.sum("n").alias("n"))
    ids = whole.filter("species_id IS NOT NULL").withColumn("value", F.round(F.sqrt(share_of_total(F.col("n").cast("double"), *site)), 6))
    sizes = whole.filter("species_id IS NULL").select(*site, F.col("n").alias("n_lists"))
    written = Tally()
    out = written.on(ids.join(sizes, site).select(*site, "species_id", "n", "n_lists", "value"))
    path = f"{config.output}/composition"
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    log.info("batch %d: wrote %d rows in %d partitions of %s", number, written.get(), len(touched), path)


def composition(spark: SparkSession, config: Config) -> DataFrame:
    """(site columns, species_id, n, n_lists, value): lists of a site that hold an id, its lists, and the root of the id's share."""
    return table(spark, f"{config.output}/composition", _schemas(config)[1])


def run(spark: SparkSession, config: Config) -> DataFrame:
    """Take in what is new and give back the whole composition.

    Ids count once a list. Rows with a null or blank list bring nothing. A file is taken once, by its path: rows that are
    added later belong in new files. No input yet gives no rows.
    """
    schema = spark.read.parquet(config.input).schema
    source = spark.readStream.schema(schema)
    source = source.option("maxFilesPerTrigger", config.files) if config.files else source
    # a stream takes a folder or a pattern; as a pattern, the path may also be that of one file
    path = config.input.rstrip("/")
    query = source.parquet(f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() else path).writeStream.foreachBatch(lambda batch, number: take(batch, number, config)).option("checkpointLocation", config.checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if not readers._exists(spark, f"{config.output}/composition"):
        spark.createDataFrame([], _schemas(config)[1]).write.mode("overwrite").parquet(f"{config.output}/composition")
    return composition(spark, config)


if __name__ == "__main__":
    main(Config, run, "Consolidate new site lists", ("input", "output", "checkpoint", "exclude"), str(Path(__file__).with_suffix(".json")))
