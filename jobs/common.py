"""What both jobs share: their config files, command line and session."""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read_config(kind, path: str, **over):
    """A config of ``kind`` from a JSON file, with arguments that are not None in place of its values."""
    found = json.loads(Path(path).read_text()) if path else {}
    found.update({k: v for k, v in over.items() if v is not None})
    names = {f.name for f in fields(kind)}
    if set(found) - names:
        raise ValueError(f"unknown settings {sorted(set(found) - names)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})


def main(kind, run, description: str, paths: tuple[str, ...], default: str) -> None:
    """The command line of a job: reads the config, makes the session, runs the job and stops the session."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", default=default, help="JSON file of settings")
    for name in paths:
        parser.add_argument(f"--{name}", help=f"overrides the setting {name!r}")
    given = vars(parser.parse_args())
    config = read_config(kind, given.pop("config"), **given)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(description).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, config)
    finally:
        spark.stop()


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of a job's output, which may have no files yet."""
    return spark.read.schema(schema).parquet(path)
