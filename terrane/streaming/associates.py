"""Associates of focal sites from a stream of occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spatial import distance_join


def associate_stream(sites: DataFrame, points: DataFrame, radius: float = 50.0) -> DataFrame:
    """(sci, tid, n): running counts of pairs within ``radius`` of static sites (sci, fid, e, n); run in ``complete`` or ``update`` mode.

    ``points`` is a stream of (tid, e, n). The join holds no state; counts are one row for each pair of taxa.
    """
    return distance_join(sites, points, radius).groupBy("sci", "tid").agg(F.count("*").alias("n"))
