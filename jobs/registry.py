"""The jobs as queries: each runs twice into a new folder and gives back its whole output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import associates, site_lists
from terrane.plans import oracles
from terrane.scratch import scratch_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_site_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition of (lang, source) sites from the texts as lists of ids."""
    folder = _folder(spark, "job1")
    config = site_lists.Config(input=f"{sf_dir}/documents.parquet", output=f"{folder}/out", checkpoint=f"{folder}/checkpoint")
    site_lists.run(spark, config)
    return site_lists.run(spark, config)


def job2_associates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all months on associates of focal taxa."""
    config = associates.Config(sites=f"{sf_dir}/customer.parquet", points=f"{sf_dir}/orders.parquet", output=f"{_folder(spark, 'job2')}/out", red=("1-O", "2-F", "3-P", "5-O"))
    associates.run(spark, config)
    return associates.run(spark, config)


JOB1 = r"""
WITH d AS (
  SELECT coalesce(nullif(trim(lang), ''), 'NA') AS lang, coalesce(nullif(trim(source), ''), 'NA') AS source, list_distinct(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS ids FROM documents
),
sites AS (SELECT lang, source, count(*) AS n_lists FROM d WHERE len(ids) > 0 GROUP BY ALL),
own AS (SELECT lang, source, species_id, count(*) AS n FROM (SELECT lang, source, unnest(ids) AS species_id FROM d) GROUP BY ALL)
SELECT lang, source, species_id, n, n_lists, round(sqrt(n::DOUBLE / sum(n) OVER (PARTITION BY lang, source)), 6) AS value FROM own JOIN sites USING (lang, source)
"""

JOB2 = f"""
WITH {oracles.SITES}, {oracles.POINTS}, days AS (SELECT o_orderkey AS pid, strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderdate IS NOT NULL), {oracles.RED},
met AS (SELECT month, sci, fid, tid FROM sites s JOIN points p ON (s.e - p.e) * (s.e - p.e) + (s.n - p.n) * (s.n - p.n) <= 2500 JOIN days USING (pid)),
kept AS (SELECT month, sci, tid, count(*) AS n_pairs, count(DISTINCT fid) AS n_sites, max(CASE WHEN id IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_red FROM met LEFT JOIN red ON id = tid WHERE tid NOT IN ('', 'NA') GROUP BY ALL HAVING count(*) >= 15)
SELECT 'associates' AS report, month, sci, tid, n_pairs, n_sites, n_red, NULL::BIGINT AS n_points FROM kept
UNION ALL
SELECT 'totals', month, sci, NULL, n_pairs, n_sites, coalesce(red, 0)::BIGINT, NULL
FROM (SELECT month, sci, count(*) AS n_pairs, count(DISTINCT fid) AS n_sites FROM met GROUP BY ALL) LEFT JOIN (SELECT month, sci, sum(n_red) AS red FROM kept GROUP BY ALL) USING (month, sci)
UNION ALL
SELECT 'month', month, NULL, NULL, NULL, NULL, NULL, count(*) FROM days GROUP BY ALL
"""


def queries() -> dict:
    return {"job1_site_lists": job1_site_lists, "job2_associates": job2_associates}


def oracle_sql() -> dict[str, str]:
    return {"job1_site_lists": JOB1, "job2_associates": JOB2}
