"""Both jobs: two runs over growing input, tries that are repeated, corrected months, the command line and the SQL."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import associates, registry, site_lists
from jobs.common import read_config

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def rows(df, *columns):
    return sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))


@pytest.mark.parametrize("name", ["job1_site_lists", "job2_associates"])
def test_query_equals_its_sql(spark, name):
    settings = lambda: {r["key"]: r["value"] for r in spark.sql("SET").collect() if r["key"].startswith("spark.sql.")}
    before = settings()
    con = duckdb.connect()
    for t in ("documents", "customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    have, want = rows(got, *columns), sorted(str(tuple(r)) for r in cursor.fetchall())
    assert len(have) > 100 and have == want
    assert before == settings()


LISTS = "doc_id long, lang string, source string, text string, species_id string, n int"
FIRST = [(1, "en", "a", "x  y x", "?", 9), (2, "en", "a", "x z", "?", 9), (3, "de", "b", "u", "?", 9), (4, None, " ", "q", "?", 9), (5, "en", "b", None, "?", 9), (6, "en", "b", " \t", "?", 9)]
SECOND = [(7, "en", "a", "x w", "?", 9), (1, "en", "a", "x  y x", "?", 9), (8, "fr", "c", "v", "?", 9)]


def whole(*parts):
    lists = {}
    for r in (r for p in parts for r in p):
        ids = set((r[3] or "").split())
        if ids:
            lists.setdefault(((r[1] or "").strip() or "NA", (r[2] or "").strip() or "NA"), []).append(ids)
    out = []
    for site, own in lists.items():
        counts = {i: sum(i in ids for ids in own) for i in set().union(*own)}
        out += [(*site, i, n, len(own), round((n / sum(counts.values())) ** 0.5, 6)) for i, n in counts.items()]
    return sorted(map(str, out))


COLUMNS = ("lang", "source", "species_id", "n", "n_lists", "value")


def test_lists_grow(spark, tmp_path, caplog):
    caplog.set_level("INFO")
    config = site_lists.Config(input=f"{tmp_path}/in", output=f"{tmp_path}/out", checkpoint=f"{tmp_path}/cp")
    spark.createDataFrame(FIRST, LISTS).coalesce(1).write.parquet(config.input)
    assert rows(site_lists.run(spark, config), *COLUMNS) == whole(FIRST)
    assert "read 6 lists, 2 of them blank; 6 ids, 0 of them excluded" in caplog.text
    files = lambda part: sorted((str(p), p.stat().st_mtime_ns) for p in Path(config.output, "composition").rglob(f"lang={part}/*.parquet"))
    de, en = files("de"), files("en")
    # nothing new: nothing is written
    assert rows(site_lists.run(spark, config), *COLUMNS) == whole(FIRST)
    assert (files("de"), files("en")) == (de, en) and de and en
    spark.createDataFrame(SECOND, LISTS).coalesce(1).write.mode("append").parquet(config.input)
    caplog.clear()
    assert rows(site_lists.run(spark, config), *COLUMNS) == whole(FIRST, SECOND)
    assert "read 3 lists" in caplog.text and "read 6 lists" not in caplog.text
    # only the partitions that the new lists touch were written again
    assert files("de") == de and files("en") != en


def test_a_batch_that_is_tried_again_counts_once(spark, tmp_path):
    config = site_lists.Config(input="-", output=f"{tmp_path}/out", checkpoint="-")
    site_lists.take(spark.createDataFrame(FIRST, LISTS), 0, config)
    for _ in range(2):
        site_lists.take(spark.createDataFrame(SECOND, LISTS), 1, config)
    assert rows(site_lists.composition(spark, config), *COLUMNS) == whole(FIRST, SECOND)


def test_a_run_that_is_cut_off_is_started_again(spark, tmp_path, monkeypatch):
    config = site_lists.Config(input=f"{tmp_path}/in", output=f"{tmp_path}/out", checkpoint=f"{tmp_path}/cp")
    spark.createDataFrame(FIRST, LISTS).write.parquet(config.input)
    real = site_lists.publish

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(site_lists, "publish", broken)
    with pytest.raises(Exception, match="lost"):
        site_lists.run(spark, config)
    monkeypatch.setattr(site_lists, "publish", real)
    assert rows(site_lists.run(spark, config), *COLUMNS) == whole(FIRST)


def test_excluded_ids_and_no_lists(spark, tmp_path):
    (tmp_path / "exclude.csv").write_text("taxonID;name\nx;X\n")
    config = site_lists.Config(input=f"{tmp_path}/in", output=f"{tmp_path}/out", checkpoint=f"{tmp_path}/cp", exclude=f"{tmp_path}/exclude.csv", files=1)
    spark.createDataFrame([], LISTS).write.parquet(config.input)
    assert site_lists.run(spark, config).count() == 0
    spark.createDataFrame(FIRST, LISTS).repartition(3).write.mode("append").parquet(config.input)
    got = {r["species_id"]: (r["n"], r["n_lists"]) for r in site_lists.run(spark, config).filter("source = 'a'").collect()}
    assert got == {"y": (1, 2), "z": (1, 2)}


def months(df):
    return {r["month"]: r["n"] for r in df.groupBy("month").agg(F.count("*").alias("n")).collect()}


def test_months_are_replaced_one_by_one(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.write.parquet(f"{tmp_path}/orders")
    of = lambda **k: associates.Config(sites=f"{SF}/customer.parquet", points=f"{tmp_path}/orders", output=f"{tmp_path}/out", least=2, **k)
    everything = associates.run(spark, associates.Config(sites=f"{SF}/customer.parquet", points=f"{tmp_path}/orders", output=f"{tmp_path}/all", least=2))
    every = months(everything)
    some = sorted(every)[3:6]
    got = months(associates.run(spark, of(since=some[0], until=some[1])))
    assert got == {m: every[m] for m in some[:2]}
    got = associates.run(spark, of(since=some[1], until=some[2]))
    assert months(got) == {m: every[m] for m in some}
    want = everything.filter(F.col("month").isin(some))
    assert rows(got, *want.columns) == rows(want, *want.columns)
    # a corrected month loses what it no longer holds
    fewer = orders.filter(f"date_format(o_orderdate, 'yyyy-MM') <> '{some[1]}'").unionByName(orders.filter(f"date_format(o_orderdate, 'yyyy-MM') = '{some[1]}'").limit(1))
    fewer.write.parquet(f"{tmp_path}/fewer")
    got = associates.run(spark, associates.Config(sites=f"{SF}/customer.parquet", points=f"{tmp_path}/fewer", output=f"{tmp_path}/out", least=2, since=some[1], until=some[1]))
    assert got.filter(F.col("month") == some[1]).filter("report = 'associates'").count() == 0
    assert {m: n for m, n in months(got).items() if m != some[1]} == {m: every[m] for m in some if m != some[1]}


def test_configs():
    assert read_config(site_lists.Config, str(ROOT / "jobs/site_lists.json"), output="/o", exclude=None).output == "/o"
    assert read_config(associates.Config, str(ROOT / "jobs/associates.json")).red == ("1-O", "2-F", "3-P", "5-O")
    with pytest.raises(ValueError, match="unknown"):
        read_config(associates.Config, str(ROOT / "jobs/associates.json"), speed=1)


def test_command_lines(spark, tmp_path):
    """In processes of their own, which make and stop their sessions."""
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 --conf spark.checkpoint.dir={tmp_path}/scratch pyspark-shell"}
    settings = json.loads((ROOT / "jobs/site_lists.json").read_text()) | {"input": f"{SF}/documents.parquet", "output": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/cp"}
    (tmp_path / "config.json").write_text(json.dumps(settings))
    done = subprocess.run([sys.executable, str(ROOT / "jobs/site_lists.py"), "--config", f"{tmp_path}/config.json"], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "lists" in done.stderr and site_lists.composition(spark, read_config(site_lists.Config, f"{tmp_path}/config.json")).count() > 100
    done = subprocess.run([sys.executable, str(ROOT / "jobs/associates.py"), "--sites", f"{SF}/customer.parquet", "--points", f"{SF}/orders.parquet", "--output", f"{tmp_path}/months"], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "wrote" in done.stderr and spark.read.parquet(f"{tmp_path}/months").count() > 10
