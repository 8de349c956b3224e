"""Species in every cell and points in one square: same results, and no task that holds them all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.observed import Tally
from terrane.operators import community, spatial, stats
from terrane.scratch import materialise


def widest(df):
    """Rows of the largest partition, and of all."""
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(sizes), sum(sizes)


@pytest.mark.parametrize("names", [False, True])
def test_common_species_go_to_dense_blocks(spark, names, monkeypatch):
    rng = np.random.default_rng(1)
    x = (rng.random((90, 30)) < 0.1) * rng.random((90, 30))
    x[:, 3], x[:, 7] = rng.random(90), rng.random(90)
    cell = (lambda i: f"cell {i:03d}") if names else int
    f = spark.createDataFrame([(cell(i), f"s{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], f"cell_id {'string' if names else 'long'}, species_id string, value double")
    plain = {(r["i"], r["j"]): r["dot"] for r in community.pair_dots(f).collect()}
    monkeypatch.setattr(community.shared_sums, "__defaults__", (20, 16, 4))
    split = {(r["i"], r["j"]): r["dot"] for r in community.pair_dots(f, heavy=20).collect()}
    assert split.keys() == plain.keys() == {(cell(i), cell(j)) for i in range(90) for j in range(i + 1, 90)}
    assert all(abs(split[k] - v) < 1e-12 for k, v in plain.items())
    labels = spark.createDataFrame([(cell(i), i % 2) for i in range(90)], f"cell_id {'string' if names else 'long'}, cluster long")
    rows = lambda: sorted(tuple(r) for r in stats.sorensen_pairs(f, labels).collect())
    dense = rows()
    monkeypatch.setattr(community.shared_sums, "__defaults__", (10_000, 512, 1024))
    assert dense == rows()


def points_of_one_square(spark, n):
    spread = spark.range(n).select(F.lit("t").alias("tid"), F.lit(1.0).alias("e"), F.lit(2.0).alias("n"))
    return spread.repartition(4)


def test_dense_squares_are_cut(spark):
    points = materialise(points_of_one_square(spark, 4000).union(spark.createDataFrame([("u", 500.0, 2.0), ("u", None, 2.0)], "tid string, e double, n double")), "test-points")
    sites = spark.createDataFrame([("a", 1, 3.0, 2.0), ("b", 2, 51.0, 2.0), ("c", 3, 460.0, 2.0), ("d", 4, 90.0, 2.0), ("e", 5, None, 2.0)], "sci string, fid long, e double, n double")
    count = lambda df: sorted(tuple(r) for r in df.groupBy("fid", "tid").agg(F.count("*")).collect())
    want = [(1, "t", 4000), (2, "t", 4000), (3, "u", 1)]
    assert count(spatial.distance_join(sites, points, 50.0, hot=None)) == want
    cut = spatial.distance_join(sites, points, 50.0, hot=300)
    assert cut.columns == spatial.distance_join(sites, points, 50.0, hot=None).columns and count(cut) == want


def test_pairs_of_a_dense_square_are_spread(spark):
    points = materialise(spark.range(8000).select(F.col("id").alias("pid"), F.lit(1.0).alias("e"), F.lit(2.0).alias("n")).repartition(4), "test-points")
    sites = spark.createDataFrame([(i, 3.0, 2.0) for i in range(5)], "fid long, e double, n double")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        largest, every = widest(spatial.distance_join(sites, points, 50.0, hot=200))
        assert every == 40_000 and largest < 0.6 * every
        assert widest(spatial.distance_join(sites, points, 50.0, hot=None))[0] == 40_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pairs_take_tasks_by_their_number(spark):
    """8,000 and 32,000 rows of one split each, in 8 squares: 32 million pairs, which one task made as its input is small."""
    e, n = (F.col("id") % 8 * 1000).cast("double").alias("e"), (F.col("id") % 8 * 700 + 2).cast("double").alias("n")
    sites = spark.range(0, 8000, 1, 1).select(F.lit("s").alias("sci"), F.col("id").alias("fid"), e, n)
    points = spark.range(0, 32_000, 1, 1).select(F.col("id").alias("pid"), e, n)
    largest, every = widest(spatial.distance_join(sites, points, 50.0))
    assert every == 32_000_000 and largest < 0.7 * every


@pytest.mark.parametrize("size,share,hot", [(1000, 20_000_000, 100_000), (3, 40, 100_000), (2, 40, 7)])
def test_lists_and_cuts_give_each_pair_once(spark, size, share, hot):
    rng = np.random.default_rng(7)
    s = [(f"s{i % 3}", *map(float, rng.integers(-9, 9, 2) * 10), i, [i]) for i in range(120)] + [("s0", None, 1.0, 900, None), (None, 0.0, 0.0, 901, None), (None, 0.0, 0.0, 901, None)]
    p = [(i, *map(float, rng.integers(-9, 9, 2) * 10)) for i in range(150)] + [(900, 1.0, None), (None, -30.0, -40.0), (None, -30.0, -40.0)]
    sites = materialise(spark.createDataFrame(s, "sci string, e double, n double, fid long, more array<long>").repartition(3), "test-sites")
    points = materialise(spark.createDataFrame(p, "pid long, e double, n double").repartition(3), "test-points")
    got = spatial.distance_join(sites, points, 50.0, size=size, share=share, hot=hot)
    assert got.columns == ["sci", "site_e", "site_n", "fid", "more", "pid", "e", "n", "d2"]
    want = [(*a, *b, d) for a in s for b in p if None not in (a[1], a[2], b[1], b[2]) and (d := (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) <= 2500]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    want = sorted(repr((*a[1:3], *b, d)) for a in s for b in p if None not in (a[1], a[2], b[1], b[2]) and (d := (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) <= 2500)
    assert want == sorted(repr(tuple(r)) for r in spatial.distance_join(sites.select("e", "n"), points, 50.0, share=share, hot=hot).collect())


def test_counts_ride_on_the_pass(spark):
    seen, kept = Tally(), Tally()
    df = spark.range(100)
    out = kept.on(seen.on(df, even=F.count_if(F.col("id") % 2 == 0)).filter("id < 10"))
    assert out.count() == 10 and (seen.get(), seen.get("even"), kept.get()) == (100, 50, 10)
    none = Tally()
    assert none.on(spark.createDataFrame([], "id long").filter("id > 3")).count() == 0 and none.get() == 0


def test_pairs_of_equal_places_are_counted_and_not_listed(spark, tmp_path):
    """200,000 sites and as many points of one place: 40 thousand million pairs, which no run could list."""
    from jobs import associates
    from terrane.plans import queries

    n = 200_000
    c = spark.range(n).select((F.col("id") * 400).alias("c_custkey"), F.lit("S").alias("c_mktsegment"))
    o = spark.range(n).select((F.col("id") * 158_800).alias("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority"), F.lit("O").alias("o_orderstatus"), F.lit("2020-05-06").cast("timestamp").alias("o_orderdate"))
    c.write.parquet(f"{tmp_path}/customer.parquet")
    o.write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("radius_counts", "all_observations"):
        assert [tuple(r) for r in queries.__dict__[name](spark, str(tmp_path)).collect()] == [("S", "1-O", n * n)]
    assert [r["Species_IDs"] for r in queries.site_species_sets(spark, str(tmp_path)).select("Species_IDs").distinct().collect()] == ["1-O"]
    assert {(r["LocalityID"], r["SWEREF_N"], r["Species_IDs"]) for r in queries.red_lists(spark, str(tmp_path)).collect()} == {(f"loc_{100 * i}", 6500000, "1-O") for i in range(5)}
    assert [r["red_finds"] for r in queries.assoc_threshold(spark, str(tmp_path)).collect()] == ["1-O"]
    out = associates.run(spark, associates.Config(f"{tmp_path}/customer.parquet", f"{tmp_path}/orders.parquet", f"{tmp_path}/out"))
    assert {(r["report"], r["n_pairs"], r["n_sites"], r["n_points"]) for r in out.collect()} == {("associates", n * n, n, None), ("totals", n * n, n, None), ("month", None, None, n)}


def test_places_that_are_not_broadcast_give_the_same_counts(spark):
    rng = np.random.default_rng(5)
    sites = spark.createDataFrame([(f"s{i % 3}", *map(float, rng.integers(0, 30, 2) * 10)) for i in range(200)] + [("s0", None, 1.0)], "sci string, e double, n double")
    points = spark.createDataFrame([(f"t{i % 4}", *map(float, rng.integers(0, 30, 2) * 10)) for i in range(300)] + [("t0", 1.0, None)], "tid string, e double, n double")
    want = sorted(tuple(r) for r in spatial.distance_join(sites, points, 50.0).groupBy("sci", "tid").agg(F.count("*")).collect())
    for rows in (20_000, 3):
        assert sorted(tuple(r) for r in spatial.pair_counts(sites, points, 50.0, ["sci"], ["tid"], broadcast_rows=rows).collect()) == want
