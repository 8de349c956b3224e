"""Hand-sized inputs with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import expr
from terrane.operators import community, graph, sampling, spatial, stats

ROWS = [("a", "x", 4.0), ("b", "y", 1.0), ("b", "z", 3.0), ("c", "x", 2.0), ("c", "y", 2.0)]
POINTS = [(1, 0, [0.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 1, [4.0, 0.0]), (4, 1, [4.0, 2.0]), (5, 1, [5.0, 1.0])]
VEC = "id long, cluster long, v array<double>"


@pytest.fixture(scope="module")
def features(spark):
    return community.hellinger(spark.createDataFrame(ROWS, "cell_id string, species_id string, count double"))


def test_hellinger(features):
    got = {(r["cell_id"], r["species_id"]): round(r["value"], 6) for r in features.collect()}
    assert got == {("a", "x"): 1.0, ("b", "y"): 0.5, ("b", "z"): 0.866025, ("c", "x"): 0.707107, ("c", "y"): 0.707107}
    norm = features.groupBy("cell_id").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-12 for r in norm)


def test_distances(features):
    d = {(r["i"], r["j"]): round(r["d"], 6) for r in community.pair_dots(features).select("i", "j", community.unit_distance(F.col("dot")).alias("d")).collect()}
    assert d == {("a", "c"): 0.765367, ("b", "c"): 1.137055}


def test_lcbd(features):
    got = {r["cell_id"]: round(r["lcbd"], 6) for r in stats.lcbd(features).collect()}
    assert got == {"a": 0.333333, "b": 0.515639, "c": 0.151027}


def test_adaptive_kernel_and_two_hops(spark):
    edges = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (1, 1, 0.0), (1, 0, 1.0), (2, 2, 0.0), (2, 1, 2.0)], "src long, dst long, d double")
    got = {(r["src"], r["dst"]): round(r["w"], 6) for r in graph.similarity(edges).collect()}
    want = {(0, 1): 0.14075, (0, 2): 0.00005, (1, 2): 0.019049}
    for (i, j), w in want.items():
        assert abs(got[i, j] - w) < 2e-5 and got[i, j] == got[j, i]
    assert all(abs(got[i, i] - 1.000001) < 1e-6 for i in range(3))


def test_benjamini_hochberg(spark):
    def q(ps):
        df = spark.createDataFrame([(0, i, float(p)) for i, p in enumerate(ps)], "g int, i int, p double")
        return [round(r["q"], 9) for r in stats.benjamini_hochberg(df, "g").orderBy("i").collect()]

    assert q([0.01, 0.04, 0.03, 0.005, 0.5]) == [0.025, 0.05, 0.05, 0.025, 0.5]
    assert q([0.02, 0.02, 0.9]) == [0.03, 0.03, 0.9]


def test_sorensen_parts(spark):
    df = spark.createDataFrame([(2, 1, 3), (3, 0, 2), (0, 1, 1), (0, 0, 0)], "a int, b int, c int")
    got = [tuple(round(x, 6) for x in r) for r in df.select(*expr.sorensen(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [(0.5, 0.333333, 0.166667), (0.25, 0.0, 0.25), (1.0, 1.0, 0.0), (0.0, 0.0, 0.0)]


def test_bands(spark):
    lats = [55, 56, 56, 56, 57, 58, 60, 61, 63, 65, 69]
    df = spark.createDataFrame([("t", i, float(x)) for i, x in enumerate(lats)] + [("one", 1, 60.0), ("one", 2, 60.0), ("none", 1, None), (None, 1, 50.0)], "sci string, i int, lat double")
    out = sampling.latitude_bands(df, "sci", "lat")
    assert [r["band"] for r in out.filter("sci = 't'").orderBy("i").collect()] == [0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7]
    assert {r["latband"] for r in out.filter("sci = 'one'").collect()} == {"LAT1"}
    assert out.filter("sci = 'none' AND band IS NULL").count() == 1 and out.filter("sci IS NULL AND band = 0").count() == 1


def test_silhouette_permanova_separation(spark):
    v = spark.createDataFrame(POINTS, VEC)
    for block in (1024, 2):
        sums = stats.label_sums(v, block)
        s = [round(r["s"], 6) for r in stats.silhouettes(sums).orderBy("id").collect()]
        assert s == [0.778943, 0.77352, 0.579691, 0.602779, 0.719931]
        r = stats.separation(sums).first()
        assert (round(r["mean"], 6), round(r["sd"], 6), r["n"]) == (4.469561, 0.477104, 6)
    p = stats.permanova(v).first()
    assert (round(p["sst"], 9), round(p["ssw"], 6), round(p["f"], 6), round(p["r2"], 6)) == (26.0, 3.166667, 21.631579, 0.878205)
    r2 = spark.range(1).select(expr.r_squared(F.lit(p["f"]), F.lit(2), F.lit(5)).alias("r")).first()["r"]
    assert abs(r2 - p["r2"]) < 1e-12
    t = stats.permanova_test(v, 99).first()
    assert t["permutations"] == 99 and 0.01 <= t["p"] <= 0.3 and abs(t["f"] - p["f"]) < 1e-9


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(55.0, 14.25), (57.0, 12.75), (59.3293, 18.0686), (69.0, 21.0)], "lat double, lon double")
    n, e = expr.project(F.col("lat"), F.col("lon"))
    got = df.withColumns({"n": n, "e": e})
    want = [(6095048.642, 452024.069), (6319636.937, 363331.554), (6580743.008, 674571.866), (7666089.698, 739639.195)]
    assert [(round(r["n"], 3), round(r["e"], 3)) for r in got.collect()] == want
    lat, lon = expr.unproject(F.col("n"), F.col("e"))
    for r in got.select("lat", "lon", lat.alias("a"), lon.alias("b")).collect():
        assert abs(r["lat"] - r["a"]) < 1e-9 and abs(r["lon"] - r["b"]) < 1e-9


def test_weighted_locality_median(spark):
    rows = [("f1", 1, "L", str(s), None, 10.0, 1.0) for s in (1, 2, 3)] + [("f1", 2, "L", "4", "LAT2", 10.0, 1.0), ("f2", 1, "L", "1", "LAT3", 99.0, 1.0)]
    r = community.locality_summary(spark.createDataFrame(rows, "file string, row long, locality_id string, species_id string, latband string, n double, e double")).first()
    assert (r["latband"], r["n"], r["e"]) == ("NA", 10.0, 1.0)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(expr.half_even(F.lit(x))) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert [one(expr.canonical_id(F.lit(x))) for x in ("007", " 5 ")] == ["7", "5"]
    with pytest.raises(Exception):
        one(expr.canonical_id(F.lit("12.0")))
    assert one(expr.taxon_number(F.lit("x12"))) == "12" and one(expr.taxon_number(F.lit("x12"), True)) is None and one(expr.taxon_number(F.lit("a:Taxon:7"), True)) == "7"
    assert one(expr.file_name(F.lit(" a b/ćÅ\t"))) == "a_bÅ" or one(expr.file_name(F.lit(" a b/cÅ\t"))) == "a_bcÅ"
    assert one(expr.file_name(F.lit(None).cast("string"))) == "unknown"
    assert one(expr.split_ids(F.lit("  "))) == [] and one(expr.join_ids(F.array(F.lit("9"), F.lit("10")))) == "10 9"
    assert one(expr.cell_name(expr.grid_index(F.lit(float("nan")), 10), expr.grid_index(F.lit(25.0), 10))) == "gx-1_gy2"
    assert abs(one(expr.normal_tail(F.lit(1.96))) - 0.04999579) < 1e-6
    assert one(expr.volcano(F.lit(0.0))) == 300
    with pytest.raises(ValueError):
        expr.kernel(F.lit(1.0), "other")


def test_distance_join_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    s = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-300, 300, (80, 2)))] + [(99, None, 1.0)]
    p = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-300, 300, (400, 2)))] + [(999, 1.0, None)]
    out = spatial.distance_join(spark.createDataFrame(s, "fid long, e double, n double"), spark.createDataFrame(p, "pid long, e double, n double"), 50.0)
    got = sorted((r["fid"], r["pid"]) for r in out.collect())
    want = sorted((i, j) for i, a, b in s[:-1] for j, c, d in p[:-1] if (a - c) ** 2 + (b - d) ** 2 <= 2500)
    assert got == want and any((a - c) ** 2 + (b - d) ** 2 == 2500 for _, a, b in s[:-1] for _, c, d in p[:-1])


def test_mann_whitney_against_ranks(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (30, 6)) * (rng.random((30, 6)) < 0.6)
    labels = [(i, i % 3) for i in range(30)]
    f = spark.createDataFrame([(i, f"s{j}", float(x[i, j])) for i in range(30) for j in range(6) if x[i, j]], "cell_id long, species_id string, value double")
    for r in stats.mann_whitney(f, spark.createDataFrame(labels, "cell_id long, cluster long")).collect():
        col, own = x[:, int(r["species_id"][1:])], np.array([c == r["cluster"] for _, c in labels])
        u = sum((a > b) + 0.5 * (a == b) for a in col[own] for b in col[~own])
        ties = sum(t**3 - t for t in np.unique(col, return_counts=True)[1].astype(float))
        sd = math.sqrt(own.sum() * (~own).sum() / 12 * (31 - ties / (30 * 29)))
        gap = u - own.sum() * (~own).sum() / 2
        assert abs(r["u"] - u) < 1e-9 and abs(r["z"] - np.sign(gap) * max(abs(gap) - 0.5, 0) / sd) < 1e-9


def test_communities_find_planted_groups(spark):
    rng = np.random.default_rng(5)
    edges = {}
    for i in range(60):
        for j in range(i):
            if rng.random() < (0.6 if i % 3 == j % 3 else 0.02):
                edges[i, j] = edges[j, i] = 1.0
    df = spark.createDataFrame([(i, j, w) for (i, j), w in edges.items()], "src long, dst long, w double")
    for refine in (True, False):
        runs = [{r["node"]: r["label"] for r in graph.communities(df, [1.0], refine=refine).collect()} for _ in range(2)]
        assert runs[0] == runs[1] and len(set(runs[0].values())) == 3
        assert all(runs[0][i] == runs[0][i % 3] for i in range(60))
    labels = spark.createDataFrame(list(runs[0].items()), "node long, label long")
    assert graph.modularity(df, labels).first()["quality"] > 0.5


def test_merges(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 0.2), (3, 2, 0.2), (3, 4, 0.9), (4, 3, 0.9), (5, 6, 1.0), (6, 5, 1.0)], "src long, dst long, w double")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2), (5, 3), (6, 3)], "node long, label long")
    got = {r["node"]: r["label"] for r in graph.merge_small(edges, labels, 2).collect()}
    # 3 joins 4; 4's cluster began small, so it goes on to 1 and 2 though it has grown
    assert got[1] == got[2] == got[3] == got[4] and got[5] == got[6] and len(set(got.values())) == 2
    v = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate([0, 1, 10, 11, 50])], "id long, v array<double>")
    l = spark.createDataFrame([(i, i) for i in range(5)], "node long, label long")
    got = {r["node"]: r["label"] for r in graph.greedy_merge(v, l, 2).collect()}
    assert got[0] == got[1] == got[2] == got[3] != got[4]
    runs = spark.createDataFrame([(0, 5, 0.9, 3), (1, 4, 0.5, 2), (2, 4, 0.7, 1)], "run int, k int, quality double, min_size int")
    assert graph.pick_run(runs, 4).first()["run"] == 2


def test_samples(spark):
    df = spark.createDataFrame([("t", f"LAT{i % 3}", i, float(i % 5 - 1)) for i in range(90)], "sci string, latband string, k int, w double")
    a, b = (sorted(r["k"] for r in sampling.stratified_sample(df.repartition(n), "sci", "latband", 7, 42, ["k"]).collect()) for n in (2, 9))
    assert a == b and len(a) == 21
    drawn = sampling.draw(df, ["sci"], 200, 1, ["k"], weight="w").collect()
    assert len(drawn) == 54 and all(r["w"] > 0 for r in drawn)
    assert sampling.draw(df.withColumn("w", F.lit(0.0)), ["sci"], 200, 1, ["k"], weight="w").count() == 90
    assert sampling.stratified_sample(df, "sci", "latband", 7, 42, ["k"], cap=10).count() == 10


def test_distances_of_all_pairs(features):
    for block in (1024, 1):
        d = {(r["i"], r["j"]): round(r["d"], 6) for r in community.pair_distances(features, block=block).collect()}
        assert d == {("a", "b"): 1.414214, ("a", "c"): 0.765367, ("b", "c"): 1.137055}


def test_drawn_pairs_are_different_and_as_many_as_asked_for(spark):
    groups = spark.createDataFrame([(0, 1), (1, 2), (2, 7), (3, 40), (4, 300_000)], "cluster int, m long")
    got = stats.draw_pairs(groups, 50, 1).collect()
    assert len({tuple(r) for r in got}) == len(got) and all(0 <= r["low"] < r["high"] < {1: 2, 2: 7, 3: 40, 4: 300_000}[r["cluster"]] for r in got)
    assert {c: sum(r["cluster"] == c for r in got) for c in range(5)} == {0: 0, 1: 1, 2: 21, 3: 50, 4: 50}
    assert stats.draw_pairs(groups, 50, 1).collect() != stats.draw_pairs(groups, 50, 2).collect()


def test_drawn_dissimilarities_are_those_of_the_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    presence = spark.createDataFrame([(c, f"s{s}") for c in range(40) for s in rng.choice(30, rng.integers(1, 9), replace=False)], "cell_id long, species_id string")
    labels = spark.range(40).select(F.col("id").alias("cell_id"), (F.col("id") % 2).alias("cluster"))
    every = {tuple(r)[:3]: tuple(r)[3:] for r in stats.sorensen_pairs(presence, labels).collect()}
    some = {tuple(r)[:3]: tuple(r)[3:] for r in stats.sorensen_pairs(presence, labels, most=30).collect()}
    assert len(some) == 60 and len(every) == 2 * 190 and all(every[k] == v for k, v in some.items())


def test_distances_to_centres(spark):
    v = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, [6.0, 8.0]), (3, 1, [1.0, 1.0])], "id long, cluster long, v array<double>")
    assert {r["id"]: r["d"] for r in stats.centre_distances(v).collect()} == {1: 5.0, 2: 5.0, 3: 0.0}
