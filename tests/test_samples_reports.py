"""Draws with replacement, effort strata, the edge cut, reports, folders of taxa and counts of what was left out."""

import warnings

import pytest
from pyspark.sql import functions as F

from terrane.operators import graph, sampling, stats
from terrane.plans import config, stages
from terrane.sources import reports, writers


def test_draws_with_replacement_follow_the_weights(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, 0.0), ("a", 4, None), ("b", 5, 0.0), ("b", 6, -1.0), (None, 7, 2.0)], "g string, k int, w double")
    got = sampling.draw(df, ["g"], 4000, 7, ["k"], weight="w", replace=True)
    assert got.columns == df.columns
    counts = {(r["g"], r["k"]): r["count"] for r in got.groupBy("g", "k").count().collect()}
    assert set(counts) == {("a", 1), ("a", 2), ("b", 5), ("b", 6), (None, 7)} and counts[None, 7] == 4000
    assert counts["a", 1] + counts["a", 2] == 4000 and abs(counts["a", 2] / 4000 - 0.75) < 0.03
    assert counts["b", 5] + counts["b", 6] == 4000 and abs(counts["b", 5] / 4000 - 0.5) < 0.03
    again = sampling.draw(df.repartition(5), ["g"], 4000, 7, ["k"], weight="w", replace=True)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    assert sampling.draw(df, ["g"], 0, 7, ["k"], replace=True).count() == 0
    assert sampling.draw(df.filter("false"), ["g"], 5, 7, ["k"], replace=True).count() == 0


def test_effort_strata_share_a_band(spark):
    rows = [("t", f"LAT{b}", s, 100 * b + i) for b in (1, 2) for s, n in (("low", 30), ("high", 30), (None, 2)) for i in range(n)]
    rows = [(t, b, s, 1000 * (s is None) + 500 * (s == "high") + k) for t, b, s, k in rows]
    df = spark.createDataFrame(rows, "sci string, latband string, effort string, k int")
    out = sampling.stratified_sample(df, "sci", "latband", 11, 1, ["k"], strict_equal=False, effort="effort")
    counts = {(r["latband"], r["effort"]): r["count"] for r in out.groupBy("latband", "effort").count().collect()}
    for band in ("LAT1", "LAT2"):
        # 11 over three strata: two of them get 4; the smallest has only 2 rows
        assert counts[band, None] == 2 and sorted((counts[band, "low"], counts[band, "high"])) in ([3, 4], [4, 4])
    again = sampling.stratified_sample(df, "sci", "latband", 11, 1, ["k"], strict_equal=False, effort="effort", replace=True)
    assert {r["latband"]: r["count"] for r in again.groupBy("latband").count().collect()} == {"LAT1": 11, "LAT2": 11}
    assert out.columns == df.columns and again.columns == df.columns


def test_strongest_entries_are_cut_before_they_are_made_symmetric(spark):
    pairs = [(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7), (4, 5, 0.6)]
    edges = spark.createDataFrame([(1, 1, 1.0)] + [e for a, b, w in pairs for e in ((a, b, w), (b, a, w))], "src int, dst int, w double")
    cut = lambda n, least=0.0: sorted(tuple(r) for r in graph.strongest_edges(edges, n, least).collect())
    # a loop and both directions of two pairs, then one direction of the third
    assert cut(5) == [(1, 2, 0.9), (2, 3, 0.8)] and cut(6) == [(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7)]
    assert cut(100) == [tuple(p) for p in pairs] and cut(100, 0.75) == [(1, 2, 0.9), (2, 3, 0.8)]


def test_taxa_with_like_names_have_folders_of_their_own(spark, tmp_path):
    df = spark.createDataFrame([("Abies alba", 2), ("Abies alba", 1), ("Abies?alba", 3), ("Abies alba!", 4), ("Abiesalba", 5), (None, 6)], "sci string, k int")
    names = {r["sci"]: r["taxon"] for r in writers.taxon_folders(df).collect()}
    assert len(set(names.values())) == 5 and names[None] == "unknown"
    assert {names["Abies alba"], names["Abies alba!"]} == {"Abies_alba", "Abies_alba__001"}
    writers.write_taxa({"one": df, "two": df.filter("k > 3")}, str(tmp_path / "out"), order={"one": ["k"]})
    back = spark.read.csv(str(tmp_path / "out" / "one"), sep="\t", header=True, inferSchema=True)
    assert sorted((r["sci"] or "", r["k"], r["taxon"]) for r in back.collect()) == sorted((s or "", k, names[s]) for s, k in [("Abies alba", 2), ("Abies alba", 1), ("Abies?alba", 3), ("Abies alba!", 4), ("Abiesalba", 5), (None, 6)])
    assert (tmp_path / "out" / "two" / f"taxon={names['Abiesalba']}").exists() and not (tmp_path / "out" / "two" / f"taxon={names['Abies?alba']}").exists()


def test_the_matrix_of_separation_is_symmetric(spark):
    s = spark.createDataFrame([(0, 1, 3, 0.5), (0, 2, 3, 0.7), (1, 2, 3, 0.9)], "ci long, cj long, n long, mean double")
    got = sorted(tuple(r) for r in stats.separation_matrix(s).collect())
    assert got == [(0, None, 0.5, 0.7), (1, 0.5, None, 0.9), (2, 0.7, 0.9, None)]


def test_reports_hold_every_table(spark, tmp_path, capsys):
    v = spark.createDataFrame([(i, i % 2, [float(i % 2) * 3 + i / 100, float(i)]) for i in range(12)], "id long, cluster long, v array<double>")
    found = stages.evaluation(v, config.Evaluation(permutations=9))
    text = reports.evaluation_report(found)
    for title in ("Distances to the centroid within clusters", "Mean distances between clusters", "Silhouette, overall", "Silhouette by cluster", "Variance explained by clusters", "Permutation test"):
        assert title in text
    mean = found["separation"].first()["mean"]
    assert text.count(f"{mean:.5f}") >= 3  # twice in the matrix, once in detail
    reports.write_report(text, str(tmp_path / "report.txt"))
    assert (tmp_path / "report.txt").read_text() == text and text in capsys.readouterr().out
    f = spark.createDataFrame([(i, f"s{j}", 0.5) for i in range(6) for j in range(4) if (i + j) % 3], "cell_id long, species_id string, value double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "cell_id long, cluster long")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        eight = stages.diversity(f, labels)
    assert any("without a label" in str(w.message) for w in said)
    text = reports.community_report(f, labels, eight)
    assert "Cells: 6" in text and "Species: 4" in text and "Clusters: 0, 1" in text and "Dissimilarity within clusters" in text
    runs = spark.createDataFrame([(0, 5, 0.9, 3), (1, 4, 0.5, 2), (2, 4, 0.7, 1)], "run int, k int, quality double, min_size int")
    text = reports.clustering_report(runs, {"run": 2, "k": 4}, spark.createDataFrame([(1, 0), (2, 1)], "node long, label long"), config.Clusters())
    assert "resolution 0.36461, 4 communities" in text and "Clusters in the end: 2" in text and "0.330950" in text


def test_tables_of_clusters_join_on_the_first(spark):
    a, b, c = (spark.createDataFrame(rows, f"cluster int, {n} int") for n, rows in (("x", [(0, 1), (1, 2)]), ("y", [(0, 5), (2, 6)]), ("z", [(1, 7)])))
    assert sorted(tuple(r) for r in stats.cluster_table(a, b, c).collect()) == [(0, 1, 5, None), (1, 2, None, 7)]


def test_consolidation_counts_what_it_removes(spark):
    lists = spark.createDataFrame([("f", 1, "a", None, 1.0, 1.0, "1 2 3"), ("f", 2, "b", "LAT1", 2.0, 2.0, "2 2"), ("f", 3, " ", None, None, None, "4"), ("f", 4, "c", None, None, None, None)], "file string, row long, locality_id string, latband string, n double, e double, species_ids string")
    out = stages.consolidate(lists, spark.createDataFrame([("2",)], "id string"), spark.createDataFrame([], "species_id string, name string, rank long"))
    assert tuple(out["removed"].first()) == (4, 5, 3)
    assert sorted(tuple(r) for r in out["presence"].collect()) == [("a", "1"), ("a", "3")]


@pytest.mark.parametrize("z", [0.0, 0.3, 1.96, 5.0, 12.0, 36.0, 40.0, None])
def test_normal_tail(spark, z):
    import math

    from terrane.functions import expr

    got = spark.range(1).select(expr.normal_tail(F.lit(z).cast("double")).alias("p")).first()["p"]
    assert got is None if z is None else abs(got - math.erfc(z / math.sqrt(2))) <= 1e-11 * math.erfc(z / math.sqrt(2)) + 1e-300
