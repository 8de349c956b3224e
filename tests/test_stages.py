"""The stages from occurrences to a drawn network, on a small made-up survey."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.plans import config, stages
from terrane.sources import readers, writers


@pytest.fixture(scope="module")
def survey(spark):
    """A focal plant at 60 sites, each with associates within some metres, in two regions with different floras."""
    rng = np.random.default_rng(8)
    rows = []
    for site in range(60):
        lat, lon = 56 + site * 0.2, 12.0 + (site % 7) * 0.5
        rows.append((lon, lat, "u:Taxon:1", "Focal one", f"L{site}"))
        for tid in rng.choice(np.arange(2, 9) if site < 30 else np.arange(6, 13), 5, replace=False):
            rows.append((lon + 0.0001, lat + 0.0001, f"u:Taxon:{tid}", f"Plant {tid}", f"L{site}"))
    rows += [(12.0, 40.0, "u:Taxon:2", "Plant 2", "far"), (None, 56.0, "u:Taxon:2", "Plant 2", "none"), (12.0, 56.0, "x3", "Plant 3", "loose"), (12.0, 56.0, "u:Taxon:99", "Animal", "no plant")]
    data = [(None if a is None else str(a), str(b), t, n, None, "2020", loc, None) for a, b, t, n, loc in rows]
    plants = spark.createDataFrame([(str(i),) for i in range(1, 40)], "id string")
    red = spark.createDataFrame([("3",), ("7",), ("11",)], "id string")
    return spark.createDataFrame(data, readers.OCCURRENCE), red, plants


def test_associates_and_consolidation(spark, survey, tmp_path):
    out = stages.associates(*survey, config.Associates(least_pairs=5, focal_ids=("1",)))
    hits = out["hits"].collect()
    assert hits and {r["tid"] for r in hits} <= {str(i) for i in range(2, 13)} and all(r["d2"] <= 2500 for r in hits)
    lists = out["site_lists"].collect()
    assert len(lists) == 60 and all(r["Species_IDs"] for r in lists)
    totals = out["totals"].first()
    assert (totals["sci"], totals["n_focal"]) == ("Focal one", 60) and totals["n_red"] == len(out["red_finds"].first()["finds"].split())
    assert out["all_observations"].count() == sum(r["n"] for r in out["counts"].collect())
    writers.write_tsv(out["site_lists"].drop("sci", "fid"), str(tmp_path / "focal" / "Sites"))
    sites = readers.locality_lists(spark, str(tmp_path / "focal" / "Sites" / "*.csv"))
    exclude = spark.createDataFrame([("12",)], "id string")
    names = spark.createDataFrame([("2", "two", 0)], "species_id string, name string, rank int")
    two = stages.consolidate(sites, exclude, names)
    species = {r["species_id"]: r["species"] for r in two["species"].collect()}
    assert "12" not in species and species["2"] == "two" and species["3"] == "3"
    assert two["localities"].count() == 60


def test_features_to_network(spark):
    rng = np.random.default_rng(2)
    pres, locs = [], []
    for i in range(80):
        locs.append((f"l{i}", float(i % 10 * 10_000 + 5), float(i // 10 * 10_000 + 5)))
        pool = np.arange(0, 12) if i < 40 else np.arange(8, 20)
        pres += [(f"l{i}", f"s{s}") for s in rng.choice(pool, 7, replace=False)]
    presence, localities = spark.createDataFrame(pres, "locality_id string, species_id string"), spark.createDataFrame(locs, "locality_id string, e double, n double")
    three = stages.features(presence, localities)
    knn = stages.cell_neighbours(three["features"])
    assert knn.groupBy("src").count().filter("count <> 15").count() == 0 and knn.filter("src = dst AND d = 0").count() == 80
    four = stages.clusters(knn, c=config.Clusters(resolutions=(0.5, 1.0), target=2, least_size=10))
    labels = four["labels"].select(F.col("node").alias("cell_id"), F.col("label").alias("cluster")).persist()
    assert labels.select("cluster").distinct().count() >= 2
    assert stages.region_map(three["cells"], labels, 10_000.0).count() == 80
    six = stages.markers(three["features"], labels)
    assert six.count() > 0 and six.filter("q > 0.05 OR delta <= 0").count() == 0
    eight = stages.diversity(three["features"], labels, six)
    assert abs(eight["lcbd"].agg(F.sum("lcbd").alias("s")).first()["s"] - 1) < 1e-9
    beta = eight["beta"].first()
    assert abs(beta["beta_sor_mean"] - beta["beta_turnover_mean"] - beta["beta_nestedness_mean"]) < 1e-9
    index = {f"s{k}": k for k in range(20)}
    dense = three["features"].groupBy("cell_id").agg(F.collect_list(F.struct("species_id", "value")).alias("x")).collect()
    of = {r["cell_id"]: r["cluster"] for r in labels.collect()}
    rows = []
    for i, r in enumerate(dense):
        v = [0.0] * 20
        for s in r["x"]:
            v[index[s["species_id"]]] = s["value"]
        rows.append((i, of[r["cell_id"]], v))
    seven = stages.evaluation(spark.createDataFrame(rows, "id long, cluster long, v array<double>"), config.Evaluation(permutations=49))
    assert seven["permanova_test"].first()["p"] == pytest.approx(0.02)
    assert seven["silhouettes"].filter("s < -1 OR s > 1").count() == 0
    nine = stages.network(four["similarity"], labels.toDF("node", "label"), 300, 20)
    assert nine["nodes"].filter("x < 0 OR x > 1 OR y < 0 OR y > 1").count() == 0 and nine["edges"].count() <= 300


@pytest.mark.parametrize("partitions", [2, 16])
def test_same_results_for_any_partitioning(spark, survey, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        occ, red, plants = survey
        out = stages.associates(occ.repartition(partitions), red, plants, config.Associates(least_pairs=5, focal_ids=("1",)))
        got = sorted(tuple(r) for r in out["site_lists"].collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = sorted(tuple(r) for r in stages.associates(*survey, config.Associates(least_pairs=5, focal_ids=("1",)))["site_lists"].collect())
    assert got == want
