"""Queries cover their whole tables: against the SQL without its modulo filters, and by counts."""

import itertools

import numpy as np
import pytest

from terrane.operators import graph, stats
from terrane.plans import bridge, queries, registry

from .test_oracle import SF, _rows, duck  # noqa: F401

SEVENTH = " WHERE l_partkey % 7 = 0"
LIMITS = {"marker_topn": ("<= 12", "<= 40"), "strip_values": ("<= 3", "<= 12")}
TENTH = " WHERE c_custkey % 10 = 0"


def _same(spark, duck, name, cut):  # noqa: F811
    got = registry.queries()[name](spark, SF)
    cursor = duck.execute(registry.oracle_sql()[name].replace(cut, "").replace(*LIMITS.get(name, (cut, ""))))
    columns = [c[0] for c in cursor.description]
    have, want = _rows(tuple(r[c] for c in columns) for r in got.collect()), _rows(cursor.fetchall())
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert all(abs(x - y) <= 2e-5 if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b)), (a, b)


def test_community_counts_every_line(spark):
    assert bridge.community(spark, SF).agg({"count": "sum"}).first()[0] == bridge.table(spark, SF, "lineitem").count()


@pytest.mark.parametrize("name", "pair_distances cluster_centroids marker_means marker_cohen_d marker_mwu bh_fdr marker_topn volcano dispersion lcbd lcbd_summary indval_summary sorensen strip_values lcbd_boxes radar".split())
def test_community_queries_cover_lineitem(spark, duck, name):  # noqa: F811
    _same(spark, duck, name, SEVENTH)


def test_every_customer_is_a_site(spark):
    assert bridge.sites(spark, SF).count() == bridge.table(spark, SF, "customer").count()


@pytest.mark.parametrize("name", "radius_join radius_counts assoc_threshold target_totals all_observations site_species_sets red_per_locality red_lists".split())
def test_distance_queries_cover_customers(spark, duck, name):  # noqa: F811
    _same(spark, duck, name, TENTH)


def test_permutations_have_no_most_rows(spark):
    rng = np.random.default_rng(6)
    x, c = rng.normal(size=(21_000, 2)), rng.integers(0, 3, 21_000)
    v = spark.createDataFrame([(i, int(c[i]), x[i].tolist()) for i in range(len(x))], "id long, cluster long, v array<double>")
    t, p = stats.permanova_test(v, 199).first(), stats.permanova(v).first()
    x = x - x.mean(0)
    between = [sum((x[o == g].sum(0) ** 2).sum() / (o == g).sum() for g in range(3)) for o in [c, *(rng.permutation(c) for _ in range(1999))]]
    want = np.mean(np.array(between) >= between[0])
    assert t["permutations"] == 199 and abs(t["f"] - p["f"]) < 1e-9 and abs(t["p"] - want) < 4 * (want * (1 - want) / 199) ** 0.5


def test_permutation_p_against_all_permutations(spark):
    x, c = np.array([[0.0, 1], [1, 0], [2, 5], [9, 1], [3, 3], [4, 9], [7, 7]]), np.array([0, 0, 0, 1, 1, 2, 2])
    v = spark.createDataFrame([(i, int(c[i]), x[i].tolist()) for i in range(len(x))], "id long, cluster long, v array<double>")

    def ssw(c):
        return sum(((x[c == g] - x[c == g].mean(0)) ** 2).sum() for g in range(3))

    every = [ssw(np.array(p)) for p in set(itertools.permutations(c.tolist()))]
    want = np.mean([s <= ssw(c) + 1e-9 for s in every])
    for block in (100, 2):
        got = stats.permanova_test(v, 1999, block=block).first()["p"]
        assert abs(got - want) < 4 * (want * (1 - want) / 1999) ** 0.5 + 1 / 1999


def test_block_counts_add_up_to_the_labels():
    sizes, m = np.array([3, 0, 5, 4, 1]), np.array([6, 5, 2])
    held = np.array([stats._block_counts(lambda low, high: np.random.default_rng((1, low, high)), m, sizes, b) for b in range(5)])
    assert (held.sum(0) == m).all() and (held.sum(1) == sizes).all()


def test_registered_permutations_are_the_references(spark):
    assert registry.queries()["permanova_p"](spark, SF).first()["permutations"] == 999


def test_layout_has_nodes_without_edges(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5)], "src long, dst long, w double")
    got = {r["node"]: (r["x"], r["y"]) for r in graph.layout(edges, 50, nodes=spark.range(1, 7).toDF("node")).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and all(0 <= z <= 1 for p in got.values() for z in p)
    assert np.hypot(*np.subtract(got[1], got[2])) < min(np.hypot(*np.subtract(got[1], got[k])) for k in (4, 5, 6))
    assert graph.layout(edges.limit(0), 5, nodes=spark.range(2).toDF("node")).count() == 2


def test_registered_layout_draws_the_references_graph(spark, monkeypatch):
    seen, keep, solve = {}, graph.strongest_edges, graph.layout
    monkeypatch.setattr(graph, "strongest_edges", lambda e, most: seen.update(most=most) or keep(e, 100))
    monkeypatch.setattr(graph, "layout", lambda e, rounds, nodes: seen.update(rounds=rounds) or solve(e, 5, nodes=nodes))
    assert registry.queries()["layout"](spark, SF).count() == bridge.table(spark, SF, "embeddings").count()
    assert seen == {"most": 100_000, "rounds": 500}


def test_feature_limits_are_the_references(spark):
    count = lambda name, by: [r["count"] for r in registry.queries()[name](spark, "/root/testdata/sf0.01").groupBy(*by).count().collect()]
    assert max(count("marker_topn", ["cluster"])) == 40 and {r for r in count("strip_values", ["cluster", "cell_id"])} == {12}
    assert max(count("stratified_sample", ["sci"])) > 100 and 12 < max(count("stratified_sample", ["sci", "latband"])) <= 40


def test_exact_mann_whitney_of_few_cells_without_ties(spark):
    x, own = np.random.default_rng(3).permutation(12) + 1.0, 4
    f = spark.createDataFrame([(i, "s", float(v)) for i, v in enumerate(x)], "cell_id long, species_id string, value double")
    labels = spark.createDataFrame([(i, int(i >= own)) for i in range(12)], "cell_id long, cluster long")
    every = [sum(x[i] > x[j] for i in some for j in set(range(12)) - set(some)) for some in itertools.combinations(range(12), own)]
    u = every[0]
    want = min(1.0, 2 * min(np.mean([v <= u for v in every]), np.mean([v >= u for v in every])))
    got = stats.mann_whitney(f, labels, method="auto").collect()
    assert len(got) == 2 and all(abs(r["p"] - want) < 1e-12 for r in got)
    scanned = stats.scan_markers(f, labels, q_most=1.0).collect()
    assert len(scanned) == 1 and abs(scanned[0]["p"] - want / 2) < 1e-12
    assert "p" not in stats.mann_whitney(f, labels).columns


def test_first_row_of_ties_is_the_same_in_any_order(spark, tmp_path):
    rows = [(1, s, 5, 2, f) for s in (9, 3, 7) for f in "RA"] + [(1, 1, None, 1, "A"), (1, 2, 5, None, "A")]
    for name, some in (("a", rows), ("b", rows[::-1])):
        spark.createDataFrame(some, "l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        assert [tuple(r) for r in queries.dedup_first(spark, f"{tmp_path}/{name}").collect()] == [(1, 3, 5, 2, "A")]


def test_presence_is_made_distinct_on_numbers(spark):
    plan = bridge.presence(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "keys=[o_custkey" in plan and "keys=[locality_id" not in plan


def test_pushes_of_tiles_are_those_of_all_pairs():
    pos = np.random.default_rng(8).random((150, 2))
    pos[7] = pos[90]
    gap = pos[:, None] - pos[None]
    want = (gap * (0.04 / np.maximum((gap**2).sum(2), 1e-9))[..., None]).sum(1)
    for tile in (16, 50, 64, 256):
        assert np.allclose(graph._pushes(pos, 0.2, tile), want, rtol=1e-9, atol=1e-9)
