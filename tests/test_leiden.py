"""Communities by table rounds: connected, as good as a plain loop, the same for any partitioning, awkward graphs."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import graph, leiden
from terrane.plans import bridge
from terrane.scratch import materialise

from .plain_louvain import louvain

EDGES = "src long, dst long, w double"


@pytest.fixture(scope="module")
def embedded(spark):
    near = graph.neighbours(bridge.vectors(spark, "/root/testdata/sf0.001").select("id", "v"), 15, digits=6)
    return materialise(graph.similarity(near, "adaptive"), "test-graph")


def pieces(edges, label):
    """Communities with more than one connected piece."""
    near = defaultdict(set)
    for r in edges:
        if r["w"] > 0 and label[r["src"]] == label[r["dst"]]:
            near[r["src"]].add(r["dst"])
    seen, found = set(), defaultdict(int)
    for start in label:
        if start in seen:
            continue
        found[label[start]] += 1
        todo = [start]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near[n]
    return {c for c, n in found.items() if n > 1}


def test_as_good_as_a_plain_loop_and_connected(spark, embedded):
    edges = embedded.collect()
    nodes = sorted({r["src"] for r in edges})
    at = {n: i for i, n in enumerate(nodes)}
    src, dst, w = (np.array([f(r) for r in edges]) for f in (lambda r: at[r["src"]], lambda r: at[r["dst"]], lambda r: r["w"]))
    gammas = [0.33095, 1.0]
    got = graph.communities(embedded, gammas)
    assert {(r["run"], r["resolution"]) for r in got.select("run", "resolution").distinct().collect()} == {(0, 0.33095), (1, 1.0)}
    for run, gamma in enumerate(gammas):
        own = got.filter(F.col("run") == run).select("node", "label")
        label = {r["node"]: r["label"] for r in own.collect()}
        assert sorted(label) == nodes and not pieces(edges, label)
        sizes = [sum(v == k for v in label.values()) for k in range(len(set(label.values())))]
        assert sizes == sorted(sizes, reverse=True) and min(sizes) > 0
        plain = spark.createDataFrame([(n, int(c)) for n, c in zip(nodes, louvain(len(nodes), src, dst, w, gamma, 123))], "node long, label long")
        quality = [graph.modularity(embedded, x, gamma).first()["quality"] for x in (own, plain)]
        # many partitions of this graph are nearly as good as one another at the larger resolution
        assert quality[0] >= quality[1] * (1 if gamma < 1 else 0.99) - 1e-9


def test_same_labels_for_any_partitioning(spark, embedded):
    rows = []
    for n in (1, 13):
        shuffled = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(tuple, graph.communities(embedded.repartition(n), [1.0], seed=7).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
    assert rows[0] == rows[1]


def test_a_community_that_falls_apart_is_cut(spark):
    both = lambda pairs: [(a, b, 1.0) for x, y in pairs for a, b in ((x, y), (y, x))]
    edges = spark.createDataFrame(both([(1, 2), (2, 3), (4, 5), (3, 9), (5, 9)]), EDGES)
    tables = []
    links = materialise(edges.selectExpr("src AS i", "dst AS j", "1L AS x", "0 AS run"), "test-links")
    whole = leiden._Graph(links, 1.0, [1.0], 1, tables)
    labels = spark.createDataFrame([(0, n, 7 if n != 9 else 9) for n in (1, 2, 3, 4, 5, 9)], "run int, node long, label long")
    assert {r["node"]: r["label"] for r in leiden._connected(whole, labels).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9}


def test_parts_are_connected_and_lie_in_their_community(spark, embedded):
    tables = []
    links = materialise(embedded.filter("src <> dst").select(F.col("src").alias("i"), F.col("dst").alias("j"), F.round(F.col("w") * 1e9).cast("long").alias("x"), F.lit(0).alias("run")), "test-links")
    whole = leiden._Graph(links, 1.0, [1.0], 3, tables)
    whole.whole = whole.nodes.agg(F.sum("k")).first()[0] / 2
    labels = whole.nodes.withColumn("label", F.col("node") % 3)
    parts = {r["node"]: (r["label"], r["part"]) for r in leiden._refined(whole, labels).collect()}
    inside = defaultdict(set)
    for n, (label, part) in parts.items():
        assert n % 3 == label
        inside[part].add(label)
    assert all(len(v) == 1 for v in inside.values()) and len(inside) < len(parts)
    assert not pieces(embedded.collect(), {n: p for n, (_, p) in parts.items()})


def test_awkward_graphs(spark):
    run = lambda rows, schema=EDGES, **k: sorted((r["node"], r["label"]) for r in graph.communities(spark.createDataFrame(rows, schema), [1.0], **k).collect())
    assert run([]) == []
    assert run([(1, 1, 2.0)]) == [(1, 0)]
    assert run([(1, 2, 0.0), (2, 1, 0.0)]) == [(1, 0), (2, 1)]
    assert run([(1, 2, 1.0), (2, 1, 1.0), (None, 2, 1.0), (3, None, 1.0), (4, 4, None)]) == [(1, 0), (2, 0)]
    # names as nodes, a loop, and two equal pairs
    names = [("b", "a", 1.0), ("a", "b", 1.0), ("c", "d", 1.0), ("d", "c", 1.0), ("a", "a", 0.5)]
    for refine in (True, False):
        assert run(names, "src string, dst string, w double", refine=refine) == [("a", 0), ("b", 0), ("c", 1), ("d", 1)]


def test_links_stay_where_they_are_in_a_round(spark, embedded, monkeypatch):
    # what is shuffled in a round of moves is keyed by labels, so only sizes of communities are; the links are dealt once a level
    plans, write = [], leiden.materialise

    def noted(df, label, **more):
        if label == "communities-turn":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label, **more)

    monkeypatch.setattr(leiden, "materialise", noted)
    few = embedded.filter("src % 8 = 0 AND dst % 8 = 0")
    sent = sorted(map(tuple, graph.communities(few, [1.0]).collect()))
    shuffles = [line for plan in plans for line in plan.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION" not in line]
    assert plans and shuffles and all("label" in line.split("hashpartitioning(")[1].split(")")[0] for line in shuffles)
    # with more nodes than are sent the labels are shuffled to the links, and nothing changes
    plans.clear()
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, graph.communities(few, [1.0], sent=0).collect())) == sent
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert plans and not any("BroadcastHashJoin" in plan for plan in plans)


def test_lists_of_links_choose_as_joined_links_do(spark, embedded, monkeypatch):
    # whole weights, so that many gains are equal; far apart numbers of nodes, which are not looked up in a table
    monkeypatch.setattr(leiden, "LIST_LINKS", 500)
    node = lambda c: F.col(c) * 10**9 - 7
    pairs = embedded.filter("src <> dst").select(node("src").alias("i"), node("dst").alias("j"), F.lit(1).cast("long").alias("x"))
    loops = pairs.select("i", F.col("i").alias("j"), F.lit(0).cast("long").alias("x")).distinct()
    shared = materialise(pairs.union(loops), "test-links")
    for links in (shared, shared.withColumn("run", F.explode(F.array(F.lit(0), F.lit(1)))).filter("run = 0 OR i % 3 + j % 3 <> 1 OR i = j")):
        whole = leiden._Graph(links, 1.0, [0.5, 1.0], 3, [])
        whole.whole = whole.strength / 2
        for labels in (whole.nodes.withColumn("label", F.col("node")), whole.nodes.withColumn("label", (F.col("node") + 7) / 10**9 % 3).withColumn("label", F.col("label").cast("long")), whole.nodes.filter("run = 1").withColumn("label", F.lit(5).cast("long"))):
            sizes = labels.groupBy("run", "label").agg(F.sum("k").alias("total"), F.count("*").alias("n"))
            sized = labels.join(sizes, ["run", "label"])
            for number in (0, 1):
                columns = ["run", "node", "k", "label", "to", "inside", "total"]
                joined, listed = (sorted(map(tuple, f(whole, sized, number).select(*columns).collect())) for f in (leiden._chosen, leiden._chosen_in_lists))
                assert joined and joined == listed
        whole.release()


def test_a_round_sends_labels_and_leaves_links_in_their_lists(spark, embedded):
    links = materialise(embedded.selectExpr("src AS i", "dst AS j", "1L AS x").union(embedded.selectExpr("src AS i", "src AS j", "0L AS x").distinct()), "test-links")
    graph = leiden._Graph(links, 1.0, [1.0], 3, [])
    graph.whole = graph.strength / 2
    step, quality = leiden._turn(graph, graph.nodes.withColumn("label", F.col("node")), 0)
    assert quality and step.count() == graph.n and graph.lists is not None and sum(len(r["i"]) for r in graph.lists.collect()) == links.count()
    graph.release()
