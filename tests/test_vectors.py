"""Packed vector search against brute force: clustered and even data, ties, small blocks, what is left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import vectors

SCHEMA = "id long, v array<double>"


def frame(spark, x, ids=None, partitions=4):
    return spark.createDataFrame([(int(i), [float(a) for a in r]) for i, r in zip(range(len(x)) if ids is None else ids, x)], SCHEMA).repartition(partitions)


def brute(x, ids, k, include_self, digits):
    out = []
    for r, i in zip(x, ids):
        d = np.round(np.sqrt(((r - x) ** 2).sum(1)), digits)
        near = [j for j in np.lexsort((ids, d)) if include_self or ids[j] != i][:k]
        out += [(int(i), int(ids[j]), float(d[j])) for j in near]
    return sorted(out)


def clustered(n=600, dims=12, groups=12, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, dims))[rng.integers(0, groups, n)] * 5 + rng.normal(size=(n, dims)) * spread


@pytest.mark.parametrize("include_self", [True, False])
@pytest.mark.parametrize("kind", ["clustered", "even", "ties"])
def test_neighbours_equal_brute_force(spark, kind, include_self):
    rng = np.random.default_rng(2)
    x = {"clustered": clustered(), "even": rng.normal(size=(500, 8)), "ties": rng.integers(0, 3, (400, 4)).astype(float)}[kind]
    ids = rng.permutation(len(x)) * 3
    got = sorted(map(tuple, vectors.neighbours(frame(spark, x, ids), 7, include_self, block=40, digits=6).collect()))
    assert got == brute(x, ids, 7, include_self, 6)


def test_blocks_that_are_too_far_are_left_out(spark):
    x = clustered(4000, 16, 40)
    blocks, _ = vectors.pack(frame(spark, x), 10, 100)
    count = blocks.count()
    pairs = vectors.block_pairs(blocks)
    copies = pairs.join(blocks.select(F.col("b").alias("c"), "n"), "c").agg(F.sum("n")).first()[0] / len(x)
    assert blocks.agg(F.sum("n")).first()[0] == len(x) and count > 30
    # each vector goes to a few blocks, where all pairs of blocks would take it to all
    assert copies < 6 and pairs.count() < 0.15 * count**2
    # even data: nothing is lost, and nothing can be left out
    even, _ = vectors.pack(frame(spark, np.random.default_rng(3).normal(size=(600, 16))), 10, 50)
    assert vectors.block_pairs(even).count() <= even.count() ** 2


def test_fewer_rows_than_asked_for_and_none(spark):
    x = np.array([[0.0, 0], [1, 0], [5, 5]])
    assert sorted(map(tuple, vectors.neighbours(frame(spark, x), 15).collect())) == brute(x, np.arange(3), 15, True, 9)
    assert vectors.neighbours(frame(spark, x[:1]), 3, include_self=False).count() == 0
    assert vectors.neighbours(spark.createDataFrame([], SCHEMA), 3).count() == 0
    some = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (None, [1.0, 1.0])], SCHEMA)
    assert [tuple(r) for r in vectors.neighbours(some, 3).collect()] == [(1, 1, 0.0)]


def test_label_sums_equal_brute_force(spark):
    x, rng = clustered(300, 6, 5, 0.5), np.random.default_rng(4)
    g = rng.integers(0, 4, len(x))
    df = spark.createDataFrame([(i, int(c), [float(a) for a in r]) for i, (r, c) in enumerate(zip(x, g))], "id long, cluster long, v array<double>")
    got = {(r["id"], r["other"]): (r["cluster"], r["n"], r["s"], r["q"]) for r in vectors.label_sums(df, block=32).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert len(got) == len(x) * 4
    for (i, other), (c, n, s, q) in got.items():
        own = (g == other) & (np.arange(len(x)) != i)
        assert c == g[i] and n == own.sum() and abs(s - d[i][own].sum()) < 1e-8 and abs(q - (d[i][own] ** 2).sum()) < 1e-7


def test_products_near_zero_are_exact():
    x = np.random.default_rng(5).normal(size=(50, 20)) * 1000
    y = x + 1e-7
    assert np.allclose(vectors.squares(x, y).diagonal(), ((x - y) ** 2).sum(1), rtol=1e-12, atol=0)


def test_blocks_are_sent_a_fixed_number_of_times(spark):
    """All pairs of blocks are compared, but a block is sent once for each row and column of tiles, however many blocks there are."""
    sent = {}
    for n in (500, 2000):
        blocks, width = vectors.pack(frame(spark, np.random.default_rng(6).normal(size=(n, 4))), 0, 20)
        count = blocks.count()
        pairs = blocks.select("b", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("c"))
        side = int(np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism)))
        tiles = [r["count"] for r in vectors._meetings(blocks, pairs, width).count().collect()]
        assert len(tiles) == side**2 and max(tiles) <= 2 * -(-count // side)
        sent[n] = sum(tiles) / count
    assert sent[500] == sent[2000] == 2 * side
