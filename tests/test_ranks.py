"""Numbers and quantiles from ranges against plain sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import ranks

AT = [0.0, 0.005, 0.1, 0.5, 0.73, 0.995, 1.0]


@pytest.mark.parametrize("kind", ["even", "ties", "one group"])
def test_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(1)
    v = rng.normal(size=2000) if kind != "ties" else rng.integers(0, 5, 2000).astype(float)
    g = rng.choice(["a", "b", None], 2000, p=[0.9, 0.09, 0.01]) if kind != "one group" else np.full(2000, "a")
    df = spark.createDataFrame([(x, float(y)) for x, y in zip(g.tolist(), v)] + [("a", None), ("empty", None)], "g string, v double").repartition(7)
    got = {r["g"]: r["q"] for r in ranks.quantiles(df, ["g"], "v", AT).collect()}
    assert got.keys() == set(g.tolist())
    for k, q in got.items():
        own = v[[x == k for x in g.tolist()]]
        assert np.allclose(q, np.quantile(own, AT), rtol=0, atol=1e-12)
    whole = ranks.quantiles(df, [], "v", AT).collect()
    assert len(whole) == 1 and np.allclose(whole[0]["q"], np.quantile(v, AT), rtol=0, atol=1e-12)
    assert ranks.quantiles(df.filter("false"), [], "v", AT).count() == 0
    middle = {r["g"]: r["v"] for r in ranks.medians(df.filter("v IS NOT NULL"), ["g"], "v").collect()}
    assert all(abs(middle[k] - got[k][3]) < 1e-12 for k in got)


def test_no_state_grows_with_the_values(spark):
    """Aggregates are counts, sums and extremes, and the only window over everything is over one row for each range."""
    plan = ranks.quantiles(spark.range(1000).withColumn("v", F.rand(1)), [], "v", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(i % 37, f"n{i % 5}") for i in range(500)] + [(None, "z")], "a int, b string").repartition(9)
    got = [(r["at"], r["b"], r["a"]) for r in ranks.numbered(df, ["b", "a"], "at").orderBy("at").collect()]
    want = sorted({(f"n{i % 5}", i % 37) for i in range(500)}) + [("z", None)]
    assert got == [(i, b, a) for i, (b, a) in enumerate(want)]
    assert ranks.numbered(df.filter("false"), ["a"], "at").count() == 0
