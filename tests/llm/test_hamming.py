import numpy as np
import pytest

from terrane.llm import hamming

from .fixtures import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    """{vec_id: (links, component)} over all pairs of a label, and the pairs' number."""
    usable = [(i, np.array(v, np.float64), k) for i, v, k in rows if k is not None and v is not None and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for a in range(len(usable)):
        for b in range(a + 1, len(usable)):
            (i, x, k), (j, y, m) = usable[a], usable[b]
            if k == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i] += 1
                links[j] += 1
                pairs += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (links[i], find(i)) for i in links}, pairs


def _got(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def _clouds(seed, groups, size, noise):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        centre = rng.standard_normal(32)
        for _ in range(size):
            out.append((centre + noise * rng.standard_normal(32), g % 3))
    return out


def test_recall_against_brute_force(spark):
    clouds = _clouds(1, 40, 6, 0.2) + _clouds(2, 30, 4, 0.3) + _clouds(3, 200, 1, 0)
    rows = [(i, [float(np.float32(e)) for e in v], k) for i, (v, k) in enumerate(clouds)]
    want, pairs = brute(rows)
    got = _got(hamming.near_vectors(spark.createDataFrame(rows, SCHEMA)))
    assert pairs > 200 and set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * 2 * pairs


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    want, pairs = brute(rows)
    got = _got(hamming.near_vectors(df))
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.9 * 2 * pairs


def test_hot_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK", 16)
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(16)
    near = [(i, [float(np.float32(e)) for e in centre + 0.02 * rng.standard_normal(16)], 1) for i in range(120)]
    copies = [(200 + i, near[0][1], 1) for i in range(30)]
    got = _got(hamming.near_vectors(spark.createDataFrame(near + copies, SCHEMA)))
    assert set(got.values()) == {(149, 0)}


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [1.0, nan], 1), (5, [inf, 1.0], 1), (6, [1.0, 1.0], None), (7, [1.0, 1.0], 1), (8, [2.0, 2.0], 1), (9, [1.0, 1.0], 2), (10, [1.0, 1.0, 1.0], 1), (11, [], 1), (7, [1.0, 1.0], 1), (None, [1.0, 1.0], 1)]
    out = hamming.near_vectors(spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA + ", n_links string, v int")).collect()
    assert len(out) == len(rows)
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out}
    assert got == {(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10, 11)} | {(7, 2, 7, True), (8, 2, 7, False), (None, 0, None, True)}
    assert hamming.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("width", [4, 12, 18])
def test_recall_at_the_threshold_by_width(spark, width):
    rng = np.random.default_rng(width)
    rows = []
    for shape in range(3):
        # isotropic vectors, vectors far from the origin, vectors of few dimensions
        turn = rng.standard_normal((6, 32)) if shape == 2 else np.eye(32)
        for g in range(150):
            x = rng.standard_normal(turn.shape[0]) @ turn + (3 if shape == 1 else 0)
            y = rng.standard_normal(turn.shape[0]) @ turn
            x, y = x / np.sqrt(x @ x), y - (y @ x) / (x @ x) * x
            for c in (1, 0.94, 0.932):
                v = c * x + np.sqrt(1 - c * c) * y / np.sqrt(y @ y)
                rows.append((len(rows), [float(e) for e in v], shape))
    want, pairs = brute(rows)
    found = {}
    for most in (200_000, 0):
        got = _got(hamming.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), width=width, broadcast_rows=most))
        assert all(got[i][0] <= want[i][0] for i in want)
        found[most] = got
    assert found[0] == found[200_000] and pairs >= 1000
    assert sum(n for n, _ in found[0].values()) >= 0.99 * 2 * pairs


def test_radius_is_the_tail_of_the_binomial():
    rng = np.random.default_rng(0)
    flips = rng.binomial(126, 0.12, 2_000_000)
    r = hamming.radius(126, 0.12, 1e-3)
    assert (flips > r).mean() <= 1.1e-3 and (flips > r - 1).mean() > 0.9e-3
