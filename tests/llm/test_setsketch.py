import numpy as np

from terrane.llm import setsketch
from terrane.llm.graph import components

from .fixtures import EXTRA, SF, near_duplicates


def _got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = near_duplicates(rows)
    assert _got(setsketch.near_duplicates(docs)) == want
    assert len({c for _, c in want.values()}) < len(want)


def _variants(seed, copies, edits):
    """Copies of one text, each with a few words changed, and chains in which each changes the one before."""
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(4000)}" for _ in range(300)]
    out = [list(base)]
    for k in range(copies):
        t = list(base if k % 2 else out[-1])
        for p in rng.integers(0, len(t), edits):
            t[p] = f"x{rng.integers(10**6)}"
        out.append(t)
    return [" ".join(t) for t in out]


def test_large_groups_and_chains(spark):
    texts = _variants(1, 150, 3) + _variants(2, 120, 6) + _variants(3, 90, 1) * 2
    order = np.random.default_rng(5).permutation(len(texts))
    rows = [(int(i), texts[k]) for i, k in enumerate(order)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert _got(setsketch.near_duplicates(df)) == near_duplicates(rows)


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "SMALL_BUCKET", 3)
    monkeypatch.setattr(setsketch, "BLOCK", 8)
    texts = _variants(4, 60, 5) + _variants(6, 40, 8)
    rows = [(i, t) for i, t in enumerate(texts)]
    assert _got(setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == near_duplicates(rows)


def test_awkward_rows(spark):
    rows = [(1, None, 0.0, 1, "a", 1, "s"), (2, "", 0.0, 1, None, 1, "s"), (3, " \t\n", None, None, None, None, None), (4, "A b", 0.0, 1, "a", 1, "s"), (5, "a B", 0.0, 1, "a", 1, "s"), (6, "a b c d e", 0.0, 1, "a", 1, "s"), (6, "a b c d e", 0.0, 1, "a", 1, "s"), (7, "É b", 0.0, 1, "a", 1, "s"), (8, "é b", 0.0, 1, "a", 1, "s"), (None, "a b", 0.0, 1, "a", 1, "s"), (9, "word " * 200_000, 0.0, 1, "a", 1, "s")]
    out = setsketch.near_duplicates(spark.createDataFrame(rows, EXTRA)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in out if r["doc_id"]) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 9, True)]
    assert [(r["component_id"], r["kept"]) for r in out if r["doc_id"] is None] == [(None, True)]
    assert setsketch.near_duplicates(spark.createDataFrame([], EXTRA)).count() == 0
    kept = setsketch.keep_one(spark.createDataFrame(rows, EXTRA))
    assert kept.columns == ["doc_id", "text", "score", "n", "spans", "label", "source"]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 6, 7, 8, 9]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**63, 500, dtype=np.uint64) for _ in range(2))
    assert (setsketch.merge(setsketch.registers(a), setsketch.registers(b)) == setsketch.registers(np.concatenate((a, b)))).all()
    same = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        same.append((setsketch.registers(x[:900]) == setsketch.registers(x[100:])).mean())
    assert abs(np.mean(same) - 0.8) < 0.01


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 180)] + [(300, 300), (None, 4)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 180)}}


def test_rows_with_equal_ids_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (6, a), (6, b), (9, b), (9, b), (4, c), (4, None), (None, a), (2, ""), (2, "x y")]
    got = setsketch.near_duplicates(spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, kept double"))
    key = lambda r: str(r)
    want = [(3, 36, 3, True), (6, 36, 3, False), (6, 36, 3, False), (9, 36, 3, False), (9, 36, 3, False), (4, 36, 4, True), (4, 0, 4, True), (None, 36, None, True), (2, 0, 2, True), (2, 1, 2, True)]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    kept = setsketch.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 2, 2, 3, 4, 4]
