import json

import corpus_pipeline
import __spark_entry__

from .fixtures import SF, near_duplicates


def test_stages_keep_their_promises(spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    first = docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        left[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    assert set(left["language"]) == {d for d, t in texts.items() if any(c.isalpha() for c in t)}
    want = near_duplicates(sorted(left["language"].items()))
    assert set(left["near_duplicates"]) == {d for d, (_, c) in want.items() if c == d}
    assert set(left["decontamination"]) < set(left["near_duplicates"])
    assert set(left["secrets"]) == set(left["decontamination"])
    changed = {d for d, t in left["secrets"].items() if t != left["decontamination"][d]}
    assert changed and all("[SECRET]" in left["secrets"][d] for d in changed)


def test_run_covers_what_is_left(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert out and all(r["length"] <= 2048 and len(r["ids"]) == 4 * r["length"] for r in out)


def test_registered():
    q = __spark_entry__.queries()
    assert q["pipeline"] is corpus_pipeline.run and {f"op{i}_" for i in range(1, 11)} <= {k.split("_")[0] + "_" for k in q}
    json.dumps(__spark_entry__.oracle_sql())
