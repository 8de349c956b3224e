import zlib

import numpy as np
import public_tokenizers
import pytest

from terrane.llm import packing, token_files, tokens
from terrane.llm.registry import VOCABULARY

from .fixtures import EXTRA, SF

ODD = ["a\x1cb it's don't we'll 12.5%%% ΑΣ ΣΑΣ İx ǅ <|endoftext|> <|endoftext|>x é  x\u0085y​z é ÀÉ×÷ ﻿ 日本語 テスト 'S 'RE'' x'*** ***'s it'should", "", "x" * 5000, "\x00\x01 a　b c", "K Å ﬁ ½ ² a² ª", "\x1c \x1d"]


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r["doc_id"], r["text"]) for r in rows)


@pytest.fixture(scope="module")
def ids(documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return {d: np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4") for d, x in documents}


def test_encoder_equals_the_library(documents):
    e = tokens.Encoder(VOCABULARY, limit=500)
    texts = [t for _, t in documents[:300]] + ODD
    got = [x for i in range(0, len(texts), 7) for x in e.encode_many(texts[i : i + 7])]
    want = [np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert got == want
    assert e.encode(None) == b""


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("top", [1, 2, 50_000, 2**32])
def test_blocks_round_trip(n, top):
    x = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    x[::50] = np.uint32(top - 1)
    assert (token_files.unpack_ids(memoryview(token_files.pack_ids(x)), n) == x).all()


def test_token_files_whole_table(spark, ids, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 20_000)
    got = sorted(token_files.read_token_files(token_files.write_token_files(spark.read.parquet(f"{SF}/documents.parquet"), VOCABULARY)).collect())
    start, want = 0, []
    for d in sorted(ids):
        want.append((d, start, len(ids[d]), zlib.crc32(ids[d].tobytes())))
        start += len(ids[d])
    assert [tuple(r) for r in got] == want


def test_packing_whole_table(spark, ids):
    got = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), VOCABULARY).collect()
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["ids"] == piece.tobytes()
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(at) == list(range(len(at))) and all(at[s] == 2048 for s in at if s != len(at) - 1)
    assert sum(at.values()) == sum(map(len, ids.values()))


def test_neighbours_on_the_curve_are_alike(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = sorted(packing.pack(docs, VOCABULARY).filter("start = 0").collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    order = [lang[r["doc_id"]] for r in got]
    same = np.mean([a == b for a, b in zip(order, order[1:])])
    assert same > 0.7 > 0.5 > np.mean([order.count(x) / len(order) for x in order])


def test_hilbert_keys_step_by_one_cell():
    n = 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << n)] * 3, indexing="ij"), -1).reshape(-1, 3).astype(np.uint64)
    keys = packing.hilbert_keys(grid, n)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    path = grid[np.argsort(keys)].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "word " * 30_000), (None, "x")]
    df = spark.createDataFrame([(d, t, 0.0, 1, "x", 1, "s") for d, t in rows], EXTRA)
    got = token_files.read_token_files(token_files.write_token_files(df, VOCABULARY)).collect()
    assert sorted((r["doc_id"] or 0, r["start"], r["n_tokens"]) for r in got) == [(0, 0, 2), (1, 2, 1), (2, 3, 1), (3, 4, 3), (3, 7, 3), (4, 10, 30_001)]
    pieces = packing.pack(df, VOCABULARY).collect()
    assert sum(r["length"] for r in pieces) == 30_011 and len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)
    none = spark.createDataFrame([], EXTRA)
    assert packing.pack(none, VOCABULARY).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(none, VOCABULARY)).count() == 0


def test_vocabulary_path_is_a_parameter():
    assert VOCABULARY == public_tokenizers.path("word_bpe_49k.json")
