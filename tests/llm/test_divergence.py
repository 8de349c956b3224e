"""Divergence of sources: against a plain loop over exact integers, its SQL, and with small blocks and tiles."""

import random
import re
from collections import Counter

import duckdb
import numpy as np

from terrane.llm import divergence, registry
from terrane.llm.sql import ORACLES

from .fixtures import SF


def brute(docs, least=30, top=50):
    seen, every, counts = {}, {}, {}
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        counts.setdefault((lang, source), Counter()).update(words)
        every.setdefault(lang, Counter()).update(words)
        seen.setdefault(lang, Counter()).update(set(words))
    out = []
    for (lang, source), own in counts.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = share(own), share(every[lang])
        pairs = []
        for (l2, s2), c2 in counts.items():
            if l2 == lang and s2 != source:
                o = share(c2)
                pairs.append((sum(abs(p[t] - o[t]) for t in kept), s2))
        terms = [(p[t] - q[t], t) for t in kept if own[t] > 0 and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def made(n=1200, groups=9, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "日本", "Don't", "A1b"]
    words = [re.sub("[0-9]", lambda m: chr(97 + int(m[0])), w) for w in words]
    docs = []
    for _ in range(n):
        lang = rng.choice(["en", "de", None, "xx"])
        text = None if rng.random() < 0.05 else "1 2 !" if lang == "xx" else " ".join(rng.choice(words).title() if rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randrange(40)))
        docs.append((text, lang, rng.choice([None, *[f"s{i}" for i in range(groups)]])))
    return docs


def test_against_a_plain_loop(spark):
    docs = made()
    docs += docs[:50]
    schema = "text string, lang string, source string, term string, n long, value long, rank int, tile int"
    got = rows(divergence.divergence(spark.createDataFrame([(*d, "x", 1, 2, 3, 4) for d in docs], schema)))
    want = brute(docs)
    assert got == want
    assert {("", "", "pair"), ("xx", "", "pair"), ("en", "s0", "term")} <= {r[:3] for r in got}
    assert not any(r[0] == "xx" and r[4] for r in got)


def test_tiles_and_blocks_do_not_change_results(spark, monkeypatch):
    docs = made()
    frame = spark.createDataFrame(docs, "text string, lang string, source string")
    monkeypatch.setattr(divergence, "TERMS", 7)
    monkeypatch.setattr(divergence, "GROUPS", 4)
    monkeypatch.setattr(divergence, "AT_ONCE", 50)
    assert rows(divergence.divergence(frame, 5, 4)) == brute(docs, 5, 4)


def test_slices_and_flushes_do_not_change_counts(monkeypatch):
    text = " ".join(random.Random(1).choice("alpha Beta gamma, délta eps zeta".split()) for _ in range(3000)).encode()
    monkeypatch.setattr(divergence, "SLICE", 50)
    monkeypatch.setattr(divergence, "FLUSH", 3)
    counts, n, docs = divergence._Counts(), Counter(), Counter()
    for batch in [*counts.add(("a", "b"), text), *counts.flush()]:
        for r in batch.to_pylist():
            n[r["term"]] += r["n"]
            docs[r["term"]] += r["docs"]
    want = Counter(text.decode().lower().replace(",", "").split())
    del n[None], docs[None]
    assert n == want and docs == dict.fromkeys(want, 1)


def test_shares_are_exact():
    counts, whole = np.array([0, 7, 10**14, 3 * 10**15], np.int64), np.array([5, 12 * 10**9, 10**15 + 3, 3 * 10**15 + 5], np.int64)
    assert divergence.shares(counts, whole).tolist() == [1 + 10**9 * (int(c) + 5) // int(w) for c, w in zip(counts, whole)]


def test_empty_and_wordless(spark):
    schema = "text string, lang string, source string"
    assert divergence.divergence(spark.createDataFrame([], schema)).count() == 0
    docs = [(None, None, None), ("", "en", "a"), ("12", "en", "b")]
    assert rows(divergence.divergence(spark.createDataFrame(docs, schema))) == brute(docs) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({ORACLES['op12_source_divergence']})").fetchall()
    got = rows(registry.op12_source_divergence(spark, SF))
    assert len(got) > 1000 and got == sorted(want)
