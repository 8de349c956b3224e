"""Scores of the learned operators against plain loops over whole texts, and the pipeline on awkward rows."""

import math
import re

import pytest

import corpus_pipeline
from terrane.llm import langid, quality, registry, toxicity

from .fixtures import SF

TEXTS = [None, "", " \n\n ", "12 %%", "The quick, brown fox\njumps OVER it!!", "la cosa de la casa", "a", "straße ΣΑΣ été 日本", "word " * 3000 + "\n*** 77 77\n", "the thing of\n\nidiot moron idiot\nfine"]


def sampled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("text IS NOT NULL").orderBy("doc_id").limit(25).collect()
    return list(enumerate(TEXTS + [r["text"] for r in docs]))


def plain_marginals(logits, trans, init):
    """P(1) at each position by forward and backward sums in logarithms."""
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    unary = [(0.0, max(-25.0, min(25.0, float(x)))) for x in logits]
    ahead, back = [(0.0, unary[0][1] + init)], [(0.0, 0.0)]
    for u in unary[1:]:
        ahead.append(tuple(u[s] + add(ahead[-1][0] + trans[0][s], ahead[-1][1] + trans[1][s]) for s in (0, 1)))
    for u in reversed(unary[1:]):
        back.append(tuple(add(trans[s][0] + u[0] + back[-1][0], trans[s][1] + u[1] + back[-1][1]) for s in (0, 1)))
    return [1 / (1 + math.exp(min(700, f[0] + b[0] - f[1] - b[1]))) for f, b in zip(ahead, reversed(back))]


def logistic(weights, x):
    return 1 / (1 + math.exp(-max(-30, min(30, sum(w * v for w, v in zip(weights, x))))))


def odds(p):
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def plain_grams(text):
    for w in (text or "").split():
        w = "".join(filter(str.isalpha, langid.NOT_LETTERS.sub("", w).lower()))
        padded = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if w and gram.strip() and len(gram.strip()) >= n - 1:
                    h = n
                    for c, m in zip(gram, langid.MULTIPLIERS.tolist()):
                        h = ((h ^ (ord(c) + 1)) * m) % 2**64
                        h ^= h >> 29
                    yield h % langid.BUCKETS


def test_languages_against_a_plain_loop(spark):
    labelled = [(i, t, lang) for i, (t, lang) in enumerate([("the thing of it", "en"), ("la cosa de el", "es"), ("das ding von ihm", "de"), ("ne le pas vous", "fr")] * 6)]
    model = langid.train(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    rows = sampled(spark)
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        grams = list(plain_grams(text))
        if not grams:
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["ambiguous"]) == ("und", 0, False)
            continue
        bits = [sum(float(model.weights[g, k]) for g in grams) / len(grams) * langid.SCALE + float(model.bias[k]) for k in range(model.code.shape[1])]
        loss = [sum(t * math.log1p(math.exp(-b * c)) for t, b, c in zip(model.trust, bits, code)) for code in model.code]
        share = [math.exp(-x * len(bits)) for x in loss]
        best = loss.index(min(loss))
        assert got[i]["lang_pred"] == model.languages[best]
        assert abs(got[i]["score"] - share[best] / sum(share)) < 1e-4
        gap = sorted(loss)[1] - min(loss) - langid.MARGIN
        assert abs(gap) < 1e-5 or got[i]["ambiguous"] == (gap < 0)


def test_toxic_scores_and_spans_against_a_plain_loop(spark):
    # no two share three neighbouring words, as copies count once
    labelled = [(i, f"q{i} day r{i} {'idiot' if i % 2 else 'sunny'} s{i} t{i} {'moron' if i % 2 else 'fine'} u{i} thing", i % 2) for i in range(80)]
    labelled = spark.createDataFrame(labelled, "doc_id long, text string, label int")
    model = toxicity.train(labelled, labelled)
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist()))
    rows = sampled(spark)
    got = {r["doc_id"]: r for r in toxicity.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    found = 0
    for i, text in rows:
        words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", text or "")]
        x, spans = [0, 0, 0, 1], []
        if words:
            p = plain_marginals([sum(weight.get(h, 0.0) for h in toxicity.word_features([w])[0].tolist()) + model.bias for w, _, _ in words], model.trans.tolist(), model.init)
            x = [odds(max(p)) - math.log(1e-4), math.log1p(sum(p)), 10 * sum(p) / len(p), 1]
            for k, (_, a, b) in enumerate(words):
                if p[k] > 0.5 and k and p[k - 1] > 0.5:
                    spans[-1][1] = b
                elif p[k] > 0.5:
                    spans.append([a, b])
        found += len(spans)
        assert abs(got[i]["score"] - logistic(model.document, x)) < 1e-4
        assert [[s["start"], s["end"]] for s in got[i]["spans"]] == spans
    assert found


def plain_line(line):
    kinds = lambda b: 0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 if b in b"\t\n\x0b\x0c\r " else 4 if b < 128 else 5
    c = [sum(kinds(b) == k for b in line) for k in range(6)]
    words = line.split()
    some, size, letters = max(len(words), 1), max(len(line), 1), max(c[0] + c[1] + c[5], 1)
    doubled = sum(a == b and kinds(a) == 4 for a, b in zip(line, line[1:]))
    repeats, single = sum(a == b for a, b in zip(words, words[1:])), sum(len(w) == 1 for w in words)
    return [c[0] / letters, c[2] / size, c[4] / size, doubled / some, 1 - len(set(words)) / some, repeats / some, single / some, c[3] / size, math.log1p(len(words)) / 5, float(not words), c[4] / some / 4, min(size / some, 40) / 20, float(c[0] > 0.5 * letters), 1.0]


def test_quality_against_a_plain_loop(spark):
    labelled = spark.createDataFrame([(i, f"A good line of {i} words\nand another one" if i % 2 else f"$$$ BUY {i} NOW !!!\n*** *** 99 99", i % 2) for i in range(60)], "doc_id long, text string, label int")
    model = quality.train(labelled, labelled)
    rows = sampled(spark)
    got = {r["doc_id"]: r["score"] for r in quality.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    none = [0.0] * quality.FEATURES
    for i, text in rows:
        lines = (text or "").encode().split(b"\n")
        x = [none, *map(plain_line, lines), none]
        p = plain_marginals([sum(w * v for w, v in zip(model.weights, x[k] + x[k - 1] + x[k + 1])) for k in range(1, len(x) - 1)], model.trans.tolist(), model.init)
        size = [len(line) + 1.0 for line in lines]
        bad = sum(a * b for a, b in zip(p, size))
        assert abs(got[i] - logistic(model.document, [bad / sum(size), odds(max(p)) / 4, math.log1p(bad) / 5, math.log(sum(size)) / 5, 1])) < 1e-6


def awkward(spark, tmp_path, empty):
    """Tables in which columns clash with operators' own, ids repeat or are null, and a text is very long."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = benchmark.filter("text IS NOT NULL").orderBy("item_id").first()["text"]
    lang = next(r["lang"] for r in docs if r["lang"] and r["text"])
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], i, "x") for i, r in enumerate(docs)]
    rows += [rows[3], (None, f"before {item} after", lang, "s", 1, 100, "y"), (None, None, None, None, None, None, None), (900001, "", lang, "s", 0, 101, "z"), (900002, " ".join(f"und{k} word{k % 91}" for k in range(60_000)), lang, "s", 1, 102, "w")]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long, gone string")
    (out.limit(0) if empty else out).write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, item


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_awkward_rows(spark, tmp_path, empty):
    rows, item = awkward(spark, tmp_path, empty)
    docs, texts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), "test-awkward")
        assert docs.columns == columns
        texts.append({(r["doc_id"], r["text"]) for r in docs.collect()})
    if empty:
        assert not any(texts) and corpus_pipeline.run(spark, str(tmp_path)).count() == 0
        return
    leak = (None, f"before {item} after")
    assert leak in texts[0] and leak not in texts[2]
    assert all(t and any(c.isalpha() for c in t) for _, t in texts[0])
    assert any(d == 900002 for d, _ in texts[3])
    assert all(r["length"] <= 2048 for r in corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_every_operator_is_registered_once():
    names = sorted(registry.queries())
    assert sorted(int(re.match(r"op(\d+)_", n).group(1)) for n in names) == list(range(1, 13))
